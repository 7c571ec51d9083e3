"""Packing of ranked evidence into a bounded prompt context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import cut

SEPARATOR = "\n\n---\n\n"


def listed(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.array_join(x.cast("array<string>"), ", ", "None"), F.lit(""))


def section(most: int) -> Column:
    """The block of one hit: rank, score, company, document_id, source_file, page_numbers, chunk_id, chunk_type, section_titles, table_metadata (JSON text), text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    lines = [
        F.format_string("[Evidence %d]", F.col("rank")), F.format_string("score: %.6f", F.col("score")), F.concat(F.lit("company: "), said("company")), F.concat(F.lit("document_id: "), F.coalesce(F.col("document_id").cast("string"), F.lit(""))),
        F.concat(F.lit("source_file: "), said("source_file")), F.concat(F.lit("page_numbers: "), listed("page_numbers")), F.concat(F.lit("chunk_id: "), said("chunk_id")), F.concat(F.lit("chunk_type: "), said("chunk_type")), F.concat(F.lit("section_titles: "), listed("section_titles")),
        F.when(F.col("table_metadata").isNotNull(), F.concat(F.lit("table_metadata: "), F.col("table_metadata").cast("string"))), F.lit("exact_text:"), cut("text", most),
    ]
    return F.concat_ws("\n", *lines)


def packed(hits: DataFrame, most: int = 24_000, section_column: str = "section", query: str = "query_id", rank: str = "rank") -> DataFrame:
    """The hits that fit: the first always, then while the lengths add up to at most so many characters."""
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    own = hits.withColumn("_sum", F.sum(F.length(section_column)).over(w)).withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(rank)))
    return own.filter((F.col("_n") == 1) | (F.col("_sum") <= most)).drop("_sum", "_n")


def contexts(hits: DataFrame, most: int = 24_000, most_chunk: int = 2_500) -> DataFrame:
    """query_id, context of each query that has hits."""
    kept = packed(hits.withColumn("section", section(most_chunk)), most)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "section"))), lambda x: x["section"]), SEPARATOR).alias("context"))
