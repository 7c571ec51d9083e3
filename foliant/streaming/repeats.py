"""Repeated margin lines kept up as pages come: counts of (document, line) as a state, so that new pages don't recompute a document.

The state is a table of two kinds of rows: pages that were seen, and margin lines with the number of pages they stand on. A batch adds
what its new pages say to the rows of its documents and writes the folders these are in, in one dynamic partition overwrite; so a batch that is run again, or a
page that comes twice, changes nothing, and a batch that fails leaves the state as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import fold
from foliant.operators.layout import least_repeats, page_lines
from foliant.session import checkpointed

#: Folders of the state, by a hash of the document.
FOLDERS = 64
SCHEMA = "source_file string, page_pos int, normalized_text string, pages long, first struct<page_pos:int,line_pos:int,text:string>, margin_positions array<string>, folder int"


class Repeats:
    """The state at a path. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, folders: int = FOLDERS):
        self.spark, self.path, self.folders = spark, path, folders

    def state(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def add(self, numbered: DataFrame) -> DataFrame:
        """Takes pages (as layout.page_lines() does) into the state; source_file, normalized_text, repeated of the lines that are repeated now and were not, or the other way round.

        More pages of a document raise how many a line must stand on, so a line may cease to be repeated. A null document is one of its own.
        """
        folder = F.pmod(F.xxhash64(F.coalesce("source_file", F.lit(""))), F.lit(self.folders)).cast("int").alias("folder")
        numbered = checkpointed(numbered.dropDuplicates(["source_file", "page_pos"]).select("source_file", F.col("page_pos").cast("int").alias("page_pos"), "page_number", "height", "unit", "lines", folder))
        touched = [r.folder for r in numbered.select("folder").distinct().collect()]  # at most as many as there are folders
        before = checkpointed(self.state().filter(F.col("folder").isin(touched)))
        same = F.col("n.source_file").eqNullSafe(F.col("s.source_file")) & (F.col("n.page_pos") == F.col("s.page_pos"))
        new = checkpointed(numbered.alias("n").join(before.filter("normalized_text is null").select("source_file", "page_pos").alias("s"), same, "left_anti"))
        lines = page_lines(new.drop("folder")).filter("margin_position is not null").withColumn("normalized_text", fold("text")).filter("normalized_text <> ''")
        first = F.struct(F.col("page_pos").cast("int").alias("page_pos"), F.col("line_pos").cast("int").alias("line_pos"), "text")
        found = lines.groupBy("source_file", "normalized_text").agg(F.count_distinct("page_pos").alias("pages"), F.min(first).alias("first"), F.collect_set("margin_position").alias("margin_positions"))
        both = before.filter("normalized_text is not null").select("source_file", "normalized_text", "pages", "first", "margin_positions").unionByName(found)
        counts = both.groupBy("source_file", "normalized_text").agg(F.sum("pages").alias("pages"), F.min("first").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("margin_positions")))).alias("margin_positions"))  # at most a row of the state and one of the batch
        pages = before.filter("normalized_text is null").select("source_file", "page_pos").union(new.select("source_file", "page_pos"))
        after = checkpointed(pages.unionByName(counts, allowMissingColumns=True).select("*", folder).select(*before.columns))
        after.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(self.path)
        key = ["source_file", "normalized_text"]
        was, now = (repeated(x).select(*key, F.lit(True).alias("repeated")) for x in (before, after))
        gone = lambda x, y, r: x.alias("n").join(y.alias("s"), F.col("n.source_file").eqNullSafe(F.col("s.source_file")) & (F.col("n.normalized_text") == F.col("s.normalized_text")), "left_anti").select(*key, F.lit(r).alias("repeated"))
        return gone(now, was, True).union(gone(was, now, False))

    def read(self) -> DataFrame:
        """The rows of layout.repeated_lines() for all pages so far."""
        return repeated(self.state())


def repeated(state: DataFrame) -> DataFrame:
    enough = state.filter("normalized_text is null").groupBy("source_file").agg(least_repeats(F.count("*")).alias("min_repeat_pages"))
    lines = state.filter("normalized_text is not null").alias("n").join(enough.alias("s"), F.col("n.source_file").eqNullSafe(F.col("s.source_file")))
    return lines.filter("pages >= min_repeat_pages").select("n.source_file", "normalized_text", F.col("first.text").alias("text"), F.col("pages").alias("page_occurrence_count"), F.array_sort("margin_positions").alias("margin_positions"), "min_repeat_pages")


def add_available(pages: DataFrame, state: Repeats, checkpoint: str, changed: Callable[[DataFrame], None] = lambda x: None) -> None:
    """Takes what there is now of a stream of pages into the state and ends; changed gets what each batch changed."""
    pages.writeStream.foreachBatch(lambda batch, n: changed(state.add(batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
