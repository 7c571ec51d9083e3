"""Normalisation of layout files: lines with bounds, page kinds, tables by page, repeated headers and footers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import collapse, filled, fold
from foliant.session import checkpointed, stored

MARGIN, INCHES, REPEATS = 0.08, 0.9, 5


@dataclass
class Layout:
    """Tables of normalised documents, by source_file and, below it, page_number or order."""

    documents: DataFrame
    pages: DataFrame
    lines: DataFrame
    page_tables: DataFrame
    unmapped_tables: DataFrame
    paragraphs: DataFrame
    repeated: DataFrame
    flagged: DataFrame


def bounds(polygon: Column) -> Column:
    """left, right, top, bottom of a polygon of x and y by turns; all null for fewer than 8 numbers."""
    good = F.coalesce(F.size(polygon) >= 8, F.lit(False)) & ~F.coalesce(F.exists(polygon, lambda v: v.isNull()), F.lit(False))
    x, y = F.filter(polygon, lambda v, i: i % 2 == 0), F.filter(polygon, lambda v, i: i % 2 == 1)
    # a corner each of four, as nearly all have, is read without a function over the array
    four = (F.size(polygon) == 8) & reduce(and_, (F.get(polygon, F.lit(i)).isNotNull() for i in range(8)))
    at = lambda first: [F.get(polygon, F.lit(i)) for i in range(first, 8, 2)]
    made = {"left": (F.least(*at(0)), F.array_min(x)), "right": (F.greatest(*at(0)), F.array_max(x)), "top": (F.least(*at(1)), F.array_min(y)), "bottom": (F.greatest(*at(1)), F.array_max(y))}
    return F.struct(*(F.when(four, few).when(good, many).alias(k) for k, (few, many) in made.items()))


def region_bounds(regions: Column, page: Column | None = None) -> Column:
    """Bounds of the regions that have some, of one page if it is given."""
    own = F.coalesce(regions, F.expr("cast(array() as array<struct<pageNumber:int,polygon:array<double>>>)"))
    own = own if page is None else F.filter(own, lambda r: r["pageNumber"] == page)
    return F.filter(F.transform(own, lambda r: bounds(r["polygon"])), lambda b: b["left"].isNotNull())


def inside(b: Column, areas: Column) -> Column:
    """Whether the centre of b lies in one of the areas, edges included."""
    x, y = (b["left"] + b["right"]) / 2, (b["top"] + b["bottom"]) / 2
    return F.coalesce(F.exists(areas, lambda a: x.between(a["left"], a["right"]) & y.between(a["top"], a["bottom"])), F.lit(False))


def page_kind(n_lines: Column, n_tables: Column) -> Column:
    return F.when((n_tables > 0) & (n_lines <= 10), "visual_or_table").when(n_tables > 0, "mixed").when(n_lines <= 8, "visual_or_cover").otherwise("text")


def margin_position(top: Column, bottom: Column, height: Column, unit: Column) -> Column:
    """top, bottom or null: where a line lies in the margins of its page. top comes first."""
    relative = height * MARGIN
    margin = F.when(F.lower(unit) == "inch", F.least(F.lit(INCHES), relative)).otherwise(relative)
    return F.when(height > 0, F.when(top <= margin, "top").when(bottom >= F.greatest(height - margin, F.lit(0.0)), "bottom"))


def least_repeats(n_pages: Column) -> Column:
    return F.when(n_pages < 2, 2).otherwise(F.least(F.lit(REPEATS), n_pages))


def repeated_lines(lines: DataFrame, pages: DataFrame, source: str = "source_file") -> DataFrame:
    """Of each document the folded margin lines that stand on enough pages: text (the first), normalized_text, page_occurrence_count, margin_positions, min_repeat_pages.

    lines: source, page_number, page_pos, line_pos, text, margin_position.
    """
    enough = pages.groupBy(source).agg(least_repeats(F.count("*")).alias("min_repeat_pages"))
    marked = lines.filter(F.col("margin_position").isNotNull() & filled("text")).withColumn("normalized_text", fold("text"))
    found = marked.groupBy(source, "normalized_text").agg(
        F.min_by("text", F.struct("page_pos", "line_pos")).alias("text"), F.count_distinct("page_pos").alias("page_occurrence_count"), F.sort_array(F.collect_set("margin_position")).alias("margin_positions")
    )
    return found.join(enough, source).filter("page_occurrence_count >= min_repeat_pages")


def normalize(raw: DataFrame, materialize: bool = False) -> Layout:
    """Tables of raw layout documents (foliant.sources.layout.RAW). Documents without a source name share the null one.

    materialize computes all but the paragraphs once, in the shared folder: chunking and measuring read them several times.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    root_names = ["apiVersion", "contentFormat", "stringIndexType", "modelId", "pages", "tables", "paragraphs", "sections", "styles", "figures"]
    d = raw.select(
        F.coalesce(*map(blank, ("source_file", "sourceFile", "source_path", "sourcePath"))).alias("source_file"), blank("model_id").alias("m"),
        F.coalesce("result", "analyzeResult", F.struct(*root_names)).alias("r"),
    ).select("source_file", F.coalesce("m", F.nullif("r.modelId", F.lit("")), F.lit("unknown")).alias("model_id"), "r.*")

    d = checkpointed(d) if materialize else d
    tables = d.select("source_file", F.posexplode("tables").alias("table_pos", "table"))
    numbered = d.select("source_file", F.posexplode("pages").alias("page_pos", "p")).select("source_file", "page_pos", F.col("p.pageNumber").alias("page_number"), "p.width", "p.height", "p.unit", "p.lines")
    paragraphs = d.select("source_file", F.posexplode("paragraphs").alias("paragraph_index", "p")).select("source_file", "paragraph_index", "p.role", "p.content", "p.boundingRegions", "p.spans")
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0))
    documents = d.select(
        "source_file", "model_id", size("pages").alias("page_count"), size("tables").alias("table_count"), size(F.filter("tables", lambda t: F.size(_pages_of(t)) == 0)).alias("unmapped_table_count"),
        F.col("apiVersion").alias("api_version"), F.col("contentFormat").alias("content_format"), F.col("stringIndexType").alias("string_index_type"), "paragraphs", "sections", "styles", "figures",
    )
    return from_pages(documents, numbered, tables, paragraphs, materialize)


def _pages_of(table: Column) -> Column:
    """Numbers of the pages that a table is on, in order without repeats."""
    return F.array_distinct(F.filter(F.coalesce(F.transform(table["boundingRegions"], lambda g: g["pageNumber"]), F.expr("cast(array() as array<int>)")), lambda p: p.isNotNull()))


def page_lines(numbered: DataFrame) -> DataFrame:
    """Lines with text of pages as rows (source_file, page_pos, page_number, height, unit, lines), with their bounds and margin_position."""
    lines = numbered.select("source_file", "page_pos", "page_number", "height", "unit", F.posexplode("lines").alias("line_pos", "line"))
    lines = lines.filter(filled("line.content")).withColumn("text", collapse("line.content")).withColumn("b", bounds(F.col("line.polygon")))
    lines = lines.select("source_file", "page_pos", "page_number", "height", "unit", "line_pos", "text", F.coalesce("line.polygon", F.expr("cast(array() as array<double>)")).alias("polygon"), "b.*")
    return lines.withColumn("margin_position", margin_position(F.col("top"), F.col("bottom"), F.col("height"), F.col("unit")))


def from_pages(documents: DataFrame, numbered: DataFrame, tables: DataFrame, paragraphs: DataFrame, materialize: bool = False) -> Layout:
    """The tables of documents whose pages are rows, so that no document is in one row.

    documents: source_file, model_id, ...; numbered: source_file, page_pos (that orders the pages), page_number, width, height,
    unit, lines (array of content and polygon); tables: source_file, table_pos, table; paragraphs: source_file, paragraph_index, role,
    content, boundingRegions, spans.
    """
    once = stored if materialize else (lambda df: df)
    tables = tables.withColumn("on_pages", _pages_of(F.col("table")))
    page_tables = once(tables.select("source_file", "table_pos", "table", "on_pages", F.explode("on_pages").alias("page_number")))
    per_page = page_tables.groupBy("source_file", "page_number").agg(F.count("*").alias("n_tables"))

    lines = page_lines(numbered)
    line_count = F.coalesce(F.array_size(F.filter("lines", lambda x: filled(x["content"]))), F.lit(0))
    pages = numbered.select("source_file", "page_pos", "page_number", "width", "height", "unit", line_count.alias("n_lines"))
    pages = pages.join(per_page, ["source_file", "page_number"], "left").withColumn("n_tables", F.coalesce("n_tables", F.lit(0)))
    pages = once(pages.withColumn("page_type", page_kind(F.col("n_lines"), F.col("n_tables"))))
    lines = once(lines)

    repeated = once(repeated_lines(lines, pages))
    marked = lines.filter("margin_position is not null").withColumn("normalized_text", fold("text"))
    flagged = marked.join(repeated.select("source_file", "normalized_text", "page_occurrence_count"), ["source_file", "normalized_text"]).withColumn("candidate_type", F.lit("repeated_header_footer_candidate"))
    return Layout(documents, pages, lines, page_tables, tables.filter(F.size("on_pages") == 0).drop("on_pages"), paragraphs, repeated, once(flagged))


def candidates(layout: Layout) -> DataFrame:
    """The repeated lines of all documents, of each the most frequent first, then by text."""
    return layout.repeated.orderBy("source_file", F.desc("page_occurrence_count"), "text")
