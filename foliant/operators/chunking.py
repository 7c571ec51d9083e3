"""Chunks of bounded size from normalised pages.

Filters, roles, titles and numbering are expressions and windows. What depends on earlier decisions (grouping of lines,
packing of units, merging of small chunks, rows of a table) is a fold over the units of one page or the rows of one
table, which a function over Arrow-backed frames does, one row a page or table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import collapse, filled, fold, last_distinct, meaningful_title, slug, text_heavy
from foliant.operators.layout import Layout, inside, region_bounds
from foliant.session import stored


@dataclass(frozen=True)
class Sizes:
    """Characters: where a chunk ends by itself, may end, and must; what is small; and how many titles it carries."""

    # On them depends where chunks end.
    target: int = 1100
    least_soft: int = 450
    soft: int = 1400
    most: int = 1500
    heading: int = 180
    trailing: int = 250
    small: int = 280
    tiny: int = 140
    table: int = 2200
    titles: int = 3


# Kinds of pages, roles of paragraphs.
VISUAL = ("visual_or_table", "visual_or_cover")
LEFT_OUT = ("pageHeader", "pageFooter", "pageNumber")
HEADINGS = ("title", "sectionHeading")

# -- folds over one page


def squeeze(text: object) -> str:
    return " ".join(str(text or "").split())


def is_title(text: str) -> bool:
    n = sum(c.isalpha() for c in text)
    return 0 < len(text) <= 160 and n > 0 and not (n <= 1 and len(text) <= 2 and not any(c.isdigit() for c in text))


def is_heading(text: str, lines: int = 1) -> bool:
    if lines > 3:
        return False
    t = squeeze(text)
    words = t.count(" ") + 1
    if not t or len(t) > 140 or words > 14 or t[-1] in ".!?" or not is_title(t):
        return False
    return words <= 8 or sum(c.isalpha() and c.isupper() for c in t) >= 0.55 * sum(c.isalpha() for c in t)


def boundary(text: str, most: int) -> int:
    """Where a text that is too long is cut: after the last mark in the latter part, at the next space close behind, or hard."""
    least = max(int(most * 0.6), 200)
    for mark in (". ", "; ", ": ", ", ", " "):
        at = text.rfind(mark, least, most + 1)
        if at >= 0:
            return at + len(mark.strip())
    at = text.find(" ", most)
    return at if 0 <= at <= most + 120 else most


def split_long(text: str, most: int) -> list[str]:
    """Sentences packed up to most characters; a longer one is cut at boundaries."""
    text = squeeze(text)
    if len(text) <= most:
        return [text] if text else []
    packs: list[str] = []
    for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])", text):
        if packs and len(packs[-1]) + 1 + len(s) <= most:
            packs[-1] += " " + s
        else:
            packs.append(s)
    out = []
    for rest in packs:
        while len(rest) > most:
            at = boundary(rest, most)
            out.append(squeeze(rest[:at]))
            rest = squeeze(rest[at:])
        out.append(rest)
    return [x for x in out if x]


def group_lines(lines: list[dict], height: float | None, unit: str | None) -> list[dict]:
    """Units of lines: a new one after a wide gap, at a heading once a group is long, at a heading if bounds are missing."""
    relative = height * 0.018 if height and height > 0 else 0.25
    gap = max(0.18, min(0.35, relative) if (unit or "").lower() == "inch" else relative)
    groups: list[list[dict]] = []
    size = 0  # characters of the last group, with a line feed after each of its lines
    for x in lines:
        if groups:
            last = groups[-1][-1]
            if last["bottom"] is None or x["top"] is None:
                new = is_heading(x["text"])
            else:
                new = x["top"] - last["bottom"] > gap or (size > 60 and is_heading(x["text"]))
            if not new:
                groups[-1].append(x)
                size += len(x["text"]) + 1
                continue
        groups.append([x])
        size = len(x["text"]) + 1
    units, titles = [], []
    for g in groups:
        text = "\n".join(x["text"] for x in g)
        heading = text if is_heading(text, len(g)) else None
        if heading:
            name = squeeze(heading)
            titles = [*(t for t in titles if t != name), name][-3:]
        units.append({"text": text, "kind": "clean_lines", "heading": heading, "titles": list(titles), "paragraphs": 0})
    return units


def merge_titles(*lists: list[str], most: int = 3) -> list[str]:
    return list(dict.fromkeys(t for x in lists for t in x if squeeze(t)))[-most:]


def joined(units: list[dict]) -> dict:
    return {"text": "\n\n".join(u["text"] for u in units if u["text"]), "titles": merge_titles(*(u["titles"] for u in units)), "paragraphs": sum(u["paragraphs"] for u in units), "kind": units[0]["kind"]}


def _small(c: dict, s: Sizes) -> bool:
    n = len(c["text"])
    return n <= s.small and (n <= s.tiny or sum(bool(x.strip()) for x in c["text"].splitlines()) <= 3 or c["paragraphs"] <= 1)


def _fit(a: dict, b: dict, s: Sizes) -> bool:
    return a["kind"] == b["kind"] and len(a["text"]) + 2 + len(b["text"]) <= s.most


def _both(a: dict, b: dict) -> dict:
    return {"text": f"{a['text']}\n\n{b['text']}".strip(), "titles": merge_titles(a["titles"], b["titles"]), "paragraphs": a["paragraphs"] + b["paragraphs"], "kind": a["kind"]}


def pack_units(units: list[dict], visual: bool, s: Sizes = Sizes()) -> list[dict]:
    """Chunks of the units of one page, in order."""
    parts = []
    for u in units:
        cut = split_long(u["text"], s.most) if len(u["text"]) > s.most else [u["text"]]
        parts += [u] if len(cut) <= 1 else [{**u, "text": t, "heading": u["heading"] if i == 0 else None, "paragraphs": u["paragraphs"] if i == 0 else 0} for i, t in enumerate(cut)]
    out: list[dict] = []
    held: list[dict] = []
    size = 0
    for u in parts:
        if held and ((u["heading"] and size >= s.heading) or (size >= s.least_soft and size + len(u["text"]) > s.soft)):
            out.append(joined(held))
            held, size = [], 0
        held.append(u)
        size += len(u["text"]) + (2 if size and u["text"] else 0)  # as joined() has it
        if size >= s.target:
            out.append(joined(held))
            held, size = [], 0
    if held:
        rest = joined(held)
        if out and len(rest["text"]) < s.trailing and not visual and len(out[-1]["text"]) + 2 + len(rest["text"]) <= s.most:
            out[-1] = _both(out[-1], rest)
        else:
            out.append(rest)
    merged: list[dict] = []
    i = 0
    while i < len(out):
        c = out[i]
        if i + 1 < len(out) and _small(c, s) and _fit(c, out[i + 1], s):
            merged.append(_both(c, out[i + 1]))
            i += 2
            continue
        if merged and _small(c, s) and _fit(merged[-1], c, s):
            merged[-1] = _both(merged[-1], c)
        else:
            merged.append(c)
        i += 1
    return merged


def table_lines(table: dict) -> list[str]:
    """One line for each row of a table: its kinds and what its cells say."""
    rows, columns = max(table["rowCount"] or 0, 0), max(table["columnCount"] or 0, 0)
    grid: dict[tuple[int, int], str] = {}
    kinds: dict[int, set[str]] = {}
    for c in sorted(_listed(table["cells"]), key=lambda c: (c["rowIndex"] or 0, c["columnIndex"] or 0)):
        at = (c["rowIndex"] or 0, c["columnIndex"] or 0)
        if at[0] >= rows or at[1] >= columns:
            continue
        said, kind = squeeze(c["content"]), squeeze(c["kind"])
        if said:
            grid[at] = f"{grid[at]} / {said}" if grid.get(at) and grid[at] != said else said
        if kind:
            kinds.setdefault(at[0], set()).add(kind)
    out = []
    for r in range(rows):
        said = " | ".join(f"C{c + 1}={grid[r, c]}" for c in range(columns) if (r, c) in grid)
        mark = f" [{', '.join(sorted(kinds[r]))}]" if r in kinds else ""
        out.append(f"Row {r + 1}{mark}: {said or '[empty]'}")
    return out


def _listed(x) -> list:
    return [] if x is None else list(x)


def table_chunks(table: dict, most: int = Sizes.table) -> list[dict]:
    """Text, row_start and row_end of the chunks of a table: rows by turns up to most characters with the head."""
    rows, columns, cells = max(table["rowCount"] or 0, 0), max(table["columnCount"] or 0, 0), len(_listed(table["cells"]))
    # The first lines of a table's text and the marks of its rows.
    head = [f"Table with {rows} rows and {columns} columns.", f"Cell count: {cells}."]
    base = len("\n".join(head)) + 1
    parts: list[list[tuple[int, str]]] = [[]]
    size = base
    for i, line in enumerate(table_lines(table), 1):
        if parts[-1] and size + len(line) + 1 > most:
            parts.append([])
            size = base
        parts[-1].append((i, line))
        size += len(line) + 1
    said = lambda p: "\n".join([*head, *([f"Included rows: {p[0][0]} to {p[-1][0]}."] if p else []), *(x for _, x in p)])
    return [{"text": said(p), "row_start": p[0][0] if p else None, "row_end": p[-1][0] if p else None} for p in parts]


# -- over all documents

_UNIT = "struct<text:string,kind:string,heading:string,titles:array<string>,paragraphs:int>"
_LINE = "struct<text:string,top:double,bottom:double>"
_CHUNK = "array<struct<text:string,titles:array<string>,paragraphs:int,kind:string>>"


def _page_fold(sizes: Sizes):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            chunks, headings = [], []
            for usable, units, lines, height, unit, kind in zip(f["usable"], f["units"], f["lines"], f["height"], f["unit"], f["page_type"], strict=True):
                number = lambda x: None if x is None or x != x else x
                own = [{**u, "titles": _listed(u["titles"])} for u in _listed(units)] if usable else group_lines([{**x, "top": number(x["top"]), "bottom": number(x["bottom"])} for x in _listed(lines)], number(height), unit)
                chunks.append(pack_units(own, kind in VISUAL, sizes))
                headings.append(merge_titles([u["heading"] for u in own if u["heading"]], most=sizes.titles))
            yield f[["source_file", "page_pos", "page_number", "page_type", "flag", "height", "unit", "usable"]].assign(n=[len(x) for x in chunks], chunks=chunks, headings=headings)

    return run


def paragraph_units(layout: Layout) -> DataFrame:
    """source_file, page_number, units (in order) and usable: whether they, not the lines, tell what the page says."""
    none = F.expr("cast(array() as array<int>)")
    pages_of = F.array_distinct(F.filter(F.coalesce(F.transform("boundingRegions", lambda r: r["pageNumber"]), none), lambda p: p.isNotNull()))
    p = layout.paragraphs.filter(filled("content")).withColumn("text", collapse("content")).withColumn("on", pages_of).filter(F.size("on") == 1).withColumn("page_number", F.col("on")[0])
    role = F.coalesce("role", F.lit(""))
    heading = role.isin(*HEADINGS)
    p = p.select("source_file", "page_number", "paragraph_index", "text", "boundingRegions", heading.alias("is_heading"), F.lower("text").alias("normalized_text"), role.alias("r")).filter(~F.col("r").isin(*LEFT_OUT)).drop("r")
    # by text first, so that all that follows is by page
    p = p.join(layout.repeated.select("source_file", "normalized_text", F.col("page_occurrence_count").alias("times")), ["source_file", "normalized_text"], "left")
    p = p.filter(F.col("is_heading") | (F.coalesce("times", F.lit(0)) < 5)).drop("normalized_text", "times").join(table_areas(layout), ["source_file", "page_number"], "left")
    areas = F.coalesce("areas", F.expr("cast(array() as array<struct<left:double,right:double,top:double,bottom:double>>)"))
    in_table = F.col("areas").isNotNull() & F.exists(region_bounds(F.col("boundingRegions"), F.col("page_number")), lambda b: inside(b, areas))
    p = p.filter(~in_table).withColumn("heading", F.when(F.col("is_heading") & meaningful_title("text"), F.col("text")))
    so_far = Window.partitionBy("source_file", "page_number").orderBy("paragraph_index").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("titles", last_distinct(F.collect_list("heading").over(so_far), Sizes.titles))
    n = F.length("text")
    units = p.groupBy("source_file", "page_number").agg(
        F.sort_array(F.collect_list(F.struct("paragraph_index", F.struct("text", F.lit("paragraph").alias("kind"), "heading", "titles", F.lit(1).alias("paragraphs")).alias("u")))).alias("x"),
        F.count("*").alias("n"), F.sum(n).alias("chars"), F.count_if(text_heavy("text")).alias("long"), F.count_if(n <= 40).alias("short"), F.count("heading").alias("heads"), F.max(n).alias("longest"),
    )
    units = units.join(layout.pages.groupBy("source_file", "page_number").agg(F.first("page_type").alias("page_type")), ["source_file", "page_number"])
    average = F.col("chars") / F.col("n")
    usable = (
        F.when(F.col("page_type").isin(*VISUAL) & (F.col("chars") < 200), False)
        .when((F.col("n") >= 20) & (average < 35) & (F.col("short") / F.col("n") >= 0.6), False)
        .when((F.col("n") >= 12) & (average < 50) & (F.col("long") == 0) & (F.col("heads") >= F.col("n") * 0.35), False)
        .otherwise((F.col("longest") >= 450) | ((F.col("chars") >= 350) & (F.col("n") >= 2) & (average >= 45)) | (F.col("long") >= 2) | ((F.col("chars") >= 600) & (F.col("n") <= 10)))
    )
    return units.select("source_file", "page_number", F.col("x.u").alias("units"), usable.alias("usable"))


def table_areas(layout: Layout) -> DataFrame:
    """source_file, page_number, areas of all tables on a page."""
    return layout.page_tables.groupBy("source_file", "page_number").agg(F.flatten(F.collect_list(region_bounds(F.col("table.boundingRegions"), F.col("page_number")))).alias("areas"))


def kept_lines(layout: Layout, only: DataFrame | None = None) -> DataFrame:
    """source_file, page_number, lines (in order) without those in tables and without repeated margin lines where at least 3 others stand; of the pages of only, if it is given."""
    r = lambda c: F.round(c, 4)
    x = layout.lines if only is None else layout.lines.join(only, ["source_file", "page_number"], "left_semi")
    x = x.select("source_file", "page_number", "line_pos", "text", "left", "right", "top", "bottom", F.when(F.col("margin_position").isNotNull(), fold("text")).alias("normalized_text"))
    x = x.join(layout.repeated.select("source_file", "normalized_text", F.col("page_occurrence_count").alias("own")), ["source_file", "normalized_text"], "left").drop("normalized_text")
    alike = Window.partitionBy("source_file", "page_number", "text", r("left"), r("right"), r("top"), r("bottom"))
    x = x.withColumn("times", F.max("own").over(alike)).withColumn("others", F.count_if(F.col("times").isNull()).over(Window.partitionBy("source_file", "page_number")))
    x = x.join(table_areas(layout), ["source_file", "page_number"], "left")
    areas = F.coalesce("areas", F.expr("cast(array() as array<struct<left:double,right:double,top:double,bottom:double>>)"))
    n = F.size(F.split("text", " "))
    drop = (F.col("others") >= 3) & (F.coalesce("times", F.lit(0)) >= 5) & (n <= 12) & (F.length("text") <= 120)
    x = x.filter(~(F.col("areas").isNotNull() & inside(F.struct("left", "right", "top", "bottom"), areas)) & ~drop)
    return x.groupBy("source_file", "page_number").agg(F.sort_array(F.collect_list(F.struct("line_pos", F.struct("text", "top", "bottom").alias("x")))).alias("y")).select("source_file", "page_number", F.col("y.x").alias("lines"))


def distinct_tables(tables: DataFrame, order: list[str]) -> DataFrame:
    """Of the tables (column table) of a source that are alike in all they say the first by order, with copies, how many there are."""
    rest = [c for c in tables.columns if c not in ("source_file", *order)]
    t = tables.withColumn("signature", F.sha1(F.to_json("table").cast("binary")))
    first = t.groupBy("source_file", "signature").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"), F.min(F.struct(*order)).alias("o"), F.count("*").alias("copies"))
    return first.select("source_file", "o.*", "x.*", "copies")


def chunk_documents(layout: Layout, sizes: Sizes = Sizes()) -> DataFrame:
    """The chunks of all documents, numbered through each document: texts of a page, then its tables that no page before had."""
    pages = layout.pages.join(paragraph_units(layout), ["source_file", "page_number"], "left")
    flags = layout.flagged.select("source_file", "page_number").distinct().withColumn("flag", F.lit(True))
    pages = pages.withColumn("usable", F.coalesce("usable", F.lit(False))).join(flags, ["source_file", "page_number"], "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    about_page = ["source_file", "page_pos", "page_number", "page_type", "flag", "height", "unit"]
    made = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select(*about_page, "usable").schema) + f", n int, chunks {_CHUNK}, headings array<string>"

    def fold_pages(p: DataFrame, units: Column, lines: Column) -> DataFrame:
        used = p.select(*about_page, "usable", units.cast(f"array<{_UNIT}>").alias("units"), lines.cast(f"array<{_LINE}>").alias("lines"))
        return stored(used.mapInPandas(_page_fold(sizes), made), "folded")

    # once, since numbers need the counts of all pages before, and tables the headings; lines are brought together for the pages that they tell only
    by_units = fold_pages(pages, F.when(F.col("usable"), F.col("units")), F.lit(None))
    rest = stored(by_units.filter("not usable").select(*about_page, "usable"), "rest")
    by_lines = fold_pages(rest.join(kept_lines(layout, rest), ["source_file", "page_number"], "left"), F.lit(None), F.col("lines"))
    folded = by_units.filter("usable").unionByName(by_lines)
    about = folded.select("source_file", "page_number", "page_type", "flag")
    texts = folded.filter("n > 0").select("source_file", "page_pos", "page_number", "page_type", "flag", F.posexplode("chunks").alias("i", "c"))
    texts = texts.select(
        "source_file", "page_number", "page_pos", "i", F.when(F.col("page_type").isin(*VISUAL), "visual").otherwise("text").alias("chunk_type"), F.col("c.kind").alias("content_source"),
        F.array("page_number").alias("page_numbers"), F.array("page_type").alias("page_types"), F.col("c.titles").alias("section_titles"), F.col("c.text").alias("text"), F.lit(0).alias("table_count"), F.col("c.paragraphs").alias("paragraph_count"), F.col("flag").alias("header_footer_candidates_present"), F.lit(None).cast(_TABLE_META).alias("table_metadata"),
    )

    through = Window.partitionBy("source_file").orderBy("page_number", "table_pos")
    t = distinct_tables(layout.page_tables, ["page_number", "table_pos"]).drop("copies").join(about, ["source_file", "page_number"])
    t = t.withColumn("table_index", F.row_number().over(through))
    kinds = about.select("source_file", F.col("page_number").alias("n"), F.col("page_type").alias("kind"), F.col("flag").alias("f"))
    every = t.select("source_file", "table_index", "page_type", F.posexplode("on_pages").alias("i", "n")).join(kinds, ["source_file", "n"], "left").groupBy("source_file", "table_index").agg(
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("kind", "page_type").alias("kind")))), lambda x: x["kind"])).alias("page_types"), F.max(F.coalesce("f", F.lit(False))).alias("any_flag")
    )
    titled = folded.select("source_file", "page_number", "headings")
    t = t.join(every, ["source_file", "table_index"]).join(titled, ["source_file", "page_number"])
    columns = ["source_file", "page_number", "table_index", "on_pages", "page_types", "any_flag", "headings"]

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [table_chunks(x, sizes.table) for x in f["table"]]
            yield f[columns].assign(rows=[x["rowCount"] or 0 for x in f["table"]], cols=[x["columnCount"] or 0 for x in f["table"]], cells=[len(_listed(x["cells"])) for x in f["table"]], parts=made)

    kind = lambda c: t.schema[c].dataType.simpleString()
    cut = t.select(*columns, "table").mapInPandas(tables, ", ".join(f"{c} {kind(c)}" for c in columns) + ", rows int, cols int, cells int, parts array<struct<text:string,row_start:int,row_end:int>>")
    cut = cut.select("*", F.posexplode("parts").alias("i", "c"))
    cut = cut.select(
        "source_file", "page_number", F.lit(None).cast("int").alias("page_pos"), (F.row_number().over(Window.partitionBy("source_file", "page_number").orderBy("table_index", "i")) - 1).alias("i"), F.lit("table").alias("chunk_type"), F.lit("tables").alias("content_source"), F.col("on_pages").alias("page_numbers"), "page_types", F.col("headings").alias("section_titles"),
        F.col("c.text").alias("text"), F.lit(1).alias("table_count"), F.lit(0).alias("paragraph_count"), F.col("any_flag").alias("header_footer_candidates_present"),
        F.struct("table_index", F.greatest("rows", F.lit(0)).alias("row_count"), F.greatest("cols", F.lit(0)).alias("column_count"), F.col("cells").alias("cell_count"), "c.row_start", "c.row_end").cast(_TABLE_META).alias("table_metadata"),
    )
    cut = stored(cut, "tables")
    # of each page, and of the tables of each page number (after its pages), how many chunks come before; only these counts are ordered
    counts = folded.select("source_file", "page_number", "page_pos", "n").unionByName(cut.groupBy("source_file", "page_number", "page_pos").agg(F.count("*").cast("int").alias("n")))
    before = F.sum("n").over(Window.partitionBy("source_file").orderBy("page_number", F.col("page_pos").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.filter("n > 0").withColumn("before", F.coalesce(before, F.lit(0))).drop("n").join(layout.documents.select("source_file", "model_id"), "source_file").withColumn("page_pos", F.coalesce("page_pos", F.lit(-1)))
    all_ = texts.unionByName(cut).withColumn("page_pos", F.coalesce("page_pos", F.lit(-1))).join(counts, ["source_file", "page_number", "page_pos"]).withColumn("chunk_index", (F.col("before") + F.col("i") + 1).cast("int"))
    label = F.coalesce(F.get("page_numbers", F.lit(0)).cast("string"), F.lit("None"))
    name = F.concat(slug(F.coalesce("source_file", F.lit("document"))), F.format_string("__c%04d__", "chunk_index"), "chunk_type", F.lit("__p"), label, F.when(F.col("chunk_type") == "table", F.format_string("__t%03d", F.col("table_metadata.table_index"))).otherwise(""))
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return all_.select(
        name.alias("chunk_id"), "chunk_index", "source_file", "model_id", "chunk_type", "content_source", F.get("page_numbers", F.lit(0)).alias("page_start"), F.element_at("page_numbers", -1).alias("page_end"), "page_numbers", "page_types", "section_titles",
        "text", F.length("text").alias("char_count"), lines.alias("line_count"), "table_count", "paragraph_count", "header_footer_candidates_present", "table_metadata",
    )


_TABLE_META = "struct<table_index:int,row_count:int,column_count:int,cell_count:int,row_start:int,row_end:int>"


def chunking_stats(layout: Layout, chunks: DataFrame) -> DataFrame:
    """Of each document: pages, chunks by type, pages that used paragraphs or lines, paragraphs, repeated lines."""
    kinds = chunks.groupBy("source_file").agg(F.count("*").alias("total_chunks"), *(F.count_if(F.col("chunk_type") == k).alias(f"{k}_chunk_count") for k in ("text", "table", "visual")))
    units = layout.pages.join(paragraph_units(layout).select("source_file", "page_number", "usable"), ["source_file", "page_number"], "left").groupBy("source_file").agg(F.count("*").alias("source_page_count"), F.count_if(F.coalesce("usable", F.lit(False))).alias("pages_using_paragraphs"))
    n = F.size(F.array_distinct(F.filter(F.coalesce(F.transform("boundingRegions", lambda r: r["pageNumber"]), F.expr("cast(array() as array<int>)")), lambda p: p.isNotNull())))
    said = collapse("content") != ""
    paragraphs = layout.paragraphs.groupBy("source_file").agg(F.count("*").alias("paragraph_total"), F.count_if(~said).alias("paragraph_empty"), F.count_if(said & (n != 1)).alias("paragraph_ambiguous_page"))
    repeated = layout.repeated.groupBy("source_file").agg(F.count("*").alias("repeated_header_footer_candidate_count"))
    out = layout.documents.select("source_file", "model_id")
    for x in (units, kinds, paragraphs, repeated):
        out = out.join(x, "source_file", "left")
    return out.withColumn("pages_using_line_fallback", F.col("source_page_count") - F.col("pages_using_paragraphs")).fillna(0)


def text_parts(rows: DataFrame, key: str, most: int, text: str = "text") -> DataFrame:
    """key, part, text: each text in parts of at most most characters, at sentences where that is possible, over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                cut = [split_long(x or "", most) for x in few.column(1).to_pylist()]
                of = pa.array([i for i, x in enumerate(cut) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([few.column(0).take(of), pa.array([i for x in cut for i in range(len(x))], pa.int32()), pa.array([t for x in cut for t in x], pa.string())], names=[key, "part", "text"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, part int, text string")


class TextChunks:
    """The table function of that for SQL: (part, text) of a text in parts of at most most characters."""

    def eval(self, text: str, most: int):
        for i, x in enumerate(split_long(text or "", most)):
            yield i, x


def register(spark) -> None:
    """chunk_text(text, most) for SQL, with Arrow between Spark and Python."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("chunk_text", udtf(TextChunks, returnType="part: int, text: string", useArrow=True))
