"""Page geometry, repeated lines, tables and chunks; documents stand in for laid-out pages: source is the file, doc_id the page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import chunking, layout
from foliant.operators.evaluation import artifacts
from foliant.plans import chunk_sql
from foliant.plans.registry import query, table
from foliant.plans.texts import TOKENS, WHOLE
from foliant.session import stored
from foliant.sources import layout as files

HEIGHT, LINE = 11.0, 0.5


def pages_layout(spark, sf_dir, materialize: bool = False) -> layout.Layout:
    """The documents of a source as a laid-out file: a page a document, a line a half inch, paragraphs of the lines; nations as a table on the first page."""
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit(".pdf")).alias("source_file"), F.col("doc_id").cast("int").alias("page_number"), F.split("text", "\n").alias("said"))
    corners = ((1.0, 0.0), (7.5, 0.0), (7.5, 0.4), (1.0, 0.4))
    polygon = lambda i: F.array(*(v for x, y in corners for v in (F.lit(x), F.lit(y) + i * LINE)))
    lines = F.transform("said", lambda t, i: F.struct(t.alias("content"), polygon(i).alias("polygon")))
    numbered = d.select("source_file", F.col("page_number").alias("page_pos"), "page_number", F.lit(8.5).alias("width"), F.lit(HEIGHT).alias("height"), F.lit("inch").alias("unit"), lines.alias("lines"))
    region = F.array(F.struct(F.col("page_number").alias("pageNumber"), F.lit(None).cast("array<double>").alias("polygon")))
    paragraphs = d.select("source_file", "page_number", F.posexplode("said").alias("paragraph_index", "content"))
    role = F.when((F.col("paragraph_index") == 0) & (F.length("content") < 100), "sectionHeading")
    paragraphs = paragraphs.select("source_file", "paragraph_index", role.alias("role"), "content", region.cast(files.REGIONS).alias("boundingRegions"), F.lit(None).cast(files.SPANS).alias("spans"))
    documents = d.groupBy("source_file").agg(F.lit("plain").alias("model_id"), F.count("*").alias("page_count"), F.min("page_number").alias("first"))
    cell = lambda c, v: F.struct(F.lit("content").alias("kind"), F.col("n_nationkey").alias("rowIndex"), F.lit(c).alias("columnIndex"), F.col(v).cast("string").alias("content"))
    n = table(spark, sf_dir, "nation").agg(F.count("*").cast("int").alias("rowCount"), F.lit(2).alias("columnCount"), F.flatten(F.sort_array(F.collect_list(F.array(cell(0, "n_nationkey"), cell(1, "n_name"))))).alias("cells"))
    where = F.array(F.struct(F.col("first").alias("pageNumber"), F.lit(None).cast("array<double>").alias("polygon")))
    made = F.struct("rowCount", "columnCount", "cells", where.alias("boundingRegions"), F.lit(None).cast(files.SPANS).alias("spans")).cast(files.TABLE)
    tables = documents.crossJoin(F.broadcast(n)).select("source_file", F.lit(0).alias("table_pos"), made.alias("table"))  # one row, of 25 nations
    return layout.from_pages(documents, numbered, tables, paragraphs, materialize)


_LINES = r"select source, doc_id, i - 1 i, trim(regexp_replace(line, '\s+', ' ', 'g')) t from (select source, doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) i, unnest(string_split(text, chr(10))) line from documents)"
_PLACED = f"select *, case when i * {LINE}::double <= {HEIGHT}::double * 0.08::double then 'top' when i * {LINE}::double + 0.4::double >= {HEIGHT}::double - {HEIGHT}::double * 0.08::double then 'bottom' end place from ({_LINES}) where t <> ''"


@query(f"select source || '.pdf' source_file, doc_id::int page_number, count(*) n_lines, count(place) in_margin, round(max(i::double * {LINE} + 0.4), 6) lowest from ({_PLACED}) group by all")
def line_bounds(spark, sf_dir):
    x = pages_layout(spark, sf_dir).lines
    return x.groupBy("source_file", "page_number").agg(F.count("*").alias("n_lines"), F.count("margin_position").alias("in_margin"), F.round(F.max("bottom"), 6).alias("lowest"))


@query(f"""select d.source || '.pdf' source_file, d.doc_id::int page_number, case when f and n <= 10 then 'visual_or_table' when f then 'mixed' when n <= 8 then 'visual_or_cover' else 'text' end page_type
  from (select source, doc_id, doc_id = min(doc_id) over (partition by source) f from documents) d left join (select source, doc_id, count(*) filter (t <> '') n from ({_LINES}) group by all) l using (source, doc_id)""")
def page_kinds(spark, sf_dir):
    return pages_layout(spark, sf_dir).pages.select("source_file", "page_number", "page_type")


@query(f"""with l as (select source, doc_id, i, t, place, lower(t) k from ({_PLACED}) where place is not null), p as (select source, case when count(*) < 2 then 2 else least(5, count(*)) end least_pages from documents group by source)
  select source || '.pdf' source_file, k normalized_text, arg_min(t, (doc_id, i)) as text, count(distinct doc_id) page_occurrence_count, array_to_string(list_sort(list_distinct(list(place))), ',') margin_positions from l join p using (source) group by source, k, least_pages having count(distinct doc_id) >= least_pages""")
def repeated_lines(spark, sf_dir):
    x = pages_layout(spark, sf_dir).repeated
    return x.select("source_file", "normalized_text", "text", "page_occurrence_count", F.array_join("margin_positions", ",").alias("margin_positions"))


@query(f"""with l as (select source, doc_id, i, t, place, lower(t) k from ({_PLACED}) where place is not null), p as (select source, case when count(*) < 2 then 2 else least(5, count(*)) end least_pages from documents group by source),
  r as (select source, k, count(distinct doc_id) n from l group by all) select source || '.pdf' source_file, doc_id::int page_number, i::int line_pos, place margin_position, n page_occurrence_count from l join r using (source, k) join p using (source) where n >= least_pages""")
def flagged_lines(spark, sf_dir):
    return pages_layout(spark, sf_dir).flagged.select("source_file", "page_number", "line_pos", "margin_position", "page_occurrence_count")


@query(chunk_sql.layout_chunks(HEIGHT, LINE))
def layout_chunks(spark, sf_dir):
    """All chunks of the documents as laid-out files."""
    c = chunking.chunk_documents(pages_layout(spark, sf_dir, materialize=True))
    return c.select("chunk_id", "chunk_index", "source_file", "chunk_type", "content_source", "page_start", "page_end", "text", "char_count", "line_count", "paragraph_count", F.array_join("section_titles", " | ").alias("titles"))


@query(chunk_sql.layout_chunk_stats(HEIGHT, LINE))
def layout_chunk_stats(spark, sf_dir):
    made = pages_layout(spark, sf_dir, materialize=True)
    return chunking.chunking_stats(made, chunking.chunk_documents(made))


@query(chunk_sql.layout_chunk_coverage(HEIGHT, LINE, WHOLE, TOKENS))
def layout_chunk_coverage(spark, sf_dir):
    made = pages_layout(spark, sf_dir, materialize=True)
    return artifacts.chunk_coverage(made, stored(chunking.chunk_documents(made), "chunks"))


@query(f"select source || '.pdf' source_file, count(*) pages, round(count(*) filter (n > 0 or f)::double / count(*), 6) non_empty_page_rate, 1::bigint tables from (select source, doc_id, doc_id = min(doc_id) over (partition by source) f from documents) d left join (select source, doc_id, count(*) filter (t <> '') n from ({_LINES}) group by all) l using (source, doc_id) group by source")
def filled_pages(spark, sf_dir):
    """Of each document its pages, the share of those with lines or tables, and its tables."""
    made = pages_layout(spark, sf_dir)
    report = artifacts.parsing_report(made, made.pages.select("source_file", "page_number", F.lit("").alias("text")))
    tables = made.page_tables.groupBy("source_file").agg(F.count("*").alias("tables"))
    return report.join(tables, "source_file").select("source_file", "pages", "non_empty_page_rate", "tables")


@query("""select r_name source_file, 'Table with ' || count(*) || ' rows and 2 columns.' || chr(10) || 'Cell count: ' || (2 * count(*)) || '.' || chr(10) || 'Included rows: 1 to ' || count(*) || '.' || chr(10) || string_agg('Row ' || i || ' [content]: C1=' || n_nationkey || ' | C2=' || n_name, chr(10) order by i) as text
  from (select *, row_number() over (partition by n_regionkey order by n_nationkey) i from nation) n join region on r_regionkey = n_regionkey group by r_name""")
def table_render(spark, sf_dir):
    """A region's nations as a table."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("i", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    cell = lambda c, v: F.struct(F.lit("content").alias("kind"), F.col("i").alias("rowIndex"), F.lit(c).alias("columnIndex"), F.col(v).cast("string").alias("content"))
    t = n.groupBy("r_name").agg(F.count("*").cast("int").alias("rowCount"), F.lit(2).alias("columnCount"), F.flatten(F.collect_list(F.array(cell(0, "n_nationkey"), cell(1, "n_name")))).alias("cells"))

    def run(frames):
        for f in frames:
            for name, r, c, cells in zip(f["r_name"], f["rowCount"], f["columnCount"], f["cells"], strict=True):
                import pandas as pd

                parts = chunking.table_chunks({"rowCount": r, "columnCount": c, "cells": cells})
                yield pd.DataFrame({"source_file": [name] * len(parts), "text": [p["text"] for p in parts]})

    return t.mapInPandas(run, "source_file string, text string")


@query("select min(p_partkey) p_partkey, p_brand, p_type, p_size, count(*) copies from part group by p_brand, p_type, p_size")
def table_dedupe(spark, sf_dir):
    """Parts as tables of one row, the first of those with one content kept."""
    cell = lambda i, c: F.struct(F.lit("content").alias("kind"), F.lit(0).alias("rowIndex"), F.lit(i).alias("columnIndex"), F.col(c).cast("string").alias("content"))
    names = ("p_brand", "p_type", "p_size")
    p = table(spark, sf_dir, "part").withColumn("table", F.struct(F.lit(1).alias("rowCount"), F.lit(3).alias("columnCount"), F.array(*(cell(i, c) for i, c in enumerate(names))).alias("cells")))
    found = chunking.distinct_tables(p.select(F.lit("part").alias("source_file"), "p_partkey", "table"), ["p_partkey"])
    said = lambda i: F.col("table.cells")[i]["content"]
    return found.select("p_partkey", said(0).alias("p_brand"), said(1).alias("p_type"), said(2).cast("int").alias("p_size"), "copies")
