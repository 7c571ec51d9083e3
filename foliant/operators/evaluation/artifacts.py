"""Measures of parsed pages, chunks and embedding records against what they were made of."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from foliant.functions.edits import distance
from foliant.functions.rates import agreement, f1, numbers, rate, ratio
from foliant.functions.text import collapse, collapse_hyphens, tokens
from foliant.functions.vectors import all_finite, norm
from foliant.session import stored

NONE = "cast(array() as array<string>)"
# Roles of paragraphs that a page's text leaves out.
LEFT_OUT = ("pageHeader", "pageFooter", "pageNumber")
#: Of what has no match collapse_hyphens() leaves nothing.
_SAID = r"(?U)[^\s\u00ad]"


def overlap(left: DataFrame, right: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, left_tokens, right_tokens, matched: the tokens of both sides as multisets."""
    count = lambda df, name: df.select(*keys, F.explode(tokens(text)).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias(name))
    both = count(left, "l").join(count(right, "r"), [*keys, "token"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.groupBy(*keys).agg(F.sum(zero("l")).alias("left_tokens"), F.sum(zero("r")).alias("right_tokens"), F.sum(F.least(zero("l"), zero("r"))).alias("matched"))


def with_prf(x: DataFrame, matched: str = "matched", truth: str = "left_tokens", given: str = "right_tokens") -> DataFrame:
    """x with precision, recall and f1 of its token counts."""
    x = x.withColumn("precision", ratio(F.col(matched), F.col(given))).withColumn("recall", ratio(F.col(matched), F.col(truth)))
    return x.withColumn("f1", f1(F.col("precision"), F.col("recall")))


#: Cells of the table of an edit distance from which Python counts it, by what differs, and not the JVM, by all cells.
CELLS = 1 << 22


def _as_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair of token arrays as texts of one character a token, with their sizes and common tokens; of large pairs the distance instead of the texts."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    for batch in batches:
        keep, out = batch.num_columns - 2, ([], [], [], [], [], [])
        for r, h in zip(batch.column(keep).to_pylist(), batch.column(keep + 1).to_pylist(), strict=True):
            code: dict[str, str] = {}
            large = len(r) * len(h) > CELLS
            for t in () if large else (*r, *h):
                if t not in code:
                    n = 0x4E00 + len(code)
                    code[t] = chr(n if n < 0xD800 else n + 0x800)  # over the surrogates
            both = Counter(r) & Counter(h)
            said = ("", "") if large else ("".join(map(code.__getitem__, r)), "".join(map(code.__getitem__, h)))
            for x, v in zip(out, (*said, len(r), len(h), both.total(), distance(r, h) if large else None), strict=True):
                x.append(v)
        yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=[*batch.schema.names[:keep], "_a", "_b", "_n", "_k", "_m", "_d"])


def word_errors(pairs: DataFrame, by: list[str], reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Of pairs of page texts, by document: pages, pages_with_text, word_error_rate, precision, recall, f1, page_wer_median, page_wer_p90.

    Pages whose reference has no tokens count for precision only. Tokens become characters in Arrow batches, so that
    the built-in edit distance counts them; pairs of more than CELLS cells are counted there, by their differences.
    """
    t = pairs.select(*by, tokens(reference).alias("_r"), tokens(hypothesis).alias("_h"))
    schema = StructType([*(t.schema[c] for c in by), *(StructField(c, StringType()) for c in ("_a", "_b")), *(StructField(c, IntegerType()) for c in ("_n", "_k", "_m", "_d"))])
    t = t.mapInArrow(_as_characters, schema).withColumn("_e", F.when(F.col("_n") > 0, F.coalesce("_d", F.levenshtein("_a", "_b"))))
    wer = F.when(F.col("_n") > 0, F.col("_e") / F.col("_n"))
    s = t.groupBy(*by).agg(
        F.count("*").alias("pages"), F.count_if(F.col("_n") > 0).alias("pages_with_text"), F.sum("_e").alias("_e"), F.sum("_n").alias("_n"), F.sum("_k").alias("_k"), F.sum("_m").alias("_m"),
        F.round(F.median(wer), 6).alias("page_wer_median"), F.round(F.percentile(wer, 0.9), 6).alias("page_wer_p90"),
    )
    s = s.withColumn("word_error_rate", ratio(F.col("_e"), F.col("_n")))
    return with_prf(s, "_m", "_n", "_k").drop("_e", "_n", "_k", "_m")


def zipped_pages(reference: DataFrame, hypothesis: DataFrame, by: list[str], page: str = "page_number", text: str = "text") -> DataFrame:
    """by, ordinal, reference, hypothesis: the pages of two readings of a document by their places in its page order, as far as both go."""
    w = Window.partitionBy(*by).orderBy(F.col(page).asc_nulls_last())
    side = lambda df, name: df.select(*by, F.row_number().over(w).alias("ordinal"), F.col(text).alias(name))
    return side(reference, "reference").join(side(hypothesis, "hypothesis"), [*by, "ordinal"])


def parsing_report(layout, read: DataFrame) -> DataFrame:
    """Of each document: word_errors() of the lines of its pages against read (source_file, page_number, text), pages, and the share of pages that have lines or tables."""
    said = layout.lines.groupBy("source_file", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    own = layout.pages.select("source_file", "page_number").join(said, ["source_file", "page_number"], "left")
    errors = word_errors(zipped_pages(read, own, ["source_file"]), ["source_file"]).withColumnRenamed("pages", "compared_pages")
    filled = (F.col("n_lines") > 0) | (F.col("n_tables") > 0)
    pages = layout.pages.groupBy("source_file").agg(F.count("*").alias("pages"), rate(F.count_if(filled), F.count("*")).alias("non_empty_page_rate"))
    return pages.join(errors, "source_file", "left")


def preservation(raw: DataFrame, processed: DataFrame, kinds: list[str], key: str = "document_id") -> DataFrame:
    """Of each document the agreement of raw and processed counts of each kind."""
    r = raw.select(key, *(F.col(k).alias(f"_{k}") for k in kinds))
    return processed.join(r, key).select(key, *(agreement(F.col(f"_{k}"), F.col(k)).alias(f"{k}_rate") for k in kinds))


def macro_means(metrics: DataFrame, key: str = "document_id") -> DataFrame:
    """metric, mean over the documents that have the metric."""
    names = [f.name for f in metrics.schema.fields if f.name != key and f.dataType.simpleString() in ("int", "bigint", "double", "float")]
    long = metrics.select(key, *(F.col(c).cast("double").alias(c) for c in names)).unpivot([key], names, "metric", "value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean")).filter("mean is not null")


def chunk_sizes(chunks: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """By document, of text and visual chunks: characters and words, and shares of 800 to 1500, below 400 and above 1500."""
    n = F.length(collapse_hyphens(text))
    c = chunks.withColumn("_n", n).withColumn("_w", F.size(tokens(text)))
    count = F.count("*")
    rates = {"target_rate": F.count_if(F.col("_n").between(800, 1500)), "small_rate": F.count_if(F.col("_n") < 400), "oversized_rate": F.count_if(F.col("_n") > 1500)}
    return c.groupBy(*by).agg(*numbers(F.col("_n"), "chars"), *numbers(F.col("_w"), "words"), *(ratio(x, count).alias(k) for k, x in rates.items()))


def _on_pages() -> Column:
    """The pages that the regions of a paragraph name."""
    return F.array_distinct(F.filter(F.coalesce(F.transform("boundingRegions", lambda r: r["pageNumber"]), F.expr("cast(array() as array<int>)")), lambda p: p.isNotNull()))


def _unsaid(pages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """source_file, page_number of the pages without a paragraph that tells what they say: few as a rule, and written, so that Spark knows how few."""
    told = paragraphs.filter(~F.coalesce("role", F.lit("")).isin(*LEFT_OUT) & F.col("content").rlike(_SAID)).select("source_file", _on_pages().alias("on")).filter(F.size("on") == 1)
    told = told.select("source_file", F.col("on")[0].alias("page_number")).distinct()
    return stored(pages.select("source_file", "page_number").distinct().join(told, ["source_file", "page_number"], "left_anti"), "unsaid")


def source_texts(pages: DataFrame, paragraphs: DataFrame, lines: DataFrame) -> DataFrame:
    """Of each page its text (paragraphs but headers, footers and page numbers; its lines if there are none), whether paragraphs, and headings."""
    p = paragraphs.filter(F.col("content").rlike(_SAID)).withColumn("t", collapse_hyphens("content")).withColumn("on", _on_pages()).filter(F.size("on") == 1).withColumn("page_number", F.col("on")[0])
    role = F.coalesce("role", F.lit(""))
    said = F.when(~role.isin(*LEFT_OUT), F.struct("paragraph_index", "t"))
    heads = F.when(role.isin("title", "sectionHeading"), F.struct("paragraph_index", "t"))
    p = p.groupBy("source_file", "page_number").agg(F.sort_array(F.collect_list(said)).alias("s"), F.sort_array(F.collect_list(heads)).alias("h"))
    x = lines.join(_unsaid(pages, paragraphs), ["source_file", "page_number"], "left_semi")
    x = x.groupBy("source_file", "page_number").agg(F.sort_array(F.collect_list(F.struct("line_pos", collapse_hyphens("text").alias("t")))).alias("x"))
    out = pages.select("source_file", "page_number").join(p, ["source_file", "page_number"], "left").join(x, ["source_file", "page_number"], "left")
    used = F.coalesce(F.size("s") > 0, F.lit(False))
    return out.select("source_file", "page_number", used.alias("from_paragraphs"), F.when(used, F.array_join("s.t", "\n\n")).otherwise(F.coalesce(F.array_join("x.t", "\n"), F.lit(""))).alias("text"), F.coalesce(F.col("h.t"), F.expr(NONE)).alias("headings"))


def _page_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages (source_file, folded text, folded text of chunks and their titles, folded headings): tokens of either text, common ones, headings, and those that the chunks have."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            few = batch.slice(at, 256)
            out = []
            for said, cut, titles, headings in zip(*(few.column(i).to_pylist() for i in range(1, 5)), strict=True):
                a, b = Counter(said.split(" ")), Counter(cut.split(" "))
                a.pop("", None)
                b.pop("", None)
                heads = [h for h in headings if h]
                out.append((a.total(), b.total(), sum(min(n, b[t]) for t, n in a.items() if t in b), len(heads), sum(h in cut or h in titles for h in heads)))
            yield pa.RecordBatch.from_arrays([few.column(0), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))], names=["source_file", "left_tokens", "right_tokens", "matched", "heads", "covered"])


def chunk_coverage(layout, chunks: DataFrame) -> DataFrame:
    """Of each document: shares of pages, tables and headings in chunks, token recall, precision and F1, ratio of tokens, chunks over several pages, and how pages were read.

    Tables are counted by sets of (page, ordinal) on either side, so a table on n pages counts n times in the source.
    """
    source = source_texts(layout.pages, layout.paragraphs, layout.lines)
    texts = chunks.filter("chunk_type in ('text', 'visual')")
    on = texts.select("source_file", "chunk_index", F.explode("page_numbers").alias("page_number"), collapse_hyphens("text").alias("t"), "section_titles").filter("page_number is not null")
    said = on.groupBy("source_file", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "t"))), lambda x: x["t"]), "\n\n").alias("text"), F.array_join(F.flatten(F.collect_list("section_titles")), " || ").alias("titles"))
    low = lambda c: F.lower(collapse_hyphens(c))
    both = source.select("source_file", "page_number", F.col("text").alias("s"), "headings").join(said.withColumnRenamed("text", "t"), ["source_file", "page_number"], "left")
    both = both.select("source_file", low("s").alias("s"), low("t").alias("t"), low("titles").alias("titles"), F.transform("headings", low).alias("headings"))
    counts = ("left_tokens", "right_tokens", "matched", "heads", "covered")
    schema = StructType([both.schema["source_file"], *(StructField(c, LongType()) for c in counts)])
    how = both.mapInArrow(_page_counts, schema).groupBy("source_file").agg(F.count("*").alias("pages"), *(F.sum(c).alias(c) for c in counts))
    tables = layout.page_tables.groupBy("source_file").agg(F.count("*").alias("tables"))
    made = chunks.withColumn("p", F.explode("page_numbers")).groupBy("source_file").agg(F.count_distinct("p").alias("chunk_pages"))
    cut = chunks.filter("chunk_type = 'table'").groupBy("source_file").agg(F.count_distinct("page_start", "table_metadata.table_index").alias("chunk_tables"))
    cross = texts.groupBy("source_file").agg(F.count_if(F.size(F.array_distinct("page_numbers")) > 1).alias("cross"), F.count("*").alias("n"))
    out = how
    for x in (tables, made, cut, cross):
        out = out.join(x, "source_file", "left")
    out = with_prf(out.fillna(0))
    return out.select(
        "source_file", ratio(F.col("chunk_pages"), F.col("pages")).alias("page_coverage_rate"), ratio(F.col("chunk_tables"), F.col("tables")).alias("table_coverage_rate"), F.col("recall").alias("source_token_recall"), F.col("precision").alias("chunk_token_precision"), F.col("f1").alias("chunk_token_f1"),
        ratio(F.col("covered"), F.col("heads")).alias("heading_coverage_rate"), ratio(F.col("right_tokens"), F.col("left_tokens")).alias("chunk_text_to_source_token_ratio"), ratio(F.col("cross"), F.col("n")).alias("cross_page_text_chunk_rate"),
    )


# -- embedding records

PAYLOAD = (
    "document_id", "chunk_id", "chunk_index", "source_file", "model_id", "chunk_type", "content_source", "page_start", "page_end", "page_numbers", "page_types", "section_titles",
    "char_count", "line_count", "table_count", "table_metadata", "paragraph_count", "header_footer_candidates_present",
)


def records(chunks: DataFrame, document: Column) -> DataFrame:
    """id, text and payload of the chunks that say something."""
    return chunks.filter(collapse("text") != "").withColumn("document_id", document).select(F.col("chunk_id").alias("id"), "text", *PAYLOAD)


def enriched(records_: DataFrame, chunks: DataFrame) -> DataFrame:
    """records with the table_metadata of their chunk, and changed, whether it was another."""
    own = chunks.select(F.col("chunk_id").alias("id"), F.col("table_metadata").alias("_new"))
    return records_.join(own, "id", "left").withColumn("changed", ~F.col("table_metadata").eqNullSafe(F.col("_new"))).withColumn("table_metadata", F.col("_new")).drop("_new")


def enrichment_summary(enriched_: DataFrame, document: str = "document_id") -> DataFrame:
    """Sums over enriched records: documents, records, tables among them, tables with metadata, records that changed."""
    table = F.col("chunk_type") == "table"
    return enriched_.agg(
        F.count_distinct(document).alias("document_count"), F.count("*").alias("record_count"), F.count_if(table).alias("table_record_count"),
        F.count_if(table & F.col("table_metadata").isNotNull()).alias("table_records_with_metadata"), F.count_if("changed").alias("changed_record_count"),
    )


def embedding_metrics(given: DataFrame, expected: DataFrame, manifest: DataFrame, payload: list[str], document: str = "document_id") -> DataFrame:
    """Integrity of embedding records by document: coverage, ids, texts, payloads, vectors.

    given: document, id, vector, payload_keys (names that the payload has), text and payload columns; expected: the same
    without vectors; manifest: document, chunk_count_embedded, vector_dimension.
    """
    e = expected.select(document, "id", F.col("text").alias("_text"), *(F.col(c).alias(f"_{c}") for c in payload), F.lit(1).alias("_is"))
    same = F.lit(True)
    for c in payload:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    known = F.coalesce(F.col("_is") == 1, F.lit(False))
    g = given.join(e, [document, "id"], "left").join(manifest, document, "left")
    size = F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0))
    vec = F.coalesce("vector", F.expr("cast(array() as array<float>)"))
    n = F.count("*")
    table = F.col("chunk_type") == "table" if "chunk_type" in given.columns else F.lit(False)
    meta = F.col("table_metadata").isNotNull() if "table_metadata" in given.columns else F.lit(False)
    m = g.withColumn("_norm", norm(vec)).groupBy(document).agg(
        n.alias("embedded_record_count"), F.count_distinct("id").alias("unique_embedded_id_count"), F.first("chunk_count_embedded").alias("manifest_chunk_count_embedded"), F.first("vector_dimension").alias("vector_dimension"),
        F.count_distinct(F.when(known, F.col("id"))).alias("_covered"), F.count_if(F.coalesce((F.col("id") != "") & (F.col("id") == F.col("chunk_id") if "chunk_id" in given.columns else F.lit(True)), F.lit(False))).alias("_ids"), F.count_if(known & F.col("text").eqNullSafe(F.col("_text"))).alias("_texts"), F.count_if(known & same).alias("_meta"),
        F.sum(F.size(F.array_intersect("payload_keys", F.array(*map(F.lit, payload))))).alias("_keys"), F.count_if(table).alias("table_record_count"), F.count_if(table & meta).alias("table_records_with_metadata"),
        F.count_if(size > 0).alias("_filled"), F.count_if((size > 0) & all_finite(vec)).alias("_finite"), F.count_if(F.col("_norm") > 0).alias("_nonzero"), F.count_if(size == F.col("vector_dimension")).alias("_dim"),
        F.round(F.min("_norm"), 6).alias("vector_norm_min"), F.round(F.max("_norm"), 6).alias("vector_norm_max"), F.round(F.avg("_norm"), 6).alias("vector_norm_mean"), F.round(F.stddev_pop("_norm"), 6).alias("vector_norm_std"),
    )
    want = expected.groupBy(document).agg(F.count_distinct("id").alias("source_chunk_count"))
    m = want.join(m, document, "full").fillna(0, [c for c in m.columns if c.startswith("_") or c.endswith("_count")] + ["source_chunk_count", "table_records_with_metadata"])
    k, u = F.col("embedded_record_count"), F.col("unique_embedded_id_count")
    made = {
        "manifest_count_matches_rate": F.when(F.col("manifest_chunk_count_embedded") == k, 1.0).otherwise(0.0), "embedding_coverage_rate": rate(F.col("_covered"), F.col("source_chunk_count")), "missing_embedding_count": F.col("source_chunk_count") - F.col("_covered"), "extra_embedding_count": u - F.col("_covered"),
        "duplicate_embedding_id_count": k - u, "id_payload_match_rate": rate(F.col("_ids"), k), "payload_text_exact_match_rate": rate(F.col("_texts"), k), "payload_metadata_match_rate": rate(F.col("_meta"), k), "table_metadata_presence_rate": rate(F.col("table_records_with_metadata"), F.col("table_record_count")),
        "required_payload_field_presence_rate": rate(F.col("_keys"), k * len(payload)), "nonempty_vector_rate": rate(F.col("_filled"), k), "finite_vector_rate": rate(F.col("_finite"), k), "nonzero_vector_rate": rate(F.col("_nonzero"), k), "vector_dimension_consistency_rate": rate(F.col("_dim"), k),
    }
    return m.withColumns(made).drop(*(c for c in m.columns if c.startswith("_")))


COUNTS = ("source_chunk_count", "embedded_record_count", "unique_embedded_id_count", "missing_embedding_count", "extra_embedding_count", "duplicate_embedding_id_count", "table_record_count", "table_records_with_metadata")
WEIGHTED = ("id_payload_match_rate", "payload_text_exact_match_rate", "payload_metadata_match_rate", "required_payload_field_presence_rate", "nonempty_vector_rate", "finite_vector_rate", "nonzero_vector_rate", "vector_dimension_consistency_rate")


def embedding_summary(metrics: DataFrame) -> DataFrame:
    """Sums of counts, means of rates weighted by records, the dimension if all have the same one."""
    k = F.col("embedded_record_count")
    s = metrics.agg(
        F.count("*").alias("document_count"), *(F.sum(c).alias(c) for c in COUNTS), *(rate(F.sum(F.col(c) * k), F.sum(k)).alias(c) for c in WEIGHTED), rate(F.count_if(F.col("manifest_count_matches_rate") == 1), F.count("*")).alias("manifest_count_matches_rate"),
        F.when(F.count_distinct("vector_dimension") == 1, F.max("vector_dimension")).alias("vector_dimension"), F.min("vector_norm_min").alias("vector_norm_min"), F.max("vector_norm_max").alias("vector_norm_max"), F.round(F.avg("vector_norm_mean"), 6).alias("vector_norm_mean_macro"),
    )
    return s.withColumn("table_metadata_presence_rate", rate(F.col("table_records_with_metadata"), F.col("table_record_count"))).withColumn("embedding_coverage_rate", rate(F.col("unique_embedded_id_count") - F.col("extra_embedding_count"), F.col("source_chunk_count")))
