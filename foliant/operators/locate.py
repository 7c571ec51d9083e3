"""Which pages hold the evidence: terms of a question, features of hits, selection and rendering."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import collapse, cut, stripped

# Patterns, stop words and synonym groups that decide results.
LOCATION = (
    r"(?i)\bon which page\b", r"(?i)\bwhat page\b", r"(?i)\bwhich page\b", r"(?i)\bwhere (?:is|are|can i find|in the report)\b",
    r"(?i)\bshow (?:me )?the source\b", r"(?i)\bshow (?:me )?where\b", r"(?i)\bevidence[- ]location\b",
)
STOP = "a an and annual appears are can does evidence find for from in is it locate located location me of on page pages pdf report show source stated the this what where which".split()
GROUPS = (("outlook", "forecast", "guidance", "expectation", "expected"), ("dividend", "proposed", "proposal", "propose"), ("revenue", "sales"), ("margin", "ebit", "ebitda"), ("risk", "risks"))
OUTLOOK, ACTIONS = GROUPS[0], ("expect", "forecast", "project", "anticipat", "predict")
PREFIXES = (
    "^on which page is", "^what page is", "^which page is", "^on which page does", "^what page does", r"^show (?:me )?the source of", r"^show (?:me )?where",
    "^where is", "^where are", "^where in the report is", "^where in the report are",
)
SUFFIX = r"(?i)\s+(?:stated|mentioned|shown|discussed|found|located)\s*$"


def is_location(question: Column | str) -> Column:
    q, out = collapse(question), F.lit(False)
    for p in LOCATION:
        out = out | q.rlike(p)
    return out


def terms(question: Column | str) -> Column:
    q = F.regexp_replace(F.lower(collapse(question)), "[^a-z0-9]+", " ")
    return F.filter(F.split(q, " "), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP))


def target(question: Column | str) -> Column:
    """What a location question asks for."""
    q = F.regexp_replace(F.regexp_replace(collapse(question), r"\?+$", ""), r"\s+$", "")
    for p in PREFIXES:
        q = F.regexp_replace(q, f"(?i){p}\\s+", "")
    q = F.trim(F.regexp_replace(q, SUFFIX, ""))
    return F.when(q == "", F.lit("this request")).otherwise(q)


def _words(x: Column) -> Column:
    return F.array(*map(F.lit, x))


def _among(group) -> Column:
    return F.filter("terms", lambda t: t.isin(*group))


def _any_in(needles: Column, hay: Column) -> Column:
    return F.exists(needles, lambda t: F.contains(hay, t))


def searchable(chunks: DataFrame) -> DataFrame:
    """chunks (text, section_titles, chunk_type, table_metadata as map or null) with what terms are looked for in.

    _titles and _hay are the distinct runs of a-z and 0-9 in the folded titles and in all that a chunk says: a term is such a run, so it is in a text
    where it is in one of its runs. _speaks says whether at least 25 words speak of an outlook as an action. Before a join with questions these are computed
    once a chunk, for however many questions it is a hit.
    """
    runs = lambda x: F.array_join(F.array_distinct(F.split(F.lower(x), "[^a-z0-9]+")), " ")
    titles = F.coalesce(F.array_join("section_titles", " "), F.lit(""))
    meta = F.coalesce(F.array_join(F.transform(F.map_entries(F.col("table_metadata")), lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(e["value"].cast("string"), F.lit("None")))), " "), F.lit(""))
    c = chunks.withColumn("_titles", runs(titles)).withColumn("_hay", runs(F.concat_ws(" ", F.coalesce("text", F.lit("")), titles, F.coalesce("chunk_type", F.lit("")), meta)))
    words = F.coalesce("text", F.lit("")).rlike(r"(?U)^\s*+(?:\S++\s++){24}\S")
    return c.withColumn("_speaks", (_any_in(_words(OUTLOOK), F.col("_titles")) | _any_in(_words(OUTLOOK), F.col("_hay"))) & _any_in(_words(ACTIONS), F.col("_hay")) & words)


def asked(questions: DataFrame) -> DataFrame:
    """questions (question) with terms, and these as _asked (joined) and _sorted (by synonym groups), once a question if this is before a join with hits."""
    q = questions.withColumn("terms", terms("question")).withColumn("_asked", F.array_join("terms", " "))
    focus = F.filter("terms", lambda t: t.isin(*{x for g in GROUPS for x in g}))
    return q.withColumn("_sorted", F.struct(F.array(*map(_among, GROUPS)).alias("groups"), focus.alias("focus"), _among(OUTLOOK).alias("outlook"), F.filter("terms", lambda t: ~t.isin(*OUTLOOK)).alias("other")))


def _overlaps(hay: pa.Array, said: pa.Array) -> pa.Array:
    """How many of the terms of a question, repeats included, are in the runs of a chunk; each term is looked for once in neighbours of one chunk."""
    hay, said = hay.dictionary_encode(), said.dictionary_encode()
    texts, questions = hay.dictionary.to_pylist(), [x.split() for x in said.dictionary.to_pylist()]
    out, last, words, known = [], None, frozenset(), {}
    for i, j in zip(hay.indices.to_pylist(), said.indices.to_pylist(), strict=True):
        if i != last:
            last, words, known = i, frozenset(texts[i].split(" ")), {}
        n = 0
        for t in questions[j]:
            if t in words:
                n += 1
                continue
            found = known.get(t)
            if found is None:
                found = known[t] = t in texts[i]
            n += found
        out.append(n)
    return pa.array(out, pa.int32())


def with_features(hits: DataFrame) -> DataFrame:
    """hits (question, chunk_type, score, and what searchable and asked read or have made) with terms, overlap, intent_bonus, type_bonus, composite."""
    h = hits if "_hay" in hits.columns else searchable(hits)
    h = h if "_asked" in h.columns else asked(h)
    bonus = F.lit(0.0)
    for i in range(len(GROUPS)):
        own = F.get("_sorted.groups", F.lit(i))
        bonus = bonus + F.when(_any_in(own, F.col("_titles")), 2.5).when(_any_in(own, F.col("_hay")), 1.0).otherwise(0.0)
    kind = F.when(F.col("chunk_type") == "text", 0.25).when(F.col("chunk_type") == "table", 0.15).otherwise(0.0)
    overlaps = F.arrow_udf(lambda hay, said: _overlaps(hay, said), "int")
    h = h.withColumn("overlap", overlaps("_hay", "_asked")).withColumn("intent_bonus", bonus).withColumn("type_bonus", kind)
    return h.withColumn("composite", F.col("overlap") + F.col("intent_bonus") + F.col("type_bonus") + F.col("score"))


def _ranked(features: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("composite"), F.desc("overlap"), F.desc("intent_bonus"), F.desc("score"), "rank")
    return features.withColumn("location_rank", F.row_number().over(order))


def rerank(hits: DataFrame) -> DataFrame:
    """hits with features and location_rank; equal hits stay in the order of rank."""
    return _ranked(with_features(hits))


def select_locations(hits: DataFrame, max_pages: int = 3) -> DataFrame:
    """The hits that answer where: focus on the question's synonym groups if any hit has them, 60 % of the best, one a page, at most max_pages.

    An outlook question narrows to hits of at least 25 words that speak of it as an action, to texts among
    those if there are any. Adds place, the order of the pages.
    """
    h = with_features(hits)
    per = Window.partitionBy("query_id")
    said = lambda c: F.col(f"_sorted.{c}")
    h = h.withColumn("_o", (F.size(said("outlook")) > 0) & F.col("_speaks") & ((F.size(said("other")) == 0) | _any_in(said("other"), F.col("_hay"))))
    h = h.withColumn("_t", F.col("_o") & F.coalesce(F.col("chunk_type") == "text", F.lit(False)))
    h = h.withColumn("_f", (F.size(said("focus")) > 0) & (_any_in(said("focus"), F.col("_titles")) | _any_in(said("focus"), F.col("_hay"))))
    h = _ranked(h.drop("_titles", "_hay", "_speaks", "_asked", "_sorted"))  # before rows are moved
    some = lambda c: F.max(c).over(per)
    h = h.withColumn("_keep", F.when(some("_t"), F.col("_t")).when(some("_o"), F.col("_o")).when(some("_f"), F.col("_f")).otherwise(F.lit(True))).filter("_keep")
    h = h.withColumn("page", F.coalesce(F.get("page_numbers", F.lit(0)), F.col("page_start"))).withColumn("_best", F.max("composite").over(per)).filter("composite >= 0.6 * _best and page is not null")
    once = Window.partitionBy("query_id", "document_id", "page").orderBy("location_rank")
    h = h.withColumn("_n", F.row_number().over(once)).filter("_n = 1").withColumn("_n", F.row_number().over(per.orderBy("location_rank"))).filter(F.col("_n") <= max_pages)
    return h.withColumn("place", F.row_number().over(per.orderBy("page", "location_rank"))).drop("_o", "_t", "_f", "_keep", "_n", "_best")


def excerpt(text: Column | str, terms_: Column | str, most: int = 900) -> Column:
    """Around the longest term that the text has (the first of equals), with dots where it is cut."""
    t_terms = F.col(terms_) if isinstance(terms_, str) else terms_
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  # x is computed once for all places of f

    def longer(best: Column, x: Column) -> Column:
        n, low = F.length(x), best["low"]
        at = F.when(n > best["n"], F.when(F.contains(low, x), F.instr(low, x))).when(n == best["n"], F.least(F.nullif(F.instr(low, x), F.lit(0)), best["at"]))
        return once(at, lambda i: F.when(i.isNotNull(), F.struct(low.alias("low"), n.alias("n"), i.alias("at"))).otherwise(best))

    def around(t: Column, best: Column) -> Column:
        end = F.least(F.greatest(best["at"] - 1 - most // 2, F.lit(0)) + most, F.length(t))
        start = F.greatest(end - most, F.lit(0))
        part = stripped(F.substring(t, start + 1, most))
        return F.when(best["n"] < 0, cut(t, most, "...")).otherwise(F.concat(F.when(start > 0, "...").otherwise(""), part, F.when(end < F.length(t), "...").otherwise("")))

    def whole(t: Column) -> Column:
        none = F.struct(F.lower(t).alias("low"), F.lit(-1).alias("n"), F.lit(0).alias("at"))
        return F.when(F.length(t) <= most, t).otherwise(once(F.aggregate(t_terms, none, longer), lambda best: around(t, best)))

    return once(stripped(text), whole)


def page_phrase(pages: Column) -> Column:
    p = pages.cast("array<string>")
    return F.when(F.size(p) == 0, "").when(F.size(p) == 1, F.concat(F.lit("page "), p[0])).when(F.size(p) == 2, F.concat(F.lit("pages "), F.array_join(p, " and "))).otherwise(
        F.concat(F.lit("pages "), F.array_join(F.slice(p, 1, F.size(p) - 1), ", "), F.lit(", and "), F.element_at(p, -1))
    )


def selected_pages(response: Column | str) -> Column:
    """Page numbers after PAGES: in a response, none for NONE or another form."""
    tail = F.trim(F.regexp_extract(F.coalesce(F.col(response) if isinstance(response, str) else response, F.lit("")), r"(?i)PAGES\s*:\s*(.+)", 1))
    return F.when(F.upper(tail).startswith("NONE"), F.expr("cast(array() as array<string>)")).otherwise(F.regexp_extract_all(tail, F.lit(r"\d+"), F.lit(0)))


def location_answers(chosen: DataFrame) -> DataFrame:
    """query_id, answer from chosen hits (question, place, page, company, source_file, text, terms)."""
    item = F.struct("place", "page", F.concat(F.lit("- "), "company", F.lit(", "), "source_file", F.lit(", page "), "page").alias("r"), F.concat(F.lit("- Page "), "page", F.lit(': "'), excerpt("text", "terms"), F.lit('"')).alias("e"))
    own = chosen.groupBy("query_id").agg(F.first("question").alias("question"), F.sort_array(F.collect_list(item)).alias("x"))
    lines = F.concat(F.array(F.lit("Answer"), F.concat(F.lit("The strongest evidence for "), target("question"), F.lit(" appears on "), page_phrase(F.col("x.page")), F.lit(".")), F.lit(""), F.lit("Resources")), F.col("x.r"), F.array(F.lit(""), F.lit("Evidence")), F.col("x.e"))
    return own.select("query_id", F.array_join(lines, "\n").alias("answer"))


def location_contexts(chosen: DataFrame, most: int = 1200) -> DataFrame:
    """query_id, context: the candidates as they are shown to the page chooser."""
    lines = F.concat_ws(
        "\n", F.lit(""), F.format_string("[Candidate %d]", "place"), F.format_string("score: %.6f", "score"), F.concat(F.lit("company: "), "company"), F.concat(F.lit("source_file: "), F.coalesce("source_file", F.lit("None"))), F.concat(F.lit("page: "), "page"),
        F.concat(F.lit("chunk_type: "), F.coalesce("chunk_type", F.lit("None"))), F.concat(F.lit("section_titles: ["), F.array_join(F.transform("section_titles", lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]")), F.lit("exact_text:"), excerpt("text", "terms", most),
    )
    own = chosen.withColumn("_l", lines).groupBy("query_id").agg(F.first("question").alias("q"), F.sort_array(F.collect_list(F.struct("place", "_l"))).alias("x"))
    return own.select("query_id", F.concat(F.lit("Question:\n"), "q", F.lit("\n\nRetrieved location candidates:\n"), F.array_join("x._l", "\n")).alias("context"))


def chosen_by_response(selected: DataFrame, responses: DataFrame) -> DataFrame:
    """Of the selected hits those whose page the response names, the first of a page (of any document), in the response's order."""
    pages = responses.select("query_id", F.posexplode(F.array_distinct(selected_pages("response"))).alias("_i", "_p"))
    met = selected.withColumn("_p", F.col("page").cast("string")).join(pages, ["query_id", "_p"])
    met = met.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_p").orderBy("place"))).filter("_n = 1")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_i"))).drop("_i", "_p", "_n")
