"""Operators on small hand-made inputs, and on plain Python versions of their rules."""

import json
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import rates, text, vectors
from foliant.operators import answers, chunking, context, layout, locate, registry, retrieval
from foliant.operators.answer_parse import parse_answers
from foliant.operators.evaluation import answers as answer_measures
from foliant.operators.evaluation import artifacts, search
from foliant.sources import layout as files
from foliant.sources import providers, settings, sinks
from foliant.streaming import ingest


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


# -- functions


def test_text_functions(spark):
    assert one(spark, text.collapse("t"), t="  a  b \n c ") == "a b c"
    assert one(spark, text.collapse_hyphens("t"), t="year- on so­ft") == "yearon soft"
    assert one(spark, text.slug("t"), t="Dir/My Report (2024).v2.pdf") == "my_report_2024_v2"
    assert one(spark, text.slug("t"), t="---.pdf") == "document"
    assert one(spark, text.sentences("t"), t='One. two. Three! "Four" x? (Five') == ["One. two.", "Three!", '"Four" x?', "(Five"]
    assert one(spark, text.lookup_key("t"), t=" Mercedes-Benz  AG ") == "mercedes benz ag"
    for title, good in (("A", False), ("A1", True), ("12", False), ("", False), ("Outlook", True), ("x" * 161, False)):
        assert one(spark, text.meaningful_title("t"), t=title) == good == chunking.is_title(title)
    for line, good in (("Risk report", True), ("This ends.", False), ("one two three four five six seven eight nine", False), ("ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE", True), ("x" * 141, False)):
        assert one(spark, text.heading_like("t"), t=line) == good == chunking.is_heading(line)
    assert one(spark, text.cut("t", 5), t=" abc  defg ") == "abc\n[TRUNCATED]"
    assert spark.createDataFrame([(["a", "b", "a", "c", "d"],)], "h array<string>").select(text.last_distinct(F.col("h"), 3).alias("x")).first().x == ["a", "c", "d"]
    names = spark.createDataFrame([("a_layout.json",), ("b.json",)], "n string").select(files.processed_name(F.col("n")).alias("x")).collect()
    assert [r.x for r in names] == ["a_processed.json", "b_processed.json"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_token_distance_and_word_errors(spark):
    rnd = random.Random(4)
    pairs = [([rnd.choice("abcdefg") * rnd.randrange(1, 3) for _ in range(rnd.randrange(0, 30))], [rnd.choice("abcdefg") for _ in range(rnd.randrange(0, 30))]) for _ in range(40)]
    df = spark.createDataFrame([(i, f"d{i % 3}", " ".join(a), " ".join(b), a, b) for i, (a, b) in enumerate(pairs)], "i int, d string, reference string, hypothesis string, a array<string>, b array<string>")
    for r in df.withColumn("x", text.token_distance(F.col("a"), F.col("b"))).collect():
        assert r.x == distance(r.a, r.b)
    got = {r.d: r for r in artifacts.word_errors(df, ["d"]).collect()}
    for d in ("d0", "d1", "d2"):
        own = [p for i, p in enumerate(pairs) if f"d{i % 3}" == d]
        errors = [(distance(a, b), len(a)) for a, b in own if a]
        assert got[d].word_error_rate == pytest.approx(sum(e for e, _ in errors) / sum(n for _, n in errors), abs=1e-6)
        assert got[d].page_wer_median == pytest.approx(float(np.median([e / n for e, n in errors])), abs=1e-6)
        assert got[d].page_wer_p90 == pytest.approx(float(np.percentile([e / n for e, n in errors], 90)), abs=1e-6)
        assert got[d].pages_with_text == len(errors) and got[d].pages == len(own)


def test_many_distinct_tokens(spark):
    a = [f"w{i}" for i in range(40_000)]
    b = a[:20_000] + ["x"] + a[20_002:]
    df = spark.createDataFrame([(a[34_000:36_000], b[34_000:36_000], a, b)], "p array<string>, q array<string>, a array<string>, b array<string>")
    assert df.select(text.token_distance(F.col("p"), F.col("q")).alias("x")).first().x == distance(a[34_000:36_000], b[34_000:36_000])


def test_rates(spark):
    a = lambda x, y: one(spark, rates.agreement(F.col("a").cast("int"), F.col("b").cast("int")), a=x, b=y)
    assert [a(None, 1), a(0, 0), a(0, 3), a(4, 3)] == [None, 1.0, 0.0, 0.75]
    for f, nothing in ((rates.ratio, None), (rates.rate, 1.0), (rates.share, 0.0)):
        assert one(spark, f(F.col("a"), F.col("b")), a=1, b=0) == nothing and one(spark, f(F.col("a"), F.col("b")), a=1, b=4) == 0.25


def test_vectors(spark):
    names = ["", "a", "chunk__c0001", "é漢"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(vectors.uuid5("n").alias("x")).collect()
    assert [r.x for r in got] == [str(uuid.uuid5(uuid.UUID(vectors.POINTS), n)) for n in names]
    v = spark.createDataFrame([([3.0, 4.0],), ([float("nan"), 1.0],), ([],), ([0.0],)], "v array<double>").select(vectors.norm("v").alias("n"), vectors.all_finite("v").alias("f"), vectors.cosine("v", F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()
    assert [r.n for r in v] == [5, 1, 0, 0] and [r.f for r in v] == [True, False, True, True] and v[0].c == pytest.approx(0.6) and v[3].c is None


# -- search


def points(spark, n=200, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v[5] = 0
    v[7] = v[8]
    rows = [(i, v[i].tolist() if i != 6 else None, f"d{i % 4}", "text" if i % 3 else "table") for i in range(n)]
    return v, spark.createDataFrame(rows, "point_id int, vector array<double>, document_id string, chunk_type string").repartition(3)


def best(v, q, k, allowed):
    s = [(-float(v[i] @ q / (np.linalg.norm(v[i]) * np.linalg.norm(q))), i) for i in allowed if i not in (5, 6)]
    return [i for _, i in sorted((round(a, 12), i) for a, i in s)[:k]]


def test_top_k_by_brute_force(spark, monkeypatch):
    v, p = points(spark)
    allowed = {0: None, 1: ["d1"], 2: ["d2", "d0", ""], 3: []}
    kinds = {0: None, 1: ["text"], 2: None, 3: ["table"]}
    q = spark.createDataFrame([(i, v[8 + i].tolist(), allowed[i], kinds[i]) for i in range(4)], "query_id int, vector array<double>, documents array<string>, types array<string>")
    for block in (1 << 20, 100):
        monkeypatch.setattr(retrieval, "BLOCK_BYTES", block)
        got = {}
        for r in retrieval.top_k(p, q, 7, document="document_id", chunk_type="chunk_type", documents="documents", chunk_types="types").collect():
            got.setdefault(r.query_id, {})[r.rank] = r.point_id
        for i in range(4):
            docs, types = [x for x in allowed[i] or [] if x], kinds[i] or []
            want = best(v, v[8 + i], 7, [j for j in range(200) if (not docs or f"d{j % 4}" in docs) and (not types or ("text" if j % 3 else "table") in types)])
            assert [got[i][n] for n in sorted(got[i])] == want
    assert retrieval.top_k(p, q, 0).count() == 4 and retrieval.top_k(p.limit(0), q, 3).count() == 0 and retrieval.top_k(p, q.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        retrieval.top_k(p, q.withColumn("vector", F.lit(None).cast("array<double>")), 3)


def test_balanced_search(spark):
    v, p = points(spark)
    q = spark.createDataFrame([(0, v[9].tolist(), ["d2", "d0"]), (1, v[9].tolist(), ["d1"]), (2, v[9].tolist(), None)], "query_id int, vector array<double>, documents array<string>")
    got = retrieval.retrieve(p, q, 40, balance=True, document="document_id").collect()
    by = {k: [r.point_id for r in sorted((r for r in got if r.query_id == k), key=lambda r: r.rank)] for k in range(3)}
    lists = [best(v, v[9], 16, [i for i in range(200) if f"d{i % 4}" == d]) for d in ("d2", "d0")]
    assert by[0] == [x for pair in zip(*lists, strict=True) for x in pair]  # 16 of each, though 40 were asked for
    assert by[1] == best(v, v[9], 40, range(1, 200, 4)) and by[2] == best(v, v[9], 40, range(200))
    assert [one(spark, retrieval.balanced_limit(F.col("a"), F.col("b")), a=x, b=y) for x, y in ((8, 2), (12, 2), (40, 2), (1, 5))] == [8, 10, 16, 8]


def test_gate_and_limits(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1, 0.45), (1, 0.1), (2, 0.449)], "query_id int, score double")
    assert {r.query_id: r.strong for r in retrieval.strong_gate(q, hits).collect()} == {1: True, 2: False, 3: False}
    limit = lambda n, a, b, d: one(spark, retrieval.effective_limit(F.col("n"), F.col("a"), F.col("b"), F.col("d")), n=n, a=a, b=b, d=d)
    assert [limit(12, True, False, 0), limit(12, False, True, 1), limit(12, False, True, 2), limit(30, True, False, 0)] == [20, 12, 20, 30]


def test_published_rank_metrics(spark):
    """Ranks of twelve cases and the means that were published for them."""
    ranks = [([1], 1)] * 10 + [([1, 2], 2), ([4, 8], 3)]
    seconds = [1.39, 2.527, 1.19, 2.418, 1.286, 1.272, 1.218, 1.312, 9.525, 1.327, 1.772, 1.656]
    df = spark.createDataFrame([(i, r, n, s) for i, ((r, n), s) in enumerate(zip(ranks, seconds, strict=True))], "query_id int, ranks array<int>, relevant bigint, latency_seconds double")
    got = search.summary(search.ranked(df)).first().asDict()
    want = {"case_count": 12, "mean_latency_seconds": 2.241, "p95_latency_seconds": 5.676, "hit_at_1": 0.916667, "hit_at_3": 0.916667, "hit_at_5": 1.0, "hit_at_10": 1.0, "recall_at_1": 0.875, "recall_at_3": 0.916667, "recall_at_5": 0.944444, "recall_at_10": 0.972222, "mrr_at_10": 0.9375, "ndcg_at_10": 0.945846, "map_at_10": 0.930556}
    assert got == pytest.approx(want)
    none = search.ranked(spark.createDataFrame([(1, [], 0)], "query_id int, ranks array<int>, relevant bigint")).first()
    assert none.ndcg_at_10 == none.recall_at_10 == none.mrr_at_10 == none.average_precision_at_10 == 0 and none.first_relevant_rank is None


def test_stress_and_snippet_summaries(spark):
    cases = spark.createDataFrame([(1, "a", "A", 1.0, ["x", "y"], ["table"]), (2, "a", "A", 3.0, ["z"], []), (3, "b", "B", 2.0, [], [])], "query_id int, category_id string, category_name string, latency_seconds double, expected_documents array<string>, expected_types array<string>")
    hits = spark.createDataFrame([(1, 1, "x", "text", 0.9), (1, 2, "q", "table", 0.8), (1, 3, "y", "text", 0.7), (2, 1, "", "text", 0.6)], "query_id int, rank int, document_id string, chunk_type string, score double")
    found = search.documents_found(hits, cases)
    by = {r.query_id: r for r in found.collect()}
    assert (by[1].top1_hit, by[1].purity_at_5, by[1].document_recall_at_1, by[1].document_recall_at_3, by[1].type_coverage_at_3, by[1].mean_top3_score) == (1, 0.666667, 0.5, 1.0, 1.0, 0.8)
    assert (by[2].top1_hit, by[2].purity_at_5, by[2].type_coverage_at_3) == (0, 0, None) and by[3].result_count == 0 and by[3].top_score is None
    s = {r.category_id: r for r in search.stress_summary(found).collect()}
    assert s[None].case_count == 3 and s["a"].case_count == 2 and s["a"].mean_latency_seconds == 2 and s[None].mean_type_coverage_at_3 == 1 and s["b"].mean_type_coverage_at_3 is None
    texts = spark.createDataFrame([(1, 1, "Alpha  beta"), (1, 2, "gamma"), (1, 3, "beta gamma")], "query_id int, rank int, text string")
    groups = spark.createDataFrame([(1, [["ALPHA", "beta"], ["gamma"]]), (2, [["x"]])], "query_id int, groups array<array<string>>")
    r = search.snippet_ranks(texts, groups)
    got = {x.query_id: (x.group_ranks, x.expected_rank, x.hit_at_1, x.hit_at_3) for x in r.collect()}
    assert got == {1: ([1, 2], 2, False, True), 2: ([None], None, False, False)}
    total = search.snippet_summary(r.withColumn("latency_seconds", F.lit(1.5))).first()
    assert total.hit_at_3_rate == 0.5 and total.missed == [2] and total.max_latency_seconds == 1.5


# -- names


def test_detect_long_aliases(spark):
    name = "Münchener Rückversicherungs-Gesellschaft Aktiengesellschaft in München"
    known = registry.registry(spark, [*registry.DOCUMENTS, ("re_2024", name, "re_2024.pdf", ["munich re", " ".join(f"w{i}" for i in range(40))])])
    q = spark.createDataFrame([(1, f"BMW or {name}?"), (2, "so " + " ".join(f"W{i}" for i in range(40))), (3, name[:-4]), (4, "munich re")], "question_id long, question string")
    assert {r.question_id: r.documents for r in registry.detect(q, known).collect()} == {1: ["bmw_2024", "re_2024"], 2: ["re_2024"], 3: [], 4: ["re_2024"]}


def test_registry(spark):
    known = registry.registry(spark)
    q = spark.createDataFrame([(1, "Compare VW with bmw group and BMW."), (2, "nothing"), (3, "Mercedes-Benz or Robert Bosch GmbH?"), (4, None), (5, "bmwx")], "question_id int, question string")
    assert {r.question_id: r.documents for r in registry.detect(q, known).collect()} == {1: ["volkswagen_2024", "bmw_2024"], 2: [], 3: ["mercedes_2024", "bosch_2024"], 4: [], 5: []}
    f = spark.createDataFrame([(1, ["VW", " ", "vw", "BMW_2024.pdf"]), (2, ["All"]), (3, ["Tesla", "bmw"]), (4, None)], "question_id int, filters array<string>")
    r = registry.resolve(f, known)
    got = {x.question_id: (x.documents, x.unknown) for x in r.collect()}
    assert got[1] == (["volkswagen_2024", "bmw_2024"], []) and got[2] == ([d[0] for d in registry.DOCUMENTS], []) and got[3] == (["bmw_2024"], ["Tesla"]) and got[4] == ([], [])
    with pytest.raises(ValueError, match="Tesla.*Siemens AG"):
        registry.require_known(r, known)
    names = registry.company_names(spark.createDataFrame([("bmw_2024",), ("other",), ("",), (None,)], "document_id string"), known)
    assert sorted(x.company for x in names.collect()) == ["BMW Group", "other", "unknown", "unknown"]


# -- answers

FORMS = {
    1: "Answer\nSales grow.\n\nReporting Period\n2025 (forecast)\n\nResources\n1. Volkswagen Group, volkswagen_2024.pdf, p229\n2. Volkswagen Group, volkswagen_2024.pdf, p185\n\nEvidence\n1. \"We expect...\" (Volkswagen Group, volkswagen_2024.pdf, p229)\n2. \"The result...\" (Volkswagen Group, volkswagen_2024.pdf, p185)\n",
    2: "Answer:\nThey lobby.\n\nResources:\nNone\n\nEvidence:\nVolkswagen Group, volkswagen_2024.pdf, p183:\n\"The Group represents its interests.\"\n\nVolkswagen Group, volkswagen_2024.pdf, p184:\n\"Lobbying is governed.\"\n",
    3: "Answer\nIt was raised.\n\nResources\n- Robert Bosch GmbH, bosch_2024.pdf, page 49\n\nEvidence\n\"In 2024, we decided to raise our target.\"\n",
    4: "Answer\nBMW Group:\nA rise.\n\nVolkswagen Group:\nAnother.\n\nReporting Period\n2025 outlook.\n\nResources\n- BMW Group, bmw_2024.pdf, p262\n- Volkswagen Group, volkswagen_2024.pdf, p229\n\nEvidence\nBMW Group, bmw_2024.pdf, p262:\n\"Deliveries rise.\"\n\nVolkswagen Group, volkswagen_2024.pdf, p229:\n\"We expect up to 5% in 2025.\"\n",
    5: "  No strong answer found in the provided documents.\n",
    6: "just text",
    7: None,
    8: "Answer\nx\nResources\nsomething without a page\nEvidence\nNone",
    9: "Answer\nx\nResources\n* see report.pdf pages 12 and 14\nEvidence\n- quote (pp. 12-14)\n\nBMW Group:\n",
}


def test_parse_answers(spark):
    got = {r.k: r for r in parse_answers(spark.createDataFrame(list(FORMS.items()), "k int, response string")).collect()}
    assert [(r.company, r.source_file, r.page_number) for r in got[1].resources] == [("Volkswagen Group", "volkswagen_2024.pdf", 229), ("Volkswagen Group", "volkswagen_2024.pdf", 185)]
    assert [(e.text, e.page_number) for e in got[1].evidence] == [('"We expect..."', 229), ('"The result..."', 185)] and got[1].reporting_period == "2025 (forecast)"
    assert [r.page_number for r in got[2].resources] == [183, 184] and got[2].evidence[0].company == "Volkswagen Group" and got[2].evidence[0].text == '"The Group represents its interests."' and got[2].answer == "They lobby."
    assert [(e.company, e.source_file, e.page_number) for e in got[3].evidence] == [("Robert Bosch GmbH", "bosch_2024.pdf", 49)] and len(got[3].resources) == 1
    assert [(e.company, e.page_number) for e in got[4].evidence] == [("BMW Group", 262), ("Volkswagen Group", 229)] and len(got[4].resources) == 2 and got[4].answer.startswith("BMW Group:\nA rise.")
    assert got[5].mode == "special_refusal" and got[5].answer == answers.NO_STRONG and got[5].resources == [] == got[5].evidence
    assert got[6].answer == "just text" and got[6].mode == "grounded_answer" and got[7].answer == ""
    assert [(r.company, r.source_file, r.page_label, r.raw) for r in got[8].resources] == [("", "", None, "something without a page")] and got[8].evidence == []
    assert (got[9].resources[0].source_file, got[9].resources[0].page_label, got[9].resources[0].company) == ("report.pdf", "12 and 14", "see") and got[9].evidence[0].text == "quote" and got[9].evidence[0].page_label == "12-14"


def test_refusals_and_gates(spark):
    none = "\nResources\nNone\nEvidence\nNone"
    said = {answers.NO_DATA: answers.NO_DATA, f"Answer {answers.UNSUPPORTED}": answers.UNSUPPORTED, f"Answer\n{answers.NO_STRONG}{none}": answers.NO_STRONG, f"Answer\nThe text does NOT provide it.{none}": answers.NO_STRONG, f"answer x {answers.NO_STRONG.upper()}{none}": answers.NO_STRONG, f"Answer\nThe text does not provide it.\nResources\n- a{none}x": None, " kept as is ": None}
    for r, want in said.items():
        assert one(spark, answers.refusal("t"), t=r) == (r if want is None else want), r
    assert one(spark, answers.final("t", "s"), t=answers.UNSUPPORTED, s="supported") == answers.NO_STRONG
    g = one(spark, answers.gate("t"), t="scope : unsupported\nCLARITY:ambiguous")
    assert (g.scope, g.clarity) == ("unsupported", "ambiguous") and one(spark, answers.gate("t"), t="?").scope == "supported"
    assert [one(spark, answers.operation("t"), t=x) for x in (" ranking!", "COMPARISON", "", "RANK")] == ["ranking", "comparison", "direct", "direct"]
    assert [one(spark, answers.topic("t"), t=x) for x in ("report_topic.", "EXTERNAL", "")] == ["report_topic", "external", "external"]


def test_answer_measures(spark):
    a = "Answer\nBMW\nResources\n- BMW Group, bmw_2024.pdf, page 171\nEvidence\nquote"
    assert one(spark, answer_measures.well_formed(F.col("a")), a=a) and not one(spark, answer_measures.well_formed(F.col("a")), a="Answer:\nx\nResources\nEvidence")
    assert one(spark, answer_measures.cites(F.col("a")), a=a) and not one(spark, answer_measures.cites(F.col("a")), a="Answer\nx\nResources\nNONE\nEvidence\ny")
    want = F.array(F.struct(F.lit("bmw group").alias("company"), F.lit("BMW_2024.pdf").alias("source_file"), F.lit(71).alias("page")))
    assert one(spark, answer_measures.resources_present(F.col("a"), want), a=a)  # 71 is a part of 171
    s = one(spark, answer_measures.judge_scores(F.col("a")), a='ok: {"relevance": 1, "groundedness": 0.5, "notes": "n"} done')
    assert (s.relevance, s.groundedness, s.completeness, s.notes) == (1, 0.5, None, "n")


def test_context_packing(spark):
    rows = [(1, i, 0.5, "d", f"c{i}", "BMW", "f.pdf", [i], "text", ["A", "B"], None, "x" * n) for i, n in enumerate((3000, 10, 900, 5), 1)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, score double, document_id string, chunk_id string, company string, source_file string, page_numbers array<int>, chunk_type string, section_titles array<string>, table_metadata string, text string")
    got = context.contexts(hits, most=3000, most_chunk=2500).first().context.split(context.SEPARATOR)
    assert len(got) == 2 and got[0].startswith("[Evidence 1]\nscore: 0.500000\ncompany: BMW\ndocument_id: d\nsource_file: f.pdf\npage_numbers: 1\nchunk_id: c1\nchunk_type: text\nsection_titles: A, B\nexact_text:\nxxx") and got[0].endswith("[TRUNCATED]")
    assert len(context.contexts(hits, most=1).first().context.split(context.SEPARATOR)) == 1


def test_locations(spark):
    assert one(spark, locate.terms("q"), q="On which page is the Revenue-outlook for 2025?") == ["revenue", "outlook", "2025"]
    assert one(spark, locate.excerpt(F.lit("a" * 600 + " outlook " + "b" * 600), F.array(F.lit("none"), F.lit("outlook")), 100)) == "..." + ("a" * 600 + " outlook " + "b" * 600)[551:651].strip() + "..."
    long = "we expect revenue outlook growth " + "word " * 30
    rows = [(1, "What page is the revenue outlook on?", i, s, "d", pages, 0, kind, titles, t, "c", "f.pdf") for i, (s, pages, kind, titles, t) in enumerate([(0.9, [3], "table", ["Outlook"], long), (0.8, [7], "text", [], long), (0.7, [7], "text", [], long), (0.6, [2], "text", [], "revenue"), (0.5, [5], "text", ["outlook"], long)], 1)]
    hits = spark.createDataFrame(rows, "query_id int, question string, rank int, score double, document_id string, page_numbers array<int>, page_start int, chunk_type string, section_titles array<string>, text string, company string, source_file string").withColumn("table_metadata", F.lit(None).cast("map<string,string>"))
    chosen = locate.select_locations(hits)
    assert [(r.page, r.place) for r in chosen.orderBy("place").collect()] == [(5, 1), (7, 2)]
    said = spark.createDataFrame([(1, "PAGES: 7, 99, 5")], "query_id int, response string")
    answer = locate.location_answers(locate.chosen_by_response(chosen, said)).first().answer
    assert answer.startswith("Answer\nThe strongest evidence for the revenue outlook on appears on pages 7 and 5.\n\nResources\n- c, f.pdf, page 7\n- c, f.pdf, page 5\n\nEvidence\n- Page 7: \"we expect")


# -- layout and chunks


def raw(spark, documents):
    return spark.read.schema(files.RAW).json(spark.sparkContext.parallelize([json.dumps(d) for d in documents]))


def line(content, top, height=0.2):
    return {"content": content, "polygon": [1.0, top, 7.0, top, 7.0, top + height, 1.0, top + height]}


def region(page, top=None, bottom=None):
    return {"pageNumber": page, "polygon": [0.5, top, 7.5, top, 7.5, bottom, 0.5, bottom] if top is not None else None}


def report():
    long = "This sentence has several words and says a little about the year. "
    pages, paragraphs = [], []
    for n in range(1, 7):
        body = [line(f"{long}{n}{i}", 1.5 + i * 0.25) for i in range(12)]
        head = [line("ANNUAL  REPORT", 0.3)] if n < 6 else []
        pages.append({"pageNumber": n, "width": 8.5, "height": 11.0, "unit": "inch", "lines": [*head, *body, line(f"Group Ltd", 10.6), {"content": " ", "polygon": []}]})
        paragraphs += [{"role": "pageHeader", "content": "ANNUAL REPORT", "boundingRegions": [region(n)]}, {"role": "sectionHeading", "content": f"Section {n}", "boundingRegions": [region(n)]}]
        paragraphs += [{"role": None, "content": long * 8, "boundingRegions": [region(n)]} for _ in range(3)]
    paragraphs += [{"content": "two pages", "boundingRegions": [region(1), region(2)]}, {"content": " ", "boundingRegions": [region(1)]}]
    cells = [{"kind": "columnHeader" if r == 0 else "content", "rowIndex": r, "columnIndex": c, "content": f"r{r} c{c}"} for r in range(40) for c in range(3)] + [{"rowIndex": 99, "columnIndex": 0, "content": "out"}, {"rowIndex": 0, "columnIndex": 0, "content": "more"}]
    table = {"rowCount": 40, "columnCount": 3, "cells": cells, "boundingRegions": [region(2, 5.0, 9.0), region(3, 1.0, 2.0)]}
    return {"source_file": "My Report.pdf", "model_id": "m", "result": {"apiVersion": "1", "pages": pages, "tables": [table, {"rowCount": 0, "columnCount": 0, "cells": []}], "paragraphs": paragraphs}}


def test_normalize(spark):
    made = layout.normalize(raw(spark, [report(), {"sourceFile": "b.pdf", "analyzeResult": {"modelId": "z", "pages": [{"pageNumber": 1, "height": 100.0, "unit": "pixel", "lines": [{"content": "x", "polygon": None}, {"content": "y", "polygon": [1, 2, 3, 4, 5, 6]}]}]}}, {"pages": []}]))
    docs = {r.source_file: r for r in made.documents.collect()}
    d = docs["My Report.pdf"]
    assert (d.model_id, d.page_count, d.table_count, d.unmapped_table_count) == ("m", 6, 2, 1) and (docs["b.pdf"].model_id, docs[None].model_id, docs[None].page_count) == ("z", "unknown", 0)
    kinds = {(r.source_file, r.page_number): r.page_type for r in made.pages.collect()}
    assert kinds["My Report.pdf", 1] == "text" and kinds["My Report.pdf", 2] == kinds["My Report.pdf", 3] == "mixed" and kinds["b.pdf", 1] == "visual_or_cover"
    rep = {r.normalized_text: r for r in made.repeated.collect()}
    assert rep.keys() == {"annual report", "group ltd"} and rep["annual report"].page_occurrence_count == 5 and rep["group ltd"].margin_positions == ["bottom"] and rep["annual report"].min_repeat_pages == 5
    assert made.flagged.count() == 11 and made.unmapped_tables.count() == 1
    b = made.lines.filter("source_file = 'b.pdf'").collect()
    assert all(r.left is None and r.margin_position is None for r in b) and len(b) == 2


def test_chunks(spark):
    made = layout.normalize(raw(spark, [report()]))
    c = chunking.chunk_documents(made).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in c] == list(range(1, len(c) + 1)) and all(r.char_count == len(r.text) and r.page_start == r.page_numbers[0] for r in c)
    tables = [r for r in c if r.chunk_type == "table"]
    assert tables and tables[0].page_numbers == [2, 3] and tables[0].table_metadata.row_start == 1 and tables[-1].table_metadata.row_end == 40 and tables[0].section_titles == ["Section 2"]
    assert "Row 1 [columnHeader]: C1=r0 c0 / more | C2=r0 c1 | C3=r0 c2" in tables[0].text and tables[0].chunk_id == f"my_report__c{tables[0].chunk_index:04d}__table__p2__t001"
    assert [r.table_metadata.row_start for r in tables][1:] == [r.table_metadata.row_end + 1 for r in tables][:-1] and all(len(r.text) <= 2200 for r in tables)
    texts = [r for r in c if r.chunk_type == "text"]
    assert all(r.content_source == "paragraph" and len(r.page_numbers) == 1 for r in texts) and texts[0].section_titles == ["Section 1"] and texts[0].header_footer_candidates_present
    assert "ANNUAL REPORT" not in " ".join(r.text for r in texts)
    s = chunking.chunking_stats(made, chunking.chunk_documents(made)).first()
    assert (s.source_page_count, s.pages_using_paragraphs, s.pages_using_line_fallback, s.paragraph_total, s.paragraph_empty, s.paragraph_ambiguous_page, s.repeated_header_footer_candidate_count) == (6, 6, 0, 32, 1, 1, 2)
    m = artifacts.chunk_coverage(made, chunking.chunk_documents(made)).first()
    assert m.page_coverage_rate == 1 and m.heading_coverage_rate == 1 and m.source_token_recall == 1 and m.cross_page_text_chunk_rate == 0 and m.table_coverage_rate == 0.5


def test_line_fallback(spark):
    lines = [line("Risk report", 1.0), line("Words of a first line", 1.3), line("and of a second", 1.6), line("after a wide gap", 4.0), line("in a table", 6.0)]
    doc = {"source_file": "x.pdf", "pages": [{"pageNumber": 1, "height": 11.0, "unit": "inch", "lines": lines}], "tables": [{"rowCount": 1, "columnCount": 1, "cells": [], "boundingRegions": [region(1, 5.9, 6.5)]}]}
    c = chunking.chunk_documents(layout.normalize(raw(spark, [doc]))).orderBy("chunk_index").collect()
    assert [r.content_source for r in c] == ["clean_lines", "tables"] and c[0].text == "Risk report\nWords of a first line\nand of a second\n\nafter a wide gap" and c[0].chunk_type == "visual" and c[1].text.endswith("Included rows: 1 to 1.\nRow 1: [empty]")


def test_lines_are_brought_together_for_pages_without_usable_paragraphs_only(spark, monkeypatch):
    made = layout.normalize(raw(spark, [report(), {"source_file": "x.pdf", "pages": [{"pageNumber": 1, "height": 11.0, "unit": "inch", "lines": [line("Risk report", 1.0), line("two\u00ad words", 1.3)]}], "paragraphs": [{"role": "pageHeader", "content": "Risk", "boundingRegions": [region(1)]}]}]))
    seen, kept = [], chunking.kept_lines
    monkeypatch.setattr(chunking, "kept_lines", lambda *a: seen.append(kept(*a)) or seen[-1])
    c = chunking.chunk_documents(made)
    assert [(r.source_file, r.page_number) for r in seen[0].collect()] == [("x.pdf", 1)]
    assert [r.text for r in c.filter("source_file = 'x.pdf'").collect()] == ["Risk report\ntwo\u00ad words"]
    m = {r.source_file: r for r in artifacts.chunk_coverage(made, c).collect()}
    assert m["x.pdf"].source_token_recall == m["x.pdf"].chunk_token_precision == 1 and m["x.pdf"].heading_coverage_rate is None
    assert [r.text for r in artifacts.source_texts(made.pages, made.paragraphs, made.lines).filter("not from_paragraphs").collect()] == ["Risk report\ntwo words"]


def unit(t, heading=None, titles=()):
    return {"text": t, "kind": "paragraph", "heading": heading, "titles": list(titles), "paragraphs": 1}


def test_packing_rules():
    pack = lambda *units, visual=False: [len(c["text"]) for c in chunking.pack_units(list(units), visual)]
    assert pack(unit("a" * 1100), unit("b" * 500)) == [1100, 500]  # the target ends a chunk
    assert pack(unit("a" * 500), unit("b" * 901)) == [500, 901]  # the soft limit
    assert pack(unit("a" * 449), unit("b" * 1500)) == [1951]  # below it anything is added
    assert pack(unit("a" * 200), unit("h" * 20, heading="h" * 20), unit("b" * 300)) == [522] or pack(unit("a" * 300), unit("h" * 20, heading="h" * 20), unit("b" * 300)) == [300, 322]
    assert pack(unit("a" * 1200), unit("b" * 100)) == [1302] and pack(unit("a" * 1200), unit("b" * 249), visual=True) == [1451]  # trailing, then small
    assert pack(unit("a" * 1300), unit("b" * 240)) == [1300, 240]  # would be too long
    text_ = "Alpha beta gamma. " * 200
    parts = chunking.split_long(text_, 1500)
    assert " ".join(parts) == " ".join(text_.split()) and all(len(p) <= 1500 for p in parts)
    assert [len(p) for p in chunking.split_long("x" * 4000, 1500)] == [1500, 1500, 1000] and chunking.split_long("  ", 10) == []
    rnd = random.Random(2)
    for _ in range(200):
        units = [unit(" ".join("w" * rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 400)))) for _ in range(rnd.randrange(1, 12))]
        out = chunking.pack_units(units, False)
        assert " ".join(" ".join(c["text"] for c in out).split()) == " ".join(" ".join(u["text"] for u in units).split()) and sum(c["paragraphs"] for c in out) == len(units) and all(len(c["text"]) <= 1951 for c in out)


# -- records, sources, sinks


def test_embedding_metrics(spark):
    expected = spark.createDataFrame([("d", "1", "a", "1"), ("d", "2", "b", "2"), ("d", "3", "c", "3"), ("e", "9", "z", "9")], "document_id string, id string, text string, chunk_id string")
    given = spark.createDataFrame([("d", "1", [3.0, 4.0], "a", "1", ["chunk_id"]), ("d", "1", [0.0, 0.0], "a", "1", ["chunk_id"]), ("d", "2", [float("nan"), 1.0], "B", None, []), ("d", "x", [1.0], "c", "x", ["chunk_id", "more"]), ("d", "y", [], "c", "y", ["chunk_id"])], "document_id string, id string, vector array<float>, text string, chunk_id string, payload_keys array<string>")
    manifest = spark.createDataFrame([("d", 5, 2)], "document_id string, chunk_count_embedded int, vector_dimension int")
    m = {r.document_id: r for r in artifacts.embedding_metrics(given, expected, manifest, ["chunk_id"]).collect()}
    d = m["d"]
    assert (d.source_chunk_count, d.embedded_record_count, d.unique_embedded_id_count, d.missing_embedding_count, d.extra_embedding_count, d.duplicate_embedding_id_count) == (3, 5, 4, 1, 2, 1)
    assert (d.embedding_coverage_rate, d.payload_text_exact_match_rate, d.payload_metadata_match_rate, d.required_payload_field_presence_rate) == (0.666667, 0.4, 0.4, 0.8)
    assert (d.nonempty_vector_rate, d.finite_vector_rate, d.nonzero_vector_rate, d.vector_dimension_consistency_rate, d.vector_norm_max, d.id_payload_match_rate) == (0.8, 0.6, 0.6, 0.6, 5.0, 0.8)
    assert m["e"].embedded_record_count == 0 and m["e"].embedding_coverage_rate == 0 and m["e"].finite_vector_rate == 1
    s = artifacts.embedding_summary(artifacts.embedding_metrics(given, expected, manifest, ["chunk_id"])).first()
    assert (s.document_count, s.missing_embedding_count, s.vector_dimension, s.payload_text_exact_match_rate, s.embedding_coverage_rate) == (2, 2, 2, 0.4, 0.5)


def test_providers(spark):
    assert [list(r) for r in providers.batches([10, 20, 30, 5, 40], rows=9, chars=50)] == [[0, 1], [2, 3], [4]] and [len(r) for r in providers.batches([1] * 33)] == [16, 16, 1] and list(providers.batches([])) == []
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    waits = []
    assert providers.with_retries(flaky, sleep=waits.append) == "ok" and waits == [3.0, 6.0]
    with pytest.raises(OSError):
        providers.with_retries(lambda: (_ for _ in ()).throw(OSError("down")), tries=2, sleep=waits.append)
    df = spark.createDataFrame([(1, "some words"), (2, " "), (3, None), (4, "some words")], "id int, text string")
    got = {r.id: r.vector for r in providers.embed(df, providers.HashedWords(16)).collect()}
    assert got.keys() == {1, 4} and got[1] == got[4] and sum(x * x for x in got[1]) == pytest.approx(1)

    class Echo:
        def complete(self, kind, prompts):
            return [f"{kind}: {p}" for p in prompts]

    asked = providers.asker(Echo())(spark.createDataFrame([(1, "why")], "question_id int, question string"), "gate").first()
    assert asked.response == "gate: why"
    record = providers.recorded(spark.createDataFrame([(1, "gate", "SCOPE: SUPPORTED")], "question_id int, kind string, response string"))
    assert record(spark.createDataFrame([(1, "q")], "question_id int, question string"), "gate").first().response == "SCOPE: SUPPORTED"
    with pytest.raises(Exception, match="no recorded response"):
        record(spark.createDataFrame([(2, "q")], "question_id int, question string"), "gate").collect()


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"retrieval_limit": 5, "chat_endpoint": "<your endpoint>"}))
    s = settings.load(str(path), {"FOLIANT_RETRIEVAL_LIMIT": "9", "FOLIANT_CHAT_ENDPOINT": "https://x", "FOLIANT_BATCH_SIZE": "3"})
    assert (s.retrieval_limit, s.chat_endpoint, s.batch_size, s.minimum_top_score) == (5, "https://x", 3, 0.45)
    for bad in ({"FOLIANT_BATCH_SIZE": "many"}, {"FOLIANT_BATCH_SIZE": "0"}):
        with pytest.raises(ValueError):
            settings.load(None, bad)
    assert settings.endpoint("https://x/openai/v1/ ") == "https://x" or settings.endpoint("https://x/openai/v1/") == "https://x"


def test_files_and_store(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a_layout.json").write_text(json.dumps(report(), indent=1))
    (tmp_path / "raw" / "x.pdf").write_bytes(b"%PDF")
    got = files.read_raw(spark, str(tmp_path / "raw" / "*.json")).select("file", F.size("result.pages").alias("n")).first()
    assert (got.file, got.n) == ("a_layout.json", 6) and [r.name for r in files.list_pdfs(spark, str(tmp_path / "raw")).collect()] == ["x.pdf"]
    (tmp_path / "stage").mkdir()
    for name in ("a_chunks.json", "a_evaluation_chunks.json", "b.json"):
        (tmp_path / "stage" / name).write_text('{"source_file": "a"}')
    assert [r.file for r in files.read_stage(spark, str(tmp_path / "stage"), "_chunks", "source_file string").collect()] == ["a_chunks.json"]
    left = spark.createDataFrame([("a", "a_p.json"), ("b", "b_p.json"), ("c", "c_p.json")], "document_id string, file string")
    right = spark.createDataFrame([("a_layout.json",), ("a_1.json",), ("b_2.json",), ("b_1.json",)], "file string")
    assert {r.document_id: r.matched for r in files.matching(left, right, "_layout").collect()} == {"a": "a_layout.json", "b": "b_1.json", "c": None}
    df = spark.range(3)
    path = str(tmp_path / "t")
    sinks.replace_table(df, path)
    sinks.replace_table(sinks.read_table(spark, path).union(spark.range(10, 12)), path)
    assert sinks.read_table(spark, path).count() == 5
    store = sinks.PointStore(spark, str(tmp_path / "points"), 2)
    rec = spark.createDataFrame([("a__c1", "d1", 1, [1.0, 0.0], "one"), ("a__c2", "d2", 2, [0.0, 1.0], "two")], "id string, document_id string, chunk_index int, vector array<float>, text string")
    assert store.upsert(sinks.points(rec)) == {"points": 2, "upserted": 2, "matches": True}
    again = sinks.points(rec.filter("id = 'a__c1'").withColumn("text", F.lit("new")))
    assert store.upsert(again)["points"] == 2 and store.upsert(again)["points"] == 2 and {r.text for r in store.read().collect()} == {"new", "two"}
    assert "PartitionFilters: [isnotnull(document_id" in store.read().filter("document_id = 'd1'")._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        store.upsert(sinks.points(rec.withColumn("vector", F.array(F.lit(1.0)).cast("array<float>"))))
    store.drop()
    assert not store.exists()


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = sinks.PointStore(spark, str(tmp_path / "points"), 2)
    schema = "id string, document_id string, chunk_index int, vector array<float>"

    def put(name, *ids):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"id": i, "document_id": "d", "chunk_index": 1, "vector": [1, 0]}) for i in ids))

    def go():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        ingest.upsert_available(stream, store, str(tmp_path / "cp"), sinks.points)

    put("1.json", "a", "b")
    go()
    put("2.json", "b", "c")
    go()
    go()
    assert store.count() == 3
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 01:10:00", "x", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.total for r in ingest.windowed_counts(events, "ts").collect()) == [3, 4]


def test_plans(spark, sf):
    """Filters and columns reach the scan, and the last selection is limited before it is shuffled."""
    p = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = p.filter("label = 3").select("vec_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan and re.search(r"ReadSchema: struct<vec_id:bigint,label:\w+>", plan)
    q = p.filter("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    plan = retrieval.top_k(p, q, 5, point_id="vec_id", vector="embedding").distinct()._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "MapInArrow" in plan


def test_question_bank(spark):
    from foliant.operators.evaluation import cases

    bank = spark.createDataFrame([("a", "A", "about a", [("a1", "why?", "supported", None, None, ["d"], None), ("a2", "how?", "unsupported", None, None, None, None)]), ("b", "B", None, [])], cases.BANK)
    flat = cases.flatten_bank(bank)
    assert [(r.case_id, r.category_case_index) for r in flat.orderBy("case_id").collect()] == [("a1", 1), ("a2", 2)] and cases.supported(flat).count() == 1
    assert cases.to_run(flat, flat.filter("case_id = 'a1'")).first().case_id == "a2"
    assert cases.render_bank(flat).first().markdown == "## A\n\nabout a\n\n1. why? (supported)\n2. how? (unsupported)"


def test_command_line(spark, tmp_path, capsys):
    from foliant.__main__ import main
    from foliant.sources.prompts import prompts

    (tmp_path / "a_layout.json").write_text(json.dumps(report()))
    assert main(["chunk", str(tmp_path / "*.json"), str(tmp_path / "chunks")]) == 0
    assert main(["index", str(tmp_path / "chunks"), str(tmp_path / "points"), "--dimension", "32"]) == 0
    assert main(["search", str(tmp_path / "points"), "Table with 40 rows and 3 columns", "--chunk-type", "table", "--limit", "2"]) == 0
    (tmp_path / "r.json").write_text(json.dumps({"response": FORMS[3]}))
    assert main(["parse", str(tmp_path / "r.json")]) == 0
    out = capsys.readouterr().out.strip().split("\n")
    assert json.loads(out[0])["matches"] and json.loads(out[1])["rank"] == 1 and "__table__" in json.loads(out[1])["chunk_id"] and json.loads(out[-1])["evidence"][0]["page_number"] == 49
    assert answers.NO_STRONG in prompts("annual reports")["answer"] and len(prompts("x")) == 6


def test_one_call_a_question_and_a_chunk(spark, tmp_path):
    """However often a response or a vector is used, its provider is asked once."""

    class Counted:
        def __init__(self, path):
            self.path = path

        def _note(self, lines):
            with open(self.path, "a") as f:
                f.writelines(f"{x}\n" for x in lines)

        def complete(self, kind, prompts):
            self._note([kind] * len(prompts))
            said = {"topic": "REPORT_TOPIC", "operation": "DIRECT", "location": "PAGES: 3", "answer": "Answer\nIt grew."}
            return [said.get(kind) or f"SCOPE: {'UNSUPPORTED' if 'odd' in p else 'SUPPORTED'}\nCLARITY: CLEAR" for p in prompts]

        def embed(self, texts):
            self._note(["embed"] * len(texts))
            return [[1.0, 0.0]] * len(texts)

    provider = Counted(str(tmp_path / "calls"))
    q = spark.createDataFrame([(k, f"{'On which page is' if k % 2 else 'How did'} trade {'odd' if k == 4 else ''} {k}?", ["X"]) for k in range(10)], "question_id int, question string, companies array<string>").repartition(3)
    hits = spark.createDataFrame(
        [(k, 1, 0.9, "d", "X", "d.pdf", [3], 3, "c", "text", ["t"], None, "trade grew") for k in range(10)],
        "query_id int, rank int, score double, document_id string, company string, source_file string, page_numbers array<int>, page_start int, chunk_id string, chunk_type string, section_titles array<string>, table_metadata map<string,string>, text string",
    )
    got = answers.answer(q, hits, providers.asker(provider))
    assert got.count() == 10 and got.count() == 10
    n = {k: (tmp_path / "calls").read_text().split().count(k) for k in ("gate", "topic", "operation", "answer", "location")}
    assert n == {"gate": 10, "topic": 1, "operation": 5, "answer": 5, "location": 5}

    chunks = spark.createDataFrame([(f"a__c{k}", f"d{k % 3}", k, f"text {k}") for k in range(10)], "id string, document_id string, chunk_index int, text string")
    made = sinks.points(providers.embed(chunks, provider))
    store = sinks.PointStore(spark, str(tmp_path / "points"), 2)
    assert store.upsert(made) == {"points": 10, "upserted": 10, "matches": True}
    assert (tmp_path / "calls").read_text().split().count("embed") == 10
    assert [(r.document, r.total, r.sent, r.stored, r.matches) for r in store.summary(made).orderBy("document").collect()] == [(None, True, 10, 10, True), ("d0", False, 4, 4, True), ("d1", False, 3, 3, True), ("d2", False, 3, 3, True)]


def test_upsert_touches_only_its_documents(spark, tmp_path):
    store = sinks.PointStore(spark, str(tmp_path / "p"), 2)
    rec = lambda *rows: spark.createDataFrame([(i, d, 1, [1.0, 0.0], t) for i, d, t in rows], "point_id string, document_id string, chunk_index int, vector array<float>, text string")
    store.upsert(rec(("a", "x", "1"), ("b", "y", "1"), ("c", "z", "1"), ("e", "x y/=", "1")))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "p").glob("*/*.parquet")}
    assert store.upsert(rec(("a", "x", "2"), ("c", "y", "2"))) == {"points": 4, "upserted": 2, "matches": True}
    assert {(r.point_id, r.document_id, r.text) for r in store.read().collect()} == {("a", "x", "2"), ("b", "y", "1"), ("c", "y", "2"), ("e", "x y/=", "1")}
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "p").glob("*/*.parquet")}
    assert len(before.keys() & after.keys()) == 1 and all(before[p] == after[p] for p in before.keys() & after.keys())
    assert not list(tmp_path.glob("p.*"))


@pytest.fixture
def model_service():
    """A server that answers as embedding, chat and layout services do."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def _say(self, status, said, **headers):
            body = json.dumps(said).encode()
            self.send_response(status)
            for k, v in {"Content-Length": str(len(body)), **headers}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.path, self.headers["api-key"]))
            if self.path.endswith("/embeddings"):
                texts = json.loads(body)["input"]
                return self._say(200, {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(texts)))]})
            if self.path.endswith("/completions"):
                said = json.loads(body)["messages"]
                return self._say(200, {"choices": [{"message": {"content": " " if said[-1]["content"] == "nothing" else f" {said[0]['content']}: {said[-1]['content']} "}}]})
            if body == b"bad":
                return self._say(400, {"error": "no PDF"})
            return self._say(202, {}, **{"Operation-Location": f"http://127.0.0.1:{self.server.server_address[1]}/result"})

        def do_GET(self):
            seen.append(("get", ""))
            done = sum(x == ("get", "") for x in seen) > 1
            self._say(200, {"status": "succeeded" if done else "running", "analyzeResult": {"_x": 1, "apiVersion": "1", "pages": [{"pageNumber": 1, "unit": "inch", "_p": 2, "lines": [{"content": "hello"}]}]}})

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", seen
    s.shutdown()


def test_model_services(spark, model_service):
    from foliant.sources import services

    url, seen = model_service
    embedder = services.HttpEmbedder(url + "/openai/v1/", "k", "m")
    assert embedder.embed(["a", "bbb"]) == [[1.0, 1.0], [3.0, 1.0]] and embedder.one("ab") == [2.0, 1.0]
    got = providers.embed(spark.createDataFrame([(1, "abcd"), (2, " ")], "id int, text string"), embedder).collect()
    assert [(r.id, r.vector) for r in got] == [(1, [4.0, 1.0])]
    chat = services.HttpChat(url, "k", "m", {"gate": "system"})
    assert chat.complete("gate", ["x"]) == ["system: x"] and chat.complete("answer", ["y"]) == ["y: y"]
    with pytest.raises(ValueError):
        chat.complete("gate", ["nothing"])
    layout_ = services.HttpLayout(url + "/analyze", "k", every_s=0.01)
    files_ = spark.createDataFrame([("a.pdf", b"%PDF")], "name string, content binary")
    row = services.extract_layouts(files_, layout_).first()
    assert (row.source_file, row.model_id, row.result.pages[0].lines[0].content, row.file) == ("a.pdf", "prebuilt-layout", "hello", "a.pdf")
    assert layout.normalize(services.extract_layouts(files_, layout_)).lines.first().text == "hello"
    with pytest.raises(OSError, match="no PDF"):
        layout_.extract("b", b"bad")
    assert ("/openai/v1/embeddings", "k") in seen


def pdf(*texts):
    """A PDF of a page a text, the second one compressed, with a map of its font's codes."""
    import zlib

    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(texts)} /Kids [{' '.join(f'{10 + 2 * i} 0 R' for i in range(len(texts)))}] /Resources << /Font << /F1 4 0 R >> >> >>", "null", "<< /Type /Font >>"]
    out = b"%PDF-1.4\n" + b"".join(f"{i + 1} 0 obj\n{x}\nendobj\n".encode() for i, x in enumerate(objects))
    for i, lines in enumerate(texts):
        body = "BT /F1 12 Tf " + " ".join(f"1 0 0 1 72 {700 - 20 * j} Tm {x}" for j, x in enumerate(lines)) + " ET"
        raw = body.encode("cp1252")
        head = b"<< /Length 0 >>"
        if i == 1:
            raw, head = zlib.compress(raw), b"<< /Length 0 /Filter /FlateDecode >>"
        out += f"{10 + 2 * i} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>\nendobj\n{11 + 2 * i} 0 obj\n".encode() + head + b"\nstream\n" + raw + b"\nendstream\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_text_and_parsing_report(spark, tmp_path):
    from foliant.sources import pdf_text

    data = pdf([r"(Page one \(first\)) Tj", "[(wo) -20 (rds) -300 (here)] TJ"], ["<48692021> Tj", "(caf\xe9 \\101) Tj"], [])
    assert pdf_text.pages(data) == ["Page one (first)\nwords here", "Hi !\ncafé A", ""]
    assert pdf_text.pages(b"no pdf") == []
    (tmp_path / "a.pdf").write_bytes(data)
    read = pdf_text.read_pdf_pages(spark, str(tmp_path))
    assert [(r.source_file, r.page_number) for r in read.orderBy("page_number").collect()] == [("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3)]
    page = lambda n, *said: {"pageNumber": n, "height": 11.0, "unit": "inch", "lines": [{"content": x} for x in said]}
    made = layout.normalize(raw(spark, [{"source_file": "a.pdf", "result": {"pages": [page(1, "Page one (first)", "words there"), page(2, "Hi ! café A"), page(3)]}}]))
    r = artifacts.parsing_report(made, read).first()
    assert (r.pages, r.compared_pages, r.pages_with_text, r.non_empty_page_rate, r.word_error_rate) == (3, 3, 2, 0.666667, round(1 / 9, 6))


def test_enrichment_sums(spark):
    e = spark.createDataFrame([("d", "table", 1, True), ("d", "table", None, False), ("e", "text", None, False)], "document_id string, chunk_type string, table_metadata int, changed boolean")
    assert tuple(artifacts.enrichment_summary(e).first()) == (2, 3, 2, 1, 1)


def test_answer_service(spark, tmp_path, capsys):
    import threading
    import urllib.error
    import urllib.request

    from foliant import service
    from foliant.__main__ import Recorded, main

    (tmp_path / "bmw_2024.pdf").write_bytes(b"%PDF x")
    rows_ = [("bmw_2024__c1", "bmw_2024", "Revenue of BMW Group grew to 10.", "text"), ("bosch_2024__c1", "bosch_2024", "Sales of Bosch fell.", "text")]
    points_ = spark.createDataFrame([(i, i, d, t, k, f"{d}.pdf", [7], 7, ["Results"]) for i, d, t, k in rows_], "point_id string, chunk_id string, document_id string, text string, chunk_type string, source_file string, page_numbers array<int>, page_start int, section_titles array<string>")
    points_ = providers.embed(points_, providers.HashedWords(256))
    said = {"gate": "SCOPE: SUPPORTED\nCLARITY: CLEAR", "operation": "DIRECT", "location": "PAGES: 7", "answer": 'Answer\nRevenue grew to 10.\n\nResources\n- BMW Group, bmw_2024.pdf, page 7\n\nEvidence\n- "Revenue of BMW Group grew to 10." (BMW Group, bmw_2024.pdf, page 7)'}
    own = service.Answers(spark, points_, providers.HashedWords(256), Recorded(said), registry.registry(spark))
    got = own.respond("Revenue of BMW Group grew to 10.")
    assert got["answer"] == "Revenue grew to 10." and got["resources"][0]["source_file"] == "bmw_2024.pdf" and got["evidence"][0]["page_number"] == 7 and got["duration_seconds"] >= 0
    assert "page 7" in own.respond("On which page is Revenue of BMW Group grew to 10.?")["answer"]
    s = service.server(own, str(tmp_path), ("127.0.0.1", 0), "http://ui")
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_address[1]}"

    def get(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, body)) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    assert get("/health") == (200, b'{"status": "ok"}') and json.loads(get("/api/companies")[1])["companies"][0]["document_id"] == "bmw_2024"
    assert get("/reports/bmw_2024.pdf") == (200, b"%PDF x") and get("/reports/..%2fx.pdf")[0] == get("/reports/../x.pdf")[0] == get("/reports/y.pdf")[0] == get("/x")[0] == 404
    ask = lambda **x: get("/api/answer", json.dumps(x).encode())
    assert json.loads(ask(question="Revenue of BMW Group grew to 10.", company_filters=["BMW"], retrieval_limit=3)[1])["mode"] == got["mode"]
    assert ask(question=" ")[0] == ask(question="x", company_filters=["nobody"])[0] == ask(question="x", retrieval_limit=99)[0] == 400
    s.shutdown()
    points_.write.parquet(str(tmp_path / "points"))
    (tmp_path / "said.json").write_text(json.dumps(said))
    assert main(["answer", str(tmp_path / "points"), "Revenue of BMW Group grew to 10.", "--recorded", str(tmp_path / "said.json")]) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["answer"] == "Revenue grew to 10."


def test_text_parts_and_table_function(spark):
    said = " ".join(f"Sentence {k} goes on and on." for k in range(30))
    df = spark.createDataFrame([(1, said), (2, None), (3, "short"), (4, "x" * 900)], "id int, text string")
    got = sorted(tuple(r) for r in chunking.text_parts(df, "id", 300).collect())
    chunking.register(spark)
    df.createOrReplaceTempView("_parts")
    assert got == sorted(tuple(r) for r in spark.sql("select id, c.part, c.text from _parts, lateral chunk_text(text, 300) c").collect())
    assert {i for i, _, _ in got} == {1, 3, 4} and all(len(t) <= 420 for _, _, t in got) and " ".join(t for i, _, t in got if i == 1) == said


def test_detect_with_many_first_words(spark, monkeypatch):
    known = spark.createDataFrame([(0, "a1", "Alpha Beta Gamma", "a.pdf", ["alpha"]), (1, "b1", "Beta Gamma", "b.pdf", ["the beta"])], "place int, document_id string, company_name string, source_file string, aliases array<string>")
    q = spark.createDataFrame([(1, "the beta of alpha beta gamma"), (2, "gamma beta"), (3, ""), (4, None), (5, "alpha")], "question_id int, question string")
    want = {1: ["b1", "a1"], 2: [], 3: [], 4: [], 5: ["a1"]}
    assert {r.question_id: r.documents for r in registry.detect(q, known).collect()} == want
    monkeypatch.setattr(registry, "FIRST_WORDS", 1)
    assert {r.question_id: r.documents for r in registry.detect(q, known).collect()} == want


def test_batches_of_documents(spark):
    sizes = {"a": [10, 20, 30, 5, 40], "b": [60, 1, 1], None: [1, None]}
    df = spark.createDataFrame([(d, i, None if n is None else "x" * n) for d, x in sizes.items() for i, n in enumerate(x)], "d string, i int, text string")
    got = {(r.d, r.i): r.batch_id for r in providers.batch_ids(df.filter("d is not null").repartition(5), "d", "i", most_rows=2, chars=50).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("a", 4): 2, ("b", 0): 0, ("b", 1): 1, ("b", 2): 1}


def test_whole_numbers_and_documents(spark, tmp_path):
    from foliant.functions.text import int_or_zero

    df = spark.createDataFrame([("3",), ("-2.9",), ("true",), ("x",), (None,), ("1e3",), (" 7 ",), ("99999999999",), ("infinity",)], "x string")
    assert [r[0] for r in df.select(int_or_zero("x")).collect()] == [3, -2, 0, 0, 0, 1000, 7, 0, 0]
    assert spark.range(1).select(int_or_zero(F.lit(True)), int_or_zero(F.lit(4.9))).first()[:] == (0, 4)
    got = spark.createDataFrame([(["a", "b"], ["b", "c"]), (None, ["a"]), (None, None)], "d array<string>, f array<string>").select(registry.wanted("d", "f").alias("w")).collect()
    assert [r.w for r in got] == [["a", "b", "c"], ["a"], []]
    docs = spark.createDataFrame([("a", 1, "ü", None), ("b", 2, "y", 3.5)], "name string, n int, t string, x double")
    sinks.write_documents(docs, str(tmp_path / "out"), "name")
    (path,) = (tmp_path / "out" / "name=a").glob("part-*")
    said = path.read_text(encoding="utf-8")
    assert json.loads(said) == {"n": 1, "t": "ü", "x": None} and "\n  " in said


def test_blocks_of_queries_are_sent_in_about_what_they_measure():
    import pickle
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from foliant.operators import retrieval

    n, lists = 2000, [str(x) for x in range(64)]
    block = pa.table({"q": pa.array(range(n)), "v": pa.array([[float(i + j) for j in range(64)] for i in range(n)]), "d": pa.array([lists[i % 7 :] if i % 3 else None for i in range(n)], pa.list_(pa.string())), "c": pa.array([None] * n, pa.list_(pa.string())), "n": pa.array([10] * n, pa.int32())})
    sent = pickle.dumps(retrieval._packed(block))
    tracemalloc.start()
    got = pickle.loads(sent)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 2 * n * (64 * 8 + 64 + 32 * len(lists) // 8)
    assert np.array_equal(got["flat"].reshape(n, 64)[5], np.arange(5.0, 69.0)) and len(got["d_sets"]) == 7
    assert all((got["d"][i] < 0) == (i % 3 == 0) and (i % 3 == 0 or got["d_sets"][got["d"][i]] == sorted(lists[i % 7 :])) for i in range(n))


def test_excerpts_of_many_terms_take_linear_time(spark):
    """The longest term found decides, of equals the first place; a text is folded once, not once a term."""
    import time

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randrange(3, 9)))
    given = []
    for k in range(40):
        said = [word() for _ in range(2000 if k < 20 else rnd.randrange(0, 12))]
        given.append((k, "  " + " ".join(x.upper() if rnd.random() < 0.3 else x for x in said) + " \n", [word() for _ in range(1500)] + rnd.sample(said, len(said) // 2) if k % 3 else [word() * 3]))

    def slow(text, terms, most):
        t = text.strip()
        if len(t) <= most:
            return t
        found = [(-len(x), t.lower().index(x)) for x in terms if x in t.lower()]
        if not found:
            return t[:most].rstrip() + "..."
        end = min(max(min(found)[1] - most // 2, 0) + most, len(t))
        start = max(end - most, 0)
        return "..." * (start > 0) + t[start : start + most].strip() + "..." * (end < len(t))

    df = spark.createDataFrame(given, "k int, text string, terms array<string>").repartition(4)
    df.select(locate.excerpt("text", "terms", 60)).limit(1).collect()
    begun = time.perf_counter()
    got = {r.k: r.e for r in df.select("k", locate.excerpt("text", "terms", 60).alias("e")).collect()}
    assert time.perf_counter() - begun < 20
    assert got == {k: slow(t, x, 60) for k, t, x in given}


def test_hits_meet_what_is_made_once_a_chunk_and_once_a_question(spark):
    """Terms are found within words, beside marks and in any case, repeats counted, however texts and questions meet."""
    texts = ["Outlook-guidance: we Expect MARGINS of 20.5% é", "margin margins forecastéd revenues and sales", None, "", "x" * 50 + "dividend proposals " + "word " * 30 + "forecast expected"]
    questions = ["Where is the margin margin outlook?", "dividend proposed guidance for sales", "on which page is it", "expect revenue 205 nothing"]
    chunks = spark.createDataFrame([(i, t, ["Sales Outlook"] if i == 1 else None if i == 2 else ["a", "b"], "text" if i % 2 else None) for i, t in enumerate(texts)], "rank int, text string, section_titles array<string>, chunk_type string").withColumn("table_metadata", F.expr("cast(null as map<string,string>)"))
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id int, question string")
    plain = chunks.crossJoin(asked).withColumn("score", F.lit(0.5))
    early = locate.searchable(chunks).crossJoin(locate.asked(asked)).withColumn("score", F.lit(0.5)).orderBy("rank", "query_id")
    rows = lambda h: sorted(map(tuple, locate.rerank(h).select("query_id", "rank", "overlap", "intent_bonus", "composite", "location_rank").collect()))
    got = rows(plain)
    assert rows(early) == got
    said = {r.query_id: r.terms for r in asked.select("query_id", locate.terms("question").alias("terms")).collect()}
    for q, i, overlap, *_ in got:
        hay = " ".join(x for x in (texts[i] or "", "Sales Outlook" if i == 1 else "" if i == 2 else "a b", "text" if i % 2 else "") if x).lower()
        assert overlap == sum(t in hay for t in said[q]), (q, i)
