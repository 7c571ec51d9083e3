"""Search that prunes the store, upserts by Spark's own writes, inverted lists, names by automaton, rows that stay what they are."""

import json
import math
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import answers, ivf, registry, retrieval
from foliant.sources import providers, sinks

POINT = "point_id string, document_id string, chunk_type string, chunk_index int, vector array<float>, text string"


def records(spark, *rows):
    return spark.createDataFrame([(i, d, c, n, [float(x) for x in v], i) for n, (i, d, c, v) in enumerate(rows)], POINT)


def queries(spark, *rows):
    return spark.createDataFrame([(i, [float(x) for x in v], d, c) for i, v, d, c in rows], "query_id int, vector array<double>, documents array<string>, types array<string>")


def hits(df):
    return sorted((r.query_id, r["rank"], r.point_id) for r in df.collect())


NAMED = {"document": "document_id", "chunk_type": "chunk_type", "documents": "documents", "chunk_types": "types"}


def scanned(df):
    """What the plan says of its scan, and how many bytes it read when it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text, found, todo = plan.toString(), 0, [plan]
    while todo:
        node = todo.pop()
        inside = getattr(node, "executedPlan", None)
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(inside())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found += node.metrics().get("filesSize").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return text, found


def test_filters_reach_the_scan(spark, tmp_path):
    store = sinks.PointStore(spark, str(tmp_path / "p"), 2)
    store.upsert(records(spark, *((f"{d}{i}", f"d{d}", "table" if i % 2 else "text", (i, 1)) for d in range(6) for i in range(20))))
    points = store.read()
    one = queries(spark, (1, (1, 0), ["d1"], ["text"]), (2, (0, 1), ["d1", "d4"], ["text"]))
    text, some = scanned(retrieval.top_k(points, one, 3, **NAMED))
    assert "document_id#" in text.split("PartitionFilters: [")[1].split("]")[0] and "In(chunk_type" not in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(chunk_type,text)" in text.split("PushedFilters: [")[1].split("]")[0]
    _, whole = scanned(retrieval.top_k(points, queries(spark, (1, (1, 0), ["d1"], None), (2, (0, 1), None, None)), 3, **NAMED))
    assert 0 < some * 2 < whole  # two of six folders; all of them if a query may use every document
    assert hits(retrieval.top_k(points, one, 3, **NAMED)) == [(1, 1, "118"), (1, 2, "116"), (1, 3, "114"), (2, 1, "10"), (2, 2, "40"), (2, 3, "12")]


@pytest.mark.parametrize("listed", [1000, 0])
def test_filters_of_other_types(spark, monkeypatch, listed):
    monkeypatch.setattr(retrieval, "LISTED", listed)
    rows = spark.createDataFrame([(i, i % 4, [1.0, float(i)]) for i in range(40)] + [(99, None, [1.0, 0.0])], "point_id int, label int, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0], ["2", "x", "--2", "02"]), (2, [1.0, 0.0], ["3", "", None])], "query_id int, vector array<double>, documents array<string>")
    got = retrieval.top_k(rows, q, 2, document="label", documents="documents")
    assert hits(got) == [(1, 1, 2), (1, 2, 6), (2, 1, 3), (2, 2, 7)]
    none = q.withColumn("documents", F.array(F.lit("nobody")))
    assert retrieval.top_k(rows, none, 2, document="label", documents="documents").collect() == []
    dated = rows.withColumn("label", F.expr("date'2024-01-01' + label"))
    asked = q.withColumn("documents", F.array(F.lit("2024-01-03")))
    assert hits(retrieval.top_k(dated, asked, 1, document="label", documents="documents")) == [(1, 1, 2), (2, 1, 2)]


def test_each_query_meets_vectors_of_its_own_length(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0, 0.0]), ("d", []), ("e", None), ("f", [0.0, 0.0])], "point_id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0, 0.0]), (3, [1.0] * 9)], "query_id int, vector array<double>")
    assert hits(retrieval.top_k(rows, q, 5)) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]


def test_search_equals_plain_python(spark):
    """Groups of filters, kinds, limits and slices, by document and not."""
    rnd = random.Random(7)
    rows = [(f"p{i:03}", rnd.choice(["a", "b", "c", "d", None, ""]), rnd.choice(["text", "table", None]), [rnd.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(300)]
    asked = [(j, [rnd.gauss(0, 1) for _ in range(3)], rnd.choice([None, [], ["a"], ["a", "b"], ["b", "nobody"]]), rnd.choice([None, ["text"], ["text", "table"]]), rnd.choice([1, 2, 7])) for j in range(12)]
    points = spark.createDataFrame(rows, "point_id string, document_id string, chunk_type string, vector array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id int, vector array<double>, documents array<string>, types array<string>, n int")
    cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for per in (False, True):
        want = []
        for j, v, d, c, n in asked:
            scored = [(-round(cosine(v, x[3]), 9), x[0], x[1]) for x in rows if (not d or x[1] in d) and (not c or x[2] in c)]
            for key in {x[2] for x in scored} if per else [None]:
                best = sorted(x for x in scored if not per or x[2] == key)[:n]
                want += [(j, i) for _, i, _ in best]
        got = retrieval.top_k(points, q, 7, per_document=per, limit="n", **NAMED)
        assert sorted((r.query_id, r.point_id) for r in got.collect()) == sorted(want)


def test_upsert_is_one_write(spark, tmp_path):
    store = sinks.PointStore(spark, str(tmp_path / "p"), 2)
    store.upsert(records(spark, ("a", "x", "text", (1, 0)), ("b", "x", "text", (1, 0)), ("c", "007", "table", (0, 1)), ("e", "z", "text", (1, 1))))
    assert {r.document_id for r in store.read().collect()} == {"x", "007", "z"}
    # a document that loses all of its points, one that gains them, one that stays as it is
    assert store.upsert(records(spark, ("c", "x", "text", (1, 1)), ("b", "y", "text", (1, 1)))) == {"points": 4, "upserted": 2, "matches": True}
    assert {(r.point_id, r.document_id) for r in store.read().collect()} == {("a", "x"), ("b", "y"), ("c", "x"), ("e", "z")}
    assert store.upsert(records(spark, ("f", "007", "text", (1, 1))))["points"] == 5
    with pytest.raises(ValueError, match="the store has vectors of dimension 2, not 3"):
        sinks.PointStore(spark, store.path, 3).upsert(records(spark, ("g", "x", "text", (1, 1, 1))))
    with pytest.raises(ValueError, match="no point_id"):
        store.upsert(records(spark, (None, "x", "text", (1, 1))))
    assert sinks.PointStore(spark, store.path, 3).upsert(records(spark, ("g", "x", "text", (1, 1, 1))), recreate=True)["points"] == 1


def test_a_writer_that_dies_and_a_reader_meanwhile(spark, tmp_path, monkeypatch):
    """The rows are as before until the write is done, and stay so if it fails."""
    store = sinks.PointStore(spark, str(tmp_path / "p"), 2)
    store.upsert(records(spark, *((f"p{i}", f"d{i % 3}", "text", (i, 1)) for i in range(9))))
    before = sorted(r.point_id for r in store.read().collect())
    new, seen, go = records(spark, *((f"q{i}", f"d{i % 3}", "text", (i, 1)) for i in range(6))), [], str(tmp_path / "go")

    def slow(fail):
        def run(batches):
            import os

            for batch in batches:
                end = time.time() + 60
                while not os.path.exists(go) and time.time() < end:
                    time.sleep(0.1)
                if fail:
                    raise RuntimeError("died")
                yield batch

        return lambda existing, rows, **how: rows.mapInArrow(run, rows.schema)

    # rows are held back within the job that writes them: upserted() and the checkpoint give them to the writer as they are
    monkeypatch.setattr(sinks, "checkpointed", lambda df: df)
    for fail in (True, False):
        monkeypatch.setattr(sinks, "upserted", slow(fail))
        failed = []

        def write(failed=failed):
            try:
                store.upsert(new)
            except Exception as e:  # noqa: BLE001
                failed.append(e)

        other = threading.Thread(target=write)
        other.start()
        time.sleep(3)
        seen.append(sorted(r.point_id for r in store.read().collect()))
        open(go, "w").close()
        other.join()
        assert bool(failed) is fail
        if fail:
            assert sorted(r.point_id for r in store.read().collect()) == before
            (tmp_path / "go").unlink()
    assert seen == [before, before]
    assert sorted(r.point_id for r in store.read().collect()) == [f"q{i}" for i in range(6)]


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, path)
    sinks.replace_table(spark.range(3), path)
    reader = sinks.read_table(spark, path)
    sinks.replace_table(sinks.read_table(spark, path).union(spark.range(10, 12)), path)
    assert reader.count() == 3 and sinks.read_table(spark, path).count() == 5
    with pytest.raises(Exception, match="died"):
        sinks.replace_table(spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("died"))).alias("id")), path)
    assert sinks.read_table(spark, path).count() == 5
    sinks.replace_table(spark.range(1), path)
    assert sinks.read_table(spark, path).count() == 1
    assert len(list((tmp_path / "t").glob("version=*/_SUCCESS"))) == 2


def test_inverted_lists(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = [(f"p{i:04}", (centres[i % 20] + 0.25 * rng.normal(size=16)).tolist()) for i in range(2000)]
    points = spark.createDataFrame([*vectors, ("zero", [0.0] * 16), ("null", None), ("short", [1.0])], "point_id string, vector array<double>")
    c = ivf.fit(points, lists=32, sample=500)
    assert c.shape == (32, 16) and np.allclose((c * c).sum(1), 1)
    ivf.write(points, c, str(tmp_path / "i"))
    index, c = ivf.read(spark, str(tmp_path / "i"))
    assert index.count() == 2003 and {r.point_id for r in index.filter("list_id = -1").collect()} == {"zero", "null", "short"}
    q = spark.createDataFrame([(i, vectors[i * 37][1]) for i in range(40)], "query_id int, vector array<double>")
    exact = retrieval.top_k(points, q, 10)
    found = ivf.search(index, c, q, 10, probes=6)
    assert ivf.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.95
    assert hits(ivf.search(index, c, q, 10, probes=32)) == hits(exact)
    probes = ivf.calibrated(index, c, ivf.sampled(index), 10, 0.97)
    assert 1 < probes < 16 and ivf.recall(ivf.search(index, c, q, 10, probes=probes), exact).agg(F.avg("recall")).first()[0] >= 0.95
    assert ivf.calibrated(index, c, ivf.sampled(index), 10, 1.0) <= 32
    text, some = scanned(ivf.search(index, c, q.limit(1), 10, probes=2))
    assert "list_id#" in text.split("PartitionFilters: [")[1].split("]")[0] and some * 4 < scanned(ivf.search(index, c, q, 10, probes=32))[1]
    assert ivf.fit(points.limit(0)).shape == (0, 0)
    assert ivf.search(ivf.filed(points.filter("point_id = 'zero'"), np.zeros((0, 0))), np.zeros((0, 0)), q, 3).collect() == []


def test_names_by_automaton_and_by_runs(spark):
    rnd = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "alp", "ha"]
    known = [(i, f"d{i}", " ".join(rnd.choices(words, k=rnd.randint(1, 4))), f"f{i}.pdf", [" ".join(rnd.choices(words, k=rnd.randint(1, 3)))]) for i in range(12)]
    known = spark.createDataFrame(known, "place int, document_id string, company_name string, source_file string, aliases array<string>")
    asked = [(i % 7, " ".join(rnd.choices([*words, "x", "Beta,", "ALPHA"], k=rnd.randint(0, 12)))) for i in range(60)] + [(None, "alpha"), (3, None)]
    q = spark.createDataFrame(asked, "question_id int, question string")
    one, other = ([(r.question_id, r.documents) for r in registry.detect(q, known, automaton_bytes=n).collect()] for n in (1 << 20, 0))
    order = lambda rows: sorted(rows, key=str)
    assert order(one) == order(other) and len(one) == len(asked)
    # the two rows of a question are told apart
    both = spark.createDataFrame([(1, "alpha"), (1, "nothing")], "question_id int, question string")
    single = spark.createDataFrame([(0, "d", "Alpha", "f", None)], known.schema)
    for n in (1 << 20, 0):
        assert sorted(r.documents for r in registry.detect(both, single, automaton_bytes=n).collect()) == [[], ["d"]]
    assert registry.detect(both, single.limit(0)).select("documents").distinct().collect()[0].documents == []


def test_batches_keep_every_row(spark):
    rows = [("a", 1, "xx", 1), ("a", 1, "xx", 2), (None, 1, "y", 3), (None, None, None, 4), ("", 2, "z", 5), ("a", None, "w", 6), ("a", 1, "xx", 1)]
    df = spark.createDataFrame(rows, "d string, i int, text string, other int")
    got = providers.batch_ids(df.withColumn("batch_id", F.lit("mine")), "d", "i", most_rows=2, chars=100).collect()
    assert sorted((r.d, r.i, r.text, r.other) for r in got if r.d == "a" and r.i) == sorted(r for r in rows if r[0] == "a" and r[1]) and len(got) == len(rows)
    assert sorted(r.batch_id for r in got if r.d == "a") == [0, 0, 1, 1] and {r.batch_id for r in got if r.d is None} == {0} and {r.batch_id for r in got if r.d == ""} == {0}


class Counted:
    """Responses by kind, counted."""

    def __init__(self, path, **said):
        self.path, self.said = str(path), said

    def complete(self, kind, prompts):
        with open(self.path, "a") as f:
            f.writelines(f"{kind}\n" for _ in prompts)
        return [self.said[kind] for _ in prompts]


class CountedWords(providers.HashedWords):
    def __init__(self, path):
        super().__init__(64)
        self.path = str(path)

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.writelines("embed\n" for _ in texts)
        return super().embed(texts)


def test_nothing_is_searched_for_what_the_gate_stops(spark, tmp_path):
    from foliant import service

    log = tmp_path / "log"
    points = spark.createDataFrame([(f"{d}_{i}", d, f"Revenue of part {i}", "text", f"{d}.pdf", [i], i) for d in ("bmw_2024", "bosch_2024") for i in range(40)], "point_id string, document_id string, text string, chunk_type string, source_file string, page_numbers array<int>, page_start int")
    points = providers.embed(points.withColumn("chunk_id", F.col("point_id")).withColumn("section_titles", F.array()), providers.HashedWords(64))
    refused = {"topic": "EXTERNAL", "operation": "DIRECT", "location": "PAGES: 1", "answer": "Answer\nIt grew."}
    own = lambda **said: service.Answers(spark, points, CountedWords(log), Counted(log, **refused | said), registry.registry(spark))
    calls = lambda: sorted(log.read_text().split()) if log.exists() else []
    assert own(gate="SCOPE: UNSUPPORTED\nCLARITY: CLEAR").respond("Who won?")["raw_response"] == answers.UNSUPPORTED
    assert calls() == ["gate", "topic"]
    log.unlink()
    assert own(gate="SCOPE: SUPPORTED\nCLARITY: AMBIGUOUS").respond("What of it?")["raw_response"] == answers.NO_STRONG
    assert calls() == ["gate"]
    log.unlink()
    seen = []
    for question, operation, limit, want in (("Revenue of part 7 of BMW and Bosch", "AGGREGATION", 3, 20), ("Revenue of part 7 of BMW", "AGGREGATION", 3, 3), ("Revenue of part 7 of BMW and Bosch", "DIRECT", 3, 3), ("Revenue of part 7 of Bosch and BMW", "RANKING", 30, 30)):
        a = own(gate="SCOPE: SUPPORTED\nCLARITY: CLEAR", operation=operation)
        found = a.search
        a.search = lambda asked, found=found: seen.append((asked.first().limit, asked.first().companies)) or found(asked)
        assert a.respond(question, limit=limit)["answer"] in ("It grew.", answers.NO_STRONG)
        assert seen[-1][0] == want
    assert seen[0][1] == ["BMW Group", "Robert Bosch GmbH"] and seen[3][1] == ["Robert Bosch GmbH", "BMW Group"]
    assert calls().count("embed") == calls().count("gate") == calls().count("operation") == 4


def test_json_of_points(spark, tmp_path):
    """The command line reads a store as the store does."""
    store = sinks.PointStore(spark, str(tmp_path / "p"), 2)
    store.upsert(records(spark, ("a", "x", "text", (1, 0))))
    store.upsert(records(spark, ("a", "y", "text", (1, 0))))
    assert spark.read.parquet(store.path).count() == 2 and store.read().count() == 1
    assert json.loads(store.read().toJSON().first())["document_id"] == "y" and math.isclose(store.read().first().vector[0], 1.0)


class Once:
    """A judge that logs its prompts, and dies at one of them while a file is there."""

    def __init__(self, path, dies=""):
        self.path, self.dies = str(path), dies

    def complete(self, kind, prompts):
        import os

        if self.dies and os.path.exists(self.path + ".dies") and any(self.dies in p for p in prompts):
            raise RuntimeError("killed")
        with open(self.path, "a") as f:
            f.writelines(f"{kind} {len(p)}\n" for p in prompts)
        return [f'Scores: {{"relevance": 1, "groundedness": 0.5, "notes": "n{len(p)}"}}' for p in prompts]


def test_a_ledger_asks_for_what_is_left(spark, tmp_path):
    from foliant.operators.evaluation import judge
    from foliant.operators.evaluation import answers as measures
    from foliant.sources.ledger import Ledger

    log = tmp_path / "log"
    (tmp_path / "log.dies").write_text("")
    kind = lambda i: "unsupported" if i % 10 == 0 else "supported"
    said = lambda i: answers.NO_STRONG if i % 7 == 0 else f"Answer {i % 40}"
    cases = spark.createDataFrame([(i, kind(i), f"question {i % 40}", ["d"], said(i)) for i in range(60)], "case_id int, answer_expectation string, question string, expected_document_ids array<string>, generated_answer string")
    ask = lambda: Ledger(spark, str(tmp_path / "ledger"), Once(log, "question 33"), block=4, tasks=2, tries=1, wait=0, valid=judge.valid)
    with pytest.raises(Exception, match="killed"):
        judge.judged(cases, ask()).collect()
    before = len(log.read_text().split("\n")) - 1
    kept = ask().read().count()
    assert 0 < kept <= before
    (tmp_path / "log.dies").unlink()
    got = {r.case_id: r for r in judge.judged(cases, ask()).collect()}
    prompts = {(f"question {i % 40}", said(i)) for i in range(60) if i % 10 and i % 7}
    assert len(log.read_text().split("\n")) - 1 == before + len(prompts) - kept  # only what is left was asked
    assert judge.judged(cases, ask()).count() == 60 and len(log.read_text().split("\n")) - 1 == before + len(prompts) - kept
    assert len(got) == 60 and all((r.scores is None) == (i % 10 == 0 or i % 7 == 0) for i, r in got.items())
    assert (got[1].scores.relevance, got[1].scores.groundedness, got[1].scores.completeness) == (1.0, 0.5, 0.0)
    # five scores a case, from the prompt to the summary
    own = judge.judged(cases, ask()).withColumns({"expected_documents": F.expr("array(struct('c' company_name, 'f' source_file))"), "category_id": F.lit("k"), "category_name": F.lit("K"), "latency_seconds": F.lit(1.0)})
    total = measures.summary(measures.scored(own)).filter("category_id is null").first()
    assert total.case_count == 60 and 0 < total.llm_relevance_mean < 1


def test_a_ledger_keeps_to_its_rate(spark, tmp_path):
    from foliant.sources.ledger import Ledger

    rows = spark.createDataFrame([(i, f"q{i}") for i in range(12)] + [(99, None), (100, "")], "question_id int, question string")
    ledger = Ledger(spark, str(tmp_path / "l"), Once(tmp_path / "log"), per_second=8, tasks=2)
    begun = time.time()
    got = ledger(rows, "gate")
    assert got.count() == 14 and time.time() - begun > 0.7  # 13 prompts in two tasks, 4 a second each
    with pytest.raises(Exception, match="not valid"):
        Ledger(spark, str(tmp_path / "l"), Once(tmp_path / "log"), tries=1, wait=0, valid=lambda x: False)(rows, "topic").collect()
    assert ledger.read().select("kind").distinct().count() == 1


def test_recall_of_the_registered_query(spark):
    from foliant.plans.search import vec_ivf

    assert vec_ivf(spark, "/root/testdata/sf0.01").agg(F.avg("recall")).first()[0] >= 0.95


def test_judge_from_the_command_line(spark, tmp_path, capsys):
    from foliant.__main__ import main

    case = lambda i, kind, said: {"case_id": str(i), "category_id": "k", "category_name": "K", "answer_expectation": kind, "question": f"q{i}", "generated_answer": said, "latency_seconds": 1.0, "expected_document_ids": ["d"], "expected_documents": [{"company_name": "C", "source_file": "c.pdf"}]}
    (tmp_path / "cases.json").write_text("\n".join(json.dumps(x) for x in (case(1, "supported", "Answer\nC grew."), case(2, "unsupported", answers.UNSUPPORTED), case(3, "supported", answers.NO_STRONG))))
    (tmp_path / "said.json").write_text(json.dumps({"judge": 'x {"relevance": 1, "groundedness": 0.5, "citation_accuracy": 1, "completeness": 0, "instruction_following": 1} y'}))
    assert main(["judge", str(tmp_path / "cases.json"), str(tmp_path / "out"), str(tmp_path / "ledger"), "--recorded", str(tmp_path / "said.json")]) == 0
    told = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n") if x.startswith("{")]
    assert {x.get("category_id") for x in told} == {"k", None} and all(x["case_count"] == 3 and x["unsupported_refusal_accuracy"] == 1.0 and x["llm_relevance_mean"] == 0.5 for x in told)
    assert sorted(r.llm_answer_quality_mean for r in spark.read.json(str(tmp_path / "out")).collect() if r.llm_answer_quality_mean is not None) == [0.0, 0.7]
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 1
