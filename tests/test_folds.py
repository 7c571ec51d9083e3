"""Edit distance of any length and titles with a bounded state, against plain loops."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.functions import edits
from foliant.operators.evaluation import artifacts
from foliant.operators.titles import last_titles


def slow(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_distance():
    rnd = random.Random(1)
    for _ in range(1500):
        a, b = ([rnd.choice("abcde"[: rnd.choice([2, 5])]) for _ in range(rnd.randrange(40))] for _ in range(2))
        if rnd.random() < 0.5:
            b = [x for x in a if rnd.random() > 0.1]
        want = slow(a, b)
        assert edits.distance(a, b) == want
        if a and b:
            assert edits.by_bits(a, b) == edits.by_diagonals(a, b, 99) == want
            assert edits.by_diagonals(a, b, want - 1) is None


def test_distance_of_long_readings():
    rnd = random.Random(2)
    a = [str(rnd.randrange(5000)) for _ in range(200_000)]
    b = list(a)
    for _ in range(2000):
        i, kind = rnd.randrange(len(b)), rnd.random()
        if kind < 0.4:
            b[i] = "x"
        elif kind < 0.7:
            del b[i]
        else:
            b.insert(i, "y")
    begun = time.process_time()
    assert 1800 < edits.distance(a, b) <= 2000 and time.process_time() - begun < 20


def test_word_errors_of_long_pages(spark, monkeypatch):
    rnd = random.Random(3)
    pages = [(k % 3, " ".join(rnd.choices("abcd", k=rnd.randrange(60))), " ".join(rnd.choices("abcd", k=rnd.randrange(60)))) for k in range(30)] + [(1, "", "a b"), (2, None, None), (2, "a", "")]
    df = spark.createDataFrame(pages, "d int, reference string, hypothesis string")
    want = sorted(artifacts.word_errors(df, ["d"]).collect())
    monkeypatch.setattr(artifacts, "CELLS", 50)
    assert sorted(artifacts.word_errors(df, ["d"]).collect()) == want


@pytest.mark.parametrize(("seed", "groups", "ranges", "n"), [(1, 1, 9, 3), (2, 30, 5, 3), (3, 3, 12, 1), (4, 2, 1, 4)])
def test_last_titles(spark, seed, groups, ranges, n):
    rnd = random.Random(seed)
    place, rows = defaultdict(int), []
    for _ in range(500):
        g = rnd.choice([None, *range(groups)]) if groups > 2 else rnd.randrange(groups)
        place[g] += 1
        rows.append((g, place[g], rnd.choice([None, "a", "b", "c", "d", "e"])))
    want, seen = [], defaultdict(list)
    for g, i, t in rows:
        if t is not None:
            seen[g] = [*(x for x in seen[g] if x != t), t]
        want.append((g, i, tuple(seen[g][-n:])))
    df = spark.createDataFrame(rows, "g int, i int, t string").repartition(4)
    got = last_titles(df, "g", ["i"], F.col("t"), n, ranges=ranges)
    assert sorted(((r.g, r.i, tuple(r.titles)) for r in got.collect()), key=str) == sorted(want, key=str)
    assert last_titles(df.limit(0), "g", ["i"], F.col("t"), n).collect() == []


def test_titles_of_one_long_conversation(spark):
    """A million turns of one conversation: linear, and no task has them all."""
    turns = spark.range(1_000_000).select(F.lit(1).alias("conv"), "id", (F.col("id") % 7).cast("string").alias("t"))
    got = last_titles(turns, "conv", ["id"], F.col("t"), ranges=8)
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 400_000
    assert got.filter("id = 999999").first().titles == [str(k % 7) for k in (999_997, 999_998, 999_999)]
