"""Greedy packing by ranges against a plain loop."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.operators import packing
from foliant.sources import providers


def packed(rows, most_rows, most_size):
    """rows: group, order, size, in order."""
    out, open_ = [], {}
    for g, i, n in rows:
        batch, held, size = open_.get(g, (-1, 0, 0))
        if batch < 0 or held >= most_rows or size + n > most_size:
            batch, held, size = batch + 1, 0, 0
        open_[g] = (batch, held + 1, size + n)
        out.append((g, i, batch))
    return out


@pytest.mark.parametrize(("seed", "groups", "most_rows", "most_size", "ranges"), [(1, 1, 5, 30, 7), (2, 6, 3, 12, 5), (3, 40, 16, 50, 9), (4, 2, 1, 10, 4), (5, 1, 64, 10**9, 8), (6, 3, 50, 20, 30), (7, 1, 9, 1, 6)])
def test_greedy(spark, seed, groups, most_rows, most_size, ranges):
    rnd = random.Random(seed)
    place = defaultdict(int)
    rows = []
    for _ in range(400):
        g = rnd.choice([None, *range(groups)]) if groups > 2 else rnd.randrange(groups)
        place[g] += 1
        rows.append((g, place[g], rnd.choice([0, 0, 1, 3, 7, 20, 60])))
    df = spark.createDataFrame(rows, "g int, i int, n int").withColumn("batch_id", F.lit("mine")).repartition(6)
    got = packing.greedy(df, "g", ["i"], F.col("n"), most_rows, most_size, ranges=ranges)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 2
    assert sorted((tuple(r[c] for c in ("g", "i", "batch_id")) for r in got.collect()), key=str) == sorted(packed(rows, most_rows, most_size), key=str)


def test_greedy_edges(spark):
    none = spark.createDataFrame([], "g int, i int, n int")
    assert packing.greedy(none, "g", ["i"], F.col("n"), 4, 10).collect() == []
    one = spark.createDataFrame([(1, 1, None), (1, 1, None), (None, None, 99)], "g int, i int, n int")
    assert sorted((r.g is None, r.batch_id) for r in packing.greedy(one, "g", ["i"], F.col("n"), 1, 10).collect()) == [(False, 0), (False, 1), (True, 0)]
    with pytest.raises(ValueError):
        packing.greedy(one, "g", ["i"], F.col("n"), 0, 10)


def test_batches_of_one_large_document(spark):
    rnd = random.Random(9)
    rows = [("d", i, "x" * rnd.randrange(40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "d string, i int, text string").repartition(5)
    got = providers.batch_ids(df, "d", "i", most_rows=16, chars=300, ranges=12)
    sizes = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert sizes < 1000  # no task has the document
    assert sorted((r.d, r.i, r.batch_id) for r in got.collect()) == sorted(packed([(d, i, len(t)) for d, i, t in rows], 16, 300))
