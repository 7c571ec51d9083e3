"""Exact percentiles against Spark's own, which hold a group in a buffer."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import quantiles

WANTED = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p90": 0.9, "p999": 0.999, "p100": 1.0}


@pytest.mark.parametrize(("accuracy", "spread"), [(10_000, "even"), (100, "even"), (100, "tail"), (20, "ties"), (50, "tail")])
def test_percentiles(spark, accuracy, spread):
    rnd = random.Random(accuracy)
    one = {"even": lambda: rnd.random(), "tail": lambda: 10 ** rnd.uniform(-200, 200) * rnd.choice([-1, 1]), "ties": lambda: float(rnd.randrange(4))}[spread]
    group = lambda: rnd.choice(["hot", "hot", "hot", "a", "b", None])
    rows = [(group(), i % 2, one() if rnd.random() > 0.02 else None) for i in range(6000)] + [("none", 0, None), ("single", 1, 7.0), ("nan", 0, float("nan")), ("nan", 0, 1.0), ("nan", 0, 2.0)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(5)
    for by in (["g", "h"], ["g"], []):
        got = quantiles.percentiles(df, by, "v", WANTED, accuracy)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan
        want = df.groupBy(*by).agg(*(F.percentile("v", p).alias(n) for n, p in WANTED.items()))
        key = lambda r: str([r[c] for c in by])  # noqa: B023, E731
        a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert [str(x[c]) for c in by] == [str(y[c]) for c in by]
            for n in WANTED:
                assert x[n] == pytest.approx(y[n], rel=1e-9, nan_ok=True) if y[n] is not None else x[n] is None, (by, n, x, y)


def test_wrong_brackets_are_opened(spark, monkeypatch):
    """A sketch that is off by more than it says costs a pass and no row."""
    df = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    real = F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda v, p, accuracy: F.transform(real(v, p, accuracy), lambda x: x + 300))
    r = quantiles.percentiles(df, ["g"], "v", {"p50": 0.5, "p90": 0.9}).first()
    assert (r.p50, r.p90) == pytest.approx((499.5, 899.1))


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.percentiles(df, ["g"], "v", {"p": 0.5}).collect() == []
