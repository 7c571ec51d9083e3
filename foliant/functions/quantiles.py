"""Exact percentiles of groups of any size, without all values of a group in one buffer.

A sketch of each group (mergeable, of bounded size) gives a bracket that the wanted rank lies in, as its error is bounded. A second
pass counts what is below each bracket and the distinct values within, a few thousandths of the rows; these are put in order and the ranks read off.
A bracket that the counts prove wrong is opened and counted again, so the result is exact whatever the sketch says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.skew import dealt_join, hot_keys
from foliant.session import checkpointed

#: A sketch is off by no more than the so manyth part of its rows; brackets are twice as wide on either side.
ACCURACY = 10_000


def percentiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """by and, of each group, the percentiles named in wanted, interpolated between the two nearest values at (n - 1) * p.

    Nulls don't count, and a group without other values has null; NaN is the greatest value. Null is a group of its own. Two passes over
    the rows; a hot group is dealt to several tasks.
    """
    own = rows.select(F.struct(*by).alias("key") if by else F.struct(F.lit(1).alias("one")).alias("key"), F.col(value).cast("double").alias("v"))
    margin, names = 2 / accuracy, list(wanted)
    edges = [x for p in wanted.values() for x in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = checkpointed(own.groupBy("key").agg(F.count("v").alias("n"), F.count("*").alias("m"), F.percentile_approx("v", edges, accuracy).alias("e")))
    at = [F.lit(p) * (F.col("n") - 1) for p in wanted.values()]
    bracket = [
        F.struct(
            F.lit(i).alias("i"), F.floor(x).alias("low"), F.ceil(x).alias("high"), (x - F.floor(x)).alias("part"),
            F.when(F.lit(p - margin > 0), F.get("e", F.lit(2 * i))).alias("from"), F.when(F.lit(p + margin < 1), F.get("e", F.lit(2 * i + 1))).alias("to"),
        )
        for i, (x, p) in enumerate(zip(at, wanted.values(), strict=True))
    ]
    brackets = sketch.select("key", "n", "m", F.array(*bracket).alias("b"))
    found = checkpointed(_counted(own, brackets))
    wrong = found.filter("not right").select("key").distinct()
    if not wrong.isEmpty():
        opened = F.transform("b", lambda b: b.withField("from", F.lit(None).cast("double")).withField("to", F.lit(None).cast("double")))
        found = found.join(wrong, "key", "left_anti").unionByName(_counted(own, brackets.join(wrong, "key", "left_semi").withColumn("b", opened)))
    wide = found.groupBy("key").agg(*(F.max(F.when(F.col("i") == i, F.col("value"))).alias(name) for i, name in enumerate(names)))
    out = sketch.select("key").join(wide, "key", "left")
    return out.select(*(F.col("key").getField(c).alias(c) for c in by), *names)


def _counted(own: DataFrame, brackets: DataFrame) -> DataFrame:
    """key, i, value and right of each bracket: the percentile, and whether the ranks lie within."""
    n = brackets.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    met = dealt_join(own.filter("v is not null"), brackets.filter("n > 0").select("key", "b"), "key", hot_keys(brackets, "key", n), "v")
    met = met.select("key", "v", F.explode("b").alias("b")).filter("b.to is null or v <= b.to")
    inside = F.when(F.col("b.from").isNull() | (F.col("v") >= F.col("b.from")), F.col("v"))
    counts = met.groupBy("key", "b", inside.alias("v")).agg(F.count("*").alias("c"))  # null: what is below
    upto = Window.partitionBy("key", "b").orderBy(F.asc_nulls_first("v"))
    counts = counts.withColumn("upto", F.sum("c").over(upto))
    first = lambda rank: F.min(F.when(F.col("v").isNotNull() & (F.col("upto") > F.col(f"b.{rank}")), F.col("v")))
    read = counts.groupBy("key", "b").agg(first("low").alias("a"), first("high").alias("z"), F.max("upto").alias("seen"), F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("below"))
    right = (F.col("below") <= F.col("b.low")) & (F.col("seen") > F.col("b.high"))
    value = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(F.col("a") * (1 - F.col("b.part")) + F.col("z") * F.col("b.part"))
    return read.select("key", F.col("b.i").alias("i"), value.alias("value"), right.alias("right"))


def number_summary(rows: DataFrame, by: list[str], value: str, name: str, digits: int = 6) -> DataFrame:
    """by and count, min, p50, p90, max and mean of value, their names beginning with name; percentiles are exact and rounded."""
    plain = rows.groupBy(*by).agg(F.count(value).alias(f"{name}_count"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max"), F.round(F.avg(value), digits).alias(f"{name}_mean"))
    found = percentiles(rows, by, value, {f"{name}_p50": 0.5, f"{name}_p90": 0.9})
    found = found.select(*by, *(F.round(f"{name}_p{p}", digits).alias(f"{name}_p{p}") for p in (50, 90)))
    both = plain.alias("a").join(found.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]) if by else plain.alias("a").join(found.alias("b"), F.lit(True))  # one row each
    return both.select(*(F.col(f"a.{c}").alias(c) for c in by), *(f"{name}_{x}" for x in ("count", "min", "p50", "p90", "max", "mean")))
