"""Connected components of an edge table by alternating large and small stars; nothing is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import dealt_join, drop_folder, hot_keys, stored

MOST_ROUNDS = 60
#: Links from which a round has one more task, and tasks of a round of few: tables of a few rows in hundreds of partitions cost the driver more than the work does.
LINKS_A_TASK, LEAST_TASKS = 1 << 16, 12


def components(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges (a, b); no rows for none.

    nodes, where it is known, is about how many there are: from it comes the number of tasks that hold the edges at first.

    Large star: each node links its larger neighbours to its least one. Small star: each node links
    itself and its smaller neighbours to the least. Both make at most a row for each link, also at a
    node that a third of all links have. Its rows are dealt to several tasks. Ends when a round changes nothing; the rounds grow
    with the logarithm of the longest path, and after MOST_ROUNDS an error is raised, so that no result lacks a link.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links = checkpointed(links if nodes is None else links.coalesce(LEAST_TASKS + nodes // LINKS_A_TASK))
    seen = _state(links)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        before, few = links, LEAST_TASKS + seen[0] // LINKS_A_TASK  # no more rows are in any table of the round than twice the links; coalesce only lowers a number
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # each of these is read several times: as one plan it is repeated in it some twenty times, which the driver holds and explains anew at each step
        near = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count("*").alias("m")).coalesce(few))
        large = _joined(both, near, 2 * seen[0]).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).coalesce(few)
        large = checkpointed(large.distinct().coalesce(few))
        down = checkpointed(large.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("m")).coalesce(few))
        small = _joined(large, down, seen[0]).filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).coalesce(few)
        links = checkpointed(small.union(down.select("a", F.col("least").alias("b"))).distinct().coalesce(few))
        now = _state(links)
        _drop(before, near, large, down)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not complete after {MOST_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written and read again as a table of as many bytes as its files have.

    A checkpoint keeps the bytes that its plan estimates, for a join the product of both sides'. From round to round that number
    has 16 times the digits, and after some rounds the driver's plans multiply and hold numbers of megabytes each.
    """
    return stored(df, "components")


def _drop(*tables: DataFrame) -> None:
    """Deletes the files of tables of a round that is done."""
    for t in tables:
        for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
            drop_folder(t.sparkSession, path)


def _joined(links: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """links (a, b), about n, with the least of a."""
    return dealt_join(links, least.select("a", "least"), "a", hot_keys(least, "a", n), "b")


def _state(links: DataFrame) -> tuple:
    """Equal after a round only if the links are."""
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
