"""Source divergence: how far the word rates of each (language, source) group are from those of the other groups and of the language.

A group's rate of a term is p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), so most rates are that of count 0, p0. The distance of
two groups a and b over all V terms starts at the baseline V * abs(p0a - p0b), and only terms that one of them has correct it:

* what a term of a adds when b lacks it, abs(pa - p0b) - abs(p0a - p0b), depends on b by one number only, so it is summed over the
  distribution of a's rates by a running sum: a row for each distinct rate and for each other group, none for a term;
* a term that both have corrects that by abs(pa - pb) - abs(pa - p0b) - abs(p0a - pb) + abs(p0a - p0b). These come from the postings
  of the term, groups in tiles of at most TILE, and are summed by pair before anything is shuffled.

Counting runs in Arrow batches with a bounded dictionary; all else is columns. Whole numbers only: a rate is divided as a decimal, and
sums of rates stay below 10**9 + V.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import column, dealt_join, hot_keys, stored

UNIT, PRIOR = 10**9, 5
#: Documents of a language that a kept term is in; ranks of terms; groups of a tile.
LEAST, TERMS, TILE = 30, 50, 256
#: Terms that a task counts before it passes them on.
HELD = 1 << 18

#: Letters in lower case and bytes beyond ASCII as they are, else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, summed by task; term '' with zeros for each group that occurs."""
    given = docs.select(*(F.coalesce(column(c).cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate((text, lang, source))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, dict[bytes, list[int]]] = {}
        held = 0

        def flush():
            for (own_lang, own_source), found in groups.items():
                keys = list(found)
                for at in range(0, len(keys), 1 << 15):
                    part = keys[at : at + (1 << 15)]
                    n, d = zip(*(found[x] for x in part), strict=True)
                    one = lambda x, m=len(part): pa.array([x] * m, pa.string())
                    yield pa.RecordBatch.from_arrays([one(own_lang), one(own_source), pa.array(part, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for said, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = groups.setdefault(tuple(key), {b"": [0, 0]})
                held -= len(found)
                own: dict[bytes, int] = {}
                for w in said.encode().translate(_FOLD).split():
                    own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    x = found.get(w)
                    if x is None:
                        found[w] = [n, 1]
                    else:
                        x[0] += n
                        x[1] += 1
                held += len(found)
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return given.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, most: int = TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group of docs.

    Part pair has each other source of the language with the distance over all kept terms, part term the terms that stand out
    against the language, at most most of them; ranks by value, then by item. Null text, lang and source are ''; empty texts have no
    terms, very long ones and very long words are read whole; repeated rows count each; a group without terms has pairs, and distance
    0 where its language keeps no term. An empty table gives an empty result. Only the three columns are read, so others may have any
    name. Pairs of a language with many sources are dealt by tiles of sources, rows of a large group by their terms.
    """
    counts = terms(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    summed = counts.withColumns({"in_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "nth": F.row_number().over(term.orderBy("source"))})
    kept = stored(summed.filter((F.col("in_docs") >= least) | (F.col("term") == "")).select("lang", "source", "term", "n", "lang_n", "nth"), "terms")

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("m"), F.count_if((F.col("nth") == 1) & (F.col("term") != "")).alias("v"))
    own = stored(own, "groups")
    langs = own.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("v").alias("v"), F.count("*").alias("sources"), F.sum("m").alias("rows"))
    langs = stored(langs, "languages")
    sized = own.drop("v").join(langs, "lang")
    div = lambda count, total: F.expr(f"1L + (cast({count} + {PRIOR} as decimal(20,0)) * {UNIT}BD) div cast({total} + {PRIOR} * v as decimal(20,0))")
    group = F.xxhash64("lang", "source")
    groups = stored(sized.select("lang", "source", "total", "lang_total", "v", "sources", "m", group.alias("g"), F.when(F.col("v") > 0, div("0L", "total")).otherwise(F.lit(0)).alias("p0")), "sizes")

    # rates of the counts that there are, rows of a large group dealt by term
    n = kept.count()
    rows = kept.filter("n > 0 and term <> ''").withColumn("key", F.struct("lang", "source"))
    sizes = groups.select(F.struct("lang", "source").alias("key"), "total", "lang_total", "v", "sources", "p0", "m")
    rated = dealt_join(rows, sizes.drop("m"), "key", hot_keys(sizes, "key", n), "term")
    rated = stored(rated.select("lang", "source", "term", "sources", "p0", div("n", "total").alias("p"), div("lang_n", "lang_total").alias("q")), "rates")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out_of_line = rated.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    top = out_of_line.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= most)

    # pairs of a language: tiles of groups meet, each tile pair once
    pieces = F.greatest(F.lit(1), F.ceil(F.col("sources") / tile)).cast("int")
    placed = groups.withColumn("pieces", pieces).withColumn("own", F.pmod("g", F.col("pieces")).cast("int"))
    left = placed.select("lang", "source", "p0", "v", "own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    right = placed.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("own"))
    pairs = left.join(right, ["lang", "own", "other"]).filter("source <> item").select("lang", "source", "item", "p0", "q0", "v")

    # sum over a's terms of abs(p - x) - abs(p0 - x) for x of each other group
    shares = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    none = F.lit(None)
    events = pairs.select("lang", "source", F.col("q0").alias("at"), F.lit(0).cast("long").alias("k"), "item", "p0", "v").unionByName(
        shares.select("lang", "source", F.col("p").alias("at"), "k", none.cast("string").alias("item"), none.cast("long").alias("p0"), none.cast("long").alias("v")))
    whole = Window.partitionBy("lang", "source")
    upto = whole.orderBy("at")
    weight = F.col("k") * F.col("at")
    events = events.withColumns({"k_to": F.sum("k").over(upto), "s_to": F.sum(weight).over(upto), "k_all": F.sum("k").over(whole), "s_all": F.sum(weight).over(whole)}).filter("item is not null")
    single = events.select("lang", "source", "item", F.expr("at * k_to - s_to + (s_all - s_to) - at * (k_all - k_to) - k_all * abs(p0 - at) + if(source < item, v * abs(p0 - at), 0L)").alias("value"))

    # terms that two groups have, in tiles of the groups
    shared = rated.withColumn("pieces", pieces).withColumn("own", F.pmod(F.xxhash64("lang", "source"), F.col("pieces")).cast("int"))
    shared = shared.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    post = F.struct("source", "p", "p0", "own")
    posts = shared.groupBy("lang", "term", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")).agg(F.collect_list(post).alias("all"))  # at most 2 * tile or so
    posts = posts.filter("size(all) > 1").select("i", "j", "lang", F.explode("all").alias("a"), "all").select("lang", "i", "j", "a", F.explode("all").alias("b"))
    both = posts.filter("a.source < b.source and (i = j or a.own <> b.own)")
    change = F.expr("abs(a.p - b.p) - abs(a.p - b.p0) - abs(a.p0 - b.p) + abs(a.p0 - b.p0)")
    both = both.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), change.alias("value")).filter("value <> 0")

    low = single.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), "value")
    apart = low.union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    apart = apart.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    apart = apart.select("lang", "x.source", "x.item", "value").withColumn("rank", F.row_number().over(by_value))
    made = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return made(apart, "pair").union(made(top, "term"))
