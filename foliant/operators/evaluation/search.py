"""Retrieval measures: ranks of what is relevant, documents and kinds that are found, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.rates import mean_or_zero, share

KS = (1, 3, 5, 10)


def relevant_ranks(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, relevant (how many), ranks (rising) for each query of truth (query_id, point_id)."""
    truth = truth.distinct()
    met = truth.join(hits.select("query_id", "point_id", "rank"), ["query_id", "point_id"], "left")
    return met.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sort_array(F.collect_list("rank")).alias("ranks"))


def ranks_among(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, relevant, ranks as relevant_ranks() gives them, for relevant points that are many: relevant has query_id and how many (relevant), hits (few a query) whether one is (is_relevant)."""
    met = hits.filter("is_relevant").groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    return relevant.select("query_id", "relevant").join(met, "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.expr("cast(array() as array<int>)")))


def _upto(k: int) -> Column:
    return F.filter("ranks", lambda r: r <= k)


def ranked(cases: DataFrame, ks=KS, k: int = 10) -> DataFrame:
    """cases (ranks rising, relevant) with first_relevant_rank, hit_at_k, recall_at_k, mrr, ndcg and average precision at k.

    Nothing relevant gives 0.
    """
    own = _upto(k)
    gain = F.aggregate(own, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    most = F.least(F.col("relevant"), F.lit(k)).cast("int")
    ideal = F.when(most > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))).otherwise(F.lit(0.0))
    precision = F.aggregate(F.transform(own, lambda r, i: (i + 1) / r), F.lit(0.0), lambda a, x: a + x)
    out = cases.withColumn("first_relevant_rank", F.get("ranks", F.lit(0)))
    out = out.withColumns({f"hit_at_{n}": F.when(F.size(_upto(n)) > 0, 1.0).otherwise(0.0) for n in ks} | {f"recall_at_{n}": share(F.size(_upto(n)), F.col("relevant")) for n in ks})
    return out.withColumns({f"mrr_at_{k}": F.coalesce(1 / F.get(own, F.lit(0)), F.lit(0.0)), f"ndcg_at_{k}": F.coalesce(F.try_divide(gain, ideal), F.lit(0.0)), f"average_precision_at_{k}": share(precision, F.col("relevant"))})


def latency(x: str = "latency_seconds") -> list[Column]:
    return [mean_or_zero(F.col(x), 3).alias("mean_latency_seconds"), F.round(F.coalesce(F.percentile(x, 0.95), F.lit(0.0)), 3).alias("p95_latency_seconds")]


def summary(cases: DataFrame, by: list[str] | None = None, ks=KS, k: int = 10, timed: bool = True) -> DataFrame:
    """Means over cases."""
    names = [f"{m}_at_{n}" for n in ks for m in ("hit", "recall")] + [f"mrr_at_{k}", f"ndcg_at_{k}"]
    made = [mean_or_zero(F.col(n)).alias(n) for n in names] + [mean_or_zero(F.col(f"average_precision_at_{k}")).alias(f"map_at_{k}")]
    return cases.groupBy(*(by or [])).agg(F.count("*").alias("case_count"), *(latency() if timed else []), *made)


def documents_found(hits: DataFrame, cases: DataFrame, ks=KS, kind_ks=(3, 5, 10)) -> DataFrame:
    """Of each case (query_id, expected_documents, expected_types): result_count, top_score, mean_top3_score, top1_hit, purity_at_5, document_recall_at_k, type_coverage_at_k (null without expected types)."""
    x = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.coalesce(F.col("document_id").cast("string"), F.lit("")).alias("d"), F.coalesce("chunk_type", F.lit("")).alias("c"), "score"))).alias("h"))
    none = F.expr("cast(array() as array<struct<rank:int,d:string,c:string,score:double>>)")
    c = cases.join(x, "query_id", "left").withColumn("h", F.coalesce("h", none))
    for name in ("expected_documents", "expected_types"):
        c = c.withColumn(name, F.coalesce(name, F.expr("cast(array() as array<string>)")))
    filled = lambda col, k: F.filter(F.slice(col, 1, k), lambda v: v != "")
    docs, kinds, scores = F.col("h.d"), F.col("h.c"), F.col("h.score")
    expected = F.col("expected_documents")
    found = lambda want, have: F.size(F.filter(want, lambda e: F.array_contains(have, e)))
    five = filled(docs, 5)
    made = {
        "result_count": F.size("h"), "top_score": F.round(F.get(scores, F.lit(0)), 6),
        "mean_top3_score": F.round(share(F.aggregate(F.slice(scores, 1, 3), F.lit(0.0), lambda a, s: a + s), F.size(F.slice(scores, 1, 3))), 6),
        "top1_hit": F.when(F.array_contains(expected, F.get(docs, F.lit(0))), 1.0).otherwise(0.0),
        "purity_at_5": F.round(share(F.size(F.filter(five, lambda d: F.array_contains(expected, d))), F.size(five)), 6),
    }
    made |= {f"document_recall_at_{k}": F.round(share(found(expected, filled(docs, k)), F.size(expected)), 6) for k in ks}
    made |= {f"type_coverage_at_{k}": F.when(F.size("expected_types") > 0, F.round(share(found(F.col("expected_types"), filled(kinds, k)), F.size("expected_types")), 6)) for k in kind_ks}
    return c.withColumns(made).drop("h")


def stress_summary(cases: DataFrame, ks=KS, kind_ks=(3, 5, 10)) -> DataFrame:
    """Means by category and, in the row without one, over all."""
    means = ["top_score", "top1_hit", "purity_at_5", *(f"document_recall_at_{k}" for k in ks)]
    made = [mean_or_zero(F.col(n)).alias(f"mean_{n}") for n in means] + [F.round(F.avg(f"type_coverage_at_{k}"), 6).alias(f"mean_type_coverage_at_{k}") for k in kind_ks]
    sets = [["category_id", "category_name"], []]
    return cases.groupingSets([tuple(map(F.col, s)) for s in sets], "category_id", "category_name").agg(F.count("*").alias("case_count"), *latency(), *made)


def snippet_ranks(hits: DataFrame, cases: DataFrame, ks=(1, 3, 5, 10, 20)) -> DataFrame:
    """Of each case (query_id, groups: array of arrays of snippets): group_ranks, expected_rank (the worst, null unless all are found) and hit_at_k."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))
    groups = cases.select("query_id", F.posexplode("groups").alias("g", "snippets")).withColumn("snippets", F.transform("snippets", norm))
    met = groups.join(hits.select("query_id", "rank", norm(F.col("text")).alias("t")), "query_id", "left")
    rank = met.groupBy("query_id", "g").agg(F.min(F.when(F.forall("snippets", lambda s: F.contains(F.col("t"), s)), F.col("rank"))).alias("r"))
    out = rank.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "r"))), lambda x: x["r"]).alias("group_ranks"), F.when(F.count("r") == F.count("*"), F.max("r")).alias("expected_rank"))
    return out.withColumns({f"hit_at_{k}": F.coalesce(F.col("expected_rank") <= k, F.lit(False)) for k in ks})


def snippet_summary(cases: DataFrame, ks=(1, 3, 5, 10, 20)) -> DataFrame:
    """Over cases with latency_seconds: mean and greatest latency, hit rates, ids of what was missed."""
    rates = [(F.count_if(F.col(f"hit_at_{k}")) / F.count("*")).alias(f"hit_at_{k}_rate") for k in ks]
    missed = F.sort_array(F.collect_list(F.when(F.col("expected_rank").isNull(), F.col("query_id")))).alias("missed")
    return cases.agg(F.count("*").alias("case_count"), mean_or_zero(F.col("latency_seconds"), 3).alias("mean_latency_seconds"), F.max("latency_seconds").alias("max_latency_seconds"), *rates, missed)
