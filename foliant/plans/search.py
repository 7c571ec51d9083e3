"""Similarity search over embeddings: vec_id is the point, label the document, every twentieth row a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.vectors import all_finite, cosine, norm, uuid5
from foliant.operators import ivf, retrieval
from foliant.operators.evaluation import search as measures
from foliant.plans.registry import query, table
from foliant.sources.sinks import upserted

NAMED = {"point_id": "vec_id", "vector": "embedding", "document": "label"}

_PAIRS = """
  e as (select vec_id, label, embedding::double[] v from embeddings),
  q as (select vec_id query_id, label, v from e where vec_id % 20 = 0),
  s as (select query_id, q.label query_label, e.vec_id point_id, e.label document_id, list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) score from q, e)"""
_RANKED = "select query_id, point_id, round(score, 6) score, rank from (select *, row_number() over (partition by query_id order by score desc, point_id) rank from s {where}) where rank <= {k}"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("string")
    other = lambda n: ((F.col("label") + n) % 10).cast("string")
    return _points(spark, sf_dir).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("vector"), F.array(label, other(1)).alias("two"), F.array(label, other(1), other(2)).alias("three"))


def _scored(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "point_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_PAIRS} {_RANKED.format(where='', k=10)}")
def vec_topk(spark, sf_dir):
    return _scored(retrieval.top_k(_points(spark, sf_dir), _queries(spark, sf_dir), 10, **NAMED))


@query(f"with {_PAIRS} {_RANKED.format(where='where document_id in (query_label, (query_label + 1) % 10)', k=8)}")
def vec_topk_filtered(spark, sf_dir):
    return _scored(retrieval.top_k(_points(spark, sf_dir), _queries(spark, sf_dir), 8, documents="two", **NAMED))


@query(f"with {_PAIRS} {_RANKED.format(where='where score >= 0.3', k=20)}")
def vec_topk_threshold(spark, sf_dir):
    return _scored(retrieval.top_k(_points(spark, sf_dir), _queries(spark, sf_dir), 20, threshold=0.3, **NAMED))


@query(f"""with {_PAIRS},
  d as (select *, (document_id - query_label + 10) % 10 place, row_number() over (partition by query_id, document_id order by score desc, point_id) n from s where (document_id - query_label + 10) % 10 < 3),
  t as (select *, row_number() over (partition by query_id order by n, place) rank from d where n <= 11)
  select query_id, point_id, document_id::varchar document_id, round(score, 6) score, rank from t where rank <= 20""")
def vec_topk_balanced(spark, sf_dir):
    hits = retrieval.retrieve(_points(spark, sf_dir), _queries(spark, sf_dir), 20, balance=True, documents="three", **NAMED)
    return hits.select("query_id", "point_id", "document_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_PAIRS} select query_id, round(max(score), 6) top_score, coalesce(max(score) >= 0.45, false) strong from (select q.query_id, s.score from q left join s on q.query_id = s.query_id and s.document_id = (s.query_label + 1) % 10 and s.point_id <> s.query_id) group by query_id")
def strong_gate(spark, sf_dir):
    q = _queries(spark, sf_dir).withColumn("next", F.array(F.get("two", F.lit(1))))
    gate = retrieval.strong_gate(q, retrieval.top_k(_points(spark, sf_dir), q, 1, documents="next", **NAMED))
    return gate.withColumn("top_score", F.round("top_score", 6))


def _cases(spark, sf_dir) -> DataFrame:
    hits = retrieval.top_k(_points(spark, sf_dir), _queries(spark, sf_dir), 10, **NAMED)
    queries, own = _queries(spark, sf_dir).select("query_id", "label"), F.col("document_id") == F.col("label")
    counts = _points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("relevant"))
    told = hits.join(queries, "query_id").withColumn("is_relevant", own)
    return measures.ranked(measures.ranks_among(told, queries.join(counts, "label")))


_RANKS = f"""with {_PAIRS}, h as (select *, row_number() over (partition by query_id order by score desc, point_id) rank from s),
  r as (select q.query_id, (select count(*) from e where e.label = q.label) relevant, coalesce((select list(h.rank order by h.rank) from h where h.query_id = q.query_id and h.rank <= 10 and h.document_id = q.label), []) ranks from q),
  m as (select query_id, relevant, ranks[1] first_relevant_rank,
    {', '.join(f"(len(list_filter(ranks, lambda x: x <= {k})) > 0)::int::double hit_at_{k}, len(list_filter(ranks, lambda x: x <= {k}))::double / relevant recall_at_{k}" for k in (1, 3, 5, 10))},
    coalesce(1.0 / ranks[1], 0)::double mrr_at_10,
    coalesce(list_sum(list_transform(ranks, lambda x: 1 / log2(x + 1))), 0) / list_sum(list_transform(generate_series(1, least(relevant, 10)), lambda x: 1 / log2(x + 1))) ndcg_at_10,
    coalesce(list_sum(list_transform(ranks, lambda x, i: i::double / x)), 0) / relevant average_precision_at_10 from r)"""


@query(f"{_RANKS} select query_id, relevant, first_relevant_rank, {', '.join(f'round({m}_at_{k}, 6) {m}_at_{k}' for k in (1, 3, 5, 10) for m in ('hit', 'recall'))}, round(mrr_at_10, 6) mrr_at_10, round(ndcg_at_10, 6) ndcg_at_10, round(average_precision_at_10, 6) average_precision_at_10 from m")
def rank_metrics(spark, sf_dir):
    c = _cases(spark, sf_dir).drop("ranks")
    return c.select(*(F.round(x, 6).alias(x) if t == "double" else F.col(x) for x, t in c.dtypes))


@query(f"{_RANKS} select count(*) case_count, {', '.join(f'round(avg({m}_at_{k}), 6) {m}_at_{k}' for k in (1, 3, 5, 10) for m in ('hit', 'recall'))}, round(avg(mrr_at_10), 6) mrr_at_10, round(avg(ndcg_at_10), 6) ndcg_at_10, round(avg(average_precision_at_10), 6) map_at_10 from m")
def rank_summary(spark, sf_dir):
    return measures.summary(_cases(spark, sf_dir), timed=False)


@query(f"""with {_PAIRS}, h as (select *, row_number() over (partition by query_id order by score desc, point_id) rank from s),
  x as (select query_id, query_label, list(document_id order by rank) d, list('t' || (document_id % 3) order by rank) t, list(score order by rank) s from h where rank <= 10 group by query_id, query_label)
  select query_id, len(d) result_count, round(s[1], 6) top_score, round((s[1] + s[2] + s[3]) / 3, 6) mean_top3_score, (d[1] in (query_label, (query_label + 1) % 10))::int::double top1_hit,
    round(len(list_filter(d[:5], lambda y: y in (query_label, (query_label + 1) % 10))) / 5.0, 6) purity_at_5,
    {', '.join(f"round((list_contains(d[:{k}], query_label)::int + list_contains(d[:{k}], (query_label + 1) % 10)::int) / 2.0, 6) document_recall_at_{k}" for k in (1, 3, 5, 10))},
    {', '.join(f"round((list_contains(t[:{k}], 't0')::int + list_contains(t[:{k}], 't1')::int) / 2.0, 6) type_coverage_at_{k}" for k in (3, 5, 10))} from x""")
def documents_found(spark, sf_dir):
    hits = retrieval.top_k(_points(spark, sf_dir), _queries(spark, sf_dir), 10, **NAMED).withColumn("chunk_type", F.concat(F.lit("t"), F.col("document_id") % 3))
    cases = _queries(spark, sf_dir).select("query_id", F.col("two").alias("expected_documents"), F.array(F.lit("t0"), F.lit("t1")).alias("expected_types"))
    return measures.documents_found(hits, cases).drop("expected_documents", "expected_types")


@query("select label, count(*) n, round(min(l), 6) norm_min, round(max(l), 6) norm_max, round(avg(l), 6) norm_mean, round(stddev_pop(l), 6) norm_std, count(*) filter (isfinite(l)) finite from (select label, sqrt(list_dot_product(embedding::double[], embedding::double[])) l from embeddings) group by label")
def vec_quality(spark, sf_dir):
    e = _points(spark, sf_dir).withColumn("l", norm("embedding"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.min("l"), 6).alias("norm_min"), F.round(F.max("l"), 6).alias("norm_max"), F.round(F.avg("l"), 6).alias("norm_mean"), F.round(F.stddev_pop("l"), 6).alias("norm_std"), F.count_if(all_finite("embedding")).alias("finite"))


@query("select len(embedding) dimension, count(*) n from embeddings group by 1")
def vec_dimensions(spark, sf_dir):
    return _points(spark, sf_dir).groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))


@query("""select vec_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', (('0x' || h[17:18])::int & 63) | 128) || h[19:20] || '-' || h[21:32] point_id
  from (select vec_id, sha1(unhex('0a59b45a32d749e886588cb05d71a9dc') || encode('chunk_' || vec_id)) h from embeddings)""")
def vec_point_id(spark, sf_dir):
    return _points(spark, sf_dir).select("vec_id", uuid5(F.concat(F.lit("chunk_"), F.col("vec_id"))).alias("point_id"))


@query(f"with {_PAIRS}, x as (select *, row_number() over (partition by query_id order by score desc, point_id) n from s where point_id <> query_id) select query_id, point_id nearest, round(score, 6) score, document_id = query_label same from x where n = 1")
def vec_nearest_other(spark, sf_dir):
    hits = retrieval.top_k(_points(spark, sf_dir), _queries(spark, sf_dir), 2, **NAMED).filter("point_id <> query_id")
    best = hits.groupBy("query_id").agg(F.min_by(F.struct("point_id", "document_id", "score"), "rank").alias("b"))
    labels = _queries(spark, sf_dir).select("query_id", "label")
    return best.join(labels, "query_id").select("query_id", F.col("b.point_id").alias("nearest"), F.round("b.score", 6).alias("score"), (F.col("b.document_id") == F.col("label")).alias("same"))


@query("select vec_id, round(list_dot_product(embedding::double[], v) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(v, v))), 6) score from embeddings, (select embedding::double[] v from embeddings where vec_id = 0)")
def vec_cosine(spark, sf_dir):
    """One query as a constant column: no join of its own, no Python."""
    e = _points(spark, sf_dir)
    first = e.filter("vec_id = 0").select("embedding").first()
    v = F.array(*(F.lit(float(x)) for x in first.embedding))
    return e.select("vec_id", F.round(cosine("embedding", v), 6).alias("score"))


@query("select user_id, event_id, event_type, round(value, 6) value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n = 1")
def upsert_latest(spark, sf_dir):
    """Events as versions of their user's record: even ones are there, odd ones are upserted, the latest stays."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"), F.struct("ts", "event_id").alias("version"))
    merged = upserted(None, upserted(None, e.filter("event_id % 2 = 0"), "user_id", "version").unionByName(upserted(None, e.filter("event_id % 2 = 1"), "user_id", "version")), "user_id", "version")
    return merged.drop("version")


@query("select user_id, count(*) n from events where user_id not in (select user_id from events where event_type = 'purchase' and event_id % 7 = 0) group by user_id")
def resume_anti(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.join(e.filter("event_type = 'purchase' and event_id % 7 = 0").select("user_id").distinct(), "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


@query()
def vec_ivf(spark, sf_dir):
    """Of the exact ten best of each query, how many a search of inverted lists finds; how many lists it reads is told by a sample of the points."""
    points, named = _points(spark, sf_dir), {"point_id": "vec_id", "vector": "embedding"}
    queries = _queries(spark, sf_dir).select("query_id", "vector")
    centroids = ivf.fit(points, 64, "embedding", "vec_id")
    index = ivf.filed(points, centroids, "embedding")
    probes = ivf.calibrated(index, centroids, ivf.sampled(points, "embedding", "vec_id"), **named)
    return ivf.recall(ivf.search(index, centroids, queries, 10, probes, **named), retrieval.top_k(points, queries, 10, **named))
