"""Search by inverted lists: points are filed under the nearest of some centroids, and a query reads the lists nearest to it.

Centroids are fitted on a bounded sample (spherical k-means, a parameter each for its rows, lists and rounds); every point is filed.
The lists are the folders of a table, so a block of queries scans those that one of them probes, and what is read is scored
exactly. With all lists probed the result is that of the exact search; with fewer, points in other lists are missed: calibrated() says how many
lists find what part, and recall() how many points a search found. Where points have no clusters, that is most of the lists, and the exact search is the better one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from foliant.operators.retrieval import matrix, top_k

#: Rows of the sample, lists, rounds of k-means, lists that a query reads, rows of a file of a list.
SAMPLE, LISTS, ROUNDS, PROBES, FILE_ROWS = 50_000, 256, 12, 16, 1 << 20
#: The part of the exact result that a calibrated number of probes finds in its sample.
RECALL = 0.97


def fit(points: DataFrame, lists: int = LISTS, vector: str = "vector", key: str = "point_id", sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of at most lists rows, from the sample rows whose keys have the least hashes; no rows without points.

    Vectors of another length than most (the least of equals) and those without a length don't count. The first centroids are the
    first distinct rows of the sample.
    """
    own = points.select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(F.col(key).cast("string")).alias("h")).filter("v is not null")
    rows = own.orderBy("h", F.xxhash64("v")).limit(sample).select("v").toArrow().column("v").combine_chunks()
    if not len(rows):
        return np.zeros((0, 0))
    sizes = rows.value_lengths().to_numpy()
    x = matrix(rows, int(np.bincount(sizes).argmax()))
    x = x[x.any(1)]
    c = x[np.sort(np.unique(x, axis=0, return_index=True)[1])[:lists]]
    for _ in range(rounds):
        of = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(x, 1 + len(x) // 4096)]) if len(x) else np.zeros(0, int)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        length = np.sqrt((total * total).sum(1, keepdims=True))
        new = np.where(length > 0, total / np.maximum(length, 1e-300), c)
        if np.allclose(new, c):
            break
        c = new
    return c


def filed(points: DataFrame, centroids: np.ndarray, vector: str = "vector") -> DataFrame:
    """points with list_id: the nearest centroid, the first of equals; -1 for what has no length or another dimension."""
    sent = points.sparkSession.sparkContext.broadcast(centroids)  # a bounded number of vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part.column(part.schema.names.index(vector)), c.shape[1])
                own = (x @ c.T).argmax(1) if len(c) else np.zeros(len(x), int)
                own[~x.any(1)] = -1
                yield part.append_column("list_id", pa.array(own, pa.int32()))

    return points.mapInArrow(run, StructType([*points.schema.fields, StructField("list_id", IntegerType())]))


def write(points: DataFrame, centroids: np.ndarray, path: str, vector: str = "vector") -> None:
    """The index: a folder for each list and one table of centroids beside it. A large list goes to several tasks."""
    spark = points.sparkSession
    filed(points, centroids, vector).hint("rebalance", "list_id").write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("list_id").parquet(f"{path}/lists")
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centroids)], "list_id int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()  # a bounded number of vectors
    return spark.read.parquet(f"{path}/lists"), np.array([r.centroid for r in rows])


def probed(queries: DataFrame, centroids: np.ndarray, probes: int = PROBES) -> DataFrame:
    """queries with lists: the probes lists whose centroids are nearest."""
    sent = queries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            x = matrix(batch.column(batch.schema.names.index("vector")), c.shape[1])
            best = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
            yield batch.append_column("lists", pa.array([[str(j) for j in row] for row in best.tolist()], pa.list_(pa.string())))

    return queries.mapInArrow(run, StructType([*queries.schema.fields, StructField("lists", ArrayType(StringType()))]))


def search(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, probes: int = PROBES, **named) -> DataFrame:
    """query_id, point_id, list_id, score, rank: the best points of the probed lists by exact cosine; named as in top_k.

    An index without centroids has no points that could be found. A filter of kinds (chunk_type, chunk_types) goes on top.
    """
    if not len(centroids):
        centroids = np.zeros((1, 1))
    hits = top_k(index, probed(queries, centroids, probes), k, document="list_id", documents="lists", **named)
    return hits.withColumnRenamed("document_id", "list_id")


def calibrated(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, target: float = RECALL, **named) -> int:
    """The least number of probes with which a sample of queries (query_id, vector) finds the part target of its exact k best points.

    It is read off one exact search: from the place of each best point's list among those nearest to its query.
    """
    exact = top_k(index, queries, k, document="list_id", **named).select("query_id", F.col("document_id").cast("string").alias("list"))
    order = probed(queries, centroids, max(1, len(centroids))).select("query_id", F.posexplode("lists").alias("place", "list"))
    met = exact.join(order, ["query_id", "list"]).groupBy("place").count().collect()  # a row a list
    wanted, seen = target * sum(r["count"] for r in met), 0
    for r in sorted(met):
        seen += r["count"]
        if seen >= wanted:
            return r.place + 1
    return max(1, len(centroids))


def sampled(points: DataFrame, vector: str = "vector", key: str = "point_id", rows: int = 200) -> DataFrame:
    """query_id, vector: at most rows points with vectors, those whose keys have the least hashes."""
    own = points.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("vector")).filter("size(vector) > 0")
    return own.orderBy(F.xxhash64(F.col("query_id").cast("string")), "query_id").limit(rows)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted, found and recall: how many of the exact search's points an index found."""
    had = found.select("query_id", "point_id", F.lit(1).alias("_had")).distinct()
    rows = exact.select("query_id", "point_id").join(had, ["query_id", "point_id"], "left")
    counts = rows.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("_had").alias("found"))
    return counts.withColumn("recall", F.col("found") / F.col("wanted"))
