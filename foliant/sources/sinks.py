"""Sinks: JSON and JSON lines, tables of which the last whole version counts, and a keyed table of points.

What is committed, and when, is left to Spark's own writers: a version is there once its writer has left its mark of success, and
the documents of an upsert are replaced by one dynamic partition overwrite, whose files stand aside until the whole job is done.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.vectors import uuid5
from foliant.session import checkpointed


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, over what was there."""
    df.write.mode("overwrite").json(path)


def write_documents(df: DataFrame, path: str, name: str) -> None:
    """A folder for each value of column name, with the other columns of its row as indented JSON in UTF-8, over what was there."""
    rest = [c for c in df.columns if c != name]
    said = df.select(name, F.to_json(F.struct(*rest), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    said.write.mode("overwrite").partitionBy(name).text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are none."""
    return spark.read.schema(schema).json(path)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the versions that are whole, the oldest first."""
    fs, p, make = _files(spark, path)
    found = fs.globStatus(make(f"{p}/version=*/_SUCCESS")) or []
    return sorted((x.getPath().getParent().toString() for x in found), key=lambda x: x.rsplit("version=", 1)[1])


def replace_table(df: DataFrame, path: str, keep: int = 2) -> None:
    """Writes a version of the table at path, which counts for read_table() from the moment that Spark's writer marks it as whole.

    df may read the table itself. A writer that dies leaves what was there, and of two writers the one that began last counts. Versions before
    the last keep are deleted, so a reader may go on with the one before; what dead writers left unmarked goes with those that began later.
    """
    spark = df.sparkSession
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/version={name}")
    fs, p, make = _files(spark, path)
    whole = _versions(spark, path)
    first = whole[-keep:][0].rsplit("version=", 1)[1]
    for x in fs.listStatus(p):
        if "version=" in x.getPath().getName() and x.getPath().getName().removeprefix("version=") < first:
            fs.delete(x.getPath(), True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version of a table; FileNotFoundError if there is none."""
    whole = _versions(spark, path)
    if not whole:
        raise FileNotFoundError(path)
    return spark.read.parquet(whole[-1])


def points(records: DataFrame) -> DataFrame:
    """Embedding records (id, vector, payload columns) with point_id, the name-based id of their chunk."""
    return records.withColumn("point_id", uuid5("id"))


def upserted(existing: DataFrame | None, records: DataFrame, key: str = "point_id", version: str | None = None) -> DataFrame:
    """One row a key: of records and existing the last written, of records with one key that of the greatest version."""
    new = records.withColumn("_at", F.lit(1))
    both = new if existing is None else existing.withColumn("_at", F.lit(0)).unionByName(new, allowMissingColumns=True)
    order = [F.desc("_at"), *([F.desc(version)] if version else []), *(F.col(c) for c in both.columns if c not in (key, "_at", version) and not both.schema[c].dataType.simpleString().startswith("map"))]
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n", "_at")


class PointStore:
    """A table of points on a shared path: a folder for each document, in which rows are in order of kind and chunk, with Bloom filters of kinds and ids.

    So a filter of documents prunes folders, one of kinds row groups by their ranges and filters, and a look for ids most of them. Where an upsert leaves a document
    without points, its folder holds one row without an id, which read() leaves out.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int, document: str = "document_id", sort: str = "chunk_index", kind: str = "chunk_type", document_type: str = "string"):
        self.spark, self.path, self.dimension, self.document, self.sort, self.kind, self.document_type = spark, path, dimension, document, sort, kind, document_type

    def exists(self) -> bool:
        fs, p, _ = _files(self.spark, self.path)
        return fs.exists(p)

    def drop(self) -> None:
        fs, p, _ = _files(self.spark, self.path)
        fs.delete(p, True)

    def _rows(self) -> DataFrame:
        """All rows. Names of folders are read as what they were, not as the numbers that they may look like."""
        found = self.spark.read.parquet(self.path).schema
        own = ", ".join(f"`{f.name}` {self.document_type if f.name == self.document else f.dataType.simpleString()}" for f in found.fields)
        return self.spark.read.schema(own).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().filter("point_id is not null")

    def upsert(self, records: DataFrame, version: str | None = None, recreate: bool = False) -> dict:
        """Writes records (with point_id and vector); how many there are now, and whether that is what was expected.

        Records are made once, since their vectors may come from a service. Only the documents that they are of, or that
        had one of their points, are written anew, so the cost is that of these documents, all in one job: if it fails,
        the store is as it was. A store whose vectors have another dimension is refused. One writer at a time.
        """
        records = checkpointed(records)
        bad = records.filter(F.coalesce(F.size("vector"), F.lit(-1)) != F.lit(self.dimension)).count()
        if bad:
            raise ValueError(f"{bad} vectors are not of dimension {self.dimension}")
        nameless = records.filter("point_id is null").count()
        if nameless:
            raise ValueError(f"{nameless} records have no point_id")
        fresh = recreate or not self.exists()
        ids, here, old = records.select("point_id").distinct(), records.select(self.document), None
        if not fresh:
            other = self.read().select(F.size("vector").alias("n")).filter(F.col("n") != self.dimension).first()
            if other:
                raise ValueError(f"the store has vectors of dimension {other.n}, not {self.dimension}")
            had = self.read().select("point_id", self.document).join(ids, "point_id", "left_semi").select(self.document)
            here = here.union(had)
            old = self.read().join(here.distinct().withColumnRenamed(self.document, "_d"), F.col(self.document).eqNullSafe(F.col("_d")), "left_semi")
        here = checkpointed(here.distinct())
        new = checkpointed(upserted(old, records, version=version))
        if not fresh:
            left = here.withColumnRenamed(self.document, "_d").join(new.select(self.document).distinct(), F.col("_d").eqNullSafe(F.col(self.document)), "left_anti")
            new = new.unionByName(left.select(F.col("_d").alias(self.document)), allowMissingColumns=True)
        # a large document goes to several files, small ones share a task
        order = [c for c in (self.document, self.kind, self.sort) if c in new.columns]
        writer = new.hint("rebalance", self.document).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "static" if fresh else "dynamic")
        for c in {self.kind, "point_id"} & set(new.columns):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.partitionBy(self.document).parquet(self.path)
        self.spark.catalog.refreshByPath(self.path)
        written, upserted_ = self.read(), ids.count()
        return {"points": written.count(), "upserted": upserted_, "matches": ids.join(written, "point_id", "left_semi").count() == upserted_}

    def summary(self, records: DataFrame) -> DataFrame:
        """Of each document of records and of all together (document null): sent, stored (distinct points, of them in the store) and matches."""
        there = self.read().select("point_id", F.lit(True).alias("_there"))
        sent = records.select(self.document, "point_id").distinct().join(there, "point_id", "left")
        counts = sent.rollup(self.document).agg(F.grouping(self.document).alias("_all"), F.count("*").alias("sent"), F.count("_there").alias("stored"))
        return counts.select(F.col(self.document).alias("document"), (F.col("_all") == 1).alias("total"), "sent", "stored", (F.col("sent") == F.col("stored")).alias("matches"))

    def count(self) -> int:
        return self.read().count()
