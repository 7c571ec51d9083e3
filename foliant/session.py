"""Sessions, and the package on their executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch. Spark's own 64 MB are held several times over on either side of a Python worker.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 67_108_864, "16m")
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once an application, so that they need no copy of their own; lowers Spark's default size of Arrow batches."""
    sc = spark.sparkContext
    key, default, ours = BATCH
    if spark.conf.get(key) in (f"{default}b", str(default), "64m", "64MB"):
        spark.conf.set(key, ours)
    if sc.applicationId not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        made = os.path.join(_folder("foliant"), "foliant_package.zip")
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for at, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(at, name)
                        z.write(path, os.path.join("foliant", os.path.relpath(path, top)))
        sc.addPyFile(made)
        _shipped.add(sc.applicationId)
    return spark


def _folder(prefix: str) -> str:
    """A folder of this machine that is deleted when the program ends: for the package, and for checkpoints of a local session."""
    made = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def _checkpoints(spark: SparkSession) -> str:
    """The folder of checkpoints: spark.checkpoint.dir.

    Where that is unset, as in tests, a local session gets a temporary folder of its own and a cluster one in
    its warehouse, which machines share.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc.setCheckpointDir(given or (_folder("checkpoint") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of checkpoints, for a table that lasts as long as the work."""
    return f"{_checkpoints(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written once as Parquet to the folder of checkpoints and read from there, column by column; deleted when the program ends in an orderly way."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    atexit.register(_drop, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def session(name: str = "foliant", **settings: str) -> SparkSession:
    """A session with adaptive execution; settings are Spark's own, with _ for each dot."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in settings.items():
        builder = builder.config(k.replace("_", "."), v)
    return ship(builder.getOrCreate())
