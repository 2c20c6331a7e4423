"""Materialised intermediate tables in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: How often, and for how many seconds each, the cleaner is waited for.
TURNS, PAUSE = 6, 0.3
_OWN: dict[str, str] = {}
#: Path of each table, with a weak reference to the file index that every plan over its files holds.
_READ: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local master without that setting (tests) gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        holder = tempfile.TemporaryDirectory(prefix="tessera-")
        atexit.register(holder.cleanup)
        _OWN[app] = holder.name
    return _OWN[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back, which cuts its lineage.

    The files outlive any executor, so a lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().relation().location()
    _READ[path] = spark._jvm.java.lang.ref.WeakReference(index)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    _READ.pop(path, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def settle(spark: SparkSession) -> None:
    """Frees the disk of steps that are over.

    The JVM is asked to collect, upon which Spark's cleaner deletes shuffle files, and tables whose files no DataFrame, and
    none derived from it, can read any more are deleted. The cleaner works on its own: the next step waits for it,
    TURNS pauses at most while shuffles are left (a local master does not), so that it does not add its files to those of the last.
    """
    shuffles = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    for _ in range(TURNS):
        gc.collect()
        spark._jvm.System.gc()
        if not shuffles.size() or spark.sparkContext.master.startswith("local["):
            break
        time.sleep(PAUSE)
    for path, index in list(_READ.items()):
        if index.refersTo(None):
            _delete(spark, path)
