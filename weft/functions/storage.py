"""Tables in the shared folder: they bound the lineage of loops and survive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own where the session names none and all runs in this process (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="weft-shared-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        found = "file://" + _OWN[0]
    return found.rstrip("/")


@contextmanager
def _shuffles_dropped_after(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as it ends, as nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/weft-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with _shuffles_dropped_after(df.sparkSession):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that `stored` gave, once nothing reads it any more; other frames are left alone."""
    if path := getattr(df, "_weft_path", None):
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Write a table in the shared folder, dealt and sorted by a column, so that joins on it need no exchange; read it back."""
    spark = df.sparkSession
    table = f"weft_{name}_{uuid.uuid4().hex}"
    with _shuffles_dropped_after(spark):
        df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
