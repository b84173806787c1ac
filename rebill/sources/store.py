"""Tables of a job's own in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; on a local master without that setting, as in tests, one below /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/statements-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame) -> DataFrame:
    """The frame written once and read again: what is built on it neither plans nor computes it anew."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_by(df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
    """The same, dealt out by ``keys`` once: later groups, windows and joins on them (and more columns) move no rows.

    Rows that are ``dealt`` out by ``keys`` already are written where they are.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), path.rsplit("/", 1)[1].replace("-", "_")
    (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def dropped(*frames: DataFrame) -> None:
    """Delete what was kept of frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/statements-" in folder:
                spark.sql(f"DROP TABLE IF EXISTS {folder.rsplit('/', 1)[1].replace('-', '_')}")
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
