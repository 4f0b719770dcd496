"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. In local mode, where one machine runs all, a temporary folder will
    do if that is unset; on a cluster it is an error."""
    if path := spark.conf.get("spark.checkpoint.dir", ""):
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="lexweave-"))
    return _fallback[0]


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost
    executors. The files go when the session's file system closes, or with forget()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexweave-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _files(spark, path, lambda system, where: system.deleteOnExit(where))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete what written() made, once everything read from it is written too."""
    for table in tables:
        if path := getattr(table, "written_to", None):
            _files(table.sparkSession, path, lambda system, where: system.delete(where, True))


def _files(spark: SparkSession, path: str, act) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(where.getFileSystem(spark._jsc.hadoopConfiguration()), where)
