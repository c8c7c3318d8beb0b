"""Tables kept in the folder that the driver and every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session on one machine may lack that setting; it gets a temporary
    folder.  On a cluster no local folder is right.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="lanternq-")
    return _OWN_DIR[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a re-read rather than a
    recomputation, and it fixes the rows for every later use.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            hadoop_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop_path, True)
