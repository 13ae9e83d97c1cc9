"""The folder that the driver and every executor can read and write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset, and only for a local master (tests, a laptop), a
    temporary folder is made and put into the session's configuration.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='basinflow-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A folder of this application that nothing else uses."""
    return f"{shared_dir(spark)}/basinflow/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{tag}"


def write_down(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again: it is computed once, and a lost executor costs a re-read."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Remove all that this application wrote under the shared folder. Frames that still read it can't be used after that."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/basinflow/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
