"""Tables of a scale-factor folder, and files of other formats with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"no table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views for ``spark.sql``."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_files(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV, JSON or text. CSV and JSON need a schema: inferring one reads everything twice."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_files(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "error", **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
