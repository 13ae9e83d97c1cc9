"""Shared helpers: where intermediate tables go, and small column idioms."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.operators import names
from basinflow.sources.shared import drop_written, fresh_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"


def table_path(spark: SparkSession, tag: str) -> str:
    return fresh_path(spark, tag)


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a re-run, and
    Spark learns the true size of the table for its choice of joins.
    """
    spark = df.sparkSession
    path = path or table_path(spark, tag)
    with small_batches(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch between Spark and a Python worker, and the setting that bounds them.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that start within send Python workers ``BATCH_BYTES`` at a time, which bounds what a worker holds also where rows are long."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


class Run(NamedTuple):
    """A table that is hash-bucketed and sorted by its key, so that merges with another one of that key move no rows."""

    name: str
    path: str
    frame: DataFrame

    def drop(self) -> None:
        spark = self.frame.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_table(spark, self.path)


#: Rows of the input for a bucket of its runs, up to as many buckets as there are shuffle partitions.
BUCKET_ROWS = 25_000


def buckets_for(spark: SparkSession, rows: int) -> int:
    return min(parallelism(spark), 1 + rows // BUCKET_ROWS)


def write_run(df: DataFrame, key: str, tag: str, buckets: int) -> Run:
    """Write ``df`` bucketed and sorted by ``key`` under the shared folder. Runs of as many buckets merge without a shuffle."""
    spark = df.sparkSession
    path, name = table_path(spark, tag), f"basinflow_{tag}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return Run(name, path, spark.table(name))


def doubling_batch(key: Column, rows: int, base: int) -> tuple[Column, int]:
    """A batch number for each key, and how many there are: the first two batches hold about ``base`` rows, each later one as many as all before it.

    Batches are dealt by hash, so there are about log2(rows / base) of them at any size.
    """
    bits = max(0, (rows // base).bit_length() - 1)
    draw = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    return F.length(F.ltrim(F.bin(draw), F.lit("0"))).cast("int"), bits + 1


def first_batch(rows: int) -> int:
    """A quarter of the rows: an index of any size takes three batches, so that later ones merge with runs, and runs are compacted."""
    return max(1, rows // 4)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_all_tables(spark: SparkSession) -> None:
    """Remove every intermediate table of this application. Frames that still read one can't be used after that."""
    drop_written(spark)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in ``lower``."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def ascii_strip(c: Column) -> Column:
    """Strip ``[\\x20\\x09-\\x0D]`` at both ends."""
    return F.btrim(c, F.lit(SPACE))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_documents(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc, doc_id, text), and whether ``doc`` is doc_id itself, as it is where that is unique and not null.

    ``doc`` is a unique long that orders documents. Where doc_id can't serve, rows
    are range-sorted by (doc_id, nulls first, then text hash) and numbered.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd = texts.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if odd.isEmpty():
        return texts.select(F.col("doc_id").alias("doc"), "doc_id", "text").where("doc IS NOT NULL"), True
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = texts.repartitionByRange(parallelism(docs.sparkSession), *by).sortWithinPartitions(*by)
    numbered = materialize(dealt.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "numbered")
    return numbered.where("doc IS NOT NULL"), False


def with_doc_id(result: DataFrame, keyed: DataFrame, plain: bool) -> DataFrame:
    """Put doc_id in the place of ``doc``."""
    if plain:
        return result.withColumnRenamed("doc", "doc_id")
    return result.join(keyed.select("doc", "doc_id"), "doc").drop("doc")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added while ``df`` has such a column (names ignore case)."""
    return names.free_name(base, df)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, although ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def keep_one_per_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the smallest (doc_id, text hash), null ids last.

    ``groups`` has (doc_id, raw, grp) for every row, ``raw`` being the text's
    ``xxhash64``. Rows are found by id and text, as ids may repeat or be null.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "raw")
    counted = materialize(groups.groupBy("grp", "doc_id", "raw").agg(F.count("*").alias("n")), "groups")
    best = counted.groupBy("grp").agg(F.min(rank).alias("top"), F.sum("n").alias("size")).where("size > 1").select("grp", "top")
    lost = counted.join(best, "grp").select("doc_id", "raw", rank.eqNullSafe(F.col("top")).alias("twin"), "n")
    lost = materialize(lost.where("not twin or n > 1"), "lost")
    mark, code, raw = (free_name(docs, name) for name in ("lost_id", "lost_raw", "own_raw"))
    named = [F.col("doc_id").alias(mark), F.col("raw").alias(code)]
    hashed = docs.withColumn(raw, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(mark)) & (F.col(raw) == F.col(code))
    left = hashed.join(lost.where("not twin").select(*named), same, "left_anti")
    # Rows that repeat an id and a text: one of them stays.
    twins = lost.where("twin").select(*named)
    return left.join(twins, same, "left_anti").unionByName(left.join(twins, same, "left_semi").dropDuplicates(["doc_id", raw])).drop(raw)
