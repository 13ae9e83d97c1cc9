"""Physical layouts that save later shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.operators.names import free_name


#: Rows of a bucket, about.
BUCKET_ROWS = 200_000


def buckets_for(rows: int, least: int = 8) -> int:
    """As many buckets as keep one at about ``BUCKET_ROWS`` of the ``rows``: what a task sorts does not grow with the table."""
    return max(least, -(-rows // BUCKET_ROWS))


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """A table of the warehouse hashed and sorted by ``key``: joins and groupings on it need no shuffle.

    Rows are dealt by the key first, so each bucket is one file.
    """
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def write_partitioned(df: DataFrame, path: str, by: str, order: str) -> None:
    """Parquet folders by ``by``, rows sorted by ``order`` within a file, so that row-group statistics prune.

    Rows are dealt by ranges of (by, order), so a value of ``by`` that holds most rows is written by many tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, by, order).sortWithinPartitions(by, order).write.mode("overwrite").partitionBy(by).parquet(path)


def spread_bits(value: Column) -> Column:
    """The low 31 bits of a long, each followed by a zero bit: halves move apart, then quarters, down to single bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        value = F.shiftleft(value, shift).bitwiseOR(value).bitwiseAND(F.lit(mask))
    return value


def morton_code(x: Column, y: Column) -> Column:
    """Bits of two whole numbers from 0 to 2**31 - 1, interleaved: places near in the plane are near in the code."""
    return F.shiftleft(spread_bits(x.cast("long")), 1).bitwiseOR(spread_bits(y.cast("long")))


def write_morton(df: DataFrame, path: str, x: Column, y: Column, rows_per_group: int = 1_000_000) -> None:
    """Parquet files in order of the Morton code of ``x`` and ``y``, scaled to their ranges, so that row groups are small boxes and their statistics prune on either column.

    Rows are dealt by ranges of (code, hash of the row), so a place that most rows share is written by many tasks. Null coordinates count as the least.
    ``x`` and ``y`` are whole numbers of any range.
    """
    lo_x, hi_x, lo_y, hi_y = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    scaled = lambda c, lo, hi: F.floor((F.coalesce(c, F.lit(lo or 0)) - F.lit(lo or 0)) * F.lit(0xFFFF / max((hi or 0) - (lo or 0), 1))).cast("long")
    name = free_name("code", df)
    coded = df.withColumn(name, morton_code(scaled(x, lo_x, hi_x), scaled(y, lo_y, hi_y)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = coded.repartitionByRange(n, name, F.xxhash64(*df.columns)).sortWithinPartitions(name)
    dealt.drop(name).write.option("parquet.block.row.count.limit", rows_per_group).parquet(path)
