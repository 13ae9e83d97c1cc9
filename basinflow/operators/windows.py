"""Window idioms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinflow.operators.joins import time_bucket
from basinflow.operators.names import free_name


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their number as the last column, ``rank_no`` (or a free name like it).

    Spark drops rows inside the map tasks before the shuffle (WindowGroupLimit). Null keys are a group of their own.
    """
    rank = free_name("rank_no", df)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def dedup_latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``. Null keys are a key of their own."""
    return top_k_per_group(df, key, order, 1).select(*df.columns)


def sessionize(df: DataFrame, by: str, time: str, gap_seconds: int, width: int = 86_400) -> DataFrame:
    """The columns of ``df`` and ``session_no`` (or a free name like it), from 1: a session ends where the next row is ``gap_seconds`` or more later.

    Rows are dealt by (key, time bucket of ``width`` seconds), so a hot key lies in as
    many tasks as it has buckets. A bucket's first row looks back at the last time of
    the buckets before, and sessions begun in those are added up, both over one row per
    key and bucket. Rows that tie on time are in one session. Null keys are one key; rows without a time come first and are
    session 1 together with each other; an empty table gives no rows.
    """
    row = F.struct(*df.columns)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.select(row.alias("row"), F.col(by).alias("k"), at.alias("t"), time_bucket(df, time, width).alias("b"))
    key = Window.partitionBy("k").orderBy(F.col("b").asc_nulls_first())
    ends = rows.groupBy("k", "b").agg(F.max("t").alias("end"))
    ends = ends.select(F.col("k").alias("k2"), F.col("b").alias("b2"), F.lag("end").over(key).alias("before"))
    same = F.col("k").eqNullSafe(F.col("k2")) & F.col("b").eqNullSafe(F.col("b2"))
    inside = Window.partitionBy("k", "b").orderBy("t")
    earlier = F.coalesce(F.lag("t").over(inside), "before")
    begins = F.coalesce(F.col("t") - F.col("earlier") >= gap_seconds * 1_000_000, F.col("nth") == 1)
    # Without an earlier time the first row of its bucket begins a session.
    marked = rows.join(ends, same).withColumn("earlier", earlier).withColumn("nth", F.row_number().over(inside))
    marked = marked.select("row", "k", "b", "t", begins.cast("long").alias("begins"))
    sums = marked.groupBy("k", "b").agg(F.sum("begins").alias("n"))
    so_far = F.coalesce(F.sum("n").over(key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("k").alias("k2"), F.col("b").alias("b2"), so_far.alias("so_far"))
    # Of rows that tie on time any one may be marked: the sum takes them all, so they get one number.
    number = F.col("so_far") + F.sum("begins").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.join(sums, same).select("row.*", number.alias(free_name("session_no", df)))
