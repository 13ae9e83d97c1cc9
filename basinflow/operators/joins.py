"""Joins that Spark has no operator for, as compositions of those it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinflow.operators.names import free_name


def time_bucket(df: DataFrame, time: str, width: int) -> Column:
    """The number of the bucket that a time lies in: ``width`` seconds of a date or timestamp, ``width`` units of a number."""
    value = F.col(time)
    if isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.floor(F.unix_micros(value.cast("timestamp")) / F.lit(width * 1_000_000)).cast("long")
    return F.floor(value / F.lit(width)).cast("long")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, carry: list[str], width: int = 86_400) -> DataFrame:
    """Each left row with the ``carry`` columns of the latest right row of its key at or before its time.

    Rows are dealt by (key, time bucket of ``width``), so a hot key lies in as many
    tasks as it has buckets. Within a bucket a running ``last`` finds the match; for
    rows before a bucket's first right row it is the last right row of the buckets
    before, found over one row per key and bucket. No inequality join: the work is
    linear in the rows.

    Left rows keep their columns, also repeated ones; without a match the carried
    columns are null. Ties on time take the greatest carry values. A null key or time
    matches nothing, on either side. Empty sides are fine. A carried column that the
    left side has too raises, as its name would stand twice.
    """
    if clash := {c.lower() for c in left.columns} & {c.lower() for c in carry}:
        raise ValueError(f"rename before the join: {sorted(clash)}")
    rights = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(by).alias("k"), F.col(right_time).alias("t"), time_bucket(right, right_time, width).alias("b"), F.struct(*carry).alias("v")
    )
    lefts = left.select(
        F.col(by).alias("k"), F.col(left_time).alias("t"), time_bucket(left, left_time, width).alias("b"), F.lit(1).alias("side"),
        F.struct(*left.columns).alias("row"), F.lit(None).alias("v"),
    )
    # One row per key and bucket: the last right row up to the bucket's end.
    seen = lefts.select("k", "b", F.lit(None).alias("m")).unionByName(rights.select("k", "b", F.struct("t", "v").alias("m")))
    ends = seen.where("k IS NOT NULL AND b IS NOT NULL").groupBy("k", "b").agg(F.max("m").alias("m"))
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("k", "b", F.last("m.v", ignorenulls=True).over(before).alias("before"))
    both = lefts.unionByName(rights.select("k", "t", "b", F.lit(0).alias("side"), F.lit(None).alias("row"), "v")).join(carried, ["k", "b"], "left")
    inside = Window.partitionBy("k", "b").orderBy("t", "side", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("found", F.coalesce(F.last("v", ignorenulls=True).over(inside), "before")).where("side = 1")
    return found.select("row.*", *[F.col(f"found.{c}").alias(c) for c in carry])


def interval_join(points: DataFrame, spans: DataFrame, point: str, start: str, stop: str, width: int, by: str | None = None) -> DataFrame:
    """Pairs with start <= point < stop over integers, through an equi-join on buckets of ``width``.

    A span is repeated once per bucket that it touches, so ``width`` should be near
    the usual span; points are never repeated, so no pair is found twice. Null points
    or ends, and spans that are empty or run backwards, match nothing; repeated rows
    pair as often as they occur.
    """
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    name = free_name("bucket", points, spans)
    p = points.withColumn(name, bucket(F.col(point)))
    s = spans.where(F.col(stop) > F.col(start)).withColumn(name, F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(stop) - 1))))
    on = [name] + ([by] if by else [])
    return p.join(s, on).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(stop))).drop(name)


def salted_join(big: DataFrame, small: DataFrame, on: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are dealt to ``salts`` tasks each; ``small`` is repeated as often.

    Null keys match nothing; ``left`` keeps them.
    """
    if how not in ("inner", "left"):
        raise ValueError("inner or left")
    name = free_name("salt", big, small)
    dealt = big.withColumn(name, F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [on, name], how).drop(name)


def overlap_join(left: DataFrame, right: DataFrame, start: str, stop: str, width: int, most: int = 10_000) -> DataFrame:
    """Pairs (``left.*`` as struct ``l``, ``right.*`` as struct ``r``) whose spans [start, stop) of integers overlap.

    Both sides lie in every bucket of ``width`` that they touch, and a pair is made in its first common bucket, the one that the
    later start lies in, so it is made once. A bucket with more than ``most`` rows of ``left`` is split: its left rows are dealt to
    portions and its right rows repeated in each, so no task joins more than about ``most`` of them with a bucket.
    Spans that are empty or run backwards, or have a null end, overlap nothing; rows that repeat pair as often as they occur.
    """

    def spread(df: DataFrame, side: str) -> DataFrame:
        rows = df.where(F.col(stop) > F.col(start)).select(F.struct(*df.columns).alias(side), F.col(start).alias(f"{side}_lo"), F.col(stop).alias(f"{side}_hi"))
        at = lambda c: F.floor(c / F.lit(width)).cast("long")
        return rows.withColumn("first", at(F.col(f"{side}_lo"))).withColumn("bucket", F.explode(F.sequence("first", at(F.col(f"{side}_hi") - 1)))).withColumnRenamed("first", f"{side}_first")

    lefts, rights = spread(left, "l"), spread(right, "r")
    # One row per bucket.
    portions = lefts.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("portions"))
    dealt = lefts.join(portions, "bucket").withColumn("portion", F.pmod(F.xxhash64("l"), F.col("portions")).cast("int")).drop("portions")
    copies = rights.join(portions, "bucket").withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1))).drop("portions")
    met = dealt.join(copies, ["bucket", "portion"]).where((F.col("l_lo") < F.col("r_hi")) & (F.col("r_lo") < F.col("l_hi")))
    return met.where(F.col("bucket") == F.greatest("l_first", "r_first")).select("l", "r")
