"""Numbers and ranks over whole tables, or over groups of any size, without a window that gathers them in one task.

Rows are range-sorted into partitions and written, so that each row has the number of its
partition and its place there. Counts per partition, added up, tell where each one begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinflow.operators.names import free_name
from basinflow.sources.shared import write_down


def deal_in_order(df: DataFrame, order: Sequence[Column], part: str, at: str) -> DataFrame:
    """``df`` in global order, written and read again, with ``part`` (partitions ascend) and ``at`` (rows ascend within one).

    Rows that tie are told apart by a hash of the row and by their place in the input, so a
    value that most rows share, or a row that is repeated, lies in many partitions.
    ``df`` should be a scan or a written table: the place in the input is evaluated once per row.
    """
    spark = df.sparkSession
    mark, tie = free_name("mark", df), free_name("tie", df)
    keyed = df.withColumns({mark: F.xxhash64(*df.columns), tie: F.monotonically_increasing_id()})
    by = [*order, F.col(mark), F.col(tie)]
    dealt = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    return write_down(dealt.select(*df.columns, F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at)), "dealt")


def group_starts(dealt: DataFrame, by: Sequence[str], part: str, at: str) -> DataFrame:
    """(by, part, shift, size) for each group and partition that has rows of it: ``at + shift`` is a row's place, from 0, in its group of ``size`` rows."""
    counts = dealt.groupBy(*by, part).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    group = Window.partitionBy(*by)  # one row for each group and partition
    before = F.coalesce(F.sum("n").over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(*by, part, (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("size"))


def number_in_groups(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``: each row's number, from 0, in its group. Null keys are a group; a group of any size lies in many tasks."""
    part, at = free_name("part", df), free_name("at", df)
    dealt = deal_in_order(df, [*[F.col(c).asc_nulls_first() for c in by], *order], part, at)
    starts = group_starts(dealt, by, part, at).select(*[F.col(c).alias(f"{c}__") for c in by], F.col(part).alias(f"{part}__"), "shift")
    same = F.col(part) == F.col(f"{part}__")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    return dealt.join(starts, same).select(*df.columns, (F.col(at) + F.col("shift")).alias(name))


def global_ranks(df: DataFrame, order: Sequence[Column], keys: Sequence[str], tiles: int = 100) -> DataFrame:
    """``df`` with ``row_no``, ``rank_no``, ``tile`` and ``share`` (row_number, rank, ntile and percent_rank) over the whole table, or free names like these.

    ``order`` sorts the rows and begins with ``keys``, the columns whose equal values tie in ``rank_no``
    and ``share``; nulls tie with each other. Runs of equal keys may be longer than a partition: the
    driver sees one row per partition, and tells each where the run that it begins with had begun.
    Rows equal in all of ``order`` are numbered in an arbitrary order; an empty table gives no rows.
    """
    spark = df.sparkSession
    names = [free_name(c, df) for c in ("row_no", "rank_no", "tile", "share")]
    part, at, run = (free_name(c, df) for c in ("part", "at", "run"))
    dealt = deal_in_order(df, order, part, at)
    # Keyed by partition and key, so that a key of many rows is dealt as its partitions are.
    dealt = dealt.withColumn(run, F.min(at).over(Window.partitionBy(part, *keys)))
    key = F.to_json(F.struct(*keys))
    edges = dealt.groupBy(part).agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.min_by(key, at).alias("low"), F.max_by(key, at).alias("high"), F.max_by(run, at).alias("last_run")
    )
    begins, upto, run_start, high = [], 0, 0, None
    for e in sorted(edges.collect(), key=lambda e: e[part]):  # one row per partition
        carried = run_start if e.low == high else upto
        begins.append((e[part], e["first"], upto, carried))
        if e.last_run > e["first"]:
            run_start = upto + e.last_run - e["first"]
        else:
            run_start = carried
        upto, high = upto + e.n, e.high
    p, first, offset, carried = (free_name(c, dealt) for c in ("p", "first", "offset", "carried"))
    starts = spark.createDataFrame(begins, f"{p} int, {first} long, {offset} long, {carried} long")
    met = dealt.join(F.broadcast(starts), F.col(part) == F.col(p))  # bounded: one row per partition
    place = F.col(at) - F.col(first) + F.col(offset)
    rank = F.when(F.col(run) == F.col(first), F.col(carried)).otherwise(F.col(run) - F.col(first) + F.col(offset))
    each, more = divmod(upto, tiles)
    tile = F.floor(place / (each + 1)) if not each else F.when(place < more * (each + 1), F.floor(place / (each + 1))).otherwise(more + F.floor((place - more * (each + 1)) / each))
    share = rank / max(upto - 1, 1)
    return met.select(*df.columns, *[c.alias(n) for c, n in zip(((place + 1).cast("long"), (rank + 1).cast("long"), (tile + 1).cast("long"), share), names)])
