"""Sequences of steps within a time limit, without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinflow.operators.joins import time_bucket
from basinflow.sources.shared import write_down


def match_steps(events: DataFrame, by: str, time: str, steps: Sequence[Column], within_seconds: int, width: int = 86_400) -> DataFrame:
    """(by, t1, ..., tn, reached): a row for each event of the first step, with the time of the earliest event of each next step after the one before.

    Steps are conditions; an event may meet several. Each must come strictly later than the one before and at most ``within_seconds``
    after the first; beyond that times are null and ``reached`` counts the steps that were met. As every step is taken as
    early as it can be, a start that can be completed is completed, and at its earliest.

    The automaton of steps runs backward over the rows of a (key, time bucket), once, and keeps for each step the earliest
    completion of what follows. A bucket passes on, for each step, the earliest chain that begins in it; a bucket's own rows then look at the
    chains of later buckets only where none begins after them in their own. So a hot key lies in as many tasks as it has buckets, and
    between buckets there is a row for each of them. A null key or time matches nothing; rows that repeat are starts of their own; an empty table
    gives no rows.
    """
    n = len(steps)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    flags = F.array(*[F.coalesce(s, F.lit(False)) for s in steps])
    rows = events.where(F.col(by).isNotNull() & F.col(time).isNotNull()).select(F.col(by).alias("k"), at.alias("t"), time_bucket(events, time, width).alias("b"), flags.alias("s"))
    rows = rows.where(F.exists("s", lambda x: x))
    inside = Window.partitionBy("k", "b").orderBy(F.desc("t"))
    # Rows strictly later in the bucket: ties on time are peers, which a range frame leaves out.
    later = inside.rangeBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("k").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    chain = F.when(F.col("s")[n - 1], F.array("t"))  # from this row on: the times of its step and of those after it
    found = rows.withColumn(f"c{n}", chain)
    for step in range(n - 1, 0, -1):
        # The earliest later row that begins a chain of the next step: its time is the chain's first.
        near = F.min(f"c{step + 1}").over(later)
        firsts = found.groupBy("k", "b").agg(F.min(f"c{step + 1}").alias("first"))
        carried = firsts.select("k", "b", F.last("first", ignorenulls=True).over(across).alias("beyond"))
        found = found.join(carried, ["k", "b"], "left").withColumn("next", F.coalesce(near, "beyond")).drop("beyond")
        own = F.when(F.col("s")[step - 1], F.concat(F.array("t"), F.coalesce("next", F.array().cast("array<bigint>"))))
        found = found.withColumn(f"c{step}", own).drop("next", f"c{step + 1}")
        if step > 1:  # each step reads the rows twice
            found = write_down(found, "steps")
    limit = F.col("c1")[0] + within_seconds * 1_000_000
    starts = found.where(F.col("c1").isNotNull()).select("k", F.filter("c1", lambda x: x <= limit).alias("c"))
    stamp = lambda i: F.get("c", F.lit(i))
    return starts.select(F.col("k").alias(by), *[F.timestamp_micros(stamp(i)).alias(f"t{i + 1}") for i in range(n)], F.size("c").cast("long").alias("reached"))
