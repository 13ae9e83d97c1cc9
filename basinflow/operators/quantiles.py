"""Exact quantiles of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of the sketch that brackets a quantile, as a share of the group: 1 in ACCURACY.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, by: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """``by`` and, for each name in ``fractions``, the exact interpolated quantile of the non-null values.

    A mergeable sketch brackets each quantile between two values that are sure to lie
    about it, give or take a rank; a grouped count then gives how many values lie below
    the bracket and how often each one inside occurs, and only these, about 4 in ``ACCURACY`` of the rows or
    fewer distinct values, are sorted. No group gathers in one task.

    A null ``by`` is a group; a group without values has null quantiles; an empty table
    gives no rows.
    """
    slack = 2 / ACCURACY
    v = F.col(value)
    bounds = []
    for name, p in fractions.items():
        low = F.min(v) if p <= slack else F.percentile_approx(v, p - slack, ACCURACY)
        high = F.max(v) if p >= 1 - slack else F.percentile_approx(v, p + slack, ACCURACY)
        bounds.append(F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"), low.alias("lo"), high.alias("hi")))
    sketch = df.groupBy(F.col(by).alias("k")).agg(F.count(v).alias("n"), F.array(*bounds).alias("bounds"))
    brackets = sketch.select("k", "n", F.explode("bounds").alias("q")).select("k", "n", "q.*")
    rows = df.select(F.col(by).alias("k2"), v.alias("v")).where(v.isNotNull())
    met = rows.join(brackets, F.col("k2").eqNullSafe(F.col("k")))
    # All values below the bracket are one row, and all above it, with the value next to the bracket.
    side = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), 1).otherwise(0)
    counts = met.groupBy("k", "name", "p", "n", side.alias("side"), F.when(side == 0, F.col("v")).alias("at")).agg(
        F.count("*").alias("c"), F.when(side < 0, F.max("v")).otherwise(F.min("v")).alias("x")
    )
    order = Window.partitionBy("k", "name").orderBy("side", "at").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(order)).withColumn("place", F.col("p") * (F.col("n") - 1))
    ends = ranked.groupBy("k", "name", "place").agg(
        F.min_by("x", F.when(F.col("upto") > F.floor("place"), F.col("upto"))).alias("a"), F.min_by("x", F.when(F.col("upto") > F.ceil("place"), F.col("upto"))).alias("b")
    )
    found = ends.select("k", "name", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("x"))
    wide = found.groupBy("k").agg(*[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in fractions])
    keys = sketch.select(F.col("k").alias("k2"))
    return keys.join(wide, F.col("k2").eqNullSafe(F.col("k")), "left").select(F.col("k2").alias(by), *fractions)
