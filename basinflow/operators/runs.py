"""Run-length encoding by a table function over partitions of a table argument."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from basinflow.operators.joins import time_bucket
from basinflow.sources.shared import write_down


@F.udtf
class RunsOf:
    """Of each partition of a table (k, b, t, ..., kind), sorted: a row for each run of equal kinds. It holds one run at a time."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("runs_of takes a table: runs_of(TABLE(t) PARTITION BY (k, b) ORDER BY t)")
        given = rows.dataType
        schema = StructType().add("k", given["k"].dataType).add("b", given["b"].dataType).add("nth", LongType()).add("kind", given["kind"].dataType)
        return AnalyzeResult(schema.add("n", LongType()).add("first", given["t"].dataType).add("last", given["t"].dataType))

    def __init__(self) -> None:
        self.run: list | None = None

    def eval(self, rows: Row):
        if self.run and self.run[3] == rows["kind"]:
            self.run[4] += 1
            self.run[6] = rows["t"]
            return
        if self.run:
            yield tuple(self.run)
        self.run = [rows["k"], rows["b"], self.run[2] + 1 if self.run else 1, rows["kind"], 1, rows["t"], rows["t"]]

    def terminate(self):
        if self.run:
            yield tuple(self.run)


def encode_runs(df: DataFrame, by: str, time: str, tie: str, kind: str, width: int = 86_400) -> DataFrame:
    """(by, run_no, kind, n, first, last): the runs of equal ``kind`` of each key, in order of ``time``, then ``tie``.

    The table function encodes each (key, time bucket), so a hot key lies in as many tasks as it has buckets. A row per bucket then
    tells where a bucket's first run goes on from the one before, and how many runs there are before it; the pieces of a run
    are added up by (key, number of the run). A null kind is a kind; rows without a time come first; a null key is a key; an empty table gives no rows.
    """
    spark = df.sparkSession
    df.select(F.col(by).alias("k"), time_bucket(df, time, width).alias("b"), F.col(time).alias("t"), F.col(tie).alias("tie"), F.col(kind).alias("kind")).createOrReplaceTempView("_rows_in_runs")
    spark.udtf.register("runs_of", RunsOf)
    pieces = write_down(spark.sql("SELECT * FROM runs_of(TABLE(_rows_in_runs) PARTITION BY (k, b) ORDER BY (t, tie))"), "runs")
    spark.catalog.dropTempView("_rows_in_runs")
    ends = pieces.groupBy("k", "b").agg(F.max("nth").alias("runs"), F.struct(F.min_by("kind", "nth").alias("x")).alias("head"), F.struct(F.max_by("kind", "nth").alias("x")).alias("tail"))
    key = Window.partitionBy("k").orderBy(F.col("b").asc_nulls_first())
    goes_on = F.coalesce(F.lag("tail").over(key).eqNullSafe(F.col("head")) & (F.row_number().over(key) > 1), F.lit(False)).cast("long")
    ends = ends.withColumn("goes_on", goes_on)
    shift = F.coalesce(F.sum(F.col("runs") - F.col("goes_on")).over(key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("goes_on")
    ends = ends.select(F.col("k").alias("k2"), F.col("b").alias("b2"), shift.alias("shift"))
    numbered = pieces.join(ends, F.col("k").eqNullSafe(F.col("k2")) & F.col("b").eqNullSafe(F.col("b2"))).withColumn("run_no", F.col("nth") + F.col("shift"))
    runs = numbered.groupBy("k", "run_no").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.select(F.col("k").alias(by), "run_no", F.col("kind").alias(kind), "n", "first", "last")
