"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation (each role but ``system``) the dialogue is
rendered once with that participant as the assistant and every other one as a
user named by its role; the system turn stays the system's. The mask marks, as
half-open character ranges, what the model is to learn: the participant's own
contents with their end marks.

A rendering is a list of *parts* of ``turns_per_part`` turns, each a row: ``offset``
is where the part begins in the whole rendering, and the mask's ranges are places in
the whole rendering too. Usual conversations are one part; the parts of a longer one,
joined in order, are the rendering, whatever its length, and texts are never gathered
by more than a part: where parts begin is added up over their lengths, a row of four numbers for
1,024 turns. Turns are numbered in two steps: a range sort deals them by (conversation, turn), so
one hot conversation lies in many partitions, and the counts per conversation and
partition, added up, tell where each partition's turns begin. Participants are
found by a combined distinct, and met by a join on conv_id that Spark can split.

Defined results: a null text is empty; a null role is the participant "unknown";
a null turn counts as 0; ties on turn are ordered by role, then by the text's
SHA-256; repeated rows are rendered as often as they occur; a null conv_id is a
conversation of its own; a conversation with system turns only has no perspective and
no rows; texts and roles go in as they are, also if they hold the marks themselves
(masks are places, so they stay right); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinflow.llm.common import materialize, parallelism, read_table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def number_turns(said: DataFrame) -> DataFrame:
    """``said`` (conv_id, turn, role, content) with ``place``: the number, from 0, of each turn in its conversation."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn"), F.col("role"), F.col("digest"), F.col("tie")]
    keyed = said.withColumn("digest", F.sha2(F.col("content").cast("binary"), 256)).withColumn("tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(parallelism(said.sparkSession), *order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "turn", "role", "content", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at"))
    dealt = materialize(dealt, "turns")
    counts = dealt.groupBy("conv_id", "pid").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # one row per conversation and partition
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("conv_id").alias("_conv"), F.col("pid").alias("_pid"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    met = dealt.join(starts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pid") == F.col("_pid")))
    return met.select("conv_id", "turn", "role", "content", (F.col("at") + F.col("shift")).alias("place"))


def render_perspectives(turns: DataFrame, turns_per_part: int = 1024) -> DataFrame:
    """(conv_id, perspective, part, offset, n_turns, n_learned, text, mask array<struct<start,stop>>)."""
    said = turns.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"),
    )
    said = number_turns(said).withColumn("part", F.floor(F.col("place") / turns_per_part).cast("long"))
    parties = said.where("role <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    seen = said.join(parties, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("role") == F.col("perspective")
    header = (
        F.when(own, F.lit("assistant"))
        .when(F.col("role") == "system", F.lit("system"))
        .otherwise(F.concat(F.lit("user name="), F.col("role")))
    )
    parts = seen.select(
        "conv_id", "perspective", "part", "place", own.alias("own"),
        F.concat(F.when(F.col("conv_id").isNull(), "none").otherwise("id "), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("_key"),
        F.concat(F.lit(OPEN), header, F.lit("\n")).alias("head"), F.concat("content", F.lit(CLOSE)).alias("body"),
    )
    group = ["_key", "perspective", "part"]
    piece = F.struct("place", F.concat("head", "body").alias("piece"), "own", F.length("head").cast("long").alias("head"))
    joined = parts.groupBy(*group).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(piece)).alias("p"))
    # Where parts begin is added up over their lengths. Texts are neither sorted nor moved for it: they meet it where the grouping has put them.
    lengths = parts.groupBy(*group).agg(F.sum(F.length("head") + F.length("body")).alias("length"))
    before = Window.partitionBy("_key", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))
    joined = joined.join(lengths.select(*group, offset.alias("offset")).hint("shuffle_hash"), group)
    return joined.select(
        "conv_id",
        "perspective",
        "part",
        "offset",
        F.size("p").cast("long").alias("n_turns"),
        F.size(F.filter("p", lambda x: x["own"])).cast("long").alias("n_learned"),
        F.array_join("p.piece", "").alias("text"),
        _mask(F.col("p"), F.col("offset")).alias("mask"),
    )


def _mask(pieces: Column, offset: Column) -> Column:
    """Ranges of the own contents, walking over the pieces of a part."""
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        stop = acc["at"] + F.length(x["piece"])
        span = F.array(F.struct((acc["at"] + x["head"]).alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(x["own"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    return F.aggregate(pieces, F.struct(offset.alias("at"), none.alias("mask")), step)["mask"]


def op7_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    done = render_perspectives(read_table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["stop"].cast("string")))
    return done.withColumn("mask", F.array_join(spans, ","))


# Places are counted over the whole rendering; only the rows are cut into parts.
OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS content FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), s AS (
  SELECT t.*, perspective, role = perspective AS own,
         '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
                                ELSE 'user name=' || role END || chr(10) AS head,
         content || '<|im_end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), w AS (
  SELECT *, CAST(sum(length(head) + length(body)) OVER o AS BIGINT) AS stop, row_number() OVER o - 1 AS place
  FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn, role, sha256(content) ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, place // 1024 AS part, min(stop - length(head) - length(body)) AS "offset",
       count(*) AS n_turns, count(*) FILTER (own) AS n_learned, string_agg(head || body, '' ORDER BY stop) AS text,
       coalesce(string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY stop) FILTER (own), '') AS mask
FROM w GROUP BY conv_id, perspective, place // 1024
"""
