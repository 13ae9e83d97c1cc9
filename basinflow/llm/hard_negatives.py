"""Hard negatives by distributed radix selection over integer scores.

A *window* is an anchor with a range of scores, [lo, hi], and the rows that it may take: those of the
anchor's label (to find positives) or those of other labels (negatives). The distance of
a row is ``hi`` minus its score. A pass counts the rows of every window by one digit of their
distance, the most significant first; the counts, added up, locate the digit that holds the
kth row, and the next pass counts only rows below that digit. After the last digit the
kth score is known exactly, and one more pass gathers the rows that reach it, and no others.

Each pass compares blocks of anchors with chunks of rows in numpy, an exact integer product; scores
are never written. Anchors are a set of queries against all rows, and both sides are dealt by (block, slice of chunks), so
that tasks are of even size whatever labels rows have. Anchors, windows and what passes find about them grow with the table, and
their Parquet files are far smaller than their rows, so every join asks for a merge and nothing is broadcast through the driver. The histogram of a chunk
ends at its own kth row, since the kth of all rows can't lie further away. Of rows that tie for the
last places, a chunk sends the smallest ids that could be taken, so copies of a vector don't pile up.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part.
Vectors of unequal lengths are filled up with zeros; an empty vector scores 0. Components are saturated so that scores fit 56 bits
(at 2**25 for 64 components). Rows that share an id, or are repeated whole, are rows of their own, also as anchors
and positives; a row is never its own positive. Ties on score go to the smaller id. A positive whose score is negative has an empty window.
An anchor without positives, or a window without rows, gives no rows; so does an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinflow.llm.common import materialize, parallelism, read_table

#: Bits of a digit at most; bytes of the vectors of a chunk, and of a block of anchors.
RADIX, CHUNK_BYTES, BLOCK_BYTES, TILE = 9, 2 << 20, 512 << 10, 64
CHUNKS_IN_SLICE = 64
SCORE_BITS = 56
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Space(NamedTuple):
    """Points, packed and plain; ``bound`` is at least the size of any score."""

    points: DataFrame  # (row, vec_id, label, v)
    chunks: DataFrame  # (chunk, rows, ids, labels, vectors), little-endian longs
    n_chunks: int
    dims: int
    bound: int


def quantized(rows: DataFrame, vec_id: str, label: Column, vector: str) -> Space | None:
    """Rows that take part, with components floor(256 * x) as integers; None if there are none."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    fit = rows.where(F.col(vec_id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull()).where(finite)
    dims = fit.agg(F.max(F.size(vector))).first()[0]
    if dims is None:
        return None
    dims = max(dims, 1)
    most = int((2**SCORE_BITS / dims) ** 0.5)
    v = F.transform(vector, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x.cast("double") * 256))).cast("long"))
    v = F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(vector)))
    points = fit.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    points = materialize(points, "points")
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    bound = points.agg(F.max(size)).first()[0]
    per_chunk = max(16, CHUNK_BYTES // (8 * dims))
    chunks = materialize(points.mapInArrow(lambda it: _pack(it, dims, per_chunk), "chunk long, rows binary, ids binary, labels binary, vectors binary"), "chunks")
    return Space(points, chunks, chunks.count(), dims, max(bound, 1))


def _pack(batches: Iterator[pa.RecordBatch], dims: int, per_chunk: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, ids, labels = (batch.column(i).to_numpy() for i in range(3))
        v = batch.column(3).flatten().to_numpy().reshape(-1, dims)
        for lo in range(0, len(row), per_chunk):
            part = slice(lo, lo + per_chunk)
            packed = [pa.array([x[part].tobytes()], pa.binary()) for x in (row, ids, labels, v)]
            yield pa.record_batch([pa.array([row[lo]], pa.int64()), *packed], names=["chunk", "rows", "ids", "labels", "vectors"])


class _Block(NamedTuple):
    """A block of anchors with its windows against a chunk of rows."""

    rows: np.ndarray
    ids: np.ndarray
    scores: np.ndarray  # anchors x rows
    labels: np.ndarray
    own: np.ndarray  # of each window: the anchor's place in scores
    anchor_rows: np.ndarray
    anchor_labels: np.ndarray
    windows: dict[str, np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, small: bool) -> Iterator[_Block]:
    kind = np.float64 if small else np.int64  # doubles hold the scores exactly, and multiply faster
    for batch in batches:
        for i in range(batch.num_rows):
            rows, ids, labels, vectors = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in ("rows", "ids", "labels", "vectors"))
            anchors, windows = batch.column("anchors")[i].values, batch.column("windows")[i].values
            held = {f.name: windows.field(f.name).to_numpy(zero_copy_only=False) for f in windows.type}
            a_rows, a_labels = anchors.field("row").to_numpy(), anchors.field("label").to_numpy()
            a = anchors.field("v").flatten().to_numpy().reshape(-1, dims)
            order = np.argsort(a_rows)
            own = order[np.searchsorted(a_rows, held["anchor"], sorter=order)]
            scores = a.astype(kind) @ vectors.reshape(-1, dims).astype(kind).T
            yield _Block(rows, ids, scores, labels, own, a_rows, a_labels, held)


def _hits(b: _Block, same: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For each tile of windows: the windows (numbered in the tile), rows and scores that lie in the windows' ranges."""
    for lo in range(0, len(b.own), TILE):
        part = slice(lo, lo + TILE)
        own = b.own[part]
        s = b.scores[own]
        met = (s <= b.windows["top"][part, None]) & (s >= b.windows["bottom"][part, None])
        met &= (b.anchor_labels[own][:, None] == b.labels[None, :]) == same
        w, r = np.nonzero(met)
        if same:
            others = b.anchor_rows[own][w] != b.rows[r]
            w, r = w[others], r[others]
        yield part, w, r, s[w, r].astype(np.int64)


def _histograms(batches: Iterator[pa.RecordBatch], dims: int, small: bool, same: bool, shift: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches, dims, small):
        out: list[list[np.ndarray]] = [[], [], []]
        for part, w, _, s in _hits(b, same):
            number, need = b.windows["w"][part], b.windows["need"][part]
            digit = (b.windows["top"][part][w] - s) >> shift
            counts = np.bincount(w * buckets + digit, minlength=len(number) * buckets).reshape(-1, buckets)
            w, digit = np.nonzero((counts > 0) & (counts.cumsum(1) - counts < need[:, None]))
            for column, x in zip(out, (number[w], digit, counts[w, digit])):
                column.append(x)
        yield pa.record_batch([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["w", "digit", "n"])


def _gathered(batches: Iterator[pa.RecordBatch], dims: int, small: bool, same: bool) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches, dims, small):
        out: list[list[np.ndarray]] = [[], [], [], []]
        for part, w, r, s in _hits(b, same):
            # Rows above the kth score all qualify; of those at it, the smallest ids, as many as are wanted.
            order = np.lexsort((b.rows[r], b.ids[r], w))
            w, r, s = w[order], r[order], s[order]
            tied = s == b.windows["tie"][part][w]
            before = np.cumsum(tied) - tied
            first = np.searchsorted(w, np.arange(len(b.own[part])))
            nth = before - np.append(before, 0)[first][w]
            taken = ~tied | (nth < b.windows["need"][part][w])
            for column, x in zip(out, (b.windows["w"][part][w], b.ids[r], b.rows[r], s)):
                column.append(x[taken])
        yield pa.record_batch([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["w", "vec_id", "row", "score"])


def _met(space: Space, anchors: DataFrame, windows: DataFrame, blocks: int) -> DataFrame:
    """Every chunk with every block of anchors and its windows, dealt by (block, slice)."""
    slices = max(1, min(space.n_chunks, max(-(-2 * parallelism(windows.sparkSession) // blocks), space.n_chunks // CHUNKS_IN_SLICE)))
    own = anchors.groupBy("block").agg(F.collect_list(F.struct("row", "label", "v")).alias("anchors"))
    each = windows.groupBy("block").agg(F.collect_list(F.struct("w", "anchor", "top", "bottom", "tie", "need")).alias("windows"))
    packed = own.join(each.hint("merge"), "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = space.chunks.withColumn("slice", F.pmod(F.xxhash64("chunk"), F.lit(slices)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.join(packed.hint("merge"), ["block", "slice"]).select("rows", "ids", "labels", "vectors", "anchors", "windows")


def locate(space: Space, anchors: DataFrame, blocks: int, windows: DataFrame, k: int, same: bool, span: int) -> DataFrame:
    """``windows`` with ``base``, the distance of the kth row, and ``below``, how many rows are nearer; ``whole`` where there are fewer than ``k``."""
    bits = max(1, span.bit_length())
    passes = -(-bits // RADIX)
    width = -(-bits // passes)
    small, dims = space.bound < 2**53, space.dims
    keys = ["w", "anchor", "block", "lo", "hi"]
    # The distance of the kth row lies in [base, base + 2 ** (bits still open)), and `below` rows are nearer.
    state = windows.select(*keys, F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("whole"))
    for j in range(passes):
        shift = width * (passes - 1 - j)
        ranged = state.where(~F.col("whole")).select(
            "w", "anchor", "block", (F.col("hi") - F.col("base")).alias("top"),
            F.greatest("lo", F.col("hi") - F.col("base") - F.lit((1 << (shift + width)) - 1)).alias("bottom"),
            F.lit(0).cast("long").alias("tie"), (k - F.col("below")).cast("long").alias("need"),
        )
        counted = _met(space, anchors, ranged, blocks).mapInArrow(lambda it, shift=shift: _histograms(it, dims, small, same, shift, 1 << width), "w long, digit long, n long")
        counts = counted.groupBy("w", "digit").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("w").orderBy("digit")))  # a row for each digit
        reached = state.join(upto.hint("merge"), "w").where(F.col("upto") + F.col("below") >= k).groupBy("w").agg(F.min(F.struct("digit", (F.col("upto") - F.col("n")).alias("before"))).alias("d"))
        state = state.join(reached.hint("merge"), "w", "left").select(
            *keys, (F.col("base") + F.coalesce(F.col("d.digit") * (1 << shift), F.lit(0))).alias("base"),
            (F.col("below") + F.coalesce("d.before", F.lit(0))).alias("below"), F.col("d").isNull().alias("whole"),
        )
        state = materialize(state, f"digit{j}")
    return state


def gather(space: Space, anchors: DataFrame, blocks: int, state: DataFrame, k: int, same: bool) -> DataFrame:
    """(w, vec_id, row, score) of the rows that reach the kth score of their window; chunks send no more of those that tie there than are wanted."""
    small, dims = space.bound < 2**53, space.dims
    kth = F.col("hi") - F.col("base")
    ranged = state.select(
        "w", "anchor", "block", F.col("hi").alias("top"), F.when(F.col("whole"), F.col("lo")).otherwise(kth).alias("bottom"),
        F.when(F.col("whole"), F.col("lo") - 1).otherwise(kth).alias("tie"), (k - F.col("below")).cast("long").alias("need"),
    )
    return _met(space, anchors, ranged, blocks).mapInArrow(lambda it: _gathered(it, dims, small, same), "w long, vec_id long, row long, score long")


def select_top(space: Space, anchors: DataFrame, blocks: int, windows: DataFrame, k: int, same: bool, span: int) -> DataFrame:
    """(w, nth, vec_id, row, score): the first ``k`` rows of each window, or all if it has fewer.

    ``anchors`` is (block, row, label, v); ``windows`` is (w, anchor, block, lo, hi), ``span`` being at least any ``hi - lo``.
    ``same``: rows of the anchor's label but the anchor itself; else rows of other labels.
    """
    found = gather(space, anchors, blocks, locate(space, anchors, blocks, windows, k, same, span), k, same)
    nth = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)


def mine_hard_negatives(
    rows: DataFrame, vec_id: str, label: Column, vector: str, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), as in ``SCHEMA``.

    ``anchors`` is a condition on ``vec_id``, ``label`` and ``v``. For each anchor and each of its first ``positives`` rows of its label: the
    first ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    space = quantized(rows, vec_id, label, vector)
    own = space and space.points.where(anchors)
    n_anchors = own.count() if space else 0
    if not n_anchors:
        return spark.createDataFrame([], SCHEMA)
    blocks = -(-n_anchors // max(16, BLOCK_BYTES // (8 * space.dims)))
    own = materialize(own.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "anchors")
    whole = own.select(F.col("row").alias("w"), F.col("row").alias("anchor"), "block", F.lit(-space.bound).alias("lo"), F.lit(space.bound).alias("hi"))
    near = select_top(space, own, blocks, whole, positives, True, 2 * space.bound)
    p = F.col("score")
    # low * p <= 100 * n <= high * p, with n a whole number
    lo, hi = F.expr(f"(score * {low} + 99) div 100"), F.expr(f"(score * {high}) div 100")
    anchor = own.select(F.col("row").alias("w"), F.col("vec_id").alias("anchor_id"), "block")
    pairs = near.where(p >= 0).select("w", F.col("vec_id").alias("positive_id"), p.alias("positive_score"), lo.alias("lo"), hi.alias("hi")).where("lo <= hi").join(anchor.hint("merge"), "w")
    pairs = materialize(pairs.select(F.col("w").alias("anchor"), "block", "anchor_id", "positive_id", "positive_score", "lo", "hi", F.monotonically_increasing_id().alias("w")), "pairs")
    found = select_top(space, own, blocks, pairs.select("w", "anchor", "block", "lo", "hi"), negatives, False, space.bound)
    met = found.join(pairs.select("w", "anchor_id", "positive_id", "positive_score").hint("merge"), "w")
    return met.select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(read_table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)
QUALIFY row_number() OVER w <= 10
"""
