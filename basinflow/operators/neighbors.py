"""Nearest neighbours by cosine: exactly, in blocks, or through an inverted file of cells.

Both ways meet rows and queries in groups of bounded size, keyed by (cell, portion of the cell's rows, block
of the queries that probe it), where numpy multiplies them and keeps each query's first ``k``; the firsts of all groups
are ranked again. A cell that holds most rows, or draws most queries, is many groups. No side is broadcast.

Ids are longs and should be unique. Rows with a null id or vector, or with a null or non-finite component, are left out on
either side, and so are vectors of another length than most rows have; a vector of zeros is as near to everything as 0. A row is never a neighbour of a query
of its own id. Scores are taken to 12 decimals; ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.operators.windows import top_k_per_group
from basinflow.sources.shared import write_down

#: Rows and queries of a group at most, on average of hashes.
PORTION_ROWS, BLOCK_QUERIES = 8192, 2048
FOUND = "query_id long, neighbor_id long, score double"


class Index(NamedTuple):
    """Rows by cell, as written, with the bounded model that dealt them."""

    rows: DataFrame  # (cell, id, v)
    centroids: np.ndarray
    probes: int
    recall: float  # on the queries that ``probes`` was chosen by


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(sound).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length (or of zeros)."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _first_k(a: np.ndarray, b: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the best ``k`` rows of each query, ties by id."""
    s = np.round(a @ b.T, 12)  # beyond that, equal angles differ by how they were added up
    s[queries[:, None] == ids[None, :]] = -np.inf
    low = -np.inf if s.shape[1] <= k else np.partition(s, s.shape[1] - k, axis=1)[:, [-k]]
    q, r = np.nonzero((s >= low) & (s > -np.inf))
    order = np.lexsort((ids[r], -s[q, r], q))
    q, r = q[order], r[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    q, r = q[nth < k], r[nth < k]
    return queries[q], ids[r], s[q, r]


def _search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``rows`` (cell, id, v) against ``queries`` (cell, query_id, q): the ``k`` best rows of the cells that a query names."""

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "neighbor_id", "score"])
        found = _first_k(_matrix(right["q"]), _matrix(left["v"]), right["query_id"].to_numpy(), left["id"].to_numpy(), k)
        return pa.table(dict(zip(("query_id", "neighbor_id", "score"), found)))

    # One row per cell.
    portions = rows.groupBy("cell").agg(F.ceil(F.count("*") / PORTION_ROWS).cast("int").alias("portions"))
    blocks = queries.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    plan = write_down(portions.join(blocks, "cell"), "cells")
    share = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(plan, "cell").select("cell", share("id", "portions").alias("portion"), every("blocks").alias("block"), "id", "v")
    right = queries.join(plan, "cell").select("cell", every("portions").alias("portion"), share("query_id", "blocks").alias("block"), "query_id", "q")
    keys = ["cell", "portion", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, FOUND)
    return top_k_per_group(found, ["query_id"], [F.desc("score"), F.col("neighbor_id")], k).withColumnRenamed("rank_no", "rank")


def _same_length(df: DataFrame, column: str, dims: int) -> DataFrame:
    return df.where(F.size(column) == dims)


def _dims(rows: DataFrame) -> int:
    return rows.agg(F.mode(F.size("v"))).first()[0] or 0


def exact_neighbors(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, neighbor_id, score, rank): every query against all rows."""
    rows = vectors(rows, key, vector)
    dims = _dims(rows)
    asked = vectors(queries, key, vector).select(F.lit(0).alias("cell"), F.col("id").alias("query_id"), F.col("v").alias("q"))
    return _search(_same_length(rows, "v", dims).select(F.lit(0).alias("cell"), "id", "v"), _same_length(asked, "q", dims), k)


def _k_means(x: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors, by plain rounds of means; a cell that runs empty takes the worst placed vector."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        own, near = s.argmax(1), s.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(near, kind="stable")[: len(empty)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = sums / np.where(size == 0, 1, size)
    return c


def _cells(df: DataFrame, centroids: np.ndarray, key: str, vector: str, n: int) -> DataFrame:
    """``df`` (key, vector) with ``cell``, one row for each of the ``n`` nearest cells, nearest first (``place`` from 0)."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _matrix(batch.column(1)) @ centroids.T
            order = np.argsort(-s, axis=1, kind="stable")[:, :n]
            at = np.repeat(np.arange(len(s)), order.shape[1])
            yield pa.record_batch(
                [pa.array(order.ravel(), pa.int32()), pa.array(np.tile(np.arange(order.shape[1]), len(s)), pa.int32()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))],
                names=["cell", "place", key, vector],
            )

    return df.select(key, vector).mapInArrow(nearest, f"cell int, place int, {key} long, {vector} array<double>")


def build_index(rows: DataFrame, key: str, vector: str, k: int, cells: int | None = None, target: float = 0.95, sample: int = 20_000, tuned: int = 200, seed: int = 7) -> Index | None:
    """An inverted file over all rows; None if no row takes part.

    Centroids are fitted on at most ``sample`` rows, by order of a hash of their id; every row is then assigned. As many cells are probed as give
    ``target`` recall of the ``k`` neighbours of ``tuned`` rows (by another hash), which are searched exactly for that. ``cells`` is the square root of the
    rows by default, 4,096 at most, so the model is of bounded size.
    """
    points = vectors(rows, key, vector)
    dims = _dims(points)
    if not dims:
        return None
    points = write_down(_same_length(points, "v", dims), "points")
    count = points.count()
    cells = cells or min(4096, max(1, round(count**0.5)))
    drawn = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("v").toArrow()
    centroids = _k_means(_matrix(drawn["v"]), cells, seed)
    assigned = write_down(_cells(points, centroids, "id", "v", 1).select("cell", "id", "v"), "assigned")
    probe = points.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(tuned)
    near = exact_neighbors(points.withColumnRenamed("id", key).withColumnRenamed("v", vector), probe.withColumnRenamed("id", key).withColumnRenamed("v", vector), key, vector, k)
    ranked = _cells(probe.withColumnRenamed("id", "query_id"), centroids, "query_id", "v", len(centroids)).select("query_id", "cell", "place")
    homes = near.select("query_id", F.col("neighbor_id").alias("id")).join(assigned.select("cell", "id"), "id")
    places = homes.join(ranked, ["query_id", "cell"]).groupBy("place").count().collect()  # a row for each cell at most
    hits = np.zeros(len(centroids))
    for r in places:
        hits[r.place] += r["count"]
    recall = np.cumsum(hits) / max(hits.sum(), 1)
    probes = int(np.searchsorted(recall, target)) + 1 if hits.sum() else 1
    probes = min(probes, len(centroids))
    return Index(assigned, centroids, probes, float(recall[probes - 1]) if hits.sum() else 1.0)


def search_index(index: Index, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, neighbor_id, score, rank): the ``k`` best rows of the cells nearest to each query, with exact scores."""
    asked = _same_length(vectors(queries, key, vector), "v", index.centroids.shape[1])
    dealt = write_down(_cells(asked, index.centroids, "id", "v", probes or index.probes), "probes")
    return _search(index.rows, dealt.select("cell", F.col("id").alias("query_id"), F.col("v").alias("q")), k)

