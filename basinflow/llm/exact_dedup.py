"""Exact dedup by a log-structured merge index.

Each map task is a writer. It fills a *memtable* (one Arrow batch): equal texts
in it are found by digest and compared byte by byte, and one representative per
text is kept with the number of rows it stands for. Memtables are flushed to a
log, and the index takes the log's representatives in batches that double in size.

A batch is grouped by digest and meets the *runs* of the index, tables that are
bucketed and sorted. Each run has a *filter*: its sorted *tags*, the first ``TAG``
bytes of its digests. The batch merges with the filter first; only entries that
pass it are looked up in the run, and a run that no entry passes to is not read.
Entries that no run has are new. An entry that a run has is a hit: it goes into the
new run with the better identifier of the two and the rows of both, so that the
newest entry of a digest tells all. A level of ``fanout`` runs is compacted into
one run of the next level, which keeps the newest entry of each digest.

The texts behind digests that two memtables share, and only those, are read again
and grouped by their bytes, so that two texts that merely share a digest stay apart.

One memtable sends one row per text however many copies it holds, so a group
with a third of all rows reaches the index as one row per memtable. Rows of texts that
occur once are never joined with anything but the index's repeated digests.

Defined results: a null text counts as empty; rows with a null doc_id are
ordinary rows that lose against any row with an id; of rows that tie on doc_id
the first in file order stays; an empty table gives an empty result; extra
columns are ignored (``drop_duplicates_exact`` carries them through).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import Run, buckets_for, doubling_batch, first_batch, free_name, materialize, read_table, small_batches, table_path, write_run

#: Bytes of a digest that its tag holds: 1 in 2**40 / (entries of a run) passes a filter in vain.
TAG = 5
LOG_SCHEMA = "doc_id long, row_no long, digest binary, rep_no long, n_rows long, raw long"


def _memtables(batches: Iterator[pa.RecordBatch], sign: int) -> Iterator[pa.RecordBatch]:
    part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    seen = 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        first: dict[tuple[bytes, int], tuple] = {}
        own, hashes = [], []
        held: dict[bytes, list[bytes]] = {}
        for i, text in enumerate(texts):
            plain = (text or "").encode()
            hashes.append(xxhash.xxh64_intdigest(plain, 42))
            raw = plain.lower()  # bytes.lower() touches A-Z only
            digest = hashlib.sha256(raw).digest()
            same = held.setdefault(digest, [])
            k = next((k for k, x in enumerate(same) if x == raw), len(same))
            if k == len(same):
                same.append(raw)
            own.append((digest, k))
            rank = (ids[i] is not None, sign * (ids[i] or 0), -i)
            if (best := first.get((digest, k))) is None or rank > best[0]:
                first[digest, k] = (rank, part + seen + i, (best[2] if best else 0) + 1)
            else:
                first[digest, k] = (*best[:2], best[2] + 1)
        order = sorted(range(len(own)), key=lambda i: own[i][0])  # a run is sorted by digest
        rows = [part + seen + i for i in order]
        reps = [first[own[i]] for i in order]
        yield pa.record_batch(
            [
                pa.array([ids[i] for i in order], pa.int64()),
                pa.array(rows, pa.int64()),
                pa.array([own[i][0] for i in order], pa.binary()),
                pa.array([r[1] for r in reps], pa.int64()),
                pa.array([r[2] if r[1] == row else 0 for r, row in zip(reps, rows)], pa.int64()),
                pa.array(np.array(hashes, np.uint64)[order].view(np.int64)),
            ],
            names=["doc_id", "row_no", "digest", "rep_no", "n_rows", "raw"],
        )
        seen += len(own)


def flush_log(docs: DataFrame, keep: str, rows: int, base: int) -> tuple[DataFrame, int]:
    """The log, a row per document with its batch, and the number of batches; ``n_rows`` > 0 marks a memtable's representatives."""
    spark = docs.sparkSession
    sign = 1 if keep == "largest" else -1
    batch, batches = doubling_batch(F.col("row_no"), rows, base)
    log = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _memtables(it, sign), LOG_SCHEMA)
    path = table_path(spark, "log")
    with small_batches(spark):
        log.withColumn("batch", F.when(F.col("n_rows") > 0, batch).otherwise(-1)).write.partitionBy("batch").parquet(path)
    return spark.read.schema(LOG_SCHEMA + ", batch int").parquet(path), batches


def _order(keep: str) -> F.Column:
    """Rows rank by this struct; the greatest stays."""
    doc = F.col("doc_id") if keep == "largest" else -F.col("doc_id")
    return F.struct(F.col("doc_id").isNotNull().alias("known"), doc.alias("rank"), (-F.col("row_no")).alias("row"))


class DigestIndex:
    """Levels of runs (tag, digest, n, n_reps, top): the rows and memtables that had a digest so far, and the best identifier."""

    def __init__(self, buckets: int, fanout: int = 2):
        self.buckets, self.fanout = buckets, fanout
        self.levels: list[list[Run]] = []
        self.filters: dict[str, Run] = {}  # by the name of the run; written when the run is first probed

    def add(self, reps: DataFrame, keep: str) -> None:
        """Add a batch of representatives (digest, doc_id, row_no, raw, n_rows)."""
        tag = F.conv(F.hex(F.substring("digest", 1, TAG)), 16, 10).cast("long")
        top = F.max(F.struct(_order(keep).alias("o"), "doc_id", "raw")).alias("top")
        counts = reps.select("*", tag.alias("tag")).groupBy("tag", "digest").agg(F.sum("n_rows").alias("n"), F.count("*").alias("n_reps"), top)
        if not self.levels:
            return self._push(0, counts)
        batch = write_run(counts, "tag", "batch", self.buckets)
        hits = self.hits(batch.frame)
        if hits is None:
            self._push(0, batch.frame)
        else:
            fresh = batch.frame.join(hits.select("tag", "digest"), ["tag", "digest"], "left_anti")
            grown = hits.select(
                "tag", "digest", (F.col("n") + F.col("had.n")).alias("n"), (F.col("n_reps") + F.col("had.n_reps")).alias("n_reps"),
                F.greatest("top", "had.top").alias("top"),
            )
            self._push(0, fresh.unionByName(grown))
        batch.drop()

    def hits(self, batch: DataFrame) -> DataFrame | None:
        """The rows of ``batch`` whose digest a run has, with the newest entry (``had``), or None."""
        runs = [r for level in self.levels for r in level]
        probes = [batch.join(self.filter_of(run).frame.hint("merge"), "tag", "left_semi").withColumn("run", F.lit(i)) for i, run in enumerate(runs)]
        passed = materialize(reduce(DataFrame.unionByName, probes), "passed")
        entry = F.struct("n", "n_reps", "top").alias("had")
        # A run whose filter lets nothing pass isn't read.
        found = [
            passed.where(F.col("run") == r.run).drop("run").join(runs[r.run].frame.select("tag", "digest", entry), ["tag", "digest"])
            for r in passed.groupBy("run").count().collect()
        ]
        if not found:
            return None
        own = [F.first(c).alias(c) for c in ("n", "n_reps", "top")]
        met = reduce(DataFrame.unionByName, found).groupBy("tag", "digest").agg(*own, F.max("had").alias("had"))
        met = materialize(met, "hits")
        return None if met.isEmpty() else met

    def _push(self, level: int, entries: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(write_run(entries, "tag", f"run{level}", self.buckets))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._newest([run.frame for run in old]))
            for run in old:
                self._drop(run)

    def filter_of(self, run: Run) -> Run:
        """The sorted tags of a run."""
        if run.name not in self.filters:
            self.filters[run.name] = write_run(run.frame.select("tag").distinct(), "tag", "filter", self.buckets)
        return self.filters[run.name]

    def _drop(self, run: Run) -> None:
        run.drop()
        if tags := self.filters.pop(run.name, None):
            tags.drop()

    def _newest(self, runs: list[DataFrame]) -> DataFrame:
        newest = reduce(DataFrame.unionByName, runs).groupBy("tag", "digest").agg(F.max(F.struct("n", "n_reps", "top")).alias("e"))
        return newest.select("tag", "digest", "e.n", "e.n_reps", "e.top")

    def repeated(self) -> DataFrame:
        """(digest, keep_id, keep_row, keep_raw, group_size, n_reps) of every digest of several rows."""
        runs = [run.frame.where("n > 1") for level in self.levels for run in level]
        return self._newest(runs).select("digest", *_winner(F.col("n")), "n_reps")

    def drop(self) -> None:
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []


def _winner(size: F.Column) -> list[F.Column]:
    return [F.col("top.doc_id").alias("keep_id"), (-F.col("top.o.row")).alias("keep_row"), F.col("top.raw").alias("keep_raw"), size.alias("group_size")]


def dedup_index(docs: DataFrame, keep: str = "largest", base: int | None = None, fanout: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_no, digest, raw, keep_id, keep_row, keep_raw, group_size.

    ``raw`` is the text's ``xxhash64``; with doc_id it finds a row again.

    ``keep`` is ``largest`` or ``smallest`` (doc_id of the row that stays); ``base``: rows of the first batch, one in 4 by default.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep: largest or smallest")
    rows = docs.count()
    log, batches = flush_log(docs, keep, rows, base or first_batch(rows))
    reps = log.where("batch >= 0")
    index = DigestIndex(buckets_for(docs.sparkSession, rows), fanout)
    for b in range(batches):
        index.add(log.where(F.col("batch") == b), keep)
    repeated = materialize(index.repeated(), "repeated")
    index.drop()
    hits = reps.join(repeated.where("n_reps > 1").select("digest"), "digest", "left_semi")
    clash = materialize(_clashes(docs, hits), "clash")
    columns = ["doc_id", "row_no", "digest", "raw", "keep_id", "keep_row", "keep_raw", "group_size"]
    own = {"keep_id": "doc_id", "keep_row": "row_no", "keep_raw": "raw"}
    met = log.join(repeated, "digest", "left").withColumn("alone", F.col("group_size").isNull())
    met = met.withColumns({k: F.when(F.col("alone"), F.col(v)).otherwise(F.col(k)) for k, v in own.items()})
    met = met.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    if clash.isEmpty():
        return met.select(columns)
    # Texts that share a digest: their bytes part them.
    bodies = _bodies(docs, hits.join(clash, "digest", "left_semi")).withColumnRenamed("doc_id", "_doc")
    parted = hits.join(bodies, F.col("doc_id").eqNullSafe(F.col("_doc")) & (hits.digest == bodies.digest)).select(hits["*"], "body")
    top = F.max(F.struct(_order(keep).alias("o"), "doc_id", "raw")).alias("top")
    groups = parted.groupBy("digest", "body").agg(top, F.sum("n_rows").alias("n")).select("digest", "body", *_winner(F.col("n")))
    by_rep = parted.join(groups, ["digest", "body"]).select(F.col("row_no").alias("rep_no"), "keep_id", "keep_row", "keep_raw", "group_size")
    apart = log.join(by_rep, "rep_no").select(columns)
    return met.join(clash, "digest", "left_anti").select(columns).unionByName(apart)


def _bodies(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The normalised bytes behind hits, once per (doc_id, digest, bytes)."""
    wanted = materialize(hits.select(F.col("doc_id").alias("_hit")).distinct(), "hits")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_hit")), "left_semi")
    return found.mapInArrow(_normal_texts, "doc_id long, digest binary, body binary").distinct()


def _clashes(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests that stand for more than one text."""
    bodies = _bodies(docs, hits).select("digest", "body").distinct()
    return bodies.groupBy("digest").count().where("count > 1").select("digest")


def _normal_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws = [(t or "").encode().lower() for t in batch.column(1).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), pa.array([hashlib.sha256(r).digest() for r in raws], pa.binary()), pa.array(raws, pa.binary())],
            names=["doc_id", "digest", "body"],
        )


def drop_duplicates_exact(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``docs`` with one row of each group of equal texts; every column is kept."""
    index = dedup_index(docs, keep)
    same_row = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw"))
    lost = materialize(index.where("row_no <> keep_row").select("doc_id", "raw", same_row.alias("twin")), "lost")
    mark, code, raw = (free_name(docs, name) for name in ("lost_id", "lost_raw", "own_raw"))
    named = [F.col("doc_id").alias(mark), F.col("raw").alias(code)]
    gone = lost.where("not twin").select(*named).distinct()
    twins = lost.where("twin").select(*named).distinct()
    hashed = docs.withColumn(raw, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(mark)) & (F.col(raw) == F.col(code))
    left = hashed.join(gone, same, "left_anti")
    # Rows that repeat an id and a text: one of them stays.
    rest = left.join(twins, same, "left_anti")
    return rest.unionByName(left.join(twins, same, "left_semi").dropDuplicates(["doc_id", raw])).drop(raw)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    index = dedup_index(read_table(spark, sf_dir, "documents"), keep="largest")
    return index.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row_no") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP9_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
