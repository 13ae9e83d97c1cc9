"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if a ``depth``-byte string that covers it also starts earlier (in a
smaller doc_id, or earlier in its document). Only the first ``depth`` bytes of a
suffix matter, so suffixes are ordered by most-significant-digit passes that stop
there, and a suffix that stands alone after a pass is dropped from the next:

1. *First digit.* The digit of the suffix at s is the least hash among the
   ``GRAM``-byte grams of its first ``depth`` bytes: equal windows have equal
   digits. Neighbouring suffixes mostly share their digit, so a maximal *run* of
   them travels as one row (about one per 30 bytes of text) with a hash of all
   the bytes its windows cover.
2. *Second digit.* Rows of one first digit are sorted by that hash. A digit seen
   once leaves the sort. Rows equal in both digits are equal in every window: the
   first occurrence stays, the others are removed whole.
3. *Last digit.* Where one first digit holds different rows (the edges of
   repeats), the first row of each kind is opened: each of its windows is ordered
   by the first digit and a 64-bit hash of its ``depth`` bytes. Equal groups are
   the repeated windows; all but the earliest are removed. A run's windows travel
   as one row, eight bytes a window.

Skew. A pass first sorts inside the map task, which settles all but the earliest
member of each equal group there, so a group of any size sends one row per block
of text. A first digit with many different rows in a block is *wide*: its rows are
dealt by both digits instead of one, a mark tells the others of that digit, and
its windows are dealt one by one. A task reads its rows in sorted portions; a group
longer than a portion is thinned as it comes: of equal rows the earliest waits for the
rest, and a first digit with more different rows than a portion holds becomes wide. No
row, group or window is dropped.

Hashes are 128 bits in passes 2 and 3 (two 64-bit polynomial hashes of different
bases over randomised bytes): windows that merely collide are not expected in any
corpus that fits on disk.

Defined results: a null text is an empty text; a text under ``depth`` bytes is
left alone; rows with null or repeated doc_ids are numbered in the order (doc_id,
nulls first, then text hash), and each is a document of its own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import keyed_documents, parallelism, read_table, with_doc_id

GRAM = 32
#: Bytes of text that a task works on at a time.
BLOCK = 1 << 20
#: Rows that a task settles at a time.
PORTION = 1 << 18
#: Different second digits of one first digit in a block from which both digits deal the rows.
WIDE = 8
U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
REMOVED, CLASS, MARK, OPEN, WIDE_OPEN = range(5)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place): every input bit reaches every output bit."""
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Rolling:
    """Hashes of any substrings of ``data`` from prefix sums of a polynomial mod 2**64."""

    def __init__(self, data: np.ndarray, base: int):
        symbol = _mix(np.arange(1, 257, dtype=U) * U(base))
        n = len(data)
        power = np.full(n + 1, base, U)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(symbol[data] * power[:n], out=self.prefix[1:])
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), U)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse, out=inverse)

    def all(self, width: int) -> np.ndarray:
        n = len(self.prefix) - width
        return _mix((self.prefix[width:] - self.prefix[:n]) * self.inverse[:n])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[hi] - self.prefix[lo]) * self.inverse[lo])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def first_digits(data: np.ndarray, ends: np.ndarray, depth: int):
    """Runs (lo, hi, digit, self_repeating) of window starts; hi is the last start. Windows stay inside documents."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, bool), None)
    if len(data) < depth:
        return none
    rolling = Rolling(data, BASES[0])
    grams = rolling.all(GRAM)
    least = _sliding_min(grams, depth - GRAM + 1)
    inside = np.ones(len(least), bool)
    for end in ends.tolist():  # starts whose window would leave the document
        inside[max(0, end - depth + 1) : end] = False
    cut = np.empty(len(least), bool)
    cut[0] = True
    np.not_equal(least[1:], least[:-1], out=cut[1:])
    cut[1:] |= inside[1:] != inside[:-1]
    starts = np.flatnonzero(cut)
    stops = np.r_[starts[1:], len(least)] - 1
    # A gram that leaves while an equal one takes over: the run may hold equal windows.
    again = np.flatnonzero((grams[: len(least) - 1] == least[:-1]) & ~cut[1:])
    selfish = np.zeros(len(starts), bool)
    selfish[np.searchsorted(starts, again, side="right") - 1] = True
    keep = inside[starts]
    return starts[keep], stops[keep], least[starts[keep]], selfish[keep], rolling


def _merge(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Union of half-open ranges per document."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.r_[True, doc[1:] != doc[:-1]]
    group = np.cumsum(new) - 1
    span = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + group * span) - group * span  # the furthest end so far in this document
    begins = new.copy()
    begins[1:] |= lo[1:] > reach[:-1]
    at = np.flatnonzero(begins)
    return doc[at], lo[at], reach[np.r_[at[1:], len(doc)] - 1]


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) -> (doc, body): texts cross the network compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([pack((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc", "body"])


def _blocks(batches: Iterator[pa.RecordBatch], raw_of, extra: int = 0):
    """(doc keys, data, offsets, extra column values) of about ``BLOCK`` bytes of whole documents."""
    docs, raws, more, size = [], [], [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(2 + extra))):
            raw = raw_of(row[1])
            docs.append(row[0])
            raws.append(raw)
            more.append(row[2:])
            size += len(raw)
            if size >= BLOCK:
                yield _joined(docs, raws, more)
                docs, raws, more, size = [], [], [], 0
    if docs:
        yield _joined(docs, raws, more)


def _joined(docs, raws, more):
    offsets = np.r_[0, np.cumsum([len(r) for r in raws])].astype(np.int64)
    return np.array(docs, np.int64), np.frombuffer(b"".join(raws), np.uint8), offsets, more


ROWS = "d1 long, d2 long, doc long, lo int, hi int, kind byte"


def _rows(d1, d2, doc, lo, hi, kind) -> pa.RecordBatch:
    n = len(doc)
    return pa.record_batch(
        [
            pa.array(np.ascontiguousarray(d1).view(np.int64)),
            pa.array(np.ascontiguousarray(d2).view(np.int64)),
            pa.array(doc.astype(np.int64)),
            pa.array(lo.astype(np.int32)),
            pa.array(hi.astype(np.int32)),
            pa.array(np.broadcast_to(np.asarray(kind, np.int8), n)),
        ],
        names=["d1", "d2", "doc", "lo", "hi", "kind"],
    )


def _removed(doc, lo, hi) -> pa.RecordBatch:
    doc, lo, hi = _merge(doc, lo, hi)
    zero = np.zeros(len(doc), U)
    return _rows(_mix(doc.astype(np.int64).view(U).copy()), zero, doc, lo, hi, REMOVED)


def _map_runs(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Passes 1 and 2 inside a block of documents."""
    for docs, data, offsets, _ in _blocks(batches, lambda text: (text or "").encode()):
        lo, hi, d1, selfish, rolling = first_digits(data, offsets[1:], depth)
        if not len(lo):
            continue
        d2 = rolling.of(lo, hi + depth)
        d2 = _mix(d2 + U(3) * Rolling(data, BASES[1]).of(lo, hi + depth))
        at = np.searchsorted(offsets, lo, side="right") - 1
        doc, lo, hi = docs[at], lo - offsets[at], hi - offsets[at]
        order = np.lexsort((lo, doc, d2, d1))
        d1, d2, doc, lo, hi, selfish = (x[order] for x in (d1, d2, doc, lo, hi, selfish))
        new1 = np.r_[True, d1[1:] != d1[:-1]]
        new2 = new1 | np.r_[True, d2[1:] != d2[:-1]]
        again = ~new2
        yield _removed(doc[again], lo[again], hi[again] + depth)
        first = np.flatnonzero(new2)
        kinds = np.add.reduceat(new2.astype(np.int64), np.flatnonzero(new1))
        wide = np.repeat(kinds > WIDE, kinds)
        d1, d2, doc, lo, hi, selfish = (x[first] for x in (d1, d2, doc, lo, hi, selfish))
        kind = np.where(wide, WIDE_OPEN, np.where(selfish, OPEN, CLASS)).astype(np.int8)
        yield _rows(d1, d2, doc, lo, hi, kind)
        marks = np.unique(d1[wide])
        if len(marks):
            zero = np.zeros(len(marks), np.int64)
            yield _rows(marks, zero.view(U), zero, zero, zero, MARK)


def _portions(batches: Iterator[pa.RecordBatch], keys: int = 1, thin=None) -> Iterator[pa.Table]:
    """Rows sorted by their first ``keys`` columns, in portions of about ``PORTION`` rows that end where these change.

    A group that is longer goes through ``thin``, which gives what can be settled now
    and the few rows that the group's later rows must still meet.
    """
    held: list[pa.RecordBatch] = []
    size, limit = 0, PORTION
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < limit:
            continue
        rows = pa.Table.from_batches(held)
        last = np.ones(size, bool)
        for i in range(keys):
            key = rows.column(i).to_numpy()
            last &= key == key[-1]
        cut = size - int(last.sum())  # rows of the last group wait for the next batch
        if cut:
            yield rows.slice(0, cut)
        rows = rows.slice(cut)
        if thin and rows.num_rows > PORTION // 2:
            settled, rows = thin(rows)
            if settled.num_rows:
                yield settled
        held, size = rows.to_batches(), rows.num_rows
        limit = PORTION + size
    if held:
        yield pa.Table.from_batches(held)


def _thin_runs(rows: pa.Table, depth: int) -> tuple[pa.Table, pa.Table]:
    """Of one first digit: the first row of each second digit stays; too many of them make the digit wide, and a mark stays."""
    d1, d2, doc, lo, hi, kind = (np.array(c.to_numpy()) for c in rows.columns)
    marks, gone = np.flatnonzero(kind == MARK)[:1], np.flatnonzero(kind == REMOVED)
    own = np.flatnonzero((kind != MARK) & (kind != REMOVED))
    order = own[np.lexsort((lo[own], doc[own], d2[own]))]
    new = np.ones(len(order), bool)
    new[1:] = d2[order][1:] != d2[order][:-1]
    first, again = order[new], order[~new]
    if len(order):
        kind[first] = np.maximum.reduceat(kind[order], np.flatnonzero(new))
    hi[again] += depth
    kind[again] = REMOVED
    settled, stay = np.r_[gone, again], np.r_[marks, first]
    part = lambda at: pa.Table.from_batches([_rows(d1[at], d2[at], doc[at], lo[at], hi[at], kind[at])])
    if len(first) <= PORTION // 2:
        return part(settled), part(stay)
    kind[first] = WIDE_OPEN
    zero = np.zeros(1, np.int64)
    return part(np.r_[settled, first]), pa.Table.from_batches([_rows(d1[:1], zero, zero, zero, zero, MARK)])


def _thin_windows(rows: pa.Table, depth: int) -> tuple[pa.Table, pa.Table]:
    """Of one window of a wide first digit the earliest stays. Other digits hold few kinds, and wait whole."""
    if not rows.column(1)[0].as_py():
        return rows.slice(0, 0), rows
    doc, lo = rows.column(2).to_numpy(), rows.column(3).to_numpy()
    order = np.lexsort((lo, doc))
    again = rows.take(order[1:])
    again = again.set_column(4, "hi", pa.array(lo[order[1:]] + np.int32(depth)))
    return again.set_column(5, "hashes", pa.array([b""] * again.num_rows, pa.binary())), rows.take(order[:1])


RANGES = "d1 long, doc long, lo int, hi int, kind byte"


def _ranges(d1, doc, lo, hi, kind) -> pa.RecordBatch:
    kinds = np.broadcast_to(np.asarray(kind, np.int8), len(doc))
    return pa.record_batch(
        [pa.array(d1.view(np.int64)), pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(kinds)],
        names=["d1", "doc", "lo", "hi", "kind"],
    )


def _settle_runs(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Pass 2 over all blocks: ranges to remove, and runs to open (lo and hi are their first and last starts)."""
    for rows in _portions(batches, 1, lambda group: _thin_runs(group, depth)):
        yield from _settle_portion([c.to_numpy() for c in rows.columns], depth)


def _settle_portion(rows: list[np.ndarray], depth: int) -> Iterator[pa.RecordBatch]:
    d1, d2, doc, lo, hi, kind = rows
    done = kind == REMOVED
    yield _ranges(d1[done], doc[done], lo[done], hi[done], REMOVED)
    marked = d1[kind == MARK]
    rest = (kind != MARK) & ~done
    d1, d2, doc, lo, hi, kind = (x[rest] for x in (d1, d2, doc, lo, hi, kind))
    if not len(d1):
        return
    order = np.lexsort((lo, doc, d2, d1))
    d1, d2, doc, lo, hi, kind = (x[order] for x in (d1, d2, doc, lo, hi, kind))
    new1 = np.r_[True, d1[1:] != d1[:-1]]
    new2 = new1 | np.r_[True, d2[1:] != d2[:-1]]
    yield _ranges(d1[~new2], doc[~new2], lo[~new2], hi[~new2] + depth, REMOVED)
    heads = np.flatnonzero(new1)
    kinds = np.add.reduceat(new2.astype(np.int64), heads)
    many = np.repeat(kinds > 1, np.diff(np.r_[heads, len(d1)]))
    wide = np.isin(d1, marked) | (kind == WIDE_OPEN)
    # A class that repeats inside one of its rows is opened by its first row, whichever row says so.
    groups = np.flatnonzero(new2)
    selfish = np.repeat(np.maximum.reduceat(kind == OPEN, groups), np.diff(np.r_[groups, len(d1)]))
    opened = new2 & (many | selfish | wide)
    yield _ranges(d1[opened], doc[opened], lo[opened], hi[opened], np.where(wide[opened], WIDE_OPEN, OPEN))


WINDOWS = "d1 long, spread long, doc long, lo int, hi int, hashes binary"


def _open_runs(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Pass 3 inside a block: rows of windows (hi 0, eight bytes each from lo on), or removed ranges (no windows)."""
    for docs, data, offsets, more in _blocks(batches, zstandard.ZstdDecompressor().decompress, extra=1):
        if len(data) < depth:
            continue
        spans = [(i, r["lo"], r["hi"], r["d1"], r["kind"] == WIDE_OPEN) for i, (runs,) in enumerate(more) for r in runs]
        which, lo, hi, d1, wide = (np.array(c) for c in zip(*spans))
        # One row per run of neighbouring windows that are the block's first of their kind.
        count = hi - lo + 1
        run = np.repeat(np.arange(len(lo)), count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[run]
        begin = start + offsets[which[run]]
        w = Rolling(data, BASES[1]).of(begin, begin + depth)
        doc = docs[which[run]]
        order = np.lexsort((start, doc, w, d1[run]))
        same = np.r_[False, (w[order][1:] == w[order][:-1]) & (d1[run][order][1:] == d1[run][order][:-1])]
        again = np.zeros(len(w), bool)
        again[order] = same
        gone_doc, gone_lo, gone_hi = _merge(doc[again], start[again], start[again] + depth)
        keep = np.flatnonzero(~again)
        head = np.r_[True, (run[keep][1:] != run[keep][:-1]) | (np.diff(keep) > 1) | wide[run[keep]][1:]]
        first = keep[head]
        size = np.diff(np.r_[np.flatnonzero(head), len(keep)])
        body = w[keep].tobytes()
        cuts = np.r_[0, np.cumsum(size)] * 8
        payload = [body[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        spread = np.where(wide[run[first]], w[first].view(np.int64), 0)
        none = np.zeros(len(gone_doc), np.int64)
        yield pa.record_batch(
            [
                pa.array(np.r_[d1[run[first]], gone_doc]),
                pa.array(np.r_[spread, none]),
                pa.array(np.r_[doc[first], gone_doc]),
                pa.array(np.r_[start[first], gone_lo].astype(np.int32)),
                pa.array(np.r_[np.zeros(len(first), np.int64), gone_hi].astype(np.int32)),
                pa.array(payload + [b""] * len(gone_doc), pa.binary()),
            ],
            names=["d1", "spread", "doc", "lo", "hi", "hashes"],
        )


def _settle_windows(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Pass 3 over all blocks: equal windows of one first digit; all but the earliest are removed."""
    for rows in _portions(batches, 2, lambda group: _thin_windows(group, depth)):
        d1, doc, lo, hi = (rows.column(i).to_numpy() for i in (0, 2, 3, 4))
        bodies = rows.column(5).to_pylist()
        count = np.array([len(x) // 8 for x in bodies], np.int64)
        w = np.frombuffer(b"".join(bodies), U)
        row = np.repeat(np.arange(len(d1)), count)
        start = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count) + lo[row]
        done = hi > 0
        out = [(doc[done], lo[done].astype(np.int64), hi[done].astype(np.int64))]
        if len(w):
            order = np.lexsort((start, doc[row], w, d1[row]))
            key, digit = w[order], d1[row][order]
            again = order[np.r_[False, (key[1:] == key[:-1]) & (digit[1:] == digit[:-1])]]
            out.append((doc[row[again]], start[again], start[again] + depth))
        merged = _merge(*(np.concatenate(c) for c in zip(*out)))
        yield _ranges(np.zeros(len(merged[0]), np.int64), *merged, REMOVED)


CUT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch], with_spans: bool) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out = []
        for doc, body, ranges in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = unpack(body)
            spans: list[list[int]] = []
            for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            kept = b"".join(raw[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)]))
            out.append((doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"lo": a, "hi": b} for a, b in spans]))
        cols = list(zip(*out)) if out else [()] * 7
        arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.string())]
        names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_spans:
            arrays += [pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))]
            names += ["kept", "spans"]
        yield pa.record_batch(arrays, names=names)


def remove_repeats(docs: DataFrame, depth: int = 100, with_spans: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    ``with_spans`` adds the bytes that stay (``kept binary``) and the removed
    half-open byte ranges (``spans``).
    """
    if depth <= GRAM:
        raise ValueError(f"depth must exceed {GRAM} bytes")
    keyed, plain = keyed_documents(docs)
    n = parallelism(docs.sparkSession)
    texts = keyed.select("doc", "text")
    route = F.when(F.col("kind") == WIDE_OPEN, F.xxhash64("d1", "d2")).otherwise(F.col("d1"))
    # Sorted, so that a task settles one portion after another and never holds its whole partition.
    runs = texts.mapInArrow(lambda it: _map_runs(it, depth), ROWS).repartition(n, route).sortWithinPartitions("d1")
    settled = runs.mapInArrow(lambda it: _settle_runs(it, depth), RANGES)
    # The filter, which the inner join would add on its side alone, makes both sides the same: one exchange serves both joins.
    bodies = texts.mapInArrow(_squeeze, "doc long, body binary").where("doc IS NOT NULL")
    span = F.collect_list(F.struct("lo", "hi"))
    runs_of = F.collect_list(F.struct("d1", "lo", "hi", "kind"))
    opened = settled.where(F.col("kind").isin(OPEN, WIDE_OPEN)).groupBy("doc").agg(runs_of.alias("runs"))
    windows = (
        bodies.join(opened, "doc")
        .select("doc", "body", "runs")
        .mapInArrow(lambda it: _open_runs(it, depth), WINDOWS)
        .repartition(n, "d1", "spread")
        .sortWithinPartitions("d1", "spread")
    )
    removed = settled.where(F.col("kind") == REMOVED).unionByName(windows.mapInArrow(lambda it: _settle_windows(it, depth), RANGES))
    ranges = removed.groupBy("doc").agg(span.alias("ranges"))
    schema = CUT + (", kept binary, spans array<struct<lo:int,hi:int>>" if with_spans else "")
    cut = bodies.join(ranges, "doc", "left").select("doc", "body", "ranges").mapInArrow(lambda it: _cut(it, with_spans), schema)
    return with_doc_id(cut, keyed, plain)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read_table(spark, sf_dir, "documents"), depth=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
