"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints come from word shingles (see ``simhash_fingerprints``). Two
fingerprints link at ``max_bits`` or fewer differing bits; documents group by the
links' connected components.

The index. Distinct fingerprints are sorted by Gray rank, so that neighbours differ
in few bits. Runs of ``FAN`` make nodes that store the bit pattern all their members
share and the mask of those bits; runs of nodes make upper nodes, up to a root of at
most ``FAN``. A search goes down from pairs of the uppermost nodes. A pair brings
the differences that its parents have accumulated and adds those in the bits that
its own nodes share and its parents did not; above ``max_bits`` it is dropped with
all it holds. Pairs of nodes whose members are all in one component already are
dropped too, so a dense group isn't searched pair by pair.

Partitions. Up to ``HOT`` fingerprints are one index. More are cut into groups of
about ``GROUP``, each with an index of its own: 64 bits are cut into blocks;
fingerprints within ``max_bits`` agree in at least ``blocks - max_bits`` whole
blocks, so every choice of that many blocks, or some of its bits, is the key of a
*table* of groups, and each link lies within a group of some table. A key takes
only as many bits as make groups of ``GROUP``; more blocks are used when the bits
of fewer don't suffice, so groups keep their size at any scale and no link is lost.
Groups of over ``HOT`` are searched in the finest tables instead (32 bits at 4
bits' distance), whose random groups hold a few rows.

Groups arrive sorted and are searched one after another, so a task holds one group
at a time. A group reports a spanning forest of its links: m fingerprints send at most
m - 1 edges. Equal fingerprints are merged before the search (a grouped minimum), so
thousands of copies are one entry.

Defined results: a null, empty or blank text has fingerprint zero and links like
any other; repeated rows and ties share a fingerprint and so a component; a null
doc_id takes part and never names a component unless nothing else does; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import keep_one_per_group, materialize, parallelism, read_table
from basinflow.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Members of a node of the index.
FAN = 4
#: Codes of a random group.
GROUP = 2048
#: Codes that one index holds at most, unless its keys are the finest.
HOT = 16_384
#: Pairs of nodes that are opened at once.
STEP = 1 << 15


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """SimHash of one text: a bit is 1 if set in over half of the shingles' XXH64 values."""
    tokens = WORD.findall((text or "").encode().lower())
    if not tokens:
        return 0
    line = b" ".join(tokens)
    n = len(tokens)
    if n <= words:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = (ends[: n - words + 1] - np.fromiter(map(len, tokens[: n - words + 1]), np.int64, n - words + 1)).tolist()
    stops = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * counts > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def simhash_fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long): A-Z lower-cased, words are runs of non-blank bytes, shingles of ``words`` words."""
    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return frame.mapInArrow(lambda it: _fingerprints(it, words), "doc_id long, fp long")


def tables(n: int, max_bits: int) -> list[int]:
    """Masks of the tables for n distinct fingerprints: the fewest blocks whose keys can part them into groups of ``GROUP``."""
    if n <= HOT:
        return [0]
    width = (n // GROUP).bit_length()
    for blocks in range(max_bits + 1, max_bits + 5):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        choices = [[b for i in c for b in range(edges[i], edges[i + 1])] for c in combinations(range(blocks), blocks - max_bits)]
        if width <= min(map(len, choices)):
            break
    return [sum(1 << b for b in bits[:width]) for bits in choices]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class Forest:
    """Components of 0..n-1, and the links that made them. ``label`` is each element's root."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for lo in range(0, len(i), 1 << 14):
            a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
            x, y = self.label[a], self.label[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                continue
            # one link per pair of components is enough
            _, first = np.unique(np.minimum(x, y)[apart] * len(self.label) + np.maximum(x, y)[apart], return_index=True)
            parent: dict[int, int] = {}
            for k in apart[first].tolist():
                p, q = int(x[k]), int(y[k])
                while p in parent:
                    p = parent[p]
                while q in parent:
                    q = parent[q]
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    self.links.append((int(a[k]), int(b[k])))
            roots = np.arange(len(self.label))
            for p, q in parent.items():
                roots[p] = q
            while (deeper := roots[roots] != roots).any():
                roots[deeper] = roots[roots[deeper]]
            self.label = roots[self.label]


class GrayIndex:
    """The hierarchical index over distinct codes sorted by Gray rank; ``opened`` and ``pruned`` count pairs of upper nodes."""

    def __init__(self, codes: np.ndarray):
        self.levels = [(codes, np.full(len(codes), np.uint64(2**64 - 1)))]
        while len(self.levels[-1][0]) > FAN:
            pattern, mask = self.levels[-1]
            at = np.arange(0, len(pattern), FAN)
            ones = np.bitwise_and.reduceat(pattern & mask, at)
            zeros = np.bitwise_and.reduceat(~pattern & mask, at)
            self.levels.append((ones, ones | zeros))
        self.opened = self.pruned = 0

    def search(self, max_bits: int, forest: Forest | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs (i, j), i < j. With a ``forest``, which the caller keeps up, pairs that are one component already may be left out."""
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, i, j, np.zeros(len(i), np.uint8), np.zeros(len(i), np.uint64))]
        while stack:
            depth, i, j, apart, common = stack.pop()
            pattern, mask = self.levels[depth]
            shared = mask[i] & mask[j]
            # the parents' differences, and those in bits that only now are shared
            apart = apart + np.bitwise_count((pattern[i] ^ pattern[j]) & shared & ~common)
            near = apart <= max_bits
            if depth == 0:
                near &= i < j
                if near.any():
                    yield i[near], j[near]
                continue
            if forest is not None:
                low, high = self._components(depth, forest.label)
                near &= (low[i] != high[i]) | (low[i] != low[j]) | (low[j] != high[j])
            self.opened += int(near.sum())
            self.pruned += int(len(near) - near.sum())
            i, j, apart, common = i[near], j[near], apart[near], shared[near]
            for lo in range(0, len(i), STEP):
                part = slice(lo, lo + STEP)
                stack.append((depth - 1, *self._below(depth, i[part], j[part], apart[part], common[part])))

    def _below(self, depth: int, i, j, apart, common):
        step = np.arange(FAN)
        a = np.repeat(i * FAN, FAN * FAN) + np.tile(np.repeat(step, FAN), len(i))
        b = np.repeat(j * FAN, FAN * FAN) + np.tile(step, len(j) * FAN)
        ok = (a <= b) & (b < len(self.levels[depth - 1][0]))
        return a[ok], b[ok], np.repeat(apart, FAN * FAN)[ok], np.repeat(common, FAN * FAN)[ok]

    def _components(self, depth: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(label), FAN**depth)
        return np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)


def hamming_links(codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j), i < j, of all linked pairs of distinct codes sorted by Gray rank."""
    found = list(GrayIndex(codes).search(max_bits))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(i for i, _ in found)]), np.concatenate([none, *(j for _, j in found)])


def group_forest(codes: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of a group's links, as indices into its codes, which are sorted by Gray rank."""
    forest = Forest(len(codes))
    for i, j in GrayIndex(codes).search(max_bits, forest):
        forest.add(i, j)
    return forest.links


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The codes of each group, from rows (t, k, fp) that are sorted by (t, k)."""
    held: list[np.ndarray] = []
    at = None
    for batch in batches:
        t, k, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(t):
            continue
        starts = np.r_[0, np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1, len(t)].tolist()
        for lo, hi in zip(starts, starts[1:]):
            if held and at != (t[lo], k[lo]):
                yield np.concatenate(held)
                held = []
            at = (t[lo], k[lo])
            held.append(fp[lo:hi])
    if held:
        yield np.concatenate(held)


def _search(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (t, k, fp) of whole groups -> edges."""
    edges: list[np.ndarray] = []
    size = 0

    def sent() -> pa.RecordBatch:
        out = np.concatenate([np.zeros((0, 2), np.int64), *edges])
        return pa.record_batch([pa.array(np.ascontiguousarray(out[:, c])) for c in (0, 1)], names=["src", "dst"])

    for fp in _whole_groups(batches):
        if len(fp) > 1:
            code = fp.view(np.uint64)
            order = np.argsort(gray_rank(code))
            links = group_forest(code[order], max_bits)
            if links:
                edges.append(fp[order][np.array(links)])
                size += len(links)
        if size > 100_000:
            yield sent()
            edges, size = [], 0
    yield sent()


def _in_tables(codes: DataFrame, masks: list[int]) -> DataFrame:
    """(t, k, fp): each code (fp) once per table, keyed by its bits under the table's mask."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)]
    return codes.select(F.explode(F.array(*keys)).alias("g"), "fp").select("g.t", "g.k", "fp")


def _group_links(keyed: DataFrame, max_bits: int) -> DataFrame:
    # One entry per distinct code: a key that holds many documents is still small.
    dealt = keyed.repartition(parallelism(keyed.sparkSession), "t", "k").sortWithinPartitions("t", "k")
    return dealt.mapInArrow(lambda it: _search(it, max_bits), "src long, dst long")


def find_links(codes: DataFrame, n: int, max_bits: int) -> DataFrame:
    """(src, dst): edges over the n distinct codes (fp) with the same components as all their links.

    A group of over ``HOT`` codes is not searched as it is: its codes are searched
    in the finest tables instead, which are complete by themselves.
    """
    masks, finest = tables(n, max_bits), tables(1 << 62, max_bits)
    keyed = _in_tables(codes, masks)
    if masks == finest:
        return _group_links(keyed, max_bits)
    hot = materialize(keyed.groupBy("t", "k").count().where(F.col("count") > HOT).select("t", "k"), "hot")
    if hot.isEmpty():
        return _group_links(keyed, max_bits)
    dense = materialize(keyed.join(hot, ["t", "k"], "left_semi").select("fp").distinct(), "dense")
    return _group_links(keyed.join(hot, ["t", "k"], "left_anti"), max_bits).unionByName(_group_links(_in_tables(dense, finest), max_bits))


def near_components(fingerprints: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, component_id) for every distinct ``fp`` of (doc_id, fp): the smallest doc_id it reaches by links."""
    distinct = materialize(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    edges = find_links(distinct.select("fp"), distinct.count(), max_bits)
    linked = connected_components(materialize(edges, "links"))
    linked = materialize(linked, "components")
    least = distinct.withColumnRenamed("fp", "node").join(linked, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    return distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    fps = materialize(simhash_fingerprints(docs, words), "fingerprints")
    named = materialize(near_components(fps, max_bits), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest (doc_id, text hash), null ids last. All columns stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text"))
    prints = materialize(simhash_fingerprints(keyed, words).withColumnRenamed("doc_id", "raw").distinct(), "fingerprints")
    codes = materialize(prints.select("fp").distinct(), "codes")
    linked = connected_components(materialize(find_links(codes, codes.count(), max_bits), "links"))
    groups = prints.join(materialize(linked.withColumnRenamed("node", "fp"), "components"), "fp", "left")
    groups = materialize(groups.select("raw", F.coalesce("component", "fp").alias("grp")), "raws")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("raw"))
    return keep_one_per_group(docs, rows.join(groups, "raw"))


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
