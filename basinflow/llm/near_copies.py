"""Near copies by likeness: texts whose sets of five-word shingles share 0.8 or more of their union.

SimHash comes first: each shingle set has a 64-bit SimHash fingerprint, the Gray-order
index of ``simhash`` finds the fingerprints within ``BITS`` bits, and the links whose
sets are alike join their texts. At a likeness of 0.8 fingerprints differ in about ten
bits, which no exact index reaches at scale, so MinHash finds what SimHash leaves
apart: ``BANDS`` keys of ``ROWS`` least values each, and two texts that SimHash has not
joined are compared if they agree in any key. A pair of likeness s is missed with
probability (1 - s^ROWS)^BANDS, 5e-8 at 0.8 and less above; every candidate is then
decided by the exact likeness of its whole shingle sets, so nothing below the
threshold links.

Equal shingle sets are one node. The members of a bucket (the texts with one key)
are first compared with the bucket's least node, unless SimHash has joined them,, which settles a bucket of near
copies in as many comparisons as it has members. Only where a bucket is left with
several components are the pairs across these compared, in buckets cut to pairs of
blocks, so that no bucket gathers in one task; pairs that one block pair has already
linked through others are skipped, since they change no component.

Defined results: words, case and blanks as in ``simhash``; a text of fewer words than
``words`` is one shingle; texts without words are alike; a null doc_id takes part, and
stays only if its group has nothing else; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import keep_one_per_group, materialize, parallelism
from basinflow.llm.components import connected_components
from basinflow.llm.simhash import WORD, find_links

#: Bits in which linked SimHash fingerprints differ at most.
BITS = 4
BANDS, ROWS = 32, 4
#: Members of a bucket in a block, and those that meet its head in one group.
BLOCK, PORTION = 256, 1024
#: Shingles whose least values are taken at once.
CHUNK = 2048

_rng = np.random.default_rng(42)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    for m in _MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text, ascending."""
    tokens = WORD.findall((text or "").encode().lower())
    n, digest = len(tokens), xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(b" ".join(tokens), 42)] if n else [], np.uint64)
    h = np.fromiter((digest(t, 42) for t in tokens), np.uint64, n)
    out = h[: n - words + 1]
    for i in range(1, words):
        out = _mixed(out) + h[i : n - words + 1 + i]
    return np.unique(_mixed(out))


def band_keys(found: np.ndarray) -> np.ndarray:
    """``BANDS`` MinHash keys of a shingle set."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for lo in range(0, len(found), CHUNK):
        values = found[None, lo : lo + CHUNK] * _TIMES[:, None] + _PLUS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = _mixed(keys * _MIX[0] + least[:, i])
    return keys


def set_fingerprint(found: np.ndarray) -> int:
    """The SimHash of a shingle set: a bit is 1 if set in over half of its hashes. Signed, as Spark's longs are."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(found), 65_536):
        counts += np.unpackbits(found[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<i8")[0])


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two distinct-hash sets share ``least`` of their union. Two empty sets are alike."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def _set_id(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7) - (1 << 63)


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws, nodes, prints, keys = [], [], [], []
        for text in batch.column(1).to_pylist():
            found = shingles(text, words)
            raws.append(xxhash.xxh64_intdigest((text or "").encode(), 42))
            nodes.append(_set_id(found))
            prints.append(set_fingerprint(found))
            keys.append(band_keys(found).view(np.int64))
        flat = np.concatenate(keys) if keys else np.array([], np.int64)
        yield pa.record_batch(
            [
                batch.column(0),
                pa.array(np.array(raws, np.uint64).view(np.int64)),
                pa.array(nodes, pa.int64()),
                pa.array(prints, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(raws) + 1) * BANDS, pa.int32()), pa.array(flat)),
            ],
            names=["doc_id", "raw", "node", "fp", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            found = [shingles(t, words) for t in batch.column(0).slice(lo, 256).to_pylist()]
            yield pa.record_batch([pa.array([_set_id(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "body"])


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(src, dst, body, other) -> the pairs that are alike."""
    for batch in batches:
        src, dst = batch.column(0), batch.column(1)
        ok = [alike(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), least) for a, b in zip(batch.column(2), batch.column(3))]
        yield pa.record_batch([src, dst], names=["src", "dst"]).filter(pa.array(ok, pa.bool_()))
        del batch
        pa.default_memory_pool().release_unused()  # workers live on; what this stage needed is given back


def _across(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, p, q, block, node, component, body) of whole block pairs -> the links across components.

    A pair whose ends are already in one component here is skipped.
    """
    group: list[tuple] = []
    at = None

    def links() -> pa.RecordBatch:
        _, p, q = at
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        src, dst = [], []
        left = [m for m in group if m[0] == p]
        right = left if p == q else [m for m in group if m[0] == q]
        for i, (_, a, ca, x) in enumerate(left):
            for _, b, cb, y in right[i + 1 :] if p == q else right:
                if root(ca) != root(cb) and alike(x, y, least):
                    parent[root(ca)] = root(cb)
                    src.append(a)
                    dst.append(b)
        return pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    for batch in batches:
        k, p, q, block, node, comp = (batch.column(i).to_pylist() for i in range(6))
        for i, body in enumerate(batch.column(6)):
            if at != (k[i], p[i], q[i]):
                if len(group) > 1:
                    yield links()
                group, at = [], (k[i], p[i], q[i])
            group.append((block[i], node[i], comp[i], np.frombuffer(body.as_py(), np.uint64)))
    if len(group) > 1:
        yield links()


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(src, dst): nodes of (node, fp) that SimHash proposes, at most one less than there are nodes. Nodes of one fingerprint meet the least of them, which stands for it in the index's links."""
    codes = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "codes")
    links = materialize(find_links(codes.select("fp"), codes.count(), BITS), "code_links")
    one, two = (codes.select(F.col("fp").alias(fp), F.col("first").alias(node)) for fp, node in (("_one", "src"), ("_two", "dst")))
    across = links.select(F.col("src").alias("_one"), F.col("dst").alias("_two")).join(one, "_one").join(two, "_two").select("src", "dst")
    equal = nodes.join(codes, "fp").where("node <> first").select(F.col("node").alias("src"), F.col("first").alias("dst"))
    return equal.unionByName(across.where("src <> dst")).distinct()


def _alike_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of (src, dst) the pairs that are alike.

    A ``dst`` meets its pairs in portions, so that the head of a bucket of most texts is no hot key; its set is repeated once for each.
    """
    portions = F.ceil(F.col("n") / PORTION).cast("int")
    sizes = materialize(pairs.groupBy("dst").agg(F.count("*").alias("n")).select("dst", portions.alias("parts")), "degrees")
    dealt = pairs.join(sizes, "dst").select("src", "dst", F.pmod(F.xxhash64("src"), F.col("parts")).cast("int").alias("part"))
    one = sets.select(F.col("node").alias("src"), "body")
    two = sets.join(sizes, F.col("node") == F.col("dst")).select("dst", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("body").alias("other"))
    both = dealt.join(one, "src").join(two, ["dst", "part"]).select("src", "dst", "body", "other")
    return both.mapInArrow(lambda it: _verify(it, least), "src long, dst long")


def likeness_links(docs: DataFrame, signed: DataFrame, words: int, least: float) -> DataFrame:
    """(src, dst): links of nodes with the same components as all candidate pairs of likeness ``least`` or more."""
    spark = docs.sparkSession
    nodes = signed.groupBy("node").agg(F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    proposed = materialize(simhash_pairs(nodes.select("node", "fp")), "proposed")
    member = nodes.select("node", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared, "buckets")
    member = materialize(member.join(shared, "key"), "members")
    # The texts behind candidates, and only those, are read again.
    wanted = member.select("node").unionByName(proposed.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    rows = signed.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "raw")).alias("r"))
    rows = materialize(rows.select(F.col("r.doc_id").alias("_doc"), F.col("r.raw").alias("_raw")).distinct(), "wanted")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_raw"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    sets = texts.join(rows, same, "left_semi").select("_text").mapInArrow(lambda it: _sets(it, words), "node long, body binary")
    sets = materialize(sets.dropDuplicates(["node"]), "sets")

    hashed = materialize(_alike_pairs(proposed, sets, least), "hashed")
    joined = materialize(connected_components(hashed), "joined")
    of = lambda node, name: joined.select(F.col("node").alias(node), F.col("component").alias(name))
    pairs = member.where("node <> head").select(F.col("node").alias("src"), F.col("head").alias("dst")).distinct()
    apart = pairs.join(of("src", "_s"), "src", "left").join(of("dst", "_d"), "dst", "left").where("NOT coalesce(_s = _d, false)").select("src", "dst")
    stars = materialize(hashed.unionByName(_alike_pairs(materialize(apart, "apart"), sets, least)), "stars")

    found = materialize(connected_components(stars), "found")
    placed = member.select("node", "key").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    # Blocks by a count of the bucket's size that is known; which block a node falls in does not matter.
    placed = materialize(placed.join(shared.select("key", "n"), "key"), "placed")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    left = placed.join(materialize(open_keys, "open"), "key", "left_semi")
    # Buckets with the same members need one search.
    size = F.ceil(F.col("n") / BLOCK).cast("int")
    blocks = left.withColumn("size", size).withColumn("block", F.pmod(F.xxhash64("node"), F.col("size")).cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "component")
    dealt = dealt.join(sets, "node").select("key", "p", "q", "block", "node", "component", "body")
    dealt = dealt.repartition(parallelism(spark), "key", "p", "q").sortWithinPartitions("key", "p", "q")
    across = dealt.mapInArrow(lambda it: _across(it, least), "src long, dst long")
    return stars.unionByName(materialize(across, "across"))


def near_copy_groups(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, raw, grp) for every row of ``docs``: ``raw`` is the text's ``xxhash64``, rows of one ``grp`` are near copies."""
    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = frame.mapInArrow(lambda it: _signed(it, words), "doc_id long, raw long, node long, fp long, keys array<long>")
    signed = materialize(signed, "signed")
    linked = materialize(connected_components(likeness_links(docs, signed, words, least)), "near")
    return signed.join(linked, "node", "left").select("doc_id", "raw", F.coalesce("component", "node").alias("grp"))


def drop_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest (doc_id, text hash), null ids last. All columns stay."""
    return keep_one_per_group(docs, near_copy_groups(docs, words, least))
