"""The document operators on odd rows, against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from basinflow.llm import chat, common, exact_dedup, fingerprints, line_dedup, mixing, packing, quality, simhash, suffix_dedup
from basinflow.llm.components import connected_components
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def rows(spark):
    return fx.odd_documents(spark)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return fx.frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return fx.frame(spark, [])


def key(x):
    return (x[0] is not None, *map(str, x))


def test_line_dedup(docs, rows, empty):
    got = line_dedup.dedup_lines(docs, min_docs=10, base=4, fanout=2).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=key) == sorted(fx.line_dedup([r[:2] for r in rows], 10), key=key)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_index_compacts_and_counts(spark, monkeypatch):
    batches = [["a", "b", "a"], ["b", "c"], ["a"], ["c", "c", "d", "a"], ["e", "a"]]
    keys = lambda b: spark.createDataFrame([(k,) for k in b], "key string")
    index = line_dedup.LineIndex(min_docs=3, buckets=4, fanout=2)
    fresh = []
    for b in batches:
        fresh.append(sorted({r.key for r in index.unseen(keys(b)).collect()}))
        index.add(keys(b))
    assert fresh == [["a", "b"], ["c"], [], ["d"], ["e"]]
    assert {r.key for r in index.common().collect()} == {"a", "c"}
    newest = {r.key: r.n for r in index._newest(index.runs()).collect()}
    assert newest == {"a": 3, "b": 2, "c": 3, "d": 1, "e": 1}  # "a" was settled at 3
    assert len(index.levels) > 1 and all(len(level) < 2 for level in index.levels)
    # merges move no rows of a run
    batch = common.write_run(keys("abc"), "key", "batch", 4).frame
    assert "Exchange" not in index.unseen(batch)._jdf.queryExecution().executedPlan().toString()
    index.drop()
    # without the anti-join, counts come out wrong
    monkeypatch.setattr(line_dedup.LineIndex, "unseen", lambda self, batch: batch.limit(0))
    blind = line_dedup.LineIndex(min_docs=2, buckets=4, fanout=2)
    for b in batches:
        blind.add(keys(b))
    assert {r.key for r in blind.common().collect()} != {"a", "b", "c"}


def test_batches_double(spark):
    batch, n = common.doubling_batch(F.col("id"), 1 << 14, 1 << 10)
    sizes = Counter(r.b for r in spark.range(1 << 14).select(batch.alias("b")).collect())
    assert n == 5 and sorted(sizes) == list(range(n))
    assert all(abs(sizes[b] - (1 << 10 << max(0, b - 1))) < 150 << b for b in range(n))
    assert common.doubling_batch(F.col("id"), 0, 10)[1] == common.doubling_batch(F.col("id"), 9, 10)[1] == 1


def test_suffix_dedup(docs, rows, empty):
    got = suffix_dedup.remove_repeats(docs, depth=100, with_spans=True).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    # rows that share an id are numbered by text hash; put ours in that order
    numbered = {}
    for r in order:
        numbered.setdefault(r[0], []).append(r[1])
    ties = {d: [t for t in ts] for d, ts in numbered.items()}
    signed = lambda t: (-(2**63) if t is None else 0, 0 if t is None else int(np.array(xxhash.xxh64_intdigest(t, 42), np.uint64).view(np.int64)))
    null_hash = 42
    texts, ids = [], []
    for d, ts in ties.items():
        for t in sorted(ts, key=lambda t: null_hash if t is None else signed(t)[1]):
            ids.append(d)
            texts.append(t or "")
    want = [(d, len(t.encode()), kept, spans) for d, t, (kept, spans) in zip(ids, texts, fx.repeats(texts, 100))]
    have = [(r.doc_id, r.n_bytes, bytes(r.kept), [(s.lo, s.hi) for s in r.spans]) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert all(r.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest() for r in got)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_exact_dedup(docs, rows, empty):
    got = exact_dedup.dedup_index(docs, "largest").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[fx.lower(r[1] or "")].append(r[0])
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        want += [(i, max(known, default=None), len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted([(r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.row_no == r.keep_row for r in got) == len(groups)
    kept = exact_dedup.drop_duplicates_exact(docs).collect()
    assert len(kept) == len(groups) and len(kept[0]) == len(docs.columns)
    small = {r.keep_id for r in exact_dedup.dedup_index(docs, "smallest").collect()}
    assert small - {None} == {min(i for i in ids if i is not None) for ids in groups.values() if any(i is not None for i in ids)}
    assert exact_dedup.drop_duplicates_exact(empty).count() == 0


def test_digest_index_probes_filters_and_compacts(spark, docs, monkeypatch):
    want = sorted(map(tuple, exact_dedup.dedup_index(docs).select("doc_id", "digest", "keep_id", "group_size").collect()), key=key)
    passed, levels = [], []
    hits = exact_dedup.DigestIndex.hits

    def watched(self, batch):
        levels.append([len(level) for level in self.levels])
        for run in (r for level in self.levels for r in level):
            passed.append((batch.join(self.filter_of(run).frame, "tag", "left_semi").count(), batch.count()))
        return hits(self, batch)

    monkeypatch.setattr(exact_dedup.DigestIndex, "hits", watched)
    small = exact_dedup.dedup_index(docs, base=4, fanout=2).select("doc_id", "digest", "keep_id", "group_size")
    assert sorted(map(tuple, small.collect()), key=key) == want
    assert any(0 < n < m for n, m in passed) and any(n == 0 for n, _ in passed)  # some runs are read for a few entries, some not at all
    assert max(map(len, levels)) > 1
    # a filter that lets nothing pass loses the hits between batches
    monkeypatch.setattr(exact_dedup.DigestIndex, "hits", lambda self, batch: None)
    blind = exact_dedup.dedup_index(docs, base=4, fanout=2).select("doc_id", "digest", "keep_id", "group_size")
    assert sorted(map(tuple, blind.collect()), key=key) != want


def test_registered_indexes_merge_and_compact(spark, monkeypatch):
    """The registered queries themselves run the index: batches meet runs, levels are compacted, and without merges the results are wrong."""
    from basinflow.llm.queries import QUERIES
    from tests import parity

    met = []
    unseen, hits = line_dedup.LineIndex.unseen, exact_dedup.DigestIndex.hits

    def seen(kind, inner):
        def call(self, batch):
            met.append((kind, [len(level) for level in self.levels]))
            return inner(self, batch)

        return call

    def kept_rows():  # at the scale where copies lie in several memtables
        return QUERIES["op9_exact_dedup"](spark, "/root/testdata/sf0.1").where("kept").count()

    monkeypatch.setattr(line_dedup.LineIndex, "unseen", seen("lines", unseen))
    monkeypatch.setattr(exact_dedup.DigestIndex, "hits", seen("digests", hits))
    QUERIES["op1_line_dedup"](spark, parity.DATA).count()
    right = kept_rows()
    for kind in ("lines", "digests"):
        levels = [at for k, at in met if k == kind]
        assert len(levels) >= 2 and any(len(at) > 1 and at[1] for at in levels)  # several merges, one with a compacted run
    monkeypatch.setattr(exact_dedup.DigestIndex, "hits", lambda self, batch: None)
    assert kept_rows() > right
    # No line of this table is in ten documents; with two the merges decide.
    docs = spark.read.parquet(f"{parity.DATA}/documents.parquet")
    kept = lambda: sorted(map(tuple, line_dedup.dedup_lines(docs, min_docs=2).collect()))
    right = kept()
    monkeypatch.setattr(line_dedup.LineIndex, "unseen", lambda self, batch: batch.limit(0))
    assert kept() != right


def test_exact_dedup_parts_texts_that_share_a_digest(spark, docs, rows, monkeypatch):
    # with a digest of one value every hit needs its bytes
    monkeypatch.setattr(exact_dedup, "_memtables", _one_digest_memtables)
    monkeypatch.setattr(exact_dedup, "_normal_texts", _one_digest_texts)
    got = exact_dedup.dedup_index(docs.where("doc_id IS NOT NULL"), "largest").collect()
    groups = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            groups[fx.lower(r[1] or "")].append(r[0])
    # one digest and repeated ids can't be told apart by the test's rows; ids that occur once can
    once = {d for d, n in Counter(r[0] for r in rows).items() if n == 1}
    want = {i: (max(ids), len(ids)) for ids in groups.values() for i in ids if i in once}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got if r.doc_id in once} == want


def _one_digest_memtables(batches, sign):
    import pyarrow as pa

    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 33
    seen = 0
    for b in batches:
        n = b.num_rows
        ids = [part + seen + i for i in range(n)]
        seen += n
        yield pa.record_batch(
            [b.column(0), pa.array(ids, pa.int64()), pa.array([b"x"] * n, pa.binary()), pa.array(ids, pa.int64()), pa.array([1] * n, pa.int64()), pa.array(ids, pa.int64())],
            names=["doc_id", "row_no", "digest", "rep_no", "n_rows", "raw"],
        )


def _one_digest_texts(batches):
    import pyarrow as pa

    for b in batches:
        raws = [(t or "").encode().lower() for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array([b"x"] * len(raws), pa.binary()), pa.array(raws, pa.binary())], names=["doc_id", "digest", "body"])


def slow_simhash(text, words):
    tokens = [t for t in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in fx.lower(text or "")).split(" ") if t]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty):
    assert all(simhash.fingerprint(r[1], 4) == slow_simhash(r[1], 4) for r in rows)
    known = docs.where("doc_id IS NOT NULL")
    got = simhash.near_duplicates(known).collect()
    codes = {(r[0], i): slow_simhash(r[1], 4) for i, r in enumerate(rows) if r[0] is not None}
    comp = fx.components(codes, 4)
    want = Counter((d, codes[d, i], comp[d, i][0]) for d, i in codes)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    # Rows without an id keep their fingerprint and take part: they are named by the smallest id that they reach, or have none.
    every = Counter((r.doc_id, r.fp % 2**64) for r in simhash.near_duplicates(docs).collect())
    assert every == Counter((r[0], slow_simhash(r[1], 4)) for r in rows) and any(d is None for d, _ in every)
    kept = simhash.drop_near_duplicates(known)
    assert {r.doc_id for r in kept.collect()} == {c[0] for c in comp.values()} and kept.columns == known.columns
    assert simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("n", [3, 100, 700])
def test_gray_index_finds_every_link(n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**63, max(1, n // 20), dtype=np.uint64)
    codes = centres[rng.integers(0, len(centres), n)]
    for _ in range(4):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    codes = np.unique(codes)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    i, j = simhash.hamming_links(codes, 4)
    near = np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4, 1)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


@pytest.mark.parametrize("n", [10, 10**5, 10**6, 10**9, 10**11])
def test_every_table_choice_is_complete(n):
    masks = simhash.tables(n, 4)
    assert n >> masks[0].bit_count() <= simhash.HOT
    rng = np.random.default_rng(1)
    for _ in range(300):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("dense", [False, True])
def test_a_group_reports_a_spanning_forest(monkeypatch, dense):
    monkeypatch.setattr(simhash, "STEP", 64)
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 2**9 if dense else 2**14, 300, dtype=np.uint64))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    links = simhash.group_forest(codes, 2)
    want = fx.components({int(c): int(c) for c in codes}, 2)
    assert len(links) == len(codes) - len(set(want.values()))
    have = {int(c): {int(c)} for c in codes}
    for i, j in links:
        a, b = int(codes[i]), int(codes[j])
        assert (a ^ b).bit_count() <= 2
        union = have[a] | have[b]
        for c in union:
            have[c] = union
    assert {c: min(s) for c, s in have.items()} == want


def test_upper_nodes_prune(spark):
    """On the table that the bench reads, upper nodes drop most pairs, and what is left is every link."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    codes = np.array(sorted({r.fp for r in simhash.simhash_fingerprints(docs).collect()}), np.int64).view(np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    index = simhash.GrayIndex(codes)
    found = {(int(a), int(b)) for i, j in index.search(4) for a, b in zip(i, j)}
    near = np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4, 1)
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))
    assert len(index.levels) >= 5 and index.pruned > index.opened / 2
    assert index.opened * simhash.FAN**2 < len(codes) ** 2 / 2  # pairs compared, against all pairs


def test_groups_cross_batches():
    import pyarrow as pa

    t, k, fp = [0, 0, 0, 1, 1, 1, 1, 2], [5, 5, 6, 6, 6, 6, 6, 6], list(range(8))
    whole = pa.record_batch([pa.array(x, pa.int64()) for x in (t, k, fp)], names=["t", "k", "fp"])
    for size in (1, 2, 3, 8):
        parts = [whole.slice(i, size) for i in range(0, 8, size)]
        assert [g.tolist() for g in simhash._whole_groups(iter(parts))] == [[0, 1], [2], [3, 4, 5, 6], [7]]


def test_hot_groups_are_searched_in_the_finest_tables(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(63, 3, replace=False)) for c in base for _ in range(6)]
    dense = [0xFFF ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(12, 63, (60, 2))]  # these share their low bits
    codes = sorted({*map(int, base), *near, *dense})
    rows = [(i, c) for i, c in enumerate(codes)]
    got = simhash.near_components(spark.createDataFrame(rows, "doc_id long, fp long"), 4).collect()
    want = fx.components(dict(rows), 4)
    assert {r.fp: r.component_id for r in got} == {c: want[i] for i, c in rows}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1200)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_packed_partitions_are_even_in_rows_and_tokens(spark):
    """Long and short pieces in equal numbers of rows differ a hundredfold in tokens."""
    rows = [(i, "word " * 1023 if i % 2 else "word") for i in range(400)]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), max_len=1024)
    held = pieces.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("length").alias("n"), F.count("*").alias("rows"), F.min("length").alias("lo"), F.max("length").alias("hi"))
    parts = sorted(held.collect(), key=lambda r: r["p"])
    n = common.parallelism(spark)
    total = sum(r["n"] for r in parts)
    assert sum(r["n"] for r in pieces.select(F.col("length").alias("n")).collect()) == total
    assert len(parts) == n and max(r["n"] for r in parts) < 2 * total / n
    assert max(r["rows"] for r in parts) < 2.5 * sum(r["rows"] for r in parts) / n
    assert all(a["hi"] <= b["lo"] for a, b in zip(parts, parts[1:]))


def test_packing_round_trip(docs, rows, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(docs, max_len=64, with_ids=True).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    whole = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.start):
        assert p.length == len(p.ids) <= 64 and p.length & (p.length - 1) == 0 and p.offset == 0
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.start == len(whole[p.doc_row])
        whole[p.doc_row] += p.ids
    want = Counter(tuple([*exact.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows)
    assert Counter(map(tuple, whole.values())) == want
    assert packing.pack_documents(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, max_len=100)


def test_piece_lengths():
    assert packing.piece_lengths(1300, 1024) == [1024, 256, 16, 4] and packing.piece_lengths(1, 1024) == [1]
    assert all(sum(packing.piece_lengths(n, 64)) == n for n in range(1, 300))


def test_fingerprints(docs, rows, empty):
    got = fingerprints.edit_chain(docs).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert by_id[1][0].fingerprint == by_id[2][0].fingerprint and by_id[1][0].fingerprint != by_id[45][0].fingerprint
    assert by_id[7][0].fingerprint == by_id[8][0].fingerprint == ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.edit_chain(empty).count() == 0


def test_edits_take_the_next_lower_document(spark):
    texts = {i: f"{i} " + "wörd " * (i % 7) + "x" * (i % 5) for i in range(-40, 300, 3)}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprints.edit_chain(df).collect()}
    ids = sorted(texts, reverse=True)
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - half] + texts[nxt][:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    alone = fingerprints.edit_chain(df.where("doc_id = 2")).collect()
    assert alone[0].near_next == 1.0


def test_anchors_are_context_free(spark):
    middle = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, middle), (2, f"some other start {middle}"), (3, f"{middle} and an end")], "doc_id long, text string")
    found = defaultdict(set)
    for r in fingerprints.syncmer_anchors(df).collect():
        found[r.doc_id].add((r.position, r.hash))
    inner = {(p, h) for p, h in found[1] if p >= 4}
    assert inner and inner <= found[3] and {(p + 3, h) for p, h in inner} <= found[2]


def test_mixing(spark, docs, rows, empty):
    mixed = mixing.mix_sources(docs, weights={"s0": 3.0, "s1": 1.0}, budget=4000, seed=5)
    n = Counter(r.source for r in mixed.select("source").collect())
    assert set(n) == {"s0", "s1"} and abs(n["s0"] - 3000) < 250 and abs(n["s1"] - 1000) < 150
    assert mixed.columns[: len(docs.columns)] == docs.columns and "mix_copy_" in mixed.columns
    again = mixing.mix_sources(docs.repartition(2), weights={"s0": 3.0, "s1": 1.0}, budget=4000, seed=5)
    assert Counter(map(str, mixed.collect())) == Counter(map(str, again.collect()))
    assert mixing.mix_sources(empty).count() == 0


def test_many_sources_meet_their_rates_by_salt(docs, monkeypatch):
    want = Counter(map(str, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "MAX_RATES", 0)
    assert Counter(map(str, mixing.mix_sources(docs).collect())) == want


@pytest.mark.parametrize("mean", [0.0, 0.3, 4.0, 40.0])
def test_poisson_counts_have_the_right_moments(spark, mean):
    n = 20_000
    one = spark.range(1).select(mixing.poisson_parts(F.lit(mean)).alias("parts"), mixing.poisson_cdf(F.lit(mean)).alias("cdf"))
    got = spark.range(n).crossJoin(one).select(mixing.poisson_count(F.col("id"), F.col("parts"), F.col("cdf"), 9).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
    assert abs(got[0] - mean) <= 5 * (mean / n) ** 0.5 and abs(got[1] - mean) <= 0.06 * mean


def test_quality_learns_held_out_rows(spark):
    import random

    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "past", "old", "mills"]) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "the", "$$$", "river"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels, max_train=300)
    scored = quality.score_quality(docs, model).withColumn("held_out", quality.held_out()).collect()
    held = [r for r in scored if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    assert sum((r.score >= 0.7) == (r.doc_id % 3 > 0) for r in held) / len(held) > 0.97


def test_quality_on_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 0), (3, 1)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels)
    scored = quality.score_quality(docs, model)
    assert scored.columns == [*docs.columns, "score_"] and scored.count() == len(rows)
    assert quality.keep_quality(docs, labels.limit(0)).count() == len(rows)
    assert quality.keep_quality(empty, labels).count() == 0


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(80)]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    values = [np.ones(8) for _ in rows]
    w, b = quality.dual_coordinate_descent(rows, values, y, np.full(80, 0.1), epochs=3000, seed=1)
    primal = lambda w, b: 0.5 * (w @ w + b * b) + 0.1 * sum(max(0, 1 - t * (w[r] @ v + b)) for r, v, t in zip(rows, values, y))
    best = primal(w, b)
    for _ in range(200):
        d = np.zeros(len(w))
        d[:40] = rng.normal(size=40) * 0.02
        assert primal(w + d, b + rng.normal() * 0.02) >= best - 1e-3


def test_chat_perspectives(spark):
    said = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, "ann", "Bye é"), (1, 3, "ann", "Bye é"),
        (2, 0, "system", "alone"), (3, None, None, "odd"), (None, 0, "ann", "no id"),
    ]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("perspective", F.lit(1)).withColumn("block", F.lit(2))
    got = {(r.conv_id, r.perspective): r for r in chat.render_perspectives(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "unknown"), (None, "ann")}
    ann = got[1, "ann"]
    learned = [ann.text[m.start : m.stop] for m in ann.mask]
    assert learned == ["Hi<|im_end|>\n", "Bye é<|im_end|>\n", "Bye é<|im_end|>\n"] and ann.n_turns == 5 and ann.n_learned == 3
    assert "<|im_start|>user name=bob\n<|im_end|>" in ann.text and ann.text.startswith("<|im_start|>system\nBe kind.")
    assert got[1, "bob"].text.count("user name=ann") == 3
    assert chat.render_perspectives(df.limit(0)).count() == 0


def test_parts_of_a_long_conversation_join_to_its_rendering(spark):
    """A conversation of any length, ties and null turns too, is rendered as if in one part; the system turn comes once."""
    said = [(None, None if i % 5 == 0 else i % 40, ("ann", "bob", "cy")[i % 3], f"line {i % 100}") for i in range(2000)]
    said += [(1, 0, "system", "Be kind. <|im_end|>")] + [(1, i, ("ann", "bob")[i % 2], f"é {i}") for i in range(1, 700)] + [(2, 0, "ann", "x")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(7)
    whole = {(r.conv_id, r.perspective): r for r in chat.render_perspectives(df, 10**6).collect()}
    assert len(whole) == 6 and all(r.part == r.offset == 0 for r in whole.values())
    parts = defaultdict(list)
    for r in chat.render_perspectives(df, 64).collect():
        parts[r.conv_id, r.perspective].append(r)
    for k, rows in parts.items():
        rows.sort(key=lambda r: r.part)
        text = "".join(r.text for r in rows)
        assert text == whole[k].text and [r.part for r in rows] == list(range(len(rows)))
        assert [m for r in rows for m in r.mask] == whole[k].mask
        assert all(r.n_turns <= 64 and r.offset == sum(len(x.text) for x in rows[: r.part]) for r in rows)
        assert sum(r.n_turns for r in rows) == whole[k].n_turns and len(whole[k].mask) == whole[k].n_learned
    assert whole[1, "ann"].text.count("Be kind.") == 1
    assert [whole[1, "ann"].text[m.start : m.stop] for m in whole[1, "ann"].mask] == [f"é {i}<|im_end|>\n" for i in range(2, 700, 2)]


def test_a_hot_conversation_is_dealt_and_its_texts_are_not_gathered(spark):
    """A third of all rows share a null conv_id: their turns lie in many tasks, and the window over its parts sees lengths only."""
    said = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 500).alias("conv_id"), (F.col("id") % 7).alias("turn"),
        F.element_at(F.array(F.lit("ann"), F.lit("bob")), (F.col("id") % 2 + 1).cast("int")).alias("role"), F.concat(F.lit("t"), F.col("id")).alias("content"),
    )
    numbered = chat.number_turns(said).collect()
    places = defaultdict(list)
    for r in numbered:
        places[r.conv_id].append(r.place)
    assert len(numbered) == 6000 and all(sorted(p) == list(range(len(p))) for p in places.values())
    parts = chat.render_perspectives(said.withColumnRenamed("content", "text"), 50)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window [") :]
    assert "sum(length#" in window and "collect_list" not in window  # what is sorted by conversation is lengths
    assert "ShuffledHashJoin" in plan and plan.split("ShuffledHashJoin")[1].split("ObjectHashAggregate")[0].count("Exchange") == 0  # and texts stay where they were grouped
    assert parts.where("conv_id IS NULL").count() == 2 * 40
    assert chat.number_turns(said.limit(0)).collect() == []


def test_session_settings_are_left_alone(spark, docs):
    key = common.BATCH_SETTING
    before = spark.conf.get(key)
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(1, 60)], "doc_id long, quality int, toxic int")
    quality.keep_quality(docs, labels).count()
    exact_dedup.dedup_index(docs).count()
    assert spark.conf.get(key) == before
