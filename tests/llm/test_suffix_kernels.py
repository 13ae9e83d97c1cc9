"""The radix passes without Spark: random corpora, small blocks, every first digit wide or none."""

from __future__ import annotations

import random
from collections import defaultdict

import pyarrow as pa
import pytest

from basinflow.llm import suffix_dedup as sd
from tests.llm import fixtures as fx


def squeezed(texts: list[str]):
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc", "text"])
    return next(sd._squeeze(iter([batch]))).column(1)


def passes(texts: list[str], depth: int, parts: int = 3):
    def table(batches):
        return [r for b in batches for r in b.to_pylist()]

    def dealt(rows, key, schema):
        groups = defaultdict(list)
        for r in rows:
            groups[key(r) % parts].append(r)
        return [[pa.RecordBatch.from_pylist(g, schema=schema)] for g in groups.values()]

    mapped = list(sd._map_runs(iter([pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc", "text"])]), depth))
    rows = table(mapped)
    by_route = dealt(rows, lambda r: hash((r["d1"], r["d2"])) if r["kind"] == sd.WIDE_OPEN else r["d1"], mapped[0].schema) if rows else []
    settled = [r for part in by_route for r in table(sd._settle_runs(iter(part), depth))]
    runs = defaultdict(list)
    removed = [r for r in settled if r["kind"] == sd.REMOVED]
    for r in settled:
        if r["kind"] in (sd.OPEN, sd.WIDE_OPEN):
            runs[r["doc"]].append({k: r[k] for k in ("d1", "lo", "hi", "kind")})
    if runs:
        docs = sorted(runs)
        batch = pa.record_batch([pa.array(docs, pa.int64()), squeezed([texts[d] for d in docs]), pa.array([runs[d] for d in docs])], names=["doc", "body", "runs"])
        opened = list(sd._open_runs(iter([batch]), depth))
        rows = table(opened)
        for part in dealt(rows, lambda r: hash((r["d1"], r["spread"])), opened[0].schema) if rows else []:
            removed += table(sd._settle_windows(iter(part), depth))
    ranges = defaultdict(list)
    for r in removed:
        ranges[r["doc"]].append({"lo": r["lo"], "hi": r["hi"]})
    last = pa.record_batch(
        [pa.array(range(len(texts)), pa.int64()), squeezed(texts), pa.array([ranges[d] for d in range(len(texts))], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))],
        names=["doc", "body", "ranges"],
    )
    return [(r["kept"], [(s["lo"], s["hi"]) for s in r["spans"]]) for r in table(sd._cut(iter([last]), True))]


@pytest.mark.parametrize("wide", [0, 1, 8])
@pytest.mark.parametrize("block", [200, 10**6])
@pytest.mark.parametrize("seed", range(6))
def test_random_corpora(monkeypatch, wide, block, seed):
    monkeypatch.setattr(sd, "WIDE", wide)
    monkeypatch.setattr(sd, "BLOCK", block)
    rng = random.Random(seed)
    alphabet = ["ab", "abcdefghij", "aé"][seed % 3]
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 120))) for _ in range(6)]
    texts = []
    for _ in range(25):
        parts = [rng.choice(pool) if rng.random() < 0.6 else rng.choice(alphabet) * rng.randrange(0, 90) for _ in range(rng.randrange(0, 6))]
        texts.append("".join(parts))
    assert passes(texts, 50) == fx.repeats(texts, 50)


def test_a_passage_shared_by_all(monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 5000)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(70)
    texts = [noise(rng.randrange(0, 200)) + passage + noise(rng.randrange(0, 200)) for _ in range(150)]
    assert passes(texts, 50) == fx.repeats(texts, 50)


def test_portions_end_where_the_first_digit_changes(monkeypatch):
    monkeypatch.setattr(sd, "PORTION", 4)
    d1 = [1, 1, 2, 2, 2, 2, 2, 3, 4, 4, 5, 5, 5, 6]
    whole = pa.record_batch([pa.array(d1, pa.int64()), pa.array(range(len(d1)), pa.int64())], names=["d1", "n"])
    for size in (1, 3, 5, 20):
        parts = list(sd._portions(iter([whole.slice(i, size) for i in range(0, len(d1), size)])))
        assert [x for p in parts for x in p.column(1).to_pylist()] == list(range(len(d1)))
        keys = [set(p.column(0).to_pylist()) for p in parts]
        assert all(not a & b for i, a in enumerate(keys) for b in keys[:i])
        assert len(parts) > 1 or size == 20


def in_batches(batches, size: int, keys):
    """One task's rows as Spark gives them: sorted, in batches of ``size``."""
    whole = pa.Table.from_batches(list(batches)).sort_by([(k, "ascending") for k in keys]).combine_chunks()
    return iter(b for b in whole.to_batches(max_chunksize=size))


@pytest.mark.parametrize("wide", [0, 1, 8])
@pytest.mark.parametrize("portion", [2, 6, 40, 1 << 18])
@pytest.mark.parametrize("seed", range(3))
def test_groups_longer_than_a_portion(monkeypatch, wide, portion, seed):
    """A third of the texts are copies, and all hold one passage in many surroundings."""
    monkeypatch.setattr(sd, "WIDE", wide)
    monkeypatch.setattr(sd, "BLOCK", 300)
    runs, windows = sd._settle_runs, sd._settle_windows
    monkeypatch.setattr(sd, "_settle_runs", lambda it, depth: runs(in_batches(it, 3, ["d1"]), depth))
    monkeypatch.setattr(sd, "_settle_windows", lambda it, depth: windows(in_batches(it, 3, ["d1", "spread"]), depth))
    monkeypatch.setattr(sd, "PORTION", portion)
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, copy = noise(60), noise(150)
    texts = [copy if rng.random() < 0.34 else noise(rng.randrange(0, 80)) + passage + noise(rng.randrange(0, 80)) for _ in range(60)]
    assert passes(texts, 50) == fx.repeats(texts, 50)


def test_a_hot_group_is_held_in_few_rows(monkeypatch):
    """However long one digit's group is, no portion holds much more than ``PORTION`` rows."""
    monkeypatch.setattr(sd, "PORTION", 20)
    np = sd.np
    for kinds in (3, 400):
        n = 500
        at = np.arange(n)
        rows = sd._rows(np.full(n, 7), at % kinds, at, np.zeros(n), np.full(n, 5), sd.CLASS)
        portions = list(sd._portions(iter([rows.slice(i, 5) for i in range(0, n, 5)]), 1, lambda g: sd._thin_runs(g, 50)))
        assert max(p.num_rows for p in portions) <= 40
        out = [r for p in portions for r in p.to_pylist() if r["kind"] != sd.MARK]
        assert sorted(r["doc"] for r in out) == list(range(n))
        if kinds == 3:
            assert sorted(r["doc"] for r in out if r["kind"] != sd.REMOVED) == [0, 1, 2]
        else:
            assert all(r["kind"] in (sd.WIDE_OPEN, sd.REMOVED, sd.CLASS) for r in out)
    n = 500
    one = pa.record_batch([pa.array([7] * n), pa.array([9] * n), pa.array(range(n)), pa.array([1] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([b"12345678"] * n)], names=["d1", "spread", "doc", "lo", "hi", "hashes"])
    gone = [r["doc"] for b in sd._settle_windows(iter([one.slice(i, 5) for i in range(0, n, 5)]), 50) for r in b.to_pylist()]
    assert sorted(gone) == list(range(1, n))
