"""Registered queries that SQL can't express, over whole tables, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from basinflow.llm import quality
from basinflow.llm.queries import QUERIES
from tests import parity
from tests.llm import fixtures as fx
from tests.llm.test_text_ops import slow_simhash


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{parity.DATA}/documents.parquet").select("doc_id", "text").collect()
    return dict(sorted((r.doc_id, r.text or "") for r in rows))


def run(spark, name):
    return QUERIES[name](spark, parity.DATA).collect()


def test_suffix_dedup(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op2_suffix_dedup")}
    want = {}
    for (d, t), (kept, spans) in zip(texts.items(), fx.repeats(list(texts.values()), 100)):
        n = len(t.encode())
        want[d] = (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert got == want
    assert sum(x[1] for x in got.values()) > 0


def test_quality(spark, texts):
    rows = run(spark, "op3_quality")
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_on_held_out_labels(spark):
    """The registered query finds the labels of rows that it did not learn from, at the scale that has some hundreds of labels."""
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op3_quality"](spark, folder).collect() if r.held_out and r.doc_id in truth]
    right = np.mean([(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in rows])
    assert len(rows) > 80 and right > 0.9
    good, bad = ([r.score for r in rows if truth[r.doc_id] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95  # a good one outranks a bad one


def test_quality_against_dense_support_vectors():
    """A dense NB-SVM, solved by subgradient steps on the primal, agrees with the sparse dual solution."""
    rng = np.random.default_rng(5)
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    rows = [np.unique(np.r_[rng.choice(30, 6), 30 + rng.choice(6, 3) + (6 if t > 0 else 0)]) for t in y]
    x = np.zeros((60, 48))
    for i, r in enumerate(rows):
        x[i, r] = 1
    p, q = x[y > 0].sum(0) + 1, x[y < 0].sum(0) + 1
    total = quality.DIMS - 48  # places that no text has count one in each class
    ratio = np.log(p / (p.sum() + total)) - np.log(q / (q.sum() + total))
    scaled = x * ratio / np.sqrt(x.sum(1, keepdims=True))
    cost = 0.3 * np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    w, b, best, best_at = np.zeros(48), 0.0, np.inf, None
    for step in range(1, 20_000):
        margin = y * (scaled @ w + b)
        value = 0.5 * (w @ w + b * b) + cost @ np.maximum(0, 1 - margin)
        if value < best:
            best, best_at = value, (w.copy(), b)
        active = (margin < 1) * cost * y
        rate = 1 / (step + 10)
        w, b = w - rate * (w - active @ scaled), b - rate * (b - active.sum())
    got, bias = quality._fit_margins(rows, y, 0.3, 2000, 7)
    mine = np.array([got[r].sum() / np.sqrt(len(r)) + bias for r in rows])
    assert np.abs(mine - (scaled @ best_at[0] + best_at[1])).max() < 0.05


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*values):
    """XXH64 of longs, each seeded by the one before."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed)
    return signed(seed)


def closed_syncmers(text):
    """(distance, hash) of every 5-word window whose least inner pair lies at an edge, after four blank words."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    h = [0] * 4 + [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    pair = [chained(a, b) for a, b in zip(h, h[1:])]
    out, last = [], -1
    for i in range(len(h) - 4 if words else 0):
        inner = pair[i : i + 4]
        if min(inner) in (inner[0], inner[3]):
            out.append((min(i - last, 15), chained(pair[i], pair[i + 2], h[i + 4]) & 0xFFFFFFFF))
            last = i
    return out


def slow_likeness(a, b):
    def words_of(anchors):
        return {(p[1], *x): x[0] for p, x in zip([(0, 0), *anchors], anchors)}

    x, y = words_of(a), words_of(b)
    whole = sum({**x, **y}.values())
    return sum(x[k] for k in x.keys() & y.keys()) / whole if whole else 1.0


def test_fingerprints(spark, texts):
    falling = sorted(texts, reverse=True)
    following = dict(zip(falling, falling[1:] + falling[:1]))
    rows = {r.doc_id: r for r in run(spark, "op5_fingerprints")}
    assert set(rows) == set(texts)
    anchors = {d: closed_syncmers(t) for d, t in texts.items()}
    shown = lambda a: "".join(f"{h:08x}{g:x}" for g, h in a)
    for d, r in rows.items():
        t, half = texts[d], len(texts[d]) // 2
        edited = t[: len(t) - half] + texts[following[d]][:half]
        other = closed_syncmers(edited)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (shown(anchors[d]), shown(other))
        assert abs(r.near_edited - slow_likeness(anchors[d], other)) < 1e-12
        assert abs(r.near_next - slow_likeness(anchors[d], anchors[following[d]])) < 1e-12
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()]) + 0.1


def test_packing(spark, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pieces: dict[int, list] = {}
    for r in run(spark, "op6_packing"):
        pieces.setdefault(r.doc_id, []).append(r)
    for d, t in texts.items():
        ids = np.array([*exact.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.offset) == (at, len(ids), 0)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length <= 1024 and r.length & (r.length - 1) == 0  # full at a power of two: no padding
            at += r.length
        assert at == len(ids)
    assert len({r.sequence_id for p in pieces.values() for r in p}) == sum(map(len, pieces.values()))


def test_simhash_dedup(spark, texts):
    codes = {d: slow_simhash(t, 4) for d, t in texts.items()}
    want = {d: (f"{codes[d]:016x}", c) for d, c in fx.components(codes, 4).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op8_simhash_dedup")} == want
