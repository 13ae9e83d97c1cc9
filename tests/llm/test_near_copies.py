"""The pipeline's near stage against brute force over five-word shingles, by row counts."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from basinflow.llm import near_copies
from tests import parity
from tests.llm import fixtures as fx

NEAR = dict(corpus_pipeline.STAGES)["simhash near-dedup"]


def shingle_set(text):
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in fx.lower(text or "")).split(" ")
    words = [w for w in words if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_planted_near_copies_go(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(100 * g + k, edited(rng, base, k)) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in NEAR(spark, df, "").collect()) == [100 * g for g in range(12)]


def test_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{parity.DATA}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    found = groups([r.text for r in rows])
    want = [rows[g].doc_id for g in sorted(set(found))]
    assert len(want) < len(rows)
    assert sorted(r.doc_id for r in NEAR(spark, docs, "").collect()) == want


def test_repeated_and_null_ids(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    a, b, c = " ".join(base), edited(rng, base, 1), edited(rng, base, 2)
    other = " ".join(f"o{i}" for i in range(50))
    rows = [(3, a), (7, b), (7, other), (None, c), (None, "alone and without id"), (3, c), (9, "x y"), (9, "x y")]
    kept = Counter((r.doc_id, r.text) for r in NEAR(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert kept[7, other] == kept[None, "alone and without id"] == kept[9, "x y"] == 1
    assert kept[3, a] + kept[3, c] == 1 and sum(kept.values()) == 4


def test_chains_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    monkeypatch.setattr(near_copies, "PORTION", 3)  # the head of a bucket is repeated for its portions
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(30):  # the ends of the chain are not alike
        texts.append(" ".join(words))
        words = edited(rng, words, 2).split(" ")
    assert set(groups(texts)) == {0} and not near_copies.alike(near_copies.shingles(texts[0], 5), near_copies.shingles(texts[-1], 5), 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in NEAR(spark, df, "").collect()] == [0]


def test_null_and_empty_texts_and_clashing_columns(spark):
    """Texts without words are alike, whatever they are made of; columns named like the stage's own pass through."""
    texts = ["", None, " \n\t ", "one two three", None, "ONE two  three", "four"]
    rows = [(i if i != 4 else None, t, 7, 8, "g", 9, 10, 11) for i, t in enumerate(texts, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _hash int, grp string, raw int, node int, lost_id int")
    kept = NEAR(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text, r._id, r._hash, r.grp, r.raw, r.node, r.lost_id) for r in kept.collect()) == [
        (1, "", 7, 8, "g", 9, 10, 11), (6, "ONE two  three", 7, 8, "g", 9, 10, 11), (7, "four", 7, 8, "g", 9, 10, 11),
    ]
    assert NEAR(spark, df.limit(0), "").count() == 0


def test_a_bucket_of_most_texts(spark):
    """Two thousand near copies in one group, among others: one stays, and no task meets them all at the head."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, base, 1)) for i in range(2000)] + [(10_000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(30))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in NEAR(spark, df, "").collect()}
    assert kept == {0, *range(10_000, 10_200)}


def test_simhash_joins_texts_before_minhash(spark, monkeypatch):
    """Copies with one word of 2,000 changed are joined by SimHash and never met again through a MinHash bucket; likeness decides on what it proposes."""
    rng = random.Random(21)
    rows = []
    for g in range(10):
        base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        rows += [(10 * g + k, edited(rng, base, min(k, 1))) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    materialize = near_copies.materialize

    def noted(frame, tag, *rest):
        out = materialize(frame, tag, *rest)
        if tag in ("proposed", "hashed", "apart"):
            seen[tag] = out.count()
        return out

    monkeypatch.setattr(near_copies, "materialize", noted)
    assert sorted(r.doc_id for r in NEAR(spark, df, "").collect()) == [10 * g for g in range(10)]
    assert seen["proposed"] >= seen["hashed"] >= 18 and seen["apart"] <= 2
    twins = spark.createDataFrame([(5, 9), (3, 9), (8, 11), (7, -1)], "node long, fp long")  # 9 and 11 differ in a bit
    assert sorted(map(tuple, near_copies.simhash_pairs(twins).collect())) in ([(3, 8), (5, 3)], [(5, 3), (8, 3)])
