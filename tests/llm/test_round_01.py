"""Rows, ids and tokens that operators once left out."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from basinflow.llm import fingerprints, packing, simhash


def test_simhash_drop_finds_rows_by_id_and_text(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    a = " ".join(base)
    b, c = " ".join(["one", *base]), " ".join([*base, "two"])
    assert max((simhash.fingerprint(a, 4) ^ simhash.fingerprint(x, 4)).bit_count() for x in (b, c)) <= 4
    other = " ".join(f"o{i}" for i in range(50))
    rows = [(3, a), (3, c), (7, b), (7, other), (None, c), (None, "alone and without id"), (9, "x y"), (9, "x y")]
    kept = Counter((r.doc_id, r.text) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept[7, other] == kept[None, "alone and without id"] == kept[9, "x y"] == 1
    assert kept[3, a] + kept[3, c] == 1 and sum(kept.values()) == 4


def test_pipeline_packing_gives_token_ids(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = {1: "some words to pack " * 40, 2: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got: dict[int, list] = {}
    for r in sorted(dict(corpus_pipeline.STAGES)["packing"](spark, df, "").collect(), key=lambda r: r.start):
        got[r.doc_id] = got.get(r.doc_id, []) + r.ids
    assert got == {d: [*exact.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}


def test_added_tokens_are_encoded_as_the_tokenizer_file_says():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> end", "<|endoftext|>", "plain  text\n", "x<|endoftext|><|endoftext|>y", ""]
    assert packing.encoder(None)(texts) == [exact.encode(t, add_special_tokens=False).ids for t in texts]


def test_likeness_covers_all_anchors(spark):
    own = [[f"{d}w{i}" for i in range(6000)] for d in "ab"]
    passage = [f"p{i}" for i in range(100)]
    texts = {2: " ".join(own[0] + passage), 1: " ".join(own[1][:3000] + passage + own[1][3000:])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in fingerprints.edit_chain(df).collect():
        assert 0.004 < r.near_next < 100 / 12_000  # the passage, which has 100 of 12,100 words
    words = " ".join(own[0]), " ".join([*own[0][:3000], "another", "sentence", *own[0][3000:]])
    near = spark.createDataFrame([(2, words[0]), (1, words[1])], "doc_id long, text string")
    assert all(0.99 < r.near_next < 1 for r in fingerprints.edit_chain(near).collect())
    # the same sentences in another order lie alike within themselves only
    parts = [" ".join(own[0][i : i + 20]) for i in range(0, 2000, 20)]
    moved = spark.createDataFrame([(2, " ".join(parts)), (1, " ".join(parts[1::2] + parts[::2]))], "doc_id long, text string")
    assert all(0.5 < r.near_next < 0.95 for r in fingerprints.edit_chain(moved).collect())
