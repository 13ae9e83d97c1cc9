"""The manifest on odd rows and on trees of every shape, against a tree built by hand."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from basinflow.llm import merkle
from basinflow.llm.common import ascii_lower
from tests.llm import fixtures as fx


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text) -> str:
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climb(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The root, and for each leaf the siblings before and after it at each level."""
    ways: list[list] = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for way, (k, i) in zip(ways, enumerate(at)):
            way.append((runs[i // fanout][: i % fanout], runs[i // fanout][i % fanout + 1 :]))
            at[k] = i // fanout
        nodes = [H(*run) for run in runs]
    return nodes[0], ways


def manifest(rows, fanout):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    out, order = [], sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    roots = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], fanout) for s in order}
    root, above = climb([roots[s][0] for s in order], fanout)
    for s, upper in zip(order, above):
        for (_, _, own, r), way in zip(sorted(trees[s], key=lambda x: x[:3]), roots[s][1]):
            way = way + upper
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf(*r[:4], fx.lower(r[4])) if bad else own
            for before, after in way:
                node = H(*before, node, *after)
            out.append((r[0], own, roots[s][0], root, H(*[x for b, a in way for x in b + a]), node, node == root))
    return out


def digests(df, fanout):
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = merkle.build_manifest(df, fanout, F.when(bad, ascii_lower(F.col("text"))))
    folded = merkle.fold(F.col("path"), F.coalesce("shown", "leaf"))
    rows = made.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof_digests(F.col("path"))).alias("p"), folded.alias("f")).collect()
    return [(r[0], *[bytes(x).hex() for x in r[1:]], r.f == r.root) for r in rows]


def key(x):
    return (x[0] is not None, *map(str, x))


@pytest.fixture(scope="module")
def rows(spark):
    return fx.odd_documents(spark)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_odd_rows(spark, rows, fanout):
    df = fx.frame(spark, rows)
    want = manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows], fanout)
    assert sorted(digests(df, fanout), key=key) == sorted(want, key=key)
    assert len({x[3] for x in want}) == 1 and any(not x[-1] for x in want) and any(x[-1] for x in want)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 16, 17, 33], [260, 1], [1] * 17, [2] * 20])
def test_trees_of_every_shape(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(d, f"s{k}" if k else None, "en", 3, rng.choice("AbC")) for k, n in enumerate(sizes) for d in rng.sample(range(10_000), n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(digests(df, 16), key=key) == sorted(manifest(rows, 16), key=key)


def test_empty_table_and_order_of_sources(spark, rows):
    df = fx.frame(spark, [])
    assert digests(df, 16) == []
    names = ["é", "z", "Z", "\U0001f600", "￿", "", None]  # UTF-8 order isn't that of UTF-16
    some = [(i, s, None, None, None) for i, s in enumerate(names)]
    df = spark.createDataFrame(some, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(digests(df, 3), key=key) == sorted(manifest(some, 3), key=key)


def test_a_hot_source_is_dealt_to_many_tasks(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("source"))
    df = df.withColumns({"lang": F.lit("en"), "n_chars": F.lit(1), "text": F.lit("x")})
    from basinflow.operators.ranks import deal_in_order

    dealt = deal_in_order(df, [F.col("source"), F.col("doc_id")], "part", "at").groupBy("part").count().collect()
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 2000
    assert merkle.build_manifest(df).count() == 4000
