"""Hard negatives on odd rows, against a brute-force version in plain integers."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from basinflow.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, row long, w long, score string, block int, v int"


def brute(rows, n_pos=5, n_neg=10, low=30, high=90, most=None):
    dims = max((len(v) for i, v, c in rows if None not in (i, v, c)), default=0)
    most = most or int((2**hn.SCORE_BITS / max(dims, 1)) ** 0.5)
    points = []
    for i, v, c in rows:
        if None in (i, v, c) or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [max(-most, min(most, math.floor(256 * x))) for x in v]
        points.append((i, c, q + [0] * (dims - len(q))))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for at, a in enumerate(points):
        if a[0] % 100:
            continue
        ranked = sorted(((-score(a, b), b[0], k) for k, b in enumerate(points) if k != at))
        near = [x for x in ranked if points[x[2]][1] == a[1]][:n_pos]
        for s, p, _ in near:
            window = [x for x in ranked if points[x[2]][1] != a[1] and low * -s <= 100 * -x[0] <= high * -s][:n_neg]
            out += [(a[0], p, n, x[1], -s, -x[0]) for n, x in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 7, 7, "x", 7, 7) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, hn.mine_hard_negatives(df, "vec_id", F.col("label"), "embedding", F.col("vec_id") % 100 == 0, **kw).collect()))


def vectors(seed, n, dims, scale=1.0, labels=3):
    rng = random.Random(seed)
    return [(i * 5, [rng.gauss(0.2, 1) * scale for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(hn, "CHUNK_BYTES", 2000)  # many chunks and blocks
    monkeypatch.setattr(hn, "BLOCK_BYTES", 100)
    rows = vectors(1, 700, 8, scale)
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_odd_rows_ties_and_repeats(spark):
    rows = vectors(2, 120, 4)
    v = rows[0][1]
    rows += [(1000 + i, v, 1) for i in range(60)] + [(2000 + i, [x * 0.6 for x in v], 2) for i in range(60)]  # more ties than places, on both sides
    rows += [(100, v, 1), (100, v, 1), (300, v, None), (400, None, 1), (None, v, 1), (500, [1.0, None, 2.0, 0.0], 1)]
    rows += [(600, [float("nan")] * 4, 1), (700, [float("inf")] * 4, 1), (800, [], 1), (900, [0.5], 2), (2100, [1e300, -1e300, 0.0, 1.0], 1), (2200, [-x for x in v], 0)]
    want = brute(rows)
    assert mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=70, low=10, high=100) == brute(rows, 2, 70, 10, 100)


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    assert mined(spark, [(100, [1.0], 1), (2, [0.5], 2)]) == []  # no positive
    assert mined(spark, [(100, [1.0], 1), (7, [1.0], 1), (2, [0.5], 2)]) == brute([(100, [1.0], 1), (7, [1.0], 1), (2, [0.5], 2)]) != []


def test_the_radix_passes_find_the_kth_score(spark, monkeypatch):
    """After the last digit the kth score is known, and only rows that reach it are gathered."""
    monkeypatch.setattr(hn, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(hn, "RADIX", 7)
    rows = vectors(3, 500, 8)
    space = hn.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", F.col("label"), "embedding")
    own = space.points.where("vec_id % 100 = 0").withColumn("block", F.lit(0))
    windows = own.select(F.col("row").alias("w"), F.col("row").alias("anchor"), "block", F.lit(-space.bound).alias("lo"), F.lit(space.bound).alias("hi"))
    state = hn.locate(space, own, 1, windows, 5, False, 2 * space.bound)
    points = {r.row: r for r in space.points.collect()}
    score = lambda a, b: sum(x * y for x, y in zip(a.v, b.v))
    for r in state.collect():
        a = points[r.anchor]
        ranked = sorted((score(a, b) for b in points.values() if b.label != a.label), reverse=True)
        assert (r.hi - r.base, r.below, r.whole) == (ranked[4], sum(x > ranked[4] for x in ranked), False)
    assert hn.gather(space, own, 1, state, 5, False).count() == 5 * own.count()  # no ties here, and nothing else comes


def test_nothing_is_broadcast(spark, monkeypatch):
    """Anchors and windows grow with the table: no plan sends them through the driver, however small their files are."""
    plans = []
    materialize = hn.materialize

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, *args)

    monkeypatch.setattr(hn, "materialize", noted)
    df = spark.createDataFrame(vectors(4, 300, 8), "vec_id long, embedding array<double>, label int")
    out = hn.mine_hard_negatives(df, "vec_id", F.col("label"), "embedding", F.col("vec_id") % 100 == 0)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]
