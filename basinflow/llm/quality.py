"""Quality classifier: support vectors over naive-Bayes scaled n-gram indicators.

Features are indicators, hashed to ``DIMS`` places: word 1- and 2-grams, 4-grams
of the text's *shape* (letters become a or A, digits 0, runs of one class shrink
to at most two), and buckets of a few shares (repeated neighbours, distinct words,
capitals, signs, digits). Each indicator is scaled by its log-count ratio between
the classes, and a linear hinge-loss model is fitted by dual coordinate descent; a
two-parameter logistic curve, fitted on out-of-fold margins, turns margins into
scores between 0 and 1.

The model is fitted on at most ``max_train`` labelled documents (those with the
least hash of doc_id), features only; that bound holds for any corpus. Scoring is
one pass over whole texts, a row at a time, without a shuffle; the model it
carries has a fixed size.

Labels come only from rows with crc32(doc_id as text) mod 4 other than 2. Defined
results: a null text counts as empty; empty texts are scored by their buckets like
any other; several labels of one doc_id are averaged (half or more is 1), null
labels are ignored; a null doc_id is held out and scored; repeated rows score
alike; with under three labels of a class every document scores (n1 + 1) / (n + 1)
and ``keep_quality`` keeps all; of rows that share a labelled doc_id one is learned
from; an empty table gives no rows; labels, lang, source and doc_id are never
inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinflow.llm.common import free_name, materialize, read_table

BITS = 18
DIMS = 1 << BITS
SHAPE = bytes(
    b"a"[0] if 97 <= c <= 122 or c >= 128 else b"A"[0] if 65 <= c <= 90 else b"0"[0] if 48 <= c <= 57 else b" "[0] if c in (32, 9, 10, 11, 12, 13) else c
    for c in range(256)
)
LETTER = np.array([c in b"aA0 " for c in range(256)])


def _place(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def _grams(data: np.ndarray) -> np.ndarray:
    d = data.astype(np.uint64)
    return d[:-3] | d[1:-2] << np.uint64(8) | d[2:-1] << np.uint64(16) | d[3:] << np.uint64(24)


def _buckets(raw: bytes, shape: np.ndarray, tokens: list[bytes]) -> list[int]:
    n, m = max(1, len(raw)), max(1, len(tokens))
    shares = (
        sum(map(eq, tokens, tokens[1:])) / m,
        len(set(tokens)) / m,
        np.count_nonzero(shape == ord("A")) / n,
        np.count_nonzero(~LETTER[shape]) / n,
        np.count_nonzero(shape == ord("0")) / n,
    )
    even = [1000 * i + int(min(x, 1.0) * 20) for i, x in enumerate(shares)]
    fine = [1000 * i + 100 + int(x * 4096).bit_length() for i, x in enumerate(shares)]
    return [*even, *fine, 10_000 + min(n, 1 << 20).bit_length()]


class Features:
    """Distinct indicator places of a text. Holds scratch space, so one per task."""

    def __init__(self):
        self.last = np.zeros(DIMS, np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        shape = np.frombuffer(raw.translate(SHAPE), np.uint8)
        tokens = raw.split()
        parts = [_place(np.array(_buckets(raw, shape, tokens), np.uint64), 1)]
        if len(raw) > 3:
            thin = np.ones(len(shape), bool)
            thin[2:] = (shape[2:] != shape[1:-1]) | (shape[2:] != shape[:-2])
            short = shape[thin]
            if len(short) > 3:
                parts.append(_place(_grams(short), 3))
        if tokens:
            word = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
            parts += [_place(word, 4), _place(word[:-1] * np.uint64(31) + word[1:], 5)]
        places = np.concatenate(parts)
        turn = np.arange(len(places))
        self.last[places] = turn  # the last of equal places wins: distinct without sorting
        return places[self.last[places] == turn]


@dataclass
class Model:
    weights: np.ndarray | None  # log-count ratio times fitted weight, per place
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 1.0

    def score(self, places: np.ndarray) -> float:
        if self.weights is None:
            return self.prior
        margin = self.weights[places].sum() / np.sqrt(len(places)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.ones((2, DIMS))
    for places, label in zip(rows, y):
        counts[int(label > 0), places] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int):
    """Linear SVM with hinge loss: min over alpha in [0, cost] of the dual, one coordinate at a time. Bias as a constant feature."""
    w, bias = np.zeros(DIMS), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if (change := new - alpha[i]) != 0:
                w[rows[i]] += change * y[i] * values[i]
                bias += change * y[i]
                alpha[i] = new
                moved = max(moved, abs(change))
        if moved < 1e-4:
            break
    return w, bias


def _fit_margins(rows, y, c, epochs, seed):
    ratio = log_count_ratios(rows, y)
    values = [ratio[r] / np.sqrt(len(r)) for r in rows]
    rate = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, bias = dual_coordinate_descent(rows, values, y, c * rate, epochs, seed)
    return ratio * w, bias


def _logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by damped Newton steps, targets smoothed by the class counts."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        theta -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 0.3, epochs: int = 10, seed: int = 7, folds: int = 3) -> Model:
    y = np.where(labels > 0, 1.0, -1.0)
    n1 = int((y > 0).sum())
    if n1 < folds or len(y) - n1 < folds:
        return Model(None, prior=(n1 + 1) / (len(y) + 1))
    fold = np.zeros(len(y), int)
    for sign in (1, -1):
        at = np.flatnonzero(y == sign)
        fold[at] = np.arange(len(at)) % folds
    margin = np.zeros(len(y))
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        weights, bias = _fit_margins([rows[i] for i in inside], y[inside], c, epochs, seed)
        for i in np.flatnonzero(fold == k):
            margin[i] = weights[rows[i]].sum() / np.sqrt(len(rows[i])) + bias
    slope, shift = _logistic_curve(margin, y)
    weights, bias = _fit_margins(rows, y, c, epochs, seed)
    return Model(weights.astype(np.float32), bias, slope, shift)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        places = [features(t).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(places, pa.binary()), batch.column(2)], names=["doc_id", "places", "label"])


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def train_quality(docs: DataFrame, labels: DataFrame, max_train: int = 4000, **options) -> Model:
    """Fit on the labelled documents outside the held-out quarter, ``max_train`` of them at most.

    The driver gets the distinct places of each one's features, four bytes a place and ``DIMS`` places at most: a megabyte for a very long
    text, some kilobytes for a usual one.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long"), "text", "label")  # max_train rows at most are broadcast
    found = rows.mapInArrow(_extract, "doc_id long, places binary, label int")
    found = found.groupBy("doc_id").agg(F.min(F.struct("places", "label")).alias("x")).select("x.*").toArrow()  # one row per labelled id
    order = sorted(range(found.num_rows), key=lambda i: (zlib.crc32(found["places"][i].as_py()), found["label"][i].as_py()))
    places = [np.frombuffer(found["places"][i].as_py(), "<i4").astype(np.int64) for i in order]
    return fit(places, np.array([found["label"][i].as_py() for i in order], np.int64), **options)


def score_quality(docs: DataFrame, model: Model, keep: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with the columns ``keep`` (all by default) and a last column ``score`` (0 to 1; underscores are added if there is one already).

    Whole rows pass through Python workers in bounded batches, and the result is written while that bound holds.
    """
    name = free_name(docs, "score")
    kept = docs.columns if keep is None else keep
    text, places = docs.columns.index("text"), [docs.columns.index(c) for c in kept]
    schema = T.StructType([*[docs.schema.fields[i] for i in places], T.StructField(name, T.DoubleType())])

    def score(batches):
        features = Features()
        for batch in batches:
            parts = (batch.column(text).slice(lo, 256).to_pylist() for lo in range(0, batch.num_rows, 256))  # few texts are alive at a time
            scores = [model.score(features(t)) for part in parts for t in part]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], pa.array(scores, pa.float64())], names=[*kept, name])

    return materialize(docs.mapInArrow(score, schema).where(F.col(name) >= least), "scored")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns."""
    model = train_quality(docs, labels, **options)
    if model.weights is None:  # nothing was learned that could reject a document
        return docs
    return score_quality(docs, model, least=threshold).select(*docs.columns)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score_quality(docs.select("doc_id", "text"), train_quality(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
