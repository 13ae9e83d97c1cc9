"""Frequent items, exactly, without a shuffle by every item."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.sources.shared import write_down


def _summaries(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A task's frequent-items summary: at most ``size`` items, each counted too low by at most ``short``, which is at most rows / (size + 1)."""
    held: Counter[str] = Counter()
    total = short = 0
    for batch in batches:
        for text in batch.column(0):
            words = (text.as_py() or "").split(" ")
            got = Counter(w for w in words if w)
            total += got.total()
            held.update(got)
            if len(held) > 8 * size:  # trimmed now and then; what is subtracted from all is counted in ``short``
                cut = sorted(held.values(), reverse=True)[size]
                short += cut
                held = Counter({w: n - cut for w, n in held.items() if n > cut})
    if len(held) > size:
        cut = sorted(held.values(), reverse=True)[size]
        short += cut
        held = Counter({w: n - cut for w, n in held.items() if n > cut})
    yield pa.record_batch(
        [pa.array([None, *held], pa.string()), pa.array([total, *held.values()], pa.int64()), pa.array([short] + [0] * len(held), pa.int64())], names=["item", "n", "short"]
    )


def frequent_words(df: DataFrame, words: Column, one_in: int, slack: int = 10) -> tuple[DataFrame, int]:
    """(item, n) of every word with more than 1 / ``one_in`` of all places, with its exact count, and the number of places.

    ``words`` is a text whose words are separated by single or several spaces. Each task sums up its words by the frequent-items rule of Misra and
    Gries, with ``slack * one_in`` counters: a subtracted count goes off that many counters at once, so no word is counted too low by more than
    1 in ``slack * one_in`` of the task's words. Only summaries are shuffled. The words whose summed counts, made good by what was
    subtracted, reach the share are candidates: all that are frequent, and fewer than ``one_in * slack / (slack - 1)``, which bounds what the second,
    exact pass broadcasts. A null or empty text has no words; without words there are no rows.
    """
    parts = df.select(words.alias("w")).mapInArrow(lambda it: _summaries(it, slack * one_in), "item string, n long, short long")
    parts = write_down(parts, "summaries")
    total, short = parts.where("item IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("short"), F.lit(0))).first()
    candidates = parts.where("item IS NOT NULL").groupBy("item").agg(F.sum("n").alias("n")).where((F.col("n") + short) * one_in > total).select("item")
    found = df.select(F.explode(F.split(words, " +")).alias("item")).join(F.broadcast(candidates), "item", "left_semi")
    return found.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") * one_in > total), total
