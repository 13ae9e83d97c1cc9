r"""Licence scans by ordered signature rules.

A text is normalised once: A-Z lower-cased, words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` joined by single spaces. A
rule's regular expression runs only where its keywords occur in that string, so that most texts
cost a few substring searches. What the rules find are *detections*, intervals of words with a label and
a priority. A detection that lies within another one of the same or a higher priority is suppressed (of equal
intervals and priorities the earlier rule stays), so "gpl" gives way to the "gpl-3.0-or-later" around it;
intervals that merely overlap both stay, and so does a high priority inside a lower one.

Beside the rules, the *base* phrases are counted at all their places; their labels are never suppressed. ``score`` is the
confidence of the strongest detection that stays or base phrase found, by its priority, and 0 without any.

Every row is scanned alone, by its whole text, in the map task that reads it: there is no shuffle, and a hot source or group of copies is as
any other rows. A text is held as bytes, two or three times at once, never as a list of words. Python gets a few
megabytes of rows at a time.

Defined results: a null text is empty and has no words; an empty text has score 0 and empty labels, and null
places; rows that repeat, and null ids, are scanned as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import materialize, read_table
from basinflow.llm.license_rules import BASE, CONFIDENCE, HINT, NAMED, RULES, Rule, compiled, keyword_index

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))
_SPACES = re.compile(b"  +")
BASE_CONFIDENCE = {label: CONFIDENCE[HINT if label == "reserved" else NAMED] for label, _ in BASE}

DETECTION = "array<struct<label:string,rule:int,priority:int,first_word:bigint,stop_word:bigint>>"
BASE_PLACES = "array<struct<label:string,n:bigint,first_word:bigint,last_word:bigint>>"
SCHEMA = f"doc_id long, n_words long, base {BASE_PLACES}, found {DETECTION}"


def normalized(text: bytes) -> bytes:
    """Words with a space before, between and after them; a single space if there are none."""
    return _SPACES.sub(b" ", b" " + text.translate(_TABLE) + b" ")


def base_places(words: bytes) -> list[tuple[str, int, int, int]]:
    """(label, places, first word, last word) of each base phrase that occurs."""
    out = []
    for label, phrase in BASE:
        needle = b" " + phrase.encode() + b" "
        n, at, last = 0, words.find(needle), -1
        first = at
        while at >= 0:
            n, last = n + 1, at
            at = words.find(needle, at + 1)
        if n:
            low = words.count(b" ", 0, first)
            out.append((label, n, low, low + words.count(b" ", first, last)))
    return out


def detections(words: bytes, rules: list[Rule], by_key: dict[bytes, list[int]]) -> list[tuple[int, int, int]]:
    """(start, stop, rule) in bytes of ``words``, of every rule whose keywords occur."""
    out = []
    for key, numbers in by_key.items():
        if key not in words:
            continue
        for n in numbers:
            if all(k.encode() in words for k in rules[n].keywords[1:]):
                out += [(m.start(), m.end(), n) for m in compiled(rules[n].pattern).finditer(words)]
    return out


def unsuppressed(found: list[tuple[int, int, int]], rules: list[Rule]) -> list[tuple[int, int, int]]:
    """Detections that lie within no other one of the same or a higher priority, in order of their start.

    In this order whatever contains a detection comes before it, so the furthest stop so far of each priority decides.
    What a suppressed detection contains is contained by what suppresses that, too.
    """
    furthest = [-1] * (max(CONFIDENCE) + 1)
    out = []
    for start, stop, n in sorted(found, key=lambda d: (d[0], -d[1], -rules[d[2]].priority, d[2])):
        priority = rules[n].priority
        if max(furthest[priority:]) < stop:
            out.append((start, stop, n))
        furthest[priority] = max(furthest[priority], stop)
    return out


def _scan(batches: Iterator[pa.RecordBatch], rules: list[Rule]) -> Iterator[pa.RecordBatch]:
    by_key = keyword_index(rules)
    base_type = pa.list_(pa.struct([("label", pa.string()), ("n", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("first_word", pa.int64()), ("stop_word", pa.int64())]))
    for batch in batches:
        counts, bases, founds = [], [], []
        for text in batch.column(1):
            words = normalized(text.as_py() or b"")
            counts.append(words.count(b" ") - 1)
            bases.append(base_places(words))
            kept, at, word = [], 0, -1
            for start, stop, n in unsuppressed(detections(words, rules, by_key), rules):
                word, at = word + words.count(b" ", at, start), start
                kept.append((rules[n].label, n, rules[n].priority, word, word + words.count(b" ", start, stop) + 1))
            founds.append(kept)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(bases, base_type), pa.array(founds, found_type)]
        yield pa.record_batch(columns, names=["doc_id", "n_words", "base", "found"])


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, base, found) per row: places of the base phrases, and the detections that stay (words from 0, ``stop_word`` excluded)."""
    listed = RULES if rules is None else rules
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return materialize(texts.mapInArrow(lambda it: _scan(it, listed), SCHEMA), "licenses")


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    done = scan_licenses(read_table(spark, sf_dir, "documents"))
    confidence = F.create_map(*[F.lit(x) for k, c in CONFIDENCE.items() for x in (k, c)])
    base = F.create_map(*[F.lit(x) for k, c in BASE_CONFIDENCE.items() for x in (k, c)])
    strengths = F.concat(F.transform("found.priority", lambda p: confidence[p]), F.transform("base.label", lambda x: base[x]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return done.select(
        "doc_id",
        "n_words",
        F.aggregate("base.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_base"),
        F.array_min("base.first_word").alias("first_word"),
        F.array_max("base.last_word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "found.label")).alias("labels"),
        F.coalesce(F.array_max(strengths), F.lit(0.0)).alias("score"),
    )
