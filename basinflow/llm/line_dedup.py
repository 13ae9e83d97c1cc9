r"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line with ``[\x20\x09-\x0D]`` stripped at both ends and A-Z
lower-cased; the index holds 128 bits of its SHA-256 and in how many documents it
has been seen so far. The index is a list of levels of *runs*, tables bucketed and
sorted by hash, so that merging two of them moves no rows. A batch of documents is
counted by hash and merged with the runs: hashes that the anti-join with every run
leaves are new and enter with the batch's count; hashes that a run has enter with
that run's count and the batch's added up, unless that count has reached
``min_docs``: such a hash is settled, and nothing more is written of it. So the
count of a hash stands in its newest entry, and an entry is dropped by a greater one
when a level holds ``fanout`` runs and they are compacted into one run of the next
level. Batches double in size: there are about log2 of them, and the last merge
is as large as the corpus.

Keys found in at least ``min_docs`` documents lose all their lines everywhere.
Counts are combined before every shuffle, so a line that a third of all documents
share is one row per task. Only hashes are merged; texts move once, to meet the
flags of their own lines.

Defined results: a null or empty text is one empty line, which has no key and
stays; lines whose key is shorter than ``min_chars`` code points stay; each row
counts as a document, also if its doc_id is null or repeated; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import Run, ascii_lower, ascii_strip, buckets_for, doubling_batch, first_batch, keyed_documents, materialize, read_table, table_path, with_doc_id, write_run


def line_keys(text: Column, min_chars: int = 1) -> Column:
    """An array with, for each line, 32 hex digits for its key, or '' for lines that have none."""

    def key(line: Column) -> Column:
        body = ascii_strip(line)
        return F.when(F.length(body) >= min_chars, F.substring(F.sha2(ascii_lower(body).cast("binary"), 256), 1, 32)).otherwise(F.lit(""))

    return F.transform(F.split(text, "\n", -1), key)


class LineIndex:
    """Levels of sorted runs (key, n): ``n`` documents had the key when the entry was written; the newest entry has most."""

    def __init__(self, min_docs: int, buckets: int, fanout: int = 2):
        self.min_docs, self.buckets, self.fanout = min_docs, buckets, fanout
        self.levels: list[list[Run]] = []

    def runs(self) -> list[DataFrame]:
        return [run.frame for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Add a batch, a row (key) for each document and key in it."""
        counts = keys.groupBy("key").agg(F.count("*").alias("n"))
        runs = self.runs()
        if not runs:
            return self._push(0, counts)
        batch = write_run(counts, "key", "batch", self.buckets)
        fresh = self.unseen(batch.frame)
        met = [batch.frame.join(run.select("key", F.col("n").alias("had")).hint("merge"), "key") for run in runs]
        again = reduce(DataFrame.unionByName, met).groupBy("key").agg(F.max("n").alias("n"), F.max("had").alias("had"))
        grown = again.where(F.col("had") < self.min_docs).select("key", (F.col("n") + F.col("had")).alias("n"))
        self._push(0, fresh.unionByName(grown))
        batch.drop()

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose key no run has."""
        for run in self.runs():
            batch = batch.join(run.select("key").hint("merge"), "key", "left_anti")
        return batch

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(write_run(run, "key", f"run{level}", self.buckets))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._newest([r.frame for r in old]))
            for run in old:
                run.drop()

    def _newest(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("key").agg(F.max("n").alias("n"))

    def common(self) -> DataFrame:
        """(key) of all that at least ``min_docs`` documents have."""
        return reduce(DataFrame.unionByName, self.runs()).where(F.col("n") >= self.min_docs).select("key").distinct()

    def drop(self) -> None:
        for level in self.levels:
            for run in level:
                run.drop()
        self.levels = []


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, base: int | None = None, fanout: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) per document; ``kept`` is what stays, joined by newlines. ``base``: documents of the first batch, one in 4 by default."""
    spark = docs.sparkSession
    keyed, plain = keyed_documents(docs)
    texts = keyed.select("doc", F.coalesce("text", F.lit("")).alias("text"))
    rows = keyed.count()
    batch, batches = doubling_batch(F.col("doc"), rows, base or first_batch(rows))
    path = table_path(spark, "lines")
    # A folder for each batch: a batch reads its own lines only.
    texts.select("doc", line_keys(F.col("text"), min_chars).alias("keys"), batch.alias("batch")).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc long, keys array<string>, batch int").parquet(path)
    index = LineIndex(min_docs, buckets_for(spark, rows), fanout)
    for b in range(batches):
        index.add(lines.where(F.col("batch") == b).select(F.explode(F.array_distinct("keys")).alias("key")).where("key <> ''"))
    common = materialize(index.common().select("key", F.lit(True).alias("hit")), "common")
    index.drop()
    flags = (
        lines.select("doc", F.posexplode("keys").alias("pos", "key"))
        .join(common, "key", "left")
        .groupBy("doc")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("flags"))
        .select("doc", F.col("flags.hit").alias("flags"))
    )
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.col("flags")[i])
    done = texts.join(flags, "doc").select("doc", F.size("flags").cast("long").alias("n_lines"), kept.alias("lines"))
    done = done.select("doc", "n_lines", (F.col("n_lines") - F.size("lines")).alias("n_dropped"), F.array_join("lines", "\n").alias("kept"))
    return with_doc_id(done, keyed, plain)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(read_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), f AS (
  SELECT k.*, c.key IS NOT NULL AS hit FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (hit) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
