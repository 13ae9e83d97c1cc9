"""Mixing sources to target weights by Poisson replication.

A source with N_s of the N documents and target share w_s is repeated r_s =
w_s * budget / N_s times on average (``budget``: documents in the mixture, all N
unless given). Each document draws its own count from a Poisson distribution of
mean r_s by inverting its distribution function at a uniform number hashed from
(seed, doc_id), is exploded by that count, and the copies are sorted by a hash of
(seed, doc_id, copy), a global shuffle. Counts need no coordination, are the same
whenever they are computed, and sum to the target within a few square roots.

A mean above ``STEP`` is split into equal parts that are drawn separately and
added, which is exact and keeps exp(-mean) away from zero. Rates are one row per
source: they are broadcast only if there are at most ``MAX_RATES`` of them,
otherwise joined on (source, salt), so no source gathers in one task.

Defined results: a null source is a source of its own; a null doc_id draws by a
hash of its text; repeated rows draw the same count; texts may be null or empty; a
source without weight gets none; an empty table gives no rows; every input column
is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import free_name, let, materialize, read_table

#: Largest mean that is inverted in one piece.
STEP = 16.0
#: Terms of the distribution function; beyond it P(count) < 2**-80 at mean STEP.
TERMS = 96
MAX_RATES = 10_000
SALTS = 32


def hashed_uniform(*parts: Column) -> Column:
    """A double in [0, 1) from 52 bits of the MD5 of the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_parts(mean: Column) -> Column:
    """In how many equal parts a mean is drawn."""
    return F.greatest(F.lit(1), F.ceil(mean / F.lit(STEP)).cast("int"))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of one part of Poisson(mean), until they stop growing."""
    part = mean / poisson_parts(mean)
    first = F.exp(-part)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * part / i
        last = F.element_at(acc["cdf"], -1)
        grown = F.when(last + p > last, F.concat(acc["cdf"], F.array(last + p))).otherwise(acc["cdf"])
        return F.struct(p.alias("p"), grown.alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["cdf"]


def poisson_count(key: Column, parts: Column, cdf: Column, seed: int) -> Column:
    """A count hashed from (seed, key): for each part the least k with P(X <= k) above a uniform number."""

    def invert(u: Column) -> Column:
        return F.size(F.filter(cdf, lambda c: c <= u))

    draws = F.transform(F.sequence(F.lit(1), parts), lambda j: let(hashed_uniform(F.lit(seed), key, j), invert))
    return F.aggregate(draws, F.lit(0), lambda a, x: a + x)


def source_rates(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, budget: int | None = None) -> DataFrame:
    """(source, rate): mean repetitions. Without ``weights`` shares are proportional to N_s ** alpha."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n")).select("source", "n")
    if weights is not None:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "named string, w double")
        # ``given`` is as large as the argument
        counts = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("named")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    else:
        counts = counts.withColumn("w", F.pow("n", F.lit(float(alpha))))
    counts = materialize(counts, "source_counts")
    total = counts.agg(F.sum("n"), F.sum("w")).first()
    docs_out, weight = float(budget if budget is not None else total[0] or 0), float(total[1] or 0) or 1.0
    return counts.select("source", (F.col("w") / F.lit(weight) * F.lit(docs_out) / F.col("n")).alias("rate"))


def mix_sources(
    docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, budget: int | None = None, seed: int = 42
) -> DataFrame:
    """The mixture in shuffled order: the columns of ``docs``, then ``mix_copy`` (from 1) and ``mix_key`` (or free names like them)."""
    columns = docs.columns
    name = {c: free_name(docs, f"mix_{c}") for c in ("copy", "key", "parts", "cdf", "source", "salt", "own_salt", "n", "id")}
    rates = source_rates(docs, weights, alpha, budget)
    # The distribution function is laid out once per source; a document only looks its number up.
    laid = [F.col("source").alias(name["source"]), poisson_parts(F.col("rate")).alias(name["parts"]), poisson_cdf(F.col("rate")).alias(name["cdf"])]
    rates = materialize(rates.select(*laid), "rates")
    same = F.col("source").eqNullSafe(F.col(name["source"]))
    if rates.count() <= MAX_RATES:
        rated = docs.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn(name["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = docs.withColumn(name["own_salt"], F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        rated = spread.join(salted, same & (F.col(name["salt"]) == F.col(name["own_salt"])))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    counted = rated.select(*columns, key.alias(name["id"]), poisson_count(key, F.col(name["parts"]), F.col(name["cdf"]), seed).alias(name["n"]))
    copies = counted.where(F.col(name["n"]) > 0).withColumn(name["copy"], F.explode(F.sequence(F.lit(1), F.col(name["n"]))))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), name["id"], name["copy"]).cast("binary"))
    return copies.select(*columns, name["copy"], order.alias(name["key"])).orderBy(name["key"])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"), alpha=0.5, seed=42)


OP4_SQL = """
WITH RECURSIVE c AS (
  SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source
), r AS (
  SELECT source, w / (SELECT sum(w) FROM c) * CAST((SELECT sum(n) FROM c) AS DOUBLE) / n AS rate FROM c
), j AS (
  SELECT source, rate, greatest(1, CAST(ceil(rate / 16.0) AS INT)) AS parts FROM r
), t(source, parts, mean, k, p, cdf) AS (
  SELECT source, parts, rate / parts, 0, exp(-rate / parts), exp(-rate / parts) FROM j
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM t WHERE k < 96
), d AS (
  SELECT d.*, q.j, CAST('0x' || substr(md5('42:' || doc_id || ':' || q.j), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents d JOIN j ON d.source = j.source, LATERAL (SELECT unnest(range(1, j.parts + 1)) AS j) q
), n AS (
  SELECT d.doc_id, d.j, min(t.k) AS k FROM d JOIN t ON d.source = t.source AND t.cdf > d.u GROUP BY d.doc_id, d.j
), s AS (
  SELECT doc_id, CAST(sum(k) AS BIGINT) AS copies FROM n GROUP BY doc_id
)
SELECT d.*, CAST(q.c AS INTEGER) AS mix_copy, md5('42/order:' || d.doc_id || ':' || q.c) AS mix_key
FROM documents d JOIN s ON d.doc_id = s.doc_id, LATERAL (SELECT unnest(range(1, s.copies + 1)) AS c) q
"""
