"""Subqueries, lateral and recursive queries, ordered-set and regression aggregates, frames, gap filling and hashes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basinflow.plans.relational import money
from basinflow.sources.tables import register, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def same(name: str, sql: str, *tables: str) -> None:
    """A query whose SQL both engines read alike."""

    def run(spark, sf_dir):
        register(spark, sf_dir, *tables)
        return spark.sql(sql)

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


same(
    "subquery_in_not_in",
    """SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS near_rich,
              (SELECT count(*) FROM region) AS regions
       FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 AND o_custkey IS NOT NULL)""",
    "customer", "supplier", "orders", "region",
)
same(
    "cte_chain",
    """WITH spent AS (SELECT o_custkey AS k, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY o_custkey),
            best AS (SELECT k, s, n FROM spent WHERE n >= 12)
       SELECT c_mktsegment, count(*) AS customers, round(max(s), 2) AS most FROM best JOIN customer ON k = c_custkey GROUP BY c_mktsegment""",
    "orders", "customer",
)
same(
    "recursive_series",
    """WITH RECURSIVE t(k, depth, way) AS (
         SELECT s_suppkey, CAST(0 AS BIGINT), CAST(s_suppkey AS VARCHAR(500)) FROM supplier WHERE s_suppkey = 0
         UNION ALL SELECT s.s_suppkey, t.depth + 1, CAST(t.way || '/' || s.s_suppkey AS VARCHAR(500)) FROM supplier s JOIN t ON floor((s.s_suppkey - 1) / 4) = t.k WHERE s.s_suppkey > 0)
       SELECT k, depth, way FROM t""",
    "supplier",
)
same(
    "regression",
    """SELECT o_orderstatus, round(regr_slope(o_totalprice, CAST(o_orderkey AS DOUBLE)), 6) AS slope, round(regr_r2(o_totalprice, CAST(o_orderkey AS DOUBLE)), 6) AS r2,
              round(covar_samp(o_totalprice, CAST(o_orderkey AS DOUBLE)) / 1e6, 4) AS cov, regr_count(o_totalprice, o_orderkey) AS n
       FROM orders GROUP BY o_orderstatus""",
    "orders",
)
same(
    "value_windows",
    """SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_key, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) IS NULL AS lone,
              round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd,
              lead(o_orderkey, 1, -1) OVER w AS after
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "orders",
)
same(
    "multi_distinct",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY l_returnflag""",
    "lineitem",
)
same(
    "small_cross_join",
    "SELECT r_name, n_name, r_regionkey = n_regionkey AS member FROM region CROSS JOIN nation",
    "region", "nation",
)
same(
    "having_and_order",
    """SELECT l_suppkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_suppkey HAVING count(*) > 2 ORDER BY qty DESC, l_suppkey LIMIT 25""",
    "lineitem",
)
same(
    "distinct_pairs",
    "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "orders",
)


@query("""SELECT c_custkey, o_orderkey FROM customer, LATERAL (
         SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 2)
       WHERE c_nationkey = 3""")
def lateral_latest_two(spark, sf_dir):
    """The order stands in the window. Spark takes a correlated LIMIT as a window without an order over rows that were sorted before a shuffle, and the shuffle loses that order."""
    register(spark, sf_dir, "customer", "orders")
    return spark.sql("""
SELECT c_custkey, o_orderkey FROM customer, LATERAL (
  SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey NULLS LAST) AS nth FROM orders)
  WHERE o_custkey = c_custkey AND nth <= 2)
WHERE c_nationkey = 3""")


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
     m AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM c),
     d AS (SELECT p_brand, p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand) AS x FROM part)
SELECT part.p_brand, any_value(m.p_type) AS usual, string_agg(DISTINCT part.p_type, ',' ORDER BY part.p_type) AS types, CAST(bit_xor(p_partkey) AS BIGINT) AS bits,
       any_value(s.skew) AS skew
FROM part JOIN m ON m.p_brand = part.p_brand AND r = 1
JOIN (SELECT p_brand, round(avg(x * x * x) / power(avg(x * x), 1.5), 4) AS skew FROM d GROUP BY p_brand) s ON s.p_brand = part.p_brand
GROUP BY part.p_brand""")
def text_and_bit_aggregates(spark, sf_dir):
    """Of types that tie for the usual one the least is given; skewness is that of the population."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.mode("p_type", deterministic=True).alias("usual"),
        F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"),
        F.bit_xor("p_partkey").alias("bits"),
        F.round(F.skewness("p_retailprice"), 4).alias("skew"),
    )


@query("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, CAST(c_custkey AS VARCHAR) || '|' || c_mktsegment AS k FROM customer")
def hashes(spark, sf_dir):
    name = F.col("c_name").cast("binary")
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5(name).alias("m"), F.sha2(name, 256).alias("s"), F.concat_ws("|", F.col("c_custkey").cast("string"), "c_mktsegment").alias("k"))


@query("""
SELECT CAST(d AS VARCHAR) AS day, count(event_id) AS n FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS d)
LEFT JOIN events ON CAST(ts AS DATE) = d GROUP BY d""")
def filled_days(spark, sf_dir):
    spine = spark.sql("SELECT explode(sequence(DATE'2023-12-25', DATE'2024-02-05', INTERVAL 1 DAY)) AS d")
    counts = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return spine.join(counts, "d", "left").select(F.col("d").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""
SELECT user_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS events FROM (
  SELECT user_id, s, count(*) AS k FROM (
    SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
      SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)))
  GROUP BY ALL) GROUP BY user_id""")
def session_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = events.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count("*").alias("k"))
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("events"))


@query("""
SELECT event_type, count(*) FILTER (rn = 1) AS starters, count(*) FILTER (before = event_type) AS repeats FROM (
  SELECT event_type, row_number() OVER w AS rn, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) GROUP BY event_type""")
def event_paths(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts")
    steps = table(spark, sf_dir, "events").select("event_type", F.row_number().over(w).alias("rn"), F.lag("event_type").over(w).alias("before"))
    return steps.groupBy("event_type").agg(F.count_if(F.col("rn") == 1).alias("starters"), F.count_if(F.col("before") == F.col("event_type")).alias("repeats"))


@query("""
SELECT ts, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_day FROM events""")
def range_frame(spark, sf_dir):
    """Seconds are rounded, halves to even, as the SQL's cast of ``epoch(ts)`` to a whole number does."""
    events = table(spark, sf_dir, "events").withColumn("sec", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long"))
    w = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-86400, 0)
    return events.select("ts", "user_id", F.count("*").over(w).alias("last_day"))


@query("""
SELECT label, count(*) AS n, round(avg(list_sum(embedding::DOUBLE[])), 5) AS mean_sum, round(max(embedding[1]::DOUBLE), 6) AS top FROM embeddings GROUP BY label""")
def array_aggregates(spark, sf_dir):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(total), 5).alias("mean_sum"), F.round(F.max(F.col("embedding")[0].cast("double")), 6).alias("top"))


@query("""
SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, count(*) AS n, CAST(sum(CASE WHEN url LIKE '%?%' THEN 1 ELSE 0 END) AS BIGINT) AS queried FROM pages GROUP BY 1""")
def url_hosts(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("url").contains("?")).alias("queried"))


@query("""
SELECT o_orderstatus, date_trunc('month', o_orderdate)::TIMESTAMP AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""")
def monthly_totals(spark, sf_dir):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", month).agg(money(F.sum("o_totalprice")).alias("total"))


@query("""
SELECT * FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS copies FROM documents) WHERE copies > 1""")
def twin_documents(spark, sf_dir):
    """Documents whose text occurs several times, with the first of them. Only digests (SHA-256) are shuffled, and copies aren't paired."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    groups = docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return docs.join(groups, "digest").select("doc_id", "first_id", "copies")
