"""Scans, aggregates, joins, set operations and windows over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basinflow.functions.vectors import cosine
from basinflow.operators.joins import asof_join, interval_join, salted_join
from basinflow.operators.quantiles import exact_quantiles
from basinflow.operators.windows import dedup_latest, sessionize, top_k_per_group
from basinflow.sources.tables import register, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def money(c) -> F.Column:
    return F.round(c, 2)


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-01-01' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-01-01").cast("timestamp_ntz"))
    price = F.col("l_extendedprice")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        money(F.sum("l_quantity")).alias("sum_qty"),
        money(F.sum(price)).alias("sum_base"),
        money(F.sum(price * (1 - F.col("l_discount")))).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, upper(l_returnflag) || '-' || l_linestatus AS tag
FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.02 AND 0.04 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'O%'""")
def filter_project(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    kept = lines.where((F.col("l_quantity") > 45) & F.col("l_discount").between(0.02, 0.04) & F.col("l_returnflag").isin("A", "R") & F.col("l_linestatus").like("O%"))
    tag = F.concat(F.upper("l_returnflag"), F.lit("-"), "l_linestatus")
    return kept.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("twice"), tag.alias("tag"))


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY n_name""")
def local_supplier_volume(spark, sf_dir):
    register(spark, sf_dir, "customer", "orders", "lineitem", "supplier", "nation", "region")
    return spark.sql("""
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1999-01-01'
        GROUP BY n_name""")


@query("""
SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-01-01' AND l_shipdate > TIMESTAMP '1997-01-01'
GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def shipping_priority(spark, sf_dir):
    at = F.lit("1997-01-01").cast("timestamp_ntz")
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < at).join(wanted, "o_custkey", "left_semi")
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > at).withColumnRenamed("l_orderkey", "o_orderkey")
    revenue = money(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue")
    return orders.join(lines, "o_orderkey").groupBy("o_orderkey", "o_orderdate").agg(revenue).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("""
SELECT o_orderpriority, o_orderstatus, CAST(grouping_id(o_orderpriority, o_orderstatus) AS BIGINT) AS gid, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""")
def cube_orders(spark, sf_dir):
    out = table(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus")
    return out.agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), money(F.sum("o_totalprice")).alias("total"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g1, CAST(grouping(l_linestatus) AS BIGINT) AS g2
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_lines(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return out.agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"))


@query("""
SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(max(o_totalprice), 2) AS top
FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())""")
def grouping_sets(spark, sf_dir):
    register(spark, sf_dir, "orders")
    return spark.sql("""
        SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(max(o_totalprice), 2) AS top
        FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())""")


@query("""
SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, round(stddev_samp(o_totalprice), 4) AS sd, round(var_pop(o_totalprice) / 1e6, 4) AS vp,
       round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(corr(o_totalprice, CAST(o_custkey AS DOUBLE)), 6) AS co
FROM orders GROUP BY o_orderpriority""")
def order_statistics(spark, sf_dir):
    price = F.col("o_totalprice")
    orders = table(spark, sf_dir, "orders")
    plain = orders.groupBy("o_orderpriority").agg(
        F.countDistinct("o_custkey").alias("customers"),
        F.round(F.stddev_samp(price), 4).alias("sd"),
        F.round(F.var_pop(price) / 1e6, 4).alias("vp"),
        F.round(F.corr(price, F.col("o_custkey").cast("double")), 6).alias("co"),
    )
    ranked = exact_quantiles(orders, "o_orderpriority", "o_totalprice", {"med": 0.5, "p90": 0.9})
    ranked = ranked.select(F.col("o_orderpriority").alias("k"), F.round("med", 4).alias("med"), F.round("p90", 4).alias("p90"))
    return plain.join(ranked, F.col("o_orderpriority").eqNullSafe(F.col("k"))).drop("k")


@query("""
SELECT c_mktsegment, count(*) FILTER (c_acctbal < 0) AS negative, max_by(c_custkey, c_acctbal) AS richest, min(c_name) AS first_name,
       bool_or(c_acctbal > 9990) AS any_rich
FROM customer GROUP BY c_mktsegment""")
def conditional_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count_if(F.col("c_acctbal") < 0).alias("negative"),
        F.max_by("c_custkey", "c_acctbal").alias("richest"),
        F.min("c_name").alias("first_name"),
        F.bool_or(F.col("c_acctbal") > 9990).alias("any_rich"),
    )


@query("""
SELECT l_returnflag, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS f, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS o
FROM lineitem GROUP BY l_returnflag""")
def pivot_lines(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
    return out.select("l_returnflag", F.coalesce("F", F.lit(0.0)).alias("f"), F.coalesce("O", F.lit(0.0)).alias("o"))


@query("""
SELECT s_suppkey, kind, value FROM (
  SELECT s_suppkey, 'balance' AS kind, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier)""")
def unpivot_suppliers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot(["s_suppkey"], ["balance", "nation"], "kind", "value")


@query("SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def join_left(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))


@query("""
SELECT coalesce(s_suppkey, -1) AS s_suppkey, coalesce(c_custkey, -1) AS c_custkey, coalesce(s_nationkey, c_nationkey) AS nation
FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9900) ON s_nationkey = c_nationkey""")
def join_full(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9900")
    joined = s.join(c, s["s_nationkey"] == c["c_nationkey"], "full")
    missing = F.lit(-1).cast("long")
    return joined.select(F.coalesce("s_suppkey", missing).alias("s_suppkey"), F.coalesce("c_custkey", missing).alias("c_custkey"), F.coalesce("s_nationkey", "c_nationkey").alias("nation"))


@query("""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)
UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def join_semi_anti(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    some = orders.join(lines.where("l_quantity > 49"), "o_orderkey", "left_semi").select("o_orderkey")
    none = orders.join(lines, "o_orderkey", "left_anti").select((-F.col("o_orderkey") - 1).alias("o_orderkey"))
    return some.unionAll(none)


@query("""
SELECT p_partkey, p_brand, round(p_retailprice, 2) AS price FROM part p
WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.05 FROM part q WHERE q.p_brand = p.p_brand)""")
def correlated_average(spark, sf_dir):
    register(spark, sf_dir, "part")
    return spark.sql("""
        SELECT p_partkey, p_brand, round(p_retailprice, 2) AS price FROM part p
        WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.05 FROM part q WHERE q.p_brand = p.p_brand)""")


@query("""
SELECT event_id, e.user_id, coalesce((SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate = m.at), -1) AS o_orderkey
FROM events e LEFT JOIN LATERAL (SELECT max(o_orderdate) AS at FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate <= e.ts - INTERVAL 1500 DAY) m ON true""")
def join_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 1500 DAY")).alias("ts"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey")
    return asof_join(events, orders, "user_id", "ts", "o_orderdate", ["o_orderkey"]).select("event_id", "user_id", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))


@query("""
SELECT c_custkey, p_partkey FROM customer JOIN part
  ON CAST(floor(c_acctbal) AS BIGINT) >= CAST(floor(p_retailprice) AS BIGINT) AND CAST(floor(c_acctbal) AS BIGINT) < CAST(floor(p_retailprice) AS BIGINT) + p_size
WHERE p_size < 3""")
def join_interval(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select("c_custkey", F.floor("c_acctbal").alias("at"))
    spans = table(spark, sf_dir, "part").where("p_size < 3").select("p_partkey", F.floor("p_retailprice").alias("a"), (F.floor("p_retailprice") + F.col("p_size")).alias("b"))
    return interval_join(points, spans, "at", "a", "b", width=4).select("c_custkey", "p_partkey")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus")
def join_salted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    joined = salted_join(orders, customers, "o_custkey", salts=4)
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), money(F.sum("o_totalprice")).alias("total"))


@query("""
SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier
UNION ALL (SELECT c_nationkey + 100 FROM customer EXCEPT SELECT s_nationkey + 100 FROM supplier WHERE s_acctbal > 0)
UNION ALL (SELECT n_regionkey + 1000 FROM nation EXCEPT ALL SELECT r_regionkey + 1000 FROM region)""")
def set_operations(spark, sf_dir):
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    key = lambda df, c, add=0: df.select((F.col(c) + add).alias("k"))
    both = key(customers.where("c_acctbal > 9000"), "c_nationkey").intersect(key(suppliers, "s_nationkey"))
    only = key(customers, "c_nationkey", 100).subtract(key(suppliers.where("s_acctbal > 0"), "s_nationkey", 100))
    bag = key(table(spark, sf_dir, "nation"), "n_regionkey", 1000).exceptAll(key(table(spark, sf_dir, "region"), "r_regionkey", 1000))
    return both.unionAll(only).unionAll(bag)


@query("""
SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank_no FROM orders) WHERE rank_no <= 2""")
def top_orders_per_customer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).drop("o_totalprice")


@query("""
SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS q,
       lag(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before,
       max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def window_functions(spark, sf_dir):
    by_priority = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.rank().over(by_priority).cast("long").alias("r"),
        F.dense_rank().over(by_priority).cast("long").alias("dr"),
        F.ntile(4).over(by_date).cast("long").alias("q"),
        F.lag("o_orderkey", 1, -1).over(by_date).alias("before"),
        F.max("o_totalprice").over(by_date.rowsBetween(-2, 0)).alias("moving"),
    )


@query("""
SELECT user_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session_no, event_id FROM (
  SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b FROM events)""")
def sessions(spark, sf_dir):
    return sessionize(table(spark, sf_dir, "events"), "user_id", "ts", 3600).select("user_id", F.col("session_no").cast("long").alias("session_no"), "event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event(spark, sf_dir):
    return dedup_latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("""
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type""")
def json_fields(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k string"))
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("p.k").cast("long")).alias("k"))


@query("""
SELECT c_custkey, length(c_name) AS len, CAST(strpos(c_name, '0') AS INTEGER) AS pos, replace(lower(c_name), '#', '_') AS low, substr(c_name, 3, 4) AS part,
       lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, regexp_replace(c_name, '[0-9]+', 'N') AS masked, reverse(c_mktsegment) AS back
FROM customer""")
def string_functions(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.length("c_name").cast("long").alias("len"),
        F.instr("c_name", "0").alias("pos"),
        F.replace(F.lower("c_name"), F.lit("#"), F.lit("_")).alias("low"),
        F.substring("c_name", 3, 4).alias("part"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"),
        F.regexp_replace("c_name", "[0-9]+", "N").alias("masked"),
        F.reverse("c_mktsegment").alias("back"),
    )


@query("""
SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofweek(o_orderdate) + 1 AS dow, dayofyear(o_orderdate) AS doy,
       CAST(CAST(last_day(o_orderdate) AS DATE) AS VARCHAR) AS month_end, CAST(CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS VARCHAR) AS due, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS age
FROM orders""")
def date_functions(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year(day).cast("long").alias("y"),
        F.quarter(day).cast("long").alias("q"),
        F.dayofweek(day).cast("long").alias("dow"),
        F.dayofyear(day).cast("long").alias("doy"),
        F.last_day(day).cast("string").alias("month_end"),
        F.date_add(day, 30).cast("string").alias("due"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).alias("age"),
    )


@query("""
SELECT doc_id, len(w) AS n_words, w[1] AS first_word, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS n_distinct,
       len(list_filter(w, lambda x: length(x) > 6)) AS n_long
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def array_functions(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("w"))
    return words.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.col("w")[0].alias("first_word"),
        F.size(F.array_distinct(F.transform("w", F.lower))).cast("long").alias("n_distinct"),
        F.size(F.filter("w", lambda x: F.length(x) > 6)).cast("long").alias("n_long"),
    )


@query("""
SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) GROUP BY word HAVING count(*) >= 20""")
def word_counts(spark, sf_dir):
    # Counts by document combine before the first shuffle, as a document's words lie together, and by word before the second.
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ", -1)).alias("word"))
    in_doc = words.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return in_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs")).where("n >= 20")


@query("""
SELECT a.vec_id, b.label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS likeness
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("next_label"))
    joined = vectors.join(after, "vec_id")
    return joined.select("vec_id", F.col("next_label").alias("label"), F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("likeness"))


@query("""
SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, p_type, count(*) AS n, round(avg(p_retailprice), 4) AS price,
       count(nullif(p_brand, 'Brand#11')) AS others, round(sum(power(p_size, 2)), 0) AS squares, CAST(sum(p_size % 7) AS BIGINT) AS rest
FROM part GROUP BY ALL""")
def case_and_math(spark, sf_dir):
    size = F.col("p_size")
    kind = F.when(size < 10, "small").when(size < 30, "medium").otherwise("large")
    return table(spark, sf_dir, "part").groupBy(kind.alias("class"), "p_type").agg(
        F.count("*").alias("n"),
        F.round(F.avg("p_retailprice"), 4).alias("price"),
        F.count(F.nullif("p_brand", F.lit("Brand#11"))).alias("others"),
        F.round(F.sum(F.pow(size, F.lit(2))), 0).alias("squares"),
        F.sum(size % 7).alias("rest"),
    )
