"""Further joins and set operations, map, struct and JSON functions, sliding windows, approximate aggregates, Python functions, file formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from basinflow.plans.relational import money
from basinflow.sources.shared import fresh_path
from basinflow.sources.tables import read_files, register, table, write_files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""
SELECT coalesce(o_orderkey, -1) AS o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 350000) RIGHT JOIN customer ON c_custkey = o_custkey
WHERE c_nationkey < 5""")
def join_right(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 350000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").where("c_nationkey < 5").select("c_custkey")
    return big.join(customers, "c_custkey", "right").select(F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), "c_custkey")


@query("""
SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 400 * n_regionkey + 4000""")
def join_left_unequal(spark, sf_dir):
    """An outer join with an inequality beside the key: the key still deals the rows."""
    nations, suppliers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    on = (F.col("n_nationkey") == F.col("s_nationkey")) & (F.col("s_acctbal") > 400 * F.col("n_regionkey") + 4000)
    return nations.join(suppliers, on, "left").select("n_name", "s_suppkey")


@query("""
SELECT r_name, count(p_partkey) AS parts FROM region LEFT JOIN part ON p_size > 10 * r_regionkey AND p_size <= 10 * r_regionkey + 4 GROUP BY r_name""")
def join_left_ranges(spark, sf_dir):
    """An outer join on ranges alone. Spark broadcasts the five regions by their size; the outer side is kept by a second, keyed join."""
    regions, parts = table(spark, sf_dir, "region"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    at = F.col("p_size")
    met = regions.join(parts, (at > 10 * F.col("r_regionkey")) & (at <= 10 * F.col("r_regionkey") + 4))
    counts = met.groupBy("r_name").agg(F.count("p_partkey").alias("parts"))
    return regions.select("r_name").join(counts, "r_name", "left").select("r_name", F.coalesce("parts", F.lit(0)).alias("parts"))


@query("""
(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT k FROM (SELECT n_regionkey + 100 AS k FROM nation UNION SELECT r_regionkey + 103 FROM region)""")
def bag_operations(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    both = customers.intersectAll(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))
    nations = table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 100).alias("k"))
    either = nations.union(table(spark, sf_dir, "region").select((F.col("r_regionkey") + 103).alias("k"))).distinct()
    return both.unionAll(either)


@query("""
SELECT CAST(s AS TIMESTAMP) AS start, event_type, count(*) AS n
FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts) - INTERVAL 2 DAY]) AS s FROM events)
GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.window("ts", "3 days", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS views,
       string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names
FROM events GROUP BY user_id""")
def map_functions(spark, sf_dir):
    """Counts by type as a map of each user."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    seen = F.map_filter("m", lambda k, v: v > 0)
    return maps.select(
        "user_id",
        F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
        F.size(seen).cast("long").alias("kinds"),
        F.coalesce(F.try_element_at("m", F.lit("view")), F.lit(0)).alias("views"),
        F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"),
    )


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, '{"id":' || event_id || ',"k":"' || json_extract_string(props, '$.k') || '"}' AS packed,
       json_extract_string(props, '$.none') IS NULL AS lacks, CAST(len(json_keys(props)) AS BIGINT) AS keys
FROM events""")
def json_functions(spark, sf_dir):
    key = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        "event_id",
        key.alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), key.alias("k"))).alias("packed"),
        F.get_json_object("props", "$.none").isNull().alias("lacks"),
        F.size(F.json_object_keys("props")).cast("long").alias("keys"),
    )


@query("""
SELECT p_partkey, p_brand, p_size, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey // (p_size % 5) END AS share, TRY_CAST(substr(p_brand, 7) AS INTEGER) AS number
FROM part""")
def struct_and_try_functions(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.struct("p_partkey", F.struct("p_brand", "p_size").alias("kind")).alias("s"))
    parts = parts.withColumn("s", F.col("s").withField("number", F.substring("s.kind.p_brand", 7, 10).try_cast("int")))
    rest = F.col("s.kind.p_size") % 5
    return parts.select("s.p_partkey", "s.kind.*", F.floor(F.try_divide(F.col("s.p_partkey"), rest)).alias("share"), "s.number")


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers, CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS capitals,
       regexp_extract(text, '([A-Za-z]+)[.]', 1) AS before_stop, regexp_matches(text, '^[A-Z]') AS starts_big
FROM documents""")
def regexp_functions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).cast("long").alias("numbers"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("capitals"),
        F.regexp_extract("text", "([A-Za-z]+)[.]", 1).alias("before_stop"),
        F.regexp_like("text", F.lit("^[A-Z]")).alias("starts_big"),
    )


@query("""
SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, 6 * count(DISTINCT o_custkey) // 100 + 1 AS most_off, true AS customers_near,
       count(*) AS orders, true AS median_near
FROM orders GROUP BY o_orderpriority""")
def approximate_aggregates(spark, sf_dir):
    """Sketches beside the exact values: distinct customers within three standard errors of 2 % (and one), the median's rank within 1 in 1,000."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), "o_custkey", "o_totalprice")
    sketch = orders.groupBy("k").agg(
        F.approx_count_distinct("o_custkey", 0.02).alias("about"), F.countDistinct("o_custkey").alias("exact"), F.percentile_approx("o_totalprice", 0.5, 10_000).alias("mid")
    )
    ranks = orders.join(sketch.select("k", "mid"), "k").groupBy("k").agg(F.avg((F.col("o_totalprice") <= F.col("mid")).cast("double")).alias("rank"), F.count("*").alias("rows"))
    return sketch.join(ranks, "k").select(
        F.col("k").alias("o_orderpriority"),
        F.col("exact").alias("customers"),
        (F.floor(6 * F.col("exact") / 100) + 1).alias("most_off"),
        (F.abs(F.col("about") - F.col("exact")) <= F.floor(6 * F.col("exact") / 100) + 1).alias("customers_near"),
        F.col("rows").alias("orders"),
        (F.abs(F.col("rank") - 0.5) <= 0.001 + 1 / F.col("rows")).alias("median_near"),
    )


@query("SELECT p_partkey, round(p_retailprice * (1 + p_size / 100.0), 4) AS price FROM part")
def pandas_scalar(spark, sf_dir):
    @F.pandas_udf("double")
    def dearer(price: pd.Series, size: pd.Series) -> pd.Series:
        return price * (1 + size / 100.0)

    return table(spark, sf_dir, "part").select("p_partkey", F.round(dearer("p_retailprice", "p_size"), 4).alias("price"))


@query("""
SELECT p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 4) AS weighted FROM part GROUP BY p_brand""")
def pandas_aggregate(spark, sf_dir):
    """A grouped aggregate in pandas holds a group in one task, so each task gives its share first: sums by (brand, salt), then over salts."""

    @F.pandas_udf("double")
    def weighted(price: pd.Series, size: pd.Series) -> float:
        return float((price * size).sum())

    salted = table(spark, sf_dir, "part").withColumn("salt", F.pmod(F.xxhash64("p_partkey"), F.lit(8)))
    parts = salted.groupBy("p_brand", "salt").agg(weighted("p_retailprice", "p_size").alias("x"))
    weights = salted.groupBy("p_brand", "salt").agg(F.sum("p_size").alias("w"))
    both = parts.join(weights, ["p_brand", "salt"]).groupBy("p_brand").agg((F.sum("x") / F.sum("w")).alias("weighted"))
    return both.select("p_brand", F.round("weighted", 4).alias("weighted"))


#: Rows of a group that a pandas function gets, about: keys of few rows share a cell, a key of more is dealt in portions.
PORTION = 4096


def cell_of(key: Column, rows: int) -> Column:
    """A cell for each key, by hash; cells hold about ``PORTION`` of the ``rows``."""
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(1 + rows // PORTION))


def portion_of(row: Column, n: Column) -> Column:
    """A portion for each row, by hash, of a key that has ``n`` of them."""
    return F.pmod(F.xxhash64(row), F.ceil(n / PORTION))


@query("""
SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) * count(*) OVER u - CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER u AS BIGINT) AS off_times_n
FROM events WINDOW u AS (PARTITION BY user_id)""")
def pandas_grouped_map(spark, sf_dir):
    """Each value's distance from its user's mean, in cents times the user's events, so that it is a whole number. Groups are of about one size, whatever sizes users have.

    Rows with a null have cells of their own, since pandas holds a column with nulls as doubles.
    """

    def centre(part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(off_times_n=part["cents"] * part["n"] - part["total"])[["user_id", "event_id", "off_times_n"]]

    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"), F.monotonically_increasing_id().alias("row"))
    sums = events.groupBy(F.col("user_id").alias("of")).agg(F.count("*").alias("n"), F.sum("cents").alias("total"))
    cell, whole = cell_of(F.col("user_id"), events.count()), F.col("user_id").isNotNull() & F.col("event_id").isNotNull() & F.col("cents").isNotNull()
    dealt = events.join(sums, F.col("user_id").eqNullSafe(F.col("of"))).withColumn("cell", F.when(whole, cell).otherwise(-1 - cell)).withColumn("portion", portion_of(F.col("row"), F.col("n")))
    return dealt.drop("of", "row").groupBy("cell", "portion").applyInPandas(centre, "user_id long, event_id long, off_times_n long")


@query("""
SELECT customer.c_custkey, events.event_id FROM events JOIN customer ON c_custkey = user_id WHERE c_nationkey = 7 AND event_type = 'error'""")
def pandas_cogroup(spark, sf_dir):
    """Customers and their events meet in pandas, cell by cell. A customer is repeated for each portion of the events that it has, so that no pair of groups is large."""

    def meet(customers: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
        return customers.merge(events, left_on="c_custkey", right_on="user_id")[["c_custkey", "event_id"]]

    events = table(spark, sf_dir, "events").where("event_type = 'error' AND user_id IS NOT NULL").select("user_id", "event_id", F.monotonically_increasing_id().alias("row"))
    rows = events.count()
    sizes = events.groupBy(F.col("user_id").alias("of")).agg(F.count("*").alias("n"))
    dealt = events.join(sizes, F.col("user_id") == F.col("of")).select("user_id", "event_id", cell_of(F.col("user_id"), rows).alias("cell"), portion_of(F.col("row"), F.col("n")).alias("portion"))
    customers = table(spark, sf_dir, "customer").where("c_nationkey = 7").select("c_custkey").join(sizes, F.col("c_custkey") == F.col("of"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / PORTION) - 1))
    customers = customers.select("c_custkey", cell_of(F.col("c_custkey"), rows).alias("cell"), parts.alias("portion"))
    return customers.groupBy("cell", "portion").cogroup(dealt.groupBy("cell", "portion")).applyInPandas(meet, "c_custkey long, event_id long")


@query("""
SELECT s_suppkey, i AS nth, substr(s_name, i::BIGINT, 1) AS letter FROM supplier, LATERAL (SELECT unnest(range(1, length(s_name) + 1)) AS i)""")
def table_function(spark, sf_dir):
    @F.udtf(returnType="nth bigint, letter string")
    class Letters:
        def eval(self, text: str):
            for i, c in enumerate(text or "", 1):
                yield i, c

    register(spark, sf_dir, "supplier")
    spark.udtf.register("letters_of", Letters)
    return spark.sql("SELECT s_suppkey, nth, letter FROM supplier, LATERAL letters_of(s_name)")


@query("""
SELECT kind, n_nationkey, n_name, n_regionkey FROM nation, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS kind)""")
def formats_round_trip(spark, sf_dir):
    """The nations written in four formats, in folders by region, and read back with a declared schema."""
    nations = table(spark, sf_dir, "nation")
    back = None
    for kind in ("csv", "json", "orc", "parquet"):
        path = fresh_path(spark, f"nation_{kind}")
        write_files(nations, path, kind, partition_by=["n_regionkey"])
        rows = read_files(spark, path, kind, "n_nationkey int, n_name string, n_regionkey int").select(F.lit(kind).alias("kind"), *nations.columns)
        back = rows if back is None else back.unionByName(rows)
    return back


@query("""
SELECT o_orderstatus, month, total, round(sum(total) OVER (PARTITION BY o_orderstatus ORDER BY month ROWS UNBOUNDED PRECEDING), 2) AS so_far
FROM (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)""")
def running_totals(spark, sf_dir):
    """A window over a grouped result: the window sorts months, not orders."""
    register(spark, sf_dir, "orders")
    months = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(money(F.sum("o_totalprice")).alias("total"))
    months.createOrReplaceTempView("months")
    return spark.sql("SELECT *, round(sum(total) OVER (PARTITION BY o_orderstatus ORDER BY month ROWS UNBOUNDED PRECEDING), 2) AS so_far FROM months")
