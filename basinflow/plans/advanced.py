"""Neighbours, funnels, global ranks, overlaps, table functions over partitions, stored sketches, heavy hitters, variants and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinflow.operators.frequent import frequent_words
from basinflow.operators.funnels import match_steps
from basinflow.operators.joins import overlap_join
from basinflow.operators.layout import buckets_for, write_bucketed, write_morton, write_partitioned
from basinflow.operators.neighbors import build_index, exact_neighbors, search_index
from basinflow.operators.ranks import global_ranks
from basinflow.operators.runs import encode_runs
from basinflow.operators.windows import sessionize
from basinflow.sources.shared import fresh_path, write_down
from basinflow.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """A query with its SQL, or without any where SQL can't express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
     s AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, list_cosine_similarity(q.v, r.v) AS s FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, neighbor_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbor_id) AS rank, round(s, 6) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbor_id) <= 5""")
def neighbors_exact(spark, sf_dir):
    """The five nearest rows to each hundredth one, of all rows, in blocks."""
    rows = table(spark, sf_dir, "embeddings")
    found = exact_neighbors(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return found.select("query_id", "neighbor_id", "rank", F.round("score", 6).alias("score"))


@query(None)
def neighbors_indexed(spark, sf_dir):
    """The same through an inverted file, with the recall that its number of probes gave on other rows."""
    rows = table(spark, sf_dir, "embeddings")
    index = build_index(rows, "vec_id", "embedding", 5)
    if index is None:
        return spark.createDataFrame([], "query_id long, neighbor_id long, rank long, score double, tuned_recall double")
    found = search_index(index, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return found.select("query_id", "neighbor_id", "rank", F.round("score", 6).alias("score"), F.lit(index.recall).alias("tuned_recall"))


@query("""
WITH v AS (
  SELECT user_id, ts AS t1, (SELECT min(c.ts) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts > e.ts) AS c FROM events e WHERE event_type = 'view'
), m AS (
  SELECT user_id, t1, c, (SELECT min(p.ts) FROM events p WHERE p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts > v.c) AS p FROM v
), r AS (
  SELECT user_id, t1, c AS t2, p AS t3, 1 + CASE WHEN c <= t1 + INTERVAL 1 DAY THEN 1 ELSE 0 END + CASE WHEN c <= t1 + INTERVAL 1 DAY AND p <= t1 + INTERVAL 1 DAY THEN 1 ELSE 0 END AS reached FROM m
)
SELECT user_id, max(reached) AS reached, count(*) AS views, count(*) FILTER (reached = 3) AS completed, min(t1) FILTER (reached = 3) AS viewed,
       min(t2) FILTER (reached = 3) AS clicked, min(t3) FILTER (reached = 3) AS bought
FROM r GROUP BY user_id""")
def funnel(spark, sf_dir):
    """View, click and purchase within a day of the view: how far each user came, and the first match."""
    kind = lambda name: F.col("event_type") == name
    starts = match_steps(table(spark, sf_dir, "events"), "user_id", "ts", [kind("view"), kind("click"), kind("purchase")], 86_400)
    whole = F.col("reached") == 3
    stamp = lambda c: F.min(F.when(whole, F.col(c))).cast("timestamp_ntz")
    return starts.groupBy("user_id").agg(
        F.max("reached").alias("reached"), F.count("*").alias("views"), F.count_if(whole).alias("completed"), stamp("t1").alias("viewed"), stamp("t2").alias("clicked"), stamp("t3").alias("bought")
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER w AS row_no, rank() OVER p AS rank_no, ntile(100) OVER w AS tile, round(percent_rank() OVER p, 9) AS share
FROM lineitem
WINDOW w AS (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey), p AS (ORDER BY l_extendedprice DESC)""")
def global_rank(spark, sf_dir):
    """Ranks over all lines, without a window that one task holds. Lines that are equal in all of these columns are equal in the result."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return global_ranks(lines, order, ["l_extendedprice"], 100).withColumn("share", F.round("share", 9))


@query("""
WITH b AS (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), n AS (SELECT user_id, ts, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session_no FROM b
), s AS (SELECT user_id, session_no, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM n GROUP BY ALL HAVING max(ts) > min(ts))
SELECT a.user_id AS user_a, a.session_no AS session_a, b.user_id AS user_b, b.session_no AS session_b, (least(a.hi, b.hi) - greatest(a.lo, b.lo)) // 1000000 AS shared_seconds
FROM s a JOIN s b ON a.lo < b.hi AND b.lo < a.hi AND a.user_id < b.user_id""")
def overlapping_sessions(spark, sf_dir):
    """Sessions of different users that overlap, and for how long."""
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    numbered = sessionize(events, "user_id", "ts", 1800).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = write_down(numbered.groupBy("user_id", "session_no").agg(F.min("at").alias("lo"), F.max("at").alias("hi")), "spans")
    met = overlap_join(spans, spans, "lo", "hi", 3_600_000_000).where("l.user_id < r.user_id")
    shared = F.least("l.hi", "r.hi") - F.greatest("l.lo", "r.lo")
    return met.select(
        F.col("l.user_id").alias("user_a"), F.col("l.session_no").alias("session_a"), F.col("r.user_id").alias("user_b"), F.col("r.session_no").alias("session_b"),
        F.floor(shared / 1_000_000).alias("shared_seconds"),
    )


@query("""
WITH c AS (
  SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), n AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_no FROM c)
SELECT user_id, run_no, any_value(event_type) AS event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM n GROUP BY user_id, run_no""")
def runs_of_types(spark, sf_dir):
    """Run-length encoding of each user's event types, by a table function over partitions."""
    return encode_runs(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")


@query("""
SELECT week, count(DISTINCT user_id) AS users, 5 * count(DISTINCT user_id) // 100 + 1 AS most_off, true AS users_near, count(*) AS n, true AS median_near
FROM (SELECT date_trunc('week', ts)::TIMESTAMP AS week, user_id FROM events) GROUP BY week""")
def stored_sketches(spark, sf_dir):
    """Sketches kept per day and merged per week, beside the exact values.

    HyperLogLog with 2**12 registers has a standard error of 1.6 %: users are within three of them (and one). A KLL sketch with k = 400
    has a rank error under 1 %: the rank of its median is within that, and one row.
    """
    events = table(spark, sf_dir, "events").select("user_id", "value", F.to_date("ts").alias("day"))
    kept = events.groupBy("day").agg(F.hll_sketch_agg("user_id", 12).alias("users"), F.kll_sketch_agg_double("value", 400).alias("values"), F.count("*").alias("n"))
    kept = write_down(kept, "sketches")
    week = F.date_trunc("week", "day").cast("timestamp_ntz").alias("week")
    merged = kept.groupBy(week).agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("about"), F.kll_merge_agg_double("values").alias("kll"))
    merged = merged.select("week", "about", F.kll_sketch_get_quantile_double("kll", F.lit(0.5)).alias("mid"))
    rows = events.select(week, "user_id", "value").join(merged, "week")
    exact = rows.groupBy("week").agg(
        F.countDistinct("user_id").alias("users"), F.count("*").alias("n"), F.first("about").alias("about"),
        F.avg((F.col("value") <= F.col("mid")).cast("double")).alias("rank"),
    )
    most = F.floor(5 * F.col("users") / 100) + 1
    return exact.select(
        "week", "users", most.alias("most_off"), (F.abs(F.col("about") - F.col("users")) <= most).alias("users_near"), "n",
        (F.abs(F.col("rank") - 0.5) <= 0.01 + 1 / F.col("n")).alias("median_near"),
    )


@query("""
WITH w AS (SELECT unnest(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ')) AS word FROM documents),
     c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word)
SELECT word, n, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS total FROM c WHERE n * 1000 > (SELECT sum(n) FROM c)""")
def heavy_words(spark, sf_dir):
    """Words that are more than 1 in 1,000 of all words."""
    words = F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")
    found, total = frequent_words(table(spark, sf_dir, "documents"), words, 1000)
    return found.select(F.col("item").alias("word"), "n", F.lit(total).cast("long").alias("total"))


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, round(value, 2) AS value, event_type AS kind, user_id AS user, CAST(user_id AS VARCHAR) || ':' || event_type AS second_tag,
       TRUE AS lacks, CAST(NULL AS INTEGER) AS wrong, 'OBJECT<props: OBJECT<k: STRING>, tags: ARRAY<STRING>, user: BIGINT, v: DECIMAL(18,2)>' AS shape
FROM events""")
def variant_fields(spark, sf_dir):
    """Events as variants: typed paths, a missing one, one of another type, and the schema that all rows share."""
    made = F.to_json(
        F.struct(
            F.from_json("props", "k string").alias("props"), F.col("value").cast("decimal(18,2)").alias("v"), F.col("user_id").alias("user"),
            F.array("event_type", F.concat_ws(":", "user_id", "event_type")).alias("tags"),
        )
    )
    events = table(spark, sf_dir, "events").select("event_id", F.parse_json(made).alias("x"))
    shape = events.agg(F.schema_of_variant_agg("x").alias("s")).select(F.regexp_replace("s", r"DECIMAL\(\d+,\d+\)", "DECIMAL(18,2)").alias("shape"))
    get = lambda path, kind: F.variant_get("x", path, kind)
    typed = events.select(
        "event_id", get("$.props.k", "string").alias("k"), F.round(get("$.v", "double"), 2).alias("value"), get("$.tags[0]", "string").alias("kind"),
        get("$.user", "bigint").alias("user"), get("$.tags[1]", "string").alias("second_tag"), get("$.none", "string").isNull().alias("lacks"),
        F.try_variant_get("x", "$.tags", "int").alias("wrong"),
    )
    return typed.withColumn("shape", F.lit(shape.first()["shape"] if not events.isEmpty() else None).cast("string"))


@query("""
SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders, (SELECT max(o_custkey) AS m FROM orders)
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01' AND o_custkey BETWEEN m // 4 AND m // 2""")
def box_on_morton(spark, sf_dir):
    """A box of dates and customers from orders laid out by Morton codes, where row groups are boxes too."""
    orders, path = table(spark, sf_dir, "orders"), fresh_path(spark, "morton")
    write_morton(orders, path, F.unix_date(F.col("o_orderdate").cast("date")), F.col("o_custkey"))
    most = orders.agg(F.max("o_custkey")).first()[0] or 0
    box = F.col("o_custkey").between(most // 4, most // 2) & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-07-01").cast("timestamp_ntz"))
    return spark.read.schema(orders.schema).parquet(path).where(box).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


@query("""
SELECT o_orderstatus, count(DISTINCT o_orderkey) AS orders, count(*) AS lines, round(sum(l_extendedprice), 2) AS price
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus""")
def bucketed_join(spark, sf_dir):
    """Orders and lines as tables bucketed by order, in buckets of bounded size: the join moves no rows."""
    buckets = buckets_for(table(spark, sf_dir, "lineitem").count())
    name = f"bucketed_{fresh_path(spark, 'x').split('/')[-2]}"
    orders = write_bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), f"{name}_orders", "o_orderkey", buckets)
    lines = write_bucketed(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice"), f"{name}_lines", "o_orderkey", buckets)
    met = orders.hint("merge").join(lines, "o_orderkey")
    per_order = met.groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").alias("lines"), F.sum("l_extendedprice").alias("price"))
    done = write_down(per_order.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.round(F.sum("price"), 2).alias("price")), "by_status")
    spark.sql(f"DROP TABLE {name}_orders")
    spark.sql(f"DROP TABLE {name}_lines")
    return done


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def partitioned_scan(spark, sf_dir):
    """Orders in folders by status: a filter on it reads one folder."""
    path = fresh_path(spark, "by_status")
    write_partitioned(table(spark, sf_dir, "orders"), path, "o_orderstatus", "o_orderdate")
    kept = spark.read.parquet(path).where("o_orderstatus = 'F'")
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
