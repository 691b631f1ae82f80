"""Relational queries on the star schema and the events (extensions of the engine)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import relational
from loomwright.session import table


def x_star_join(spark, d):
    line, order, customer, nation, region = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy("r_name", "n_name").agg(revenue.alias("revenue"), F.count(F.lit(1)).alias("lines"))


def x_pricing_summary(spark, d):
    return (
        table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n"))
    )


def x_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def x_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def x_pivot(spark, d):
    kinds = ["view", "click", "purchase"]
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def x_top_orders(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return relational.top_per_key(rows, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


def x_ranks(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("c_mktsegment").orderBy(F.desc("orders"), F.asc("c_nationkey"))
    rows = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("orders"))
    return rows.select("c_mktsegment", "c_nationkey", "orders", F.rank().over(w).cast("long").alias("rank"), F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.cume_dist().over(w), 6).alias("share"))


def x_percentiles(spark, d):
    line = table(spark, d, "lineitem")
    middle = relational.exact_percentile(line, ["l_returnflag"], "l_extendedprice", 0.5, "median").select("l_returnflag", F.round("median", 4).alias("median"))
    return middle.join(line.groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("deviation")), "l_returnflag")


def x_set_all(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersectAll(b).select(F.lit("both").alias("kind"), "k").unionAll(a.exceptAll(b).select(F.lit("rest").alias("kind"), "k")).groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n"))


def x_semi_anti(spark, d):
    order, customer = table(spark, d, "orders"), table(spark, d, "customer")
    urgent = order.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return customer.join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def x_sessions(spark, d):
    rows = relational.sessions(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", 6 * 3600)
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"))


def x_tumbling(spark, d):
    return table(spark, d, "events").groupBy(F.date_format(F.window(F.col("ts").cast("timestamp"), "6 hours")["start"], "yyyy-MM-dd HH:mm").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def x_interval_join(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.floor("p_retailprice").cast("long").alias("price"))
    bands = spark.range(0, 40).select((F.col("id") * 55).alias("low"), (F.col("id") * 55 + 80).alias("high"), F.col("id").alias("band"))
    return relational.interval_join(parts, bands, "price", "low", "high", 100).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def x_salted_join(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    names = events.groupBy("event_type").agg(F.min("event_id").alias("first_id"))
    return relational.salted_join(events, names, "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("first_id").alias("first_id"))


def x_json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def x_nearest_vectors(spark, d):
    """For every vector whose id is divisible by 100, its five nearest by cosine among all vectors: a stated query set against all rows."""
    rows = table(spark, d, "embeddings")
    return relational.nearest_vectors(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 5).select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "n")


QUERIES = {f.__name__: f for f in (
    x_star_join, x_pricing_summary, x_rollup, x_cube, x_pivot, x_top_orders, x_ranks, x_percentiles, x_set_all, x_semi_anti, x_sessions, x_tumbling, x_interval_join, x_salted_join, x_json_props, x_nearest_vectors,
)}

SQL = {
    "x_star_join": """
        SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "x_pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL""",
    "x_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "x_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "x_pivot": """SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id""",
    "x_top_orders": "SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders QUALIFY n <= 5",
    "x_ranks": """
        WITH r AS (SELECT c_mktsegment, c_nationkey, count(*) AS orders FROM customer GROUP BY ALL)
        SELECT *, rank() OVER w AS rank, ntile(4) OVER w AS quarter, round(cume_dist() OVER w, 6) AS share FROM r WINDOW w AS (PARTITION BY c_mktsegment ORDER BY orders DESC, c_nationkey)""",
    "x_percentiles": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(stddev_samp(l_quantity), 6) AS deviation FROM lineitem GROUP BY 1",
    "x_set_all": """
        WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier)
        SELECT kind, k, count(*) AS n FROM (SELECT 'both' AS kind, k FROM (FROM a INTERSECT ALL FROM b) UNION ALL SELECT 'rest', k FROM (FROM a EXCEPT ALL FROM b)) GROUP BY ALL""",
    "x_semi_anti": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "x_sessions": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS events FROM s GROUP BY ALL""",
    "x_tumbling": """
        SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
    "x_interval_join": """
        WITH p AS (SELECT floor(p_retailprice)::BIGINT AS price FROM part), b AS (SELECT i AS band, i * 55 AS low, i * 55 + 80 AS high FROM range(40) t(i))
        SELECT band, count(*) AS n FROM p JOIN b ON price >= low AND price < high GROUP BY band""",
    "x_salted_join": "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type",
    "x_json_props": "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events",
    "x_nearest_vectors": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.v, v.v) AS similarity FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
        SELECT query_id, vec_id, round(similarity, 5) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS n FROM s QUALIFY n <= 5""",
}
