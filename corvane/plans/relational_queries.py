"""Queries of order-dependent operators, joins, sets, aggregates and streams on the order tables and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import sequence as S
from ..sources import storage
from ..sources.readers import pages_in_order
from ..streaming import events as stream
from .registry import query, table


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY event_type""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.latency(table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "min", "max")])


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(spent AS BIGINT) AS spent, CASE WHEN q = 0 THEN 'free' WHEN spent + q <= 60 THEN 'taken' ELSE 'skipped' END AS status FROM c""")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.running_budget(table(spark, sf_dir, "lineitem"), by=["l_orderkey"], order=[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")], cost=F.col("l_quantity").cast("long"), budget=60)
    return out.select("l_orderkey", "l_linenumber", "spent", "status")


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS tasks FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(100 // tasks + CASE WHEN pos > tasks - 100 % tasks THEN 1 ELSE 0 END AS BIGINT) AS quota FROM n""")
def quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.attempts(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), by=["l_orderkey"], order="l_linenumber")
    counts = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("tasks"))
    return lines.join(counts, "l_orderkey").select("l_orderkey", "l_linenumber", S.quotas(F.lit(100), F.col("tasks"), F.col("attempt")).cast("long").alias("quota"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_attempt(table(spark, sf_dir, "events"), by=["user_id", "event_type"], attempt="ts", position="event_id").select("user_id", "event_type", "event_id")


@query("""SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS seq, round(epoch(ts) - first_value(epoch(ts)) OVER w, 3) AS elapsed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_sequence(table(spark, sf_dir, "events"), by="user_id", ts="ts", tie="event_id").select("event_id", "seq", F.round("elapsed", 3).alias("elapsed"))


@query("""SELECT user_id, arg_max(event_type, ts) AS status, epoch(min(ts) FILTER (event_type <> 'view')) AS started, epoch(max(ts) FILTER (event_type = 'purchase')) AS completed FROM events GROUP BY user_id""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type")))
    out = S.job_status(log, key="user_id", terminal=("purchase",))
    last = F.when(F.col("status") == "pending", "view").otherwise(F.col("status"))
    return out.select("user_id", last.alias("status"), S.seconds(F.col("started_at")).alias("started"), S.seconds(F.col("completed_at")).alias("completed"))


@query("""WITH u AS (SELECT user_id AS k, ts, event_id, CASE WHEN event_type = 'purchase' THEN value END AS paid, CASE WHEN event_type <> 'view' THEN event_type END AS did FROM events),
l AS (SELECT k, arg_max(paid, (ts, event_id)) FILTER (paid IS NOT NULL) AS paid, arg_max(did, (ts, event_id)) FILTER (did IS NOT NULL) AS did FROM u GROUP BY k)
SELECT c_custkey AS k, round(coalesce(paid, c_acctbal), 2) AS paid, coalesce(did, 'none') AS did FROM customer LEFT JOIN l ON k = c_custkey""")
def partial_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.struct("ts", "event_id").alias("o"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("did"))
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("double").alias("paid"), F.lit("none").alias("did"))
    return S.partial_updates(current, log, key="k", order="o", columns=["paid", "did"]).withColumn("paid", F.round("paid", 2))


@query("""WITH l AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o FROM orders GROUP BY o_custkey) SELECT c_custkey, o AS last_order FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def latest_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    out = S.with_latest(table(spark, sf_dir, "customer").select("c_custkey"), orders, key="c_custkey", attempt="o_orderdate", position="o_orderkey")
    return out.select("c_custkey", F.col("latest.o_orderkey").alias("last_order"))


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_click FROM events""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return S.carry_forward(rows, by=["user_id"], order="o", value=F.when(F.col("event_type") == "click", F.col("event_id")), name="last_click").select("event_id", F.coalesce("last_click", F.lit(-1).cast("long")).alias("last_click"))


@query("""WITH cur AS (SELECT o_custkey AS k, o_orderkey AS v, o_orderdate AS ts, 0 AS n FROM orders WHERE o_orderstatus = 'F'), ch AS (SELECT o_custkey, o_orderkey, o_orderdate, 1 FROM orders WHERE o_orderstatus <> 'F')
SELECT k, max(epoch(ts)) AS ts FROM (SELECT * FROM cur UNION ALL SELECT * FROM ch) GROUP BY k""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), "o_orderstatus")
    out = storage.upsert(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), ["k"], "ts")
    return out.select("k", S.seconds(F.col("ts")).alias("ts"))


@query("""WITH d AS (SELECT o_custkey, o_orderkey, o_orderdate AS fetched, o_orderdate + INTERVAL 90 DAY AS expires FROM orders), n AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY fetched DESC, o_orderkey) AS r FROM d, n WHERE expires > now AND fetched <= now) WHERE r = 1""")
def fresh_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    now = orders.agg(F.max("o_orderdate")).first()[0]
    docs = orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("fetched"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("expires_at"))
    alive = docs.where((F.col("expires_at") > F.lit(now)) & (F.col("fetched") <= F.lit(now)))
    return storage.latest(alive, ["o_custkey"], [F.desc("fetched"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS INTEGER) AS shard FROM orders")
def round_robin_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shards(table(spark, sf_dir, "orders").select("o_orderkey"), order=["o_orderkey"], n=7)


@query("""WITH found AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'), want AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT k, count(*) AS n FROM found GROUP BY k)
SELECT coalesce(f.k, want.k) AS k, CASE WHEN n IS NULL THEN 'missing' WHEN want.k IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM f FULL JOIN want ON f.k = want.k WHERE n IS NULL OR want.k IS NULL OR n > 1""")
def shard_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    found = orders.where("o_orderstatus <> 'P'").select("k").union(orders.where("o_orderpriority LIKE '1%'").select("k"))
    return S.coverage(found, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), ["k"])


@query("""WITH s AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'read' ELSE 'evaluate' END AS action, CAST(event_id % 5 AS VARCHAR) AS id FROM events)
SELECT case_id, step, CAST(count(DISTINCT id) FILTER (action = 'search') OVER w AS INTEGER) AS discovered, CAST(count(DISTINCT id) FILTER (action = 'read') OVER w AS INTEGER) AS read, CAST(count(DISTINCT id) FILTER (action = 'evaluate') OVER w AS INTEGER) AS evaluated
FROM s WINDOW w AS (PARTITION BY case_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def protocol_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "read").otherwise("evaluate")
    steps = S.event_sequence(table(spark, sf_dir, "events"), by="user_id", ts="ts", tie="event_id").select(F.col("user_id").alias("case_id"), F.col("seq").alias("step"), action.alias("action"), F.array((F.col("event_id") % 5).cast("string")).alias("ids"), F.lit(True).alias("ok"))
    return S.protocol_state(steps).select("case_id", F.col("step").cast("long").alias("step"), *[F.col(c).cast("int").alias(c) for c in ("discovered", "read", "evaluated")])


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    joined = per_customer.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(storage.broadcast_if_small(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unprocessed(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH a AS (SELECT l_suppkey AS k, count(*) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT s_suppkey AS k, s_nationkey AS b FROM supplier WHERE s_acctbal > 0)
SELECT coalesce(a.k, b.k) AS k, a, b FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("b"))
    return a.join(b, "k", "full_outer").where("a IS NULL OR b IS NULL")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_discount), 2) AS discount FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_discount"), 2).alias("discount"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_in_order(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], limit=20, offset=40).select("o_orderkey")


@query("""SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS "F", sum(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS "O", sum(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS "P" FROM orders GROUP BY o_custkey""")
def pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


@query("""SELECT * FROM (SELECT DISTINCT p_brand AS b FROM part WHERE p_size < 10 INTERSECT SELECT DISTINCT p_brand FROM part WHERE p_size > 40) EXCEPT SELECT p_brand FROM part WHERE p_size = 25""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("b"), "p_size")
    return part.where("p_size < 10").select("b").intersect(part.where("p_size > 40").select("b")).subtract(part.where("p_size = 25").select("b"))


def _streamed(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    root = f"{storage.scratch_dir(spark)}/corvane/{uuid.uuid4().hex}"
    stream.run_available(df, f"{root}/out", f"{root}/state", mode=mode)
    return spark.read.schema(df.schema).parquet(f"{root}/out")


@query("SELECT event_id, event_type, value FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = stream.read(spark, sf_dir, name="events.parquet")
    return _streamed(spark, stream.once(source), "append").select("event_id", "event_type", "value")


_HOURS = "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2"


@query(_HOURS)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream.windowed(table(spark, sf_dir, "events"))
    return out.select(S.seconds(F.col("window_start")).alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query(f"SELECT * FROM ({_HOURS}) WHERE window_start + 3600 <= (SELECT max(epoch_us(ts)) / 1e6 - 3600 FROM events)")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = stream.read(spark, sf_dir, name="events.parquet")
    out = _streamed(spark, stream.windowed(source), "append")
    return out.select(S.seconds(F.col("window_start")).alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) / 1e6 AS session_start, epoch_us(max(ts)) / 1e6 + 1800 AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream.sessions(table(spark, sf_dir, "events"))
    return out.select("user_id", S.seconds(F.col("session_start")).alias("session_start"), S.seconds(F.col("session_end")).alias("session_end"), "n", F.round("total", 4).alias("total"))
