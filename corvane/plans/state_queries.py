"""Queries of streams with state, checkpointed runs, published versions, stored vectors, guards and JSON in one form."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions import text as T
from ..functions import vectors as V
from ..operators import checks, guards, observations
from ..sources import storage, vectors, versions
from ..streaming import events as stream
from ..streaming import runs, state
from .corpus_queries import REDACTED
from .registry import query, table


def _root(spark: SparkSession) -> str:
    return f"{storage.scratch_dir(spark)}/corvane/{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, sf_dir: str, keyed, made) -> DataFrame:
    """What a keyed stream over the events makes of them."""
    root = _root(spark)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, state.STORE)
    try:
        out = made(keyed(stream.read(spark, sf_dir, name="events.parquet")))
        stream.run_available(out, f"{root}/out", f"{root}/state")
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(out.schema).parquet(f"{root}/out")


_HALF_DAY, _TWO_DAYS = 12 * 3600 * 10**6, 48 * 3600 * 10**6
_FUNNEL = {"signup": 25, "view": 50, "click": 75, "purchase": 100}


def _fetches(events: DataFrame) -> DataFrame:
    """Users as keys; what they view, click or sign up for is stored by the number in its properties, other events look up."""
    number = (F.get_json_object("props", "$.k").cast("int") % 3).cast("string")
    document = F.when(~F.col("event_type").isin("purchase", "error"), F.concat(F.lit("page-"), number))
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), state.micros(F.col("ts")).alias("at"), document.alias("document"), F.col("ts").cast("timestamp").alias("ts"))


_CACHE = f"""WITH e AS (SELECT user_id AS key, event_id, epoch_us(ts) AS us, CASE WHEN event_type NOT IN ('purchase', 'error') THEN 'page-' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 3 AS VARCHAR) END AS document FROM events),
w AS (SELECT *, last_value(CASE WHEN document IS NOT NULL THEN {{'d': document, 't': us}} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
  lag(us) OVER (PARTITION BY key, document ORDER BY us, event_id) AS b FROM e)
SELECT event_id, CASE WHEN document IS NOT NULL THEN CASE WHEN b + {_HALF_DAY} > us THEN 'refreshed' ELSE 'created' END WHEN l.t + {_HALF_DAY} > us THEN 'hit' ELSE 'miss' END AS outcome,
  CASE WHEN document IS NOT NULL OR l.t + {_HALF_DAY} > us THEN l.d END AS document, CASE WHEN document IS NOT NULL OR l.t + {_HALF_DAY} > us THEN CAST(us - l.t AS BIGINT) END AS age FROM w"""


def _cache_columns(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("seq").alias("event_id"), "outcome", "document", (F.col("at") - F.col("fetched")).alias("age"))


@query(_CACHE)
def cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache_columns(_streamed(spark, sf_dir, _fetches, lambda s: state.cached(s, ttl=_HALF_DAY)))


@query(_CACHE)
def cache_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache_columns(state.cached_as_of(_fetches(table(spark, sf_dir, "events")), ttl=_HALF_DAY))


def _visits(events: DataFrame) -> DataFrame:
    """A user's days as keys: each event type is a stage, errors end a key."""
    key = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd"))
    error = F.when(F.col("event_type") == "error", "event_error")
    return events.select(key.alias("key"), F.col("event_id").alias("seq"), state.micros(F.col("ts")).alias("at"), F.col("event_type").alias("stage"), error.alias("error"), F.col("ts").cast("timestamp").alias("ts"))


_STAGES = f"""WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS key, event_id AS seq, epoch_us(ts) AS us, event_type AS stage, CASE event_type WHEN 'signup' THEN 25 WHEN 'view' THEN 50 WHEN 'click' THEN 75 ELSE 100 END AS step FROM events),
h AS (SELECT *, coalesce(max(step) OVER (PARTITION BY key ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS height FROM e),
t AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY key ORDER BY us, seq) > {_TWO_DAYS} / 8, FALSE) AS gap FROM h WHERE height < 100 AND (step > height OR stage = 'error')),
g AS (SELECT *, sum(CAST(gap AS INTEGER)) OVER (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS gaps FROM t),
l AS (SELECT key, max(us) FILTER (gaps = 0) AS us, arg_max(step, (us, seq)) FILTER (gaps = 0) AS step, max(gaps) AS gaps FROM g GROUP BY key),
n AS (SELECT max(epoch_ms(ts)) AS now FROM events)
SELECT key, CAST(seq AS BIGINT) AS seq, us AS "at", stage, CAST(step AS INTEGER) AS progress, CASE WHEN stage = 'error' THEN 'event_error' END AS error FROM g WHERE gaps = 0
UNION ALL SELECT key, -1, us + {_TWO_DAYS // 8}, 'error', 100, 'stage_timeout' FROM l, n WHERE gaps > 0 OR (step < 100 AND (us + {_TWO_DAYS // 8}) // 1000 + 1 <= now)"""


@query(_STAGES)
def stage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, _visits, lambda s: state.staged(s, progress=_FUNNEL, limit=_TWO_DAYS // 8, failed="error"))


@query(_STAGES)
def stage_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    now = rows.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]
    return state.staged_as_of(_visits(rows), progress=_FUNNEL, limit=_TWO_DAYS // 8, now=F.lit(now), failed="error")


@query("SELECT event_id, event_type, round(value, 4) AS value, epoch_us(ts) // 1000000 AS second FROM events")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in weekly files; a run over them is cancelled after its second batch, goes on, and has each event once."""
    root, rows = _root(spark), table(spark, sf_dir, "events")
    week = F.floor(state.micros(F.col("ts")) / (7 * 24 * 3600 * 10**6))
    rows.select(*stream.COLUMNS, week.alias("week")).repartition("week").write.partitionBy("week").parquet(f"{root}/log")
    source = stream.read(spark, f"{root}/log", files_per_trigger=2)
    done = []

    def work(batch: DataFrame) -> DataFrame:
        done.append(1)
        if len(done) == 2:
            runs.request_cancel(batch.sparkSession, f"{root}/control", "events")
        return batch.select("event_id", "event_type", F.round("value", 4).alias("value"), F.floor(state.micros(F.col("ts")) / 1_000_000).alias("second"))

    go = lambda: runs.run_batches(source, work, run="events", stage="reading", sink=f"{root}/sink", control=f"{root}/control")
    if go() == "cancelled":
        runs.withdraw_cancel(spark, f"{root}/control", "events")
        go()
    return runs.results(spark, f"{root}/sink", "events", "event_id bigint, event_type string, value double, second bigint")


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O')")
def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders published, open ones added; a publisher that still saw the first version is refused and changes nothing."""
    root, orders = _root(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("total"))
    first = versions.publish(orders.where("o_orderstatus = 'F'"), root)
    versions.publish(orders.where("o_orderstatus = 'O'"), root, after=first, add=True)
    try:
        versions.publish(orders, root, after=first)
    except versions.ConcurrentPublish:
        pass
    return versions.snapshot(spark, root)


@query(f"""WITH c AS (SELECT doc_id, chr(10) || coalesce(text, '') AS a, chr(10) || coalesce({REDACTED.format("text")}, '') AS b FROM documents)
SELECT doc_id, sha256(b) AS content_hash, CAST(CASE WHEN a = b THEN 1 ELSE 2 END AS BIGINT) AS built FROM c""")
def vector_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents embedded, then again after redaction: only those that redaction changed are built anew."""
    root, docs = _root(spark), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), "text")
    made = lambda d: vectors.refresh(d, root, model="hashing-64", embed=V.hashing_embedder(64), dimension=64)
    made(docs)
    out = made(docs.withColumn("text", T.redact(F.col("text"))))
    return out.select(F.col("id").cast("bigint").alias("doc_id"), "content_hash", "built")


@query("""SELECT l_orderkey, l_linenumber, o_orderstatus, n_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def strict_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line finds its order, customer and nation, or the job fails with the key."""
    named = guards.strict_lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), key="c_nationkey", value="n_name", name="n_name", what="nation")
    orders = guards.strict_join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderstatus"), named, ["c_custkey"], what="customer")
    lines = guards.strict_join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), orders, ["l_orderkey"], what="order")
    return lines.select("l_orderkey", "l_linenumber", "o_orderstatus", "n_name")


_TURN = "'\"conv_id\"{1}' || conv_id || '{0}\"message\"{1}{{\"content\"{1}' || to_json(coalesce(text, '')) || '{0}\"role\"{1}' || to_json(role) || '}}{0}\"turn\"{1}' || turn || '}}'"


@query(f"SELECT conv_id, turn, '{{' || {_TURN.format(', ', ': ')} AS body, sha256('{{' || {_TURN.format(',', ':')}) AS fingerprint FROM conversations")
def canonical_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as nested JSON with the keys in another order, brought to one form."""
    message = F.struct("role", F.coalesce("text", F.lit("")).alias("content"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("turn", message.alias("message"), "conv_id")).alias("j"))
    return rows.select("conv_id", "turn", canonical.canonical(F.col("j")).alias("body"), F.sha2(canonical.canonical(F.col("j"), item=",", key=":"), 256).alias("fingerprint"))


_ENTRY = "'{{\"evidence_id\": ' || to_json(conv_id || '-' || turn) || ', \"title\": ' || to_json(role) || ', \"rank\": ' || turn || ', \"content\": ' || to_json({0}) || '}}'"


@query(f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
w AS (SELECT conv_id, any_value(text) FILTER (turn = 0) AS query, count(*) AS n, string_agg({_ENTRY.format('text')}, ', ' ORDER BY turn) AS items FROM t GROUP BY conv_id),
o AS (SELECT conv_id, n, coalesce(query, '') AS query, '{{"query": ' || to_json(coalesce(query, '')) || ', "evidence": [' || items || ']}}' AS whole FROM w),
s AS (SELECT conv_id, string_agg({_ENTRY.format('left(text, CAST(greatest(least(3000 // n // 2, 2000), 128) AS BIGINT))')}, ', ' ORDER BY turn) AS items,
  string_agg('{{"evidence_id": ' || to_json(conv_id || '-' || turn) || '}}', ', ' ORDER BY turn) AS ids FROM t JOIN o USING (conv_id) GROUP BY conv_id),
h AS (SELECT o.conv_id, whole, '{{"query": ' || to_json(left(query, 500)) || ', "_context_truncated": true, "_original_character_count": ' || length(whole) || ', "_content_sha256": "' || sha256(whole) || '"' AS head, items, ids FROM o JOIN s USING (conv_id)),
v AS (SELECT conv_id, whole, head || ', "evidence": [' || items || '], "hits": []}}' AS a, head || ', "evidence": [' || ids || ']}}' AS b, head || '}}' AS c FROM h)
SELECT conv_id, CASE WHEN length(whole) <= 3000 THEN whole WHEN length(a) <= 3000 THEN a WHEN length(b) <= 3000 THEN b ELSE c END AS observation FROM v""")
def bounded_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as observations with their turns as evidence, none longer than 3,000 characters."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    entry = F.struct("turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("evidence_id"), "role", "text")
    rows = turns.groupBy("conv_id").agg(F.coalesce(F.max(F.when(F.col("turn") == 0, F.col("text"))), F.lit("")).alias("query"), F.array_sort(F.collect_list(entry)).alias("e"))
    evidence = F.transform("e", lambda x: F.struct(x["evidence_id"].alias("evidence_id"), x["role"].alias("title"), x["turn"].alias("rank"), x["text"].alias("content")))
    return rows.select("conv_id", observations.bounded(F.to_json(F.struct("query", evidence.alias("evidence"))), 3000).alias("observation"))


_RUNS = """t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
g AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS told, arg_max(role, turn) AS last_role, max(turn) AS last_turn, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS report,
  count(*) FILTER (role = 'user' AND n < 60) AS short_asked, count(*) FILTER (role = 'assistant' AND n < 100) AS short_told, count(*) FILTER (n = 0) AS silent, sum(n) AS chars FROM t GROUP BY conv_id),
l AS (SELECT conv_id, turn // 4 AS part, arg_max(n >= 90, turn) AS enough, max(turn) AS turn FROM t GROUP BY conv_id, turn // 4),
p AS (SELECT conv_id, count(*) AS parts, bool_and(enough) AS enough, list_contains(list(turn), max(turn)) AS allowed FROM l GROUP BY conv_id),
c AS (SELECT g.conv_id, [
  {'name': 'api_ready', 'held': TRUE}, {'name': 'supervisor_workflow', 'held': g.conv_id % 2 = 0}, {'name': 'run_completed', 'held': last_role = 'assistant'}, {'name': 'plan_created', 'held': asked >= 2},
  {'name': 'subtasks_completed', 'held': asked > 0 AND short_asked = 0}, {'name': 'tools_succeeded', 'held': told > 0 AND short_told = 0}, {'name': 'evidence_sufficient', 'held': parts = asked AND enough},
  {'name': 'evidence_allowlist', 'held': allowed}, {'name': 'final_report_present', 'held': length(trim(report, ' ')) >= 80}, {'name': 'checkpoint_completed', 'held': last_role = 'assistant'},
  {'name': 'usage_recorded', 'held': chars > 0}, {'name': 'no_runtime_errors', 'held': silent = 0}, {'name': 'persistence_round_trip', 'held': turns < 8}, {'name': 'web_control_surface', 'held': TRUE}] AS c FROM g JOIN p USING (conv_id))"""


@query(f"WITH {_RUNS} SELECT conv_id, array_to_string([x.name FOR x IN c IF NOT x.held], ',') AS gaps, CASE WHEN len([x FOR x IN c IF NOT x.held]) = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM c")
def acceptance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations told as runs (JSON) and checked by path; the SQL asks the turns themselves."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    n, mine = F.length("text"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    part = F.floor(F.col("turn") / 4).cast("string")
    of = lambda role, x: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", x.alias("x"))))), lambda s: s["x"])
    every = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("turn", x.alias("x")))), lambda s: s["x"])
    told = F.max_by(F.struct("text"), F.when(F.col("role") == "assistant", F.col("turn")))["text"]
    runs_ = turns.groupBy("conv_id").agg(
        of("user", F.col("text")).alias("plan"), of("user", F.struct(F.col("turn").cast("string").alias("subtask_id"), F.when(n >= 60, "completed").otherwise("failed").alias("status"))).alias("subtasks"),
        of("assistant", F.struct(F.when(n >= 100, "succeeded").otherwise("failed").alias("status"))).alias("tool_calls"),
        every(F.struct(part.alias("subtask_id"), F.col("turn").cast("int").alias("attempt"), (n >= 90).alias("sufficient"), F.array(mine).alias("evidence_ids"))).alias("evidence_assessments"),
        F.array(F.max_by(mine, "turn")).alias("final_evidence_ids"), F.coalesce(told, F.lit("")).alias("final_report"), F.max_by("role", "turn").alias("last_role"),
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "assistant").alias("told"), F.sum(n).alias("chars"), F.collect_list(F.when(n == 0, mine)).alias("errors"),
    )
    ended = F.when(F.col("last_role") == "assistant", "completed").otherwise("running")
    checkpoint = F.struct(F.when(F.col("last_role") == "assistant", "report").otherwise("plan").alias("stage"), F.array(F.lit("plan"), F.lit("report")).alias("completed_stages"))
    usage = F.struct(F.col("turns").alias("agent_steps"), F.col("told").alias("search_calls"), F.col("chars").alias("total_tokens"))
    fields = [F.col("conv_id").cast("string").alias("run_id"), ended.alias("status"), ended.alias("stop_reason"), "plan", "subtasks", "tool_calls", "evidence_assessments", "final_evidence_ids", "final_report", checkpoint.alias("checkpoint"), usage.alias("usage"), "errors"]
    held = F.struct(F.when(F.col("turns") < 8, F.col("conv_id").cast("string")).alias("run_id"), "final_report", checkpoint.alias("checkpoint"))
    status = F.struct(F.lit(True).alias("ready"), F.when(F.col("conv_id") % 2 == 0, "supervisor").otherwise("baseline").alias("workflow"))
    stored = storage.materialize(runs_.select("conv_id", F.to_json(F.struct(*fields)).alias("created"), F.to_json(held).alias("persisted"), F.to_json(status).alias("service")), "runs")
    records: dict[str, Column] = {"status": F.parse_json("service"), "created": F.parse_json("created"), "persisted": F.parse_json("persisted"), "page": F.lit(None).cast("string")}
    return checks.report(stored, checks.acceptance(), keys=["conv_id"], records=records).select("conv_id", F.array_join("gaps", ",").alias("gaps"), "status")
