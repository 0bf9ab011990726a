"""Queries of rule sets, comparisons, gates, trajectories and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import replay, rules, trajectories
from ..operators import sequence as S
from ..sources.storage import materialize
from .registry import query, table
from .retrieval_queries import _TOKENS


_SIGNALS = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{pattern}') THEN '{name}' END" for name, pattern in rules.SIGNALS)


@query(f"SELECT conv_id, turn, array_to_string([x FOR x IN [{_SIGNALS}] IF x IS NOT NULL], ',') AS signals FROM conversations WHERE role = 'user'")
def research_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", F.array_join(rules.research_signals(F.col("text")), ",").alias("signals"))


@query(f"""WITH q AS (SELECT conv_id, turn, conv_id % 3 AS k, [x FOR x IN [{_SIGNALS}] IF x IS NOT NULL] AS signals FROM conversations WHERE role = 'user'),
r AS (SELECT *, CASE k WHEN 0 THEN 'casual' WHEN 1 THEN 'science' ELSE '' END AS category, CASE WHEN turn % 2 = 0 THEN 0.95e0 ELSE 0.5e0 END AS confidence, conv_id % 5 = 0 AS asked FROM q),
d AS (SELECT *, NOT asked AND k = 0 AND turn % 2 = 0 AND len(signals) = 0 AS direct FROM r)
SELECT conv_id, turn, CASE WHEN direct THEN 'direct_answer' ELSE 'evidence_research' END AS route, NOT direct AND NOT asked AS overridden, CASE WHEN direct OR asked THEN '' ELSE
  array_to_string(signals || [x FOR x IN [CASE WHEN k <> 0 THEN 'category:' || CASE WHEN category = '' THEN 'unknown' ELSE category END END, CASE WHEN turn % 2 <> 0 THEN 'confidence:0.50' END] IF x IS NOT NULL], ',') END AS blockers FROM d""")
def route_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, even = F.col("conv_id") % 3, F.col("turn") % 2 == 0
    category = F.when(k == 0, "casual").when(k == 1, "science").otherwise("")
    proposed = F.when(F.col("conv_id") % 5 == 0, "evidence_research").otherwise("direct_answer")
    users = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("signals", rules.research_signals(F.col("text")))
    out = users.select("conv_id", "turn", rules.route(proposed, category, F.when(even, 0.95).otherwise(0.5), F.col("signals"), F.lit("a")).alias("r"))
    return out.select("conv_id", "turn", "r.route", "r.overridden", F.array_join("r.blockers", ",").alias("blockers"))


@query(r"""SELECT item_id, CASE WHEN regexp_matches(text, '(^|[^\pL\pM\p{Nd}\p{Pc}])[A-Z]{2,}([^\pL\pM\p{Nd}\p{Pc}]|$)') THEN 'acronym' WHEN contains(lower(text), ' and ') OR contains(lower(text), ' or ') OR contains(lower(text), 'associated with') THEN 'multi-concept'
  WHEN regexp_matches(text, '\d|[-/]') THEN 'exact-term' ELSE 'semantic-paraphrase' END AS category FROM benchmark""")
def query_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", rules.query_category(F.col("text")).alias("category"))


@query(r"""WITH n AS (SELECT p_partkey AS k, p_size, CASE p_partkey % 8 WHEN 0 THEN p_name || '.txt' WHEN 1 THEN 'a\b\' || p_name || '.MD' WHEN 2 THEN '/x/' || p_name || '.pdf' WHEN 3 THEN p_name || '.exe' WHEN 4 THEN '' WHEN 5 THEN 'x/..' WHEN 6 THEN '.txt' END AS name,
  CASE p_partkey % 5 WHEN 0 THEN 'text/plain; charset=utf-8' WHEN 1 THEN 'TEXT/MARKDOWN' WHEN 2 THEN 'application/pdf' WHEN 3 THEN '' END AS kind FROM part),
f AS (SELECT *, CASE k % 8 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' WHEN 3 THEN '.exe' ELSE '' END AS suffix, coalesce(nullif(trim(split_part(lower(kind), ';', 1)), ''), 'application/octet-stream') AS mime FROM n)
SELECT k AS p_partkey, CASE WHEN k % 8 IN (4, 7) THEN 'missing_filename' WHEN k % 8 = 5 THEN 'invalid_filename' WHEN suffix NOT IN ('.txt', '.md', '.pdf') THEN 'unsupported_file_type'
  WHEN NOT (mime = 'application/octet-stream' OR (suffix IN ('.txt', '.md') AND mime = 'text/plain') OR (suffix = '.md' AND mime = 'text/markdown') OR (suffix = '.pdf' AND mime = 'application/pdf')) THEN 'mime_type_mismatch'
  WHEN p_size <= 3 THEN 'empty_file' WHEN p_size > 45 THEN 'file_too_large' ELSE '' END AS error,
  CASE WHEN p_size * 100 NOT BETWEEN 200 AND 4000 THEN 'invalid_chunk_size' WHEN k % 1500 > 1000 OR k % 1500 >= p_size * 100 THEN 'invalid_chunk_overlap' ELSE '' END AS chunk_error FROM f""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda n, *values: F.element_at(F.array(*values), (k % n + 1).cast("int"))
    name = pick(8, F.concat("p_name", F.lit(".txt")), F.concat(F.lit("a\\b\\"), "p_name", F.lit(".MD")), F.concat(F.lit("/x/"), "p_name", F.lit(".pdf")), F.concat("p_name", F.lit(".exe")), F.lit(""), F.lit("x/.."), F.lit(".txt"), F.lit(None).cast("string"))
    kind = pick(5, F.lit("text/plain; charset=utf-8"), F.lit("TEXT/MARKDOWN"), F.lit("application/pdf"), F.lit(""), F.lit(None).cast("string"))
    error = rules.upload_error(name, kind, F.when(F.col("p_size") <= 3, 0).otherwise(F.col("p_size")), most=45)
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(error, F.lit("")).alias("error"), F.coalesce(rules.chunk_error(F.col("p_size") * 100, k % 1500), F.lit("")).alias("chunk_error"))


@query(f"""WITH t AS (SELECT CASE WHEN CAST(CAST('0x' || substr(sha256('split-1:' || conv_id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0 < 0.1e0 THEN 'validation' ELSE 'train' END AS split, len({_TOKENS}) AS n FROM conversations),
r AS (SELECT split, n, row_number() OVER (PARTITION BY split ORDER BY n) AS r, count(*) OVER (PARTITION BY split) AS c FROM t)
SELECT split, CAST(min(n) AS INTEGER) AS least, median(n) AS median, CAST(max(n) AS INTEGER) AS most, CAST(min(n) FILTER (r = CAST(round_even((c - 1) * 0.95, 0) AS BIGINT) + 1) AS INTEGER) AS p95 FROM r GROUP BY split""")
def token_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trajectories.split(table(spark, sf_dir, "conversations"), id_col="conv_id", seed="split-1").select("split", F.size(T.tokens(F.col("text"))).alias("n"))
    # nearest rank from counts of distinct lengths: no list of rows is gathered
    counts = turns.groupBy("split", "n").agg(F.count(F.lit(1)).alias("c"))
    from pyspark.sql import Window

    run = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("split").orderBy("n"))).withColumn("all", F.sum("c").over(Window.partitionBy("split")))
    p95 = run.where(F.col("upto") >= F.bround((F.col("all") - 1) * F.lit(0.95)) + 1).groupBy("split").agg(F.min("n").alias("p95"))
    return turns.groupBy("split").agg(F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most")).join(p95, "split")


@query("""WITH m AS (SELECT avg(length(text)) AS mean_chars, count(*) FILTER (length(text) < 200) / CAST(count(*) AS DOUBLE) AS short_share, count(DISTINCT lang) AS languages FROM documents),
g AS (SELECT 'mean_chars' AS gate, mean_chars AS value, mean_chars >= 500 AS passed FROM m UNION ALL SELECT 'short_share', short_share, short_share <= 0.05 FROM m UNION ALL SELECT 'languages', CAST(languages AS DOUBLE), languages >= 4 FROM m)
SELECT gate, round(value, 6) AS value, passed, CASE WHEN bool_and(passed) OVER () THEN 'accept' ELSE 'reject' END AS decision FROM g""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    metrics = table(spark, sf_dir, "documents").agg(F.avg(n).alias("mean_chars"), E.ratio(F.count_if(n < 200), F.count(F.lit(1))).alias("short_share"), F.count_distinct("lang").alias("languages"))
    return E.gate(metrics, {"mean_chars": (">=", 500), "short_share": ("<=", 0.05), "languages": (">=", 4)}).select("gate", F.round("value", 6).alias("value"), "passed", "decision")


def _recorded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Trajectories made from conversations: each turn a step, the last one an answer; some are broken on purpose, some fenced."""
    turns, c = table(spark, sf_dir, "conversations"), F.col("conv_id")
    action = F.when(F.col("role") == "user", "search").when(F.col("role") == "assistant", "read_page").otherwise("plan")
    make = lambda act, ids: F.struct(F.lit("because").alias("rationale_summary"), act.alias("action"), F.create_map().cast("map<string,string>").alias("arguments"), F.lit("o").alias("observation"), ids.alias("evidence_ids"))
    step = make(action, F.array(F.concat(F.lit("e"), (F.col("turn") % 3).cast("string"))))
    log = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role")))).alias("order"), F.array_sort(F.collect_list(F.struct("turn", F.to_json(step).alias("s")))).alias("l"))
    final = F.to_json(make(F.lit("answer"), F.array().cast("array<string>")))
    parts = F.transform("l", lambda x: x["s"])
    steps = F.array_join(F.when(c % 5 == 0, parts).otherwise(F.concat(parts, F.array(final))), ",")
    seed = F.concat(F.lit("s"), (c % 4).cast("string"), F.lit("-train-"), c.cast("string"))
    text = F.concat(F.lit('{"seed_id":"'), seed, F.lit('","query":" q ","variant":"'), F.when(c % 7 == 0, "verification").otherwise("research"), F.lit('","steps":['), steps, F.lit('],"final_answer":"the answer"}'))
    text = F.when(c % 17 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text)
    usage = F.struct(c.alias("prompt_tokens"), F.lit(2).cast("bigint").alias("completion_tokens"), (c + 2).alias("total_tokens"))
    raw = log.select(seed.alias("seed_id"), F.when(c % 11 == 0, F.left(text, F.lit(20))).otherwise(text).alias("text"), F.when(c % 3 != 0, usage).alias("usage"))
    item = lambda i: F.struct(F.lit(i).alias("evidence_id"), F.lit("T").alias("title"), F.lit("here the answer stands").alias("text"))
    seeds = log.where(c % 13 != 0).select(seed.alias("seed_id"), F.lit("q").alias("query"), F.lit("research").alias("variant"), F.when(c % 3 == 0, "other").otherwise("An Answer!").alias("expected_answer"), F.array(item("e0"), item("e1")).alias("evidence"))
    return raw, seeds


_TRAJ = """
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, turn FROM conversations),
c AS (SELECT conv_id, list('invalid_schema:steps.' || i || '.action:literal_error' ORDER BY CAST(i AS VARCHAR)) FILTER (role NOT IN ('user', 'assistant')) AS odd, bool_or(turn % 3 = 2) AS invented, count(*) AS n, count(*) FILTER (role = 'user') AS s, count(*) FILTER (role = 'assistant') AS r FROM o GROUP BY conv_id),
t AS (SELECT conv_id, n + CASE WHEN conv_id % 5 = 0 THEN 0 ELSE 1 END AS steps, s, r, 's' || conv_id % 4 AS source, CASE WHEN conv_id % 13 = 0 THEN ['unknown_seed'] WHEN conv_id % 11 = 0 THEN ['invalid_json'] WHEN n + CASE WHEN conv_id % 5 = 0 THEN 0 ELSE 1 END > 8 THEN ['invalid_schema:steps:too_long'] WHEN len(odd) > 0 THEN odd ELSE
  [x FOR x IN [CASE WHEN conv_id % 7 = 0 THEN 'variant_mismatch' END, CASE WHEN conv_id % 5 = 0 THEN 'missing_answer_action' END, CASE WHEN conv_id % 5 = 0 THEN 'answer_action_not_final' END, CASE WHEN invented THEN 'invented_evidence_id' END] IF x IS NOT NULL] END AS reasons FROM c)"""


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(trajectories.reasons(*_recorded(spark, sf_dir)), "filtered")


@query(f"WITH {_TRAJ} SELECT source || '-train-' || conv_id AS seed_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted FROM t")
def traj_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.reasons(*_recorded(spark, sf_dir)).select("seed_id", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query(f"WITH {_TRAJ} SELECT label, count(*) AS n FROM (SELECT unnest(reasons) AS label FROM t) GROUP BY label")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.histogram(trajectories.reasons(*_recorded(spark, sf_dir)), F.col("reasons"))


@query(f"""WITH {_TRAJ}, a AS (SELECT *, conv_id % 3 <> 0 AS exact FROM t WHERE len(reasons) = 0)
SELECT source, count(*) AS records, avg(CAST(exact AS INTEGER)) AS normalized_exact_rate, avg(CAST(exact AS INTEGER)) AS expected_supported_by_seed_evidence_rate, 1e0 AS final_supported_by_seed_evidence_rate, 1e0 AS last_action_is_answer_rate, avg(CAST(s > 0 AS INTEGER)) AS has_search_rate,
  0e0 AS has_evaluate_evidence_rate, 1e0 AS known_evidence_only_rate, avg(CAST(exact AS INTEGER)) AS mean_token_f1, CAST(min(steps) AS INTEGER) AS steps_min, CAST(max(steps) AS INTEGER) AS steps_max, avg(steps) AS steps_mean, median(steps) AS steps_median, CAST(sum(r) AS BIGINT) AS reads, count(*) AS answers FROM a GROUP BY ROLLUP (source)""")
def traj_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trajectories.audit(_filtered(spark, sf_dir))
    rates = [f"{n}_rate" for n in ("normalized_exact", "expected_supported_by_seed_evidence", "final_supported_by_seed_evidence", "last_action_is_answer", "has_search", "has_evaluate_evidence", "known_evidence_only")]
    return out.select("source", "records", *rates, "mean_token_f1", "steps_min", "steps_max", "steps_mean", "steps_median", F.coalesce(F.col("actions")["read_page"], F.lit(0)).alias("reads"), F.col("actions")["answer"].alias("answers"))


@query(f"""WITH {_TRAJ}, a AS (SELECT *, conv_id % 3 <> 0 AS exact FROM t WHERE len(reasons) = 0), m AS (SELECT count(*) AS n, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM t) AS rate, avg(CAST(exact AS INTEGER)) AS exact FROM a),
g AS (SELECT 'accepted_records' AS gate, CAST(n AS DOUBLE) AS value, n >= 400 AS passed FROM m UNION ALL SELECT 'acceptance_rate', rate, rate >= 0.9 FROM m UNION ALL SELECT 'normalized_exact_rate', exact, exact >= 0.99 FROM m
  UNION ALL SELECT 'last_action_is_answer_rate', 1, TRUE UNION ALL SELECT 'exactly_one_answer_rate', 1, TRUE UNION ALL SELECT 'known_evidence_only_rate', 1, TRUE)
SELECT gate, round(value, 6) AS value, passed, CASE WHEN (SELECT bool_and(passed) FROM g) THEN 'accept' ELSE 'reject' END AS decision FROM g""")
def traj_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.quality_gate(_filtered(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"""WITH {_TRAJ} SELECT count(*) AS input_records, count(*) FILTER (len(reasons) = 0) AS accepted_records, count(*) FILTER (len(reasons) > 0) AS rejected_records, count(*) FILTER (list_contains(reasons, 'unknown_seed')) AS unknown_seed_records,
  count(*) FILTER (len(reasons) = 0) / CAST(count(*) AS DOUBLE) AS acceptance_rate, count(*) FILTER (len(reasons) = 0) AS unique_ids, count(*) FILTER (len(reasons) = 0) AS unique_hashes FROM t""")
def traj_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.acceptance(_filtered(spark, sf_dir))


@query("SELECT CAST(sum(conv_id) AS BIGINT) AS prompt_tokens, CAST(2 * count(*) AS BIGINT) AS completion_tokens, CAST(sum(conv_id + 2) AS BIGINT) AS total_tokens FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 <> 0")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.token_usage(_recorded(spark, sf_dir)[0])


@query(f"""WITH {_TRAJ}, k AS (SELECT source || '-train-' || conv_id AS seed_id, source, len(reasons) = 0 AS accepted FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY accepted, CASE WHEN accepted THEN source END ORDER BY sha256('review:' || seed_id), seed_id) AS place FROM k)
SELECT seed_id, accepted, CAST(place AS INTEGER) AS place FROM p WHERE place <= CASE WHEN accepted THEN 5 ELSE 10 END""")
def review_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.review_packet(trajectories.reasons(*_recorded(spark, sf_dir)), seed="review").select("seed_id", "accepted", "place")


@query(f"WITH {_TRAJ} SELECT source || '-train-' || conv_id AS id, CAST(2 + 2 * steps - 1 AS INTEGER) AS turns FROM t WHERE len(reasons) = 0")
def sft_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = trajectories.to_records(_filtered(spark, sf_dir), "Answer from evidence.")
    return trajectories.to_turns(records, "One action at a time.").select("id", F.size("messages").alias("turns"))


@query(f"WITH {_TRAJ} SELECT source || '-train-' || conv_id AS case_id, ' q ' AS question, 'the answer' AS expected_answer, CAST(NULL AS VARCHAR) AS error FROM t WHERE len(reasons) = 0")
def dev_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.dev_cases(trajectories.to_records(_filtered(spark, sf_dir), "Answer from evidence.")).select("case_id", "question", "expected_answer", "error")


# Logs of tool use from events: a user's days are cases with five known ids; views search, clicks read, sign-ups evaluate,
# purchases answer, errors search without a query or are no action at all.
_TOOL_LOG = """
x AS (SELECT user_id || '-' || (dayofmonth(ts) - 1) // 6 AS c, ts, event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
l AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY ts, event_id) AS n, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'read_page' WHEN 'signup' THEN 'evaluate_evidence' WHEN 'purchase' THEN 'answer' WHEN 'error' THEN CASE WHEN k < 80 THEN 'search' END END AS action,
  event_type = 'error' AS silent, k, CASE event_type WHEN 'view' THEN [k % 6, (k + 1) % 6, (k + 2) % 6] WHEN 'click' THEN [k % 6] WHEN 'signup' THEN [k % 5] WHEN 'purchase' THEN list_distinct([k % 5, (k // 6) % 6]) ELSE [] END AS ids FROM x),
s AS (SELECT *, min(CASE WHEN action IS NULL THEN n END) OVER (PARTITION BY c) AS broken FROM l WHERE n <= 12),
r AS (SELECT * FROM s WHERE broken IS NULL OR n <= broken),
e AS (SELECT c, n, action, silent, unnest(ids) AS id FROM r),
e1 AS (SELECT *, id < 5 AS known, min(CASE WHEN action = 'search' AND NOT silent AND id < 5 THEN n END) OVER (PARTITION BY c, id) AS f FROM e),
e2 AS (SELECT *, min(CASE WHEN action = 'read_page' AND known AND f < n THEN n END) OVER (PARTITION BY c, id) AS rd FROM e1),
e3 AS (SELECT *, bool_and(known AND coalesce(rd < n, FALSE)) OVER (PARTITION BY c, n) AS whole FROM e2),
e4 AS (SELECT *, min(CASE WHEN action = 'evaluate_evidence' AND whole THEN n END) OVER (PARTITION BY c, id) AS j FROM e3),
g AS (SELECT c, n, count(*) AS wanted, count(*) FILTER (NOT known) AS unknown, count(*) FILTER (NOT coalesce(f < n, FALSE)) AS unfound, count(*) FILTER (NOT coalesce(rd < n, FALSE)) AS unread, count(*) FILTER (NOT coalesce(j < n, FALSE)) AS unjudged,
  count(*) FILTER (rd = n) AS fresh, list(id) FILTER (action = 'search' AND f = n) AS found, list(id) FILTER (action = 'read_page' AND rd = n) AS got FROM e4 GROUP BY c, n),
a AS (SELECT r.*, coalesce(wanted, 0) AS wanted, coalesce(unknown, 0) AS unknown, coalesce(unfound, 0) AS unfound, coalesce(unread, 0) AS unread, coalesce(unjudged, 0) AS unjudged, found, got,
  coalesce(sum(coalesce(fresh, 0)) OVER (PARTITION BY r.c ORDER BY r.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r LEFT JOIN g ON g.c = r.c AND g.n = r.n),
b AS (SELECT *, CASE WHEN action IS NULL THEN 'invalid_policy_output' WHEN action = 'answer' THEN CASE WHEN unknown > 0 THEN 'unknown_evidence_id' WHEN wanted = 0 THEN 'missing_evidence_citation' WHEN unread > 0 THEN 'unread_evidence_id'
  WHEN before < 2 THEN 'insufficient_evidence_coverage' WHEN wanted < 2 THEN 'insufficient_answer_citations' WHEN unjudged > 0 THEN 'evidence_not_evaluated' END
  WHEN action = 'read_page' THEN CASE WHEN unknown > 0 THEN 'unknown_evidence_id' WHEN unfound > 0 THEN 'undiscovered_evidence_id' END
  WHEN action = 'evaluate_evidence' THEN CASE WHEN wanted = 0 THEN 'invalid_arguments' WHEN unknown > 0 THEN 'unknown_evidence_id' WHEN unread > 0 THEN 'unread_evidence_id' END
  WHEN silent THEN 'invalid_arguments' END AS error FROM a),
d AS (SELECT *, min(CASE WHEN action = 'answer' AND error IS NULL THEN n END) OVER (PARTITION BY c) AS done FROM b),
z AS (SELECT * FROM d WHERE done IS NULL OR n <= done),
t AS (SELECT c, count(*) AS steps, bool_or(action IS NULL) AS broke, bool_or(action = 'answer') AS tried, arg_max(coalesce(error, ''), n) FILTER (action = 'answer') AS last_error, arg_max(ids, n) FILTER (action = 'answer') AS cited, arg_max(k, n) FILTER (action = 'answer') AS said,
  count(*) FILTER (error IS NOT NULL) AS failed, flatten(list(found) FILTER (found IS NOT NULL)) AS discovered, flatten(list(got) FILTER (got IS NOT NULL)) AS got,
  sum(CASE WHEN action = 'answer' THEN unknown WHEN error LIKE '%evidence_id%' THEN 1 ELSE 0 END) AS unknown_ids,
  count(*) FILTER (CASE WHEN action = 'answer' THEN error IN ('missing_evidence_citation', 'unread_evidence_id') ELSE error NOT LIKE '%evidence_id%' END) AS invalid_actions,
  count(*) FILTER (action = 'answer' AND error IN ('insufficient_evidence_coverage', 'insufficient_answer_citations', 'evidence_not_evaluated')) AS insufficient FROM z GROUP BY c),
u AS (SELECT *, coalesce(tried AND last_error = '' AND NOT broke, FALSE) AS completed, CASE WHEN coalesce(tried AND last_error = '' AND NOT broke, FALSE) THEN 'completed' WHEN broke THEN 'invalid_policy_output' ELSE coalesce(nullif(last_error, ''), 'max_steps') END AS stop_reason FROM t),
res AS (SELECT c AS case_id, completed, completed AND said % 2 = 0 AS answer_exact, stop_reason, CAST(steps AS INTEGER) AS steps, CAST(coalesce(len(discovered), 0) AS INTEGER) AS discovered, CAST(coalesce(len(got), 0) AS INTEGER) AS read, CAST(coalesce(len(cited), 0) AS INTEGER) AS cited,
  CAST(unknown_ids AS BIGINT) AS unknown_ids, invalid_actions, insufficient, CASE WHEN completed THEN failed ELSE 0 END AS recovered,
  NOT completed AND stop_reason <> 'max_steps' AND stop_reason <> 'undiscovered_evidence_id' AS protocol_failure,
  len(list_intersect([0, 1, 2], list_concat(coalesce(got, []), coalesce(cited, [])))) / 3e0 AS recall FROM u)
"""


def _tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    case = F.concat_ws("-", F.col("user_id").cast("string"), F.floor((F.dayofmonth("ts") - 1) / 6).cast("string"))
    action = F.when(kind == "view", replay.SEARCH).when(kind == "click", replay.READ).when(kind == "signup", replay.EVALUATE).when(kind == "purchase", replay.ANSWER).when(k < 80, replay.SEARCH)
    ids = F.when(kind == "view", F.array(k % 6, (k + 1) % 6, (k + 2) % 6)).when(kind == "click", F.array(k % 6)).when(kind == "signup", F.array(k % 5)).when(kind == "purchase", F.array(k % 5, F.floor(k / 6).cast("int") % 6))
    said = F.when(k % 2 == 0, "The Answer!").otherwise("no")
    steps = events.select(case.alias("case_id"), F.struct("ts", "event_id").alias("step"), action.alias("action"), F.when(kind != "error", "q").alias("query"), ids.cast("array<string>").alias("ids"), said.alias("final_answer"))
    of = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: i.cast("string"))
    cases = steps.select("case_id").distinct().select("case_id", of(4).alias("evidence"), of(2).alias("gold"), F.lit("something").alias("expected_answer"), F.array(F.lit("answer the")).alias("aliases"))
    return replay.results(steps, cases, max_steps=12, least_read=2, need_evaluated=True)


@query(f"WITH {_TOOL_LOG} SELECT case_id, completed, answer_exact, stop_reason, steps, discovered, read, cited, unknown_ids, invalid_actions, insufficient, recovered, protocol_failure, round(recall, 6) AS recall FROM res")
def tool_loop_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _tool_log(spark, sf_dir)
    return out.select(*[F.size(c).alias(c) if c in ("discovered", "read", "cited") else F.round(c, 6).alias(c) if c == "recall" else F.col(c) for c in out.columns])


@query(f"""WITH {_TOOL_LOG} SELECT count(*) AS cases, count(*) FILTER (completed) AS completed, round(avg(CAST(completed AS INTEGER)), 6) AS completion_rate, count(*) FILTER (answer_exact) AS answer_exact, round(avg(CAST(answer_exact AS INTEGER)), 6) AS answer_exact_rate,
  CAST(sum(unknown_ids) AS BIGINT) AS unknown_ids, CAST(sum(invalid_actions) AS BIGINT) AS invalid_actions, CAST(sum(insufficient) AS BIGINT) AS insufficient, CAST(sum(recovered) AS BIGINT) AS recovered, count(*) FILTER (protocol_failure) AS protocol_failures,
  round(avg(steps), 6) AS mean_steps, round(avg(recall), 6) AS mean_recall, avg(CAST(answer_exact AS INTEGER)) >= 0.5 AND avg(CAST(completed AS INTEGER)) >= 0.95 AND sum(unknown_ids) = 0 AND sum(invalid_actions) = 0 AND count(*) FILTER (protocol_failure) = 0 AND avg(recall) >= 0.9 AS passed FROM res""")
def tool_loop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replay.summary(_tool_log(spark, sf_dir), []).drop("checks", "decision")
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("rate") or c.startswith("mean") else F.col(c) for c in out.columns])


@query(r"""WITH a AS (SELECT conv_id, turn, trim(s) AS s FROM (SELECT conv_id, turn, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM conversations WHERE role = 'assistant') WHERE trim(s) <> '')
SELECT conv_id, turn, count(*) AS claims FROM a GROUP BY conv_id, turn""")
def claim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumnRenamed("text", "report")
    return E.claims(answers, keys=["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("claims"))
