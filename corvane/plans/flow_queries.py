"""Queries of whole flows: web evidence, evaluation profiles, reindexing, index status, rates of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunk, evidence, pages, profiles
from ..operators.sequence import numbered
from ..sources.storage import manifest, materialize
from .analysis_queries import _CLAIMS, _claim_tables
from .corpus_queries import _CHUNKS, _URL
from .registry import query, table

# Twenty pages in order are a run's results; every third URL had been stored a while ago, half of them too long ago.
_WEB = f"""u AS (WITH a AS (SELECT page_id, trim(url) AS u FROM pages), {_URL}),
r AS (SELECT page_id, page_id // 20 AS run, page_id % 20 AS rank, url, page_id % 3 = 0 AS stored FROM u),
k AS (SELECT url, min(page_id) % 2 = 0 AS fresh FROM r WHERE stored GROUP BY url),
g AS (SELECT r.*, coalesce(fresh, FALSE) AS fresh, fresh IS NOT NULL AS known, row_number() OVER (PARTITION BY run, r.url ORDER BY rank) = 1 AS first FROM r LEFT JOIN k ON k.url = r.url),
c AS (SELECT *, coalesce(sum(CASE WHEN NOT fresh AND first THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reads FROM g),
f AS (SELECT *, min(CASE WHEN first THEN reads END) OVER (PARTITION BY run, url) AS begun FROM c),
s AS (SELECT run, rank, url, CASE WHEN fresh THEN 'cached' WHEN NOT first THEN CASE WHEN begun < 8 THEN 'cached' ELSE 'not_read_budget' END WHEN reads >= 8 THEN 'not_read_budget' WHEN known THEN 'deduplicated' ELSE 'stored' END AS status FROM f)"""


def _web(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, sf_dir, "pages")
    read = materialize(pages.texts(raw).withColumnRenamed("page", "page_id").join(raw.select("page_id", "url"), "page_id"), "read_pages")
    once = read.groupBy("url").agg(F.min_by(F.struct("title", "text"), "page_id").alias("p")).select("url", F.lit(None).cast("string").alias("final_url"), "p.title", F.concat(F.lit("page of "), "url").alias("text"))
    keyed = raw.select("page_id", T.canonical_url(F.col("url")).alias("url"), (F.col("page_id") % 3 == 0).alias("stored"))
    held = keyed.where("stored AND url IS NOT NULL").groupBy("url").agg((F.min("page_id") % 2 == 0).alias("fresh"))
    one = once.withColumn("url", T.canonical_url(F.col("url"))).groupBy("url").agg(F.max_by("text", "text").alias("text"))
    content = I.content_hash(T.normalize_evidence(F.col("text")))
    known = held.join(one, "url").select(I.stable_id("doc", F.col("url"), content).alias("document"), "url", F.lit(0).alias("fetched_at"), F.when(F.col("fresh"), 200).otherwise(50).alias("expires_at"))
    results = raw.select(F.floor(F.col("page_id") / 20).alias("run"), (F.col("page_id") % 20).cast("int").alias("rank"), "url")
    return evidence.research(results, once, known, now=F.lit(100), ttl=F.lit(100), budget=8)


@query(f"WITH {_WEB} SELECT run, CAST(rank AS INTEGER) AS rank, url, status FROM s")
def web_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _web(spark, sf_dir)[0].select("run", "rank", "url", "status")


@query(f"WITH {_WEB} SELECT run, count(*) FILTER (status = 'cached') AS cached, count(*) FILTER (status = 'not_read_budget') AS not_read_budget, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'deduplicated') AS deduplicated, count(*) FILTER (status = 'stored') AS stored FROM s GROUP BY run")
def web_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.run_metrics(_web(spark, sf_dir)[0], ["run"])


_PROFILE = """d AS (SELECT 'd' || doc_id AS document_id FROM documents), q AS (SELECT 'q' || item_id AS query_id, text FROM benchmark),
j AS (SELECT 'q' || item_id AS query_id, 'd' || doc_id AS document_id, CAST(doc_id % 4 AS INTEGER) - 1 AS relevance FROM benchmark JOIN documents ON doc_id % 37 = item_id % 37),
kn AS (SELECT * FROM j WHERE relevance > 0), cq AS (SELECT query_id FROM (SELECT query_id, row_number() OVER (ORDER BY sha256('p-queries:' || query_id), query_id) AS n FROM (SELECT DISTINCT query_id FROM kn JOIN q USING (query_id) WHERE trim(text) <> '')) WHERE n <= 15),
wq AS (SELECT kn.* FROM kn JOIN cq USING (query_id)), must AS (SELECT DISTINCT document_id FROM wq), m AS (SELECT count(*) AS m FROM must),
kd AS (SELECT document_id FROM must UNION ALL SELECT document_id FROM (SELECT document_id, row_number() OVER (ORDER BY sha256('p-documents:' || document_id), document_id) AS n FROM d ANTI JOIN must USING (document_id)), m WHERE n <= greatest(0, 300 - m)),
kq AS (SELECT kn.* FROM kn JOIN cq USING (query_id) JOIN kd USING (document_id))"""


def _profile(spark: SparkSession, sf_dir: str) -> profiles.Profile:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), "doc_id")
    asked = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), "text", "item_id")
    judged = asked.join(docs, F.col("doc_id") % 37 == F.col("item_id") % 37).select("query_id", "document_id", ((F.col("doc_id") % 4).cast("int") - 1).alias("relevance"))
    return profiles.build(docs.drop("doc_id"), asked.drop("item_id"), judged, n_documents=300, n_queries=15, seed="p")


@query(f"WITH {_PROFILE} SELECT query_id, document_id, relevance FROM kq")
def profile_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).qrels.select("query_id", "document_id", "relevance")


@query(f"""WITH {_PROFILE} SELECT (SELECT count(*) FROM kd) AS documents, (SELECT count(*) FROM cq) AS queries, (SELECT count(*) FROM kq) AS qrels, (SELECT count(*) FROM d) AS source_documents, (SELECT count(*) FROM kn) AS source_positive_qrels,
  'p' AS seed, (SELECT count(*) FROM kq) = (SELECT count(*) FROM kn) AS qrels_complete""")
def profile_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).manifest


@query("""SELECT conv_id, turn, CASE WHEN n <= 25 THEN 'validation' ELSE 'train' END AS split FROM conversations JOIN
  (SELECT conv_id, row_number() OVER (ORDER BY sha256('s:' || conv_id), conv_id) AS n FROM (SELECT DISTINCT conv_id FROM conversations)) USING (conv_id)""")
def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.split(table(spark, sf_dir, "conversations"), seed="s", validation=25, id_col="conv_id").select("conv_id", "turn", "split")


@query(f"""WITH c AS (WITH {_CHUNKS}), t AS (SELECT doc_id, trim(coalesce(text, '')) = '' AS blank, text IS NULL AS gone FROM documents),
a AS (SELECT t.*, CASE WHEN source IS NULL OR source = 'web' THEN 'demo' ELSE 'uploaded' END AS ns FROM t JOIN documents USING (doc_id)),
o AS (SELECT doc_id, CASE WHEN ns = 'demo' THEN 'read_only_corpus' WHEN gone THEN 'stored_file_missing' WHEN blank THEN 'no_chunks' END AS error, doc_id % 5 = 0 AS same FROM a)
SELECT 'd' || o.doc_id AS document_id, CAST(count(piece) FILTER (error IS NULL AND NOT same) AS BIGINT) AS chunks, coalesce(any_value(error), CASE WHEN any_value(same) THEN 'duplicate' ELSE 'completed' END) AS outcome FROM o LEFT JOIN c ON c.doc_id = o.doc_id GROUP BY o.doc_id""")
def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut in 400 characters are cut anew in 800, but for those that had 800 already, and those that may not be."""
    raw = table(spark, sf_dir, "documents").withColumn("document_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    had = F.col("doc_id") % 5 == 0
    namespace = F.when(F.col("source").isNull() | (F.col("source") == "web"), "demo").otherwise("uploaded")
    docs = raw.select("document_id", namespace.alias("corpus_namespace"), F.lit("completed").alias("status"), F.when(had, 800).otherwise(400).alias("chunk_size"), F.lit(120).alias("chunk_overlap"))
    old = chunk.chunks(raw.where(~had), size=400, overlap=120, id_col="document_id").withColumnRenamed("doc", "document_id").withColumn("chunk_id", F.lit("old"))
    asked = raw.select("document_id", F.lit(800).alias("chunk_size"), F.lit(None).cast("int").alias("chunk_overlap"))
    _, chunks, outcomes = profiles.reindex(docs, old, raw.select("document_id", "text"), asked)
    new = chunks.where("chunk_id <> 'old'").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    outcome = F.coalesce("error", F.when(F.col("duplicate"), "duplicate").otherwise("completed"))
    return outcomes.join(new, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).cast("long").alias("chunks"), outcome.alias("outcome"))


@query(f"""WITH c AS (WITH {_CHUNKS}) SELECT 3 AS current_version, (SELECT count(*) FROM documents) AS documents, count(*) AS chunks, count(*) > 0 AS bm25_ready, count(*) > 0 AS dense_ready, 'hashing-64' AS embedding_model, 64 AS embedding_dimension FROM c""")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = chunk.chunks(docs).select(F.concat_ws("-", F.col("doc").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text")
    chunks = materialize(cut.withColumn("vector", V.hashing_embedder(64)("text")), "status_chunks")
    return profiles.index_status(docs, chunks, chunks, version=3, model="hashing-64", dimension=64)


@query("""SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages""")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.table_counts({n: table(spark, sf_dir, n) for n in ("region", "nation", "documents", "pages")})


@query("""WITH p AS (SELECT event_type AS mode, value < 50 AS ok, CASE WHEN event_type <> 'error' AND user_id % 3 > 0 THEN 'x' ELSE '' END AS expected, value < 20 AS exact, value > 90 AS lim, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT mode, count(*) AS cases, count(*) FILTER (ok) AS format_valid, round(avg(CAST(ok AS INTEGER)), 6) AS format_valid_rate, count(*) FILTER (expected <> '') AS answer_scored_cases, count(*) FILTER (expected <> '' AND exact) AS answer_exact,
  round(avg(CAST(exact AS INTEGER)) FILTER (expected <> ''), 6) AS answer_exact_rate, count(*) FILTER (lim) AS token_limit_failures, round(avg(CAST(lim AS INTEGER)), 6) AS token_limit_failure_rate, round(avg(value), 6) AS mean_latency_seconds, round(avg(k), 6) AS mean_generated_tokens FROM p GROUP BY mode""")
def format_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("mode"), (v < 50).alias("format_valid"), F.when((F.col("event_type") != "error") & (F.col("user_id") % 3 > 0), "x").otherwise("").alias("expected_answer"), (v < 20).alias("answer_exact"),
        (v > 90).alias("hit_token_limit"), v.alias("latency_seconds"), F.get_json_object("props", "$.k").cast("int").alias("generated_tokens"),
    )
    out = profiles.format_rates(rows, ["mode"])
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("rate") or c.startswith("mean") else F.col(c) for c in out.columns])


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS successful_tool_calls, count(*) FILTER (event_type <> 'purchase') AS failed_tool_calls, CAST(count(*) - count(DISTINCT props) AS BIGINT) AS repeated_queries FROM events GROUP BY user_id""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "purchase", "succeeded").otherwise("failed"))
    return profiles.run_metrics(calls, run="user_id", status="status", question="props")


@query("""SELECT month, event_type AS label, count(*) AS n FROM (SELECT dayofmonth(ts) // 10 AS month, user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1, 2) GROUP BY month, event_type""")
def last_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.floor(F.dayofmonth("ts") / 10).alias("month"), "user_id", F.col("event_type").alias("label"), F.struct("ts", "event_id").alias("o"))
    return profiles.last_label_counts(rows, case=["user_id"], order="o", label="label", by=["month"])


@query("""WITH a AS (SELECT o_custkey AS query_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS query_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey AS query_id, c_name AS query, a.n AS plain_n, a.total AS plain_total, b.n AS grounded_n, b.total AS grounded_total FROM customer LEFT JOIN a ON a.query_id = c_custkey LEFT JOIN b ON b.query_id = c_custkey""")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    of = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("query_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    out = profiles.side_by_side(of("F"), of("O"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("text")))
    return out.select("query_id", "query", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("plain", "grounded") for c in ("n", "total")])


@query("""WITH o AS (SELECT o_custkey, list('o' || o_orderkey ORDER BY o_orderdate, o_orderkey) AS before, list('o' || o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS after FROM orders GROUP BY o_custkey),
v AS (SELECT *, list_sort(list_distinct(list_concat(before[1:5], after[1:5]))) AS seen FROM o)
SELECT o_custkey, array_to_string(before[1:5], ',') AS before, array_to_string(after[1:5], ',') AS after, array_to_string([x || '=' || (list_position(before, x) - list_position(after, x)) FOR x IN seen], ',') AS rank_changes FROM v""")
def compact_rerankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    listed = lambda *o: F.transform(F.array_sort(F.collect_list(F.struct(*o, F.col("o_orderkey"), key.alias("k")))), lambda x: x["k"])
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(listed(F.col("o_orderdate")).alias("before"), listed((-F.col("o_totalprice")).alias("p")).alias("after"))
    out = profiles.compact(rows, keys=["o_custkey"])
    changes = F.array_join(F.transform(F.array_sort(F.map_entries("rank_changes")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("o_custkey", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"), changes.alias("rank_changes"))


@query()
def web_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passages of what runs stored for each benchmark item; page texts come from a parser and have no SQL."""
    raw = table(spark, sf_dir, "pages")
    read = pages.texts(raw).withColumnRenamed("page", "page_id").join(raw.select("page_id", "url"), "page_id").select("url", F.lit(None).cast("string").alias("final_url"), "title", "text")
    none = spark.createDataFrame([], "document string, url string, fetched_at int, expires_at int")
    results = numbered(raw.select("page_id", "url"), order=["page_id"]).select(F.floor(F.col("no") / 20).alias("run"), (F.col("no") % 20).cast("int").alias("rank"), "url")
    _, docs = evidence.research(results, materialize(read, "read_pages"), none, now=F.lit(100), ttl=F.lit(100), budget=20)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return evidence.search(materialize(evidence.passages(docs), "passages"), asked, top_k=3).select("query", "rank", "passage", "document", "source", "url", F.round("score", 6).alias("score"))


@query(f"WITH {_CLAIMS} SELECT case_id, mode, array_to_string(failures, ',') AS failure_types FROM cf WHERE len(failures) > 0")
def frozen_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claim evaluation as a frozen run over the benchmark's file, and the answers that failed."""
    files = manifest(spark, f"{sf_dir}/benchmark.parquet")
    run = profiles.frozen_run(files, files, *_claim_tables(spark, sf_dir), dataset="benchmark")
    return run.failures.withColumn("failure_types", F.array_join("failure_types", ","))


@query(f"WITH {_CLAIMS} SELECT 'benchmark' AS dataset_id, (SELECT count(*) FROM ro) AS cases, (SELECT string_agg(mode, ',' ORDER BY mode) FROM (SELECT DISTINCT mode FROM cf)) AS modes, FALSE AS test_used_for_tuning")
def frozen_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = manifest(spark, f"{sf_dir}/benchmark.parquet")
    return profiles.frozen_run(files, files, *_claim_tables(spark, sf_dir), dataset="benchmark").config.drop("dataset_sha256").withColumn("modes", F.array_join("modes", ","))
