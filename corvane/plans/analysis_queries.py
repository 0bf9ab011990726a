"""Queries of hybrid search, retriever evaluation, failure analysis, claims, ingestion and corpus preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, failures, ingest, rules
from ..operators import evaluate as E
from ..operators import retrieval as R
from ..operators.sequence import numbered
from ..sources.storage import broadcast_if_small, materialize
from .registry import query, table
from .retrieval_queries import _B, _METRICS, _bm25

# Vectors of documents and queries are their terms hashed to 64 signed slots. Judgments: a document's label is that of the
# vector whose number is its id, modulo the vectors that there are; a query's too.
_SLOTS = """SELECT id, CAST('0x' || substr(md5(term), 9, 8) AS BIGINT) % 64 AS slot, CAST(sum(CASE WHEN CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) >= 2147483648 THEN tf ELSE -tf END) AS DOUBLE) AS x FROM {0} GROUP BY id, slot"""
_PAIR = f"""
ev AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS no, label, count(*) OVER () AS m FROM embeddings),
dv AS (SELECT doc_id AS id, label FROM documents JOIN ev ON no = doc_id % m), qv AS (SELECT item_id AS query, label FROM benchmark JOIN ev ON no = item_id % m),
dh AS ({_SLOTS.format("post")}), qh AS ({_SLOTS.format("(SELECT query AS id, term, qtf AS tf FROM q)")}),
dl2 AS (SELECT id, sqrt(sum(x * x)) AS l FROM dh GROUP BY id HAVING sum(x * x) > 0), ql2 AS (SELECT id, sqrt(sum(x * x)) AS l FROM qh GROUP BY id HAVING sum(x * x) > 0),
dt AS (SELECT qh.id AS query, dh.id, sum(qh.x * dh.x) AS dot FROM qh JOIN dh USING (slot) GROUP BY qh.id, dh.id),
ds AS (SELECT ql2.id AS query, dl2.id, coalesce(dot, 0e0) / (ql2.l * dl2.l) AS score FROM ql2 CROSS JOIN dl2 LEFT JOIN dt ON dt.query = ql2.id AND dt.id = dl2.id),
de AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM ds)"""
_HYBRID = f"""{_B}, {_PAIR},
rk AS (SELECT query, id, 'bm25' AS source, rank, score FROM bm WHERE rank <= 20 UNION ALL SELECT query, id, 'dense', rank, score FROM de WHERE rank <= 20),
fu AS (SELECT query, id, sum(1e0 / (60 + rank)) AS score, count(*) AS n, min(rank) AS best, max(rank) FILTER (source = 'bm25') AS bm25_rank, max(rank) FILTER (source = 'dense') AS dense_rank,
  max(score) FILTER (source = 'bm25') AS bm25_score, max(score) FILTER (source = 'dense') AS dense_score FROM rk GROUP BY query, id),
hy AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, n DESC, best, id) AS rank FROM fu)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(id, label, embedding) of documents and of queries."""
    index, asked = _bm25(spark, sf_dir)
    named = materialize(numbered(table(spark, sf_dir, "embeddings").select("vec_id", "label"), order=["vec_id"]).select("no", "label"), "labels")
    m = named.count()
    of = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("id"), (F.col(c) % m).alias("no")).join(broadcast_if_small(named, merge=True), "no").select("id", "label")
    terms = asked.select(F.col("query").alias("id"), "term", F.col("qtf").cast("double").alias("tf"))
    docs = of("documents", "doc_id").join(R.hashed_vectors(index), "id", "left").withColumnRenamed("vector", "embedding")
    queries = of("benchmark", "item_id").join(R.hashed_terms(terms), "id", "left").withColumnRenamed("vector", "embedding")
    return materialize(docs, "vectors"), materialize(queries, "asked")


def _rankings(spark: SparkSession, sf_dir: str, k: int = 20) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """BM25, dense and hybrid hits, and the vectors of documents and queries."""
    docs, asked = _vectors(spark, sf_dir)
    lexical = materialize(R.bm25_rankings(*_bm25(spark, sf_dir), top_k=k).select("query", "id", "rank", "score"), "lexical")
    near = materialize(R.dense(docs, asked, top_k=k, id_col="id").select("query", "id", "rank", "score"), "dense")
    return lexical, near, R.hybrid(lexical, near, top_k=10, candidate_k=k), docs, asked


@query(f"""WITH {_HYBRID} SELECT query, id, CAST(rank AS INTEGER) AS rank, round(score, 9) AS score, CASE WHEN n = 2 THEN 'bm25,dense' WHEN bm25_rank IS NULL THEN 'dense' ELSE 'bm25' END AS sources,
  CAST(bm25_rank AS INTEGER) AS bm25_rank, CAST(dense_rank AS INTEGER) AS dense_rank, round(bm25_score, 6) AS bm25_score, round(dense_score, 6) AS dense_score,
  round(1e0 / (60 + bm25_rank), 9) AS bm25_part, round(1e0 / (60 + dense_rank), 9) AS dense_part FROM hy WHERE rank <= 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _rankings(spark, sf_dir)[2]
    of = lambda m, s: F.try_element_at(m, F.lit(s))
    return hits.select(
        "query", "id", "rank", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"), *[of("source_ranks", s).alias(f"{s}_rank") for s in ("bm25", "dense")],
        *[F.round(of("source_scores", s), 6).alias(f"{s}_score") for s in ("bm25", "dense")], *[F.round(of("contributions", s), 9).alias(f"{s}_part") for s in ("bm25", "dense")],
    )


@query(f"""WITH {_HYBRID},
h AS (SELECT hy.*, '[DOC ' || id || ']' || chr(10) || 'Title: ' || chr(10) || 'Source: ' || coalesce(nullif(source, ''), 'unknown') || chr(10) || 'RRF Rank: ' || rank
  || CASE WHEN bm25_rank IS NULL THEN '' ELSE chr(10) || 'BM25 Rank: ' || bm25_rank END || CASE WHEN dense_rank IS NULL THEN '' ELSE chr(10) || 'Dense Rank: ' || dense_rank END || chr(10) || 'Content:' AS header, coalesce(text, '') AS content
  FROM hy JOIN documents ON doc_id = id WHERE rank <= 5),
r AS (SELECT *, coalesce(sum(length(header) + 3 + length(content)) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h),
s AS (SELECT *, 6000 - used - length(header) - 1 AS room FROM r),
z AS (SELECT *, coalesce(max(CASE WHEN room < length(content) THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM s),
p AS (SELECT query, id, rank, length(content) > room AS truncated, header || chr(10) || left(content, CAST(room AS BIGINT)) AS packed FROM z WHERE stopped = 0 AND room >= 0),
a AS (SELECT query, list(id ORDER BY rank) AS ids, string_agg(packed, chr(10) || chr(10) ORDER BY rank) AS context, bool_or(truncated) AS truncated FROM p GROUP BY query)
SELECT query, length(context) AS characters, md5(context) AS digest, truncated, CAST(len(ids) AS INTEGER) AS blocks, CAST(1 AS INTEGER) AS valid, CAST(1 AS INTEGER) AS invalid FROM a""")
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid hits packed under their headers, and the citations of an answer that names the first and one that is not there."""
    hits = materialize(_rankings(spark, sf_dir)[2].where("rank <= 5").select("query", F.col("id").alias("doc_id"), "rank", "source_ranks"), "hits")
    rank = lambda s: F.try_element_at("source_ranks", F.lit(s))
    header = R.context_header(F.col("doc_id"), F.lit(""), F.col("source"), [("RRF Rank", F.col("rank")), ("BM25 Rank", rank("bm25")), ("Dense Rank", rank("dense"))])
    blocks = table(spark, sf_dir, "documents").join(broadcast_if_small(hits), "doc_id").select("query", "rank", "doc_id", header.alias("header"), F.coalesce("text", F.lit("")).alias("content"))
    packed = R.pack(blocks, max_chars=6000)
    listed = packed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "packed"))).alias("x"), F.bool_or("truncated").alias("truncated"))
    context, ids = F.array_join("x.packed", "\n\n"), F.transform("x.doc_id", lambda i: F.concat(F.lit("doc-"), i.cast("string")))
    rows = listed.select("query", context.alias("context"), "truncated", ids.alias("ids"), F.concat(F.lit("So it is ["), F.upper(ids[0]), F.lit("] and [doc-none], [doc-none].")).alias("answer"))
    out = R.check_citations(rows, F.col("ids"))
    return out.select("query", F.length("context").cast("bigint").alias("characters"), F.md5("context").alias("digest"), "truncated", F.size("ids").alias("blocks"), F.size("valid").alias("valid"), F.size("invalid").alias("invalid"))


_JUDGED = f"""{_HYBRID}, qr AS (SELECT query, id, 1 + id % 3 AS grade FROM qv JOIN dv USING (label) WHERE id % 7 = 0),
hits AS (SELECT 'lexical' AS method, query, id, rank FROM bm WHERE rank <= 10 UNION ALL SELECT 'dense', query, id, rank FROM de WHERE rank <= 10 UNION ALL SELECT 'fused', query, id, rank FROM hy WHERE rank <= 10),
idl AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS r FROM qr),
i AS (SELECT query, count(*) AS relevant, sum(CASE WHEN r <= 5 THEN (2e0 ^ grade - 1) / log2(r + 1) END) AS i5, sum(CASE WHEN r <= 10 THEN (2e0 ^ grade - 1) / log2(r + 1) END) AS i10 FROM idl GROUP BY query),
g AS (SELECT method, query, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, count(*) AS h10, min(rank) AS f,
  sum(CASE WHEN rank <= 5 THEN (2e0 ^ grade - 1) / log2(rank + 1) END) AS d5, sum((2e0 ^ grade - 1) / log2(rank + 1)) AS d10 FROM hits JOIN qr USING (query, id) GROUP BY method, query),
mt AS (SELECT m.method, i.query, coalesce(h1, 0) / CAST(relevant AS DOUBLE) AS recall_1, coalesce(h3, 0) / CAST(relevant AS DOUBLE) AS recall_3, coalesce(h5, 0) / CAST(relevant AS DOUBLE) AS recall_5, coalesce(h10, 0) / CAST(relevant AS DOUBLE) AS recall_10,
  coalesce(h5, 0) / 5e0 AS precision_5, coalesce(h10, 0) / 10e0 AS precision_10, coalesce(1e0 / f, 0e0) AS reciprocal_rank, coalesce(d5 / i5, 0e0) AS ndcg_5, coalesce(d10 / i10, 0e0) AS ndcg_10
  FROM (VALUES ('lexical'), ('dense'), ('fused')) m(method) CROSS JOIN i LEFT JOIN g ON g.method = m.method AND g.query = i.query)"""


def _judged(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Metrics by method, the judgments (group, id, grade) of each label, which all its queries share, and the queries' (query, group)."""
    lexical, near, fused, docs, asked = _rankings(spark, sf_dir)
    qrels = materialize(docs.where("id % 7 = 0 AND label IS NOT NULL").select(F.col("label").alias("group"), "id", (F.col("id") % 3 + 1).cast("int").alias("grade")), "qrels")
    groups = asked.where("label IS NOT NULL").select(F.col("id").alias("query"), F.col("label").alias("group"))
    each = {"lexical": lexical, "dense": near, "fused": fused}
    hits = None
    for n, d in each.items():
        rows = d.where("rank <= 10").select(F.lit(n).alias("method"), "query", "id", "rank")
        hits = rows if hits is None else hits.unionByName(rows)
    hits = materialize(hits, "hits")
    return {n: E.metric_bundle(hits.where(F.col("method") == n).drop("method"), qrels, groups=groups) for n in each}, qrels, groups


@query(f"WITH {_JUDGED} SELECT method, count(*) AS queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _METRICS)}, arg_min(query, (ndcg_10, query)) AS worst, arg_max(query, (ndcg_10, query)) AS best FROM mt GROUP BY method")
def retriever_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = _judged(spark, sf_dir)[0]
    rows = None
    for n, m in metrics.items():
        own = m.withColumn("method", F.lit(n))
        rows = own if rows is None else rows.unionByName(own)
    rows = materialize(rows, "metrics")
    macro = rows.groupBy("method").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in _METRICS])
    return macro.join(E.extremes(rows, "method"), "method").select("method", "queries", *_METRICS, "worst", "best")


_CATEGORY = r"CASE WHEN regexp_matches(text, '(^|[^\pL\pM\p{Nd}\p{Pc}])[A-Z]{2,}([^\pL\pM\p{Nd}\p{Pc}]|$)') THEN 'acronym' WHEN contains(lower(text), ' and ') OR contains(lower(text), ' or ') OR contains(lower(text), 'associated with') THEN 'multi-concept' WHEN regexp_matches(text, '\d|[-/]') THEN 'exact-term' ELSE 'semantic-paraphrase' END"


def _lengths(qrels: DataFrame, documents: DataFrame) -> DataFrame:
    """Per group its judged documents, counted, and the least and the most characters of one (none if no text is there)."""
    sizes = documents.select(F.col("doc_id").alias("id"), F.length("text").alias("n"))
    return qrels.join(sizes.hint("merge"), "id").groupBy("group").agg(F.count(F.lit(1)).alias("relevant"), F.array_compact(F.array(F.min("n"), F.max("n"))).alias("lengths"))


@query(f"""WITH {_JUDGED}, w AS (SELECT query, max(recall_10) FILTER (method = 'lexical') AS lr, max(recall_10) FILTER (method = 'dense') AS dr, max(ndcg_10) FILTER (method = 'lexical') AS ln, max(ndcg_10) FILTER (method = 'dense') AS dn, max(ndcg_10) FILTER (method = 'fused') AS fn FROM mt GROUP BY query),
k AS (SELECT qr.query, count(*) AS relevant, bool_or(length(text) < 200) AS short, bool_or(length(text) > 4000) AS long FROM qr JOIN documents ON doc_id = id GROUP BY qr.query),
c AS (SELECT item_id AS query, {_CATEGORY} AS category, item_id % 5 <> 0 AS reviewed FROM benchmark),
a AS (SELECT c.*, coalesce(relevant, 0) AS relevant, coalesce(short, FALSE) AS short, coalesce(long, FALSE) AS long, coalesce(lr, 0) AS lr, coalesce(dr, 0) AS dr, coalesce(ln, 0) AS ln, coalesce(dn, 0) AS dn, coalesce(fn, 0) AS fn FROM c LEFT JOIN k USING (query) LEFT JOIN w USING (query))
SELECT query, category, round(abs(ln - dn), 6) AS gap, array_to_string(list_sort([x FOR x IN [CASE WHEN relevant = 0 THEN 'no_answer_false_positive' END, CASE WHEN lr < dr THEN 'lexical_mismatch' END, CASE WHEN dr < lr AND category = 'acronym' THEN 'acronym_failure' END,
  CASE WHEN dr < lr AND category <> 'acronym' THEN 'dense_false_positive' END, CASE WHEN fn < greatest(ln, dn) THEN 'fusion_regression' END, CASE WHEN short THEN 'chunk_too_short' END, CASE WHEN long THEN 'chunk_too_long' END,
  CASE WHEN NOT reviewed THEN 'annotation_uncertain' END] IF x IS NOT NULL]), ',') AS labels FROM a""")
def compare_retrievers(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics, qrels, groups = _judged(spark, sf_dir)
    lengths = groups.join(_lengths(qrels, table(spark, sf_dir, "documents")), "group").drop("group")
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), rules.query_category(F.col("text")).alias("category"), (F.col("item_id") % 5 != 0).alias("reviewed"), F.lit(True).alias("returned"))
    cases = cases.join(lengths, "query", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0))).withColumn("lengths", F.coalesce("lengths", F.array().cast("array<int>")))
    return E.compare(*metrics.values(), cases).select("query", "category", F.round("gap", 6).alias("gap"), F.array_join("labels", ",").alias("labels"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure-analysis cases made of numbers: orders are cases, their five ids rankings, with every kind of answer."""
    n = F.col("o_orderkey")
    ids = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.concat(F.lit("c"), F.pmod(n * a + i * b, F.lit(11)).cast("string")))
    none = F.array().cast("array<string>")
    answer = lambda name, k: F.struct(
        F.lit(name).alias("name"), F.lit("x").alias("answer"), (F.pmod(n, F.lit(k)) == 0).alias("abstained"), F.when(F.pmod(n, F.lit(k + 1)) == 0, none).otherwise(F.array(F.concat(F.lit("c"), F.pmod(n, F.lit(3)).cast("string")))).alias("citations"),
        F.when(F.pmod(n, F.lit(k + 2)) == 0, F.array(F.lit("z"))).otherwise(none).alias("invalid"), F.array(F.lit("c0"), F.lit("c1")).alias("context"),
    )
    grades = F.map_from_arrays(F.array(F.lit("c1"), F.lit("c4"), F.lit("c9")), F.array((F.pmod(n, F.lit(3)) + 1).cast("int"), F.lit(1), F.lit(0)))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("case-"), n.cast("string")).alias("case_id"), F.when(F.pmod(n, F.lit(4)) != 0, F.pmod(n, F.lit(2)) == 0).alias("answerable"), F.when(F.pmod(n, F.lit(5)) != 0, grades).alias("relevance"), ids(1, 1).alias("bm25"), ids(2, 3).alias("dense"),
        F.when(F.pmod(n, F.lit(6)) != 0, ids(3, 2)).alias("rrf"), F.when(F.pmod(n, F.lit(3)) != 0, ids(4, 4)).alias("before"), F.when(F.pmod(n, F.lit(3)) != 0, ids(5, 4)).alias("after"), F.array(answer("baseline", 4), answer("reranked", 5)).alias("rag"),
        F.when(F.pmod(n, F.lit(9)) == 0, F.array(F.lit("context_noise"), F.lit("made_up"), F.lit("lexical_mismatch"))).alias("signals"),
    )


def _sql_ids(a: int, b: int) -> str:
    return f"['c' || ((n * {a} + i * {b}) % 11) FOR i IN range(0, 7)]"


def _sql_grade(x: str) -> str:
    return f"(CASE {x} WHEN 'c1' THEN n % 3 + 1 WHEN 'c4' THEN 1 ELSE 0 END)"


def _sql_ndcg(ids: str) -> str:
    dcg = lambda grades: f"list_sum([CASE WHEN ({grades})[j] > 0 THEN (2e0 ^ ({grades})[j] - 1) / log2(j + 1) ELSE 0e0 END FOR j IN range(1, 6)])"
    own = f"[{_sql_grade('x')} FOR x IN {ids}]"
    return f"(coalesce({dcg(own)}, 0e0) / {dcg('[greatest(n % 3 + 1, 1), least(n % 3 + 1, 1), 0, 0, 0]')})"


def _sql_recall(ids: str) -> str:
    return f"(len([x FOR x IN ['c1', 'c4'] IF list_contains(list_slice({ids}, 1, 5), x)]) / 2e0)"


def _sql_answer(k: int) -> str:
    cited = f"CASE WHEN n % {k + 1} = 0 THEN CAST([] AS VARCHAR[]) ELSE ['c' || (n % 3)] END"
    return f"""[CASE WHEN n % {k + 2} = 0 OR (n % {k + 1} <> 0 AND n % 3 = 2) THEN 'citation_invalid_id' END, CASE WHEN answerable AND n % {k} <> 0 AND len({cited}) = 0 THEN 'citation_missing' END,
  CASE WHEN NOT answerable AND n % {k} <> 0 THEN 'no_answer_false_positive' END, CASE WHEN answerable AND n % {k} = 0 THEN 'false_abstention' END, CASE WHEN NOT answerable AND n % {k} = 0 THEN 'correct_abstention' END]"""


_STAGE = "CASE " + " ".join(f"WHEN x IN ({', '.join(repr(n) for n in some)}) THEN '{s}'" for s, some in failures.STAGES) + " END"
_RR = "coalesce(1e0 / list_min([j FOR j IN range(1, 8) IF {0}[j] IN ('c1', 'c4')]), 0e0)"
_FAILURES = f"""
o AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 2 = 0 END AS answerable FROM orders),
l AS (SELECT n, answerable, {_sql_ids(1, 1)} AS b, {_sql_ids(2, 3)} AS d, {_sql_ids(3, 2)} AS r, {_sql_ids(4, 4)} AS be, {_sql_ids(5, 4)} AS af FROM o),
m AS (SELECT *, {_sql_recall('b')} AS rb, {_sql_recall('d')} AS rd, greatest({_sql_ndcg('b')}, {_sql_ndcg('d')}) AS best, {_sql_ndcg('r')} AS fused, {_sql_ndcg('be')} AS n0, {_sql_ndcg('af')} AS n1, {_RR.format('be')} AS m0, {_RR.format('af')} AS m1, list_has_any(be, ['c1', 'c4']) AS there FROM l),
f AS (SELECT n, CASE WHEN n % 5 = 0 THEN [CASE WHEN coalesce(answerable, TRUE) THEN 'annotation_uncertain' END] ELSE [CASE WHEN rd > rb THEN 'lexical_mismatch' END, CASE WHEN rb > 0 AND rd = 0 THEN 'dense_false_positive' END,
  CASE WHEN n % 6 <> 0 AND fused < best THEN 'fusion_regression' END, CASE WHEN n % 6 <> 0 AND fused > best THEN 'fusion_improvement' END, CASE WHEN n % 3 <> 0 THEN CASE WHEN NOT there THEN 'candidate_missing_before_rerank' WHEN n1 > n0 OR m1 > m0 THEN 'reranker_improvement' WHEN n1 < n0 OR m1 < m0 THEN 'reranker_regression' END END] END
  || {_sql_answer(4)} || {_sql_answer(5)} || CASE WHEN n % 9 = 0 THEN ['context_noise', 'lexical_mismatch'] ELSE [] END AS every FROM m),
g AS (SELECT n, list_filter(every, lambda x: x IS NOT NULL) AS every FROM f), a AS (SELECT n, [every[j] FOR j IN range(1, len(every) + 1) IF list_position(every, every[j]) = j] AS labels FROM g)
"""


@query(f"""WITH {_FAILURES}, s AS (SELECT n, labels, coalesce([x FOR x IN labels IF x NOT IN ('fusion_improvement', 'reranker_improvement', 'correct_abstention')][1], labels[1]) AS first FROM a)
SELECT 'case-' || n AS case_id, array_to_string(labels, ',') AS labels, array_to_string([s FOR s IN [{', '.join(repr(s) for s, _ in failures.STAGES)}] IF list_contains([{_STAGE} FOR x IN labels], s)], ',') AS stages,
  first, {_STAGE.replace('x IN', 'first IN')} AS first_stage FROM s""")
def failure_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = failures.analyze(_cases(spark, sf_dir))
    return out.select("case_id", F.array_join("labels", ",").alias("labels"), F.array_join("stages", ",").alias("stages"), "first", "first_stage")


@query(f"""WITH {_FAILURES}, e AS (SELECT DISTINCT n, 'label' AS kind, unnest(labels) AS name FROM a), st AS (SELECT DISTINCT n, 'stage' AS kind, {_STAGE.replace('x IN', 'name IN')} AS name FROM e),
c AS (SELECT kind, name, count(*) AS n FROM (SELECT * FROM e UNION ALL SELECT * FROM st) GROUP BY kind, name),
k AS (SELECT 'label' AS kind, unnest([{', '.join(repr(x) for x in failures.LABELS)}]) AS name UNION ALL SELECT 'stage', unnest([{', '.join(repr(s) for s, _ in failures.STAGES)}]))
SELECT kind, name, coalesce(c.n, 0) AS n FROM k LEFT JOIN c USING (kind, name)""")
def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.label_counts(failures.analyze(_cases(spark, sf_dir)))


@query(f"""WITH {_FAILURES}, t AS (SELECT unnest(range(0, {len(failures.TRACKED)})) AS place, unnest([{', '.join(repr(x) for x in failures.TRACKED)}]) AS label)
SELECT label, CAST(place AS INTEGER) AS place FROM t WHERE label NOT IN (SELECT unnest(labels) FROM a)""")
def failure_not_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.not_observed(failures.analyze(_cases(spark, sf_dir))).select("label", "place")


def _claim_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases of benchmark items: two gold claims each, and three answers that cite, half cite or do not."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]+", " "), " +").alias("w")).where(F.size("w") >= 14)
    part = lambda a: F.array_join(F.slice(F.col("w"), a, 6), " ")
    rows = items.select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("case_id"), part(2).alias("one"), part(8).alias("two"))
    cases = rows.select("case_id", F.array("one").alias("accepted"), F.array(F.lit("e1"), F.lit("e2"), F.lit("e3")).alias("evidence_ids"))
    claim = lambda no, text, sup, con: F.struct(F.lit(no).alias("gold_no"), F.col(text).alias("gold_text"), F.array(*map(F.lit, sup)).alias("supporting"), F.array(*map(F.lit, con)).cast("array<string>").alias("contradicting"))
    gold = rows.select("case_id", F.explode(F.array(claim(1, "one", ["e1", "e2"], []), claim(2, "two", ["e2"], ["e3"]))).alias("g")).select("case_id", "g.*")
    say = lambda mode, answer, *parts: F.struct(F.lit(mode).alias("mode"), answer.alias("answer"), F.concat(*parts).alias("report"), F.lit(10.0).alias("latency_ms"), F.lit(7).alias("total_tokens"))
    lit, one, two = F.lit, F.col("one"), F.col("two")
    answers = rows.select("case_id", F.explode(F.array(
        say("all", one, one, lit(" [E:e1] [E:e2]. "), two, lit(" [E:e2].")), say("first", F.upper("one"), one, lit(" [E:e1]. "), two, lit(" [E:e3]! "), lit("Nothing of this is known [E:e9].")), say("none", two, one, lit(". "), two, lit(".")), say("empty", lit(""), lit("")),
    )).alias("a")).select("case_id", "a.*")
    return cases, gold, answers



_F1 = "len(list_filter({0}, lambda y: y = x))"
_CLAIMS = rf"""
it AS (SELECT 'i' || item_id AS case_id, string_split_regex(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +') AS w FROM benchmark),
ro AS (SELECT case_id, array_to_string(w[2:7], ' ') AS one, array_to_string(w[8:13], ' ') AS two FROM it WHERE len(w) >= 14),
go AS (SELECT case_id, 1 AS gold_no, one AS g, ['e1', 'e2'] AS sup, CAST([] AS VARCHAR[]) AS con FROM ro UNION ALL SELECT case_id, 2, two, ['e2'], ['e3'] FROM ro),
an AS (SELECT case_id, 'all' AS mode, one AS answer, one || ' [E:e1] [E:e2]. ' || two || ' [E:e2].' AS report FROM ro UNION ALL SELECT case_id, 'first', upper(one), one || ' [E:e1]. ' || two || ' [E:e3]! Nothing of this is known [E:e9].' FROM ro
  UNION ALL SELECT case_id, 'none', two, one || '. ' || two || '.' FROM ro UNION ALL SELECT case_id, 'empty', '', '' FROM ro),
se AS (SELECT case_id, mode, [trim(x) FOR x IN string_split(regexp_replace(report, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) IF trim(x) <> ''] AS s FROM an),
cl AS (SELECT case_id, mode, no, trim(regexp_replace(regexp_replace(t, '\[E:[^\]\s]+\]', ' ', 'g'), '\s+', ' ', 'g')) AS claim, list_distinct(regexp_extract_all(t, '\[E:([^\]\s]+)\]', 1)) AS cited FROM (SELECT case_id, mode, unnest(s) AS t, unnest(range(1, len(s) + 1)) AS no FROM se)),
pw AS (SELECT c.case_id, mode, no, gold_no, regexp_extract_all(trim(regexp_replace(lower(claim), '\W+', ' ', 'g')), '{T.TOKEN_RE2}') AS l, regexp_extract_all(trim(regexp_replace(lower(g), '\W+', ' ', 'g')), '{T.TOKEN_RE2}') AS r FROM cl c JOIN go USING (case_id) WHERE claim <> ''),
f1 AS (SELECT case_id, mode, no, gold_no, CASE WHEN len(l) + len(r) > 0 THEN 2e0 * coalesce(list_sum(list_transform(list_distinct(l), lambda x: least({_F1.format("l")}, {_F1.format("r")}))), 0) / (len(l) + len(r)) ELSE 0 END AS f FROM pw),
be AS (SELECT case_id, mode, no, max(f) AS f, arg_max(gold_no, (f, -gold_no)) AS gold_no FROM f1 GROUP BY ALL),
ma AS (SELECT cl.case_id, cl.mode, cited, f, sup, con, list_intersect(cited, ['e1', 'e2', 'e3']) AS ok FROM cl JOIN be USING (case_id, mode, no) JOIN go ON go.case_id = cl.case_id AND go.gold_no = be.gold_no WHERE claim <> ''),
la AS (SELECT case_id, mode, cited, ok, CASE WHEN f >= {E.SUPPORT_F1} THEN sup ELSE [] END AS sup, CASE WHEN f < {E.SUPPORT_F1} THEN 'unsupported' WHEN list_has_any(ok, con) THEN 'contradicted' WHEN len(ok) = 0 THEN 'unsupported' WHEN list_has_all(ok, sup) THEN 'supported' WHEN list_has_any(ok, sup) THEN 'partial' ELSE 'unsupported' END AS label FROM ma),
ag AS (SELECT case_id, mode, count(label) AS claims, count(*) FILTER (len(cited) > 0) AS citing, count(*) FILTER (label = 'supported') AS s, count(*) FILTER (label = 'partial') AS p, count(*) FILTER (label = 'contradicted') AS c, count(*) FILTER (label = 'unsupported') AS u,
  coalesce(sum(len(cited)), 0) AS n, coalesce(sum(len(ok)), 0) AS valid, coalesce(sum(len(list_intersect(ok, sup))), 0) AS hits, coalesce(sum(len(sup)), 0) AS wanted FROM an LEFT JOIN la USING (case_id, mode) GROUP BY case_id, mode),
ev AS (SELECT ag.case_id, ag.mode, claims, CASE WHEN claims > 0 THEN citing / claims ELSE 0e0 END AS presence, CASE WHEN claims > 0 THEN s / claims ELSE 0e0 END AS supported, CASE WHEN claims > 0 THEN p / claims ELSE 0e0 END AS partial, CASE WHEN claims > 0 THEN c / claims ELSE 0e0 END AS contradicted,
  CASE WHEN claims > 0 THEN u / claims ELSE 0e0 END AS unsupported, CASE WHEN n > 0 THEN hits / n ELSE 0e0 END AS precision, CASE WHEN wanted > 0 THEN hits / wanted ELSE 0e0 END AS coverage, CASE WHEN n > 0 THEN (n - valid) / n ELSE 0e0 END AS invalid_rate,
  answer, 10e0 AS latency_ms, 7 AS total_tokens, lower(answer) = one AS exact FROM ag JOIN an ON an.case_id = ag.case_id AND an.mode = ag.mode JOIN ro ON ro.case_id = ag.case_id),
cf AS (SELECT *, [x FOR x IN [CASE WHEN NOT exact THEN 'answer_incorrect' END, CASE WHEN claims = 0 THEN 'empty_report' END, CASE WHEN presence < 1 THEN 'missing_citation' END, CASE WHEN invalid_rate > 0 THEN 'invalid_citation' END, CASE WHEN partial > 0 THEN 'partial_support' END,
  CASE WHEN contradicted > 0 THEN 'contradicted_claim' END, CASE WHEN unsupported > 0 THEN 'unsupported_claim' END] IF x IS NOT NULL] AS failures FROM ev)"""
_SHARES = ("presence", "supported", "partial", "contradicted", "unsupported", "precision", "coverage", "invalid_rate")


@query(f"WITH {_CLAIMS} SELECT case_id, mode, claims, {', '.join(f'round({c}, 6) AS {c}' for c in _SHARES)}, answer, latency_ms, CAST(total_tokens AS INTEGER) AS total_tokens, exact, array_to_string(failures, ',') AS failures FROM cf")
def claim_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.evaluate_claims(*_claim_tables(spark, sf_dir))
    return out.withColumns({"failures": F.array_join("failures", ",")} | {c: F.round(c, 6) for c in _SHARES})


@query(f"""WITH {_CLAIMS}, fc AS (SELECT mode, string_agg(f || '=' || n, ',' ORDER BY f) AS failure_counts FROM (SELECT mode, f, count(*) AS n FROM (SELECT mode, unnest(failures) AS f FROM cf) GROUP BY mode, f) GROUP BY mode)
SELECT cf.mode, count(*) AS cases, round(avg(CAST(exact AS INTEGER)), 6) AS exact, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _SHARES)}, avg(latency_ms) AS latency_ms, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, coalesce(any_value(failure_counts), '') AS failure_counts
FROM cf LEFT JOIN fc ON fc.mode = cf.mode GROUP BY cf.mode""")
def mode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.mode_summary(E.evaluate_claims(*_claim_tables(spark, sf_dir)))
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("failure_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumns({"failure_counts": counts} | {c: F.round(c, 6) for c in ("exact", *_SHARES)})


_STORED = """
docs AS (SELECT 'd' || o_orderkey AS document_id, CASE o_custkey % 3 WHEN 0 THEN 'demo' WHEN 1 THEN 'uploaded' ELSE 'evaluation' END AS corpus_namespace, CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'indexing' ELSE 'failed' END AS status,
  o_orderdate AS created_at, md5(CAST(o_custkey AS VARCHAR)) AS content_hash, 'f' || o_orderkey || '.txt' AS original_filename, 800 AS chunk_size, 120 AS chunk_overlap FROM orders),
chunks AS (SELECT 'c' || l_orderkey || '-' || l_linenumber AS chunk_id, 'd' || l_orderkey AS document_id, l_linenumber - 1 AS chunk_index, l_returnflag AS title, l_linestatus AS text FROM lineitem)"""


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey") % 3
    docs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("d"), k).alias("document_id"), F.when(c == 0, "demo").when(c == 1, "uploaded").otherwise("evaluation").alias("corpus_namespace"), F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "F", "indexing").otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.md5(F.col("o_custkey").cast("string")).alias("content_hash"), F.concat(F.lit("f"), k, F.lit(".txt")).alias("original_filename"), F.lit(800).alias("chunk_size"), F.lit(120).alias("chunk_overlap"),
    )
    key = F.col("l_orderkey").cast("string")
    chunks = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("c"), key, F.lit("-"), F.col("l_linenumber").cast("string")).alias("chunk_id"), F.concat(F.lit("d"), key).alias("document_id"), (F.col("l_linenumber") - 1).alias("chunk_index"), F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("text"),
        F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("page_number"), F.md5(key).alias("content_hash"), F.create_map(F.lit("filename"), F.lit("old"), F.lit("k"), F.lit("v")).alias("metadata"),
    )
    return docs, chunks


@query(f"WITH {_STORED}, f AS (SELECT * FROM docs WHERE corpus_namespace = 'uploaded' AND status = 'completed') SELECT document_id, CAST((SELECT count(*) FROM f) AS BIGINT) AS total FROM f ORDER BY created_at DESC, document_id LIMIT 25 OFFSET 50")
def document_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.list_documents(_stored(spark, sf_dir)[0], namespace="uploaded", status="completed", limit=25, offset=50).select("document_id", "total")


@query(f"WITH {_STORED} SELECT chunk_id, (SELECT count(*) FROM chunks WHERE document_id = 'd1') AS total FROM chunks WHERE document_id = 'd1' ORDER BY chunk_index LIMIT 3 OFFSET 1")
def chunk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.list_chunks(_stored(spark, sf_dir)[1], "d1", limit=3, offset=1).select("chunk_id", "total")


@query(f"WITH {_STORED} SELECT chunk_id AS id, original_filename AS source, corpus_namespace, 'v' AS own, original_filename AS filename FROM chunks JOIN docs USING (document_id) WHERE corpus_namespace IN ('demo', 'uploaded') AND status IN ('completed', 'indexing')")
def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = _stored(spark, sf_dir)
    return ingest.searchable(chunks, docs).select("id", "source", "corpus_namespace", F.col("metadata")["k"].alias("own"), F.col("metadata")["filename"].alias("filename"))


@query(f"WITH {_STORED} SELECT count(*) AS chunks FROM chunks JOIN docs USING (document_id) WHERE corpus_namespace IN ('demo', 'uploaded') AND status IN ('completed', 'indexing')")
def searchable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = _stored(spark, sf_dir)
    return ingest.searchable_count(chunks, docs)


@query(f"""WITH {_STORED}, k AS (SELECT corpus_namespace, content_hash, min(document_id) AS k_id FROM docs WHERE corpus_namespace = 'uploaded' AND status = 'completed' GROUP BY ALL),
u AS (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS content_hash, CASE WHEN c_custkey % 2 = 0 THEN 800 ELSE 900 END AS chunk_size FROM customer)
SELECT c_custkey, coalesce(k_id, 'document-' || left(sha256('uploaded:' || content_hash), 24)) AS document_id, k_id IS NULL AS created, k_id IS NOT NULL AND chunk_size = 800 AS duplicate FROM u LEFT JOIN k USING (content_hash)""")
def duplicate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _stored(spark, sf_dir)[0].where("corpus_namespace = 'uploaded' AND status = 'completed'")
    known = docs.groupBy("corpus_namespace", "content_hash").agg(F.min("document_id").alias("document_id"), F.first("status").alias("status"), F.first("chunk_size").alias("chunk_size"), F.first("chunk_overlap").alias("chunk_overlap"))
    uploads = table(spark, sf_dir, "customer").select("c_custkey", F.lit("uploaded").alias("corpus_namespace"), F.md5(F.col("c_custkey").cast("string")).alias("content_hash"), F.when(F.col("c_custkey") % 2 == 0, 800).otherwise(900).alias("chunk_size"), F.lit(120).alias("chunk_overlap"))
    return ingest.register(known, uploads).select("c_custkey", "document_id", "created", "duplicate")


@query(f"""WITH {_STORED}, x AS (SELECT 'd' || o_orderkey AS document_id FROM orders WHERE o_orderkey % 10 = 0 UNION SELECT 'missing')
SELECT x.document_id, CASE WHEN corpus_namespace IS NULL THEN 'document_not_found' WHEN corpus_namespace <> 'uploaded' THEN 'read_only_corpus' END AS error FROM x LEFT JOIN docs USING (document_id)""")
def delete_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _stored(spark, sf_dir)[0]
    doomed = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("document_id")).union(spark.range(1).select(F.lit("missing")))
    return ingest.deletable(docs, doomed)


@query(r"""WITH r AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents), n AS (SELECT *, sha256(t) AS h FROM r WHERE t <> ''),
f AS (SELECT h, min(doc_id) AS first, list(CAST(doc_id AS VARCHAR) ORDER BY doc_id) AS every FROM n GROUP BY h)
SELECT 'set-chunk-' || left(sha256('set' || chr(0) || first), 20) AS chunk_id, 'set:' || first AS document_id, h AS content_hash, array_to_string(list_slice(every, 2, len(every)), ',') AS duplicates FROM f""")
def canonical_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.lit("").alias("title"), F.col("text").alias("content"))
    return ingest.canonicalize(rows, dataset="set")[0].select("chunk_id", "document_id", "content_hash", F.array_join("duplicate_ids", ",").alias("duplicates"))


_UPLOAD = lambda x: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"


@query(rf"""WITH d AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\. ', '.' || chr(10) || '# ', 'g'), '\r\n|[\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS no FROM d), f AS (SELECT *, CAST(regexp_matches(line, '^\s*```') AS INTEGER) AS fence FROM l),
o AS (SELECT *, (sum(fence) OVER (PARTITION BY doc_id ORDER BY no) - fence) % 2 = 1 AS inside FROM f),
h AS (SELECT *, NOT inside AND fence = 0 AND regexp_matches(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$') AS head FROM o),
r AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY no) AS run FROM h),
b AS (SELECT doc_id, run, max(CASE WHEN head THEN {_UPLOAD("regexp_extract(line, '^(#{1,6})\\s+(.+?)\\s*#*\\s*$', 2)")} END) AS section, {_UPLOAD("coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT head), '')")} AS text FROM r GROUP BY doc_id, run)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INTEGER) AS block, md5(section) AS section, md5(text) AS text FROM b WHERE text <> ''""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as Markdown: every tenth line a heading."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\. ", ".\n# ").alias("text"))
    return ingest.markdown_blocks(docs).select(F.col("doc").alias("doc_id"), "block", F.md5("section").alias("section"), F.md5("text").alias("text"))


@query()
def simhash_blake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.simhash_blake(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")


@query(f"""WITH {_B}, t AS (SELECT query, bm.id, rank, round(score, 6) AS score, md5(left(coalesce(text, ''), 2000)) AS content, length(coalesce(text, '')) > 2000 AS truncated FROM bm JOIN documents d ON d.doc_id = bm.id WHERE rank <= 3)
SELECT query, id, CAST(rank AS INTEGER) AS rank, score, content, truncated FROM t""")
def local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    out = R.local_search(R.bm25(*_bm25(spark, sf_dir), top_k=3).select("query", "id", "rank", "score"), docs)
    return out.select("query", "id", "rank", F.round("score", 6).alias("score"), F.md5("content").alias("content"), "truncated")


@query(f"WITH {_B} SELECT query, array_to_string(list(id ORDER BY rank), ',') AS ids, CAST(count(*) AS INTEGER) AS n FROM bm WHERE rank <= 10 GROUP BY query")
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.ground_truth(R.bm25(*_bm25(spark, sf_dir), top_k=10))
    return out.select("query", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.size("ids").alias("n"))


@query(f"SELECT conv_id, turn, {_CATEGORY} AS category FROM conversations WHERE role = 'user'")
def question_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", rules.query_category(F.col("text")).alias("category"))
