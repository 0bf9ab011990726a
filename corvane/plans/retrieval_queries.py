"""Queries over the inverted index and the vectors. Benchmark passages are the text queries, every fiftieth vector a vector query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import retrieval as R
from ..sources.storage import broadcast_if_small, materialize
from .registry import query, table

_TOKENS = f"regexp_extract_all(lower(coalesce(text, '')), '{T.TOKEN_RE2}')"
_BM25 = f"""
tok AS (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM documents),
post AS (SELECT term, id, CAST(count(*) AS DOUBLE) AS tf FROM tok GROUP BY term, id),
dl AS (SELECT doc_id AS id, CAST(len({_TOKENS}) AS DOUBLE) AS length FROM documents),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, greatest(avg(length), 1e0) AS mean FROM dl),
q AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY query, term),
con AS (SELECT query, id, term, ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * qtf * tf * 2.5e0 / (tf + 1.5e0 * (B0 + B1 * length / mean)) AS contribution
  FROM q JOIN dfs USING (term) JOIN post USING (term) JOIN dl USING (id), st),
sc AS (SELECT query, id, sum(contribution) AS score FROM con GROUP BY query, id),
bm AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank, count(*) OVER (PARTITION BY query) AS total_hits FROM sc)
"""
_B = _BM25.replace("B0", "0.25e0").replace("B1", "0.75e0")


def _bm25(spark: SparkSession, sf_dir: str) -> tuple[R.Index, DataFrame]:
    return R.build_index(table(spark, sf_dir, "documents")), R.query_terms(table(spark, sf_dir, "benchmark"), id_col="item_id", text_col="text")


@query(f"WITH {_B} SELECT query, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, total_hits FROM bm WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(*_bm25(spark, sf_dir), top_k=10).select("query", "id", "rank", F.round("score", 6).alias("score"), "total_hits")


# Documents with the first line as title, whose terms count twice; queries in full-width letters, which are found all the same.
_TITLE = "coalesce(regexp_extract(text, '^([^\\n]*)', 1), '')"
_TITLED = _B.replace("CAST(count(*) AS DOUBLE) AS tf FROM tok", "CAST(sum(n) AS DOUBLE) AS tf FROM tok").replace(
    f"tok AS (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM documents)",
    f"tok AS (SELECT doc_id AS id, unnest({_TOKENS}) AS term, 1 AS n FROM documents UNION ALL SELECT doc_id, unnest({_TOKENS.replace('text', _TITLE)}), 2 FROM documents)",
).replace(f"CAST(len({_TOKENS}) AS DOUBLE) AS length", f"CAST(len({_TOKENS}) + 2 * len({_TOKENS.replace('text', _TITLE)}) AS DOUBLE) AS length")
_NARROW = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


@query(f"WITH {_TITLED} SELECT query, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, total_hits FROM bm WHERE rank <= 10")
def bm25_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("title", F.coalesce(F.regexp_extract("text", r"^([^\n]*)", 1), F.lit("")))
    wide = F.translate("text", _NARROW, "".join(chr(ord(c) + 0xFEE0) for c in _NARROW))
    asked = R.query_terms(table(spark, sf_dir, "benchmark").select("item_id", wide.alias("text")), id_col="item_id", text_col="text")
    return R.bm25(R.build_index(docs, title_col="title"), asked, top_k=10).select("query", "id", "rank", F.round("score", 6).alias("score"), "total_hits")


@query(f"""WITH {_B} SELECT query, id, term, round(contribution, 6) AS contribution,
  CAST(row_number() OVER (PARTITION BY query, id ORDER BY round(contribution, 9) DESC, term) AS INTEGER) AS position FROM con JOIN (SELECT query, id FROM bm WHERE rank <= 3) USING (query, id)""")
def bm25_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, asked = _bm25(spark, sf_dir)
    each = materialize(R.bm25_contributions(index, asked), "contributions")
    best = R.top_hits(each.groupBy("query", "id").agg(F.sum("contribution").alias("score")), 3).select("query", "id")
    return R.explain(each.join(broadcast_if_small(best), ["query", "id"])).select("query", "id", "term", F.round("contribution", 6).alias("contribution"), "position")


@query(f"WITH {_B} SELECT (SELECT count(*) FROM dl) AS documents, (SELECT round(avg(length), 3) FROM dl) AS average_length, (SELECT count(*) FROM dfs) AS unique_terms")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.index_stats(R.build_index(table(spark, sf_dir, "documents")))


@query(f"WITH {_B} SELECT term, df FROM dfs")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.build_index(table(spark, sf_dir, "documents")).terms


_DENSE = """
u AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dn AS (SELECT q.id AS query, d.id, list_cosine_similarity(q.v, d.v) AS score FROM u q, u d WHERE q.id % 50 = 0),
dr AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM dn)
"""


def _dense(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return R.dense(vectors, vectors.where("vec_id % 50 = 0"), top_k=k)


@query(f"WITH {_DENSE} SELECT query, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM dr WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("query", "id", "rank", F.round("score", 6).alias("score"))


_FLAT = _BM25.replace("B0", "1e0").replace("B1", "0e0")
for _n in ("tok", "post", "dl", "dfs", "st", "q", "con", "sc", "bm"):
    _FLAT = __import__("re").sub(rf"\b{_n}\b(?! \.)", f"{_n}_f", _FLAT)
_RRF = f"""{_B}, {_FLAT},
rk AS (SELECT query, id, 'lengths' AS source, rank FROM bm WHERE rank <= 20 UNION ALL SELECT query, id, 'flat', rank FROM bm_f WHERE rank <= 20),
fu AS (SELECT query, id, sum(1e0 / (60 + rank)) AS score, count(*) AS sources, min(rank) AS best_rank FROM rk GROUP BY query, id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, sources DESC, best_rank, id) AS rank FROM fu)
"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, asked = _bm25(spark, sf_dir)
    both = R.bm25_rankings(index, asked, top_k=20, bs=(0.75, 0.0))
    return R.fuse(both.select("query", F.when(F.col("b") > 0, "lengths").otherwise("flat").alias("source"), "id", "rank"))


@query(f"WITH {_RRF} SELECT query, id, round(score, 9) AS score, sources, CAST(best_rank AS INTEGER) AS best_rank, CAST(rank AS INTEGER) AS rank FROM fr")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query", "id", F.round("score", 9).alias("score"), "sources", "best_rank", "rank")


_SETS = f"""
dw AS (SELECT doc_id AS id, list_distinct({_TOKENS}) AS w FROM documents), qw AS (SELECT item_id AS query, list_distinct({_TOKENS}) AS w FROM benchmark),
ov AS (SELECT query, id, len(list_intersect(dw.w, qw.w)) AS score FROM dw, qw)
"""


def _overlap(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The words of documents (of those in `only`) and of queries."""
    docs = table(spark, sf_dir, "documents")
    docs = docs if only is None else docs.join(broadcast_if_small(only), "doc_id", "left_semi")
    sets = docs.select(F.col("doc_id").alias("id"), F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    return sets, asked


@query(f"WITH {_SETS} SELECT query, id, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM ov) WHERE rank <= 5")
def overlap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlap(*_overlap(spark, sf_dir), top_k=5).select("query", "id", "score", "rank")


@query(f"""WITH {_RRF}, {_SETS},
rr AS (SELECT fr.query, fr.id, fr.rank AS old_rank, row_number() OVER (PARTITION BY fr.query ORDER BY ov.score DESC, fr.rank, fr.id) AS rank FROM fr JOIN ov ON ov.query = fr.query AND ov.id = fr.id)
SELECT query, id, CAST(old_rank AS INTEGER) AS old_rank, CAST(rank AS INTEGER) AS rank, CAST(old_rank - rank AS INTEGER) AS rank_delta, rank <= 5 AS is_hit FROM rr""")
def rerank_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = materialize(_fused(spark, sf_dir).select("query", "id", "rank"), "fused")
    sets, asked = _overlap(spark, sf_dir, fused.select(F.col("id").alias("doc_id")).distinct())
    pairs = sets.join(fused, "id").join(broadcast_if_small(asked.select("query", F.col("words").alias("q"))), "query")
    scores = pairs.select("query", "id", F.size(F.array_intersect("words", "q")).alias("score"))
    return R.rerank(fused, scores, top_k=5).select("query", "id", "old_rank", "rank", "rank_delta", "is_hit")


@query(f"""WITH {_B},
b AS (SELECT query, rank, id, '[DOC ' || id || ']' || chr(10) || 'Title: ' || chr(10) || 'Source: ' || coalesce(nullif(source, ''), 'unknown') || chr(10) || 'BM25 Rank: ' || rank || chr(10) || 'Content:' AS header, coalesce(text, '') AS content FROM bm JOIN documents ON doc_id = id WHERE rank <= 10),
r AS (SELECT *, coalesce(sum(length(header) + 3 + length(content)) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b),
s AS (SELECT *, 6000 - used - length(header) - 1 AS room FROM r),
z AS (SELECT *, coalesce(max(CASE WHEN room < length(content) THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM s)
SELECT query, id, CAST(rank AS INTEGER) AS rank, length(content) > room AS truncated, md5(header || chr(10) || left(content, CAST(room AS BIGINT))) AS packed_md5 FROM z WHERE stopped = 0 AND room >= 0""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.bm25(*_bm25(spark, sf_dir), top_k=10).select("query", F.col("id").alias("doc_id"), "rank")
    blocks = table(spark, sf_dir, "documents").join(broadcast_if_small(hits), "doc_id").select("query", "rank", F.col("doc_id").alias("id"), R.context_header(F.col("doc_id"), F.lit(""), F.col("source"), [("BM25 Rank", F.col("rank"))]).alias("header"), F.coalesce("text", F.lit("")).alias("content"))
    return R.pack(blocks, max_chars=6000).select("query", "id", "rank", "truncated", F.md5("packed").alias("packed_md5"))


@query(r"""WITH a AS (SELECT conv_id, turn, 'See [Doc-' || conv_id || '] and [chunk-' || turn || '], [DOC-' || conv_id || '] too. ' || coalesce(text, '') AS answer FROM conversations WHERE role = 'assistant'),
c AS (SELECT *, list_transform(regexp_extract_all(answer, '(?i)\[((?:doc|chunk)-[a-z0-9_\-]+)\]', 1), lambda x: lower(x)) AS ids FROM a)
SELECT conv_id, turn, CAST(len(list_distinct(ids)) AS INTEGER) AS n_cited, CAST(CASE WHEN list_contains(ids, 'doc-' || conv_id) THEN 1 ELSE 0 END AS INTEGER) AS n_valid,
  CAST(len([x FOR x IN list_distinct(ids) IF x <> 'doc-' || conv_id]) AS INTEGER) AS n_invalid, starts_with(lower(ltrim(answer)), 'insufficient evidence') AS abstained FROM c""")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    answer = F.concat(F.lit("See [Doc-"), c, F.lit("] and [chunk-"), t, F.lit("], [DOC-"), c, F.lit("] too. "), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", answer.alias("answer"))
    out = R.check_citations(rows, F.array(F.concat(F.lit("doc-"), F.col("conv_id").cast("string"))))
    return out.select("conv_id", "turn", F.size("cited").alias("n_cited"), F.size("valid").alias("n_valid"), F.size("invalid").alias("n_invalid"), "abstained")


_QRELS = "qr AS (SELECT q.id AS query, d.id, 1 + d.id % 3 AS grade FROM u q JOIN u d ON q.label = d.label WHERE q.id % 50 = 0)"
_BUNDLE = f"""{_DENSE}, {_QRELS},
idl AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS r FROM qr),
i AS (SELECT query, count(*) AS relevant, sum(CASE WHEN r <= 5 THEN (2e0 ^ grade - 1) / log2(r + 1) END) AS i5, sum(CASE WHEN r <= 10 THEN (2e0 ^ grade - 1) / log2(r + 1) END) AS i10 FROM idl GROUP BY query),
j AS (SELECT dr.query, dr.rank, coalesce(grade, 0) AS grade FROM dr LEFT JOIN qr ON qr.query = dr.query AND qr.id = dr.id WHERE rank <= 10),
g AS (SELECT query, count(*) FILTER (grade > 0 AND rank <= 1) AS h1, count(*) FILTER (grade > 0 AND rank <= 3) AS h3, count(*) FILTER (grade > 0 AND rank <= 5) AS h5, count(*) FILTER (grade > 0) AS h10,
  min(CASE WHEN grade > 0 THEN rank END) AS f, sum(CASE WHEN rank <= 5 AND grade > 0 THEN (2e0 ^ grade - 1) / log2(rank + 1) END) AS d5, sum(CASE WHEN grade > 0 THEN (2e0 ^ grade - 1) / log2(rank + 1) END) AS d10 FROM j GROUP BY query),
mb AS (SELECT query, CAST(h1 AS DOUBLE) / relevant AS recall_1, CAST(h3 AS DOUBLE) / relevant AS recall_3, CAST(h5 AS DOUBLE) / relevant AS recall_5, CAST(h10 AS DOUBLE) / relevant AS recall_10, h5 / 5e0 AS precision_5,
  h10 / 10e0 AS precision_10, coalesce(1e0 / f, 0e0) AS reciprocal_rank, coalesce(d5 / i5, 0e0) AS ndcg_5, coalesce(d10 / i10, 0e0) AS ndcg_10 FROM g JOIN i USING (query))"""
_METRICS = ("recall_1", "recall_3", "recall_5", "recall_10", "precision_5", "precision_10", "reciprocal_rank", "ndcg_5", "ndcg_10")


def _bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of dense search; the vectors of a query's label are its judgments, which all queries of the label share."""
    v = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    groups = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("group"))
    qrels = v.select(F.col("label").alias("group"), F.col("vec_id").alias("id"), (F.col("vec_id") % 3 + 1).alias("grade"))
    return E.metric_bundle(_dense(spark, sf_dir), qrels, groups=groups)


@query(f"WITH {_BUNDLE} SELECT query, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM mb")
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundle(spark, sf_dir).select("query", *[F.round(m, 6).alias(m) for m in _METRICS])


@query(f"WITH {_BUNDLE} SELECT count(*) AS queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _METRICS)} FROM mb")
def metric_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro(_bundle(spark, sf_dir)).select("queries", *[F.round(m, 6).alias(m) for m in _METRICS])
