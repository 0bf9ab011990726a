"""Queries of sharded runs, unique evidence and pair scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequence as S
from ..operators import shards
from .registry import query, table

MODES = ["base", "sft"]
# A run in two modes over all items: the base mode repeats every 19th case, the other misses every 17th and has one not asked for.
_RUN = """c AS (SELECT item_id AS case_id, row_number() OVER (ORDER BY item_id DESC) AS position FROM benchmark),
r AS (SELECT case_id, 'base' AS mode, case_id % 3 = 0 AS exact FROM c UNION ALL SELECT case_id, 'base', true FROM c WHERE case_id % 19 = 0
  UNION ALL SELECT case_id, 'sft', case_id % 2 = 0 FROM c WHERE case_id % 17 <> 0 UNION ALL SELECT CAST(-1 AS BIGINT), 'sft', true)"""


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ordered = S.numbered(table(spark, sf_dir, "benchmark").select((-F.col("item_id")).alias("o"), F.col("item_id").alias("case_id")), order=["o"], name="position")
    cases = ordered.select("case_id", (F.col("position") + 1).cast("int").alias("position"))
    of = lambda m, e: cases.select("case_id", F.lit(m).alias("mode"), e.alias("exact"))
    i = F.col("case_id")
    rows = of("base", i % 3 == 0).union(of("base", F.lit(True)).where("case_id % 19 = 0")).union(of("sft", i % 2 == 0).where("case_id % 17 <> 0"))
    return cases, rows.union(spark.range(1).select(F.lit(-1).cast("bigint").alias("case_id"), F.lit("sft").alias("mode"), F.lit(True).alias("exact")))


@query("SELECT CAST(shard AS INTEGER) AS shard, source, count(*) AS n FROM (SELECT source, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS shard FROM documents) GROUP BY ALL")
def shard_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.dataset_counts(S.shards(table(spark, sf_dir, "documents").select("doc_id", "source"), order=["doc_id"], n=4), "source")


@query("""WITH e AS (SELECT lang AS dataset, CASE WHEN min(doc_id) % 2 = 0 THEN count(*) ELSE 30 END AS expected FROM documents GROUP BY lang UNION ALL SELECT 'none', 30),
n AS (SELECT lang AS dataset, count(*) AS n FROM documents GROUP BY lang)
SELECT coalesce(n.dataset, e.dataset) AS dataset, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected FROM n FULL JOIN e ON n.dataset IS NOT DISTINCT FROM e.dataset WHERE coalesce(n, 0) <> coalesce(expected, 0)""")
def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    expected = docs.groupBy(F.col("lang").alias("dataset")).agg(F.when(F.min("doc_id") % 2 == 0, F.count(F.lit(1))).otherwise(30).alias("expected"))
    expected = expected.union(spark.range(1).select(F.lit("none"), F.lit(30).cast("bigint")))
    return shards.unbalanced(docs, expected, "lang")


@query("""WITH s AS (SELECT doc_id % 4 AS shard, min(n_chars) % 2 AS steps, CASE WHEN min(doc_id) % 3 = 0 THEN NULL ELSE 'v1' END AS version FROM documents GROUP BY doc_id % 4),
f AS (SELECT steps AS fs, version AS fv FROM s ORDER BY shard LIMIT 1)
SELECT shard, 'steps' AS setting FROM s, f WHERE steps IS DISTINCT FROM fs UNION ALL SELECT shard, 'version' FROM s, f WHERE version IS DISTINCT FROM fv""")
def shard_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 4).alias("shard")).agg((F.min("n_chars") % 2).alias("steps"), F.when(F.min("doc_id") % 3 != 0, "v1").alias("version"))
    return shards.setting_differences(docs, ["steps", "version"])


@query(f"""WITH {_RUN}, w AS (SELECT case_id, mode FROM c, (VALUES ('base'), ('sft')) v(mode)), h AS (SELECT case_id, mode, count(*) AS n FROM r GROUP BY ALL)
SELECT mode, case_id, CASE WHEN n IS NULL THEN 'missing' WHEN w.case_id IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM w FULL JOIN h USING (mode, case_id) WHERE n IS NULL OR n > 1 OR w.case_id IS NULL""")
def shard_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, results = _run(spark, sf_dir)
    return shards.problems(results, cases, MODES)


@query(f"WITH {_RUN} SELECT case_id, mode, exact, CAST(position AS INTEGER) AS position, CASE mode WHEN 'base' THEN 1 ELSE 2 END AS mode_no FROM r JOIN c USING (case_id)")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, results = _run(spark, sf_dir)
    return shards.in_order(results, cases, MODES)


@query(f"""WITH {_RUN}, m AS (SELECT mode, avg(CASE WHEN exact THEN 1e0 ELSE 0e0 END) AS rate FROM r GROUP BY mode)
SELECT t.rate >= 0.4e0 AS gate_passed, t.rate >= b.rate + 0.05e0 AS improves, CASE WHEN t.rate >= 0.4e0 AND t.rate >= b.rate + 0.05e0 THEN 'eligible_for_rl' ELSE 'hold_before_rl' END AS decision
FROM m t, m b WHERE t.mode = 'sft' AND b.mode = 'base'""")
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _run(spark, sf_dir)[1].groupBy("mode").agg(F.avg(F.col("exact").cast("double")).alias("exact_rate"))
    return shards.comparison(rates.withColumn("gate_passed", F.col("exact_rate") >= 0.4))


@query("""WITH b AS (SELECT user_id, event_type, value, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k, min(event_id) OVER (PARTITION BY user_id, event_type) AS seen FROM events WHERE value IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, seen) AS rank FROM b WHERE k = 1) SELECT user_id, event_type, CAST(rank AS INTEGER) AS rank, value, event_id FROM o WHERE rank <= 2""")
def unique_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.unique_evidence(table(spark, sf_dir, "events"), by="user_id", doc="event_type", score="value", position="event_id", k=2)


def _shared_words(asked: str, texts: list[str]) -> np.ndarray:
    words = set(asked.split(" "))
    return np.array([len(words.intersection(t.split(" "))) for t in texts])


@query("""WITH m AS (SELECT count(*) AS m FROM benchmark), b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS no, item_id, coalesce(text, '') AS q FROM benchmark)
SELECT doc_id, item_id, CAST(len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split(coalesce(text, ''), ' ')))) AS DOUBLE) AS score FROM documents, m JOIN b ON no = doc_id % m""")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.numbered(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q")), order=["item_id"])
    pairs = table(spark, sf_dir, "documents").withColumn("no", F.col("doc_id") % table(spark, sf_dir, "benchmark").count()).join(b, "no")
    return shards.pair_scores(pairs, _shared_words, keys=["doc_id", "item_id"], query=F.col("q"), text=F.col("text")).withColumn("score", F.col("score").cast("double"))
