"""Failure analysis: labels of what went wrong with a query, by stage, from recorded rankings and answers.

Everything is a Column expression over one row a case; only the summaries aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluate import ratio

# The pipeline's stages in order, each with the labels that belong to it.
STAGES = (
    ("corpus", ("corpus_missing",)),
    ("parsing", ("parsing_failure", "scanned_pdf_no_text", "encoding_failure", "metadata_missing")),
    ("chunking", ("chunk_too_short", "chunk_too_long", "boundary_information_loss", "duplicate_chunk", "context_fragmentation")),
    ("bm25", ("lexical_mismatch", "tokenization_failure", "acronym_failure", "exact_term_false_positive")),
    ("dense", ("dense_false_positive", "semantic_mismatch", "embedding_domain_mismatch")),
    ("rrf", ("fusion_improvement", "fusion_regression", "candidate_k_too_small", "weak_path_interference")),
    ("retrieval", ("candidate_missing_before_rerank",)),
    ("reranker", ("reranker_improvement", "reranker_regression", "hard_negative_confusion")),
    ("context", ("context_selection_failure", "context_noise", "evidence_truncated", "redundant_context")),
    ("generation", ("generation_hallucination", "instruction_following_failure", "unsupported_claim", "answer_incomplete")),
    ("citation", ("citation_invalid_id", "citation_wrong_evidence", "citation_incomplete", "citation_misaligned", "citation_missing")),
    ("abstention", ("abstention_failure", "false_abstention", "no_answer_false_positive", "correct_abstention")),
    ("security", ("prompt_injection_risk",)),
    ("annotation", ("annotation_uncertain",)),
)
# Labels that are no failure, and those whose absence a summary reports.
SIGNALS = ("fusion_improvement", "reranker_improvement", "correct_abstention")
TRACKED = (
    "fusion_improvement", "fusion_regression", "reranker_improvement", "reranker_regression", "candidate_missing_before_rerank", "citation_invalid_id",
    "citation_missing", "no_answer_false_positive", "false_abstention", "correct_abstention", "prompt_injection_risk",
)
LABELS = tuple(label for _, some in STAGES for label in some)
VARIANT = "struct<name:string,answer:string,abstained:boolean,citations:array<string>,invalid:array<string>,context:array<string>>"
CASE = f"case_id string, answerable boolean, relevance map<string,int>, bm25 array<string>, dense array<string>, rrf array<string>, before array<string>, after array<string>, rag array<{VARIANT}>, signals array<string>"


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), _none())


def relevant(relevance: Column) -> Column:
    return F.map_keys(F.map_filter(relevance, lambda _, g: g > 0))


def recall_at(ids: Column, relevance: Column, k: int) -> Column:
    wanted = relevant(relevance)
    return ratio(F.size(F.array_intersect(wanted, F.slice(ids, 1, k))), F.size(wanted))


def ndcg_at(ids: Column, relevance: Column, k: int) -> Column:
    """nDCG of an ordered list against a map of grades; 0 without a positive grade."""

    def dcg(grades: Column) -> Column:
        gains = F.transform(F.slice(grades, 1, k), lambda g, i: F.when(g > 0, (F.pow(F.lit(2.0), g) - F.lit(1.0)) / F.log2(i + F.lit(2.0))).otherwise(F.lit(0.0)))
        return F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)

    ideal = dcg(F.sort_array(F.map_values(relevance), asc=False))
    return ratio(dcg(F.transform(ids, lambda x: F.coalesce(F.try_element_at(relevance, x), F.lit(0)))), ideal)


def reciprocal_rank(ids: Column, relevance: Column) -> Column:
    first = F.element_at(F.array_compact(F.concat(F.transform(ids, lambda x, i: F.when(F.try_element_at(relevance, x) > 0, i + 1)), F.array(F.lit(0)))), 1)
    return F.when(first > 0, F.lit(1.0) / first).otherwise(F.lit(0.0))


def _labelled(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def retrieval_labels(relevance: Column) -> Column:
    """From recall@5 and nDCG@5 of the columns bm25, dense and rrf."""
    b, d, r = _list("bm25"), _list("dense"), _list("rrf")
    rb, rd = recall_at(b, relevance, 5), recall_at(d, relevance, 5)
    best, fused = F.greatest(ndcg_at(b, relevance, 5), ndcg_at(d, relevance, 5)), ndcg_at(r, relevance, 5)
    return _labelled(
        (rd > rb, "lexical_mismatch"), ((rb > 0) & (rd == 0), "dense_false_positive"),
        ((F.size(r) > 0) & (fused < best), "fusion_regression"), ((F.size(r) > 0) & (fused > best), "fusion_improvement"),
    )


def reranker_labels(relevance: Column) -> Column:
    """From the columns before and after: nothing to rerank, no candidate, better or worse by nDCG@5 or reciprocal rank."""
    before, after = _list("before"), _list("after")
    n0, n1, m0, m1 = ndcg_at(before, relevance, 5), ndcg_at(after, relevance, 5), reciprocal_rank(before, relevance), reciprocal_rank(after, relevance)
    missing, better, worse = ~F.arrays_overlap(relevant(relevance), before), (n1 > n0) | (m1 > m0), (n1 < n0) | (m1 < m0)
    labels = F.when(missing, F.array(F.lit("candidate_missing_before_rerank"))).when(better, F.array(F.lit("reranker_improvement"))).when(worse, F.array(F.lit("reranker_regression"))).otherwise(_none())
    return F.when((F.size(before) == 0) & (F.size(after) == 0), _none()).otherwise(labels)


def answer_labels(answerable: Column) -> Column:
    """From the column rag, the answers of one or two variants in order."""

    def one(v: Column) -> Column:
        cited, context, invalid = (F.coalesce(v[n], _none()) for n in ("citations", "context", "invalid"))
        abstained, yes, no = F.coalesce(v["abstained"], F.lit(False)), F.coalesce(answerable, F.lit(False)), F.coalesce(~answerable, F.lit(False))
        return _labelled(
            ((F.size(invalid) > 0) | (F.size(F.array_except(cited, context)) > 0), "citation_invalid_id"), (yes & ~abstained & (F.size(cited) == 0), "citation_missing"),
            (no & ~abstained, "no_answer_false_positive"), (yes & abstained & (F.size(context) > 0), "false_abstention"), (no & abstained, "correct_abstention"),
        )

    return F.flatten(F.transform(F.coalesce("rag", F.array().cast(f"array<{VARIANT}>")), one))


def stage_of(label: Column) -> Column:
    """The stage of a label."""
    out = F.lit(None).cast("string")
    for stage, some in reversed(STAGES):
        out = F.when(label.isin(*some), F.lit(stage)).otherwise(out)
    return out


def stages_of(labels: Column) -> Column:
    """The distinct stages of labels, in the pipeline's order."""
    held = F.transform(labels, stage_of)
    return F.filter(F.array(*[F.lit(s) for s, _ in STAGES]), lambda s: F.array_contains(held, s))


def analyze(cases: DataFrame) -> DataFrame:
    """cases (CASE) -> case_id, labels in the order they are found, stages, first (the earliest label that is a failure, or else the
    first). Of cases with one id the first by the order of all columns is taken."""
    ordered = cases.select("case_id", F.struct(*[c for c in cases.columns if c != "case_id"]).alias("row")).groupBy("case_id").agg(F.min_by("row", F.to_json("row")).alias("row"))
    rows = ordered.select("case_id", "row.*")
    grades = F.coalesce("relevance", F.create_map().cast("map<string,int>"))
    judged = F.size(grades) > 0
    uncertain = F.when(F.coalesce(F.col("answerable"), F.lit(True)), F.array(F.lit("annotation_uncertain"))).otherwise(_none())
    seen = F.filter(_list("signals"), lambda s: s.isin(*LABELS))
    labels = F.array_distinct(F.concat(F.when(judged, F.concat(retrieval_labels(grades), reranker_labels(grades))).otherwise(uncertain), answer_labels(F.col("answerable")), seen))
    out = rows.select("case_id", labels.alias("labels"))
    failures = F.filter("labels", lambda x: ~x.isin(*SIGNALS))
    first = F.coalesce(F.try_element_at(failures, F.lit(1)), F.try_element_at(F.col("labels"), F.lit(1)))
    return out.withColumn("stages", stages_of(F.col("labels"))).withColumn("first", first).withColumn("first_stage", stage_of(F.col("first")))


def label_counts(analyzed: DataFrame) -> DataFrame:
    """(kind, name, n): every label and every stage, zeros too."""
    spark = analyzed.sparkSession
    known = name_table(spark, {"label": LABELS, "stage": tuple(s for s, _ in STAGES)})
    each = analyzed.select(F.explode(F.concat(F.transform("labels", lambda x: F.struct(F.lit("label").alias("kind"), x.alias("name"))), F.transform("stages", lambda x: F.struct(F.lit("stage").alias("kind"), x.alias("name"))))).alias("x"))
    n = each.groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"))
    return known.join(n, ["kind", "name"], "left").select("kind", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def name_table(spark: SparkSession, names: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', '{n}')" for k, some in names.items() for n in some) + " AS t(kind, name)")


def not_observed(analyzed: DataFrame) -> DataFrame:
    """Tracked labels that no case has, with their place in the list."""
    spark = analyzed.sparkSession
    tracked = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(TRACKED)) + " AS t(place, label)")
    return tracked.join(analyzed.select(F.explode("labels").alias("label")).distinct(), "label", "left_anti")


def variant_changes(pairs: DataFrame) -> DataFrame:
    """case_id, baseline and reranked (answer, citations, abstained, context) -> what differs; two missing values do not."""
    differ = lambda n: (~F.col(f"baseline.{n}").eqNullSafe(F.col(f"reranked.{n}"))).alias(f"{n}_changed")
    return pairs.select("case_id", *[differ(n) for n in ("answer", "citations", "abstained", "context")])


def variant_summary(records: DataFrame) -> DataFrame:
    """records: variant, ranked (ids), relevance (map), total_ms, generation_ms, reranker_ms, total_tokens, abstained, n_invalid.

    Means of reciprocal rank and nDCG@5 are over the records with a relevance, of latencies over all; a reranker that did not run
    took no time.
    """
    top = F.slice("ranked", 1, 5)
    held = F.coalesce(F.size("relevance") > 0, F.lit(False))
    rows = records.withColumns({"mrr": F.when(held, reciprocal_rank(top, F.col("relevance"))), "ndcg": F.when(held, ndcg_at(top, F.col("relevance"), 5))})
    return rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("queries"), F.count("mrr").alias("judged"), F.coalesce(F.avg("mrr"), F.lit(0.0)).alias("mean_mrr"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("mean_ndcg_5"),
        F.avg("total_ms").alias("mean_total_ms"), F.avg("generation_ms").alias("mean_generation_ms"), F.avg(F.coalesce("reranker_ms", F.lit(0.0))).alias("mean_reranker_ms"),
        F.sum("total_tokens").alias("total_tokens"), F.count_if("abstained").alias("abstentions"), F.sum("n_invalid").alias("invalid_citations"),
    )
