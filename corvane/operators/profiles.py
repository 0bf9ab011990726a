"""Whole evaluation profiles and index flows, put together from the operators: build, split, reindex, status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..sources.storage import broadcast_if_small, materialize, verify_manifest
from . import chunk, corpus, evaluate, ingest
from .guards import must, unique


@dataclass
class Profile:
    """A retrieval profile: documents, the queries judged on them, their judgments, and one row that tells how it was made."""

    documents: DataFrame
    queries: DataFrame
    qrels: DataFrame
    manifest: DataFrame


def build(documents: DataFrame, queries: DataFrame, qrels: DataFrame, *, n_documents: int, n_queries: int | None = None, seed: str, complete: bool = False) -> Profile:
    """documents (document_id), queries (query_id, text), qrels (query_id, document_id, relevance) -> a profile of them.

    Judgments count if they are positive and both sides are known; queries without one, or without text, are not taken. The queries
    are all, or the first n_queries in the order of a seeded hash; every document judged for one of them is kept, and others in
    hash order up to n_documents. complete: all judgments of known queries must be in the profile, else the job fails.
    """
    asked = queries.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    known = materialize(corpus.filter_qrels(qrels, asked, documents), "known_qrels")
    judged = asked.join(known.select("query_id").distinct(), "query_id", "left_semi")
    chosen = judged if n_queries is None else corpus.hash_sample(judged, seed=f"{seed}-queries", n=n_queries, id_col="query_id").drop("sample_rank")
    chosen = materialize(chosen, "profile_queries")
    wanted = known.join(broadcast_if_small(chosen.select("query_id")), "query_id", "left_semi")
    kept = materialize(corpus.required_sample(documents, wanted.select("document_id"), seed=f"{seed}-documents", n=n_documents, id_col="document_id"), "profile_documents")
    rows = corpus.filter_qrels(known, chosen, kept)
    if complete:
        held = known.join(kept.select("document_id", F.lit(True).alias("held")), "document_id", "left")
        rows = must(held, F.col("held"), F.concat(F.lit("the profile loses a judged document: "), F.col("document_id").cast("string"))).drop("held")
    rows = materialize(rows, "profile_qrels")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    manifest = one(kept, "documents").crossJoin(one(chosen, "queries")).crossJoin(one(rows, "qrels")).crossJoin(one(documents, "source_documents")).crossJoin(one(known, "source_positive_qrels"))
    return Profile(kept, chosen, rows, manifest.withColumn("seed", F.lit(seed)).withColumn("qrels_complete", F.col("qrels") == F.col("source_positive_qrels")))


def split(rows: DataFrame, *, seed: str, validation: int, id_col: str) -> DataFrame:
    """Rows with split: the first `validation` in the order of a seeded hash, and the rest as train. The same in every run."""
    first = corpus.hash_sample(rows.select(id_col).distinct(), seed=seed, n=validation, id_col=id_col).select(id_col, F.lit("validation").alias("split"))
    return rows.join(broadcast_if_small(first), id_col, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def reindex(documents: DataFrame, chunks: DataFrame, texts: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents cut anew with other parameters: (documents, chunks, outcomes).

    documents: document_id, corpus_namespace, status, chunk_size, chunk_overlap. texts: document_id, text (what was uploaded). asked:
    document_id, chunk_size, chunk_overlap (null: as they are). outcomes: document_id, error, duplicate. Refused are documents that
    are not there, read-only ones, ones without their upload, parameters out of bounds and texts that give no chunk: these stay as
    they are. A completed document whose parameters do not change is a duplicate and stays too.
    """
    have = documents.select("document_id", "corpus_namespace", "status", F.col("chunk_size").alias("old_size"), F.col("chunk_overlap").alias("old_overlap"), F.lit(True).alias("there"))
    rows = asked.select("document_id", "chunk_size", "chunk_overlap").dropDuplicates(["document_id"]).join(have, "document_id", "left").join(texts, "document_id", "left")
    rows = rows.withColumns({"chunk_size": F.coalesce("chunk_size", "old_size"), "chunk_overlap": F.coalesce("chunk_overlap", "old_overlap")})
    size, overlap = F.col("chunk_size"), F.col("chunk_overlap")
    same = (F.col("status") == "completed") & (size == F.col("old_size")) & (overlap == F.col("old_overlap"))
    error = (
        F.when(F.col("there").isNull(), "document_not_found").when(F.col("corpus_namespace") != ingest.OWN, "read_only_corpus").when(F.col("text").isNull(), "stored_file_missing")
        .when(~size.between(200, 4000), "invalid_chunk_size").when(~overlap.between(0, 1000) | (overlap >= size), "invalid_chunk_overlap").when(F.trim("text") == "", "no_chunks")
    )
    rows = materialize(rows.select("document_id", "chunk_size", "chunk_overlap", "text", error.alias("error"), (error.isNull() & F.coalesce(same, F.lit(False))).alias("duplicate")), "reindex")
    todo = rows.where("error IS NULL AND NOT duplicate")
    fresh = None
    for pair in todo.select("chunk_size", "chunk_overlap").distinct().collect():  # the settings in use, a handful
        part = todo.where((size == pair["chunk_size"]) & (overlap == pair["chunk_overlap"]))
        cut = chunk.chunks(part, size=pair["chunk_size"], overlap=pair["chunk_overlap"], id_col="document_id").withColumnRenamed("doc", "document_id")
        fresh = cut if fresh is None else fresh.unionByName(cut)
    changed = todo.select("document_id", F.col("chunk_size").alias("new_size"), F.col("chunk_overlap").alias("new_overlap"))
    out = documents.join(changed, "document_id", "left").withColumns({"status": F.when(F.col("new_size").isNotNull(), "completed").otherwise(F.col("status")), "chunk_size": F.coalesce("new_size", "chunk_size"), "chunk_overlap": F.coalesce("new_overlap", "chunk_overlap")}).drop("new_size", "new_overlap")
    if fresh is None:
        return out, chunks, rows.select("document_id", "error", "duplicate")
    fresh = fresh.select("document_id", "chunk_index", I.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "text")
    return out, ingest.replace_children(chunks.select("document_id", "chunk_index", "chunk_id", "text"), fresh, "document_id"), rows.select("document_id", "error", "duplicate")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table."""
    out = None
    for name, df in tables.items():
        own = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def index_status(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, *, version: int, model: str, dimension: int) -> DataFrame:
    """One row on an index: version, documents and chunks in it, and whether words and vectors are ready (each chunk has its own)."""
    counted = documents.agg(F.count(F.lit(1)).alias("documents")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))
    sound = chunks.select("chunk_id").join(vectors.where(F.size("vector") == dimension).select("chunk_id").distinct(), "chunk_id").agg(F.count(F.lit(1)).alias("held"))
    row = counted.crossJoin(sound).withColumn("bm25_ready", F.col("chunks") > 0).withColumn("dense_ready", (F.col("chunks") > 0) & (F.col("held") == F.col("chunks")))
    return row.select(F.lit(version).alias("current_version"), "documents", "chunks", "bm25_ready", "dense_ready", F.lit(model).alias("embedding_model"), F.lit(dimension).alias("embedding_dimension"))


def share(hit: Column, among: Column) -> Column:
    """The share of rows that hit among those counted; null where none is."""
    n = F.count_if(among)
    return F.when(n > 0, F.count_if(hit & among) / n)


def format_rates(predictions: DataFrame, by: list[str]) -> DataFrame:
    """predictions (format_valid, expected_answer, answer_exact, hit_token_limit, latency_seconds, generated_tokens) -> rates by `by`.

    Exactness is of rows that have an expected answer: null where none has.
    """
    every, scored = F.lit(True), F.coalesce(F.col("expected_answer"), F.lit("")) != ""
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("format_valid").alias("format_valid"), share(F.col("format_valid"), every).alias("format_valid_rate"), F.count_if(scored).alias("answer_scored_cases"),
        F.count_if(scored & F.col("answer_exact")).alias("answer_exact"), share(F.col("answer_exact"), scored).alias("answer_exact_rate"), F.count_if("hit_token_limit").alias("token_limit_failures"),
        share(F.col("hit_token_limit"), every).alias("token_limit_failure_rate"), F.avg("latency_seconds").alias("mean_latency_seconds"), F.avg("generated_tokens").alias("mean_generated_tokens"),
    )


def last_label_counts(assessments: DataFrame, *, case: list[str], order: str, label: str, by: list[str]) -> DataFrame:
    """(by, label, n): how many cases end with each label; cases without an assessment count nowhere."""
    last = assessments.where(F.col(label).isNotNull()).groupBy(*dict.fromkeys([*by, *case])).agg(F.max_by(label, order).alias(label))
    return last.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def run_metrics(calls: DataFrame, *, run: str, status: str, question: str) -> DataFrame:
    """Tool calls by run: succeeded, failed, and how often a question was asked again."""
    again = calls.groupBy(run, question).agg(F.count(F.lit(1)).alias("n")).groupBy(run).agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("repeated_queries"))
    done = calls.groupBy(run).agg(F.count_if(F.col(status) == "succeeded").alias("successful_tool_calls"), F.count_if(F.coalesce(F.col(status) != "succeeded", F.lit(True))).alias("failed_tool_calls"))
    return done.join(again, run)


def side_by_side(plain: DataFrame, grounded: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query, plain, grounded): both answers to each query as structs, null where one is missing."""
    packed = lambda df, name: df.select("query_id", F.struct(*[c for c in df.columns if c != "query_id"]).alias(name))
    return queries.select("query_id", F.col("text").alias("query")).join(packed(plain, "plain"), "query_id", "left").join(packed(grounded, "grounded"), "query_id", "left")


def compact(rankings: DataFrame, *, keys: list[str], top: int = 5) -> DataFrame:
    """keys, and of a reranking (before, after: ids in order; relevant: map of id to rank) what a reader sees: the first ids of each,
    and the rank changes of these alone."""
    cut = lambda c: F.slice(c, 1, top)
    place = lambda a, x: F.array_position(a, x)
    seen = F.array_union(cut("before"), cut("after"))
    changes = F.map_from_entries(F.transform(F.filter(seen, lambda x: (place(F.col("before"), x) > 0) & (place(F.col("after"), x) > 0)), lambda x: F.struct(x, (place(F.col("before"), x) - place(F.col("after"), x)).cast("int"))))
    return rankings.withColumn("rank_changes", changes).select(*keys, cut("before").alias("before"), cut("after").alias("after"), "rank_changes")


@dataclass
class FrozenRun:
    """An evaluation on frozen cases: what it was run on, metrics by mode, every answer's result, and the answers that failed."""

    config: DataFrame
    metrics: DataFrame
    predictions: DataFrame
    failures: DataFrame


def frozen_run(found: DataFrame, expected: DataFrame, cases: DataFrame, gold: DataFrame, answers: DataFrame, *, dataset: str) -> FrozenRun:
    """Evaluate answers on cases whose files (manifests: path, sha256) are those that were frozen; any other file is an error.

    Modes must be those of the answers, one answer a case and mode: an answer that comes twice fails the job with its case.
    """
    problems = verify_manifest(found, expected).limit(5).collect()
    if problems:
        raise ValueError("frozen evaluation data changed: " + ", ".join(f"{r['path']} {r['problem']}" for r in problems))
    once = unique(answers, ["case_id", "mode"], what="answer")
    predictions = materialize(evaluate.evaluate_claims(cases, gold, once), "frozen_predictions")
    hashes = found.agg(F.array_join(F.array_sort(F.collect_list("sha256")), "").alias("h")).select(F.sha2("h", 256).alias("dataset_sha256"))
    counts = cases.agg(F.count(F.lit(1)).alias("cases")).crossJoin(predictions.agg(F.array_sort(F.collect_set("mode")).alias("modes")))
    config = hashes.crossJoin(counts).select(F.lit(dataset).alias("dataset_id"), "dataset_sha256", "cases", "modes", F.lit(False).alias("test_used_for_tuning"))
    failed = predictions.where(F.size("failures") > 0).select("case_id", "mode", F.col("failures").alias("failure_types"))
    return FrozenRun(config, evaluate.mode_summary(predictions), predictions, failed)
