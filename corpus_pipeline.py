"""Corpus pipeline: documents to token ids, each stage one of the operators of corvane.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage's result
must be written before the next stage is called, which deletes the tables that the result was read from.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, minhash, mixing, quality_rules, token_store
from corvane.llm.common import broadcast_if_small, discard, materialize, recorded, table
from corvane.llm.queries import VOCABULARY_FILE


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before: list[tuple[SparkSession, str]] = []


def _stage(stage: Stage) -> Stage:
    """A stage that first deletes the scratch tables of the stage called before it: that one's result has been written by then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(_before)
        with recorded() as tables:
            out = stage(spark, docs, sf_dir)
        _before.extend(tables)
        return out

    return run


def _row(docs: DataFrame) -> Column:
    """All columns as one, whatever their names hold."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return F.struct(*quoted).alias("row")


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go. Rows are judged each, whatever their ids, over their whole
    texts, however long; columns of any names, dots included, are kept. Empty table: no rows."""
    rows = docs.select(_row(docs), "text", "lang", "source")
    return quality_rules.judge(rows).where("qr_kept").select("row.*")


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the one of smallest id.

    Each row is known by its id and a hash of its text: texts that share an id are compared each, and rows without an id too (the
    last to be kept). Of rows that repeat both, the one whose columns come first as JSON stays. Rows without any word are linked
    with nothing and stay. Texts are compared whole, however long. Columns may have any names, dots included. Empty table: no rows.
    """
    key = F.struct(F.col("row.doc_id").isNull().alias("n"), F.col("row.doc_id").alias("d"), F.xxhash64("row.text").alias("h"))
    rows = docs.select(_row(docs)).withColumn("key", key)
    found = minhash.near_duplicates(rows.select("key", F.col("row.text").alias("text")), hundredths=80, id_col="key")
    kept = materialize(found.where("kept").groupBy(F.col("doc").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_shingles").alias("n_shingles")), "kept")
    repeated = kept.where("n_rows > 1 AND n_shingles > 0").select("key")
    out = rows.join(kept.select("key"), "key", "left_semi")
    if repeated.limit(1).count():
        repeated = broadcast_if_small(repeated)
        many = out.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.join(repeated, "key", "left_anti").unionByName(many)
    return out.select("row.*")


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, whatever their ids; null and empty texts stay, and long texts
    are read whole. Columns may have any names, dots included. Empty table: no rows."""
    hit = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.struct(F.col("doc").alias("d"), F.col("mark").alias("h")).alias("key")).distinct()
    rows = docs.select(_row(docs)).withColumn("key", F.struct(F.col("row.doc_id").alias("d"), F.xxhash64("row.text").alias("h")))
    return rows.join(broadcast_if_small(materialize(hit, "hit")), "key", "left_anti").select("row.*")


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target asks for. A null source is a source of its own, rows without a word
    have size 0, repeated rows and ids count each, long texts at their whole size. Columns may have any names, dots included. Empty
    table: no rows."""
    rows = docs.select(_row(docs), "doc_id", "text", "source")
    return mixing.emit(mixing.mix(rows)).select("row.*")


@_stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks of the mix, and each written document's place and digest as read back from them. Null texts are empty; null
    ids come first; every row is a document of its own, encoded whole, however long. Other columns are not read. Empty
    table: no rows."""
    import public_tokenizers

    return token_store.read_blocks(token_store.write_blocks(docs, vocabulary_path=public_tokenizers.path(VOCABULARY_FILE)))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: The tokenizer and the block coder have no SQL; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with recorded() as own:
            docs = materialize(out, f"stage_{name}")
        discard(old)  # a stage's input is not needed once its result is written
        old = own
    return STAGES[-1][1](spark, docs, sf_dir)
