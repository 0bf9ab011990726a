"""Stored vectors of chunks: only chunks that are new or whose text has changed are embedded again.

A table holds the vectors of one model and way of normalizing, found by the hash of both. It is a base and the parts added since,
published as versions; of a chunk the newest row counts. A row is good for a chunk if it has the hash of the chunk's text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.guards import must
from . import versions
from .storage import broadcast_if_small, latest, materialize

ROW = "id string, content_hash string, vector array<float>, built bigint"


def root_of(folder: str, model: str, *, normalized: bool = True) -> str:
    """The table's folder: a hash of what its vectors depend on."""
    key = json.dumps({"format_version": 1, "model_name": model, "normalized": normalized}, sort_keys=True, separators=(",", ":"))
    return f"{folder}/{hashlib.sha256(key.encode()).hexdigest()[:24]}"


def held(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The newest row of every chunk. The base is read as it is but for the chunks that later parts name again."""
    parts = versions.folders(spark, root, version)
    if not parts:
        return spark.createDataFrame([], ROW)
    base = spark.read.schema(ROW).parquet(parts[0])
    if len(parts) == 1:
        return base
    added = latest(spark.read.schema(ROW).parquet(*parts[1:]), ["id"], [F.desc("built")])
    return base.join(broadcast_if_small(added.select("id")), "id", "left_anti").unionByName(added)


def refresh(chunks: DataFrame, folder: str, *, model: str, embed: Callable[[Column], Column], dimension: int, normalized: bool = True, most_parts: int = 8) -> DataFrame:
    """chunks (id, title, text) -> (id, content_hash, vector, built) of each, built being the version that embedded it.

    The text embedded is title, line feed, text, and its hash decides. Vectors of another length than `dimension`, with components
    that are null or not finite, or of length 0 fail the job with the chunk's id; so does an id that comes twice. Parts are merged
    into a new base when there are `most_parts`. Another refresh at the same time: ConcurrentPublish.
    """
    spark, root = chunks.sparkSession, root_of(folder, model, normalized=normalized)
    version = versions.latest_version(spark, root)
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    wanted = chunks.select(F.col("id").cast("string").alias("id"), whole.alias("whole")).withColumn("content_hash", F.sha2("whole", 256))
    have = held(spark, root, version)
    missing = wanted.join(have.where(F.size("vector") == dimension).select("id", "content_hash"), ["id", "content_hash"], "left_anti")
    built = materialize(missing.select("id", "content_hash", embed(F.col("whole")).alias("vector")), "embedded")  # each once, whatever follows
    sound = V.valid(F.col("vector")) & (F.size("vector") == dimension) & (V.norm(F.col("vector")) > 0)
    built = must(built, sound, F.concat(F.lit("no usable vector for chunk "), F.col("id")))
    built = must(built.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id"))), F.col("n") == 1, F.concat(F.lit("chunk id comes twice: "), F.col("id")))
    vector = V.normalize(F.col("vector")) if normalized else F.col("vector")
    rows = built.select("id", "content_hash", vector.cast("array<float>").alias("vector"), F.lit(version + 1).cast("bigint").alias("built"))
    full = len(versions.folders(spark, root, version)) >= most_parts
    rows = have.join(rows.select("id"), "id", "left_anti").unionByName(rows) if full else rows
    version = versions.publish(rows, root, after=version, add=not full)
    return wanted.select("id", "content_hash").join(held(spark, root, version), ["id", "content_hash"])

