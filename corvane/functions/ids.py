"""Content-addressed ids and hash keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import canonical


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def document_id(namespace: Column, digest: Column) -> Column:
    return F.concat(F.lit("document-"), F.left(F.sha2(F.concat_ws(":", namespace, digest), 256), F.lit(24)))


def chunk_id(document: Column, index: Column, text: Column) -> Column:
    return F.concat(F.lit("chunk-"), F.left(F.sha2(F.concat_ws(":", document, index.cast("string"), text), 256), F.lit(24)))


def corpus_chunk_id(dataset: Column, original: Column) -> Column:
    slug = F.trim(F.regexp_replace(F.lower(dataset), "[^a-z0-9]+", "-"))
    return F.concat(slug, F.lit("-chunk-"), F.left(F.sha2(F.concat(dataset, F.char(F.lit(0)), original), 256), F.lit(20)))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(F.concat_ws("\x00", *parts), 256), F.lit(24)))


def selection_key(seed: str, *parts: Column) -> Column:
    """The key of hash-ordered sampling: the same order in any engine."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def hash_halves(text: Column) -> tuple[Column, Column]:
    """The first 64 bits of md5 as two unsigned 32-bit halves (bigint): no sign to handle, the same in other engines."""
    h = F.md5(text)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.substring(h, 9, 8), 16, 10).cast("long")


def combined_hash(parts: Column) -> Column:
    """Hash of an array of hashes, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(parts), ""), 256)


def cache_key(model: Column, corpus_hash: Column, normalized: Column) -> Column:
    """Key of a cache of vectors: the hash of its settings as JSON with sorted keys and without blanks."""
    text = F.concat(F.lit('{"corpus_hash":'), F.to_json(corpus_hash.cast("variant")), F.lit(',"format_version":1,"model_name":'), F.to_json(model.cast("variant")), F.lit(',"normalized":'), normalized.cast("string"), F.lit("}"))
    return F.left(F.sha2(text, 256), F.lit(24))


def random_id(prefix: str) -> Column:
    """A new id in every run; never part of a result that must repeat."""
    return F.concat(F.lit(f"{prefix}-"), F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(24)))


def trajectory_hash(messages: Column) -> Column:
    """The hash of a trajectory's messages (JSON text), whatever the order of the keys in them."""
    return F.sha2(canonical(messages), 256)
