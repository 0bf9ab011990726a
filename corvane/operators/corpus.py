"""Corpus preparation and audit: profile in one pass, exact and near duplicates, sampling, qrels filters, integrity checks."""

from __future__ import annotations

import hashlib
import itertools
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from ..functions import ids as I
from ..functions import text as T
from ..sources.storage import broadcast_if_small, materialize

SHORT, LONG = 200, 4000
DISTANCE, KEYED = 3, 3


def profile(docs: DataFrame, text: Column, *, document: Column | None = None, chunk: Column | None = None, title: Column | None = None, source: Column | None = None) -> DataFrame:
    """One row of counts and length statistics; one scan. Titles, sources and ids are counted where they are given."""
    n, blank = F.length(text), lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    extra = []
    if document is not None:
        extra.append(F.count_distinct(document).alias("unique_documents"))
    if chunk is not None:
        extra.append(F.count_distinct(chunk).alias("unique_chunks"))
    if title is not None:
        extra.append(F.count_if(blank(title)).alias("missing_title"))
    if source is not None:
        extra += [F.count_if(blank(source)).alias("missing_source"), F.count_if(~T.valid_http_url(F.coalesce(source, F.lit("")))).alias("invalid_url")]
    return docs.agg(
        F.count(F.lit(1)).alias("documents"), *extra, F.count_if(blank(text)).alias("empty"), F.count_if(n < SHORT).alias("too_short"), F.count_if(n > LONG).alias("too_long"),
        F.count_if(T.mojibake(text)).alias("mojibake"), F.count_if(T.html_residue(text)).alias("html_residue"),
        F.avg(n).alias("chars_avg"), F.min(n).alias("chars_min"), F.max(n).alias("chars_max"),
    )


def length_percentiles(docs: DataFrame, text: Column, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Exact percentiles with linear interpolation (their state is one count per distinct length)."""
    return docs.agg(*[F.percentile(F.length(text), p).alias(f"p{round(p * 100)}") for p in shares])


def distributions(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) for several columns from one scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return docs.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def repeated(docs: DataFrame, digest: Column) -> DataFrame:
    """How many rows exact deduplication would remove."""
    return docs.groupBy(digest.alias("h")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("long").alias("duplicates"))


def exact_dedup(docs: DataFrame, *, id_col: str, digest: Column) -> tuple[DataFrame, DataFrame]:
    """(survivors with n_duplicates, map original -> canonical). The smallest id of equal contents survives.

    By aggregation, so a content that is repeated a million times meets in one small state and not in one task's rows.
    """
    rows = docs.select(F.col(id_col).alias("original"), digest.alias("digest"))
    first = rows.groupBy("digest").agg(F.min("original").alias("canonical"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))
    return first, rows.join(first.select("digest", "canonical"), "digest").select("original", "canonical")


#: Features of a SimHash: pairs of neighbouring words joined by this, or the only word.
JOINER = "\0"


@pandas_udf(LongType())
def simhash64(text: pd.Series) -> pd.Series:
    """64-bit SimHash of a normalized text over blake2b hashes of its features, as a signed number; no feature: all bits set."""

    def one(t: str | None) -> int:
        words = re.findall("[A-Za-z0-9]+", (t or "").lower())
        features = [JOINER.join(p) for p in itertools.pairwise(words)] if len(words) > 1 else words
        if not features:
            return -1
        raw = np.frombuffer(b"".join(hashlib.blake2b(f.encode(), digest_size=8).digest() for f in features), dtype=np.uint8)
        ones = np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0)
        return int.from_bytes(np.packbits(2 * ones >= len(features)).tobytes(), "big", signed=True)

    return text.map(one)


def simhash_blake(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, hi, lo) by `simhash64`, over texts in compatible form with white space squeezed: the halves as unsigned numbers."""
    h = docs.select(F.col(id_col).alias("id"), simhash64(T.normalize_corpus(F.col(text_col))).alias("h"))
    return h.select("id", F.shiftrightunsigned("h", 32).alias("hi"), F.col("h").bitwiseAND(0xFFFFFFFF).alias("lo"))


def simhash(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, hi, lo): the same print over md5 instead of blake2b, in built-in functions and like in any engine.

    Per bit, the features whose hash has it are counted, two bits to a sum: 32 columns in one partial aggregation.
    """
    words = docs.select(F.col(id_col).alias("id"), F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower).alias("w"))
    n = F.size("w")
    pairs = F.zip_with(F.slice("w", 1, F.greatest(n - 1, F.lit(0))), F.slice("w", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(JOINER), b))
    feature = words.select("id", F.explode_outer(F.when(n > 1, pairs).otherwise(F.col("w"))).alias("f"))
    hi, lo = I.hash_halves(F.col("f"))
    hashed = feature.select("id", hi.alias("h"), lo.alias("l"))
    # bit k in the lower, bit k + 16 in the upper half of a sum: 2^31 features fit
    both = lambda c, k: F.sum(F.shiftright(c, k).bitwiseAND(1) + F.shiftleft(F.shiftright(c, k + 16).bitwiseAND(1), 32))
    sums = hashed.groupBy("id").agg(F.count("h").alias("n"), *[both(c, k).alias(f"{c}{k}") for c in "hl" for k in range(16)])

    def half(c: str) -> Column:
        bits = []
        for k in range(16):
            total = F.coalesce(f"{c}{k}", F.lit(0).cast("long"))
            bits += [(total.bitwiseAND(0xFFFFFFFF), 1 << k), (F.shiftrightunsigned(total, 32), 1 << (k + 16))]
        return reduce(lambda a, x: a + F.when(2 * x[0] >= F.col("n"), F.lit(x[1])).otherwise(F.lit(0)), bits, F.lit(0).cast("long"))

    return sums.select("id", half("h").alias("hi"), half("l").alias("lo"))


def _nodes(prints: DataFrame) -> DataFrame:
    """(id, n, h): each print once, with its smallest id and how many documents have it."""
    return prints.groupBy("hi", "lo").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "n", F.shiftleft("hi", 32).bitwiseOR(F.col("lo")).alias("h"))


def near_pairs(prints: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """(a, b, distance) of prints at most `distance` bits apart, a < b, equal prints through their smallest id only.

    Documents with one print are one node; `near_links` gives the others too.
    """
    return _near_nodes(_nodes(prints), distance).select("a", "b", "distance")


def _near_nodes(nodes: DataFrame, distance: int) -> DataFrame:
    """(a, b, na, nb, distance) of `_nodes` at most `distance` bits apart, a < b, with the documents of each.

    The 64 bits are cut into distance + 3 blocks. Two such prints differ in `distance` blocks at most, so they agree in three; each
    print is keyed by every three of its blocks, some 32 bits at distance 3, and a pair is taken at the first three blocks that it
    agrees in, once.
    """
    blocks = distance + KEYED
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in itertools.pairwise(edges)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keys = []
    for chosen in itertools.combinations(range(blocks), KEYED):
        mask = signed(sum(masks[k] for k in chosen))
        earlier = [F.lit(signed(masks[k])) for k in range(chosen[-1]) if k not in chosen]
        keys.append(F.struct(F.lit(mask).alias("mask"), F.col("h").bitwiseAND(F.lit(mask)).alias("key"), F.array(*earlier).cast("array<bigint>").alias("earlier")))
    keyed = nodes.select("id", "n", "h", F.explode(F.array(*keys)).alias("x")).select("id", "n", "h", "x.mask", "x.key", "x.earlier")
    a, b = keyed.alias("a"), keyed.select("id", "n", "h", "mask", "key").alias("b")
    differing = F.col("a.h").bitwiseXOR(F.col("b.h"))
    # each print stands here twenty times, which the planner's estimate leaves out: without the hint it would broadcast them all
    hit = a.join(b.hint("merge"), (F.col("a.mask") == F.col("b.mask")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.bit_count(differing) <= distance))
    first = F.forall("a.earlier", lambda m: differing.bitwiseAND(m) != 0)  # an earlier block that agrees too would have met them before
    return hit.where(first).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.bit_count(differing).alias("distance"))


def near_links(prints: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """near_pairs, and (smallest id, id, 0) for every other id of equal prints.

    A star and not all pairs, so a print of a million documents gives a million rows. The distance of any two documents is that
    of their smallest ids.
    """
    first = prints.groupBy("hi", "lo").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = prints.join(first, ["hi", "lo"]).where(F.col("id") > F.col("a")).select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    return near_pairs(prints, distance=distance).unionByName(star)


def near_pair_count(prints: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """(pairs): how many pairs of documents are at most `distance` bits apart, equal prints included, without making them all: a pair
    of prints stands for the product of its documents, n equal ones for n * (n - 1) / 2."""
    nodes = _nodes(prints)  # their counts go with the keys: joined to the pairs afterwards, all nodes would be broadcast
    parts = _near_nodes(nodes, distance).select((F.col("na") * F.col("nb")).alias("p")).unionByName(nodes.select(F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("p")))
    return parts.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pairs"))


def audit(chunks: DataFrame, *, source_records: int, removed: int, text_col: str = "text", fields: dict[str, str]) -> DataFrame:
    """The audit of a corpus as one row: counts, lengths, distributions (maps of value to count) and what is wrong.

    chunks: document_id, chunk_id, content_hash, title, source and the text. source_records and removed tell how many records there
    were and how many exact duplicates went. fields: names of distributions and their columns. One scan counts and measures, one
    counts the distributions, one makes the prints of near-duplicates.
    """
    text = F.col(text_col)
    row = profile(chunks, text, document=F.col("document_id"), chunk=F.col("chunk_id"), title=F.col("title"), source=F.col("source")).withColumnsRenamed({"documents": "chunks", "unique_documents": "documents", "unique_chunks": "unique_chunk_ids"})
    row = row.withColumn("chars_avg", F.round("chars_avg", 2))
    row = row.crossJoin(length_percentiles(chunks, text)).crossJoin(repeated(chunks, F.col("content_hash")).withColumnRenamed("duplicates", "duplicate_text_after_dedup"))
    prints = materialize(simhash(chunks.withColumn("id", F.col("chunk_id")), id_col="id", text_col=text_col), "prints")
    row = row.crossJoin(near_pair_count(prints).withColumnRenamed("pairs", "near_duplicate_pairs"))
    named = chunks.select(*[F.col(c).alias(n) for n, c in fields.items()])
    counted = distributions(named, list(fields)).groupBy().pivot("field", list(fields)).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("value", F.lit("")).alias("value"), "n"))))
    maps = counted.select(*[F.map_from_entries(F.coalesce(F.col(n), F.array().cast("array<struct<value:string,n:bigint>>"))).alias(f"{n}_distribution") for n in fields])
    return row.crossJoin(maps).withColumns({"source_records": F.lit(source_records), "exact_duplicates_removed": F.lit(removed), "too_short_threshold": F.lit(SHORT), "too_long_threshold": F.lit(LONG)})


def hash_sample(df: DataFrame, *, seed: str, n: int, id_col: str, by: str | None = None) -> DataFrame:
    """The first n rows (of each `by`) in the order of a seeded hash: the same rows in every run and engine.

    Ranks are cut per partition before the shuffle (window group limit), so no group is gathered.
    """
    key = I.selection_key(seed, F.col(id_col))
    groups = [by] if by else [F.lit(0)]
    return df.withColumn("__k", key).withColumn("sample_rank", F.row_number().over(Window.partitionBy(*groups).orderBy("__k", id_col))).where(F.col("sample_rank") <= n).drop("__k")


def required_sample(df: DataFrame, required: DataFrame, *, seed: str, n: int, id_col: str) -> DataFrame:
    """All required ids, filled up to n by hash order."""
    must = df.join(required.select(id_col).distinct(), id_col, "left_semi")
    rest = df.join(required.select(id_col).distinct(), id_col, "left_anti")
    room = max(0, n - must.count())
    return must.unionByName(hash_sample(rest, seed=seed, n=room, id_col=id_col).drop("sample_rank"))


def filter_qrels(qrels: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Positive judgments whose query and document are both known."""
    return qrels.where("relevance > 0").join(queries.select("query_id").distinct(), "query_id", "left_semi").join(documents.select("document_id").distinct(), "document_id", "left_semi")


def integrity(qrels: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(check, violations): unknown queries, unknown documents, queries without a judgment, repeated ids."""
    judged = qrels.select("query_id").distinct()
    checks = {
        "unknown_query": judged.join(queries, "query_id", "left_anti"),
        "unknown_document": qrels.select("document_id").distinct().join(documents, "document_id", "left_anti"),
        "unjudged_query": queries.select("query_id").distinct().join(judged, "query_id", "left_anti"),
        "repeated_query": queries.groupBy("query_id").count().where("count > 1"),
        "repeated_document": documents.groupBy("document_id").count().where("count > 1"),
    }
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("violations")).withColumn("check", F.lit(k)) for k, d in checks.items()]).select("check", "violations")


def containment(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id): passages that occur word for word in a document's squeezed text.

    A passage is keyed by the word of it that is rarest in the documents, and by that word's place. Wherever a document has a
    key's word, the words around are compared with the passage's: one pass over the documents' words counts, one meets the keys.
    """
    clean = passages.select("item_id", T.squeeze(F.col("text")).alias("p")).where("p <> ''").select("item_id", F.split("p", " ").alias("p"))
    asked = materialize(clean.select("item_id", "p", F.posexplode("p").alias("at", "word")), "passage_words")
    words = docs.select("doc_id", F.split(T.squeeze(F.col("text")), " ").alias("w"))
    counts = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = asked.select("word").distinct()
    rare = asked.join(broadcast_if_small(counts.join(broadcast_if_small(known), "word", "left_semi")), "word")
    keys = rare.groupBy("item_id", "p").agg(F.count(F.lit(1)).alias("have"), F.min(F.struct("n", "at", "word")).alias("k")).where(F.col("have") == F.size("p"))
    keys = materialize(keys.select("item_id", "p", "k.at", "k.word"), "passage_keys")
    met = words.select("doc_id", "w", F.posexplode("w").alias("i", "word")).join(broadcast_if_small(keys), "word").where(F.col("i") >= F.col("at"))
    return met.where(F.slice("w", F.col("i") - F.col("at") + 1, F.size("p")) == F.col("p")).select("doc_id", "item_id").distinct()
