"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, star components.

1. Each text's set of distinct word shingles is hashed to 64 bits; a set's fingerprint finds equal sets, and one
   representative of each goes on. Equal sets need no pairs.
2. `K` minima of multiply-add hashes form the signature. Bands of `ROWS` minima are bucket keys. The number of bands follows
   from the threshold, so that a pair at the threshold shares no bucket with a probability below `MISS`.
3. In each bucket, members are paired with the bucket's first member only. Pairs are verified on signatures (an allowance of
   `SIGMAS` standard deviations below the threshold) and then on the full sets.
4. Components of the confirmed links come from alternating large-star and small-star steps.
5. Buckets that hold several components after that are cut into blocks, and each pair of blocks is a task: it compares the
   members of different components by signature and full set, each pair in its first common bucket only, and returns links
   alone. The components are computed again: no link that could still join two components stays untested.

No bucket is gathered into a task: first members come from a partial aggregation, their pairs from joins that AQE can split,
and a large bucket is as many tasks as it has pairs of blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

WIDTH, ROWS, MISS, SIGMAS, BLOCK = 5, 5, 1e-7, 7.0, 512
_MASK = (1 << 64) - 1


def _constants(name: str, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return np.array([int.from_bytes(hashlib.blake2b(f"{name}:{i}".encode(), digest_size=8).digest(), "little") for i in range(n)], dtype=np.uint64)


_POSITION = _constants("position", 64) | np.uint64(1)
_PART = _constants("part", 4)
_SHORT = 24
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased; words are separated by ASCII white space.

    A word of up to 24 bytes is three numbers, mixed in turn with its length; longer words are hashed by blake2b.
    """
    data = text.encode("utf-8", "surrogatepass").lower()
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[1], blank.view(np.uint8), [1]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    size = end - start
    padded = data + bytes(_SHORT)
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    out = _mix(size.astype(np.uint64) + _PART[3])
    for k in range(3):
        left = np.clip(size - 8 * k, 0, 8)
        # a part that no word has changes nothing between words of this length
        if k == 0 or left.any():
            out = np.where(left > 0, _mix(out + ((eight[np.minimum(start + 8 * k, len(eight) - 1)] & _LOW[left]) ^ _PART[k])), out)
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; with fewer words, of the whole sequence; none without words."""
    words = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    if not len(words):
        return words
    k = min(width, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total += words[i : i + n] * _POSITION[i % 64]
    return np.unique(_mix(total))


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of a * x + b modulo 2^64 (the upper half kept), a few thousand shingles at a time."""
    low = np.full(len(a), _MASK, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        low = np.minimum(low, (a[:, None] * shingles[None, i : i + 2048] + b[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame, *, threshold: float, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, n_shingles, fingerprint, signature): mark is a hash of the text; the last two are null for documents without words."""
    k = band_count(threshold) * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _constants("a", k) | np.uint64(1), _constants("b", k)
        for batch in batches:
            size, mark, sig = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width)
                size.append(len(s))
                mark.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(_signature(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array(size, pa.int64()), pa.array(mark, pa.binary()), pa.array(sig, pa.binary())], names=["doc", "mark", "n_shingles", "fingerprint", "signature"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).withColumn("mark", F.xxhash64("text"))
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, mark bigint, n_shingles bigint, fingerprint binary, signature binary")


def _agree(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree as often as the threshold's do, less SIGMAS standard deviations; sizes must allow it."""
    k, least = band_count(threshold) * ROWS, _least(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.frombuffer(b"".join(batch["sa"]), dtype="<u4").reshape(len(batch), k)
                y = np.frombuffer(b"".join(batch["sb"]), dtype="<u4").reshape(len(batch), k)
                yield batch.loc[(x == y).sum(axis=1) >= least, ["a", "b"]]

    kind = reps.schema["doc"].dataType.simpleString()
    with_b = pairs.join(reps.select(F.col("doc").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb")), "b")
    both = with_b.join(reps.select(F.col("doc").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na")), "a")
    both = both.where(F.least("na", "nb") >= F.lit(threshold - 1e-9) * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInPandas(run, f"a {kind}, b {kind}")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc, s): the full shingle sets, as sorted 64-bit numbers. docs: doc, text; wanted: node, rep and mark (a row of docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(t, width).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["doc", "s"])

    rows = docs.withColumn("own", F.xxhash64("text"))
    found = rows.join(broadcast_if_small(wanted), (F.col("own") == F.col("mark")) & F.col("doc").eqNullSafe(F.col("rep"))).select("node", "text")
    return materialize(found.mapInArrow(run, "doc bigint, s binary").groupBy("doc").agg(F.max(F.struct(F.length("s"), "s")).alias("x")).select("doc", "x.s"), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """Pairs (a, b) for which 100 * intersection >= hundredths * union, on full sets."""
    kind = sets.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= hundredths * (len(x) + len(y) - both))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    with_b = pairs.join(sets.select(F.col("doc").alias("b"), F.col("s").alias("sb")), "b")
    return with_b.join(sets.select(F.col("doc").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb").mapInPandas(run, f"a {kind}, b {kind}")


def _least(threshold: float) -> int:
    """Minima that must agree: as many as at the threshold, less SIGMAS standard deviations."""
    k = band_count(threshold) * ROWS
    return math.floor(k * threshold - SIGMAS * math.sqrt(k * threshold * (1 - threshold)))


def _across(open_: DataFrame, reps: DataFrame, sets: DataFrame, hundredths: int, threshold: float) -> DataFrame:
    """Links (a, b) between documents of one bucket and different components. open_: key, band, doc, component."""
    kind, k, least = sets.schema["doc"].dataType.simpleString(), band_count(threshold) * ROWS, _least(threshold)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        band = group["band"].iloc[0]
        ids, part = group["doc"].to_numpy(), group["component"].to_numpy()
        sig = np.frombuffer(b"".join(group["signature"]), dtype="<u4").reshape(len(group), k)
        full = [np.frombuffer(x, dtype=np.uint64) for x in group["s"]]
        size = np.array([len(x) for x in full])
        left = np.flatnonzero(group["blk"] == group["bi"])
        right = np.flatnonzero(group["blk"] == group["bj"])
        apart, out = group["bi"].iloc[0] != group["bj"].iloc[0], []
        for i in left:
            near = right[(part[right] != part[i]) & (apart | (right > i))]
            near = near[100 * np.minimum(size[near], size[i]) >= hundredths * np.maximum(size[near], size[i])]
            same = sig[near] == sig[i]
            first = same.reshape(len(near), -1, ROWS).all(axis=2).argmax(axis=1) if len(near) else near
            for j in near[(same.sum(axis=1) >= least) & (first == band)]:
                both = len(np.intersect1d(full[i], full[j], assume_unique=True))
                if 100 * both >= hundredths * (size[i] + size[j] - both):
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    counts = open_.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = open_.join(broadcast_if_small(counts), "key").withColumn("blk", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", "band", "doc", "component", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"))
    held = placed.join(reps.select("doc", "signature"), "doc").join(sets.select("doc", "s"), "doc")
    return held.groupBy("key", "bi", "bj").applyInPandas(run, f"a {kind}, b {kind}")


def star_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (doc, component), component the smallest id reachable, for every id that is in a link.

    Alternates large-star (each node sends its larger neighbours to its smallest neighbour) and small-star (each node sends
    its smaller neighbours and itself to the smallest) until nothing changes. Neighbours' minima are partial aggregations.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("doc"), F.col("v").alias("component")).union(now.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, *, hundredths: int = 80, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_shingles, component, kept) for every row: texts linked at a shingle similarity of hundredths / 100 or more.

    component is the smallest doc reachable by links, kept says that the row's doc is it. Each row's own text is compared, also
    where an id comes with several texts; rows that repeat an id and its text have the same component. Null or empty texts, and
    those of white space only: an empty set, linked with nothing, kept. Null ids are the smallest of nothing: such a row is kept
    only in a component without any id, whose component is null. Very long texts are read whole. Other columns are not read,
    whatever their names. Empty table: no rows.
    """
    threshold = hundredths / 100
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    sigs = materialize(signatures(docs, threshold=threshold, width=width, id_col=id_col, text_col=text_col), "signatures")
    # a node for each distinct set; the number is written once and read from then on
    each = sigs.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("doc").alias("least"), F.min(F.struct("doc", "mark")).alias("r"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = materialize(each.select(F.monotonically_increasing_id().alias("node"), "fingerprint", "least", F.col("r.doc").alias("rep"), F.col("r.mark").alias("mark"), "n_shingles", "signature"), "classes")
    reps = classes.select(F.col("node").alias("doc"), "n_shingles", "signature")
    keys = F.transform(F.sequence(F.lit(0), F.lit(band_count(threshold) - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    bands = reps.select("doc", F.posexplode(keys).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).where("n > 1")
    members = materialize(bands.join(shared, "key").select("key", "band", "doc", "first"), "buckets")

    stars = members.where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    wanted = classes.select("node", "rep", "mark").join(members.select(F.col("doc").alias("node")).distinct(), "node", "left_semi")
    sets = _sets(rows, wanted, width)
    agreed = materialize(_agree(stars, reps, threshold), "agreed")
    links = materialize(_confirm(agreed, sets, hundredths), "links")
    found = materialize(star_components(links), "components")

    # what the first members did not join: other components in one bucket
    placed = members.where("doc <> first").join(found, "doc", "left").select("key", "band", "doc", F.coalesce("component", "doc").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_ = materialize(placed.join(mixed.select("key"), "key", "left_semi"), "open")
    more = materialize(_across(open_, reps, sets, hundredths, threshold), "links2")
    if more.limit(1).count():
        found = materialize(star_components(found.select(F.col("doc").alias("a"), F.col("component").alias("b")).union(more)), "components2")

    # nodes' components, the smallest id of each, and the rows of each node
    held = classes.select("node", "fingerprint", "least").join(found.withColumnRenamed("doc", "node"), "node", "left").withColumn("group", F.coalesce("component", "node")).select("fingerprint", "least", "group")
    ids = held.groupBy("group").agg(F.min("least").alias("component"))
    linked = held.join(ids, "group").select("fingerprint", "component")
    out = sigs.select("doc", "n_shingles", "fingerprint").join(linked, "fingerprint", "left").withColumn("component", F.when(F.col("fingerprint").isNull(), F.col("doc")).otherwise(F.col("component")))
    return out.select("doc", "n_shingles", "component", F.col("doc").eqNullSafe(F.col("component")).alias("kept"))
