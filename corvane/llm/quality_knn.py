"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed marks: its words, their letter triples and their shapes (letters by case, digits, punctuation),
the shapes of its lines, and how far words and lines repeat. A bounded labelled sample gives the weights of marks, their
singular vectors, and the labelled vectors themselves, which are broadcast. Every document is projected and compared with all
labelled vectors by exact cosine products, a block of documents at a time; the nearest vote for their label by similarity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bounds: labelled rows learned from (their vectors take FIT_ROWS * RANK * 4 bytes), hashed marks, latent dimensions, voters.
FIT_ROWS, MARKS, RANK, VOTERS, SHARPNESS = 6_000, 2_048, 48, 15, 4.0
#: Where each kind of hashed mark lies, and its weight; the first 64 marks are measures, in steps.
SHAPES, LINES, TRIPLES, WORDS = (64, 576, 1.0), (576, 704, 0.5), (704, 1376, 0.5), (1376, 2048, 0.5)
_RUN = re.compile(r"(.)\1+")
_SHAPE = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})


def _shape(word: str) -> str:
    plain = word if word.isascii() else "".join(c if c.isascii() else "A" if c.isupper() else "a" if c.isalpha() else "~" for c in word)
    return _RUN.sub(r"\1", plain.translate(_SHAPE))


def _spot(mark: str, kind: tuple[int, int, float]) -> int:
    return kind[0] + zlib.crc32(mark.encode("utf-8", "surrogatepass")) % (kind[1] - kind[0])


def _word_marks(word: str) -> tuple[str, bytes]:
    """The shape of a word, and its marks as 16-bit numbers: shape, word, letter triples."""
    shape, small = _shape(word), word.lower()
    edged = f" {small} "
    marks = [_spot(shape, SHAPES), _spot(small, WORDS), *[_spot(edged[i : i + 3], TRIPLES) for i in range(len(edged) - 2)]]
    return shape, np.array(marks, dtype=np.uint16).tobytes()


def mark_counts(text: str | None, known: dict[str, tuple[str, bytes]]) -> np.ndarray:
    """The MARKS counts of a text, dampened; zeros for a null or empty text. `known` keeps the marks of words, except very long ones."""
    out = np.zeros(MARKS, dtype=np.float32)
    if not text:
        return out
    words = Counter(text.split())
    if not words:
        return out
    total = sum(words.values())
    own: dict[str, tuple[str, bytes]] = {}
    for w in words:
        k = known.get(w)
        if k is None:
            k = _word_marks(w)
            if len(w) <= 100:
                known[w] = k
        own[w] = k
    coded = [k[1] for k in own.values()]
    times = np.fromiter(words.values(), dtype=np.float32, count=len(words))
    sums = np.bincount(np.frombuffer(b"".join(coded), dtype=np.uint16), np.repeat(times, [len(x) // 2 for x in coded]), MARKS)
    lines = [x for x in text.split("\n") if x.strip()]
    for line, n in Counter(lines).items():
        sums[_spot(" ".join([x for x, _ in groupby([own[w][0] for w in line.split()])]), LINES)] += n
    for start, end, weight in (SHAPES, LINES, TRIPLES, WORDS):
        part = sums[start:end]
        out[start:end] = weight * np.sqrt(part / max(part.sum(), 1))

    def measure(at: int, value: float, steps: int) -> None:
        out[at + min(steps - 1, int(value * steps))] = 0.7

    measure(0, 1 - len(words) / total, 12)
    measure(12, 1 - len(set(lines)) / max(len(lines), 1), 12)
    measure(24, np.log2(total + 1) / 16, 12)
    measure(36, min(0.999, len(text) / (total * 16)), 12)
    measure(48, min(0.999, np.log2(1 + total / max(len(lines), 1)) / 10), 12)
    return out


class Space:
    """Inverse document frequencies and right singular vectors of a labelled sample."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        seen = (counts > 0).sum(axis=0)
        self.weight = np.log((len(counts) + 1) / (seen + 1)).astype(np.float32) + np.float32(0.5)
        x = counts * self.weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, : min(RANK, len(counts))]).astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.base = float(labels.mean())
        self.points = self.project(counts)

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = (counts * self.weight) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the VOTERS nearest, drawn a little to the base rate; of equally near ones at
        the edge, those of the first labelled rows."""
        near = self.project(counts) @ self.points.T
        k = min(VOTERS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(near, top, axis=1).min(axis=1)
        tied = (near >= edge[:, None]).sum(axis=1) > k
        for i in np.flatnonzero(tied):
            above, level = np.flatnonzero(near[i] > edge[i]), np.flatnonzero(near[i] == edge[i])
            top[i] = np.concatenate([above, level[: k - len(above)]])
        w = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** SHARPNESS
        return ((w * self.labels[top]).sum(axis=1) + 0.5 * self.base) / (w.sum(axis=1) + 0.5)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS, threshold: float = 0.3) -> DataFrame:
    """(doc, score, predicted) for every row of docs; `labels` holds the rows that may be learned from.

    At most `fit_rows` labels are used, those first by a hash of the id; null labels or ids are ignored, repeated ids learn once
    per row. Null and empty texts have a zero vector: no neighbour is similar, so they get the base rate. Null document ids pass
    through. Without labels: score 0. Other columns are not read. Empty table: no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    chosen = labels.select(F.col(label_id_col).alias("doc"), F.col(label_col).cast("long").alias("label")).dropna().orderBy(F.xxhash64("doc"), "doc").limit(fit_rows)
    train = materialize(rows.join(F.broadcast(chosen), "doc").select("text", "label"), "quality_train")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, bytes]] = {}
        for batch in batches:
            x = [mark_counts(t, known).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column("label")], names=["x", "label"])

    # in an order of its own, so that reruns add up alike
    sample = sorted(train.mapInArrow(measure, "x binary, label bigint").collect(), key=lambda r: (bytes(r["x"]), r["label"]))
    space = None
    if sample:
        space = Space(np.frombuffer(b"".join(bytes(r["x"]) for r in sample), dtype=np.float16).reshape(len(sample), MARKS).astype(np.float32), np.array([r["label"] for r in sample]))
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, bytes]] = {}
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for i in range(0, len(texts), 256):
                if len(known) > 500_000:
                    known.clear()
                if sent.value is None:
                    out.append(np.zeros(len(texts[i : i + 256])))
                else:
                    out.append(sent.value.vote(np.stack([mark_counts(t, known) for t in texts[i : i + 256]])))
            p = np.clip(np.concatenate(out), 0, 1).astype(np.float64) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(p, pa.float64())], names=["doc", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, score double").withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))
