"""Periodic run detection: where a text says the same words over and over.

A run is a stretch of consecutive words with smallest period q, at least max(6, 4 * q) words long, that cannot grow either way
and keep that period. Runs are found on a harmonic grid: for each period p, the points jp and (j + 1)p are compared by how far
the words agree after them and before them, the longest common extensions. A stretch of 4p words holds four grid points in a
row, so the first pair inside a run sees it whole, and all its pairs give the same stretch. Extensions come from a suffix array,
the array of the reversed text, and range minima over the common prefixes of neighbouring suffixes; pairs whose four next grid
words differ cannot start a run and are not looked up.

Texts are handled in groups laid end to end. Each text has word numbers of its own, so that no extension leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a group of texts (a longer text is a group of its own), and grid points looked at together: bounds on memory.
GROUP_WORDS, SLICE = 250_000, 1_000_000
LEAST, TIMES = 6, 4
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Extensions:
    """Longest common extensions of any two positions: suffix array, prefixes of neighbours, sparse table of range minima."""

    def __init__(self, codes: np.ndarray):
        n = self.n = len(codes)
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int32)
        ranks, width = [], 1
        order = np.argsort(rank, kind="stable")
        while True:
            ranks.append(np.append(rank, np.int32(-1)))  # one past the end differs from every word
            if rank.max(initial=0) == n - 1:
                break
            key = rank.astype(np.int64) * (n + 1)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, dtype=np.int32)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            width *= 2
        order = np.empty(n, dtype=np.int64)
        order[rank] = np.arange(n)
        self.rank = ranks[-1]
        a, b, common = order[:-1], order[1:], np.zeros(max(n - 1, 0), dtype=np.int32)
        for level in range(len(ranks) - 2, -1, -1):
            common[ranks[level][a + common] == ranks[level][b + common]] += 1 << level
        self.minima = [common]
        while (step := 1 << (len(self.minima) - 1)) * 2 <= len(common):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from a and from b on, a < b; from the end of the text on, none."""
        out = np.zeros(len(a), dtype=np.int32)
        inside = b < self.n
        x, y = self.rank[a[inside]], self.rank[b[inside]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low)[1] - 1  # the largest power of two in the range
        found = np.empty(len(low), dtype=np.int32)
        for k in np.unique(level):
            at = level == k
            found[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << int(k))])
        out[inside] = found
        return out


def _grid(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first grid point, period) of the pairs that may start a run, in slices of about SLICE pairs."""
    periods = np.where(sizes >= least, sizes // times, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (sizes[text] - 1) // period - (times - 2)  # first points with times - 1 more behind them
    ends = np.cumsum(points)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - points[at] + SLICE, side="right")))
        t, p, many = text[at:to], period[at:to], points[at:to]
        j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        step = np.repeat(p, many)
        first = np.repeat(begins[t], many) + j * step
        keep = np.flatnonzero(codes[first] == codes[first + step])
        for k in range(1, times - 1):
            keep = keep[codes[first[keep] + k * step[keep]] == codes[first[keep] + (k + 1) * step[keep]]]
        if len(keep):
            yield tuple(v[keep].astype(np.int32) for v in (np.repeat(t, many), first, step))
        at = to


def find_runs(codes: np.ndarray, sizes: np.ndarray, *, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) by text, start and period. `codes` holds the texts end to end, of `sizes` words each;
    no two texts share a code. Without words: no rows."""
    begins = np.cumsum(sizes) - sizes
    pairs = list(_grid(codes, begins, sizes, least, times))
    if not pairs:
        return np.zeros((0, 4), dtype=np.int64)
    # texts without such a pair have no run: extensions are made for the others only
    chosen = np.unique(np.concatenate([np.unique(t) for t, _, _ in pairs]))
    part = np.concatenate([codes[begins[t] : begins[t] + sizes[t]] for t in chosen])
    shift = np.zeros(len(sizes), dtype=np.int32)
    shift[chosen] = np.cumsum(sizes[chosen]) - sizes[chosen] - begins[chosen]
    after = Extensions(part)
    ahead = [after(first + shift[t], first + shift[t] + p) for t, first, p in pairs]
    del after
    before, n, found = Extensions(part[::-1]), len(part), []
    for (t, first, p), f in zip(pairs, ahead, strict=True):
        here = first + shift[t]
        back = before(n - here - p, n - here)  # the word before each point, in the reversed text
        rows = np.stack([t, first - begins[t] - back, p + f + back, p], axis=1).astype(np.int64)
        rows = rows[rows[:, 2] >= np.maximum(least, times * p)]
        found.append(np.unique(rows, axis=0))
    rows = np.unique(np.concatenate(found), axis=0)  # of one stretch the smallest period comes first; the others are its multiples
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _described(texts: list[bytes | None]) -> tuple[list[int], np.ndarray, list[bytes]]:
    """Words of each text, the runs of all, and the texts without what runs repeat."""
    words = [(t or b"").split() for t in texts]  # bytes split at ASCII white space only
    sizes, codes, base = np.array([len(w) for w in words], dtype=np.int64), [], 0
    for w in words:
        known: dict[bytes, int] = {}
        codes += [known.setdefault(x, base + len(known)) for x in w]
        base += len(known)
    runs = find_runs(np.array(codes, dtype=np.int64), sizes)
    kept: list[bytes] = []
    bounds = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
    for i, w in enumerate(words):
        mine = runs[bounds[i] : bounds[i + 1]]
        if len(mine):
            change = np.zeros(len(w) + 1, dtype=np.int64)
            np.add.at(change, mine[:, 1] + mine[:, 3], 1)
            np.add.at(change, mine[:, 1] + mine[:, 2], -1)
            w = [w[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        kept.append(b" ".join(w))
    return sizes.tolist(), runs, kept


def _groups(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """Texts in order, in groups of about GROUP_WORDS words of six bytes."""
    group: list[bytes | None] = []
    room = 6 * GROUP_WORDS
    for t in texts:
        if group and len(t or b"") > room:
            yield group
            group, room = [], 6 * GROUP_WORDS
        group.append(t)
        room -= len(t or b"")
    if group:
        yield group


def runs_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_words, runs, text) for every row of docs: its runs as (start, length, period) in words from 0, by start and
    period, and its words joined by one space without those that a run holds after its first period.

    Null and empty texts: no words, no runs, an empty text. Rows are judged each, so that repeated rows and ids, null ids and ties
    need no rule. Other columns, whatever their names, are not read. Very long texts are read whole: a task needs up to some 1,000
    bytes a word of its longest text, the most where one word fills it. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in _groups(batch.column("text").cast(pa.binary()).to_pylist()):
                sizes, runs, kept = _described(group)
                offsets = np.searchsorted(runs[:, 0], np.arange(len(group) + 1)).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, c])) for c in (1, 2, 3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(at, len(group)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), parts), pa.array(kept, pa.string())],
                    names=["doc", "n_words", "runs", "text"],
                )
                at += len(group)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string")
