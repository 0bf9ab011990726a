"""Exact top-k search by inner product with an impact-ordered index, score at a time.

The index cuts the rows into blocks. The entries of a block's vectors are its postings; they are gathered in segments of one
dimension, one sign and one step of magnitude, each with one quantised impact, and stored by falling magnitude. A block of
queries reads the segments in that order and adds up quantised scores for all its queries at once. What is unread, and what
quantising lost, is known per row as the length of the rest of its vector after each step; by Cauchy-Schwarz that bounds how far
a score can still move. Reading stops only when the bound proves all but a few pairs to be below scores that a query already
has; these possible members are scored again exactly, on whole numbers.

Every block of queries meets every block of the index, tile by tile: a stated set of queries against all rows, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of an index block, blocks' rows dealt out together, queries taken together, steps of magnitude: bounds on memory alone.
BLOCK, TILE, QUERIES, STEPS = 2048, 8192, 1024, 32
#: Reading stops once this share of the pairs is left, or at the last step: from there on exact scores cost about what the postings would.
FEW = 1 / 32
_EXACT = 2.0**24

_INDEX = "tile int, ids array<bigint>, copies array<bigint>, width int, x binary, dims binary, steps binary, impacts binary, ends binary, slots binary, rests binary"


def whole_units(vector: Column, scale: int) -> Column:
    """floor(scale * component) of every component as long; null for vectors that are null or hold null or non-finite components."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(scale))))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    one = lists.combine_chunks()
    sizes = np.diff(one.offsets.to_numpy())
    flat, out = one.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def index_block(x: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of a block by falling magnitude, and the length of what is unread or lost of each row after each step."""
    size = np.abs(x)
    top = int(size.max(initial=0))
    slot, dim = np.nonzero(x)
    value = x[slot, dim]
    step = -(-(np.abs(value).astype(np.float64) * STEPS) // max(top, 1)).astype(np.int64) if top > 2**52 else -(-np.abs(value) * STEPS // max(top, 1))
    order = np.lexsort((slot, value > 0, dim, -step))
    slot, dim, value, step = slot[order], dim[order], value[order], step[order]
    new = np.flatnonzero(np.concatenate([[True], (step[1:] != step[:-1]) | (dim[1:] != dim[:-1]) | ((value[1:] > 0) != (value[:-1] > 0))])) if len(slot) else np.zeros(0, dtype=np.int64)
    ends = np.append(new[1:], len(slot))[: len(new)]
    impacts = np.round(np.add.reduceat(value.astype(np.float64), new) / (ends - new)) if len(new) else np.zeros(0)
    lost = (value - np.repeat(impacts, ends - new)) ** 2
    rest = np.zeros((STEPS + 1, len(x)))  # rest[s]: steps above s are read
    for s in range(STEPS + 1):
        rest[s] = np.sqrt(np.bincount(slot, np.where(step > s, lost, value.astype(np.float64) ** 2), len(x))) * (1 + 1e-12)
    return {"dims": dim[new].astype(np.int32), "steps": step[new].astype(np.int32), "impacts": impacts, "ends": ends.astype(np.int32), "slots": slot.astype(np.int32), "rests": rest}


class Found:
    """The best k exact scores of each query so far, ties by id (null last)."""

    def __init__(self, ids: np.ndarray, k: int):
        self.k, self.n = k, len(ids)
        self.query, self.score, self.id, self.null = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.least = np.full(self.n, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        q, s, i, z = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((i, z, -s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, place = order[place < self.k], q[place < self.k], place[place < self.k]
        self.query, self.score, self.id, self.null = q, s[order], i[order], z[order]
        full = place == self.k - 1
        self.least[q[full]] = self.score[full]


def search_block(block: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, null: np.ndarray, copies: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, found: Found, few: float = FEW) -> float:
    """Add a block's exact best to `found`; the share of postings read."""
    width = max(x.shape[1], queries.shape[1])
    x, queries = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, queries))
    reach = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1)
    if reach >= 2.0**62:
        raise ValueError("scores do not fit 64 bits")
    kind = np.float32 if reach < _EXACT else np.float64
    spare = 0.5 if reach < 2.0**52 else reach * 1e-9  # what sums of doubles may round away
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
    by_dim = np.ascontiguousarray(queries.T).astype(kind)
    sums = np.zeros((len(x), len(queries)), dtype=kind)
    own_row, own_query = np.nonzero((ids[:, None] == query_ids[None, :]) & ~null[:, None].astype(bool))
    begin, read, known = 0, 0, np.isfinite(found.least)
    starts = np.searchsorted(-block["steps"], -np.arange(STEPS + 1), side="right")  # segments above and at a step

    def possible(rest: np.ndarray, columns=slice(None)) -> np.ndarray:
        bar = np.outer(-rest, norms[columns])
        bar += (found.least[columns] - spare)[None, :]
        return sums[:, columns] >= bar

    left = None
    sample = slice(0, None, max(1, len(queries) // 32))
    for s in range(STEPS - 1, -1, -1):
        for g in range(begin, starts[s + 1]):
            first = block["ends"][g - 1] if g else 0
            at = block["slots"][first : block["ends"][g]]
            sums[at] += by_dim[block["dims"][g]] * kind(block["impacts"][g])
            read += len(at)
        begin = starts[s + 1]
        if s and known.all() and possible(block["rests"][s], sample).mean() <= few:
            left = possible(block["rests"][s])
            if left.mean() <= few:
                break
            left = None
    if left is None:
        s = 0
        if not known.all() and len(x) >= found.k:  # a bar of the block's own: the k-th best of the least that scores can be
            least = sums - np.outer(block["rests"][0], norms) - spare
            least[own_row, own_query] = -np.inf
            found.least = np.maximum(found.least, np.partition(least, len(x) - found.k, axis=0)[len(x) - found.k])
        left = possible(block["rests"][0])
    left[own_row, own_query] = False
    row, query = np.nonzero(left)
    for a in range(0, len(row), 500_000):
        r, q = row[a : a + 500_000], query[a : a + 500_000]
        score = np.einsum("ij,ij->i", x[r], queries[q])
        many = np.minimum(copies[r], found.k)
        found.add(*(np.repeat(v, many) for v in (q, score, ids[r], null[r])))
    return read / max(len(block["slots"]), 1)


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy().astype(np.int64), column.is_null().to_numpy().astype(np.int64)


def build_index(rows: DataFrame, *, tiles: int) -> DataFrame:
    """(id, x, copies) to index blocks, a row each; rows are dealt to `tiles` tiles by a hash of id and vector."""

    def build(table: pa.Table) -> pa.Table:
        ids, null = _ids(table.column("id"))
        x, copies = _matrix(table.column("x")), table.column("copies").to_numpy()
        out = []
        order = np.lexsort((*x.T[::-1], ids, null))
        for at in range(0, len(order), BLOCK):
            part = order[at : at + BLOCK]
            made = index_block(x[part])
            out.append({"tile": table.column("tile")[0].as_py(), "ids": [None if z else i for i, z in zip(ids[part].tolist(), null[part], strict=True)], "copies": copies[part].tolist(), "width": x.shape[1], "x": x[part].tobytes()} | {k: v.tobytes() for k, v in made.items()})
        schema = pa.schema([("tile", pa.int32()), ("ids", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("width", pa.int32()), *[(c, pa.binary()) for c in ("x", "dims", "steps", "impacts", "ends", "slots", "rests")]])
        return pa.Table.from_pylist(out, schema=schema)

    dealt = rows.withColumn("tile", F.pmod(F.xxhash64("id", "x"), F.lit(tiles)).cast("int"))
    return dealt.groupBy("tile").applyInArrow(build, _INDEX)


def search(vectors: DataFrame, *, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with the other rows, ties to the smaller id.

    Components count as floor(scale * component); is_query is a condition on the id column. A row is its query's own if it has the
    query's id: such rows are no candidates of it. Rows that repeat id and vector are as many candidates, and one query; rows that
    share an id but not a vector are a query each. Null ids are no queries, and last among ties. Vectors that are null or hold
    null or non-finite components take no part; empty ones score 0, shorter ones count as if filled up with zeros. A query
    without candidates has no rows. Other columns, whatever their names, are not read. Scores beyond 64 bits raise an error. Empty
    table: no rows.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_units(F.col(f"`{vector_col}`"), scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("x IS NOT NULL")
    rows = materialize(rows.groupBy("id", "x", "asks").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    tiles, parts = max(1, -(-n // tile)), max(1, -(-asked // queries))
    index = materialize(build_index(rows.select("id", "x", "copies"), tiles=tiles), "impact_index")
    asking = rows.where("asks AND id IS NOT NULL").select("id", "x", F.pmod(F.xxhash64("x", "id"), F.lit(parts)).cast("int").alias("part"))
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asking.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def meet(blocks: pa.Table, asking: pa.Table) -> pa.Table:
        found = None
        if blocks.num_rows and asking.num_rows:
            ids, _ = _ids(asking.column("id"))
            q = _matrix(asking.column("x"))
            order = np.lexsort((*q.T[::-1], ids))  # an order of its own: a query has one number in every tile
            ids, q = ids[order], q[order]
            found = Found(ids, k)
            numbers = {c: np.int32 for c in ("dims", "steps", "ends", "slots")} | {"impacts": np.float64, "rests": np.float64}
            for i in range(blocks.num_rows):
                row = {c: blocks.column(c)[i] for c in ("x", "ids", "copies", "width", *numbers)}
                mine = pa.chunked_array([row["ids"].values])
                rid, null = _ids(mine)
                block = {c: np.frombuffer(row[c].as_py(), dtype=t) for c, t in numbers.items()}
                block["rests"] = block["rests"].reshape(STEPS + 1, len(rid))
                x = np.frombuffer(row["x"].as_py(), dtype=np.int64).reshape(len(rid), row["width"].as_py())
                search_block(block, x, rid, null, row["copies"].values.to_numpy(), q, ids, found)
        if found is None:
            return pa.table({c: pa.array([], t) for c, t in (("part", pa.int32()), ("number", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()))})
        part = asking.column("part")[0].as_py()
        return pa.table({
            "part": pa.array(np.full(len(found.query), part), pa.int32()), "number": found.query, "query_id": ids[found.query],
            "vec_id": pa.array(found.id, mask=found.null.astype(bool)), "score": found.score,
        })

    best = left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInArrow(meet, "part int, number bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("part", "number").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
