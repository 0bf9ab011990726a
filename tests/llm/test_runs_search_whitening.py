"""Periodic runs, impact-ordered search and whitening against brute force and numpy, and on odd inputs."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import impact_search, periodic_runs, queries, whitening

from .test_operators import words

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, x string, part int, copies string, doc string"


# ---- periodic runs


def plain_runs(w):
    """Every stretch for every period, then the smallest period of each stretch."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(6, 4 * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_rest(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@given(st.lists(st.tuples(st.integers(0, 90), st.integers(1, 4), st.integers(1, 9), st.integers(0, 2**30)), max_size=5))
@settings(max_examples=300, deadline=None)
def test_runs_of_groups_of_texts(kinds):
    texts = []
    for n, letters, p, seed in kinds:
        r = random.Random(seed)
        w = [f"w{r.randint(0, letters)}" for _ in range(n)]
        if n and r.random() < 0.6:
            s = r.randrange(n)
            w = [w[s + (i - s) % p] if i >= s and s + p <= n else x for i, x in enumerate(w)]
        texts.append(w)
    sizes, runs, kept = periodic_runs._described([" ".join(w).encode() for w in texts])
    assert sizes == [len(w) for w in texts]
    for i, w in enumerate(texts):
        mine = plain_runs(w)
        assert [tuple(r[1:]) for r in runs.tolist() if r[0] == i] == mine and kept[i].decode() == plain_rest(w, mine)


def test_slices_and_groups_change_nothing(monkeypatch):
    r = random.Random(5)
    texts = [" ".join(["a b c"] * 30 + [f"w{r.randint(0, 2)}" for _ in range(40)]).encode() for _ in range(20)] + [b"z " * 3000, None, b""]
    whole = periodic_runs._described(texts)
    monkeypatch.setattr(periodic_runs, "SLICE", 50)
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", 40)
    parts = [periodic_runs._described(g) for g in periodic_runs._groups(texts)]
    assert len(parts) > 5 and sum((p[2] for p in parts), []) == whole[2] and [x for p in parts for x in p[1][:, 1:].tolist()] == whole[1][:, 1:].tolist()


def test_runs_on_odd_rows(spark, odd, odd_rows, none):
    out = periodic_runs.runs_of(odd)
    assert out.columns == ["doc", "n_words", "runs", "text"]
    got = sorted((str(r["doc"]), r["n_words"], [tuple(x) for x in r["runs"]], r["text"]) for r in out.collect())
    want = []
    for doc, text, *_ in odd_rows:
        w = words(text)
        mine = plain_runs(w) if len(w) < 2000 else []
        want.append((str(doc), len(w), mine, plain_rest(w, mine)))
    assert got == sorted(want)
    assert periodic_runs.runs_of(none).count() == 0
    dotted = spark.createDataFrame([(1, "x " * 50)], "`a.b` bigint, `t.x` string")
    row = periodic_runs.runs_of(dotted, id_col="a.b", text_col="t.x").first()
    assert [tuple(x) for x in row["runs"]] == [(0, 50, 1)] and row["text"] == "x"


def test_planted_runs_and_digests(spark, tmp_path):
    r = random.Random(9)
    texts = {i: " ".join(f"w{r.randint(0, 300)}" for _ in range(r.randint(0, 120))) for i in range(300)} | {300: None, 301: "", 302: "a b c d " * 9}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n_runs = 0
    for row in queries.op11_periodic_runs(spark, str(tmp_path)).collect():
        w, h = words(texts[row["doc_id"]]), crc32(str(row["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        n_runs += len(runs)
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == sha256(plain_rest(w, runs).encode()).hexdigest()
    assert n_runs > 10


# ---- impact-ordered search


def plain_top(rows, k, scale=64, every=20):
    """(query, rank, id, score) by scoring everything; rows are (id, vector)."""
    sound = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    asked = {(i, tuple(v)) for i, v in sound if i is not None and i % every == 0}
    out = []
    for q, qv in asked:
        best = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i is None, i or 0) for i, v in sound if i != q)[:k]
        out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(best)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("kind", ["spread", "near", "equal", "long"])
def test_search_is_exact(spark, kind, monkeypatch):
    g = np.random.default_rng({"spread": 1, "near": 2, "equal": 3, "long": 4}[kind])
    x = g.normal(0, 0.2, (700, 12))
    if kind == "near":
        x = x[g.integers(0, 9, 700)] + g.normal(0, 0.01, (700, 12))
    elif kind == "equal":
        x[g.random(700) < 0.5] = x[0]
    elif kind == "long":
        x *= 40_000.0 ** g.random((700, 1))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    monkeypatch.setattr(impact_search, "BLOCK", 64)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    out = impact_search.search(df, is_query=F.col("vec_id") % 20 == 0, k=7, tile=150, queries=9)
    assert found(out) == plain_top(rows, 7)


def test_search_stops_early_only_on_proof():
    g = np.random.default_rng(0)
    x = np.round(g.normal(0, 8, (4096, 64))).astype(np.int64)
    q, ids = x[:50], np.arange(4096)
    best, none, shares = impact_search.Found(ids[:50], 5), np.zeros(1024, dtype=np.int64), []
    for a in range(0, 4096, 1024):
        part = x[a : a + 1024]
        shares.append(impact_search.search_block(impact_search.index_block(part), part, ids[a : a + 1024], none, none + 1, q, ids[:50], best))
    assert min(shares) < 1
    exact = q @ x.T
    for i in range(50):
        want = sorted((-exact[i, j], j) for j in range(4096) if j != i)[:5]
        assert [(-s, j) for s, j in zip(best.score[best.query == i].tolist(), best.id[best.query == i].tolist(), strict=True)] == want


def test_search_on_odd_rows(spark):
    v = [0.1, -0.2, 0.3]
    rows = [
        (0, v), (0, v), (20, [0.5, 0.5, 0.5]), (20, [0.1, 0.1, 0.1]), (None, v), (None, v), (3, None), (40, None), (4, [0.1, None, 0.2]), (60, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]),
        (6, []), (80, []), (7, [1.0]), (8, v), (9, v), (9, v), (100, [0.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame([(i, x, 1, "i", "x", 2, "c", "d") for i, x in rows], VECTORS)
    assert found(impact_search.search(df, is_query=F.col("vec_id") % 20 == 0, k=6)) == plain_top([(i, x) for i, x in rows], 6)
    assert impact_search.search(df.limit(0), is_query=F.col("vec_id") % 20 == 0).count() == 0
    assert impact_search.search(df.where("vec_id = 0"), is_query=F.col("vec_id") % 20 == 0).count() == 0
    assert impact_search.search(df, is_query=F.lit(False)).count() == 0


# ---- whitening


def plain_whitening(rows, k=8):
    kept = [(i, [int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept])
    n, s = len(x), x.sum(axis=0)
    c = (x * n - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [i for i, _ in kept], n, ((x * n - s) ** 2).sum(axis=1), values, c @ vectors / np.sqrt(values), values / (c**2).sum() * n


@pytest.mark.parametrize("kind", ["flat", "steep", "narrow"])
def test_whitening_is_that_of_numpy(spark, kind):
    g = np.random.default_rng(3)
    width = 5 if kind == "narrow" else 40
    x = g.normal(0, 0.1, (900, width)) * (0.4 ** np.arange(width) if kind == "steep" else 1)
    if kind == "steep":
        x = x @ np.linalg.qr(g.normal(size=(width, width)))[0] * 20
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    ids, n, deviation, values, z, shares = plain_whitening(rows)
    got = sorted(whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)).collect(), key=lambda r: (r["component"], r["doc"]))
    count = min(8, width)
    assert len(got) == 900 * count and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    for j in range(count):
        mine = got[900 * j : 900 * (j + 1)]
        w = np.array([r["whitened"] for r in mine])
        assert [r["doc"] for r in mine] == ids and [r["deviation"] for r in mine] == deviation.tolist()
        assert abs(mine[0]["explained"] / shares[j] - 1) < 1e-9
        assert min(np.abs(w - z[:, j]).max(), np.abs(w + z[:, j]).max()) < 1e-7


def test_range_finder_grows_only_if_residuals_fail(spark):
    g = np.random.default_rng(4)
    for flat in (False, True):
        x = np.floor(g.normal(0, 300, (400, 60)) * (1 if flat else 0.3 ** np.arange(60)) + 100_000).astype(np.int64)
        rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<bigint>")
        values, axes, missed, passes = whitening.components(rows, 400, x.sum(axis=0), k=3, oversampling=4)
        c = x - x.mean(axis=0)
        assert axes.shape == (60, 3) and missed <= 1e-11 and passes == (3 if flat else 5)
        assert np.allclose(values, np.linalg.eigvalsh(c.T @ c / 400)[::-1][:3], rtol=1e-10) and np.allclose(axes.T @ axes, np.eye(3), atol=1e-12)


def test_whitening_on_odd_rows(spark):
    g = np.random.default_rng(6)
    rows = [(i, [float(c) for c in np.float32(g.normal(0, 0.1, 4))]) for i in range(30)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (4, rows[5][1])]
    odd = [(40, None), (41, []), (42, [0.1, None, 0.2, 0.3]), (43, [float("nan")] * 4), (44, [float("-inf"), 0.0, 0.0, 0.0]), (45, [0.1, 0.2])]
    df = spark.createDataFrame([(i, v, 1, "i", "x", 2, "c", "d") for i, v in rows + odd], VECTORS)
    _, n, deviation, values, z, _ = plain_whitening(rows, 4)
    got = whitening.whiten(df).collect()
    assert n == 34 and len(got) == 34 * 4 and {r["n"] for r in got} == {34} and sum(r["doc"] is None for r in got) == 4
    assert sorted(r["deviation"] for r in got) == sorted(np.repeat(deviation, 4).tolist())
    assert np.allclose(sorted(abs(r["whitened"]) for r in got), sorted(np.abs(z).ravel()), atol=1e-9)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 40")).count() == 0
    assert whitening.whiten(df.where("vec_id = 1")).count() == 0  # no variance, no component
    flat = spark.createDataFrame([(i, [float(i), 2.0, 2.0 * i]) for i in range(9)], "vec_id bigint, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}
