"""Web evidence, profiles, reindexing and run metrics against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunk, evidence, profiles

KNOWN = "document string, url string, fetched_at int, expires_at int"


def doc_id(url, text):
    return "doc-" + hashlib.sha256(f"{url}\0{hashlib.sha256(text.encode()).hexdigest()}".encode()).hexdigest()[:24]


def plain_research(items, pages, known, now, budget):
    """A run's results one after another."""
    fresh = {}
    for d, u, f, e in known:
        if e > now and f >= fresh.get(u, (None, -1))[1]:
            fresh[u] = (d, f)
    stored, reads, out = {u: d for u, (d, _) in fresh.items()}, 0, []
    have, own = {d for d, *_ in known}, {}
    for rank, url in items:
        if url in stored:
            out.append((rank, stored[url], "cached"))
        elif reads >= budget:
            out.append((rank, None, "not_read_budget"))
        else:
            reads += 1
            final, text = pages.get(url, (None, None))
            if text is None:
                out.append((rank, None, "failed"))
                continue
            d = doc_id(final, text)
            out.append((rank, d, "deduplicated" if d in have or d in own.values() else "stored"))
            stored[final] = own[final] = d
    return out


def test_results_are_read_under_a_budget(spark):
    r = random.Random(7)
    urls = [f"http://e{i}.com/" for i in range(12)]
    pages = {u: (r.choice([u, u, r.choice(urls)]), r.choice(["text a", "text b", f"own {u}", None])) for u in urls[:10]}
    known = [(doc_id(u, "text a"), u, r.randint(0, 9), r.choice([50, 150])) for u in urls[:4]] + [(doc_id(urls[0], "older"), urls[0], -1, 150)]
    runs = {k: [(i, r.choice(urls)) for i in range(r.randint(0, 12))] for k in range(60)}
    results = spark.createDataFrame([(k, i, u.upper()) for k, items in runs.items() for i, u in items], "run int, rank int, url string")
    given = spark.createDataFrame([(u, f, "t", t) for u, (f, t) in pages.items()], "url string, final_url string, title string, text string")
    statuses, docs = evidence.research(results, given, spark.createDataFrame(known, KNOWN), now=F.lit(100), ttl=F.lit(100), budget=4)
    got = {}
    for row in statuses.orderBy("run", "rank").collect():
        got.setdefault(row["run"], []).append((row["rank"], row["document"], row["status"]))
    assert got == {k: plain_research(items, pages, known, 100, 4) for k, items in runs.items() if items}
    assert {x[2] for v in got.values() for x in v} == {"cached", "not_read_budget", "failed", "deduplicated", "stored"}
    kept = {x["document"]: (x["url"], x["expires_at"]) for x in docs.collect()}
    assert kept.keys() == {d for v in got.values() for _, d, s in v if s in ("stored", "deduplicated")} and {e for _, e in kept.values()} == {200}
    found = evidence.passages(docs)
    assert {x["document"] for x in found.collect()} == kept.keys()
    hits = evidence.search(found, spark.createDataFrame([("q", "OWN text")], "query string, text string"), top_k=3).collect()
    assert len(hits) == 3 and all(h["source"].startswith("src-") and h["url"] == kept[h["document"]][0] for h in hits)


def test_profiles(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(f"d{i}",) for i in range(80)], "document_id string")
    queries = spark.createDataFrame([(f"q{i}", " " if i == 3 else "text") for i in range(10)], "query_id string, text string")
    rows = {(f"q{r.randint(0, 11)}", f"d{r.randint(0, 85)}"): r.randint(0, 2) for _ in range(120)}
    qrels = spark.createDataFrame([(*k, v) for k, v in rows.items()], "query_id string, document_id string, relevance int")
    known = {k for k, v in rows.items() if v > 0 and k[0] in {f"q{i}" for i in range(10) if i != 3} and int(k[1][1:]) < 80}
    order = lambda seed, x: (hashlib.sha256(f"{seed}:{x}".encode()).hexdigest(), x)
    taken = sorted({q for q, _ in known}, key=lambda q: order("s-queries", q))[:4]
    judged = {d for q, d in known if q in taken}
    kept = judged | set(sorted({f"d{i}" for i in range(80)} - judged, key=lambda d: order("s-documents", d))[: max(0, 60 - len(judged))])
    p = profiles.build(docs, queries, qrels, n_documents=60, n_queries=4, seed="s")
    assert {x[0] for x in p.queries.select("query_id").collect()} == set(taken) and {x[0] for x in p.documents.collect()} == kept
    assert {(x[0], x[1]) for x in p.qrels.select("query_id", "document_id").collect()} == {k for k in known if k[0] in taken}
    m = p.manifest.first()
    assert (m["documents"], m["queries"], m["source_documents"], m["source_positive_qrels"], m["qrels_complete"]) == (len(kept), 4, 80, len(known), False)
    whole = profiles.build(docs, queries, qrels, n_documents=80, seed="s", complete=True)
    assert whole.qrels.count() == len(known) and whole.manifest.first()["qrels_complete"]
    with pytest.raises(Exception, match="the profile loses a judged document: d"):
        profiles.build(docs, queries, qrels, n_documents=1, n_queries=1, seed="s", complete=True)
    rows = spark.range(30).select("id", F.lit(1).alias("x"))
    cut = {x["id"]: x["split"] for x in profiles.split(rows, seed="z", validation=7, id_col="id").collect()}
    assert sorted(k for k, s in cut.items() if s == "validation") == sorted(sorted(range(30), key=lambda i: order("z", i))[:7])


def test_reindexing(spark):
    text = "A sentence of some length stands here. " * 60
    docs = [("a", "uploaded", "completed", 400, 50), ("b", "demo", "completed", 400, 50), ("c", "uploaded", "completed", 800, 120), ("d", "uploaded", "failed", 800, 120), ("e", "uploaded", "completed", 400, 50), ("f", "uploaded", "completed", 400, 50)]
    documents = spark.createDataFrame(docs, "document_id string, corpus_namespace string, status string, chunk_size int, chunk_overlap int")
    texts = spark.createDataFrame([("a", text), ("b", text), ("c", text), ("d", text), ("e", None), ("f", "  ")], "document_id string, text string")
    old = spark.createDataFrame([(d[0], 0, f"old-{d[0]}", "x") for d in docs], "document_id string, chunk_index int, chunk_id string, text string")
    asked = spark.createDataFrame([("a", 800, 120), ("b", 800, 120), ("c", None, None), ("d", None, None), ("e", 800, None), ("f", 800, None), ("g", 800, 1)], "document_id string, chunk_size int, chunk_overlap int")
    out, chunks, outcomes = profiles.reindex(documents, old, texts, asked)
    assert {x["document_id"]: (x["error"], x["duplicate"]) for x in outcomes.collect()} == {
        "a": (None, False), "b": ("read_only_corpus", False), "c": (None, True), "d": (None, False), "e": ("stored_file_missing", False), "f": ("no_chunks", False), "g": ("document_not_found", False)}
    assert {x["document_id"]: (x["status"], x["chunk_size"]) for x in out.collect()} == {"a": ("completed", 800), "b": ("completed", 400), "c": ("completed", 800), "d": ("completed", 800), "e": ("completed", 400), "f": ("completed", 400)}
    got = {}
    for x in chunks.orderBy("chunk_index").collect():
        got.setdefault(x["document_id"], []).append(x["text"])
    want = chunk.pieces(chunk.normalized(text), 800, 120)
    assert got == {"a": want, "d": want} | {k: ["x"] for k in "bcef"}
    bad = profiles.reindex(documents, old, texts, spark.createDataFrame([("a", 100, 10), ("d", 300, 300)], "document_id string, chunk_size int, chunk_overlap int"))
    assert {x["document_id"]: x["error"] for x in bad[2].collect()} == {"a": "invalid_chunk_size", "d": "invalid_chunk_overlap"} and bad[1].count() == 6


def test_rates_and_status(spark):
    rows = [("base", True, "x", True, False, 1.0, 2), ("base", False, None, True, True, 3.0, 4), ("sft", True, "", True, False, 1.0, 1)]
    got = {r["mode"]: r for r in profiles.format_rates(spark.createDataFrame(rows, "mode string, format_valid boolean, expected_answer string, answer_exact boolean, hit_token_limit boolean, latency_seconds double, generated_tokens int"), ["mode"]).collect()}
    assert (got["base"]["format_valid_rate"], got["base"]["answer_exact_rate"], got["base"]["token_limit_failure_rate"], got["sft"]["answer_exact_rate"]) == (0.5, 1.0, 0.5, None)
    calls = spark.createDataFrame([("r", "succeeded", "a"), ("r", None, "a"), ("r", "failed", "b"), ("s", "succeeded", "c")], "run string, status string, q string")
    assert {tuple(r) for r in profiles.run_metrics(calls, run="run", status="status", question="q").collect()} == {("r", 1, 2, 1), ("s", 1, 0, 0)}
    chunks = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [1.0])], "chunk_id string, vector array<double>")
    row = profiles.index_status(chunks, chunks, vectors, version=2, model="m", dimension=2).first()
    assert (row["chunks"], row["bm25_ready"], row["dense_ready"]) == (2, True, False)
    labels = spark.createDataFrame([("m", "c1", 1, "low"), ("m", "c1", 2, "high"), ("m", "c2", 1, "high"), ("m", "c3", 1, None)], "mode string, c string, n int, label string")
    assert [tuple(r) for r in profiles.last_label_counts(labels, case=["c"], order="n", label="label", by=["mode"]).collect()] == [("m", "high", 2)]
    shape = profiles.compact(spark.createDataFrame([("q", list("abcdefg"), list("gabcdef"))], "q string, before array<string>, after array<string>"), keys=["q"], top=2).first()
    assert (shape["before"], shape["after"], shape["rank_changes"]) == (["a", "b"], ["g", "a"], {"a": -1, "b": -1, "g": 6})


def test_frozen_runs(spark):
    found = spark.createDataFrame([("test.jsonl", "aa")], "path string, sha256 string")
    cases = spark.createDataFrame([("1", ["paris"], ["e1"])], "case_id string, accepted array<string>, evidence_ids array<string>")
    gold = spark.createDataFrame([("1", 1, "the town is paris", ["e1"], [])], "case_id string, gold_no int, gold_text string, supporting array<string>, contradicting array<string>")
    answers = spark.createDataFrame([("1", "rag", "Paris", "The town is Paris [E:e1].", 1.0, 2), ("1", "direct", "Rome", "", 1.0, 2)], "case_id string, mode string, answer string, report string, latency_ms double, total_tokens int")
    run = profiles.frozen_run(found, found, cases, gold, answers, dataset="d")
    row = run.config.first()
    assert (row["cases"], row["modes"], row["test_used_for_tuning"], row["dataset_sha256"]) == (1, ["direct", "rag"], False, hashlib.sha256(b"aa").hexdigest())
    assert [tuple(r) for r in run.failures.collect()] == [("1", "direct", ["answer_incorrect", "empty_report", "missing_citation"])] and run.metrics.count() == 2 and run.predictions.count() == 2
    with pytest.raises(ValueError, match="test.jsonl changed"):
        profiles.frozen_run(found, found.withColumn("sha256", F.lit("bb")), cases, gold, answers, dataset="d")
    with pytest.raises(Exception, match="repeated answer: 1, rag"):
        profiles.frozen_run(found, found, cases, gold, answers.union(answers.limit(1)), dataset="d")
