"""Small functions on literal values: labels, readers, ids, text, audits in one row."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import ids as I
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import corpus, evaluate, failures, pages, rules, trajectories
from corvane.sources import readers, storage


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_labels(spark):
    entry = lambda *s: F.array(*[F.struct(F.lit(float(x)).alias("score")) for x in s])
    assert [one(spark, rules.report_allowed(e)) for e in (entry(2, 0), entry(0, 0), entry(1))] == [True, False, False]
    assert [one(spark, rules.training_decision(F.lit(a), F.lit(b))) for a, b in ((True, True), (True, False), (False, False))] == ["production_quality_gate_passed", "answer_target_passed_protocol_gate_failed", "answer_target_failed_continue_training"]
    status = lambda run, *s: one(spark, rules.matrix_status(F.array(*map(F.lit, s)), F.lit(run)))
    assert [status(False, "succeeded"), status(True, "succeeded", "succeeded"), status(True, "succeeded", "failed"), status(True, "succeeded", "pending"), status(True, "pending")] == ["planned", "succeeded", "failed", "partial", "pending"]
    assert [one(spark, rules.format_label(F.lit(v), F.lit(n), 10)) for v, n in ((True, 99), (False, 10), (False, 9))] == [None, "max_new_tokens_reached", "invalid_trajectory_schema"]
    bad = lambda u, s, m, n: one(spark, readers.page_error(F.lit(u), F.lit(s), F.lit(m), F.lit(n)))
    assert [bad("http://a.de/x", 200, "Text/HTML; charset=x", 10), bad("file:///x", 200, "text/html", 1), bad("http://a", 404, "text/html", 1), bad("http://a", 200, "image/png", 1), bad("http://a", 200, None, 1), bad("http://a", 200, "text/plain", 3_000_000)] == [
        None, "invalid_url", "http_status", "unsupported_media_type", "unsupported_media_type", "response_too_large"]


def test_variants(spark):
    pair = "case_id string, baseline struct<answer:string,citations:array<string>,abstained:boolean,context:string>, reranked struct<answer:string,citations:array<string>,abstained:boolean,context:string>"
    rows = [("a", ("x", ["1"], False, None), ("y", ["1"], False, None)), ("b", (None, [], True, "c"), (None, ["2"], True, "d"))]
    got = {r["case_id"]: tuple(r)[1:] for r in failures.variant_changes(spark.createDataFrame(rows, pair)).collect()}
    assert got == {"a": (True, False, False, False), "b": (False, True, False, True)}
    records = "variant string, ranked array<string>, relevance map<string,int>, total_ms double, generation_ms double, reranker_ms double, total_tokens int, abstained boolean, n_invalid int"
    rows = [("plain", ["a", "b"], {"b": 1}, 10.0, 4.0, None, 5, False, 1), ("plain", ["a"], {}, 20.0, 6.0, None, 7, True, 0), ("reranked", ["b"], {"b": 1}, 30.0, 1.0, 9.0, 1, False, 0)]
    got = {r["variant"]: r for r in failures.variant_summary(spark.createDataFrame(rows, records)).collect()}
    assert (got["plain"]["queries"], got["plain"]["judged"], got["plain"]["mean_mrr"], got["plain"]["mean_total_ms"], got["plain"]["mean_reranker_ms"], got["plain"]["total_tokens"], got["plain"]["abstentions"], got["plain"]["invalid_citations"]) == (2, 1, 0.5, 15.0, 0.0, 12, 1, 1)
    assert got["reranked"]["mean_mrr"] == 1.0 and got["reranked"]["mean_ndcg_5"] == 1.0


def test_readers_of_logs_and_messages(spark, tmp_path):
    for text in ("a", "b"):
        readers.append_jsonl(spark.createDataFrame([(text,)], "id string"), str(tmp_path / "log"))
    assert sorted(r["id"] for r in readers.read_jsonl(spark, str(tmp_path / "log"), "id string").collect()) == ["a", "b"]
    rows = spark.createDataFrame([("1", [("user", "q"), ("assistant", "a")])], "id string, messages array<struct<role:string,content:string>>")
    rows.write.parquet(str(tmp_path / "m"))
    row = readers.read_messages(spark, str(tmp_path / "m")).first()
    assert [(m["role"], m["content"]) for m in row["messages"]] == [("user", "q"), ("assistant", "a")]
    assert [r["id"] for r in readers.bounded(spark.range(10), ["id"], skip=3, limit=4).collect()] == [3, 4, 5, 6]


def test_ids_and_texts(spark):
    parts = F.array(F.lit("b"), F.lit("a"))
    assert one(spark, I.combined_hash(parts)) == hashlib.sha256(b"ab").hexdigest() == one(spark, I.combined_hash(F.array(F.lit("a"), F.lit("b"))))
    made = [r["v"] for r in spark.range(3).select(I.random_id("run").alias("v")).collect()]
    assert len(set(made)) == 3 and all(len(v) == 28 and v.startswith("run-") for v in made)
    assert [one(spark, T.error_message(F.lit(t))) for t in ("bad input", "no /home/x", "C:\\x")] == ["bad input", "internal error", "internal error"]
    assert one(spark, T.version_parts(F.lit("1.10.x"))) == [1, 10, None] and one(spark, T.version_parts(F.lit("1.9")) < T.version_parts(F.lit("1.10")))
    assert one(spark, T.source_prefix(F.lit("hotpot-train-7"))) == "hotpot" and one(spark, T.short(F.lit("a  b " * 100), 10)) == "a b a b a…"
    assert [one(spark, T.strip_fence(F.lit(t))) for t in ("```json\n{}\n```", "{}", "``` x")] == ["{}", "{}", "x"]
    assert [one(spark, T.contains_answer(F.lit("It was The Cat."), F.lit(a))) for a in ("a cat", "", "dog")] == [True, False, False]
    assert [one(spark, T.has_secret(F.lit(t))) for t in ("api_key = 1", "bearer: x", "a secret")] == [True, True, False]
    assert one(spark, T.adapter_module(F.lit("m.layers.0.q.lora_A.default.weight"))) == "q" and one(spark, pages.untrusted(F.lit("x"))).splitlines()[1] == "x"
    assert one(spark, T.answer_keys(F.array(F.lit("The  Ｃat"), F.lit("b\x00a"), F.lit("")))) == ["cat the", "a b", ""]


def test_ranks_and_cascades(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, id string, rank int")
    qrels = spark.createDataFrame([("q", "c", 1), ("q", "a", 0), ("q", "b", 2)], "query string, id string, grade int")
    assert evaluate.relevant_ranks(hits, qrels).first()["ranks"] == {"b": 2, "c": 3}
    parents, children = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    left, rest = storage.delete_cascade(parents, children, spark.createDataFrame([(2,)], "k int"), "k")
    assert [r["k"] for r in left.collect()] == [1] and [r["v"] for r in rest.collect()] == ["x"]
    assert [one(spark, V.valid(F.array(*map(F.lit, v)).cast("array<double>"))) for v in ((1.0, 2.0), (float("nan"),), (float("inf"),))] == [True, False, False]


def test_a_corpus_audit_is_one_row(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 20
    rows = [("d1", "c1", "T", "http://a.de", base, "en"), ("d1", "c2", " ", "x", base, "en"), ("d2", "c3", "T", None, base + "end", None), ("d2", "c4", "T", "https://b.de/", "short <p>", "de")]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, title string, source string, text string, lang string").withColumn("content_hash", F.md5("text"))
    row = corpus.audit(chunks, source_records=9, removed=2, fields={"language": "lang"}).first()
    assert (row["chunks"], row["documents"], row["unique_chunk_ids"], row["duplicate_text_after_dedup"], row["missing_title"], row["missing_source"], row["invalid_url"], row["html_residue"], row["too_short"]) == (4, 2, 4, 1, 1, 1, 2, 1, 1)
    assert row["near_duplicate_pairs"] >= 1 and row["language_distribution"] == {"en": 2, "": 1, "de": 1} and (row["source_records"], row["exact_duplicates_removed"]) == (9, 2)
    prints = spark.createDataFrame([(i, 5, 7) for i in range(6)] + [(i, 5, 6) for i in range(6, 10)] + [(99, 1 << 31, 0)], "id int, hi bigint, lo bigint")
    assert corpus.near_pair_count(prints).first()["pairs"] == 6 * 5 // 2 + 4 * 3 // 2 + 6 * 4


def test_trajectory_gates(spark):
    step = lambda a, e=(): {"rationale_summary": "because of it", "action": a, "arguments": {}, "observation": "seen", "evidence_ids": list(e)}
    good = {"seed_id": "s-train-1", "query": "q", "variant": "research", "steps": [step("search"), step("read_page", ["e1"]), step("answer", ["e1"])], "final_answer": "paris"}
    seeds = spark.createDataFrame([("s-train-1", "q", "en", "research", "paris", [("e1", "t", "in paris")])], "seed_id string, query string, language string, variant string, expected_answer string, evidence array<struct<evidence_id:string,title:string,text:string>>")
    raw = spark.createDataFrame([("s-train-1", json.dumps(good)), ("s-train-1", "{")], "seed_id string, text string")
    got = {r["gate"]: (r["value"], r["passed"], r["decision"]) for r in trajectories.quality_gate(trajectories.reasons(raw, seeds)).collect()}
    assert set(got) == set(trajectories.GATES) and got["accepted_records"][1:] == (False, "reject") and got["acceptance_rate"] == (pytest.approx(0.5), False, "reject")
    assert got["normalized_exact_rate"][:2] == (1.0, True) and got["exactly_one_answer_rate"][:2] == (1.0, True)
