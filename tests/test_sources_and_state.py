"""Paged sources, stateful runs, evidence stores, replays and rules on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import evidence, replay, rules
from corvane.functions import ids as I
from corvane.sources import paged, readers, storage
from corvane.streaming import runs


def test_paged_source(spark):
    paged.register(spark, "numbers", "k int", lambda at, n: [(i,) for i in range(at, min(at + n, 250))], total=250, page=20, pages_per_task=3)
    df = paged.read(spark, "numbers")
    assert sorted(r["k"] for r in df.collect()) == list(range(250)) and df.rdd.getNumPartitions() == 5


def test_run_budgets_go_on_over_batches(spark, tmp_path):
    schema = "run_id string, kind string, cost double"
    for i, rows in enumerate(([("a", "step", 2.0), ("b", "step", 9.0)], [("a", "completed", 1.0), ("b", "step", 9.0)], [("a", "step", 50.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = runs.budgets(source, limit=10).writeStream.format("memory").queryName("budgets").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r["run_id"]: (r["status"], r["used"]) for r in spark.table("budgets").groupBy("run_id").agg(F.max(F.struct("events", "status", "used")).alias("x")).select("run_id", "x.*").collect()}
    assert last == {"a": ("completed", 3.0), "b": ("failed", 18.0)}


def test_documents_refresh_and_add(spark):
    rows = [("http://e.com/?utm_a=1", "x", 1), ("http://E.com", "x", 5), ("http://e.com", "y", 2), ("ftp://e.com", "x", 9)]
    docs = evidence.documents(spark.createDataFrame(rows, "url string, text string, fetched_at int"), ttl=F.lit(10))
    got = sorted((r["url"], r["text"], r["fetched_at"], r["expires_at"]) for r in docs.collect())
    assert got == [("http://e.com/", "x", 5, 15), ("http://e.com/", "y", 2, 12)]
    again = evidence.documents(spark.createDataFrame([("http://e.com/", "x", 7), ("http://f.com/", "z", 7)], "url string, text string, fetched_at int"), ttl=F.lit(10))
    assert sorted((r["text"], r["fetched_at"], r["created"]) for r in evidence.store(docs, again).collect()) == [("x", 7, False), ("y", 2, False), ("z", 7, True)]


def test_reads_under_a_budget(spark):
    rows = [(1, True, False, False), (2, False, True, False), (3, False, False, True), (4, True, False, False), (5, False, False, False)]
    out = evidence.read_status(spark.createDataFrame(rows, "rank int, cached boolean, failed boolean, seen boolean").withColumn("q", F.lit(1)), by=["q"], order=[F.col("rank")], budget=2)
    assert [r["status"] for r in out.orderBy("rank").collect()] == ["cached", "failed", "deduplicated", "cached", "not_read_budget"]
    assert evidence.run_metrics(out, ["q"]).first()["cached"] == 2


STEPS = "case_id string, step int, action string, query string, ids array<string>, final_answer string"
CASES = "case_id string, evidence array<string>, gold array<string>, expected_answer string, aliases array<string>"


def plain_replay(steps, known, gold, accepted, max_steps, least, need):
    """A case step by step."""
    found, read, judged, errors, cited, stop, said = set(), set(), set(), [], [], "max_steps", None
    unknown = invalid = short = n = 0
    for action, query, ids, answer in steps[:max_steps]:
        n, error = n + 1, None
        ids = list(dict.fromkeys(ids or []))
        if action is None:
            errors.append("invalid_policy_output")
            invalid, stop = invalid + 1, errors[-1]
            break
        if action == "answer":
            cited, strange = ids, [i for i in ids if i not in known]
            unknown += len(strange)
            checks = [(strange, "unknown_evidence_id"), (not ids, "missing_evidence_citation"), (set(ids) - read, "unread_evidence_id"), (len(read) < least, "insufficient_evidence_coverage"), (len(ids) < least, "insufficient_answer_citations"), (need and set(ids) - judged, "evidence_not_evaluated")]
            error = next((e for c, e in checks if c), None)
            invalid += error in ("missing_evidence_citation", "unread_evidence_id")
            short += error in replay.INSUFFICIENT
            stop = error or "completed"
            if not error:
                said = answer
                break
        elif action == "search":
            error = None if (query or "").strip() else "invalid_arguments"
            found |= set() if error else set(ids) & known
        elif action == "read_page":
            one = ids[0].strip() if ids else ""
            error = "unknown_evidence_id" if one not in known else "undiscovered_evidence_id" if one not in found else None
            read |= set() if error else {one}
        elif action == "evaluate_evidence":
            error = "invalid_arguments" if not ids else "unknown_evidence_id" if set(ids) - known else "unread_evidence_id" if set(ids) - read else None
            judged |= set() if error else set(ids)
        else:
            error = "action_not_executable"
        if error and action != "answer":
            unknown, invalid = unknown + ("evidence_id" in error), invalid + ("evidence_id" not in error)
        errors += [error] * bool(error)
    done = stop == "completed"
    recall = len(gold & (read | set(cited))) / len(gold) if gold else 1.0
    return (done, done and " ".join(sorted(set((said or "").lower().split()))) in accepted, stop, n, sorted(found), sorted(read), cited, unknown, invalid, short, len(errors) if done else 0, not done and stop in replay.FAILURES, recall)


@pytest.mark.parametrize("least,need", [(1, False), (2, True)])
def test_tool_logs_are_judged_as_step_by_step(spark, least, need):
    r = random.Random(least)
    cases, steps, want, codes = [], [], {}, set()
    for c in range(250):
        known, gold = {f"e{i}" for i in range(r.randint(1, 4))}, {f"e{i}" for i in range(r.randint(0, 3))}
        log = []
        for i in range(r.randint(0, 12)):
            action = r.choice(["search", "search", "read_page", "read_page", "evaluate_evidence", "answer", "answer", "dance", None if r.random() < 0.2 else "search"])
            ids = [f"e{r.randint(0, 4)}" for _ in range(r.choice([0, 1, 1, 2, 3]))]
            ids = r.choice([ids, sorted(known), sorted(known) * 2]) if action != "dance" else None
            log.append((action, r.choice(["q", "q", " ", None]), ids, r.choice(["The answer", "answer the", "no"])))
        want[f"c{c}"] = plain_replay(log, known, gold, {"answer the"}, 9, least, need)
        cases.append((f"c{c}", sorted(known), sorted(gold), "x", ["the ANSWER"]))
        steps += [(f"c{c}", i * 2, *s) for i, s in enumerate(log)]
    both = ["e0", "e1"]
    log = [("search", "q", both, None), ("answer", None, both, "no"), ("read_page", None, ["e0"], None), ("answer", None, ["e0"], "no"), ("read_page", None, ["e1"], None), ("answer", None, ["e0"], "no"), ("answer", None, both, "the answer")]
    want["d"] = plain_replay(log, set(both), set(both), {"answer the"}, 9, least, need)
    cases.append(("d", both, both, "x", ["the ANSWER"]))
    steps += [("d", i, *s) for i, s in enumerate(log)]
    log, known = spark.createDataFrame(steps, STEPS), spark.createDataFrame(cases, CASES)
    out = replay.results(log, known, max_steps=9, least_read=least, need_evaluated=need)
    got = {row["case_id"]: tuple(row)[1:] for row in out.collect()}
    assert got == want
    codes = {row["error"] for row in replay.judged(log, known, max_steps=9, least_read=least, need_evaluated=need).select("error").distinct().collect()}
    assert codes >= {None, "invalid_policy_output", "unknown_evidence_id", "undiscovered_evidence_id", "unread_evidence_id", "missing_evidence_citation", "invalid_arguments", "action_not_executable"}
    assert set(replay.INSUFFICIENT) <= codes if need else not set(replay.INSUFFICIENT) & codes
    row = replay.summary(out, []).first()
    done = sum(w[0] for w in want.values())
    assert (row["cases"], row["completed"], row["decision"], row["passed"]) == (251, done, "hold_before_rl", False) and row["completion_rate"] == pytest.approx(done / 251)
    with pytest.raises(Exception, match="at least one result"):
        replay.summary(out.limit(0), []).collect()


def test_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(rules.research_signals(F.lit("Compare the latest sources and links?"))) == ["explicit_evidence_request", "time_sensitive", "analysis_or_comparison", "multi_part"]
    assert one(rules.research_signals(F.lit("ＰＲＩＣＥ 以及 x"))) == ["time_sensitive", "multi_part"] and one(rules.research_signals(F.lit("hello"))) == []
    cats = {"What is BERT-2": "acronym", "cats or dogs": "multi-concept", "covid-19": "exact-term", "how cells grow": "semantic-paraphrase", "rates associated with": "multi-concept"}
    assert {q: one(rules.query_category(F.lit(q))) for q in cats} == cats
    assert one(rules.router(F.lit("{"))).asDict() == {"route": "evidence_research", "confidence": 0.0, "category": "invalid_output", "reason": "Invalid routing output defaulted safely to evidence research.", "final_answer": None, "signals": ["invalid_router_output"]}
    direct = one(rules.router(F.lit('{"route":"direct_answer","confidence":7,"category":"c","reason":" r ","final_answer":" x "}')))
    assert (direct["route"], direct["confidence"], direct["reason"], direct["final_answer"]) == ("direct_answer", 1.0, "r", "x")
    assert one(rules.router(F.lit('{"route":"direct_answer","confidence":-1}')))["route"] == "evidence_research"
    none = F.array().cast("array<string>")
    assert one(rules.route(F.lit("direct_answer"), F.lit("casual"), F.lit(0.9), none, F.lit("a")))["route"] == "direct_answer"
    assert one(rules.route(F.lit("direct_answer"), F.lit(""), F.lit(0.5), F.array(F.lit("s")), F.lit("a"))).asDict() == {"route": "evidence_research", "overridden": True, "blockers": ["s", "category:unknown", "confidence:0.50"]}
    assert one(rules.readiness(F.array(F.lit("ready"), F.lit("pending")))) == "pending"
    assert one(rules.plan(F.array(F.lit(" a "), F.lit(""), F.lit("b")))) == ["a", "b"] and one(rules.plan(F.array(F.lit("a")))) is None
    assert one(rules.bad_report_ids(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("b")))) == ["repeated_citation", "citation_not_allowed"]
    upload = lambda n, m="text/plain", size=1: one(rules.upload_error(F.lit(n), F.lit(m), F.lit(size), most=9))
    assert [upload("a.txt"), upload("C:\\x\\a.MD"), upload("a/"), upload(".txt"), upload(".."), upload("a.pdf"), upload("a.txt", None), upload("a.txt", "", 0), upload("a.txt", size=10), upload(None)] == [
        None, None, "unsupported_file_type", "unsupported_file_type", "invalid_filename", "mime_type_mismatch", None, "empty_file", "file_too_large", "missing_filename"]
    assert [one(rules.chunk_error(F.lit(a), F.lit(b))) for a, b in ((800, 120), (199, 1), (300, 300), (4000, 1001))] == [None, "invalid_chunk_size", "invalid_chunk_overlap", "invalid_chunk_overlap"]
    say = lambda *a: tuple(one(rules.advice(*map(F.lit, a))))
    assert [say(2, "multi_hop", 0, 0), say(5, "simple_fact", 1, 0), say(5, "comparison", 1, 0), say(5, None, 2, 1), say(5, None, 2, 2)] == [(1, False, True), (1, False, True), (2, False, False), (2, True, False), (2, False, False)]
    assert [one(rules.controller_advice(F.lit(n), F.lit(s))) for n, s in ((2, "x"), (5, "sufficient"), (5, "conflicting"), (5, "insufficient"))] == ["answer", "answer", "evaluate_evidence", "read_page"]
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert [one(rules.worker_error(F.lit(a), i, d, r)) for a, i, d, r in (("read_page", arr("a"), arr("a"), arr()), ("read_page", arr("b"), arr("a"), arr()), ("evaluate_evidence", arr(), arr(), arr("a")), ("evaluate_evidence", arr("b"), arr(), arr("a")), ("answer", arr("a"), arr(), arr("a", "b")), ("answer", arr("a"), arr(), arr("a")))] == [None, "unknown_evidence_id", None, "no_read_evidence", None, "insufficient_evidence"]


def test_more_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id":"b","text":"t"}\n\n{"_id":"a","title":"x","text":" "}\n')
    at = str(tmp_path / "c.jsonl")
    assert [tuple(r) for r in readers.read_corpus(spark, at).collect()] == [("a", "x", " "), ("b", "", "t")] and readers.read_corpus_ids(spark, at).count() == 2
    assert [tuple(r) for r in readers.read_queries(spark, at).collect()] == [("b", "t")]
    assert readers.read_optional(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    log = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert tuple(readers.status_line(log("2024\trunning\ta\tb")).first()) == ("2024", "running", ["a", "b"]) and readers.status_line(log()).first()["state"] == "not_started"
    devices = readers.read_devices(log("0, u0, 10", "1, u1, 900", "2, u2, 3"))
    assert [r["index"] for r in readers.idle_devices(devices, spark.createDataFrame([("u2",)], "uuid string")).collect()] == [0]
    names = ["model_world_size_2_rank_0.pt", "model_world_size_2_rank_1.pt", "optim_world_size_2_rank_0.pt", "optim_world_size_2_rank_1.pt", "extra_state_world_size_2_rank_0.pt", "extra_state_world_size_2_rank_1.pt", "data.pt", "huggingface"]
    files = spark.createDataFrame([("global_step_9", n) for n in names[:3]] + [("global_step_10", n) for n in names], "checkpoint string, name string")
    assert (lambda r: (r["step"], r["complete"]))(readers.latest_checkpoint(files).first()) == (10, True)
    got = readers.search_results(spark.createDataFrame([("q", [("t", "u", "s"), ("t", "", "s"), ("t", "v", "s")])], "query string, results array<struct<title:string,url:string,snippet:string>>"))
    assert [(r["rank"], r["url"]) for r in got.collect()] == [(1, "u"), (3, "v")]
    import hashlib

    key = spark.range(1).select(I.cache_key(F.lit("m/x"), F.lit("h"), F.lit(True)).alias("k")).first()["k"]
    assert key == hashlib.sha256(b'{"corpus_hash":"h","format_version":1,"model_name":"m/x","normalized":true}').hexdigest()[:24]
