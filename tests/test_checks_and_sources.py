"""Checks over nested runs, retries, append-only logs as streams, and row-making functions in SQL."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import tables
from corvane.operators import checks, chunk, retry
from corvane.sources import append_log
from corvane.streaming import events

GOOD = {
    "run_id": "r1", "status": "completed", "stop_reason": "completed", "plan": ["a", "b"], "subtasks": [{"subtask_id": "s1", "status": "completed"}, {"subtask_id": "s2", "status": "completed"}],
    "tool_calls": [{"status": "succeeded"}], "final_evidence_ids": ["e1", "e3"], "final_report": " " + "x" * 80, "checkpoint": {"stage": "report", "version": 3, "completed_stages": ["plan", "report"]},
    "evidence_assessments": [
        {"subtask_id": "s1", "attempt": 1, "sufficient": False, "evidence_ids": ["e9"]}, {"subtask_id": "s1", "attempt": 2, "sufficient": True, "evidence_ids": ["e1"]},
        {"subtask_id": "s2", "attempt": 1, "sufficient": False, "evidence_ids": []}, {"subtask_id": "s2", "attempt": 1, "sufficient": True, "evidence_ids": ["e3"]},
    ],
    "usage": {"agent_steps": 4, "search_calls": 1, "total_tokens": 10}, "errors": [],
}
STATUS, PAGE = {"ready": True, "workflow": "supervisor"}, "<a>运行 Runs</a> Console"
CHECKS = checks.acceptance(("运行 Runs", "Console"))


def gaps(spark, runs):
    """Failed checks of (status, created, persisted, page) each."""
    rows = [(i, *[json.dumps(x) if x is not None else None for x in r[:3]], r[3]) for i, r in enumerate(runs)]
    df = spark.createDataFrame(rows, "i int, status string, created string, persisted string, page string")
    records = {n: F.try_parse_json(n) for n in ("status", "created", "persisted")} | {"page": F.col("page")}
    out = checks.report(df, CHECKS, keys=["i"], records=records).orderBy("i").collect()
    assert all((r["status"] == "complete") == (not r["gaps"]) and r["checks"].keys() == CHECKS.keys() and [n for n in CHECKS if not r["checks"][n]] == r["gaps"] for r in out)
    return [r["gaps"] for r in out]


def test_every_acceptance_check(spark):
    spoilt = {
        "run_completed": {"stop_reason": "max_steps"}, "plan_created": {"plan": ["a"]}, "subtasks_completed": {"subtasks": [{"subtask_id": "s1", "status": "completed"}, {"subtask_id": "s2"}]},
        "tools_succeeded": {"tool_calls": [{"status": "failed"}]}, "evidence_sufficient": {"evidence_assessments": GOOD["evidence_assessments"][:1] + [{"subtask_id": "s2", "attempt": 0, "evidence_ids": ["e1", "e3"], "sufficient": True}]},
        "evidence_allowlist": {"final_evidence_ids": ["e9"]}, "final_report_present": {"final_report": "x" * 79 + "  "}, "checkpoint_completed": {"checkpoint": {"stage": "report", "completed_stages": ["plan"]}},
        "usage_recorded": {"usage": {"agent_steps": 4, "search_calls": 2, "total_tokens": 10}}, "no_runtime_errors": {"errors": ["x"]},
    }
    runs = [(STATUS, GOOD, GOOD, PAGE), (STATUS, GOOD, GOOD, None), ({"ready": "true", "workflow": "x"}, GOOD, GOOD, "Console"), (STATUS, GOOD, GOOD | {"run_id": "r2"}, PAGE)]
    runs += [(STATUS, GOOD | change, GOOD | change, PAGE) for change in spoilt.values()]
    found = gaps(spark, runs)
    assert found[:4] == [[], [], ["api_ready", "supervisor_workflow", "web_control_surface"], ["persistence_round_trip"]]
    for name, got in zip(spoilt, found[4:], strict=True):
        extra = {"evidence_sufficient": {"evidence_allowlist"}}.get(name, set())
        assert name in got and set(got) <= {name} | extra, name
    assert set(gaps(spark, [(None, None, None, None), ({}, [], 3, "")])[1]) >= {"api_ready", "plan_created", "final_report_present", "web_control_surface"}


def test_checks_are_one_projection(spark, tmp_path):
    spark.createDataFrame([("{}", "{}", "{}", "")], "status string, created string, persisted string, page string").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    plan = checks.report(rows, CHECKS, keys=["page"], records={n: F.try_parse_json(n) for n in ("status", "created", "persisted")} | {"page": F.col("page")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_snapshot_keeps_what_there_is(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, 5), (3, 6)], "k int, n int")
    got = {r["k"]: (r["a"] and r["a"]["v"], r["b"] and r["b"]["n"]) for r in checks.snapshot({"a": a, "b": b}, "k").collect()}
    assert got == {1: ("x", None), 2: ("y", 5), 3: (None, 6)}


def test_retries_give_the_same_rows(spark):
    def rows():
        def flaky():
            tried = {}

            def call(v):
                tried[v] = tried.get(v, 0) + 1
                if tried[v] <= int(v) % 5:
                    raise TimeoutError(v)
                return f"ok {v}"

            return call

        df = spark.range(40).select("id", F.when(F.col("id") != 7, F.col("id").cast("string")).alias("v")).repartition(3)
        call = flaky()
        return {r["id"]: tuple(r)[1:] for r in retry.with_retries(df, call, key="id", value="v", pause=0.001).collect()}

    want = {i: (f"ok {i}", None, i % 5 + 1) if i % 5 < 3 else (None, "TimeoutError", 3) for i in range(40)} | {7: (None, None, 0)}
    assert rows() == rows() == want
    waits = []
    with pytest.raises(ValueError):
        retry.with_retries(spark.range(1), str, key="id", value="id", attempts=0)
    assert waits == []


def test_append_logs_go_on_where_they_were(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    r = random.Random(3)
    lines = [f'{{"n": {i}, "text": "{"é" * r.randint(0, 40)}"}}' for i in range(300)]
    a, b = (log / "a.jsonl").open("w"), (log / "b.jsonl").open("w")

    def take():
        events.run_available(append_log.read(spark, str(log), range_bytes=500), f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted(json.loads(x["value"])["n"] for x in spark.read.parquet(f"{tmp_path}/out").collect())

    a.write("\n".join(lines[:100]) + "\n" + lines[100][:9])
    a.flush()
    assert take() == list(range(100)) and take() == list(range(100))
    a.write(lines[100][9:] + "\n" + "\n".join(lines[101:200]) + "\n")
    b.write("\r\n".join(lines[200:]) + "\r\n")
    a.close(), b.close()
    assert take() == list(range(300))
    (log / ".hidden").write_text("x\n")
    assert take() == list(range(300))


def test_functions_in_sql(spark):
    tables.register(spark)
    r = random.Random(1)
    texts = [" ".join(f"word{r.randint(0, 99)}{r.choice(['', '.', ',', chr(10)])}" for _ in range(r.randint(0, 600))) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    df.createOrReplaceTempView("chunk_me")
    got = spark.sql("SELECT d.doc_id, c.chunk_index, c.text FROM chunk_me d, LATERAL chunk_text(d.text, 400, 50) c").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, chunk.chunks(df, size=400, overlap=50).collect()))
    got = spark.sql("SELECT d.doc_id, p.* FROM chunk_me d, LATERAL web_passages(d.text, 300, 20) p").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, chunk.web_passages(df, size=300, overlap=20).collect()))
    with pytest.raises(Exception, match="invalid_chunk_size"):
        spark.sql("SELECT * FROM chunk_text('a', 1, 0)").collect()
