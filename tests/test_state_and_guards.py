"""Streams with state against their batch forms, over restarts; versions, stored vectors, guards and canonical JSON."""

import hashlib
import json
import random
from threading import Barrier, Thread

import pytest
from pyspark.sql import functions as F

from corvane.functions import canonical
from corvane.functions import ids as I
from corvane.operators import guards, observations
from corvane.sources import vectors, versions
from corvane.streaming import events, runs, state

HOUR = 3600 * 10**6
KEYED = "key string, seq bigint, at bigint, document string, stage string, error string"


@pytest.fixture(scope="module")
def keyed():
    r = random.Random(4)
    at = sorted(r.randrange(0, 200 * HOUR) for _ in range(600))
    return [(f"k{r.randint(0, 12)}", i, t, r.choice([None, "a", "b", "c"]), r.choice(["read", "cut", "stored", "done", "failed", "odd"]), None) for i, t in enumerate(at)]


def over_restarts(spark, tmp_path, rows, made, parts=4):
    """The stream's output after each part of the rows was taken by a call of its own, going on from the one before."""
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(KEYED).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_micros("at"))
    n = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * n : (k + 1) * n], KEYED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events.run_available(made(source), f"{tmp_path}/out", f"{tmp_path}/state")
    return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)


def test_cache_expires_and_refreshes(spark, tmp_path, keyed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STORE)
    got = over_restarts(spark, tmp_path, keyed, lambda s: state.cached(s, ttl=6 * HOUR))
    want = state.cached_as_of(spark.createDataFrame(keyed, KEYED), ttl=6 * HOUR)
    assert got == sorted(map(tuple, want.collect()), key=str)
    plain, held = [], {}
    for key, seq, at, document, *_ in keyed:
        mine = {d: t for d, t in held.get(key, {}).items() if at < t + 6 * HOUR}
        if document:
            plain.append((key, seq, at, "refreshed" if document in mine else "created", document, at))
            held.setdefault(key, {})[document] = at
        else:
            best = max(mine.items(), key=lambda x: x[1], default=None)
            plain.append((key, seq, at, *(("hit", *best) if best else ("miss", None, None))))
    assert got == sorted(plain, key=str) and {"hit", "miss", "created", "refreshed"} == {x[3] for x in got}


def test_stages_time_out_and_refuse_steps_back(spark, tmp_path, keyed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STORE)
    progress, limit = {"read": 25, "cut": 50, "stored": 75, "done": 100}, 20 * HOUR
    got = over_restarts(spark, tmp_path, keyed, lambda s: state.staged(s, progress=progress, limit=limit))
    want = state.staged_as_of(spark.createDataFrame(keyed, KEYED), progress=progress, limit=limit, now=F.lit(keyed[-1][2] // 1000))
    assert got == sorted(map(tuple, want.collect()), key=str)
    plain = {}
    for key, seq, at, _, stage, error in keyed:
        mine = plain.setdefault(key, [])
        if mine and mine[-1][4] == 100:
            continue
        if mine and at > mine[-1][2] + limit:
            mine.append((key, -1, mine[-1][2] + limit, "failed", 100, "stage_timeout"))
        elif stage == "failed" or progress.get(stage, -1) > (mine[-1][4] if mine else -1):
            mine.append((key, seq, at, stage, progress.get(stage, 100), error))
    assert [x for x in got if x[1] >= 0] == sorted((x for m in plain.values() for x in m if x[1] >= 0), key=str)
    assert {x[:3] for x in got if x[1] < 0} >= {x[:3] for m in plain.values() for x in m if x[1] < 0} and any(x[1] < 0 for x in got)


def test_runs_resume_after_a_crash_and_a_cancel(spark, tmp_path):
    for k in range(5):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink, control, calls = f"{tmp_path}/sink", f"{tmp_path}/control", []

    def work(batch, crash_at=None, cancel_at=None):
        calls.append(batch.count())
        if len(calls) == cancel_at:
            runs.request_cancel(batch.sparkSession, control, "r1")
        return batch.select("id", F.when(F.lit(len(calls) == crash_at), F.raise_error(F.lit("lost"))).cast("int").alias("x"))

    go = lambda **k: runs.run_batches(source, lambda b: work(b, **k), run="r1", stage="reading", sink=sink, control=control)
    with pytest.raises(Exception, match="lost"):
        go(crash_at=3)
    assert runs.results(spark, sink, "r1", "id bigint").count() == 20
    assert go(cancel_at=5) == "cancelled" and go() == "cancelled"
    done = runs.progress(spark, control, "r1").orderBy("version").collect()
    assert [(r["version"], r["rows"], r["batch"]) for r in done] == [(k + 1, 10, k) for k in range(len(done))] and len(done) < 5
    runs.withdraw_cancel(spark, control, "r1")
    assert go() == "completed" and go() == "completed"
    assert sorted(r["id"] for r in runs.results(spark, sink, "r1", "id bigint").collect()) == list(range(50))
    assert runs.progress(spark, control, "r1").count() == 5


def test_one_of_two_publishers_wins(spark, tmp_path):
    root = str(tmp_path / "idx")
    with pytest.raises(ValueError):
        versions.snapshot(spark, root)
    assert versions.publish(spark.range(3).toDF("k"), root) == 1
    held, barrier, ends = versions.snapshot(spark, root), Barrier(2), []

    def race(n):
        barrier.wait()
        try:
            ends.append((versions.publish(spark.range(n).toDF("k"), root, after=1), n))
        except versions.ConcurrentPublish:
            ends.append((None, n))

    both = [Thread(target=race, args=(n,)) for n in (5, 7)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    (won,) = [n for v, n in ends if v == 2]
    assert sorted(v or 0 for v, _ in ends) == [0, 2]
    assert versions.snapshot(spark, root).count() == won and held.count() == 3 and versions.snapshot(spark, root, 1).count() == 3
    assert versions.publish(spark.range(100, 102).toDF("k"), root, add=True) == 3
    assert versions.snapshot(spark, root).count() == won + 2
    bad = spark.range(2).select(F.raise_error(F.lit("no")).cast("long").alias("k"))
    with pytest.raises(Exception, match="no"):
        versions.publish(bad, root)
    assert versions.latest_version(spark, root) == 3
    assert len(versions.retire(spark, root, keep=1)) == 1 and versions.snapshot(spark, root).count() == won + 2


def test_only_changed_chunks_are_embedded(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def embed(text):
        def one(t):
            asked.add(1)
            return [0.0, 0.0] if "void" in t else [float(len(t)), 1.0]

        return F.udf(one, "array<float>")(text)

    chunks = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.concat(F.lit("text "), "id").alias("text"))
    go = lambda df: {r["id"]: r for r in vectors.refresh(df, str(tmp_path), model="m", embed=embed, dimension=2, most_parts=3).collect()}
    first = go(chunks)
    assert len(first) == 300 and {r["built"] for r in first.values()} == {1} and asked.value == 300
    assert abs(sum(x * x for x in first["7"]["vector"]) - 1) < 1e-6
    changed = chunks.withColumn("text", F.when(F.col("id").cast("int") % 100 == 7, "new").otherwise(F.col("text")))
    second = go(changed)
    assert {k for k, r in second.items() if r["built"] == 2} == {"7", "107", "207"} and asked.value == 303
    assert {r["built"] for r in go(changed.where("id < '2'")).values()} == {1, 2} and asked.value == 303
    merged = go(chunks)  # the old texts again: their rows were replaced
    assert {k for k, r in merged.items() if r["built"] == 4} == {"7", "107", "207"} and asked.value == 306
    root = vectors.root_of(str(tmp_path), "m")
    assert len(versions.folders(spark, root, 4)) == 1 and spark.read.parquet(*versions.folders(spark, root, 4)).count() == 300
    with pytest.raises(Exception, match="no usable vector for chunk x"):
        go(spark.createDataFrame([("x", "t", "void")], "id string, title string, text string"))
    with pytest.raises(Exception, match="chunk id comes twice: y"):
        go(spark.createDataFrame([("y", "t", "a"), ("y", "t", "b")], "id string, title string, text string"))
    assert versions.latest_version(spark, root) == 4


def test_guards_fail_with_the_key(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    right = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, w string")
    assert sorted(map(tuple, guards.strict_join(left, right, ["id"]).collect())) == [("a", 1, "x"), ("b", 2, "y")]
    with pytest.raises(Exception, match="missing seed: b"):
        guards.strict_join(left, right.where("id <> 'b'"), ["id"], what="seed").count()
    with pytest.raises(Exception, match="repeated key: a"):
        guards.strict_join(left, right.union(right.limit(1)), ["id"]).collect()
    assert {r["n"] for r in guards.strict_lookup(left, right, key="id", value="w", name="n").collect()} == {"x", "y"}
    with pytest.raises(Exception, match="missing passage: null"):
        guards.strict_lookup(left.union(spark.createDataFrame([(None, 3)], left.schema)), right, key="id", value="w", name="n", what="passage").collect()
    cases = spark.createDataFrame([("1", "test", True), ("2", "test", False), ("3", "dev", False)], "case_id string, split string, reviewed boolean")
    with pytest.raises(Exception, match="not reviewed: 2"):
        guards.formal(cases, split="test").count()
    assert guards.formal(cases.where("case_id <> '2'"), split="test").count() == 1
    drafts = spark.createDataFrame([("Draft",), ("reviewed",), (None,)], "review_status string")
    assert [r[0] for r in guards.without_drafts(drafts).collect()] == ["reviewed"]
    counted = guards.Counted(cases.where("split = 'none'"), n=F.count(F.lit(1)))
    assert counted.rows.collect() == []
    with pytest.raises(ValueError, match="no cases"):
        counted.check(lambda c: c["n"] > 0, "no cases")


def test_guards_add_no_scan(spark, tmp_path):
    spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("v")).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    plan = guards.must(rows, F.col("v") == 1, F.lit("x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    joined = guards.strict_join(rows, rows.withColumnRenamed("v", "w"), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert joined.count("FileScan") == 2


NAMES = ["a", "é", "日本", "😀", 'q"uote', "back\\slash", "tab\t", "\x01\x1f", "x:y, z", "", " ", "/", "\x7f", "{["]
NUMBERS = [0, -7, 12345678901234, 1.5, 0.1, -2.0, 1e-7, 1e22, 3.14159, 100.0, 1e16, 123456.789, 0.0001, 1.7976931348623157e308]


def value(r, depth=0):
    if depth > 3 or (k := r.random()) < 0.5:
        return r.choice([None, True, False, *NUMBERS, *NAMES])
    if k < 0.75:
        return [value(r, depth + 1) for _ in range(r.randint(0, 4))]
    return {r.choice(NAMES) + str(i): value(r, depth + 1) for i in range(r.randint(0, 4))}


def test_canonical_json_is_that_of_python(spark):
    r = random.Random(1)
    values = [value(r) for _ in range(400)]
    rows = [(i, json.dumps(v, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))) for i, v in enumerate(values)]
    t = F.col("t")
    out = spark.createDataFrame(rows, "i int, t string").select("i", canonical.canonical(t), canonical.canonical(t, item=",", key=":", ascii_only=True), canonical.spaced(t), canonical.fingerprint(t, 24))
    for i, *got in out.collect():
        v = values[i]
        compact = json.dumps(v, sort_keys=True, separators=(",", ":"))
        assert got == [json.dumps(v, sort_keys=True, ensure_ascii=False), compact, json.dumps(v, ensure_ascii=False), hashlib.sha256(compact.encode()).hexdigest()[:24]]
    one = spark.range(1).select(canonical.canonical(F.lit("{")), canonical.canonical(F.lit(None).cast("string")), I.trajectory_hash(F.lit('[{"b": 1, "a": "é"}]'))).first()
    assert one[:2] == (None, None) and one[2] == hashlib.sha256('[{"a": "é", "b": 1}]'.encode()).hexdigest()


def plain_bounded(o, most):
    text = json.dumps(o, ensure_ascii=False)
    if len(text) <= most:
        return text
    head = {"query": str(o.get("query", ""))[:500], "_context_truncated": True, "_original_character_count": len(text), "_content_sha256": hashlib.sha256(text.encode()).hexdigest()}
    take = lambda x, fields, n=None: {f: x[f][:n] if f == "content" else x[f] for f in fields if f in x}
    lists = {f: [x for x in (v if f == "evidence" else v[:10]) if isinstance(x, dict)] for f in ("evidence", "hits") if isinstance(v := o.get(f, []), list)}
    failures = {"failures": o["failures"][:10]} if isinstance(o.get("failures"), list) else {}
    room = max(min(most // max(len(o.get("evidence", [])), 1) // 2, 2000), 128) if isinstance(o.get("evidence", []), list) else 128
    full = head | {f: [take(x, observations.EVIDENCE, room) if f == "evidence" else take(x, observations.HIT, 1000) for x in v] for f, v in lists.items()} | failures
    small = head | {"evidence": [take(x, observations.IDS) for x in lists.get("evidence", [])]} | failures
    return next((t for x in (full, small) if len(t := json.dumps(x, ensure_ascii=False)) <= most), json.dumps(head, ensure_ascii=False))


def test_observations_fit(spark):
    r = random.Random(8)
    item = lambda: {f: r.choice(["x", "é" * 30, 3, None, 0.5]) if f != "content" else r.choice(["short", "long, \"words\" " * r.randint(1, 300)]) for f in r.sample(observations.EVIDENCE + ["other"], r.randint(0, 8))}
    found = []
    for _ in range(120):
        o = {"query": "q" * r.choice([1, 700])} if r.random() < 0.8 else {}
        for f, n in (("evidence", 30), ("hits", 14), ("failures", 12)):
            if r.random() < 0.7:
                o[f] = [item() if r.random() < 0.9 else "no object" for _ in range(r.randint(0, r.choice([2, n])))] if r.random() < 0.9 else {"no": "list"}
        found.append(o)
    kept = set()
    for most in (1200, 6000):
        rows = spark.createDataFrame([(i, json.dumps(o, ensure_ascii=False)) for i, o in enumerate(found)], "i int, t string")
        for i, text in rows.select("i", observations.bounded(F.col("t"), most)).collect():
            want = plain_bounded(found[i], most)  # but for the order of keys in objects kept whole
            assert len(text) == len(want) <= most and json.loads(text) == json.loads(want) and list(json.loads(text)) == list(json.loads(want)), i
            kept.add(tuple(json.loads(text)))
    assert len(kept) > 5
    assert spark.range(1).select(observations.bounded(F.lit("no json"), 2000)).first()[0] is None
