"""Sharded runs, unique evidence and pair scores, on literal values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import sequence, shards


def test_balance_counts_null_and_missing_datasets(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "dataset string")
    expected = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "dataset string, expected long")
    assert sorted((r.dataset or "", r.n, r.expected) for r in shards.unbalanced(rows, expected, "dataset").collect()) == [("", 1, 0), ("b", 1, 2), ("c", 0, 1)]
    assert shards.unbalanced(rows.limit(0), expected.limit(0), "dataset").count() == 0


def test_settings_are_held_against_the_first_shard(spark):
    rows = spark.createDataFrame([(0, 8, None), (1, 8, "x"), (2, 9, None)], "shard int, steps int, version string")
    assert sorted(map(tuple, shards.setting_differences(rows, ["steps", "version"]).collect())) == [(1, "version"), (2, "steps")]


def test_a_merged_run_is_covered_and_ordered(spark):
    cases = spark.createDataFrame([("c", 1), ("a", 2)], "case_id string, position int")
    run = spark.createDataFrame([("a", "sft"), ("c", "base"), ("a", "base"), ("a", "base"), ("z", "sft")], "case_id string, mode string")
    found = shards.problems(run, cases, ["base", "sft"]).collect()
    assert sorted(map(tuple, found)) == [("base", "a", "repeated"), ("sft", "c", "missing"), ("sft", "z", "unexpected")]
    ordered = shards.in_order(run.distinct(), cases, ["base", "sft"]).orderBy("mode_no", "position").collect()
    assert [(r.mode, r.case_id) for r in ordered] == [("base", "c"), ("base", "a"), ("sft", "a")]


@pytest.mark.parametrize(("trained", "passed", "decision"), [(0.75, True, "eligible_for_rl"), (0.75, False, "hold_before_rl"), (0.52, True, "hold_before_rl")])
def test_trained_mode_must_gain_and_pass(spark, trained, passed, decision):
    rows = spark.createDataFrame([("base", 0.5, True), ("sft", trained, passed)], "mode string, exact_rate double, gate_passed boolean")
    assert shards.comparison(rows).first().decision == decision
    assert shards.comparison(rows.where("mode = 'sft'")).count() == 0


def test_unique_evidence_keeps_the_first_of_equal_hits(spark):
    hits = spark.createDataFrame([("q", "d1", 1.0, 1), ("q", "d2", 3.0, 2), ("q", "d1", 3.0, 3), ("q", "d1", 3.0, 4), ("q", "d3", None, 5), ("q", "d4", 0.5, 6)], "query string, doc string, score double, position int")
    out = shards.unique_evidence(hits, by="query", doc="doc", score="score", position="position", k=2).orderBy("rank").collect()
    assert [(r.doc, r.score, r.position) for r in out] == [("d1", 3.0, 3), ("d2", 3.0, 2)]


def test_pair_scores_are_finite_and_one_each(spark):
    pairs = spark.createDataFrame([(1, "q", "abc"), (2, "q", None), (3, None, "a")], "id int, q string, t string")
    score = lambda f: shards.pair_scores(pairs, f, keys=["id"], query=F.col("q"), text=F.col("t"))
    assert sorted(map(tuple, score(lambda q, ts: [len(q) + len(t) for t in ts]).collect())) == [(1, 4.0), (2, 1.0), (3, 1.0)]
    for bad in (lambda q, ts: np.zeros(len(ts) + 1), lambda q, ts: np.full(len(ts), np.nan)):
        with pytest.raises(Exception, match="scores|not finite"):
            score(bad).collect()


def test_shards_are_dealt_in_order(spark):
    rows = spark.range(1000).repartition(7)
    assert all(r.shard == r.id % 3 for r in sequence.shards(rows, order=["id"], n=3).collect())
    assert sequence.shards(rows.limit(0), order=["id"], n=3).count() == 0
