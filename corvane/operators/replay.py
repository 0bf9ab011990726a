"""Recorded tool use judged step by step: which steps were allowed, why others were not, and how each case ended.

What a step may do depends on what earlier steps achieved, and each kind only on kinds before it: reading needs a search that found
the id, evaluating needs a reading, an answer needs both. So the first step that found, read or evaluated each id is a minimum over
the case, one kind after another, and no case is replayed in a loop. All windows lie within a case: one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluate import ratio

# The actions; errors that end a case without an answer as failures of the protocol; bounds of the summary's gate.
SEARCH, READ, EVALUATE, ANSWER = "search", "read_page", "evaluate_evidence", "answer"
BROKEN = "invalid_policy_output"
INSUFFICIENT = ("insufficient_evidence_coverage", "insufficient_answer_citations", "evidence_not_evaluated")
FAILURES = (BROKEN, "unknown_evidence_id", "missing_evidence_citation", "unread_evidence_id", *INSUFFICIENT)
LEAST_EXACT, LEAST_COMPLETED, LEAST_RECALL = 0.50, 0.95, 0.90


def step_error(action: Column, wanted: Column, unknown: Column, unfound: Column, unread: Column, unjudged: Column, read_before: Column, *, least_read: int, need_evaluated: bool, query: Column) -> Column:
    """The error of a step, the first that applies; null if it was allowed. The counts are of the ids it names."""
    answer = (
        F.when(unknown > 0, "unknown_evidence_id").when(wanted == 0, "missing_evidence_citation").when(unread > 0, "unread_evidence_id")
        .when(read_before < least_read, "insufficient_evidence_coverage").when(wanted < least_read, "insufficient_answer_citations")
    )
    answer = answer.when(unjudged > 0, "evidence_not_evaluated") if need_evaluated else answer
    read = F.when(unknown > 0, "unknown_evidence_id").when(unfound > 0, "undiscovered_evidence_id")
    evaluate = F.when(wanted == 0, "invalid_arguments").when(unknown > 0, "unknown_evidence_id").when(unread > 0, "unread_evidence_id")
    search = F.when(F.coalesce(F.trim(query), F.lit("")) == "", "invalid_arguments")
    return F.when(action.isNull(), BROKEN).when(action == ANSWER, answer).when(action == READ, read).when(action == EVALUATE, evaluate).when(action == SEARCH, search).otherwise("action_not_executable")


def judged(steps: DataFrame, cases: DataFrame, *, max_steps: int = 8, least_read: int = 1, need_evaluated: bool = False) -> DataFrame:
    """steps (case_id, step, action, query, ids, final_answer), cases (case_id, evidence) -> each step that counts, with its error.

    ids are what a step names; of a search, what it found. Known are those in the case's evidence. Steps count up to max_steps, up
    to one without an action (what the policy said was no action) and up to the first answer allowed. Columns besides: n (1, 2, …),
    ids (distinct), unknown (named ids that are not known), first (ids that this step found, read or evaluated first).
    """
    case = Window.partitionBy("case_id")
    rows = steps.repartition("case_id").withColumn("n", F.row_number().over(case.orderBy("step"))).where(F.col("n") <= max_steps)
    rows = rows.withColumn("broken", F.min(F.when(F.col("action").isNull(), F.col("n"))).over(case)).where("broken IS NULL OR n <= broken")
    named = F.array_distinct(F.coalesce("ids", F.array().cast("array<string>")))
    rows = rows.withColumn("ids", F.when(F.col("action") == READ, F.array(F.coalesce(F.trim(F.get(named, F.lit(0))), F.lit("")))).otherwise(named))
    rows = rows.join(cases.select("case_id", "evidence"), "case_id")
    each = rows.select("case_id", "n", "action", F.col("query"), F.explode_outer("ids").alias("id"), "evidence").withColumn("known", F.coalesce(F.array_contains("evidence", F.col("id")), F.lit(False)))
    mine, here = Window.partitionBy("case_id", "id"), Window.partitionBy("case_id", "n")
    searched = (F.col("action") == SEARCH) & F.col("known") & (F.coalesce(F.trim("query"), F.lit("")) != "")
    first = lambda ok: F.min(F.when(ok & F.col("id").isNotNull(), F.col("n"))).over(mine)
    before = lambda c: F.coalesce(F.col(c) < F.col("n"), F.lit(False))
    each = each.withColumn("found_at", first(searched)).withColumn("read_at", first((F.col("action") == READ) & F.col("known") & before("found_at")))
    whole = F.min((F.col("known") & before("read_at")).cast("int")).over(here) == 1
    each = each.withColumn("whole", whole).withColumn("judged_at", first((F.col("action") == EVALUATE) & F.col("whole")))
    is_id = F.col("id").isNotNull()
    counted = each.groupBy("case_id", "n").agg(
        F.count("id").alias("wanted"), F.count_if(is_id & ~F.col("known")).alias("unknown"), F.count_if(is_id & ~before("found_at")).alias("unfound"), F.count_if(is_id & ~before("read_at")).alias("unread"),
        F.count_if(is_id & ~before("judged_at")).alias("unjudged"), F.count_if(F.col("read_at") == F.col("n")).alias("newly_read"),
        F.collect_set(F.when(F.col("n").isin(F.col("found_at"), F.col("read_at"), F.col("judged_at")), F.col("id"))).alias("first"),
    )
    out = rows.drop("evidence", "broken").join(counted, ["case_id", "n"])
    read_before = F.coalesce(F.sum("newly_read").over(case.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    error = step_error(*map(F.col, ("action", "wanted", "unknown", "unfound", "unread", "unjudged")), F.col("read_before"), least_read=least_read, need_evaluated=need_evaluated, query=F.col("query"))
    out = out.withColumn("read_before", read_before).withColumn("error", error)
    done = F.min(F.when((F.col("action") == ANSWER) & F.col("error").isNull(), F.col("n"))).over(case)
    return out.withColumn("done", done).where("done IS NULL OR n <= done").drop("done", "wanted", "unfound", "unread", "unjudged", "newly_read", "read_before")


def results(steps: DataFrame, cases: DataFrame, *, max_steps: int = 8, least_read: int = 1, need_evaluated: bool = False) -> DataFrame:
    """steps as for `judged`, cases (case_id, evidence, gold, expected_answer, aliases) -> one result a case.

    (case_id, completed, answer_exact, stop_reason, steps, discovered, read, cited, unknown_ids, invalid_actions, insufficient,
    recovered, protocol_failure, recall). Cited are the ids of the last answer tried. The stop reason is `completed`, else
    invalid_policy_output, else the error of the last answer, else max_steps. A case without steps has none of everything.
    """
    each = judged(steps, cases, max_steps=max_steps, least_read=least_read, need_evaluated=need_evaluated)
    answer, failed = F.col("action") == ANSWER, F.col("error").isNotNull()
    strange = F.contains("error", F.lit("evidence_id"))
    last = lambda c: F.max_by(c, F.when(answer, F.col("n")))
    flat = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
    found = each.groupBy("case_id").agg(
        F.count(F.lit(1)).cast("int").alias("steps"), flat(F.when(F.col("action") == SEARCH, F.col("first"))).alias("discovered"), flat(F.when(F.col("action") == READ, F.col("first"))).alias("read"),
        F.coalesce(last("ids"), F.array().cast("array<string>")).alias("cited"), last("error").alias("last_error"), last("final_answer").alias("said"),
        F.max(answer.cast("int")).alias("tried"), F.max(F.col("action").isNull().cast("int")).alias("broke"), F.count_if(failed).alias("failed"),
        F.sum(F.when(answer, F.col("unknown")).otherwise((failed & strange).cast("long"))).alias("unknown_ids"),
        F.count_if(F.when(answer, F.col("error").isin("missing_evidence_citation", "unread_evidence_id")).otherwise(failed & ~strange)).alias("invalid_actions"),
        F.count_if(answer & F.col("error").isin(*INSUFFICIENT)).alias("insufficient"),
    )
    none = F.array().cast("array<string>")
    out = cases.join(found, "case_id", "left")
    completed = F.coalesce((F.col("tried") == 1) & F.col("last_error").isNull() & (F.col("broke") == 0), F.lit(False))
    stop = F.when(completed, "completed").when(F.col("broke") == 1, BROKEN).when(F.col("last_error").isNotNull(), F.col("last_error")).otherwise("max_steps")
    accepted = T.answer_keys(F.concat(F.array(F.coalesce("expected_answer", F.lit(""))), F.coalesce("aliases", none)))
    list_of = lambda c: F.coalesce(c, none)
    gold = F.array_distinct(F.coalesce("gold", none))
    covered = F.size(F.array_intersect(gold, F.concat(list_of("read"), list_of("cited"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.withColumn("completed", completed).withColumn("stop_reason", stop).withColumn("key", T.answer_key(F.coalesce("said", F.lit("")))).withColumn("accepted", accepted)
    return out.select(
        "case_id", "completed", (F.col("completed") & F.array_contains("accepted", F.col("key"))).alias("answer_exact"), "stop_reason", F.coalesce("steps", F.lit(0)).alias("steps"),
        list_of("discovered").alias("discovered"), list_of("read").alias("read"), list_of("cited").alias("cited"), zero("unknown_ids").alias("unknown_ids"), zero("invalid_actions").alias("invalid_actions"),
        zero("insufficient").alias("insufficient"), F.when(F.col("completed"), zero("failed")).otherwise(0).cast("long").alias("recovered"),
        (~F.col("completed") & F.col("stop_reason").isin(*FAILURES)).alias("protocol_failure"), F.when(F.size(gold) > 0, covered / F.size(gold)).otherwise(1.0).alias("recall"),
    )


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of results, and the gate: its checks and whether all hold. Without results: an error, unless grouped."""
    n = F.count(F.lit(1))
    out = results.groupBy(*by).agg(
        n.alias("cases"), F.count_if("completed").alias("completed"), ratio(F.count_if("completed"), n).alias("completion_rate"), F.count_if("answer_exact").alias("answer_exact"),
        ratio(F.count_if("answer_exact"), n).alias("answer_exact_rate"), F.sum("unknown_ids").alias("unknown_ids"), F.sum("invalid_actions").alias("invalid_actions"), F.sum("insufficient").alias("insufficient"),
        F.sum("recovered").alias("recovered"), F.count_if("protocol_failure").alias("protocol_failures"), F.avg("steps").alias("mean_steps"), F.avg("recall").alias("mean_recall"),
    )
    checks = F.struct(
        (F.col("answer_exact_rate") >= LEAST_EXACT).alias("answer_exact"), (F.col("completion_rate") >= LEAST_COMPLETED).alias("completion"), (F.col("unknown_ids") == 0).alias("no_unknown_ids"),
        (F.col("invalid_actions") == 0).alias("no_invalid_actions"), (F.col("protocol_failures") == 0).alias("no_protocol_failures"), (F.col("mean_recall") >= LEAST_RECALL).alias("recall"),
    )
    some = F.when(F.col("cases") > 0, checks).otherwise(F.raise_error(F.lit("a summary needs at least one result")))
    out = out.withColumn("checks", some)
    held = F.forall(F.array(*[F.col(f"checks.{c}") for c in ("answer_exact", "completion", "no_unknown_ids", "no_invalid_actions", "no_protocol_failures", "recall")]), lambda c: c)
    return out.withColumn("passed", held).withColumn("decision", F.when(F.col("passed"), "eligible_for_rl").otherwise("hold_before_rl"))
