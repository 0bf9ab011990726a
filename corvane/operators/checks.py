"""Named checks over nested records: each a condition on typed paths of VARIANT columns, all evaluated in one pass.

A table of checks is a dictionary from names to functions of the records' paths. The report has a row a record: every check's
outcome, the gaps, and whether the record is complete. What is missing or of another type fails its check and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The least plan and report of a finished run.
LEAST_PLAN, LEAST_REPORT = 2, 80


class At:
    """Typed paths into a VARIANT column; null where there is nothing of that type."""

    def __init__(self, value: Column):
        self.value = value

    def get(self, path: str, kind: str) -> Column:
        return F.try_variant_get(self.value, f"$.{path}", kind)

    def text(self, path: str) -> Column:
        return self.get(path, "string")

    def number(self, path: str) -> Column:
        return self.get(path, "double")

    def flag(self, path: str) -> Column:
        return F.when(F.schema_of_variant(self.get(path, "variant")) == "BOOLEAN", self.get(path, "boolean"))

    def items(self, path: str) -> Column:
        return F.coalesce(self.get(path, "array<variant>"), F.array().cast("array<variant>"))

    def texts(self, path: str) -> Column:
        return F.coalesce(self.get(path, "array<string>"), F.array().cast("array<string>"))

    def same(self, path: str, other: At) -> Column:
        return F.to_json(self.get(path, "variant")).eqNullSafe(F.to_json(other.get(path, "variant")))


Check = Callable[[dict[str, At]], Column]


def every(items: Column, condition: Callable[[Column], Column]) -> Column:
    """At least one, and the condition for each."""
    return (F.size(items) > 0) & F.forall(items, lambda x: F.coalesce(condition(x), F.lit(False)))


def field(item: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, f"$.{path}", kind)


def latest_assessments(assessments: Column) -> Column:
    """The last attempt of each subtask, the later entry of equal attempts: sorted once, then the last of each."""
    rows = F.transform(assessments, lambda x, i: F.struct(
        F.coalesce(field(x, "subtask_id"), F.lit("")).alias("subtask"), F.coalesce(field(x, "attempt", "int"), F.lit(0)).alias("attempt"), i.alias("i"),
        F.coalesce(field(x, "sufficient", "boolean"), F.lit(False)).alias("sufficient"), F.coalesce(field(x, "evidence_ids", "array<string>"), F.array().cast("array<string>")).alias("ids"),
    ))
    in_order = F.array_sort(rows)
    last = lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1)["subtask"] != x["subtask"], F.lit(True)))
    return F.element_at(F.transform(F.array(in_order), last), 1)




#: What an end-to-end run must show: `status` of the service, the run as `created` and as `persisted`.
ACCEPTANCE: dict[str, Check] = {
    "api_ready": lambda r: r["status"].flag("ready"),
    "supervisor_workflow": lambda r: r["status"].text("workflow") == "supervisor",
    "run_completed": lambda r: (r["created"].text("status") == "completed") & (r["created"].text("stop_reason") == "completed"),
    "plan_created": lambda r: F.size(r["created"].items("plan")) >= LEAST_PLAN,
    "subtasks_completed": lambda r: every(r["created"].items("subtasks"), lambda x: field(x, "status") == "completed"),
    "tools_succeeded": lambda r: every(r["created"].items("tool_calls"), lambda x: field(x, "status") == "succeeded"),
    "evidence_sufficient": lambda r: (F.size(_latest(r)) == F.size(r["created"].items("subtasks"))) & (F.size(_latest(r)) > 0) & F.forall(_latest(r), lambda x: x["sufficient"]),
    "evidence_allowlist": lambda r: (F.size(r["created"].texts("final_evidence_ids")) > 0) & (F.size(F.array_except(r["created"].texts("final_evidence_ids"), F.flatten(F.transform(_latest(r), lambda x: x["ids"])))) == 0),
    "final_report_present": lambda r: F.length(F.trim(F.coalesce(r["created"].text("final_report"), F.lit("")))) >= LEAST_REPORT,
    "checkpoint_completed": lambda r: (r["created"].text("checkpoint.stage") == "report") & F.array_contains(r["created"].texts("checkpoint.completed_stages"), "report"),
    "usage_recorded": lambda r: (r["created"].number("usage.agent_steps") > 0) & (r["created"].number("usage.search_calls") == F.size(r["created"].items("tool_calls"))) & (r["created"].number("usage.total_tokens") > 0),
    "no_runtime_errors": lambda r: F.size(r["created"].items("errors")) == 0,
    "persistence_round_trip": lambda r: r["persisted"].same("run_id", r["created"]) & r["persisted"].same("final_report", r["created"]) & r["persisted"].same("checkpoint", r["created"]),
}


def acceptance(page_marks: tuple[str, ...] = ()) -> dict[str, Check]:
    """ACCEPTANCE, and that the run's `page`, where there is one, holds all of these texts."""
    held = lambda r: reduce(lambda a, m: a & F.contains(r["page"].value, F.lit(m)), page_marks, F.lit(True))
    return ACCEPTANCE | {"web_control_surface": lambda r: F.when(r["page"].value.isNull(), True).otherwise(held(r))}


def _latest(records: dict[str, At]) -> Column:
    return latest_assessments(records["created"].items("evidence_assessments"))


def report(rows: DataFrame, checks: dict[str, Check], *, keys: list[str], records: dict[str, Column]) -> DataFrame:
    """keys, checks (map of name to outcome), gaps (names that failed, in the table's order), status: complete or incomplete.

    records: the columns that the checks take paths of. One projection, whatever the number of checks.
    """
    at = {n: At(c) for n, c in records.items()}
    outcomes = [F.struct(F.lit(n).alias("name"), F.coalesce(check(at), F.lit(False)).alias("held")) for n, check in checks.items()]
    out = rows.select(*keys, F.array(*outcomes).alias("o"))
    gaps = F.transform(F.filter("o", lambda x: ~x["held"]), lambda x: x["name"])
    return out.select(*keys, F.map_from_entries("o").alias("checks"), gaps.alias("gaps"), F.when(F.forall("o", lambda x: x["held"]), "complete").otherwise("incomplete").alias("status"))


def snapshot(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One row a key with each part's row as a struct, null where a part has none: a part that is missing does not hide the others."""
    out = None
    for name, df in parts.items():
        own = df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
        out = own if out is None else out.join(own, key, "full_outer")
    return out
