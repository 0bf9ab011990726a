"""Agent trajectories and conversations as training data: filter with reasons, audit, conversion, splits, leak checks."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import ids as I
from ..functions import text as T
from .evaluate import gate, ratio
from .sequence import numbered

# What a step may do, what a trajectory may be, and the limits of its parts.
ACTIONS = ("search", "read_page", "evaluate_evidence", "answer")
VARIANTS = ("research", "verification")
RATIONALE, OBSERVATION, ANSWER, STEPS = (3, 500), (0, 4000), (1, 6000), (1, 8)
STEP = "struct<rationale_summary:string,action:string,arguments:variant,observation:string,evidence_ids:array<string>>"
SCHEMA = f"seed_id string, query string, variant string, steps array<{STEP}>, final_answer string"
RECORD = f"steps array<{STEP}>, final_answer string"


def unfenced(text: str) -> str:
    """A code fence around the whole text removed with its first and last line."""
    t = text.strip()
    return "\n".join(t.splitlines()[1:-1]).strip() if t.startswith("```") and t.endswith("```") else t


def _text(lo: int = 0, hi: int | None = None, of: tuple[str, ...] | None = None) -> Callable[[object, str], list[str]]:
    def check(v: object, at: str) -> list[str]:
        if of is not None:
            return [] if v in of and isinstance(v, str) else [f"{at}:literal_error"]
        if not isinstance(v, str):
            return [f"{at}:string_type"]
        return [f"{at}:string_too_short"] if len(v) < lo else [f"{at}:string_too_long"] if hi is not None and len(v) > hi else []

    return check


def _list(each: Callable[[object, str], list[str]], lo: int = 0, hi: int | None = None) -> Callable[[object, str], list[str]]:
    def check(v: object, at: str) -> list[str]:
        if not isinstance(v, list):
            return [f"{at}:list_type"]
        if hi is not None and len(v) > hi:
            return [f"{at}:too_long"]
        found = [e for i, x in enumerate(v) for e in each(x, f"{at}.{i}")]
        return found or ([f"{at}:too_short"] if len(v) < lo else [])

    return check


def _model(fields: dict[str, tuple[Callable[[object, str], list[str]], bool]], rule: Callable[[dict], bool] | None = None) -> Callable[[object, str], list[str]]:
    def check(v: object, at: str) -> list[str]:
        if not isinstance(v, dict):
            return [f"{at or 'root'}:model_type"]
        name = lambda k: f"{at}.{k}" if at else k
        found = [f"{name(k)}:extra_forbidden" for k in v if k not in fields]
        for k, (one, needed) in fields.items():
            found += one(v[k], name(k)) if k in v else [f"{name(k)}:missing"] if needed else []
        return found or ([f"{at or 'root'}:value_error"] if rule and not rule(v) else [])

    return check


def _object(v: object, at: str) -> list[str]:
    return [] if isinstance(v, dict) else [f"{at}:dict_type"]


_STEP = _model(
    {"rationale_summary": (_text(*RATIONALE), True), "action": (_text(of=ACTIONS), True), "arguments": (_object, False), "observation": (_text(*OBSERVATION), True), "evidence_ids": (_list(_text()), False)},
    lambda s: s["action"] == "answer" or s["observation"].strip() != "",
)
_RESPONSE = {"steps": (_list(_STEP, *STEPS), True), "final_answer": (_text(*ANSWER), True)}
_TRAJECTORY = _model({"seed_id": (_text(), True), "query": (_text(), True), "variant": (_text(of=VARIANTS), True), **_RESPONSE})
_ANSWER = _model(_RESPONSE)


def _checker(model: Callable[[object, str], list[str]]):
    @pandas_udf(StructType([StructField("json", StringType()), StructField("errors", ArrayType(StringType()))]))
    def check(text: pd.Series) -> pd.DataFrame:
        def one(t: str | None) -> tuple[str, list[str]]:
            plain = unfenced(t or "")
            try:
                return plain, [f"invalid_schema:{e}" for e in sorted(set(model(json.loads(plain), "")))]
            except ValueError:
                return plain, ["invalid_json"]

        found = [one(t) for t in text]
        return pd.DataFrame({"json": [f[0] for f in found], "errors": [f[1] for f in found]})

    return check


#: (json, errors) of a trajectory, and of a response without its seed: the text without a fence, and what is wrong with its schema.
check_trajectory, check_response = _checker(_TRAJECTORY), _checker(_ANSWER)


def reasons(raw: DataFrame, seeds: DataFrame) -> DataFrame:
    """raw (seed_id, text: JSON) and seeds (seed_id, query, variant, expected_answer, evidence: structs with evidence_id, title, text)
    -> every reason against a row, in a fixed order; a row is accepted if it has none.

    A seed that is not known, text that is no JSON, and text of another schema (each place and kind once, sorted) are the only
    reasons then. The rows' other columns stay.
    """
    known = seeds.select("seed_id", F.struct("query", "variant", "expected_answer", F.coalesce("evidence", F.array().cast("array<struct<evidence_id:string,title:string,text:string>>")).alias("evidence")).alias("seed"))
    out = raw.join(known, "seed_id", "left").withColumn("checked", check_trajectory("text"))
    out = out.withColumn("t", F.when((F.size("checked.errors") == 0) & F.col("seed").isNotNull(), F.from_json("checked.json", SCHEMA)))
    # what a step leaves out is empty
    filled = F.transform("t.steps", lambda s: s.withField("arguments", F.coalesce(s["arguments"], F.parse_json(F.lit("{}")))).withField("evidence_ids", F.coalesce(s["evidence_ids"], F.array().cast("array<string>"))))
    out = out.withColumn("t", F.when(F.col("t").isNotNull(), F.col("t").withField("steps", filled)))
    steps = F.col("t.steps")
    answers = F.size(F.filter(steps, lambda s: s["action"] == "answer"))
    own = F.filter(F.transform("seed.evidence", lambda e: e["evidence_id"]), lambda i: F.coalesce(i, F.lit("")) != "")
    rules = F.array(
        F.when(F.col("t.seed_id") != F.col("seed_id"), F.lit("seed_id_mismatch")), F.when(F.trim("t.query") != F.trim("seed.query"), F.lit("query_mismatch")),
        F.when(F.col("t.variant") != F.col("seed.variant"), F.lit("variant_mismatch")), F.when(F.exists(steps, lambda s: ~s["action"].isin(*ACTIONS)), F.lit("invalid_action")),
        F.when(answers == 0, F.lit("missing_answer_action")), F.when(answers > 1, F.lit("multiple_answer_actions")), F.when(F.element_at(steps, -1)["action"] != "answer", F.lit("answer_action_not_final")),
        F.when(T.has_secret(F.col("checked.json")), F.lit("possible_secret")), F.when((F.size(own) > 0) & (F.size(F.array_except(used_ids(), own)) > 0), F.lit("invented_evidence_id")),
    )
    found = F.when(F.col("seed").isNull(), F.array(F.lit("unknown_seed"))).when(F.size("checked.errors") > 0, F.col("checked.errors")).otherwise(F.array_compact(rules))
    out = out.withColumn("reasons", found).withColumn("accepted", F.size("reasons") == 0)
    return out.drop("checked")


def used_ids() -> Column:
    """The distinct evidence ids of a trajectory's steps."""
    return F.array_distinct(F.flatten(F.transform("t.steps", lambda s: F.coalesce(s["evidence_ids"], F.array().cast("array<string>")))))


MEASURES = (
    "normalized_exact", "expected_in_final", "expected_supported_by_seed_evidence", "final_supported_by_seed_evidence", "last_action_is_answer", "exactly_one_answer",
    "has_search", "has_read_page", "has_evaluate_evidence", "known_evidence_only", "uses_evidence",
)


def multiset_f1(left: Column, right: Column) -> Column:
    """F1 of two arrays of words as multisets; with an empty side 1 if both are, else 0."""
    same = T.common(left, right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), (F.size(left) == F.size(right)).cast("double")).otherwise(ratio(same * F.lit(2.0), F.size(left) + F.size(right)))


def row_measures(filtered: DataFrame) -> DataFrame:
    """The measures of accepted rows: seed_id, source (before -train-), actions, token_f1 and MEASURES."""
    texts = F.array_join(F.transform("seed.evidence", lambda e: F.concat_ws(" ", F.coalesce(e["title"], F.lit("")), F.coalesce(e["text"], F.lit("")))), " ")
    rows = filtered.where("accepted").select(
        "seed_id", T.source_prefix(F.col("seed_id")).alias("source"), F.transform("t.steps", lambda s: s["action"]).alias("actions"), T.normalize_answer(F.col("t.final_answer")).alias("final"),
        T.normalize_answer(F.coalesce("seed.expected_answer", F.lit(""))).alias("expected"), T.normalize_answer(texts).alias("evidence"), used_ids().alias("used"), F.transform("seed.evidence", lambda e: e["evidence_id"]).alias("known"),
    )
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    has = lambda a: F.array_contains("actions", a)
    inside = lambda text, part: (F.col(part) != "") & F.contains(F.col(text), F.col(part))
    return rows.select("seed_id", "source", "actions", multiset_f1(words("final"), words("expected")).alias("token_f1"), *[c.alias(n) for n, c in zip(MEASURES, (
        F.col("final") == F.col("expected"), inside("final", "expected"), inside("evidence", "expected"), inside("evidence", "final"), F.element_at("actions", -1) == "answer",
        F.size(F.filter("actions", lambda x: x == "answer")) == 1, has("search"), has("read_page"), has("evaluate_evidence"), F.size(F.array_except("used", "known")) == 0, F.size("used") > 0,
    ), strict=True)])


def audit(filtered: DataFrame) -> DataFrame:
    """Accepted rows by source and over all (source null): records, a rate of each measure, mean F1, steps, actions as a map."""
    rows = row_measures(filtered).withColumn("n_steps", F.size("actions"))
    n = F.count(F.lit(1))
    out = rows.rollup("source").agg(
        n.alias("records"), *[ratio(F.count_if(c), n).alias(f"{c}_rate") for c in MEASURES], F.coalesce(F.avg("token_f1"), F.lit(0.0)).alias("mean_token_f1"),
        F.coalesce(F.min("n_steps"), F.lit(0)).alias("steps_min"), F.coalesce(F.max("n_steps"), F.lit(0)).alias("steps_max"), F.coalesce(F.avg("n_steps"), F.lit(0.0)).alias("steps_mean"), F.coalesce(F.median("n_steps"), F.lit(0.0)).alias("steps_median"),
    )
    each = rows.select("source", F.explode("actions").alias("action")).groupBy("source", "action").agg(F.count(F.lit(1)).alias("n"))
    every = each.unionByName(each.groupBy("action").agg(F.sum("n").alias("n")).withColumn("source", F.lit(None).cast("string")))
    counts = every.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("actions")).withColumnRenamed("source", "s")
    return out.join(counts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def acceptance(filtered: DataFrame) -> DataFrame:
    """One row: input, accepted, rejected and unknown-seed records, rate, distinct ids and contents of the accepted."""
    n = F.count(F.lit(1))
    own = lambda c: F.count_distinct(F.when(F.col("accepted"), c))
    return filtered.agg(
        n.alias("input_records"), F.count_if("accepted").alias("accepted_records"), F.count_if(~F.col("accepted")).alias("rejected_records"), F.count_if(F.array_contains("reasons", "unknown_seed")).alias("unknown_seed_records"),
        ratio(F.count_if("accepted"), n).alias("acceptance_rate"), own(F.col("seed_id")).alias("unique_ids"), own(F.sha2("text", 256)).alias("unique_hashes"),
    )


# What a set of accepted trajectories must reach.
GATES = {
    "accepted_records": (">=", 400), "acceptance_rate": (">=", 0.90), "normalized_exact_rate": (">=", 0.99), "last_action_is_answer_rate": (">=", 0.99),
    "exactly_one_answer_rate": (">=", 0.99), "known_evidence_only_rate": (">=", 1.0),
}


def quality_gate(filtered: DataFrame) -> DataFrame:
    """(gate, value, passed, decision) of a filtered set: its acceptance and its overall rates against GATES."""
    overall = audit(filtered).where("source IS NULL").select(*[c for c in GATES if c.endswith("_rate") and c != "acceptance_rate"])
    return gate(acceptance(filtered).select("accepted_records", "acceptance_rate").crossJoin(overall), GATES)


def token_usage(raw: DataFrame) -> DataFrame:
    """Sums of a nested column usage; rows without it count as 0."""
    total = lambda n: F.coalesce(F.sum(f"usage.{n}"), F.lit(0)).cast("bigint").alias(n)
    return raw.agg(*[total(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")])


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


_JSON = {"ignoreNullFields": "false"}


def to_records(filtered: DataFrame, system: str) -> DataFrame:
    """Accepted trajectories as training rows (id, messages, trajectory_sha256): system, question, steps and final answer as JSON."""
    whole = F.to_json("t", _JSON)
    target = F.to_json(F.struct(F.col("t.steps").alias("steps"), F.col("t.final_answer").alias("final_answer")), _JSON)
    return filtered.where("accepted").select(F.col("t.seed_id").alias("id"), F.array(_turn("system", F.lit(system)), _turn("user", F.col("t.query")), _turn("assistant", target)).alias("messages"), I.content_hash(whole).alias("trajectory_sha256"))


def to_turns(records: DataFrame, system: str) -> DataFrame:
    """Training rows of three messages as one turn a step: each action as JSON and, unless it answers, what the tool returned.

    Rows whose roles are others or whose answer breaks the schema are left out; `record_errors` tells them.
    """
    good = records.withColumn("error", record_error()).where("error IS NULL")
    r = F.from_json(check_response(F.element_at("messages", 3)["content"])["json"], RECORD)
    none = F.array().cast("array<string>")

    def pair(s: Column) -> Column:
        last, ids = s["action"] == "answer", F.coalesce(s["evidence_ids"], none)
        act = F.to_json(F.struct(s["rationale_summary"].alias("rationale_summary"), s["action"].alias("action"), F.coalesce(s["arguments"], F.parse_json(F.lit("{}"))).alias("arguments"), ids.alias("evidence_ids"), F.when(last, F.col("r.final_answer")).alias("final_answer")), _JSON)
        back = F.to_json(F.struct(F.lit("succeeded").alias("status"), s["observation"].alias("observation"), ids.alias("evidence_ids")), _JSON)
        return F.when(last, F.array(_turn("assistant", act))).otherwise(F.array(_turn("assistant", act), _turn("tool", back)))

    rows = good.withColumn("r", r)
    head = F.array(_turn("system", F.lit(system)), _turn("user", F.element_at("messages", 2)["content"]))
    return rows.withColumn("messages", F.concat(head, F.flatten(F.transform("r.steps", pair)))).drop("r", "error")


def record_error() -> Column:
    """What is wrong with a training row's messages; null if nothing."""
    roles = F.transform("messages", lambda m: m["role"])
    target = F.coalesce(F.try_element_at(F.col("messages"), F.lit(3))["content"], F.lit(""))
    return F.when(~F.coalesce(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.lit(False)), "wrong_roles").when(F.size(check_response(target)["errors"]) > 0, "invalid_target")


def with_prompt(records: DataFrame, system: str) -> DataFrame:
    """Training rows with another system turn; rows that break the contract are an error."""
    bad = records.where(record_error().isNotNull()).select("id").limit(5).collect()
    if bad:
        raise ValueError(f"rows that break the contract: {[r['id'] for r in bad]}")
    return records.withColumn("messages", F.transform("messages", lambda m, i: F.when(i == 0, _turn("system", F.lit(system))).otherwise(_turn_of(m))))


def _turn_of(m: Column) -> Column:
    return F.struct(m["role"].alias("role"), m["content"].alias("content"))


def dev_cases(records: DataFrame) -> DataFrame:
    """(case_id, question, expected_answer, split, error) of rows with exactly one user and one assistant turn and an answer."""
    of = lambda role: F.filter("messages", lambda m: m["role"] == role)
    answer = F.trim(F.get_json_object(F.try_element_at(of("assistant"), F.lit(1))["content"], "$.final_answer"))
    error = F.when((F.size(of("user")) != 1) | (F.size(of("assistant")) != 1), "not_one_turn_each").when(F.coalesce(answer, F.lit("")) == "", "empty_final_answer")
    return records.select(F.col("id").cast("string").alias("case_id"), F.try_element_at(of("user"), F.lit(1))["content"].alias("question"), answer.alias("expected_answer"), F.lit("validation_dev").alias("split"), error.alias("error"))


def seeds_of(rows: DataFrame, source: str, *, order: str) -> DataFrame:
    """Seeds of source rows (id, question, answer, evidence): the variants alternate in the order of the rows."""
    at = F.col("__at")
    return numbered(rows, order=[order], name="__at").select(F.concat(F.lit(f"{source}-train-"), F.coalesce(F.col("id").cast("string"), at.cast("string"))).alias("seed_id"), F.trim("question").alias("query"), F.lit("en").alias("language"), F.when(F.pmod(at, F.lit(2)) == 0, VARIANTS[0]).otherwise(VARIANTS[1]).alias("variant"), F.trim(F.coalesce("answer", F.lit(""))).alias("expected_answer"), "evidence")


def padded(seeds: DataFrame, target: int) -> DataFrame:
    """Seeds (with ord, their place from 0) filled up to `target`: they are gone through again and again in the other variant.

    The n-th copy of a seed is named seed-variant, then seed-variant-2 and so on.
    """
    n = seeds.count()
    if not n:
        raise ValueError("no seed records")
    rounds = F.sequence(F.lit(0), F.lit(max(0, -(-target // n) - 1)))
    other = F.when(F.col("variant") == VARIANTS[0], VARIANTS[1]).otherwise(VARIANTS[0])
    each = seeds.withColumn("round", F.explode(rounds))
    copy = F.concat("seed_id", F.lit("-"), other, F.when(F.col("round") > 1, F.concat(F.lit("-"), F.col("round").cast("string"))).otherwise(F.lit("")))
    out = each.withColumns({"seed_id": F.when(F.col("round") == 0, F.col("seed_id")).otherwise(copy), "variant": F.when(F.col("round") == 0, F.col("variant")).otherwise(other), "ord": F.col("round") * n + F.col("ord")})
    return out.where(F.col("ord") < target).drop("round")


def review_packet(filtered: DataFrame, *, seed: str, per_source: int = 5, rejected: int = 10) -> DataFrame:
    """Rows for human review: of each source the first accepted by hash order, and the first rejected ones of all; reviews are empty."""
    key = I.selection_key(seed, F.col("seed_id"))
    rows = filtered.select("seed_id", T.source_prefix(F.col("seed_id")).alias("source"), "accepted", "reasons", key.alias("k"))
    place = F.row_number().over(Window.partitionBy("accepted", F.when(F.col("accepted"), F.col("source"))).orderBy("k", "seed_id"))
    kept = rows.withColumn("place", place).where(F.col("place") <= F.when(F.col("accepted"), F.lit(per_source)).otherwise(F.lit(rejected)))
    return kept.select("seed_id", "source", "accepted", "reasons", "place", *[F.lit(None).cast("boolean").alias(c) for c in ("schema_correct", "evidence_faithful", "answer_correct")])


def final_cases(rows: DataFrame, excluded: DataFrame, *, seed: str, per_source: int) -> DataFrame:
    """Cases for a final test from rows (source, id, question, answer, aliases, evidence with supporting marks).

    Rows without id, question, answer or two supporting paragraphs go, and those whose question is among the excluded (question);
    of the rest the first of each source by hash order stay. Each has its gold claim and both sets of evidence.
    """
    trimmed = rows.select("source", *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("id", "question", "answer")], F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "evidence")
    gold = F.filter("evidence", lambda e: e["supporting"])
    good = trimmed.where("id <> '' AND question <> '' AND answer <> ''").withColumn("controlled", gold).where(F.size("controlled") >= 2).withColumn("q", T.normalize_question(F.col("question")))
    fresh = good.join(excluded.where(F.trim("question") != "").select(T.normalize_question(F.col("question")).alias("q")).distinct(), "q", "left_anti")
    key = I.selection_key(seed, F.col("source"), F.col("id"))
    chosen = fresh.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(key, "id"))).where(F.col("k") <= per_source)
    ids = F.transform("controlled", lambda e: e["evidence_id"])
    claim = F.concat(F.lit('The answer to "'), "question", F.lit('" is "'), "answer", F.lit('".'))
    return chosen.select(F.concat("source", F.lit("-validation-"), "id").alias("case_id"), F.col("source").alias("dataset"), "question", F.col("answer").alias("expected_answer"), F.filter("aliases", lambda x: F.trim(x) != "").alias("answer_aliases"), claim.alias("gold_claim"), ids.alias("supporting_ids"), "controlled", F.col("evidence").alias("distractor"))


def conversation_shape(turns: DataFrame) -> DataFrame:
    """Per conversation: turns, counts by role, whether it has exactly one user and one assistant turn, whether roles alternate."""
    count = lambda r: F.count_if(F.col("role") == r)
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    out = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), count("user").alias("user"), count("assistant").alias("assistant"), count("system").alias("system"), roles.alias("roles"))
    spoken = F.filter("roles", lambda r: r != "system")
    same = F.exists(F.zip_with(F.slice(spoken, 1, F.greatest(F.size(spoken) - 1, F.lit(0))), F.slice(spoken, 2, F.greatest(F.size(spoken) - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)
    return out.withColumn("single_pair", (F.col("user") == 1) & (F.col("assistant") == 1)).withColumn("alternates", ~same).drop("roles")


def pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, response): each user turn with the assistant turn right after it."""
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("r2"), F.col("text").alias("response")).where("r2 = 'assistant'")
    return turns.where("role = 'user'").join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("prompt"), "response")


def split(df: DataFrame, *, id_col: str, seed: str, held_out: float = 0.1) -> DataFrame:
    """split: train or validation, by hash of the id; stable when rows come or go."""
    share = F.conv(F.substring(I.selection_key(seed, F.col(id_col)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return df.withColumn("split", F.when(share < F.lit(held_out), "validation").otherwise("train"))


def leaks(train: DataFrame, forbidden: DataFrame, *, text_col: str = "prompt") -> DataFrame:
    """Training rows whose normalized question is among the forbidden ones; must be empty."""
    key = T.normalize_question(F.col(text_col))
    return train.withColumn("__q", key).join(forbidden.select(key.alias("__q")).distinct(), "__q", "left_semi").drop("__q")
