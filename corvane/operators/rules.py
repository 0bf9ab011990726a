"""Rule sets: ordered labels and error codes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import nfkc

# The signals that call for research, in order, each with what a question says then.
SIGNALS = (
    ("explicit_evidence_request", "证据|引用|来源|出处|链接|文献|论文|数据|搜索|检索|查找|查证|核实|reference|citation|source|evidence|link|paper|study|research|verify"),
    ("time_sensitive", "最新|当前|现在|目前|今日|今天|今年|近期|最近|截至|实时|价格|政策|新闻|趋势|排名|latest|current|today|recent|as of|price|policy|news|trend|ranking"),
    ("analysis_or_comparison", "为什么|如何|原因|原理|机制|影响|优缺点|区别|差异|比较|对比|评估|分析|方案|架构|推荐|why|how|cause|mechanism|impact|compare|versus|difference|evaluate|analysis|recommend"),
    ("multi_part", r"以及|并且|同时|分别|然后|此外|\band\b|\balso\b|\bthen\b"),
)
# Categories that may be answered directly, and the media types of each kind of file.
DIRECT_CATEGORIES = ("arithmetic", "translation", "rewrite", "summarize_user_text", "formatting", "casual", "closed_form_logic")
MEDIA_TYPES = {".txt": ("text/plain", "application/octet-stream"), ".md": ("text/markdown", "text/plain", "application/octet-stream"), ".pdf": ("application/pdf", "application/octet-stream")}
ACRONYM = r"\b[A-Z]{2,}(?:-[A-Z0-9]+)?\b"


def labels(*rules: tuple[Column, str]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def first_label(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.when(*[rules[0][0], F.lit(rules[0][1])])
    for c, n in rules[1:]:
        out = out.when(c, F.lit(n))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def research_signals(question: Column) -> Column:
    """Signals of a question, in order; it is compared in compatible form (NFKC) and lower case."""
    text = F.lower(nfkc(question))
    return labels(*[(text.rlike(pattern), name) for name, pattern in SIGNALS])


def query_category(question: Column) -> Column:
    """acronym, multi-concept, exact-term (a digit, hyphen or slash) or semantic-paraphrase, the first that holds."""
    text = F.lower(question)
    several = F.contains(text, F.lit(" and ")) | F.contains(text, F.lit(" or ")) | F.contains(text, F.lit("associated with"))
    return first_label((question.rlike(f"(?U){ACRONYM}"), "acronym"), (several, "multi-concept"), (question.rlike(r"\p{Nd}|[-/]"), "exact-term"), otherwise="semantic-paraphrase")


def safe_name(name: Column) -> Column:
    """The last part of a path in either notation; empty for `.`, `..` and nothing."""
    last = F.regexp_extract(F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"(/\.?)+$", ""), r"([^/]*)$", 1)
    return F.when(last.isin(".", ".."), F.lit("")).otherwise(last)


def upload_error(name: Column, media_type: Column, size: Column, *, most: int = 10 << 20) -> Column:
    """The first rule that an upload breaks; null if none. A missing media type counts as application/octet-stream."""
    safe = safe_name(name)
    suffix = F.lower(F.regexp_extract(safe, r"[^.].*?(\.[^.]+)$", 1))
    kind = F.trim(F.substring_index(F.lower(F.coalesce(F.when(media_type != "", media_type), F.lit("application/octet-stream"))), ";", 1))
    fits = F.lit(False)
    for ending, kinds in MEDIA_TYPES.items():
        fits = fits | ((suffix == ending) & kind.isin(*kinds))
    return first_label(
        (F.coalesce(name, F.lit("")) == "", "missing_filename"), (safe == "", "invalid_filename"), (~suffix.isin(*MEDIA_TYPES), "unsupported_file_type"),
        (~fits, "mime_type_mismatch"), (size <= 0, "empty_file"), (size > most, "file_too_large"),
    )


def chunk_error(size: Column, overlap: Column) -> Column:
    """What is wrong with chunk parameters; null if nothing: size within 200..4000, overlap within 0..1000 and below the size."""
    return first_label((~size.between(200, 4000), "invalid_chunk_size"), (~overlap.between(0, 1000) | (overlap >= size), "invalid_chunk_overlap"))


def route(proposed: Column, category: Column, confidence: Column, signals: Column, answer: Column) -> Column:
    """Gate over a proposed route: struct of route, overridden and blockers (what keeps a question from a direct answer).

    A direct answer needs a category that allows it, a confidence of 0.9, no research signal and an answer.
    """
    sure, allowed = F.coalesce(confidence >= 0.9, F.lit(False)), F.coalesce(category.isin(*DIRECT_CATEGORIES), F.lit(False))
    blockers = F.concat(signals, F.array_compact(F.array(
        F.when(~allowed, F.concat(F.lit("category:"), F.coalesce(F.when(category != "", category), F.lit("unknown")))),
        F.when(~sure, F.concat(F.lit("confidence:"), F.format_string("%.2f", F.coalesce(confidence, F.lit(0.0))))),
    )))
    direct = (proposed == "direct_answer") & allowed & sure & (F.size(signals) == 0) & (F.coalesce(answer, F.lit("")) != "")
    asked = F.coalesce(proposed == "evidence_research", F.lit(False))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(F.coalesce(direct, F.lit(False)), "direct_answer").otherwise("evidence_research").alias("route"),
        (~F.coalesce(direct, F.lit(False)) & ~asked).alias("overridden"), F.when(F.coalesce(direct, F.lit(False)) | asked, none).otherwise(blockers).alias("blockers"),
    )


def readiness(severities: Column) -> Column:
    """blocked > pending > ready over an array of gate states."""
    return F.when(F.array_contains(severities, "blocked"), "blocked").when(F.array_contains(severities, "pending"), "pending").otherwise("ready")


def advice(remaining: Column, complexity: Column, read: Column, evaluated: Column) -> Column:
    """Budget-aware advice: struct of target (evidence to read), evaluate, answer (whether it comes first)."""
    say = lambda target, evaluate, answer: F.struct(F.lit(target).alias("target"), F.lit(evaluate).alias("evaluate"), answer.alias("answer"))
    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(remaining <= 2, say(1, False, yes)).when(F.coalesce(complexity == "simple_fact", no), say(1, False, read >= 1))
        .when(read < 2, say(2, False, no)).when(evaluated < 2, say(2, True, no)).otherwise(say(2, False, no))
    )


def controller_advice(remaining: Column, sufficiency: Column) -> Column:
    """The action to prefer after a check of the evidence: answer, evaluate_evidence or read_page."""
    return first_label((remaining <= 2, "answer"), (sufficiency == "sufficient", "answer"), (sufficiency == "conflicting", "evaluate_evidence"), otherwise="read_page")


def worker_error(action: Column, ids: Column, discovered: Column, read: Column) -> Column:
    """Why a worker refuses an action; null if it does not. Reads need a discovered id (the first that is named), evaluations a read
    one (without any named: all that are read), answers two read and one of them cited."""
    known = F.array_intersect(ids, read)
    unknown = ~F.coalesce(F.array_contains(discovered, F.try_element_at(ids, F.lit(1))), F.lit(False))
    nothing = F.when(F.size(ids) > 0, F.size(known) == 0).otherwise(F.size(read) == 0)
    return first_label(((action == "read_page") & unknown, "unknown_evidence_id"), ((action == "evaluate_evidence") & nothing, "no_read_evidence"), ((action == "answer") & ((F.size(read) < 2) | (F.size(known) < 1)), "insufficient_evidence"))


def report_allowed(evidence: Column) -> Column:
    """Whether a report may be written: evidence, an array of structs with a score, best first, holds two and the best scores above 0."""
    return (F.size(evidence) >= 2) & F.coalesce(F.try_element_at(evidence, F.lit(1))["score"] > 0, F.lit(False))


def training_decision(answer_passed: Column, every_passed: Column) -> Column:
    return first_label((every_passed, "production_quality_gate_passed"), (answer_passed, "answer_target_passed_protocol_gate_failed"), otherwise="answer_target_failed_continue_training")


def matrix_status(statuses: Column, executed: Column) -> Column:
    """Status of a matrix of runs from its rows' (array): planned, succeeded, failed, partial or pending."""
    every = F.array_distinct(statuses)
    return first_label((~executed, "planned"), ((F.size(every) == 1) & F.array_contains(every, "succeeded"), "succeeded"), (F.array_contains(every, "failed"), "failed"), (F.array_contains(every, "succeeded"), "partial"), otherwise="pending")


def format_label(valid: Column, tokens: Column, limit: int) -> Column:
    """Why a generated answer has no valid format; null if it has."""
    return F.when(valid, F.lit(None).cast("string")).when(tokens >= limit, "max_new_tokens_reached").otherwise("invalid_trajectory_schema")


def router(text: Column) -> Column:
    """A router's JSON answer as struct: evidence_research unless it names direct_answer with an answer; confidence within 0..1,
    reason and category clipped. Broken JSON is a signal of its own."""
    parsed = F.from_json(text, "route string, confidence double, category string, reason string, final_answer string")
    broken = F.try_parse_json(text).isNull()
    trimmed = lambda n: F.trim(F.coalesce(parsed[n], F.lit("")))
    direct = F.coalesce((parsed["route"] == "direct_answer") & (trimmed("final_answer") != "") & ~broken, F.lit(False))
    reason = F.when(trimmed("reason") == "", "The router did not provide a detailed reason.").otherwise(F.left(trimmed("reason"), F.lit(300)))
    return F.struct(
        F.when(direct, "direct_answer").otherwise("evidence_research").alias("route"), F.when(broken, F.lit(0.0)).otherwise(F.least(F.greatest(F.coalesce(parsed["confidence"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).alias("confidence"),
        F.when(broken, "invalid_output").when(parsed["category"].isNull(), "unknown").otherwise(F.left(trimmed("category"), F.lit(80))).alias("category"),
        F.when(broken, "Invalid routing output defaulted safely to evidence research.").otherwise(reason).alias("reason"), F.when(direct, trimmed("final_answer")).alias("final_answer"),
        F.when(broken, F.array(F.lit("invalid_router_output"))).otherwise(F.array().cast("array<string>")).alias("signals"),
    )


def bad_report_ids(cited: Column, allowed: Column) -> Column:
    """Codes of a report's citations: none, repeated, outside the allowed ones."""
    return labels((F.size(cited) == 0, "no_citation"), (F.size(F.array_distinct(cited)) < F.size(cited), "repeated_citation"), (F.size(F.array_except(cited, allowed)) > 0, "citation_not_allowed"))


def plan(tasks: Column, *, most: int = 5) -> Column:
    """Trimmed tasks, blank ones dropped, at most `most`; null if fewer than two are left."""
    kept = F.slice(F.filter(F.transform(tasks, lambda x: F.trim(x)), lambda t: t != ""), 1, most)
    return F.when(F.size(kept) >= 2, kept)
