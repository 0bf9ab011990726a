"""Tool observations cut to a size: nested JSON rewritten in VARIANT expressions, with the hash and length of the original."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.canonical import spaced

# The fields that a shortened observation keeps, in order; bounds on what is kept of them.
EVIDENCE = "evidence_id source_id document_id passage_id canonical_url title rank retrieval_method content".split()
HIT = "document_id title source rank score content".split()
IDS = "evidence_id source_id passage_id".split()
QUERY_CHARS, HIT_CHARS, LIST_ENTRIES = 500, 1000, 10
CONTENT_MOST, CONTENT_LEAST = 2000, 128


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _get(value: Column, field: str) -> Column:
    return F.try_variant_get(value, f"$.{field}", "variant")


def _text(value: Column) -> Column:
    """A string's text; of anything else its JSON."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))


def _entries(value: Column) -> Column:
    """A list's entries; null for what is no list."""
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.try_variant_get(value, "$", "array<variant>"))


def _picked(item: Column, fields: list[str], content: Column | None) -> Column:
    """An object as JSON text with only these fields, those that it has; its content cut."""
    quoted = lambda c: F.to_json(c.cast("variant"))
    cut = lambda f: quoted(F.left(_text(_get(item, f)), content)) if f == "content" else F.to_json(_get(item, f))
    pairs = [F.when(_get(item, f).isNotNull(), F.concat(F.lit(f'"{f}":'), cut(f))) for f in fields]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pairs)), ","), F.lit("}"))


def _list(items: Column, one) -> Column:
    objects = F.filter(items, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
    return F.concat(F.lit("["), F.array_join(F.transform(objects, one), ","), F.lit("]"))


def bounded(observation: Column, most: int) -> Column:
    """An observation (JSON text, an object) of at most `most` characters as it is, a longer one rewritten.

    Kept are the query, that it was cut, the length and sha256 of the original, evidence with its content cut to a share of the
    room, the first ten hits and failures. Where that is too long, hits go and evidence keeps only its ids; where that is too long
    as well, evidence and failures go too. Lengths are of JSON with the standard blanks, as is the result; objects kept
    whole have their keys sorted. Entries that are no objects are left out, and lists that are none. What is not JSON is null.
    """
    if most < 1000:
        raise ValueError("a shortened observation takes up to 1000 characters by itself")

    def shortened(o: Column) -> Column:
        value, whole = o["v"], o["s"]
        evidence, hits, failures = (_entries(F.coalesce(_get(value, f), F.parse_json(F.lit(absent)))) for f, absent in (("evidence", "[]"), ("hits", "[]"), ("failures", "null")))
        room = F.greatest(F.least(F.floor(F.floor(F.lit(most) / F.greatest(F.size(evidence), F.lit(1))) / 2), F.lit(CONTENT_MOST)), F.lit(CONTENT_LEAST)).cast("int")
        head = F.concat(
            F.lit('{"query":'), F.to_json(F.coalesce(F.left(_text(_get(value, "query")), F.lit(QUERY_CHARS)), F.lit("")).cast("variant")), F.lit(',"_context_truncated":true,"_original_character_count":'),
            F.length(whole).cast("string"), F.lit(',"_content_sha256":"'), F.sha2(whole, 256), F.lit('"'),
        )
        field = lambda name, body: F.coalesce(F.concat(F.lit(f',"{name}":'), body), F.lit(""))
        failed = field("failures", F.concat(F.lit("["), F.array_join(F.transform(F.slice(failures, 1, LIST_ENTRIES), lambda x: F.to_json(x)), ","), F.lit("]")))
        full = field("evidence", _list(evidence, lambda x: _picked(x, EVIDENCE, room))), field("hits", _list(F.slice(hits, 1, LIST_ENTRIES), lambda x: _picked(x, HIT, F.lit(HIT_CHARS))))
        ids = F.coalesce(field("evidence", _list(evidence, lambda x: _picked(x, IDS, None))), F.lit(""))
        ids = F.when(ids == "", ',"evidence":[]').otherwise(ids)
        first, second, last = (spaced(F.concat(head, *parts, F.lit("}"))) for parts in ((*full, failed), (ids, failed), ()))
        return _let(first, lambda a: F.when(F.length(a) <= most, a).otherwise(_let(second, lambda b: F.when(F.length(b) <= most, b).otherwise(last))))

    whole = F.when(F.try_parse_json(observation).isNotNull(), spaced(observation))
    both = F.struct(F.try_parse_json(observation).alias("v"), whole.alias("s"))
    return _let(both, lambda o: F.when(F.length(o["s"]) <= most, o["s"]).otherwise(shortened(o)))
