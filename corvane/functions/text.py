"""Text functions as Column expressions: normalizers, tokenizer, URLs, citations, redaction, sentence splitting.

Three families of normalizer are kept apart on purpose: for retrieval (case folded by `lower`), for corpus text (case kept) and for
answers (casefolded, articles dropped or words sorted).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

# The token pattern of the retrieval tokenizer, in Java and RE2 spelling.
TOKEN = r"[a-z0-9ı][a-z0-9ı_.+\-/#]*|[一-鿿]+"
TOKEN_RE2 = r"[a-z0-9ı][a-z0-9ı_.+\-/#]*|[\x{4e00}-\x{9fff}]+"
CJK_RUN = "^[一-鿿]"
# Query parameters that only track, by name and by prefix.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref")
TRACKING_PREFIX = "utm_"
SECRET = r"(?i)(api[_-]?key|password|secret|bearer)\s*[:=]\s*\S+"
ABSTAIN = "insufficient evidence"


@arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Unicode NFKC; texts that are normal already, nearly all, are only checked."""
    return pa.array([t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


# What NFKC leaves as it is: ASCII, composed Latin letters, Cyrillic, kana, ideographs, dashes and quotes. Marks that could join a
# letter before them are not among these, nor is anything that has a compatible form.
STABLE = r"^[\x00-\x7f\u00c0-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u04ff\u2012-\u2015\u2018-\u201f\u3001\u3002\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff]*+$"


def compatible(text: Column) -> Column:
    """Unicode NFKC; only texts that it may change are handed to Python."""
    return F.coalesce(nfkc(F.when(~text.rlike(STABLE), text)), text)


@pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.str.casefold()


def squeeze(text: Column) -> Column:
    """Every run of Unicode white space becomes one space; trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_query(text: Column) -> Column:
    return F.trim(F.lower(nfkc(text)))


def normalize_corpus(text: Column) -> Column:
    return squeeze(nfkc(text))


def normalize_upload(text: Column) -> Column:
    """Line ends to LF, runs of blanks in a line to one space, at most one empty line in a row, trimmed."""
    t = F.regexp_replace(text, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"(?m)^ | $", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))


def normalize_evidence(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def normalize_claim(text: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(text), r"(?U)\W+", " "))


def normalize_answer(text: Column) -> Column:
    """Casefolded, without articles and punctuation, white space collapsed."""
    t = F.regexp_replace(casefold(nfkc(text)), r"(?U)\b(a|an|the)\b", " ")
    return squeeze(F.regexp_replace(t, r"(?U)[^\w\s]", " "))


def answer_key(text: Column) -> Column:
    """Order-free key of an answer: its distinct words, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(casefold(nfkc(text)), F.lit(r"(?U)\w+"), F.lit(0)))), " ")


def answer_keys(texts: Column) -> Column:
    """The keys of an array of answers: folded in one piece, as lambdas take no Python, then parted again."""
    whole = casefold(nfkc(F.array_join(F.transform(texts, lambda x: F.replace(x, F.lit("\x00"), F.lit(" "))), "\x00")))
    key = lambda x: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?U)\w+"), F.lit(0)))), " ")
    return F.transform(F.split(whole, "\x00"), key)


def normalize_question(text: Column) -> Column:
    return squeeze(casefold(text))


def tokens(text: Column) -> Column:
    """Tokens of a text in compatible form and lower case, in order; runs of CJK characters become overlapping pairs `zh:ab`."""
    base = F.lower(compatible(text))
    found = F.regexp_extract_all(F.coalesce(base, F.lit("")), F.lit(TOKEN), F.lit(0))

    def parts(x: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.concat(F.lit("zh:"), F.substr(x, i, F.lit(2))))
        return F.when(~x.rlike(CJK_RUN), F.array(x)).when(F.length(x) == 1, F.array(F.concat(F.lit("zh:"), x))).otherwise(pairs)

    # texts without any CJK character, nearly all, need no second look at each token
    return F.when(F.coalesce(base, F.lit("")).rlike("[一-鿿]"), F.flatten(F.transform(found, parts))).otherwise(found)


def sentences(text: Column) -> Column:
    """Sentences: split after . ! ? and their full-width forms before white space; blank ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?。！？])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def common(left: Column, right: Column) -> Column:
    """How many words two arrays share as multisets: both sorted together, then one pass that pairs equal words off."""
    side = lambda words, n: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(n).alias("s")))
    both = F.array_sort(F.concat(side(left, 0), side(right, 1)))
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("open"), F.lit(0).alias("n"))

    def step(state: Column, x: Column) -> Column:
        free = F.when(state["w"].eqNullSafe(x["w"]), state["open"]).otherwise(F.lit(0))
        paired = (x["s"] == 1) & (free > 0)
        left_open = F.when(x["s"] == 0, free + 1).when(paired, free - 1).otherwise(free)
        return F.struct(x["w"].alias("w"), left_open.alias("open"), (state["n"] + paired.cast("int")).alias("n"))

    return F.aggregate(both, start, step, lambda state: state["n"])


def evidence_ids(text: Column) -> Column:
    """Ids cited as [E:id], in order, distinct."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[E:([^\]\s]+)\]"), F.lit(1)))


def without_evidence_marks(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, r"\[E:[^\]\s]+\]", " "))


def citation_ids(text: Column) -> Column:
    """Lower-cased [doc-…] and [chunk-…] citations in order of first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[((?:doc|chunk)-[a-z0-9_\-]+)\]"), F.lit(1)), F.lower))


def abstains(text: Column) -> Column:
    return F.startswith(F.lower(F.ltrim(text)), F.lit(ABSTAIN))


def redact(text: Column) -> Column:
    """Assigned secrets, home and data folders, quota headers and ssh targets replaced by placeholders, the rest as it is."""
    t = F.regexp_replace(text, r"(?i)\b([a-z0-9_]*(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|secret)[a-z0-9_]*)\b(\s*[:=]\s*)(\S+)", "$1$2<redacted>")
    t = F.regexp_replace(t, r"/home/[^/\s=:]+", r"\$HOME")
    t = F.regexp_replace(t, r"/data/[^/\s=:]+(?=/)", r"/data/\$USER")
    t = F.regexp_replace(t, r"(?im)^Disk quotas for user \S+(?:\s+\(uid\s+\d+\))?:?", "Disk quotas for current user")
    return F.regexp_replace(t, r"(?i)\b(?:ssh|scp)\s+[^@\s]+@[^:\s]+", "ssh <redacted-target>")


def has_secret(text: Column) -> Column:
    return text.rlike(SECRET)


def strip_fence(text: Column) -> Column:
    """A code fence around the whole text removed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def short(text: Column, limit: int = 240) -> Column:
    t = squeeze(text)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit - 1))), F.lit("…"))).otherwise(t)


def contains_answer(text: Column, answer: Column) -> Column:
    """Normalized containment; an empty answer is in nothing."""
    a = normalize_answer(answer)
    return (a != "") & F.contains(normalize_answer(text), a)


def valid_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


@arrow_udf(StringType())
def idna(host: pa.Array) -> pa.Array:
    """Host names in ASCII; null for names that have no such form."""

    def one(name: str | None) -> str | None:
        try:
            return name if name is None else name.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None

    return pa.array([one(h) for h in host.to_pylist()], pa.string())


def _quoted(text: Column) -> Column:
    """Percent-encoded as in a form: letters, digits and _.-~ as they are, blanks as +."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _unquoted(text: Column) -> Column:
    """Decoded as in a form; a percent sign that begins no code stays."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_url(url: Column) -> Column:
    """A URL in one form, as a key: scheme and host in lower case, hosts in ASCII, default ports, repeated slashes, tracking
    parameters and the fragment dropped, parameters decoded, sorted and encoded again.

    Null for other schemes, without a host, with credentials, and for hosts and ports that are none.
    """
    u = F.regexp_replace(F.regexp_replace(url, r"^[\s\x00-\x20]+|\s+$", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1)
    credentials, place = F.regexp_extract(authority, r"^(.*)@", 1), F.regexp_extract(authority, r"([^@]*)$", 1)
    bracketed = F.startswith(place, F.lit("["))
    address = F.lower(F.regexp_extract(place, r"^\[([0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*)\](?::|$)", 1))
    name = F.lower(F.regexp_extract(place, r"^([^:\[\]]*)(?::|$)", 1))
    ascii_name = F.coalesce(idna(F.when(name.rlike(r"[^\x00-\x7f]"), name)), F.when(~name.rlike(r"[^\x00-\x7f]"), name))
    good_name = (ascii_name != "") & ~ascii_name.rlike(r"^\.|\.\.|[^.]{64}")
    host = F.when(bracketed, F.when(address != "", F.concat(F.lit("["), address, F.lit("]")))).otherwise(F.when(good_name, ascii_name))
    port_text = F.when(bracketed, F.regexp_extract(place, r"\]:(.*)$", 1)).otherwise(F.regexp_extract(place, r"^[^:]*:(.*)$", 1))
    number = F.when(port_text.rlike("^[0-9]+$"), port_text.try_cast("int"))
    usual = (number == 0) | ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    kept_port = F.when(port_text == "", F.lit("")).when(usual, F.lit("")).when(number <= 65535, F.concat(F.lit(":"), number.cast("string")))
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/{2,}", "/")
    pieces = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    items = F.transform(pieces, lambda p: F.struct(_unquoted(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), _unquoted(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")))
    wanted = F.filter(items, lambda x: ~F.lower(x["k"]).isin(*TRACKING) & ~F.startswith(F.lower(x["k"]), F.lit(TRACKING_PREFIX)))
    query = F.array_join(F.transform(F.array_sort(wanted), lambda x: F.concat(_quoted(x["k"]), F.lit("="), _quoted(x["v"]))), "&")
    tail = F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    good = scheme.isin("http", "https") & credentials.isin("", ":")
    return F.when(good, F.concat(scheme, F.lit("://"), host, kept_port, F.when(path == "", F.lit("/")).otherwise(path), tail))


# What an audit counts as broken encoding and as markup left in a text, in Java and RE2 spelling.
MOJIBAKE = "\ufffd|\x00|Ã[^\n]|Â[^\n]|â€™"
MOJIBAKE_RE2 = r"\x{FFFD}|\x00|Ã[^\n]|Â[^\n]|â€™"
HTML_RESIDUE = r"(?i)<!doctype|<html\b|<script\b|</?[a-z][^>]{0,200}>"


def mojibake(text: Column) -> Column:
    return text.rlike(MOJIBAKE)


def html_residue(text: Column) -> Column:
    return text.rlike(HTML_RESIDUE)


def error_message(text: Column, limit: int = 500) -> Column:
    """Safe to show: text that holds a path is replaced, the rest clipped."""
    return F.when(text.rlike(r"[:][\\/]|(^|\s)/\w+/"), F.lit("internal error")).otherwise(F.left(text, F.lit(limit)))


def source_prefix(text: Column) -> Column:
    return F.substring_index(text, "-train-", 1)


def version_parts(text: Column) -> Column:
    """1.10.2 -> [1, 10, 2]; arrays compare as versions do."""
    return F.transform(F.split(text, r"\."), lambda p: p.try_cast("int"))


def adapter_key(name: Column) -> Column:
    """A parameter's name without the adapter's default part."""
    return F.replace(name, F.lit(".default.weight"), F.lit(".weight"))


def adapter_module(name: Column) -> Column:
    """The module that an adapter's parameter belongs to: the third part from the end; null where there are fewer."""
    return F.try_element_at(F.split(adapter_key(name), r"\."), F.lit(-3))
