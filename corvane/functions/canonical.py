"""JSON text in one form, in built-in functions only: any nesting, keys sorted or as they came, blanks as wanted.

Nested values need no recursion: VARIANT keeps the fields of an object by name, so that parsing and writing sorts the keys at every
level, and what remains (blanks, escapes, numbers) is done token by token over the text. With the standard blanks the result is
what Python's json.dumps writes for the same value (but for a few doubles that Java writes with more digits than it need).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string, a comma or colon, or a run of anything else that is no white space.
_TOKEN = r'"(?:[^"\\]++|\\.)*+"|[,:]|[^\s",:]+'
_PARTS = r"\\u[0-9A-Fa-f]{4}|\\.|[^\\\x00-\x7e]|[\x00-\x5b\x5d-\x7e]+"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _python_float(number: Column) -> Column:
    """The shortest text of a double as Python writes it: plain from 1e-4 to below 1e16, with an exponent beyond."""

    def written(s: Column) -> Column:
        sign = F.when(F.startswith(s, F.lit("-")), "-").otherwise("")
        mantissa = F.regexp_extract(s, r"^-?([0-9.]+)", 1)
        exponent = F.coalesce(F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
        digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0+$", "")
        n = F.length(digits)
        large = F.when(exponent + 1 >= n, F.concat(digits, F.repeat(F.lit("0"), exponent + 1 - n), F.lit(".0"))).otherwise(F.concat(F.left(digits, exponent + 1), F.lit("."), F.substr(digits, exponent + 2)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        short = F.when(n > 1, F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))).otherwise(digits)
        far = F.concat(short, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
        far = F.when(F.abs(exponent) >= 100, F.concat(short, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent).cast("string"))).otherwise(far)
        scientific = F.concat(sign, F.when((exponent < -4) | (exponent >= 16), far).when(exponent < 0, small).otherwise(large))
        return F.when(F.contains(s, F.lit("E")), scientific).otherwise(s)

    return _let(number.cast("double").cast("string"), written)


def _string(token: Column, ascii_only: bool) -> Column:
    """A string token with the escapes that Python uses: none that are not needed, \\u in lower case, all beyond ASCII if wanted."""
    escaped = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")

    def part(p: Column) -> Column:
        out = F.when(p.rlike(r"^\\u"), F.lower(p))
        return (out.when(p.rlike(r"^[^\x00-\x7e]"), escaped(p)) if ascii_only else out).otherwise(p)

    needed = F.when(F.contains(token, F.lit("\\")), F.to_json(F.try_parse_json(token))).otherwise(token)
    return _let(needed, lambda t: F.when(t.rlike(r"\\u|[^\x00-\x7e]" if ascii_only else r"\\u"), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_PARTS), F.lit(0)), part), "")).otherwise(t))


def _rewritten(text: Column, item: str, key: str, ascii_only: bool) -> Column:
    def token(t: Column) -> Column:
        number = t.rlike(r"^[\[{]*-?\d[^\[{]*[.eE]")
        head, tail = F.regexp_extract(t, r"^[\[{]*", 0), F.regexp_extract(t, r"[\]}]*$", 0)
        core = F.regexp_extract(t, r"^[\[{]*(-?[0-9.eE+\-]+)[\]}]*$", 1)
        return (
            F.when(t == ",", item).when(t == ":", key).when(F.startswith(t, F.lit('"')), _string(t, ascii_only))
            .when(number, F.concat(head, _python_float(core), tail)).otherwise(t)
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), token), "")


def spaced(text: Column, *, item: str = ", ", key: str = ": ", ascii_only: bool = False) -> Column:
    """JSON text with its keys as they came, these blanks and no others. The text must be JSON; null stays null."""
    return _rewritten(text, item, key, ascii_only)


def canonical(text: Column, *, item: str = ", ", key: str = ": ", ascii_only: bool = False) -> Column:
    """JSON text with the keys of every object sorted. What is not JSON, or repeats a key, is null."""
    # a number with a fraction gets an exponent, else VARIANT takes it as a decimal, and 2.0 as 2
    doubles = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: F.when(F.startswith(t, F.lit('"')), t).otherwise(F.regexp_replace(t, r"(\.[0-9]+)(?![0-9eE])", "$1e0"))), "")
    return _rewritten(F.to_json(F.try_parse_json(F.when(text.rlike(r"[0-9]\.[0-9]"), doubles).otherwise(text))), item, key, ascii_only)


def fingerprint(text: Column, length: int = 64) -> Column:
    """The hash of a JSON value, whatever the order of its keys and its blanks: compact, sorted, ASCII."""
    return F.left(F.sha2(canonical(text, item=",", key=":", ascii_only=True), 256), F.lit(length))
