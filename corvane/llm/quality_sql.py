"""The quality rules as one DuckDB statement: base counts, estimates by the same concentration steps, verdicts.

Written from the same parameters as quality_rules; the Cholesky factor and the distances are spelled out column by column. The
steps that the engine repeats until no determinant falls are written out STEPS times: after the last fall they change nothing.
"""

from __future__ import annotations

from .quality_rules import _BIN_MAX, _BINS_PER_E, _COARSE, CHI2_CUT, CHI2_MEDIAN, FLOORS, GAIN, MAX_REPEAT, MIN_GROUP, MIN_WORDS, SCALE, STATS, SUPPORT, WINDOW, P

STEPS = 16
_FIT = [f"m{i}" for i in P] + [f"l{i}{j}" for i in P for j in range(i + 1)] + ["logdet"]


def _d2(x: str = "", f: str = "") -> str:
    """Nested selects are avoided: each z is an expression in the earlier ones, spelled out."""
    z: list[str] = []
    for i in P:
        z.append(f"(({x}k{i} / {SCALE}e0 - {f}m{i}" + "".join(f" - {f}l{i}{j} * {z[j]}" for j in range(i)) + f") / {f}l{i}{i})")
    return " + ".join(f"{v} * {v}" for v in z)


def _bin(d2: str) -> str:
    return f"CAST(greatest(0, least({_BIN_MAX}, floor(ln({d2} + 1e-6) * {_BINS_PER_E}) + {14 * _BINS_PER_E})) AS INTEGER)"


def _cut(near: str, keys: str, share: float) -> str:
    return (
        f"(SELECT {keys}, min(bin) AS cut, max(everything) AS n_group FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS run, sum(n) OVER (PARTITION BY {keys}) AS everything "
        f"FROM (SELECT {keys}, bin, count(*) AS n FROM {near} GROUP BY ALL)) WHERE run >= {share} * everything GROUP BY {keys})"
    )


def _moments(name: str, rows: str, keys: str) -> list[str]:
    """CTEs that end in one called `name`: keys, mean, Cholesky factor, log determinant of rows."""
    sums = ", ".join([f"CAST(sum(k{i}) AS DOUBLE) AS s{i}" for i in P] + [f"CAST(sum(CAST(k{i} AS HUGEINT) * k{j}) AS DOUBLE) AS q{i}{j}" for i in P for j in range(i + 1)])
    cov = ", ".join(f"q{i}{j} / n / {SCALE}e0 / {SCALE}e0 - m{i} * m{j} + {FLOORS[i] ** 2 if i == j else 0}e0 AS c{i}{j}".replace("+ 0e0", "+ 0e0") for i in P for j in range(i + 1))
    parts = [
        f"{name}_s AS (SELECT {keys}, CAST(count(*) AS DOUBLE) AS n, {sums} FROM {rows} GROUP BY {keys})",
        f"{name}_m AS (SELECT *, {', '.join(f's{i} / n / {SCALE}e0 AS m{i}' for i in P)} FROM {name}_s)",
        f"{name}_0 AS (SELECT *, {cov} FROM {name}_m)",
    ]
    for j in P:
        own = f"sqrt(greatest(c{j}{j}{''.join(f' - l{j}{k} * l{j}{k}' for k in range(j))}, {FLOORS[j] ** 2 * 0.25!r}))"
        below = [f"(c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, len(STATS))]
        parts += [f"{name}_{j}d AS (SELECT *, {own} AS l{j}{j} FROM {name}_{j})", f"{name}_{j + 1} AS (SELECT {', '.join(['*', *below])} FROM {name}_{j}d)"]
    parts.append(f"{name} AS MATERIALIZED (SELECT {keys}, {', '.join(_FIT[:-1])}, {' + '.join(f'ln(l{j}{j})' for j in P)} AS logdet FROM {name}_{len(STATS)})")
    return parts


def _middle(name: str, rows: str, value: str) -> str:
    each = " UNION ALL ".join(f"SELECT g, {i} AS stat, CAST(floor({value.format(i=i)} / {_COARSE}e0) AS INTEGER) AS bin FROM {rows}" for i in P)
    return f"{name} AS MATERIALIZED (SELECT g, {', '.join(f'max(CASE WHEN stat = {i} THEN (cut + 0.5e0) * {_COARSE / SCALE!r} END) AS v{i}' for i in P)} FROM {_cut(f'({each})', 'g, stat', 0.5)} GROUP BY g)"


def statement() -> str:
    word = r"[^\x20\x09-\x0D]+"
    base = rf"""
d AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
st AS MATERIALIZED (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper,
  [l FOR l IN string_split(t, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT * EXCLUDE (lines), len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM st),
v AS (SELECT *, ln((word_chars + 1e0) / (n_words + 1e0)) AS x0, sqrt(n_symbols / (word_chars + 1e0)) AS x1, sqrt(n_upper / (word_chars + 1e0)) AS x2,
  sqrt(n_dup_lines / (n_lines + 1e0)) AS x3, sqrt(n_repeat_words / (n_words + 1e0)) AS x4 FROM f),
x AS MATERIALIZED (SELECT * EXCLUDE (x0, x1, x2, x3, x4), {', '.join(f'CAST(floor(x{i} * {SCALE}e0 + 0.5e0) AS BIGINT) AS k{i}' for i in P)},
  {{'l': 0, 'a': lang, 's': source}} AS g0, {{'l': 1, 'a': lang, 's': CAST(NULL AS VARCHAR)}} AS g1, {{'l': 2, 'a': CAST(NULL AS VARCHAR), 's': CAST(NULL AS VARCHAR)}} AS g2 FROM v),
e AS MATERIALIZED ({' UNION ALL '.join(f'SELECT g{n} AS g, {", ".join(STATS)} FROM x WHERE NOT base_failed' for n in range(3))}),
big AS MATERIALIZED (SELECT g FROM e GROUP BY g HAVING count(*) >= {MIN_GROUP}),
k AS MATERIALIZED (SELECT e.* FROM e JOIN big USING (g))"""
    parts = [base, *_moments("classic", "k", "g"), _middle("med", "k", "k{i}"), f"off AS MATERIALIZED (SELECT g, {', '.join(f'abs(k{i} - v{i} * {SCALE}) AS o{i}' for i in P)} FROM k JOIN med USING (g))", _middle("dev", "off", "o{i}")]
    flat = ", ".join((f"greatest(1.4826e0 * dev.v{i}, {FLOORS[i]!r})" if i == j else "0e0") + f" AS l{i}{j}" for i in P for j in range(i + 1))
    parts.append(f"fit0 AS MATERIALIZED (SELECT g, 0 AS start, {', '.join(f'med.v{i} AS m{i}' for i in P)}, {flat}, 0e0 AS logdet FROM med JOIN dev USING (g) UNION ALL SELECT g, 1, {', '.join(_FIT[:-1])}, 0e0 FROM classic)")
    for s in range(STEPS):
        parts.append(f"near{s} AS MATERIALIZED (SELECT g, start, {', '.join(STATS)}, {_bin(_d2())} AS bin FROM k JOIN fit{s} USING (g))")
        parts.append(f"core{s} AS (SELECT * FROM near{s} JOIN {_cut(f'near{s}', 'g, start', SUPPORT)} USING (g, start) WHERE bin <= cut)")
        parts += _moments(f"new{s}", f"core{s}", "g, start")
        falls = f"n.logdet < o.logdet - {GAIN!r}" if s else "TRUE"
        parts.append(f"fit{s + 1} AS MATERIALIZED (SELECT o.g, o.start, {', '.join(f'CASE WHEN {falls} THEN n.{c} ELSE o.{c} END AS {c}' for c in _FIT)} FROM fit{s} o JOIN new{s} n USING (g, start))")
    parts.append(f"best AS MATERIALIZED (SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY logdet, start) AS i FROM fit{STEPS}) WHERE i = 1)")
    parts.append(f"nearz AS MATERIALIZED (SELECT g, {_bin(_d2())} AS bin FROM k JOIN best USING (g))")
    parts.append(f"fit AS MATERIALIZED (SELECT b.*, greatest(exp((cut + {0.5 - 14 * _BINS_PER_E}e0) / {_BINS_PER_E}e0) / {CHI2_MEDIAN}e0, 1e0) AS scale FROM best b JOIN {_cut('nearz', 'g', 0.5)} USING (g))")
    d2 = ", ".join(f"({_d2('x.', f'f{v}.')}) / f{v}.scale" for v in range(3))
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(coalesce({d2}) <= {CHI2_CUT}, TRUE) AS kept FROM x "
        "LEFT JOIN fit f0 ON f0.g = x.g0 LEFT JOIN fit f1 ON f1.g = x.g1 LEFT JOIN fit f2 ON f2.g = x.g2"
    )
