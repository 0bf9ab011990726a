"""Quality rules: base rules, then robust multivariate outliers by language and source. DataFrame functions only.

A document's counts become a vector of five transformed statistics, kept as integers of 1 / SCALE, so that sums are exact and no
verdict depends on the order of rows. For each group (language and source, language, all) the minimum-covariance-determinant
estimate is sought from two starts: medians with median absolute deviations, and mean with covariance of all rows. Concentration
steps keep the `SUPPORT` share of rows nearest by Mahalanobis distance and take their mean and covariance, as long as a group's
determinant falls by more than `GAIN`; of the two ends the one of lower determinant is taken. Quantiles come from counts over
fixed bins, so each step is two partial aggregations of a narrow table and no group is gathered. Estimates, one row per group,
are broadcast while they are few, which is counted.
A row is judged by the finest group with at least `MIN_GROUP` rows and rejected beyond the cut-off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if_small, let, materialize, words_of

STATS = ("k0", "k1", "k2", "k3", "k4")
P = range(len(STATS))
SCALE, SUPPORT, GAIN, MIN_GROUP = 65_536, 0.75, 1e-3, 60
#: Chi-square quantiles at 5 degrees of freedom: the median, and the cut-off's (1 - 1e-4).
CHI2_MEDIAN, CHI2_CUT = 4.3515, 25.745
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
#: Spreads below which a statistic is not measured: the counting noise, 1 / (2 sqrt(n)), of a short text, 25 words of about 5
#: characters. Word length and the repeats count words, the other two characters.
FLOORS = tuple(round(0.5 / (25 * x) ** 0.5, 4) for x in (1, 5, 5, 1, 1))
_BINS_PER_E, _BIN_MAX, _COARSE = 32, 640, 256
#: Estimates, a few numbers each, that are broadcast; they are counted, and more of them are joined by shuffle.
BROADCAST_ROWS = 200_000


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of `width` words that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hash. Only texts in which two windows agree are sorted.
    """
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def from_sorted(s: Column) -> Column:
            m = F.size(s)
            # neighbours with the same hash: the later ones of a run, and the first of each run
            pairs = F.zip_with(F.slice(s, 1, m - 1), F.slice(s, 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            starts = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
            total = F.aggregate(starts, F.struct(F.lit(0).alias("c"), F.lit(-width).alias("last")), lambda acc, x: F.struct((acc["c"] + F.least(F.lit(width), x - acc["last"])).alias("c"), x.alias("last")), lambda acc: acc["c"])
            return total

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, from_sorted))

    def windows(w: Column) -> Column:
        ids = F.transform(w, lambda x: F.xxhash64(x))
        return let(ids, lambda h: let(F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(F.slice(h, i, width))), covered))

    return F.when(n <= width, F.lit(0)).otherwise(windows(words)).cast("long")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def text_stats(text: Column) -> Column:
    """A struct of COUNTS (long) of a text; null and empty texts: all 0."""
    t = F.coalesce(text, F.lit(""))

    def counts(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    return counts(words_of(text), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))


def _vector(c: str) -> list[Column]:
    """The statistics of a struct column of counts, as integers of 1 / SCALE."""
    n = lambda name: F.col(f"{c}.{name}")
    chars, words = n("word_chars") + F.lit(1.0), n("n_words") + F.lit(1.0)
    x = [
        F.log(chars / words), F.sqrt(n("n_symbols") / chars), F.sqrt(n("n_upper") / chars),
        F.sqrt(n("n_dup_lines") / (n("n_lines") + F.lit(1.0))), F.sqrt(n("n_repeat_words") / words),
    ]
    return [F.floor(v * F.lit(float(SCALE)) + F.lit(0.5)).cast("long").alias(k) for v, k in zip(x, STATS, strict=True)]


def base_failed(c: str) -> Column:
    return (F.col(f"{c}.n_words") < MIN_WORDS) | (F.lit(100) * F.col(f"{c}.n_repeat_words") > F.lit(MAX_REPEAT) * F.col(f"{c}.n_words"))


def _cholesky() -> list[str]:
    """Covariance columns c_ij (floored on the diagonal) -> factor columns l_ij, each by those before it, and logdet."""
    out = []
    for j in P:
        out.append(f"sqrt(greatest(c{j}{j}{''.join(f' - l{j}{k} * l{j}{k}' for k in range(j))}, {FLOORS[j] ** 2 * 0.25!r}D)) AS l{j}{j}")
        out += [f"(c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, len(STATS))]
    return [*out, f"{' + '.join(f'ln(l{j}{j})' for j in P)} AS logdet"]


_KEYS = ["g", "start"]
_FIT = [f"m{i}" for i in P] + [f"l{i}{j}" for i in P for j in range(i + 1)] + ["logdet"]


def _measured(df: DataFrame) -> DataFrame:
    """df with d2: the squared Mahalanobis distance, by forward substitution with the Cholesky factor."""
    z = [f"(k{i} / {SCALE}D - m{i}{''.join(f' - l{i}{j} * z{j}' for j in range(i))}) / l{i}{i} AS z{i}" for i in P]
    return df.selectExpr("*", *z, f"{' + '.join(f'z{i} * z{i}' for i in P)} AS d2")


def _bin(d2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(_BIN_MAX), F.floor(F.log(d2 + F.lit(1e-6)) * _BINS_PER_E) + F.lit(14 * _BINS_PER_E))).cast("int")


def _quantile(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, bin, n) -> per key the first bin at which `share` of the rows is reached (cut), and all its rows (n_group)."""
    run = counts.withColumn("run", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))).withColumn("everything", F.sum("n").over(Window.partitionBy(*keys)))
    return run.where(F.col("run") >= F.lit(share) * F.col("everything")).groupBy(*keys).agg(F.min("bin").alias("cut"), F.first("everything").alias("n_group"))


def group_key(level: int, lang: Column, source: Column) -> Column:
    """The key of a row's group; a null language or source is a value of its own, which the level tells from none."""
    none = F.lit(None).cast("string")
    return F.struct(F.lit(level).alias("level"), (lang if level < 2 else none).alias("lang"), (source if level < 1 else none).alias("source"))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Exact sums over rows -> mean, Cholesky factor of the covariance with floors, log determinant."""
    exact = "CAST(sum(CAST({} AS DECIMAL(20, 0))) AS DOUBLE) AS {}".format
    sums = [exact(f"k{i}", f"s{i}") for i in P] + [exact(f"k{i} * k{j}", f"q{i}{j}") for i in P for j in range(i + 1)]
    mean = [f"s{i} / n / {SCALE}D AS m{i}" for i in P]
    cov = [f"q{i}{j} / n / {SCALE}D / {SCALE}D - m{i} * m{j} + {FLOORS[i] ** 2 if i == j else 0.0!r}D AS c{i}{j}" for i in P for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.expr("CAST(count(1) AS DOUBLE) AS n"), *map(F.expr, sums)).selectExpr(*keys, *mean, *cov, *_cholesky()).select(*keys, *_FIT)


def _medians(keyed: DataFrame) -> DataFrame:
    """Median and median absolute deviation of each statistic by group, from counts over bins of _COARSE / SCALE."""

    def middle(value, rows: DataFrame) -> DataFrame:
        each = rows.select("g", F.posexplode(F.array(*[F.floor(value(i) / _COARSE).cast("int") for i in P])).alias("stat", "bin"))
        cut = _quantile(each.groupBy("g", "stat", "bin").agg(F.count(F.lit(1)).alias("n")), ["g", "stat"], 0.5)
        return broadcast_if_small(materialize(cut.groupBy("g").agg(*[F.max(F.when(F.col("stat") == i, (F.col("cut") + F.lit(0.5)) * (_COARSE / SCALE))).alias(f"v{i}") for i in P]), "medians"))

    med = middle(lambda i: F.col(STATS[i]), keyed)
    dev = middle(lambda i: F.abs(F.col(STATS[i]) - F.col(f"v{i}") * SCALE), keyed.join(med, "g"))
    both = med.select("g", *[F.col(f"v{i}").alias(f"m{i}") for i in P]).join(dev, "g")
    return both.select("g", *[f"m{i}" for i in P], *[(F.greatest(F.lit(1.4826) * F.col(f"v{i}"), F.lit(FLOORS[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in P for j in range(i + 1)], F.lit(0.0).alias("logdet"))


def fit_mcd(rows: DataFrame) -> DataFrame:
    """rows: lang, source and the statistics -> one row per group of MIN_GROUP rows or more: g, n_group, mean, Cholesky factor, scale.

    Every step reads `rows`, which should be materialized. The loop ends: each round some group's log determinant falls by more than
    GAIN, and none falls below the floors'.
    """
    levels = F.array(*[group_key(k, F.col("lang"), F.col("source")) for k in range(3)])
    each = rows.select(F.explode(levels).alias("g"), *STATS)
    groups = broadcast_if_small(materialize(each.groupBy("g").agg(F.count(F.lit(1)).alias("n_group")).where(F.col("n_group") >= MIN_GROUP), "groups"))
    each = each.join(groups.select("g"), "g", "left_semi")
    classic = _moments(each, ["g"]).withColumn("logdet", F.lit(0.0))
    now = _medians(each).withColumn("start", F.lit(0)).unionByName(classic.withColumn("start", F.lit(1))).withColumn("moved", F.lit(True))
    first = True
    while True:
        now = materialize(now, "mcd")
        n_going = now.where("moved").count()
        if not n_going:
            break
        few = F.broadcast if n_going <= BROADCAST_ROWS else lambda df: df
        near = each.join(few(now.where("moved").drop("moved")), "g")
        near = _measured(near).withColumn("bin", _bin(F.col("d2")))
        cut = _quantile(near.groupBy(*_KEYS, "bin").agg(F.count(F.lit(1)).alias("n")), _KEYS, SUPPORT)
        core = near.join(few(cut.select(*_KEYS, "cut")), _KEYS).where(F.col("bin") <= F.col("cut"))
        new = _moments(core.select(*_KEYS, *STATS), _KEYS)
        both = now.join(few(new.select(*_KEYS, F.struct(*_FIT).alias("new"))), _KEYS, "left")
        moved = F.lit(True) if first else F.col("new.logdet") < F.col("logdet") - F.lit(GAIN)
        now = both.withColumn("moved", F.coalesce(F.col("new").isNotNull() & moved, F.lit(False))).select(*_KEYS, *[F.expr(f"IF(moved, new.{c}, {c}) AS {c}") for c in _FIT], "moved")
        first = False
    best = now.groupBy("g").agg(F.min(F.struct("logdet", "start", F.struct(*_FIT).alias("fit"))).alias("x")).select("g", "x.fit.*")
    best = broadcast_if_small(materialize(best, "mcd_best"))
    # consistency: the median distance of all rows of the group belongs at the chi-square median; floors are not undone
    half = _quantile(_measured(each.join(best, "g")).withColumn("bin", _bin(F.col("d2"))).groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n")), ["g"], 0.5)
    median = F.exp((F.col("cut") + F.lit(0.5 - 14 * _BINS_PER_E)) / F.lit(float(_BINS_PER_E)))
    return materialize(best.join(half, "g").select("g", *_FIT, "n_group", F.greatest(median / F.lit(CHI2_MEDIAN), F.lit(1.0)).alias("scale")), "mcd_scaled")


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", slim: bool = False) -> DataFrame:
    """All columns of docs (slim: only the id) and qr_* counts, qr_base_failed, qr_distance (double, null if base_failed), qr_kept.

    Null or empty texts have no word and fail the base rules. Very long texts are read whole. Null language or source: a group of
    its own. Null and repeated ids and repeated rows are judged each, alike for like texts. With fewer than MIN_GROUP rows that
    pass the base rules in the whole table there is no estimate and the base rules alone decide. Empty table: no rows. Columns may
    have any names: only those that are returned here, qr_ and a name of COUNTS, base_failed, distance or kept, are replaced.
    """
    made = [f"qr_{c}" for c in (*COUNTS, "base_failed", "distance", "kept")]
    head = [F.col(f"`{c}`") for c in ([id_col] if slim else [c for c in docs.columns if c not in made])]
    rows = docs.select(F.struct(*head).alias("row"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), text_stats(F.col(f"`{text_col}`")).alias("c"))
    stats = materialize(rows.select("row", "lang", "source", "c", base_failed("c").alias("failed"), *_vector("c")), "quality_stats")
    fit = fit_mcd(stats.where("NOT failed"))
    out = stats
    for level in range(3):
        own = fit.where(F.col("g.level") == level).select(F.col("g").alias(f"g{level}"), F.struct(*_FIT, "scale").alias(f"f{level}"))
        out = out.join(broadcast_if_small(own), F.col(f"g{level}") == group_key(level, F.col("lang"), F.col("source")), "left")
    out = _measured(out.withColumn("f", F.coalesce("f0", "f1", "f2")).select("row", "c", "failed", *STATS, "f.*"))
    distance = F.when(~F.col("failed"), F.col("d2") / F.col("scale"))
    out = out.withColumn("d2", distance).withColumn("kept", ~F.col("failed") & F.coalesce(F.col("d2") <= F.lit(CHI2_CUT), F.lit(True)))
    return out.select("row.*", *[F.col(f"c.{c}").alias(f"qr_{c}") for c in COUNTS], F.col("failed").alias("qr_base_failed"), F.col("d2").alias("qr_distance"), F.col("kept").alias("qr_kept"))
