"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same number of expected copies, its source's target / size. Documents are put in order
within their source (by size class, then by a hash), the expected copies are prefix-summed in that order, one random offset
per source is added, and a document is emitted once per integer boundary that its stretch of the sum crosses.

The prefix sum never gathers a source: rows are ranked inside small (source, size class, hash) buckets, and a bucket's offset
comes from the counts of the smaller size classes and of the buckets before it in its class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, materialize

WEIGHTS = (5, 2, 1)
SHARE, CAP, SUB_BUCKETS = 1.5, 2.0, 4096


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> also target and rate.

    Sources by code point, null last, weigh `weights` in turn. The total to share is `share` times all sizes. A source's
    target stops at `cap` times its size, and the rest is shared again by weight: with sources in order of cap / weight,
    those capped are a prefix, so one running sum finds the water level. Works on one row per source.
    """
    whole = Window.partitionBy(F.lit(0))
    by_name = whole.orderBy(F.col("source").asc_nulls_last())
    by_fill = whole.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    out = sizes.withColumn("__w", w).withColumn("__cap", F.lit(float(cap)) * F.col("source_size"))
    out = out.withColumn("__all", F.lit(float(share)) * F.sum("source_size").over(whole)).withColumn("__ws", F.sum("__w").over(whole))
    # the level if exactly the sources before this one are capped; the first source whose own cap reaches its level ends the prefix
    level = (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.col("__ws") - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    out = out.withColumn("__level", level)
    out = out.withColumn("__water", F.min(F.when(F.col("__cap") >= F.col("__level") * F.col("__w"), F.struct(F.row_number().over(by_fill).alias("k"), F.col("__level").alias("v")))).over(whole))
    target = F.least(F.col("__cap"), F.coalesce(F.col("__water.v") * F.col("__w"), F.col("__cap")))
    out = out.withColumn("target", target)
    return out.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def _size_class(size: Column) -> Column:
    """Digits and the two leading ones: classes at most a tenth wide."""
    s = size.cast("string")
    return F.length(s) * 100 + F.substring(s, 1, 2).cast("int")


def _fraction(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "0") -> DataFrame:
    """All columns of docs, and mx_size, mx_source_size, mx_target, mx_copies (long: how often the mix takes the row).

    size: the row's size as a Column; by default its words.
    Null or empty texts: size 0, still ranked, taken words 0. Null source: a source of its own, last. Null or repeated ids and
    repeated rows: each row is one document; rows that tie in size and hash are interchangeable. Empty table: no rows.
    A source of size 0 has target 0 and no copies. Columns may have any names: only those four mx_ columns of docs are replaced.
    Very long texts are read whole.
    """
    kept = [c for c in docs.columns if c not in ("mx_size", "mx_source_size", "mx_target", "mx_copies")]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{id_col}`").alias("id"),
        F.coalesce(size if size is not None else count_words(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("mx_size"),
        # a key without nulls, so that the window and the join share one partitioning; the null source sorts last
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`")), F.lit("~")).alias("__src"),
    )
    rows = base.withColumns({"__digest": F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))), "__class": _size_class(F.col("mx_size"))})
    rows = rows.withColumn("__sub", F.conv(F.substring("__digest", 1, 4), 16, 10).cast("int") % SUB_BUCKETS)
    buckets = materialize(rows.groupBy("__src", "__class", "__sub").agg(F.count(F.lit(1)).alias("__n"), F.sum("mx_size").alias("__size")), "buckets")
    # rows before a bucket: those of the smaller classes of its source, then those of the earlier buckets of its class
    classes = buckets.groupBy("__src", "__class").agg(F.sum("__n").alias("__n"), F.sum("__size").alias("__size"))
    smaller = Window.partitionBy("__src").orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("__src", "__class").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = classes.groupBy("__src").agg(F.sum("__size").alias("source_size")).withColumn("source", F.when(F.col("__src") != "~", F.substr("__src", F.lit(2))))
    targets = source_targets(sizes.select("source", "source_size"), weights=weights, share=share, cap=cap).withColumn("__src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")))
    starts = classes.select("__src", "__class", F.coalesce(F.sum("__n").over(smaller), F.lit(0)).alias("__start")).join(targets, "__src")
    inner = buckets.select("__src", "__class", "__sub", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__inner"))
    plan = inner.join(starts, ["__src", "__class"]).select(
        F.col("__src").alias("__p_src"), F.col("__class").alias("__p_class"), F.col("__sub").alias("__p_sub"), (F.col("__start") + F.col("__inner")).alias("__before"),
        F.col("source_size").alias("mx_source_size"), F.col("target").alias("mx_target"), F.col("rate").alias("__rate"),
        _fraction(F.concat_ws("|", F.lit(f"offset-{seed}"), F.col("source"))).alias("__u"),
    )
    inside = Window.partitionBy("__src", "__class", "__sub").orderBy("mx_size", "__digest", "id")
    ranked = rows.withColumn("__k", F.row_number().over(inside))
    placed = ranked.join(plan, (F.col("__src") == F.col("__p_src")) & (F.col("__class") == F.col("__p_class")) & (F.col("__sub") == F.col("__p_sub")))
    k = (F.col("__before") + F.col("__k")).cast("double")
    crossed = F.floor(k * F.col("__rate") + F.col("__u")) - F.floor((k - F.lit(1.0)) * F.col("__rate") + F.col("__u"))
    placed = placed.withColumn("mx_copies", F.least(crossed, F.ceil("__rate")).cast("long"))
    return placed.select("row.*", "mx_size", "mx_source_size", "mx_target", "mx_copies")


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it has copies, without the four mx_ columns of `mix`."""
    keep = [c for c in mixed.columns if c not in ("mx_size", "mx_source_size", "mx_target", "mx_copies")]
    rows = mixed.where("mx_copies > 0").select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.explode(F.sequence(F.lit(1), F.col("mx_copies").cast("int"))))
    return rows.select("row.*")
