"""Runs dealt over shards: counts and balance, settings, coverage, order and comparison of modes; unique evidence and pair scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequence

#: Share of exact answers that the trained mode must gain on the base mode.
GAIN = 0.05


def dataset_counts(sharded: DataFrame, dataset: str) -> DataFrame:
    """Rows of each dataset in each shard."""
    return sharded.groupBy("shard", dataset).agg(F.count(F.lit(1)).alias("n"))


def unbalanced(rows: DataFrame, expected: DataFrame, dataset: str) -> DataFrame:
    """Datasets whose rows differ from expected (dataset, expected); a dataset on one side only counts 0 on the other."""
    n = rows.groupBy(F.col(dataset).alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    both = n.alias("l").join(expected.alias("r"), F.col("l.dataset").eqNullSafe(F.col("r.dataset")), "full_outer")
    out = both.select(F.coalesce("l.dataset", "r.dataset").alias("dataset"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"))
    return out.where("n <> expected")


def setting_differences(settings: DataFrame, names: list[str]) -> DataFrame:
    """(shard, setting) where a shard's setting is not that of the smallest shard; null equals null."""
    first = settings.agg(*[F.min_by(F.struct(n), "shard").alias(n) for n in names])
    differs = F.array_compact(F.array(*[F.when(~F.col(f"s.{n}").eqNullSafe(F.col(f"f.{n}.{n}")), F.lit(n)) for n in names]))
    return settings.alias("s").crossJoin(first.alias("f")).select("s.shard", F.explode(differs).alias("setting"))


def grid(cases: DataFrame, modes: list[str]) -> DataFrame:
    """Every case in every mode."""
    return cases.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))


def problems(results: DataFrame, cases: DataFrame, modes: list[str]) -> DataFrame:
    """(mode, case_id, problem): cases that a mode of the run misses, and results that are repeated or were not asked for."""
    return sequence.coverage(results, grid(cases.select("case_id"), modes), ["mode", "case_id"])


def in_order(results: DataFrame, cases: DataFrame, modes: list[str]) -> DataFrame:
    """Results with mode_no and position, the sort key: modes as given, then cases by their position."""
    number = F.array_position(F.array(*[F.lit(m) for m in modes]), F.col("mode")).cast("int")
    return results.join(cases.select("case_id", "position"), "case_id").withColumn("mode_no", number).where("mode_no > 0")


def comparison(summaries: DataFrame, *, base: str = "base", trained: str = "sft", gain: float = GAIN) -> DataFrame:
    """summaries (mode, exact_rate, gate_passed) -> gate_passed, improves, decision; no row unless both modes are there."""
    pick = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c)))
    both = summaries.agg(pick(base, "exact_rate").alias("b"), pick(trained, "exact_rate").alias("t"), pick(trained, "gate_passed").alias("gate_passed"))
    out = both.where("b IS NOT NULL AND t IS NOT NULL").select("gate_passed", (F.col("t") >= F.col("b") + F.lit(gain)).alias("improves"))
    return out.withColumn("decision", F.when(F.col("gate_passed") & F.col("improves"), "eligible_for_rl").otherwise("hold_before_rl"))


def unique_evidence(hits: DataFrame, *, by: str, doc: str, score: str, position: str, k: int = 5) -> DataFrame:
    """The best hit of each document (the earlier of equal ones), the k highest of each group; ties go to the document seen first."""
    best = hits.where(F.col(score).isNotNull()).groupBy(by, doc).agg(F.max_by(F.struct(score, position), F.struct(score, -F.col(position))).alias("b"), F.min(position).alias("seen"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(f"b.{score}"), "seen")))
    return ranked.where(F.col("rank") <= k).select(by, doc, "rank", f"b.{score}", f"b.{position}")


def pair_scores(pairs: DataFrame, scorer: Callable[[str, list[str]], np.ndarray], *, keys: list[str], query: Column, text: Column) -> DataFrame:
    """keys and score (float) of each pair. scorer(query, texts) gives one finite number for each text; anything else is an error.

    The texts of one query in an Arrow batch are scored in one call. Null texts are empty.
    """
    rows = pairs.select(*keys, F.coalesce(query, F.lit("")).alias("__query"), F.coalesce(text, F.lit("")).alias("__text"))
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", score float"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.empty(len(batch), dtype=np.float32)
            for asked, at in batch.groupby("__query", sort=False).indices.items():
                got = np.asarray(scorer(asked, batch["__text"].iloc[at].tolist()), dtype=np.float32).reshape(-1)
                if len(got) != len(at):
                    raise ValueError(f"{len(at)} texts, but {len(got)} scores")
                if not np.isfinite(got).all():
                    raise ValueError("a score is not finite")
                out[at] = got
            yield batch[keys].assign(score=out)

    return rows.mapInPandas(run, schema)
