"""Conditions that rows must meet: a job fails at the first row that does not, with what is wrong, in the pass that reads it.

Nothing is counted beforehand. Conditions on whole tables (how many rows, how many of a kind) are counted while the rows go by and
are checked once the job has run.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.storage import broadcast_if_small


def must(df: DataFrame, condition: Column, message: Column) -> DataFrame:
    """The rows as they are; a row for which the condition is false or null fails the job with its message."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))


def _named(keys: Iterable[str]) -> Column:
    return F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])


def unique(df: DataFrame, keys: list[str], *, what: str = "key") -> DataFrame:
    """The rows; a key that comes twice fails the job."""
    seen = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    return must(seen, F.col("__n") == 1, F.concat(F.lit(f"repeated {what}: "), _named(keys))).drop("__n")


def strict_join(left: DataFrame, right: DataFrame, on: list[str], *, what: str = "key") -> DataFrame:
    """An inner join in which every left row must find its one right row; one that does not fails the job with its key."""
    rows = left.join(unique(right, on, what=what).withColumn("__held", F.lit(True)), on, "left")
    return must(rows, F.col("__held").isNotNull(), F.concat(F.lit(f"missing {what}: "), _named(on))).drop("__held")


def strict_lookup(left: DataFrame, mapping: DataFrame, *, key: str, value: str, name: str, what: str = "key") -> DataFrame:
    """left with `name`, the mapping's value for its key; a key that the mapping lacks or has twice fails the job."""
    known = mapping.select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.lit(True).alias("__held"))
    known = unique(known, ["__k"], what=what)
    rows = left.join(broadcast_if_small(known), left[key].eqNullSafe(F.col("__k")), "left")
    return must(rows, F.col("__held").isNotNull(), F.concat(F.lit(f"missing {what}: "), _named([key]))).withColumn(name, F.col("__v")).drop("__k", "__v", "__held")


def formal(cases: DataFrame, *, split: str, id_col: str = "case_id", split_col: str = "split", reviewed_col: str = "reviewed") -> DataFrame:
    """The cases of a split, every one of which must have been reviewed."""
    return must(cases.where(F.col(split_col) == split), F.col(reviewed_col), F.concat(F.lit("not reviewed: "), F.col(id_col).cast("string")))


def without_drafts(rows: DataFrame, *, status_col: str = "review_status", drafts: tuple[str, ...] = ("draft", "unreviewed")) -> DataFrame:
    """Rows whose status is known and no draft."""
    return rows.where(F.col(status_col).isNotNull() & ~F.lower(status_col).isin(*drafts))


class Counted:
    """Counts taken while a table's rows go by, and what must hold of them.

    counted = Counted(cases, n=F.count(F.lit(1)), last=F.max("number")); use counted.rows; then, once the job has run,
    counted.check(lambda c: c["n"] > 0, "no cases").
    """

    def __init__(self, df: DataFrame, **counts: Column):
        self._seen = Observation()
        self.rows = df.observe(self._seen, *[c.alias(n) for n, c in counts.items()])

    def check(self, holds, message: str) -> dict:
        found = self._seen.get
        if not holds(found):
            raise ValueError(f"{message}: {found}")
        return found
