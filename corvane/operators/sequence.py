"""Order-dependent operators as windows: budgets, quotas, carry-forward, attempts, status logs, resumption, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import broadcast_if_small, latest, materialize


def running_budget(df: DataFrame, *, by: list[str], order: list[Column], cost: Column, budget: Column | int, name: str = "status") -> DataFrame:
    """spent (before the row) and status: taken while the budget lasts, then skipped. Rows of cost 0 are always taken."""
    run = Window.partitionBy(*by).orderBy(*order)
    limit = F.lit(budget) if isinstance(budget, int) else budget
    out = df.withColumn("spent", F.coalesce(F.sum(cost).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.withColumn(name, F.when(cost == 0, "free").when(F.col("spent") + cost <= limit, "taken").otherwise("skipped"))


def quotas(total: Column, tasks: Column, position: Column) -> Column:
    """Fair shares given out one after another as remaining // tasks left: the last (total mod tasks) tasks get one more."""
    return F.floor(total / tasks) + F.when(position > tasks - F.pmod(total, tasks), 1).otherwise(0)


def context_share(total: Column, by: Column, least: int = 1000) -> Column:
    return F.greatest(F.floor(total / F.count(F.lit(1)).over(Window.partitionBy(by))), F.lit(least))


def carry_forward(df: DataFrame, *, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null value so far."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order)))


def markdown_sections(lines: DataFrame, *, by: list[str], order: str, line: str) -> DataFrame:
    """Lines with in_code and section, the heading they stand under; fences switch headings off."""
    run = Window.partitionBy(*by).orderBy(order)
    out = lines.withColumn("__fence", F.col(line).rlike(r"^\s*(```|~~~)").cast("int")).withColumn("in_code", F.pmod(F.sum("__fence").over(run), F.lit(2)) == 1)
    heading = F.when(~F.col("in_code") & (F.col("__fence") == 0) & F.col(line).rlike(r"^#{1,6}\s+\S"), F.trim(F.regexp_replace(line, r"^#{1,6}\s+|\s+#*\s*$", "")))
    return carry_forward(out, by=by, order=order, value=heading, name="section").drop("__fence")


def attempts(df: DataFrame, *, by: list[str], order: str) -> DataFrame:
    """attempt: 1 + earlier rows of the key."""
    return df.withColumn("attempt", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def latest_attempt(df: DataFrame, *, by: list[str], attempt: str, position: str) -> DataFrame:
    """Last attempt of each key; the later row wins ties."""
    return latest(df, by, [F.desc(attempt), F.desc(position)])


def job_status(log: DataFrame, *, key: str, status: str = "status", ts: str = "ts", terminal: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """A status log as one row a job: last status, started_at set once, completed_at when terminal."""
    return log.groupBy(key).agg(F.max_by(status, ts).alias("status"), F.min(F.when(F.col(status) != "pending", F.col(ts))).alias("started_at"), F.max(F.when(F.col(status).isin(*terminal), F.col(ts))).alias("completed_at"))


def partial_updates(current: DataFrame, log: DataFrame, *, key: str, order: str, columns: list[str]) -> DataFrame:
    """Rows with each column at its last value in the log that is not null; a column that no update names stays. Updates of keys that
    are not there are left out."""
    last = log.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__{c}") for c in columns])
    out = current.join(last, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns})
    return out.drop(*[f"__{c}" for c in columns])


def with_latest(rows: DataFrame, attempts: DataFrame, *, key: str, attempt: str, position: str, name: str = "latest") -> DataFrame:
    """Rows with their last attempt as a struct, null where there is none; of equal attempts the later position counts."""
    last = attempts.groupBy(key).agg(F.max_by(F.struct(*[c for c in attempts.columns if c != key]), F.struct(F.col(attempt).alias("a"), F.col(position).alias("p"))).alias(name))
    return rows.join(last, key, "left")


def fresh(df: DataFrame, *, now: Column, status: str = "status", expires: str = "expires_at") -> DataFrame:
    return df.where((F.col(status) == "ready") & (F.col(expires) > now))


def freshest(df: DataFrame, *, key: str, fetched: str, now: Column) -> DataFrame:
    """As-of lookup: the newest document of each key that has not expired."""
    return latest(df.where((F.col("expires_at") > now) & (F.col(fetched) <= now)), [key], [F.desc(fetched)])


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def numbered(df: DataFrame, *, order: list[str], name: str = "no") -> DataFrame:
    """Rows with their place from 0 in a total order, from per-partition counts: no row is gathered.

    Rows are range-partitioned by `order` and stored once with their partition, so that counts and places agree; a row's number
    is its place in its partition plus the sizes of those before.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    own = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return own.join(broadcast_if_small(before), "__p").withColumn(name, F.col("__b") + F.col("__i") - 1).drop("__p", "__i", "__b")


def shards(df: DataFrame, *, order: list[str], n: int) -> DataFrame:
    """Round-robin shard of each row of a total order."""
    return numbered(df, order=order, name="__no").withColumn("shard", F.pmod("__no", F.lit(n)).cast("int")).drop("__no")


def coverage(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: missing, unexpected or repeated rows of a sharded result."""
    have = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    both = expected.select(*keys).distinct().withColumn("__want", F.lit(1)).join(have, keys, "full_outer")
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__want").isNull(), "unexpected").when(F.col("__n") > 1, "repeated")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select(*keys, "problem")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return (ts.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second").cast("decimal(20,6)").cast("double")


def event_sequence(events: DataFrame, *, by: str, ts: str, tie: str) -> DataFrame:
    """seq from 1 and seconds since the first event of each run."""
    run = Window.partitionBy(by).orderBy(ts, tie)
    return events.withColumn("seq", F.row_number().over(run)).withColumn("elapsed", seconds(F.col(ts)) - F.first(seconds(F.col(ts))).over(run))


def protocol_state(steps: DataFrame, *, case: str = "case_id", step: str = "step") -> DataFrame:
    """steps (action, ids, ok) -> how many ids were discovered, read and evaluated before each step.

    An id counts from the first step of its kind that names it: a minimum per id, then a running sum, linear in a case's steps.
    """
    named = steps.where("ok AND action IN ('search', 'read', 'evaluate')").select(case, step, "action", F.explode("ids").alias("id"))
    first = named.groupBy(case, "action", "id").agg(F.min(step).alias(step))
    new = first.groupBy(case, step).agg(*[F.count_if(F.col("action") == a).alias(f"__{a}") for a in ("search", "read", "evaluate")])
    before = Window.partitionBy(case).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    out = steps.join(new, [case, step], "left")
    return out.withColumns({n: F.coalesce(F.sum(f"__{a}").over(before), F.lit(0)) for n, a in (("discovered", "search"), ("read", "read"), ("evaluated", "evaluate"))}).drop("__search", "__read", "__evaluate")
