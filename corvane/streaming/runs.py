"""Stateful runs: status machine and budget of each run, kept between micro-batches; runs that are checkpointed, resumed and cancelled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.readers import exists
from ..sources.versions import remove

ORDER = ("pending", "running", "completed", "failed")
OUT = "run_id string, status string, used double, exceeded boolean, events bigint"
STATE = "status string, used double, events bigint"


def budgets(events: DataFrame, *, limit: float) -> DataFrame:
    """events (run_id, kind, cost) -> each run's status, what it has used and whether that is beyond the limit, after each batch.

    Terminal states stay; costs after them are not counted.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, used, n = state.get if state.exists else ("pending", 0.0, 0)
        for batch in batches:
            for kind, cost in batch[["kind", "cost"]].itertuples(index=False):
                if status in ("completed", "failed"):
                    break
                n, used = n + 1, used + float(cost or 0)
                status = kind if kind in ("completed", "failed") else "failed" if used > limit else "running"
        state.update((status, used, n))
        yield pd.DataFrame([{"run_id": key[0], "status": status, "used": used, "exceeded": used > limit, "events": n}])

    return events.groupBy("run_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


class Cancelled(Exception):
    """The run was asked to stop."""


def request_cancel(spark: SparkSession, control: str, run: str) -> None:
    """Ask a run to stop before its next batch."""
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").json(f"{control}/cancel/run={run}")


def withdraw_cancel(spark: SparkSession, control: str, run: str) -> None:
    remove(spark, f"{control}/cancel/run={run}")


def run_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], *, run: str, stage: str, sink: str, control: str) -> str:
    """Work through what a stream has, batch by batch: `completed`, or `cancelled` where the run was asked to stop.

    Whether it was is read anew before each batch. A batch's rows replace those of an earlier try of the same run and batch, so
    that a batch cut short is written once in the end; then its progress is noted: version, stage, rows. The stream's own
    checkpoint tells a later call where to go on, after a crash, a failure or a withdrawn cancel alike.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        if exists(batch.sparkSession, f"{control}/cancel/run={run}/_SUCCESS"):
            raise Cancelled(run)
        at, seen = f"{sink}/run={run}/batch={number}", Observation()
        work(batch).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(at)
        note = [(number + 1, stage, seen.get["n"])]
        batch.sparkSession.createDataFrame(note, "version bigint, stage string, rows bigint").coalesce(1).write.mode("overwrite").json(f"{control}/progress/run={run}/batch={number}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{control}/state/run={run}").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        if f"Cancelled: {run}" not in str(error):
            raise
        return "cancelled"
    return "completed"


def progress(spark: SparkSession, control: str, run: str) -> DataFrame:
    """(version, stage, rows, batch) of the batches that a run has done."""
    return spark.read.schema("version bigint, stage string, rows bigint, batch bigint").json(f"{control}/progress/run={run}")


def results(spark: SparkSession, sink: str, run: str, schema: str) -> DataFrame:
    """What a run's batches have written, each batch once."""
    return spark.read.schema(schema).parquet(f"{sink}/run={run}").drop("batch")
