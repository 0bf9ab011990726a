"""Calls that may fail, row by row inside Arrow batches: tried again after a growing pause, failures kept as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_retries(rows: DataFrame, call: Callable[[object], str], *, key: str, value: str, attempts: int = 3, pause: float = 1.0, in_flight: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, result, error, attempts): call(value) of each row, a string.

    An exception is tried again after pause * 2**k seconds, `attempts` times in all; what then still fails is a row with the name
    of its last error. At most `in_flight` calls of a task run at once, and a batch's rows come out in its order, so that a call
    that depends on its value and attempt alone gives the same rows in every run. A null value is not called.
    """
    if attempts < 1 or in_flight < 1:
        raise ValueError("attempts and calls in flight must be at least 1")

    def one(v: object) -> tuple[str | None, str | None, int]:
        if v is None:
            return None, None, 0
        for k in range(attempts):
            try:
                return call(v), None, k + 1
            except Exception as error:
                name = type(error).__name__
                if k + 1 < attempts:
                    sleep(pause * 2**k)
        return None, name, attempts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                done = list(pool.map(one, batch.column("value").to_pylist()))
                columns = [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, "result", "error", "attempts"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(value).alias("value")).mapInArrow(run, f"{key} {kind}, result string, error string, attempts int")
