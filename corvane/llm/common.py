"""Shared helpers of the training-data operators: tables, scratch storage, let-bindings, word patterns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_base: dict[str, str] = {}
_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir, or, where that is unset (tests), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_base:
        _own_base[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _own_base[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back (columns stay prunable)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[tuple[SparkSession, str]]]:
    """The scratch tables written inside, for `discard` once their readers are done."""
    before, tables = len(_scratch), []
    try:
        yield tables
    finally:
        tables += _scratch[before:]


def discard(tables: list[tuple[SparkSession, str]]) -> None:
    """Delete these scratch tables; DataFrames that still read them become invalid."""
    while tables:
        spark, name = tables.pop()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if (spark, name) in _scratch:
            _scratch.remove((spark, name))


def release(spark: SparkSession) -> None:
    """Delete the scratch tables written so far; DataFrames that still read them become invalid."""
    discard([t for t in _scratch if t[0] is spark])


@atexit.register
def _release_at_exit() -> None:
    if _scratch and _scratch[0][0].sparkContext._jsc is not None:
        try:
            release(_scratch[0][0])
        except Exception:  # the JVM may be gone already; the folder is then the cluster's to clean
            _scratch.clear()


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, which is counted; else as it is. For rows a few short columns wide."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """Bind value to a name inside body: a value used in a lambda is otherwise computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def count_words(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
