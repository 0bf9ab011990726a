"""Stored tables: scratch materialization, versioned publication, manifests, upserts."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import exists

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which executors and driver share; where it is unset (tests), a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _own[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it back: lineage ends here, and columns can still be pruned."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/corvane/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def keeper(content: DataFrame, what: str) -> Callable[[str, Callable[[], DataFrame]], DataFrame]:
    """keep(name, build): the table that build() makes, stored under a hash of `content` and of `what` is made of it.

    Made once in an application: equal content finds the stored table. The hash takes one scan of the content, whatever its order:
    its rows, and two sums of independent row hashes.
    """
    spark, row = content.sparkSession, [F.col(f"`{c}`") for c in content.columns]
    seen = content.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*row).cast("decimal(20,0)")), F.sum(F.xxhash64(F.lit(what), *row).cast("decimal(20,0)"))).first()
    digest = hashlib.sha256(repr((what, *map(str, seen))).encode()).hexdigest()[:32]
    root = f"{scratch_dir(spark)}/corvane/{spark.sparkContext.applicationId}/{digest}"

    def keep(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{root}/{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
            _written.append((spark, path))
        return spark.read.parquet(path)

    return keep


def release(spark: SparkSession) -> None:
    """Delete the scratch tables written so far; DataFrames that still read them become invalid."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop()[1])
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    if _written and _written[0][0].sparkContext._jsc is not None:
        try:
            release(_written[0][0])
        except Exception:  # the JVM may be gone already; the folder is then the cluster's to clean
            _written.clear()


def broadcast_if_small(df: DataFrame, rows: int = 200_000, *, merge: bool = False) -> DataFrame:
    """A broadcast hint if df has at most `rows` rows, which is counted.

    merge: a merge hint else. Without it the planner judges a stored table by its compressed bytes, and may broadcast many more rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge") if merge else df


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest version of each key wins; of equal versions the change does."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return latest(both, keys, [F.desc(version), F.desc("__new")]).drop("__new")


def insert_or_ignore(current: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing keys stay; of new rows with one key the first by `order` is added."""
    fresh = latest(rows, keys, [F.col(order)]).join(current.select(*keys), keys, "left_anti")
    return current.unionByName(fresh)


def delete_cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the doomed keys."""
    return parents.join(doomed, key, "left_anti"), children.join(doomed, key, "left_anti")


def manifest(spark: SparkSession, glob: str) -> DataFrame:
    """(path, bytes, sha256) of files, for checks of frozen data."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of files that are missing, unexpected or changed."""
    both = expected.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("have"), "changed")
    return both.withColumn("problem", problem).where("problem IS NOT NULL")


def write_report(rows: DataFrame, path: str) -> None:
    """A report of few rows as one file of JSON lines."""
    rows.coalesce(1).write.mode("overwrite").json(path)
