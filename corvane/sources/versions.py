"""Versions of a table: written beside each other, published by one file that must not exist yet, read as of one version.

A version is a small JSON file that names the folders its rows lie in. Publishing creates the file of the next number; of two
publishers that saw the same version only one can, the other gets an error and its rows are deleted. Readers take a version's
folders, which never change, so they see all of it or none.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class ConcurrentPublish(RuntimeError):
    """Another publisher made the version in between."""


def _path(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(conf)
    return jvm, conf, files, files.makeQualified(at)


def remove(spark: SparkSession, path: str) -> None:
    _, _, files, at = _path(spark, path)
    files.delete(at, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text if there is none; whether that was so. The file appears whole or not at all."""
    jvm, conf, files, at = _path(spark, path)
    files.mkdirs(at.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if at.toUri().getScheme() == "file":  # a local rename replaces what is there, a link does not
            nio = jvm.java.nio.file
            nio.Files.createLink(nio.Path.of(at.toUri()), nio.Path.of(draft.toUri()))
        else:
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(draft, at, none)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        return False
    finally:
        files.delete(draft, False)
    return True


def _file(root: str, version: int) -> str:
    return f"{root}/_versions/v{version:09d}.json"


def latest_version(spark: SparkSession, root: str) -> int:
    """The number of the last version; 0 if there is none."""
    _, _, files, at = _path(spark, f"{root}/_versions")
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)


def folders(spark: SparkSession, root: str, version: int) -> list[str]:
    """Where a version's rows lie, oldest part first; none for version 0."""
    if not version:
        return []
    return json.loads(spark.read.text(_file(root, version), wholetext=True).first()[0])["folders"]


def publish(df: DataFrame, root: str, *, after: int | None = None, add: bool = False) -> int:
    """Write df and make it the version that follows `after` (as a rule the last); its number.

    add: the rows join those of the version before, else they take their place. ConcurrentPublish if another publisher has made
    that version meanwhile; a failure before the end leaves the last version as it is.
    """
    spark = df.sparkSession
    base = latest_version(spark, root) if after is None else after
    before = folders(spark, root, base) if add else []
    path = f"{root}/data/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    if not create_once(spark, _file(root, base + 1), json.dumps({"version": base + 1, "folders": [*before, path]})):
        remove(spark, path)
        raise ConcurrentPublish(f"version {base + 1} of {root} has been published by another")
    return base + 1


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, as a rule of the last: later publishers do not change them."""
    at = latest_version(spark, root) if version is None else version
    if not at:
        raise ValueError(f"{root} has no version yet")
    return spark.read.parquet(*folders(spark, root, at))


def retire(spark: SparkSession, root: str, *, keep: int = 2) -> list[str]:
    """Delete the rows that none of the last `keep` versions names, once no reader holds an older one; their folders."""
    last = latest_version(spark, root)
    kept = {f for v in range(max(1, last - keep + 1), last + 1) for f in folders(spark, root, v)}
    old = sorted({f for v in range(1, max(1, last - keep + 1)) for f in folders(spark, root, v)} - kept)
    for f in old:
        remove(spark, f)
    return old
