"""Readers and writers: JSONL, TSV qrels, corpora, event streams in text form, logs. Schemas are always declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOCUMENT = "id string, title string, content string, source string, metadata map<string,string>"
QREL = "query_id string, document_id string, relevance int"


def read_jsonl(spark: SparkSession, path: str, schema: str = DOCUMENT, *, key: str | None = "id") -> DataFrame:
    """JSON lines of a declared schema; blank lines are skipped, broken ones fail, repeated keys are an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    if key:
        twice = rows.groupBy(key).count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"repeated {key}: {[r[key] for r in twice]}")
    return rows


def unknown_fields(lines: DataFrame, allowed: StructType, column: str = "value") -> DataFrame:
    """Lines with fields outside the schema, which from_json would drop in silence."""
    extra = F.array_except(F.json_object_keys(column), F.array(*[F.lit(f) for f in allowed.fieldNames()]))
    return lines.withColumn("unknown", extra).where(F.size("unknown") > 0)


def write_jsonl(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_qrels(spark: SparkSession, path: str, *, positive: bool = False) -> DataFrame:
    """TSV with a header; the column names of the common variants are taken."""
    raw = spark.read.csv(path, sep="\t", header=True)
    have = set(raw.columns)
    pick = lambda *names: F.coalesce(*[F.col(f"`{n}`") for n in names if n in have])
    out = raw.select(pick("query-id", "query_id").alias("query_id"), pick("corpus-id", "document_id").alias("document_id"), pick("score", "relevance").cast("int").alias("relevance"))
    return out.where("relevance > 0") if positive else out


def write_qrels(df: DataFrame, path: str) -> None:
    df.select("query_id", "document_id", "relevance").write.csv(path, sep="\t", header=True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a file that may not be there yet: then no rows."""
    return read_jsonl(spark, path, schema, key=None) if exists(spark, path) else spark.createDataFrame([], schema)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add rows to a log; what earlier runs wrote stays."""
    write_jsonl(df, path, mode="append")


MESSAGES = "id string, messages array<struct<role:string,content:string>>, trajectory_sha256 string"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Training rows with nested messages, of a declared schema."""
    return spark.read.schema(MESSAGES).parquet(path)


BEIR = "_id string, title string, text string"


def read_corpus(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """A corpus of {_id, title, text} lines by id, restricted to ids (column _id) before anything else is done with it."""
    rows = read_jsonl(spark, path, BEIR, key=None)
    rows = rows.join(ids, "_id", "left_semi") if ids is not None else rows
    return rows.select("_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")).orderBy("_id")


def read_corpus_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids alone: no other field is parsed."""
    return read_jsonl(spark, path, "_id string", key=None)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of {_id, text} lines; blank texts are dropped."""
    rows = read_jsonl(spark, path, "_id string, text string", key=None)
    return rows.select(F.col("_id").alias("query_id"), F.trim("text").alias("text")).where("text <> ''")


def bounded(df: DataFrame, order: list[str | Column], *, skip: int, limit: int) -> DataFrame:
    """Rows skip + 1 to skip + limit of a total order."""
    return df.orderBy(*order).offset(skip).limit(limit)


def search_results(responses: DataFrame, *, limit: int = 10) -> DataFrame:
    """responses (query, results: array of title, url, snippet) -> ranked rows; results without a URL keep no rank of their own.

    limit is held within 1..20.
    """
    n = max(1, min(20, limit))
    rows = responses.select("query", F.posexplode(F.slice("results", 1, n)).alias("at", "r"))
    return rows.where(F.coalesce(F.trim("r.url"), F.lit("")) != "").select("query", (F.col("at") + 1).alias("rank"), "r.title", "r.url", "r.snippet")


def page_error(url: Column, status: Column, media_type: Column, size: Column, *, most: int = 2_000_000) -> Column:
    """Why a fetched page is not read; null if it is: scheme, status, media type, size."""
    kind = F.trim(F.substring_index(F.lower(F.coalesce(media_type, F.lit(""))), ";", 1))
    return (
        F.when(~F.coalesce(url.rlike("(?i)^https?://[^/?#]+"), F.lit(False)), "invalid_url").when(~status.between(200, 299), "http_status")
        .when(~kind.isin("text/html", "application/xhtml+xml", "text/plain"), "unsupported_media_type").when(size > most, "response_too_large")
    )


def status_line(lines: DataFrame) -> DataFrame:
    """(updated_at, state, details) of a tab-separated status line; without a line: not_started."""
    parts = F.split(F.trim(F.max("value")), "\t")
    row = lines.agg(parts.alias("p"))
    return row.select(F.col("p")[0].alias("updated_at"), F.when(F.col("p").isNull(), "not_started").otherwise(F.coalesce(F.get("p", F.lit(1)), F.lit("unknown"))).alias("state"), F.when(F.size("p") > 2, F.slice(F.col("p"), 3, F.greatest(F.size("p") - 2, F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("details"))


def read_devices(lines: DataFrame) -> DataFrame:
    """(index, uuid, used_mib) of a device list in CSV without a header."""
    row = F.from_csv("value", "index int, uuid string, used_mib int", {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "FAILFAST"})
    return lines.where(F.trim("value") != "").select(row.alias("r")).select("r.*")


def idle_devices(devices: DataFrame, busy: DataFrame, *, most_mib: int = 64) -> DataFrame:
    """Devices that no process (busy: uuid) uses and whose memory is nearly free."""
    return devices.where(F.col("used_mib") <= most_mib).join(busy.select("uuid"), "uuid", "left_anti").select("index").orderBy("index")


def latest_checkpoint(files: DataFrame) -> DataFrame:
    """files (checkpoint, name) -> the checkpoint of the highest step and whether all its parts are there: two shards each of model,
    optimizer and extra state, the data loader's state and the configuration."""
    step = F.substring_index("checkpoint", "_", -1).cast("int")
    shards = lambda kind: F.count_if(F.col("name").rlike(f"^{kind}_world_size_.*\\.pt$"))
    each = files.groupBy(step.alias("step")).agg(
        shards("model").alias("model"), shards("optim").alias("optim"), shards("extra_state").alias("extra"), F.max((F.col("name") == "data.pt").cast("int")).alias("data"), F.max((F.col("name") == "huggingface").cast("int")).alias("config"),
    )
    last = each.orderBy(F.desc("step")).limit(1)
    return last.withColumn("complete", (F.col("model") == 2) & (F.col("optim") == 2) & (F.col("extra") == 2) & (F.col("data") == 1) & (F.col("config") == 1))


EVIDENCE = "array<struct<evidence_id:string,title:string,text:string,supporting:boolean>>"


def paragraph_evidence(rows: DataFrame, prefix: Column, *, shape: str, clip: int = 2000) -> DataFrame:
    """rows with evidence (EVIDENCE), one entry for each paragraph that is not blank, its number in its id and its text clipped.

    shape: "parallel" for context (titles and lists of sentences) and supporting_facts (titles), "structs" for paragraphs (title,
    paragraph_text, is_supporting).
    """
    name = lambda i: F.concat(prefix, i.cast("string"))
    if shape == "parallel":
        pairs = F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))
        known = F.coalesce("supporting_facts.title", F.array().cast("array<string>"))
        each = F.transform(pairs, lambda p, i: F.struct(name(i).alias("evidence_id"), p["title"].alias("title"), F.left(F.trim(F.array_join(p["sentences"], " ")), F.lit(clip)).alias("text"), F.array_contains(known, p["title"]).alias("supporting")))
    else:
        each = F.transform("paragraphs", lambda p, i: F.struct(name(i).alias("evidence_id"), F.coalesce(p["title"], F.lit("")).alias("title"), F.left(F.trim(F.coalesce(p["paragraph_text"], F.lit(""))), F.lit(clip)).alias("text"), F.coalesce(p["is_supporting"], F.lit(False)).alias("supporting")))
    return rows.withColumn("evidence", F.filter(F.coalesce(each.cast(EVIDENCE), F.array().cast(EVIDENCE)), lambda e: e["text"] != ""))


def seed_evidence(evidence: Column, most: int = 8) -> Column:
    """The supporting entries (all, if none is marked), at most `most`."""
    marked = F.filter(evidence, lambda e: e["supporting"])
    return F.slice(F.when(F.size(marked) > 0, marked).otherwise(evidence), 1, most)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Server-sent events: records parted by an empty line, `data: ` lines hold JSON."""
    raw = spark.read.text(path, wholetext=True)
    record = raw.select(F.explode(F.split("value", r"\n\n")).alias("record"))
    data = F.array_join(F.transform(F.filter(F.split("record", "\n"), lambda x: F.startswith(x, F.lit("data: "))), lambda x: F.substr(x, F.lit(7))), "\n")
    return record.select(data.alias("data")).where("data <> ''").select(F.from_json("data", schema).alias("e")).select("e.*")


def event_text(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("data: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("value"))


def training_log(lines: DataFrame) -> DataFrame:
    """(step, kind, loss) from lines `step:<n> - train/loss:<x>`."""
    pattern = r"step:(\d+) - (train|val)/loss:([0-9.eE+\-]+)"
    hit = lines.where(F.col("value").rlike(pattern))
    part = lambda k: F.regexp_extract("value", pattern, k)
    return hit.select(part(1).cast("int").alias("step"), part(2).alias("kind"), part(3).cast("double").alias("loss"))


def pages_in_order(df: DataFrame, order: list[str | Column], *, limit: int, offset: int = 0) -> DataFrame:
    """A page of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)
