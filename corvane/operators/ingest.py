"""Documents on their way into the index: tables and their pages, duplicates, status, Markdown blocks, text to hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T

# Namespaces and states that searches see, the namespace that users may change, and the steps of an ingestion with
# their progress.
VISIBLE, READY, OWN = ("demo", "uploaded"), ("completed", "indexing"), "uploaded"
PROGRESS = (("pending", 0), ("validating", 10), ("parsing", 25), ("chunking", 40), ("storing", 55), ("embedding", 70), ("indexing", 85), ("completed", 100), ("failed", 100))


def matching(documents: DataFrame, **wanted: str | None) -> DataFrame:
    """Documents that agree with every value that is given."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]) if kv[1] else df, wanted.items(), documents)


def page(documents: DataFrame, order: list[Column], *, limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order; every row carries the total of all pages (an empty page has none)."""
    total = documents.agg(F.count(F.lit(1)).alias("total"))
    return documents.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def list_documents(documents: DataFrame, *, namespace: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, then by id."""
    return page(matching(documents, corpus_namespace=namespace, status=status), [F.desc("created_at"), F.asc("document_id")], limit=limit, offset=offset)


def list_chunks(chunks: DataFrame, document: str, *, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(matching(chunks, document_id=document), [F.asc("chunk_index")], limit=limit, offset=offset)


def searchable(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of visible, ready documents as search documents: provenance overrides a chunk's own metadata.

    The order of the index is (corpus_namespace, document_id, chunk_index), which the columns carry.
    """
    seen = documents.where(F.col("corpus_namespace").isin(*VISIBLE) & F.col("status").isin(*READY)).select("document_id", "corpus_namespace", F.col("original_filename").alias("filename"))
    rows = chunks.drop("corpus_namespace").join(seen, "document_id")
    own = ("document_id", "chunk_id", "chunk_index", "corpus_namespace", "filename", "page_number", "section", "content_hash")
    mine = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.col(n).cast("string")) for n in own]))
    other = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*own))
    return rows.select(F.col("chunk_id").alias("id"), "title", F.col("text").alias("content"), F.col("filename").alias("source"), F.map_concat(other, mine).alias("metadata"), "corpus_namespace", "document_id", "chunk_index")


def searchable_count(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return searchable(chunks, documents).agg(F.count(F.lit(1)).alias("chunks"))


def register(documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """uploads (corpus_namespace, content_hash, chunk_size, chunk_overlap, ...) with document_id, created and duplicate.

    A content that the namespace holds already keeps its row (created is false). It is a duplicate, so there is nothing to do, if
    that row is completed with the same chunk parameters.
    """
    mine = uploads.withColumn("document_id", I.document_id(F.col("corpus_namespace"), F.col("content_hash")))
    known = documents.select("corpus_namespace", "content_hash", F.col("document_id").alias("k_id"), F.col("status").alias("k_status"), F.col("chunk_size").alias("k_size"), F.col("chunk_overlap").alias("k_overlap"))
    rows = mine.join(known, ["corpus_namespace", "content_hash"], "left")
    same = (F.col("k_status") == "completed") & (F.col("k_size") == F.col("chunk_size")) & (F.col("k_overlap") == F.col("chunk_overlap"))
    out = rows.withColumn("created", F.col("k_id").isNull()).withColumn("duplicate", F.coalesce(same, F.lit(False))).withColumn("document_id", F.coalesce("k_id", "document_id"))
    return out.drop("k_id", "k_status", "k_size", "k_overlap")


def replace_children(children: DataFrame, fresh: DataFrame, parent: str, *, immutable: DataFrame | None = None) -> DataFrame:
    """Children with those of every parent that `fresh` names replaced. Parents in `immutable` may not change: an error."""
    named = fresh.select(parent).distinct()
    if immutable is not None and named.join(immutable.select(parent), parent, "left_semi").limit(1).count():
        raise ValueError("an immutable corpus may not change")
    return children.join(named, parent, "left_anti").unionByName(fresh)


def deletable(documents: DataFrame, doomed: DataFrame) -> DataFrame:
    """(document_id, error): not found, read-only (not uploaded), or null where a document may be deleted."""
    rows = doomed.select("document_id").distinct().join(documents.select("document_id", "corpus_namespace"), "document_id", "left")
    return rows.select("document_id", F.when(F.col("corpus_namespace").isNull(), "document_not_found").when(F.col("corpus_namespace") != OWN, "read_only_corpus").alias("error"))


def delete_flow(documents: DataFrame, doomed: DataFrame, *, rebuilt: bool) -> DataFrame:
    """Documents after a delete: while it runs the doomed are `deleting` and out of the index; a rebuild that fails brings them
    back as `completed`, one that works removes them. Read-only documents stay as they are."""
    may = deletable(documents, doomed).where("error IS NULL").select("document_id")
    return documents.join(may, "document_id", "left_anti") if rebuilt else documents.withColumn("status", F.when(F.col("status") == "deleting", "completed").otherwise(F.col("status")))


def mark_deleting(documents: DataFrame, doomed: DataFrame) -> DataFrame:
    may = deletable(documents, doomed).where("error IS NULL").select("document_id", F.lit(True).alias("doomed"))
    return documents.join(may, "document_id", "left").withColumn("status", F.when(F.col("doomed"), "deleting").otherwise(F.col("status"))).drop("doomed")


def ingestion_status(log: DataFrame, *, key: str = "document_id") -> DataFrame:
    """log (key, seq, stage, error_code) -> the last stage of each key with its progress; after completed or failed nothing counts."""
    place = F.array_position(F.array(*[F.lit(s) for s, _ in PROGRESS]), F.col("stage"))
    ended = F.coalesce(F.max(F.col("stage").isin("completed", "failed").cast("int")).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = log.withColumn("place", place).withColumn("ended", ended).where("place > 0 AND ended = 0")
    last = known.groupBy(key).agg(F.max(F.struct("seq", "place", "stage", "error_code")).alias("x"))
    progress = F.element_at(F.array(*[F.lit(p) for _, p in PROGRESS]), F.col("x.place").cast("int"))
    return last.select(key, F.col("x.stage").alias("status"), progress.alias("progress"), F.col("x.error_code").alias("error_code"))


def decode(content: Column) -> Column:
    """struct(text, error) of uploaded bytes: UTF-8 without its mark, normalized; invalid bytes and empty texts are errors."""
    raw = F.regexp_replace(F.decode(F.when(F.is_valid_utf8(content.cast("string")), content).otherwise(F.lit(b"").cast("binary")), "UTF-8"), "^\ufeff", "")
    text, valid = T.normalize_upload(raw), F.is_valid_utf8(content.cast("string"))
    return F.struct(F.when(valid & (text != ""), text).alias("text"), F.when(~valid, "invalid_utf8").when(text == "", "no_extractable_text").alias("error"))


def markdown_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """(doc, block, title, section, text): the text under each heading, block from 0. Headings inside code fences are text.

    The first heading of level 1 is the document's title where it has none; blocks before it keep what they had. A row at a time:
    fences and headings are windows over a document's lines.
    """
    text = F.regexp_replace(F.coalesce(text_col, F.lit("")), "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    given = F.coalesce(F.col(title_col), F.lit("")) if title_col else F.lit("")
    lines = docs.select(F.col(id_col).alias("doc"), given.alias("given"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    run = Window.partitionBy("doc").orderBy("no")
    fence = F.col("line").rlike(r"^\s*```").cast("int")
    out = lines.withColumn("fence", fence).withColumn("open", F.pmod(F.sum("fence").over(run) - F.col("fence"), F.lit(2)) == 1)
    pattern = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
    is_head = ~F.col("open") & (F.col("fence") == 0) & F.col("line").rlike(pattern)
    out = out.withColumn("head", F.when(is_head, T.normalize_upload(F.regexp_extract("line", pattern, 2)))).withColumn("level", F.when(is_head, F.length(F.regexp_extract("line", pattern, 1))))
    out = out.withColumn("run", F.count("head").over(run)).withColumn("title", F.first(F.when(F.col("level") == 1, F.col("head")), ignorenulls=True).over(run))
    body = out.groupBy("doc", "run").agg(
        F.first("given").alias("given"), F.max("head").alias("section"), F.max_by("title", F.col("no")).alias("title"),
        F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("no", "line")))).alias("x"),
    )
    named = body.select("doc", "run", F.coalesce("title", "given").alias("title"), "section", T.normalize_upload(F.array_join("x.line", "\n")).alias("text")).where("text <> ''")
    return named.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("run")) - 1).alias("block"), "title", "section", "text")


def text_to_hash(blocks: DataFrame, *, doc: str = "doc", block: str = "block") -> DataFrame:
    """(doc, text): a document's blocks in order, parted by an empty line, each under its page and section; empty ones left out."""
    clean = T.normalize_upload(F.col("text"))
    page_no = F.coalesce(F.col("page_number").cast("string"), F.lit("")) if "page_number" in blocks.columns else F.lit("")
    each = F.concat(F.lit("[page="), page_no, F.lit(";section="), F.coalesce("section", F.lit("")), F.lit("]\n"), clean)
    rows = blocks.where(clean != "").select(F.col(doc).alias("doc"), F.col(block).alias("block"), each.alias("part"))
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "\n\n").alias("text"))


def canonicalize(records: DataFrame, *, dataset: str) -> tuple[DataFrame, DataFrame]:
    """records (id, title, content, ord) -> (chunks by chunk_id, map of original ids to chunk ids).

    Text is the normalized content, or else the title; empty records go. Of equal contents the first by `ord` stays and carries
    the ids of the others in order.
    """
    clean = records.select(F.col("id").cast("string").alias("id"), "ord", T.normalize_corpus(F.coalesce("title", F.lit(""))).alias("title"), T.normalize_corpus(F.coalesce("content", F.lit(""))).alias("body"))
    rows = clean.select("id", "ord", "title", F.when(F.col("body") != "", F.col("body")).otherwise(F.col("title")).alias("text")).where("text <> ''").withColumn("content_hash", I.content_hash(F.col("text")))
    first = rows.groupBy("content_hash").agg(F.min(F.struct("ord", "id", "title", "text")).alias("x"), F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("every"))
    chunk = I.corpus_chunk_id(F.lit(dataset), F.col("x.id"))
    out = first.select(chunk.alias("chunk_id"), F.concat(F.lit(f"{dataset}:"), F.col("x.id")).alias("document_id"), "x.title", "x.text", "content_hash", F.transform(F.slice(F.col("every"), 2, F.greatest(F.size("every") - 1, F.lit(0))), lambda e: e["id"]).alias("duplicate_ids"))
    ids = rows.select("id", "content_hash").join(out.select("content_hash", "chunk_id"), "content_hash").select("id", "chunk_id")
    return out, ids
