"""Web evidence: documents by canonical URL and content, refreshed or added; reads under a budget; run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from .chunk import web_passages
from .retrieval import bm25, build_index, query_terms


def documents(pages: DataFrame, *, url_col: str = "url", text_col: str = "text", fetched_col: str = "fetched_at", ttl: Column) -> DataFrame:
    """(document, source, url, content_hash, text, fetched_at, expires_at): one row for each URL and content, the newest fetch.

    Pages whose URL is refused are left out.
    """
    rows = pages.withColumn("url", T.canonical_url(F.col(url_col))).where("url IS NOT NULL").withColumn("content_hash", I.content_hash(T.normalize_evidence(F.coalesce(text_col, F.lit("")))))
    newest = rows.groupBy("url", "content_hash").agg(F.max(F.struct(F.col(fetched_col).alias("fetched_at"), F.col(text_col).alias("text"))).alias("x"))
    return newest.select(I.stable_id("doc", F.col("url"), F.col("content_hash")).alias("document"), I.stable_id("src", F.col("url")).alias("source"), "url", "content_hash", "x.text", "x.fetched_at", (F.col("x.fetched_at") + ttl).alias("expires_at"))


def store(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """Known documents with the fetched ones: the same content is refreshed, other content added; `created` tells which."""
    both = known.withColumn("__old", F.lit(1)).unionByName(fetched.withColumn("__old", F.lit(0)))
    latest = both.groupBy("document").agg(F.max(F.struct("fetched_at", "source", "url", "content_hash", "text", "expires_at")).alias("x"), F.max("__old").alias("__old"))
    return latest.select("document", "x.source", "x.url", "x.content_hash", "x.text", "x.fetched_at", "x.expires_at", (F.col("__old") == 0).alias("created"))


def read_status(results: DataFrame, *, by: list[str], order: list[Column], budget: int) -> DataFrame:
    """results (cached, failed, seen) -> status: cached, not_read_budget, failed, deduplicated or stored.

    Cached results are free; every other read takes from the budget, failed ones too.
    """
    run = Window.partitionBy(*by).orderBy(*order)
    used = F.coalesce(F.sum((~F.col("cached")).cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    status = F.when(F.col("cached"), "cached").when(used >= budget, "not_read_budget").when(F.col("failed"), "failed").when(F.col("seen"), "deduplicated").otherwise("stored")
    return results.withColumn("status", status)


def run_metrics(statuses: DataFrame, by: list[str]) -> DataFrame:
    names = ("cached", "not_read_budget", "failed", "deduplicated", "stored")
    return statuses.groupBy(*by).agg(*[F.count_if(F.col("status") == n).alias(n) for n in names])


def research(results: DataFrame, pages: DataFrame, known: DataFrame, *, now: Column, ttl: Column, budget: int) -> tuple[DataFrame, DataFrame]:
    """Search results read as evidence under a budget: (statuses, documents).

    results: run, rank, url. pages: url, final_url, title, text (null: the page could not be read), of canonical or other URLs.
    known: documents as `documents` gives them. Results of a run are taken by rank: one whose URL has a fresh document, known before
    or stored by an earlier result of the run, is `cached` and free; every other one takes a read while `budget` lasts (else
    `not_read_budget`), also if it fails (`failed`). What is read is stored under the page's final URL; content that is known there
    already is `deduplicated` and refreshed. Results with a URL that is refused are `failed` and take a read too.

    A run's results are a short list (what a search returns), folded in order inside one row.
    """
    fetched = pages.select(T.canonical_url(F.col("url")).alias("page"), T.canonical_url(F.coalesce("final_url", "url")).alias("final"), "title", "text")
    fetched = fetched.groupBy("page").agg(F.max_by(F.struct("final", "title", "text"), F.coalesce("text", F.lit(""))).alias("p")).select("page", "p.*")
    content = I.content_hash(T.normalize_evidence(F.col("text")))
    fetched = fetched.withColumn("document", F.when(F.col("text").isNotNull() & F.col("final").isNotNull(), I.stable_id("doc", F.col("final"), content)))
    newest = known.where(F.col("expires_at") > now).groupBy("url").agg(F.max_by("document", "fetched_at").alias("fresh"))
    rows = results.select("run", "rank", T.canonical_url(F.col("url")).alias("url"))
    rows = rows.join(newest, "url", "left").join(fetched.withColumnRenamed("page", "url"), "url", "left").join(known.select("document", F.lit(True).alias("known")).distinct(), "document", "left")
    item = F.struct(F.col("rank").cast("int").alias("rank"), "url", "final", "fresh", "document", F.col("document").isNotNull().alias("ok"), F.coalesce("known", F.lit(False)).alias("known"))
    listed = rows.groupBy("run").agg(F.array_sort(F.collect_list(item)).alias("items"))
    status = "struct<rank:int,url:string,document:string,status:string>"
    start = F.struct(F.lit(0).alias("reads"), F.create_map().cast("map<string,string>").alias("stored"), F.array().cast("array<string>").alias("held"), F.array().cast(f"array<{status}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        mine = F.coalesce(F.try_element_at(state["stored"], F.coalesce(x["url"], F.lit(""))), x["fresh"])
        cached, spent = mine.isNotNull(), state["reads"] >= budget
        read = ~cached & ~spent
        taken = read & x["ok"]
        again = x["known"] | F.array_contains(state["held"], F.coalesce(x["document"], F.lit("")))
        said = F.when(cached, "cached").when(spent, "not_read_budget").when(~x["ok"], "failed").when(again, "deduplicated").otherwise("stored")
        row = F.struct(x["rank"].alias("rank"), x["url"].alias("url"), F.when(cached, mine).when(taken, x["document"]).alias("document"), said.alias("status"))
        fresh = F.when(taken, F.map_concat(F.map_filter(state["stored"], lambda k, v: k != x["final"]), F.create_map(x["final"], x["document"]))).otherwise(state["stored"])
        held = F.when(taken, F.array_append(state["held"], x["document"])).otherwise(state["held"])
        return F.struct((state["reads"] + read.cast("int")).alias("reads"), fresh.alias("stored"), held.alias("held"), F.array_append(state["out"], row).alias("out"))

    statuses = listed.select("run", F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("s")).select("run", "s.*")
    read = statuses.where("status IN ('stored', 'deduplicated')").select("document").distinct()
    stored = fetched.where("document IS NOT NULL").join(read, "document", "left_semi").groupBy("document").agg(F.first(F.struct("final", "title", "text")).alias("p"))
    docs = stored.select("document", I.stable_id("src", F.col("p.final")).alias("source"), F.col("p.final").alias("url"), F.col("p.title").alias("title"), F.col("p.text").alias("text"), now.alias("fetched_at"), (now + ttl).alias("expires_at"))
    return statuses, docs


def passages(documents: DataFrame, *, size: int = 1200, overlap: int = 160) -> DataFrame:
    """(passage, document, source, url, title, passage_index, text) of stored documents: passages with where they come from."""
    cut = web_passages(documents, size=size, overlap=overlap, id_col="document").withColumnRenamed("doc", "document")
    named = cut.select(I.stable_id("psg", F.col("document"), F.col("chunk_index").cast("string"), F.col("text")).alias("passage"), "document", F.col("chunk_index").alias("passage_index"), "text")
    return named.join(documents.select("document", "source", "url", "title"), "document")


def search(found: DataFrame, queries: DataFrame, *, top_k: int = 5) -> DataFrame:
    """(query, rank, passage, document, source, url, title, content, score): the best passages by BM25 over title and text."""
    index = build_index(found, id_col="passage", title_col="title")
    hits = bm25(index, query_terms(queries, id_col="query", text_col="text"), top_k=top_k).select("query", "rank", F.col("id").alias("passage"), "score")
    return hits.join(found, "passage").select("query", "rank", "passage", "document", "source", "url", "title", F.col("text").alias("content"), "score")
