"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

`build_index` stores the postings (term, document, position) of every training token whose term occurs in a test item, sorted
by term inside each file, together with each document's length. `phrase_hits` intersects, for each test phrase, the
offset-adjusted postings of its two rarest terms, which gives candidate starts, and confirms each candidate on the document's
words. `proximity_hits` finds windows of a document in which all terms of a phrase occur in any order.

Test phrases and their terms are broadcast only below `BROADCAST_ROWS`, counted before; beyond it they are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: What separates words: every ASCII character but letters and digits (upper case is folded before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
BROADCAST_ROWS = 200_000
#: The posting that carries a document's length; no word is empty.
LENGTH_TERM = ""


def word_list(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few enough rows; rows are a few short words wide."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def windows_of(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(phrases, owners): distinct windows as (phrase_id, terms), and (phrase_id, item). A shorter item is one window.

    Null or empty items have no window; repeated items share their windows.
    """
    words = items.select(F.col(id_col).alias("item"), word_list(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - width + 1)), lambda i: F.slice(F.col("w"), i, width))
    each = words.select("item", F.explode(spans).alias("terms"))
    owners = each.select(F.xxhash64(F.concat_ws(" ", "terms")).alias("phrase_id"), "terms", "item").distinct()
    return owners.dropDuplicates(["phrase_id"]).select("phrase_id", "terms"), owners.select("phrase_id", "item")


def keyed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text): doc is a struct of the id and a hash of the text, never null."""
    return docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark")).alias("doc"), F.col(f"`{text_col}`").alias("text"))


def build_index(docs: DataFrame, terms: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index (term, doc, pos) over every document: postings of `terms` (column term), and (LENGTH_TERM, doc, length).

    pos counts from 0 over all words of the document. Nothing is shuffled: each input split writes its own sorted postings.
    """
    words = docs.select(F.col(id_col).alias("doc"), word_list(F.col(text_col)).alias("w"))
    tokens = words.select("doc", F.posexplode(F.concat(F.array(F.lit(LENGTH_TERM)), F.col("w"))).alias("p", "term"), F.size("w").alias("n"))
    vocabulary = _bounded(terms.select("term").union(terms.sparkSession.range(1).select(F.lit(LENGTH_TERM))).distinct())
    kept = tokens.join(vocabulary, "term", "left_semi").select("term", "doc", F.when(F.col("term") == LENGTH_TERM, F.col("n")).otherwise(F.col("p") - 1).alias("pos"))
    return materialize(kept.sortWithinPartitions("term", "doc", "pos"), "postings")


def _anchors(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """(term, phrase_id, offset, rank, needed): the two rarest distinct terms of each phrase, by postings in the corpus."""
    frequency = index.where(F.col("term") != LENGTH_TERM).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    places = phrases.select("phrase_id", F.posexplode("terms").alias("offset", "term")).groupBy("phrase_id", "term").agg(F.min("offset").alias("offset"))
    ranked = places.join(frequency, "term", "left").fillna(0, ["df"]).withColumn("rank", F.row_number().over(Window.partitionBy("phrase_id").orderBy("df", "term")))
    return ranked.where("rank <= 2").withColumn("needed", F.max("rank").over(Window.partitionBy("phrase_id"))).select("term", "phrase_id", "offset", "rank", "needed")


def phrase_hits(docs: DataFrame, index: DataFrame, phrases: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, phrase_id, start, len): every exact occurrence of every phrase; start counts words from 0."""
    anchors = _bounded(materialize(_anchors(phrases, index), "anchors"))
    starts = index.where(F.col("term") != LENGTH_TERM).join(anchors, "term").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    found = F.bit_or(F.col("rank"))  # ranks 1 and 2, or the only one
    candidates = starts.groupBy("doc", "phrase_id", "start").agg(found.alias("found"), F.max("needed").alias("needed")).where("found = 2 * needed - 1")
    candidates = candidates.join(_bounded(phrases), "phrase_id").groupBy("doc").agg(F.collect_set(F.struct("phrase_id", "start", "terms")).alias("c"))
    words = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("__text"))
    joined = words.join(candidates, "doc").select("doc", "c", word_list(F.col("__text")).alias("w"))
    found = joined.select("doc", F.explode(F.filter("c", lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["terms"])) == c["terms"])).alias("c"))
    return found.select("doc", "c.phrase_id", "c.start", F.size("c.terms").alias("len")).distinct()


def proximity_hits(index: DataFrame, phrases: DataFrame, *, span: int) -> DataFrame:
    """(doc, phrase_id, start): starts of windows of `span` words that hold all distinct terms of the phrase, in any order.

    A window starts at one of the phrase's terms. From the postings of the phrase's rarest term only: the other terms' postings
    are read for documents that hold it.
    """
    anchors = _bounded(materialize(_anchors(phrases, index).where("rank = 1"), "rarest"))
    near = index.join(anchors, "term").select("doc", "phrase_id", F.col("pos").alias("at"))
    terms = phrases.select("phrase_id", F.explode(F.array_distinct("terms")).alias("term"), F.size(F.array_distinct("terms")).alias("k"))
    every = near.join(_bounded(terms), "phrase_id").withColumnRenamed("doc", "__d").withColumnRenamed("term", "__t")
    hits = every.join(index, (F.col("__d") == F.col("doc")) & (F.col("__t") == F.col("term")) & (F.abs(F.col("pos") - F.col("at")) < span)).select("doc", "phrase_id", "at", "term", "pos", "k").distinct()
    window = Window.partitionBy("doc", "phrase_id", "at").orderBy("pos").rangeBetween(0, span - 1)
    return hits.withColumn("__n", F.size(F.collect_set("term").over(window))).where("__n = k").select("doc", "phrase_id", F.col("pos").alias("start")).distinct()


def proximity(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, span: int = 2 * WIDTH) -> DataFrame:
    """(doc, mark, n_windows, n_phrases) of documents that hold all words of an item's window within `span` words, in any order.

    n_phrases counts the windows of items that are held so, n_windows the places where one is. Rows, nulls and empty tables as in
    `contamination`; documents without any are left out.
    """
    docs = keyed(docs, id_col=id_col, text_col=text_col)
    phrases, _ = windows_of(items, id_col=item_id_col, text_col=item_text_col, width=width)
    phrases = materialize(phrases, "phrases")
    index = build_index(docs.distinct(), phrases.select(F.explode("terms").alias("term")).distinct(), id_col="doc", text_col="text")
    found = proximity_hits(index, phrases, span=span)
    out = found.groupBy("doc").agg(F.count(F.lit(1)).alias("n_windows"), F.count_distinct("phrase_id").alias("n_phrases"))
    return out.select(F.col("doc.id").alias("doc"), F.col("doc.mark").alias("mark"), "n_windows", "n_phrases")


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: doc, n_words, n_hit, n_items (long), items (sorted strings), hits (array of start, len), mark (hash of the text).

    One row for each row of docs, whatever its id: inside, a document is its id and a hash of its text, so null ids, and ids that
    come with several texts, are documents of their own, and rows that repeat an id and its text have the same result. Null and
    empty texts: no words, not hit. Very long texts are read whole. Empty tables: no rows, or no hits. Items without
    an id count as one more item in n_items, and have no string in items. Only the id and text columns are read, whatever the names of
    others.
    """
    docs = keyed(docs, id_col=id_col, text_col=text_col)
    id_col, text_col = "doc", "text"
    phrases, owners = windows_of(items, id_col=item_id_col, text_col=item_text_col, width=width)
    phrases, owners = materialize(phrases, "phrases"), materialize(owners, "owners")
    index = build_index(docs, phrases.select(F.explode("terms").alias("term")).distinct(), id_col=id_col, text_col=text_col)
    hits = materialize(phrase_hits(docs, index, phrases, id_col=id_col, text_col=text_col), "phrase_hits")
    by_start = Window.partitionBy("doc").orderBy("start")
    reached = F.coalesce(F.max(F.col("end")).over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hits.groupBy("doc", "start").agg(F.max("len").alias("len")).withColumn("end", F.col("start") + F.col("len"))
    hit = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached))).groupBy("doc").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "len"))).alias("hits"))
    named = hits.select("doc", "phrase_id").distinct().join(_bounded(owners), "phrase_id").groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"), F.size(F.collect_set(F.struct("item"))).alias("n_items"))
    lengths = index.where(F.col("term") == LENGTH_TERM).select("doc", F.col("pos").alias("n_words"))
    out = lengths.join(hit.join(named, "doc"), "doc", "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("doc.id").alias("doc"), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), F.coalesce("hits", F.array().cast("array<struct<start:int,len:int>>")).alias("hits"), F.col("doc.mark").alias("mark"),
    )
