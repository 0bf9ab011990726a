"""Queries of corpus preparation, audit, text and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..operators import chunk, corpus, pages, trajectories
from ..sources.storage import materialize
from .registry import query, table

_TOKENS = f"regexp_extract_all(lower(coalesce(text, '')), '{T.TOKEN_RE2}')"


@query(rf"""SELECT count(*) AS documents, count(DISTINCT doc_id) AS unique_documents, count(*) FILTER (trim(coalesce(lang, '')) = '') AS missing_title, count(*) FILTER (trim(coalesce(source, '')) = '') AS missing_source, count(*) FILTER (NOT regexp_matches(coalesce(source, ''), '(?i)^https?://[^/?#\s]+')) AS invalid_url,
  count(*) FILTER (trim(coalesce(text, '')) = '') AS empty, count(*) FILTER (length(text) < 200) AS too_short, count(*) FILTER (length(text) > 4000) AS too_long,
  count(*) FILTER (regexp_matches(text, '{T.MOJIBAKE_RE2}')) AS mojibake, count(*) FILTER (regexp_matches(text, '{T.HTML_RESIDUE}')) AS html_residue,
  avg(length(text)) AS chars_avg, CAST(min(length(text)) AS INTEGER) AS chars_min, CAST(max(length(text)) AS INTEGER) AS chars_max FROM documents""")
def audit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.profile(table(spark, sf_dir, "documents"), F.col("text"), document=F.col("doc_id"), title=F.col("lang"), source=F.col("source"))


@query(rf"""SELECT count(*) AS documents, count(*) FILTER (NOT regexp_matches(coalesce(url, ''), '(?i)^https?://[^/?#\s]+')) AS invalid_url, count(*) FILTER (regexp_matches(html, '{T.MOJIBAKE_RE2}')) AS mojibake, count(*) FILTER (regexp_matches(html, '{T.HTML_RESIDUE}')) AS html_residue FROM pages""")
def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.profile(table(spark, sf_dir, "pages"), F.col("html"), source=F.col("url")).select("documents", "invalid_url", "mojibake", "html_residue")


@query("SELECT quantile_cont(length(text), 0.5) AS p50, quantile_cont(length(text), 0.95) AS p95 FROM documents")
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_percentiles(table(spark, sf_dir, "documents"), F.col("text"))


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.distributions(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(text))")
def repeated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.repeated(table(spark, sf_dir, "documents"), I.content_hash(F.col("text")))


@query("SELECT min(doc_id) AS canonical, sha256(text) AS digest, count(*) - 1 AS n_duplicates FROM documents GROUP BY sha256(text)")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_dedup(table(spark, sf_dir, "documents"), id_col="doc_id", digest=I.content_hash(F.col("text")))[0]


@query("SELECT doc_id AS original, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical FROM documents")
def dedup_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_dedup(table(spark, sf_dir, "documents"), id_col="doc_id", digest=I.content_hash(F.col("text")))[1]


def _bits(c: str) -> str:
    return " + ".join(f"CASE WHEN coalesce(sum(CASE WHEN {c} IS NULL THEN 0 WHEN {c} & {1 << k} <> 0 THEN 1 ELSE -1 END), 0) >= 0 THEN {1 << k} ELSE 0 END" for k in range(32))


_PRINTS = f"""
w AS (SELECT doc_id AS id, [lower(x) FOR x IN regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')] AS w FROM documents),
f AS (SELECT id, unnest(CASE WHEN len(w) >= 2 THEN [w[i] || chr(0) || w[i + 1] FOR i IN range(1, len(w))] WHEN len(w) = 1 THEN w ELSE [NULL] END) AS f FROM w),
h AS (SELECT id, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) AS h, CAST('0x' || substr(md5(f), 9, 8) AS BIGINT) AS l FROM f),
p AS (SELECT id, {_bits('h')} AS hi, {_bits('l')} AS lo FROM h GROUP BY id)
"""


@query(f"WITH {_PRINTS} SELECT id, CAST(hi AS BIGINT) AS hi, CAST(lo AS BIGINT) AS lo FROM p")
def simhash_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.simhash(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")


@query(f"""WITH {_PRINTS}, n AS (SELECT hi, lo, min(id) AS id FROM p GROUP BY hi, lo)
SELECT a.id AS a, b.id AS b, CAST(bit_count(CAST(xor(CAST(a.hi AS BIGINT), CAST(b.hi AS BIGINT)) AS BIGINT)) + bit_count(CAST(xor(CAST(a.lo AS BIGINT), CAST(b.lo AS BIGINT)) AS BIGINT)) AS INTEGER) AS distance
FROM n a JOIN n b ON a.id < b.id WHERE distance <= 3""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(corpus.simhash(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text"), "prints")
    return corpus.near_pairs(prints)


@query(f"""WITH {_PRINTS}, n AS (SELECT hi, lo, min(id) AS id FROM p GROUP BY hi, lo)
SELECT a.id AS a, b.id AS b, CAST(bit_count(CAST(xor(CAST(a.hi AS BIGINT), CAST(b.hi AS BIGINT)) AS BIGINT)) + bit_count(CAST(xor(CAST(a.lo AS BIGINT), CAST(b.lo AS BIGINT)) AS BIGINT)) AS INTEGER) AS distance
FROM n a JOIN n b ON a.id < b.id WHERE distance <= 3
UNION ALL SELECT n.id, p.id, CAST(0 AS INTEGER) FROM p JOIN n ON p.hi = n.hi AND p.lo = n.lo WHERE p.id > n.id""")
def near_dup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(corpus.simhash(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text"), "prints")
    return corpus.near_links(prints)


@query("SELECT doc_id, source, sample_rank FROM (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY sha256('seed-1:' || doc_id), doc_id) AS INTEGER) AS sample_rank FROM documents) WHERE sample_rank <= 5")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), seed="seed-1", n=5, id_col="doc_id", by="source")


@query("""WITH m AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('seed-2:' || doc_id), doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m))
SELECT doc_id FROM m UNION ALL SELECT doc_id FROM r WHERE k <= greatest(0, 300 - (SELECT count(*) FROM m))""")
def required_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.required_sample(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("toxic = 1"), seed="seed-2", n=300, id_col="doc_id")


_QREL = "qr AS (SELECT CAST(doc_id % 97 AS VARCHAR) AS query_id, doc_id AS document_id, quality + toxic AS relevance FROM labels)"


def _qrels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    qrels = table(spark, sf_dir, "labels").select((F.col("doc_id") % 97).cast("string").alias("query_id"), F.col("doc_id").alias("document_id"), (F.col("quality") + F.col("toxic")).alias("relevance"))
    return qrels, table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))


@query(f"WITH {_QREL} SELECT query_id, document_id, relevance FROM qr WHERE relevance > 0 AND query_id IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark) AND document_id IN (SELECT doc_id FROM documents)")
def qrels_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.filter_qrels(*_qrels(spark, sf_dir))


@query(f"""WITH {_QREL}, q AS (SELECT CAST(item_id AS VARCHAR) AS query_id FROM benchmark)
SELECT 'unknown_query' AS check, count(DISTINCT query_id) AS violations FROM qr WHERE query_id NOT IN (SELECT query_id FROM q)
UNION ALL SELECT 'unknown_document', count(DISTINCT document_id) FROM qr WHERE document_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'unjudged_query', count(DISTINCT query_id) FROM q WHERE query_id NOT IN (SELECT query_id FROM qr)
UNION ALL SELECT 'repeated_query', count(*) FROM (SELECT query_id FROM q GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'repeated_document', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.integrity(*_qrels(spark, sf_dir))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(' ' || t || ' ', ' ' || p || ' ') WHERE p <> ''""")
def passage_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(r"""SELECT doc_id, 'document-' || left(sha256(source || ':' || sha256(text)), 24) AS document, 'chunk-' || left(sha256(doc_id || ':0:' || text), 24) AS chunk,
  trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g')) || '-chunk-' || left(sha256(source || chr(0) || doc_id), 20) AS corpus_chunk FROM documents""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id", I.document_id(F.col("source"), I.content_hash(F.col("text"))).alias("document"), I.chunk_id(doc, F.lit(0), F.col("text")).alias("chunk"), I.corpus_chunk_id(F.col("source"), doc).alias("corpus_chunk")
    )


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed, md5(trim(lower(text))) AS lowered FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_corpus(F.col("text"))).alias("squeezed"), F.md5(T.normalize_query(F.col("text"))).alias("lowered"))


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({_TOKENS})) AS INTEGER) AS n_types, md5(array_to_string({_TOKENS}, ' ')) AS digest FROM documents")
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_types"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(r"""WITH s AS (SELECT doc_id, [trim(x) FOR x IN string_split(regexp_replace(coalesce(text, ''), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) IF trim(x) <> ''] AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences FROM s""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


_URL = r"""
b AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme, regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1) AS auth, regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query FROM a),
c AS (SELECT *, lower(regexp_extract(auth, '^([^:]*)', 1)) AS host, try_cast(nullif(regexp_extract(auth, ':(.*)$', 1), '') AS INTEGER) AS port,
  [{'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))} FOR p IN string_split(query, '&') IF p <> ''] AS items FROM b),
d AS (SELECT *, [replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+') FOR x IN list_sort([y FOR y IN items IF NOT (lower(y.k) IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref')) AND NOT starts_with(lower(y.k), 'utm_')])] AS kept FROM c)
SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' AND NOT contains(auth, '@') THEN scheme || '://' || host || CASE WHEN port IS NULL OR (scheme = 'http' AND port = 80) OR (scheme = 'https' AND port = 443) THEN '' ELSE ':' || port END
  || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '/{2,}', '/', 'g') END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url FROM d"""
_FORM = r"regexp_replace(regexp_replace(url, '#.*$', ''), 'example\.([a-z]+)/', 'EXAMPLE.\1:0080//') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'q=%41b+c&c&&UTM_x=1&z=a%2Fb~*=%zz#a?b'"


@query(f"WITH a AS (SELECT page_id, trim(url) AS u FROM pages), {_URL}")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query(f"WITH a AS (SELECT page_id, {_FORM} AS u FROM pages), {_URL}")
def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' URLs with hosts in capitals, a port and parameters that must be decoded."""
    plain = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), r"example\.([a-z]+)/", "EXAMPLE.$1:0080//")
    more = F.concat(plain, F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("q=%41b+c&c&&UTM_x=1&z=a%2Fb~*=%zz#a?b"))
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(more).alias("url"))


_SPOILT = "'My API_KEY = ' || doc_id || ' in /home/u' || doc_id || '/x and /data/team/y; scp me@host:z. ' || chr(10) || 'Disk quotas for user joe (uid 12): none. ' || coalesce(text, '')"


# The text without what must not be shown, as SQL.
REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)\b([a-z0-9_]*(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|secret)[a-z0-9_]*)\b(\s*[:=]\s*)(\S+)', '\1\2<redacted>', 'g'),
  '/home/[^/\s=:]+', '$HOME', 'g'), '/data/[^/\s=:]+/', '/data/$USER/', 'g'), '(?im)^Disk quotas for user \S+(?:\s+\(uid\s+\d+\))?:?', 'Disk quotas for current user', 'g'), '(?i)\b(?:ssh|scp)\s+[^@\s]+@[^:\s]+', 'ssh <redacted-target>', 'g')"""


@query(f"SELECT doc_id, md5({REDACTED.format(_SPOILT)}) AS clean FROM documents")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    text = F.concat(F.lit("My API_KEY = "), d, F.lit(" in /home/u"), d, F.lit("/x and /data/team/y; scp me@host:z. \nDisk quotas for user joe (uid 12): none. "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.redact(text)).alias("clean"))


_COUNTED = lambda c: f"(SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM (SELECT coalesce({c}, '') AS v, count(*) AS n FROM documents GROUP BY {c}))"


@query(rf"""WITH {_PRINTS} SELECT count(*) AS chunks, count(DISTINCT doc_id % 97) AS documents, count(DISTINCT doc_id) AS unique_chunk_ids, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty, CAST(count(*) - count(DISTINCT md5(coalesce(text, ''))) AS BIGINT) AS duplicate_text_after_dedup,
  (SELECT count(*) FROM p a JOIN p b ON a.id < b.id AND bit_count(CAST(xor(CAST(a.hi AS BIGINT), CAST(b.hi AS BIGINT)) AS BIGINT)) + bit_count(CAST(xor(CAST(a.lo AS BIGINT), CAST(b.lo AS BIGINT)) AS BIGINT)) <= 3) AS near_duplicate_pairs,
  round(avg(length(text)), 2) AS chars_avg, quantile_cont(length(text), 0.5) AS p50, quantile_cont(length(text), 0.95) AS p95, CAST(min(length(text)) AS INTEGER) AS chars_min, CAST(max(length(text)) AS INTEGER) AS chars_max, count(*) FILTER (length(text) < 200) AS too_short, count(*) FILTER (length(text) > 4000) AS too_long,
  {_COUNTED("lang")} AS language_distribution, {_COUNTED("source")} AS source_distribution, count(*) FILTER (trim(coalesce(lang, '')) = '') AS missing_title, count(*) FILTER (trim(coalesce(source, '')) = '') AS missing_source,
  count(*) FILTER (NOT regexp_matches(coalesce(source, ''), '(?i)^https?://[^/?#\s]+')) AS invalid_url, count(*) FILTER (regexp_matches(text, '{T.MOJIBAKE_RE2}')) AS mojibake, count(*) FILTER (regexp_matches(text, '{T.HTML_RESIDUE}')) AS html_residue FROM documents""")
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of 97 documents, their language as title."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select((F.col("doc_id") % 97).alias("document_id"), F.col("doc_id").alias("chunk_id"), F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"), F.col("lang").alias("title"), "source", "text", "lang")
    out = corpus.audit(chunks, source_records=0, removed=0, fields={"language": "lang", "source": "source"})
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumns({c: flat(c) for c in ("language_distribution", "source_distribution")}).drop("source_records", "exact_duplicates_removed", "too_short_threshold", "too_long_threshold")


# White space as Python sees it, and the chunks by a recursion over their starts: the text behind the middle is turned round, so that
# its last boundary comes first.
_WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NOT_WS = _WS.replace("[", "[^", 1)
_TRIM = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_LAST = lambda c: f"CASE WHEN length(regexp_extract(r, '^[^{c}]*')) < 400 THEN s + 800 - length(regexp_extract(r, '^[^{c}]*')) + length(regexp_extract(regexp_extract(r, '^[^{c}]*'), '{_WS}*$')) END"
_CHUNKS = rf"""RECURSIVE lines AS (SELECT doc_id, [{_TRIM("regexp_replace(x, '[ \t]+', ' ', 'g')")} FOR x IN regexp_split_to_array(regexp_replace(coalesce(text, ''), '\r\n', chr(10), 'g'), '[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')] AS x FROM documents),
nt AS (SELECT doc_id, {_TRIM("regexp_replace(array_to_string(x, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")} AS t FROM lines),
w(doc_id, t, n, k, nxt, piece, keep, prev, fin) AS (
  SELECT doc_id, t, length(t), 0, 0, '', FALSE, '', t = '' FROM nt
  UNION ALL
  SELECT doc_id, t, n, k + 1, CASE WHEN n - f <= 120 OR f > s THEN f ELSE back END, piece, keep, CASE WHEN keep THEN piece ELSE prev END, e >= n FROM (
    SELECT *, CASE WHEN back < n AND regexp_full_match(substr(t, back, 2), '[A-Za-z0-9][A-Za-z0-9]') AND length(regexp_extract(head, '{_NOT_WS}*$')) < length(head) THEN back - length(regexp_extract(head, '{_NOT_WS}*$')) ELSE least(back, e) END AS f FROM (
      SELECT *, piece <> '' AND piece <> prev AND NOT (e >= n AND e - s <= 120 AND n > 800 AND contains(prev, piece)) AS keep, substr(t, greatest(back - 40, 0) + 1, least(back, 40)) AS head FROM (
        SELECT *, {_TRIM("substr(t, s + 1, e - s)")} AS piece, greatest(s + 1, e - 120) AS back FROM (
          SELECT *, CASE WHEN s + 800 >= n THEN n ELSE coalesce(CASE WHEN strpos(r, chr(10) || chr(10)) > 0 THEN s + 801 - strpos(r, chr(10) || chr(10)) END, CASE WHEN strpos(r, chr(10)) > 0 THEN s + 801 - strpos(r, chr(10)) END,
            {_LAST("。！？.!?")}, {_LAST("；;")}, CASE WHEN length(regexp_extract(r, '^{_NOT_WS}*')) < 400 THEN s + 800 - length(regexp_extract(r, '^{_NOT_WS}*')) END, s + 800) END AS e FROM (
            SELECT doc_id, t, n, k, nxt AS s, prev, reverse(substr(t, nxt + 401, 400)) AS r FROM w WHERE NOT fin))))))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, piece FROM w WHERE keep"""


@query(f"WITH c AS (WITH {_CHUNKS}) SELECT doc_id, chunk_index, 'chunk-' || substr(sha256(doc_id || ':' || chunk_index || ':' || piece), 1, 24) AS chunk_id FROM c")
def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk.chunks(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "chunk_index", I.chunk_id(F.col("doc").cast("string"), F.col("chunk_index"), F.col("text")).alias("chunk_id"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.texts(table(spark, sf_dir, "pages")).withColumnRenamed("page", "page_id")


@query("""WITH c AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS "user", count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'system') AS system FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS same FROM conversations WHERE role <> 'system')
SELECT c.*, c."user" = 1 AND assistant = 1 AS single_pair, NOT coalesce(s, FALSE) AS alternates FROM c LEFT JOIN (SELECT conv_id, bool_or(coalesce(same, FALSE)) AS s FROM l GROUP BY conv_id) USING (conv_id)""")
def conv_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.conversation_shape(table(spark, sf_dir, "conversations"))


@query("SELECT a.conv_id, a.turn, md5(a.text) AS prompt, md5(b.text) AS response FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.pairs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.md5("prompt").alias("prompt"), F.md5("response").alias("response"))


@query("SELECT conv_id, CASE WHEN CAST(CAST('0x' || substr(sha256('split-1:' || conv_id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0 < 0.1e0 THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT conv_id FROM conversations)")
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.split(table(spark, sf_dir, "conversations").select("conv_id").distinct(), id_col="conv_id", seed="split-1")


@query(r"""WITH f AS (SELECT DISTINCT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k FROM conversations WHERE role = 'user' AND conv_id % 10 >= 8)
SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id % 10 <= 8 AND trim(regexp_replace(lower(text), '\s+', ' ', 'g')) IN (SELECT k FROM f)""")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and forbidden questions that share every tenth conversation, in another spelling."""
    users = table(spark, sf_dir, "conversations").where("role = 'user'").withColumnRenamed("text", "prompt")
    forbidden = users.where("conv_id % 10 >= 8").withColumn("prompt", F.concat(F.lit(" "), F.replace("prompt", F.lit(" "), F.lit("  "))))
    return trajectories.leaks(users.where("conv_id % 10 <= 8"), forbidden).select("conv_id", "turn")
