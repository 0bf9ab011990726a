"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, impact_search, licenses, minhash, mixing, periodic_runs, quality_knn, quality_rules, quality_sql, token_counts, token_store, toxicity, whitening
from .common import let, materialize, table, words_of


#: The token vocabulary; the file is not part of this repository.
VOCABULARY_FILE = "word_bpe_49k.json"
PIECES_FILE = "piece_bpe_32k.model"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col("he_text").alias("text"), F.length("he_text").cast("long").alias("n_chars"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path=public_tokenizers.path(PIECES_FILE))
    return out.withColumnRenamed("doc", "doc_id")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), hundredths=85)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def passage_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the words of a benchmark window close together, in any order."""
    out = decontaminate.proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=14)
    return out.select(F.col("doc").alias("doc_id"), "n_windows", "n_phrases")


def _scored(scorer, spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    out = scorer(table(spark, sf_dir, "documents"), labels.where(~held_out(F.col("doc_id"))))
    return out.select(F.col("doc").alias("doc_id"), held_out(F.col("doc")).alias("held_out"), "score", "predicted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity.score, spark, sf_dir)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), slim=True)
    return out.select("doc_id", *[F.col(f"qr_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.try_element_at("ls_matches", F.lit(1))
    return out.select(
        "doc_id", F.size("ls_matches").cast("long").alias("n_matches"), best["license"].alias("license"), F.coalesce(best["dice"], F.lit(0.0)).alias("dice"),
        F.coalesce(best["template"], F.lit(-1)).alias("template"), F.coalesce(best["first_word"], F.lit(-1)).alias("first_word"), F.coalesce(best["n_words"], F.lit(0)).alias("n_words"),
    )


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    blocks = token_store.write_blocks(table(spark, sf_dir, "documents"), vocabulary_path=public_tokenizers.path(VOCABULARY_FILE))
    return token_store.read_blocks(blocks)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality_knn.score, spark, sf_dir)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = materialize(docs.select("doc_id", "source", mixing.count_words(F.col("text")).alias("n")), "sizes")
    out = mixing.mix(sizes, size=F.col("n"))
    return out.select("doc_id", F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"), (F.col("mx_copies") * F.col("mx_size")).alias("taken"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which a tenth of the documents, chosen by their id, repeat a few words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def planted(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        at = (g % n).cast("int")
        period = F.lit(1) + F.floor((n - at) / (F.lit(3) + g % 8)).cast("int")
        new = let(F.struct(at.alias("a"), period.alias("p")), lambda s: F.transform(words, lambda x, i: F.when(i < s["a"], x).otherwise(F.get(words, s["a"] + (i - s["a"]) % s["p"]))))
        return F.when(n > 0, F.array_join(new, " ")).otherwise(F.lit(""))

    return docs.select("doc_id", F.when(h % 10 == 0, let(words_of(F.col("text")), planted)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.runs_of(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return out.withColumn("best", best).select(
        F.col("doc").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * -F.col("best.l") / F.col("best.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.search(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, k=20, scale=64)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("doc", "vec_id")


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_token_counts, op3_minhash, op4_decontamination, op5_toxicity, op6_quality_rules, op7_licenses, op8_token_ids, op9_quality, op10_mixing, op11_periodic_runs, op12_topk_search, op13_whitening, passage_proximity)}

_OP4_WORDS = r"[w FOR w IN regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')  IF w <> '']"

_KINDS, _GRAMS = licenses.template_rows(licenses.TEMPLATES, licenses.THRESHOLD)

ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": quality_sql.statement(),
    "op7_licenses": rf"""
WITH t(template, license, n, least, longest) AS (VALUES {_KINDS}), v(template, no, gram) AS (VALUES {_GRAMS}),
d AS (SELECT doc_id, {_OP4_WORDS.format('text')} AS w FROM documents),
g AS (SELECT doc_id, i AS pos, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 1)),
h AS (SELECT doc_id, template, no, pos FROM g JOIN v USING (gram)),
k AS (SELECT doc_id, template FROM h JOIN t USING (template) GROUP BY doc_id, template, least HAVING count(DISTINCT no) >= least),
s AS (SELECT h.* FROM h JOIN k USING (doc_id, template)),
p AS (SELECT a.doc_id, a.template, a.pos AS a, y.no, min(y.pos) AS z, t.n, t.license FROM s a JOIN t ON t.template = a.template
  JOIN s y ON y.doc_id = a.doc_id AND y.template = a.template AND y.pos BETWEEN a.pos AND a.pos + t.longest - 1 GROUP BY ALL),
r AS (SELECT doc_id, template, license, a, z, 2e0 * count(*) OVER (PARTITION BY doc_id, template, a ORDER BY z) / (n + z - a + 1) AS dice FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY dice DESC, a, z - a) AS i FROM r WHERE dice >= {licenses.THRESHOLD}e0),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, a, z - a, template) AS j, count(*) OVER (PARTITION BY doc_id) AS c FROM b WHERE i = 1)
SELECT d.doc_id, CAST(coalesce(c, 0) AS BIGINT) AS n_matches, license, coalesce(dice, 0e0) AS dice, CAST(coalesce(template, -1) AS INTEGER) AS template,
  CAST(coalesce(a, -1) AS INTEGER) AS first_word, CAST(coalesce(z - a + 2, 0) AS INTEGER) AS n_words
FROM d LEFT JOIN m ON m.doc_id = d.doc_id AND j = 1
""",
    "op3_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op4_decontamination": rf"""
WITH d AS (SELECT doc_id, {_OP4_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_OP4_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, least(i + 9, len(w))) AS terms FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(terms) AS k FROM win),
grams AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS terms FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, i, k FROM grams JOIN win USING (terms)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 2e0 * source_size AS cap FROM s),
l AS (SELECT *, row_number() OVER f AS k, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w WINDOW f AS (ORDER BY cap / w, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, k) FROM l WHERE cap >= level * w) * w, cap)) AS target FROM l),
r AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate,
  CAST(CAST('0x' || substr(md5(concat_ws('|', 'offset-0', source)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0 AS u FROM t),
o AS (SELECT d.*, md5(concat_ws('|', '0', CAST(doc_id AS VARCHAR))) AS h, length(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INTEGER) AS c FROM d),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY c, CAST('0x' || substr(h, 1, 4) AS INTEGER) % 4096, size, h, doc_id) AS DOUBLE) AS k FROM o)
SELECT doc_id, size, source_size, target, CAST(least(floor(k * rate + u) - floor((k - 1) * rate + u), ceil(rate)) AS BIGINT) * size AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
""",
    "op11_periodic_runs": r"""
WITH RECURSIVE c8(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM c8 WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM c8 WHERE k = 8),
h AS (SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS h FROM documents, crc),
o AS (SELECT doc_id, h % 10 = 0 AS planted, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM h),
a AS (SELECT *, len(w) AS n, CASE WHEN planted AND len(w) > 0 THEN CAST(g % len(w) AS INTEGER) END AS a FROM o),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
u AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
e AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM u l JOIN u r ON r.doc_id = l.doc_id AND r.x = l.x AND r.i > l.i AND r.i - l.i <= l.n // 4),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
  list({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period)[1] AS best FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM u ANTI JOIN x USING (doc_id, i) GROUP BY u.doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "passage_proximity": rf"""
WITH d AS (SELECT doc_id, {_OP4_WORDS.format('text')} AS w FROM documents), b AS (SELECT {_OP4_WORDS.format('text')} AS w FROM benchmark),
p AS (SELECT row_number() OVER () AS phrase, list_distinct(terms) AS terms FROM (SELECT DISTINCT list_slice(w, i, least(i + 9, len(w))) AS terms FROM (SELECT w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0))),
t AS (SELECT phrase, len(terms) AS k, unnest(terms) AS term FROM p), tok AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
one AS (SELECT DISTINCT doc_id, term FROM tok), held AS (SELECT doc_id, phrase, any_value(k) AS k FROM one JOIN t USING (term) GROUP BY doc_id, phrase HAVING count(*) = any_value(k)),
h AS (SELECT held.doc_id, held.phrase, held.k, tok.term, pos FROM held JOIN t ON t.phrase = held.phrase JOIN tok ON tok.doc_id = held.doc_id AND tok.term = t.term),
n AS (SELECT doc_id, phrase, k, pos, count(DISTINCT term) OVER (PARTITION BY doc_id, phrase ORDER BY pos RANGE BETWEEN CURRENT ROW AND 13 FOLLOWING) AS c FROM h)
SELECT doc_id, count(*) AS n_windows, count(DISTINCT phrase) AS n_phrases FROM n WHERE c = k GROUP BY doc_id
""",
    "op12_topk_search": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
""",
}
