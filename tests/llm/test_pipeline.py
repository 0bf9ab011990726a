"""The pipeline on a small corpus, stage by stage against plain versions."""

import random

import corpus_pipeline
import public_tokenizers
from corvane.llm.common import materialize
from corvane.llm.token_store import PieceEncoder

from .conftest import prose
from .test_operators import components, contaminated, plain_digests


def test_stages(spark, tmp_path):
    r = random.Random(12)
    texts = [prose(r, r.randint(30, 120), 3000) for _ in range(260)]
    items = [(i, prose(r, 25, 3000)) for i in range(4)]
    texts += [t + " tail" for t in texts[:20]] + texts[20:30] + [texts[40 + i] + " " + items[i % 4][1] for i in range(8)] + ["short one", None, texts[60].replace(" ", "%%% "), texts[61].replace(" ", "### ")]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "mixing", "token_ids"]
    stage = dict(corpus_pipeline.STAGES)

    kept = materialize(stage["quality_rules"](spark, docs, str(tmp_path)), "q")
    ids = {x["doc_id"] for x in kept.collect()}
    assert ids == set(range(len(texts) - 4)) and kept.columns == docs.columns

    unique = materialize(stage["near_duplicates"](spark, kept, str(tmp_path)), "n")
    want = {i for i, (_, c) in components({i: texts[i] for i in ids}, 80).items() if c == i}
    assert {x["doc_id"] for x in unique.collect()} == want and unique.columns == docs.columns

    clean = materialize(stage["decontamination"](spark, unique, str(tmp_path)), "d")
    hit = contaminated([(i, texts[i]) for i in want], items)
    assert {x["doc_id"] for x in clean.collect()} == {i for i in want if not hit[i][1]} != want

    mixed = materialize(stage["mixing"](spark, clean, str(tmp_path)), "m")
    assert mixed.columns == docs.columns

    out = stage["token_ids"](spark, mixed, str(tmp_path))
    plain = plain_digests([(x["doc_id"], x["text"]) for x in mixed.collect()], PieceEncoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer)
    assert [tuple(x) for x in out.orderBy("start").collect()] == plain
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(plain)


def test_stages_on_odd_rows(spark, tmp_path, odd, odd_rows, none):
    """Nulls, empty and long texts, ties, repeated rows and ids, clashing names, and empty tables go through every stage."""
    spark.createDataFrame([(1, "nothing of this occurs in any document at all here today"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clash = {"doc": "k0", "score": "key", "kept": "row", "component": "mark", "mx_size": "mx_other", "qr_kept": "a.b`c"}
    docs = materialize(odd.withColumnsRenamed(clash), "odd")
    kept = materialize(stage["quality_rules"](spark, docs, str(tmp_path)), "q")
    assert kept.columns == docs.columns and kept.where("text IS NULL OR text = ''").count() == 0
    unique = materialize(stage["near_duplicates"](spark, docs, str(tmp_path)), "n")
    assert unique.columns == docs.columns
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in unique.collect())
    # 5, its copies 6, 7, 12 and the row without an id are one group; 8 and 5 come twice; rows without words all stay
    assert got == [(False, i) for i in (0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 13)] + [(True, 0)]
    clean = materialize(stage["decontamination"](spark, docs, str(tmp_path)), "d")
    assert clean.columns == docs.columns and clean.count() == len(odd_rows)
    mixed = stage["mixing"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.where("k0 = 'd' AND key = 's' AND row = 'k' AND mark = 'c' AND mx_other = 'm'").count() == mixed.count() > 0
    assert stage["token_ids"](spark, docs, str(tmp_path)).count() == len(odd_rows)
    for name, run in stage.items():
        assert run(spark, none, str(tmp_path)).count() == 0, name


def test_contaminated_rows_without_an_id_go(spark, tmp_path):
    r = random.Random(2)
    item, clean = prose(r, 25, 3000), prose(r, 60, 3000)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, f"{clean} {item}"), (None, clean), (4, item), (4, clean)], "doc_id bigint, text string")
    out = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((x["doc_id"] or 0, x["text"]) for x in out) == [(0, clean), (4, clean)]
