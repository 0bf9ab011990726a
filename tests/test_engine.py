"""Operators of the engine on small hand-checked inputs."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import ids as I
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import chunk, corpus, evaluate, failures, ingest, retrieval, sequence, trajectories
from corvane.operators.pages import page_text
from corvane.plans import analysis_queries
from corvane.sources import readers, storage, vectors, versions


def one(spark, expr, **values):
    names = list(values) or ["x"]
    return spark.createDataFrame([tuple(values.values()) or (1,)], names).select(expr.alias("v")).first()["v"]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_tokens_fold_width_and_pair_cjk(spark):
    assert one(spark, T.tokens(F.col("t")), t="ＢＭ２５ 关键检索 rrf. sprächen 字") == ["bm25", "zh:关键", "zh:键检", "zh:检索", "rrf.", "spr", "chen", "zh:字"]
    assert one(spark, T.tokens(F.col("t")), t="") == []


def test_normalizers(spark):
    assert one(spark, T.normalize_answer(F.col("t")), t="The  Straße, an Apple!") == "strasse apple"
    assert one(spark, T.answer_key(F.col("t")), t="b a B") == "a b"
    assert one(spark, T.normalize_corpus(F.col("t")), t=" A \n b　c ") == "A b c"
    assert one(spark, T.normalize_upload(F.col("t")), t=" a \t b \r\n\r\n\n\n c") == "a b\n\nc"


def test_url(spark):
    urls = {"HTTP://Ex.com:80//a//b?utm_x=1&b=2&a=1#f": "http://ex.com/a/b?a=1&b=2", "https://u:p@ex.com/": None, "ftp://ex.com": None, "https://ex.com": "https://ex.com/"}
    for url, want in urls.items():
        assert one(spark, T.canonical_url(F.col("u")), u=url) == want


def test_citations_and_sentences(spark):
    assert one(spark, T.citation_ids(F.col("t")), t="[Doc-1] x [chunk-a] [doc-1]") == ["doc-1", "chunk-a"]
    assert one(spark, T.sentences(F.col("t")), t="One. Two!  Three？ four") == ["One.", "Two!", "Three？", "four"]
    assert one(spark, T.evidence_ids(F.col("t")), t="x [E:a] y [E:b] [E:a]") == ["a", "b"]


def test_redaction(spark):
    assert one(spark, T.redact(F.col("t")), t="password = x1 in /home/me/a or /data/u/b; ssh me@h:2\nDisk quotas for user joe (uid 5): x") == "password = <redacted> in $HOME/a or /data/$USER/b; ssh <redacted-target>:2\nDisk quotas for current user x"
    assert one(spark, T.has_secret(F.col("t")), t="API-KEY: q")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").select(V.normalize(F.col("v")).alias("n")).collect()
    assert [r["n"] for r in df][0] == pytest.approx([0.6, 0.8])
    assert df[1]["n"] is None and df[2]["n"] is None


def test_fusion_order(spark):
    r = spark.createDataFrame([(1, "bm25", "doc-001", 1), (1, "bm25", "doc-002", 2), (1, "dense", "doc-002", 1), (1, "dense", "doc-003", 2)], "query int, source string, id string, rank int")
    out = retrieval.fuse(r).orderBy("rank").collect()
    assert [x["id"] for x in out] == ["doc-002", "doc-001", "doc-003"]
    assert out[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    with pytest.raises(ValueError):
        retrieval.fuse(r, constant=0)


def test_bm25_title_weight_and_ties(spark):
    docs = spark.createDataFrame([(1, "alpha", "beta"), (2, "", "alpha alpha beta"), (3, "", "gamma"), (4, "", "gamma")], "doc_id int, title string, text string")
    index = retrieval.build_index(docs, title_col="title")
    asked = retrieval.query_terms(spark.createDataFrame([(9, "gamma gamma")], "q int, t string"), id_col="q", text_col="t")
    assert [(x["id"], x["rank"], x["total_hits"]) for x in retrieval.bm25(index, asked).orderBy("rank").collect()] == [(3, 1, 2), (4, 2, 2)]
    assert rows(index.postings.where("term = 'alpha'"), "id", "tf") == [(1, 2.0), (2, 2.0)]


def test_packing_cuts_the_last_block(spark):
    blocks = spark.createDataFrame([(1, 1, "h1", "aaaa"), (1, 2, "h2", "bbbbbbbb"), (1, 3, "h3", "c")], "query int, rank int, header string, content string")
    out = retrieval.pack(blocks, max_chars=15).orderBy("rank").collect()
    assert [(r["rank"], r["packed"], r["truncated"]) for r in out] == [(1, "h1\naaaa", False), (2, "h2\nbbb", True)]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, "d1", 1), (1, "d4", 2), (1, "d2", 3)], "query int, id string, rank int")
    qrels = spark.createDataFrame([(1, "d1", 3), (1, "d2", 1), (1, "d3", 2), (2, "x", 1)], "query int, id string, grade int")
    out = {r["query"]: r for r in evaluate.metric_bundle(hits, qrels).collect()}
    assert out[1]["recall_1"] == pytest.approx(1 / 3) and out[1]["recall_3"] == pytest.approx(2 / 3) and out[1]["precision_5"] == pytest.approx(2 / 5)
    assert out[1]["reciprocal_rank"] == 1 and out[2]["ndcg_10"] == 0


def test_token_f1(spark):
    pairs = spark.createDataFrame([(1, "a b b", "b b c"), (2, "", ""), (3, "a", "")], "k int, l string, r string")
    assert rows(evaluate.token_f1(pairs, F.col("l"), F.col("r"), ["k"]), "k", "f1") == [(1, pytest.approx(2 / 3)), (2, 1.0), (3, 0.0)]


def test_support_labels(spark):
    df = spark.createDataFrame([(0.9, ["a"], ["a"], []), (0.9, ["z"], ["a"], ["z"]), (0.9, [], ["a"], []), (0.9, ["a"], ["a", "b"], []), (0.5, ["a"], ["a"], [])], "f double, c array<string>, s array<string>, x array<string>")
    assert [r[0] for r in df.select(evaluate.support_label(F.col("f"), F.col("c"), F.col("s"), F.col("x"))).collect()] == ["supported", "contradicted", "unsupported", "partial", "unsupported"]


def test_claims_match_gold(spark):
    answers = spark.createDataFrame([("c", "Cats purr loudly [E:e1]. Dogs bark.")], "case_id string, report string")
    gold = spark.createDataFrame([("c", 1, "Dogs bark"), ("c", 2, "cats purr loudly")], "case_id string, gold_no int, gold_text string")
    found = evaluate.claims(answers, keys=["case_id"])
    assert rows(evaluate.best_match(found, gold), "claim_no", "gold_no", "f1") == [(1, 2, 1.0), (2, 1, 1.0)]


def test_simhash_pairs_against_brute_force(spark):
    r = random.Random(5)
    base = [" ".join(f"w{r.randint(0, 400)}" for _ in range(120)) for _ in range(6)]
    docs = [(i, t) for i, t in enumerate(base)] + [(10 + i, t + " end") for i, t in enumerate(base)] + [(90, "one"), (91, "")]
    prints = corpus.simhash(spark.createDataFrame(docs, "doc_id int, text string"), id_col="doc_id", text_col="text")
    p = {x["id"]: (x["hi"] << 32) | x["lo"] for x in prints.collect()}
    md5 = lambda f: int(hashlib.md5(f.encode()).hexdigest()[:16], 16)
    assert p[91] == (1 << 64) - 1 and p[90] == md5("one")
    b = {x["id"]: (x["hi"] << 32) | x["lo"] for x in corpus.simhash_blake(spark.createDataFrame(docs, "doc_id int, text string"), id_col="doc_id", text_col="text").collect()}
    big = lambda f: int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
    for i, t in docs:
        w = t.lower().split()
        features = [f"{x}\0{y}" for x, y in zip(w, w[1:], strict=False)] if len(w) > 1 else w
        for prints_of, h in ((p, md5), (b, big)):
            assert prints_of[i] == sum(1 << k for k in range(64) if sum(1 if h(f) >> k & 1 else -1 for f in features) >= 0)
    want, first = [], {}
    for i, v in sorted(p.items()):
        first.setdefault(v, i)
    nodes = sorted(first.values())
    for a in nodes:
        want += [(a, b, (p[a] ^ p[b]).bit_count()) for b in nodes if a < b and (p[a] ^ p[b]).bit_count() <= 3]
    assert rows(corpus.near_pairs(prints), "a", "b", "distance") == sorted(want)


def test_simhash_links_reach_every_pair(spark):
    r = random.Random(6)
    base = [" ".join(f"w{r.randint(0, 400)}" for _ in range(120)) for _ in range(4)]
    docs = [(i, t) for i, t in enumerate(base)] + [(10 + i, t.upper()) for i, t in enumerate(base)] + [(20 + i, t + "!") for i, t in enumerate(base)] + [(30, base[0] + " end")]
    prints = corpus.simhash(spark.createDataFrame(docs, "doc_id int, text string"), id_col="doc_id", text_col="text")
    p = {x["id"]: (x["hi"] << 32) | x["lo"] for x in prints.collect()}
    links = corpus.near_links(prints).collect()
    first = {i: min(j for j in p if p[j] == p[i]) for i in p}
    assert {(x["a"], x["b"]) for x in links if x["distance"] == 0} == {(first[i], i) for i in p if first[i] != i} and len(set(first.values())) < len(p)
    apart = {(x["a"], x["b"]): x["distance"] for x in links}
    got = {(a, b) for a in p for b in p if a < b and (first[a] == first[b] or (min(first[a], first[b]), max(first[a], first[b])) in apart)}
    assert got == {(a, b) for a in p for b in p if a < b and (p[a] ^ p[b]).bit_count() <= 3}


def test_dedup_keeps_the_first(spark):
    docs = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "doc_id int, text string")
    first, mapping = corpus.exact_dedup(docs, id_col="doc_id", digest=I.content_hash(F.col("text")))
    assert rows(first, "canonical", "n_duplicates") == [(1, 1), (2, 0)]
    assert rows(mapping, "original", "canonical") == [(1, 1), (2, 2), (3, 1)]


def test_chunks_cover_and_end():
    text = " ".join("x" * 30 for _ in range(60))
    for size, overlap in ((200, 185), (240, 40), (4000, 0)):
        got = chunk.pieces(text, size, overlap)
        assert all(len(x) <= size for x in got[:-1]) and "x" * 30 in got[-1] and text.startswith(got[0]) and text.endswith(got[-1])
    tokens = " ".join(f"token{i}" for i in range(180))
    got = chunk.pieces(tokens, 240, 40)
    assert len(got) > 2 and max(map(len, got)) <= 240 and all(f"token{i}" in " ".join(got).split() for i in range(180))
    assert chunk.normalized(" a \t b \r\n\r\n\n\n c\x0bd ") == "a b\n\nc\nd"
    for bad in ((199, 10), (4001, 10), (300, 300), (300, 301), (300, -1), (4000, 1001)):
        assert chunk.check(*bad)
    assert chunk.pieces("", 300, 10) == []
    page = "one line\n" * 300
    found = chunk.passages(page, 1200, 160)
    assert found[0][0] == 0 and found[-1][1] == len(page) and all(page[a:b].strip() == t for a, b, t in found) and all(page[b] == "\n" for _, b, _ in found[:-1])
    with pytest.raises(ValueError):
        chunk.passages("x", 10, 10)


def test_page_text_ignores_scripts():
    assert page_text("<title>T &amp; U</title><script>var a='<p>';</script><p>one<br>two</p>  <svg>z</svg>three") == ("T & U", "T & U\none\ntwo\nthree")
    assert page_text(None) == ("", "")


def test_markdown_sections_ignore_fences(spark):
    lines = ["# A", "x", "```", "# not", "```", "## B", "y"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, n int, line string")
    assert [r["section"] for r in sequence.markdown_sections(df, by=["doc"], order="n", line="line").orderBy("n").collect()] == ["A", "A", "A", "A", "A", "B", "B"]


def test_quotas_sum_up(spark):
    for total, n in ((10, 3), (7, 7), (2, 5)):
        got = spark.range(1, n + 1).select(sequence.quotas(F.lit(total), F.lit(n), F.col("id")).alias("q")).collect()
        left, want = total, []
        for i in range(n):
            want.append(left // (n - i))
            left -= want[-1]
        assert [r["q"] for r in got] == want


def test_shards_cover(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("k"))
    assert rows(sequence.shards(df, order=["k"], n=7), "k", "shard") == [(k, k % 7) for k in range(100)]


def test_upsert_and_ignore(spark):
    cur = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k int, v string, ts int")
    new = spark.createDataFrame([(1, "c", 5), (2, "d", 4), (3, "e", 1)], "k int, v string, ts int")
    assert rows(storage.upsert(cur, new, ["k"], "ts"), "k", "v") == [(1, "c"), (2, "b"), (3, "e")]
    assert rows(storage.insert_or_ignore(cur, new, ["k"], "ts"), "k", "v") == [(1, "a"), (2, "b"), (3, "e")]


def test_publish_and_manifest(spark, tmp_path):
    versions.publish(spark.range(3).toDF("k"), str(tmp_path / "idx"))
    versions.publish(spark.range(5).toDF("k"), str(tmp_path / "idx"))
    assert versions.snapshot(spark, str(tmp_path / "idx")).count() == 5
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("x")
    found = storage.manifest(spark, str(tmp_path / "f"))
    expected = spark.createDataFrame([("a.txt", "0"), ("b.txt", "1")], "path string, sha256 string")
    assert rows(storage.verify_manifest(found, expected), "path", "problem") == [("a.txt", "changed"), ("b.txt", "missing")]


def test_readers(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id": "1", "title": "t", "content": "c", "source": "s", "metadata": {"a": "b"}}\n\n{"id": "2", "title": "t", "content": "c", "source": "s", "metadata": {}}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "d.jsonl")).count() == 2
    (tmp_path / "e.jsonl").write_text('{"id": "1"}\n{"id": "1"}\n')
    with pytest.raises(ValueError):
        readers.read_jsonl(spark, str(tmp_path / "e.jsonl"))
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td2\t0\n")
    assert rows(readers.read_qrels(spark, str(tmp_path / "q.tsv"), positive=True), "query_id", "document_id", "relevance") == [("q1", "d1", 2)]
    (tmp_path / "s.txt").write_text('data: {"seq": 1}\n\n: ping\n\ndata: {"seq": 2}\n\n')
    assert rows(readers.read_events(spark, str(tmp_path / "s.txt"), "seq int"), "seq") == [(1,), (2,)]
    log = spark.createDataFrame([("x step:3 - train/loss:0.5",), ("noise",), ("step:3 - val/loss:1e-1",)], "value string")
    assert rows(readers.training_log(log), "step", "kind", "loss") == [(3, "train", 0.5), (3, "val", 0.1)]


def test_trajectory_reasons(spark):
    seeds = spark.createDataFrame([("a-train-1", "q", "research", "The Answer", [("e1", "T", "an answer, it says")])], "seed_id string, query string, variant string, expected_answer string, evidence array<struct<evidence_id:string,title:string,text:string>>")
    step = {"rationale_summary": "because", "action": "search", "arguments": {"q": [1]}, "observation": "o", "evidence_ids": ["e1"]}
    last = {"rationale_summary": "done", "action": "answer", "observation": ""}
    good = {"seed_id": "a-train-1", "query": " q ", "variant": "research", "steps": [step, last], "final_answer": "answer"}
    cases = {
        "": good, "unknown": good, "invalid_json": None, "seed_id_mismatch": good | {"seed_id": "x"}, "invented_evidence_id": good | {"steps": [step | {"evidence_ids": ["e9"]}, last]},
        "missing_answer_action,answer_action_not_final": good | {"steps": [step]}, "multiple_answer_actions": good | {"steps": [last, last]}, "query_mismatch,variant_mismatch": good | {"query": "r", "variant": "verification"},
        "possible_secret": good | {"final_answer": "my password: x"},
        "invalid_schema:extra:extra_forbidden,invalid_schema:final_answer:string_type,invalid_schema:steps.0.action:literal_error,invalid_schema:steps.1.observation:missing": {k: v for k, v in good.items()} | {"extra": 1, "final_answer": 3, "steps": [step | {"action": "plan"}, {k: v for k, v in last.items() if k != "observation"}]},
        "invalid_schema:steps:too_long": good | {"steps": [step] * 9}, "invalid_schema:steps.0:value_error": good | {"steps": [step | {"observation": " "}, last]}, "invalid_schema:root:model_type": [1],
        "invalid_schema:steps.0.arguments:dict_type,invalid_schema:steps.0.rationale_summary:string_too_short": good | {"steps": [step | {"arguments": [], "rationale_summary": "x"}, last]}, "invalid_schema:steps:too_short": good | {"steps": []},
    }
    raw = [("other" if k == "unknown" else "a-train-1", k, "{" if v is None else f"```json\n{json.dumps(v)}\n```" if k == "" else json.dumps(v)) for k, v in cases.items()]
    out = trajectories.reasons(spark.createDataFrame(raw, "seed_id string, kind string, text string"), seeds)
    assert {r["kind"]: ",".join(r["reasons"]) for r in out.collect()} == {k: "unknown_seed" if k == "unknown" else k for k in cases}
    ok = out.where("accepted")
    records = trajectories.to_records(ok, "sys")
    assert [m["role"] for m in records.first()["messages"]] == ["system", "user", "assistant"]
    turns = trajectories.to_turns(records, "act").first()["messages"]
    assert [m["role"] for m in turns] == ["system", "user", "assistant", "tool", "assistant"] and json.loads(turns[4]["content"])["final_answer"] == "answer" and json.loads(turns[2]["content"])["arguments"] == {"q": [1]}
    assert trajectories.with_prompt(records, "new").first()["messages"][0]["content"] == "new"
    with pytest.raises(ValueError):
        trajectories.with_prompt(records.withColumn("messages", F.slice("messages", 1, 2)), "new").collect()
    every = {r["source"]: r for r in trajectories.audit(out).collect()}
    assert set(every) == {None, "a"} and every["a"]["records"] == 1 and every["a"]["normalized_exact_rate"] == 1.0 and every[None]["actions"] == {"answer": 1, "search": 1} and every["a"]["expected_supported_by_seed_evidence_rate"] == 1.0
    assert trajectories.acceptance(out).first()["acceptance_rate"] == pytest.approx(1 / len(cases))


def test_seeds_cases_and_padding(spark):
    rows = spark.createDataFrame([("h", "r1", " Q? ", "A", ["t", "u", "v"], [["x", "y"], [" "], ["z" * 3000]], ["t", "v"]), ("h", "r2", "Q2", "A", ["t"], [["x"]], ["t"])], "source string, id string, question string, answer string, titles array<string>, sentences array<array<string>>, facts array<string>")
    shaped = rows.select("source", "id", "question", "answer", F.lit(None).cast("array<string>").alias("aliases"), F.struct(F.col("titles").alias("title"), "sentences").alias("context"), F.struct(F.col("facts").alias("title")).alias("supporting_facts"))
    seen = readers.paragraph_evidence(shaped, F.lit("h-e"), shape="parallel")
    assert [[(e["evidence_id"], len(e["text"]), e["supporting"]) for e in r["evidence"]] for r in seen.orderBy("id").collect()] == [[("h-e0", 3, True), ("h-e2", 2000, True)], [("h-e0", 1, True)]]
    cases = trajectories.final_cases(seen, spark.createDataFrame([("other",)], "question string"), seed="s", per_source=5).collect()
    assert [(c["case_id"], c["gold_claim"], len(c["distractor"])) for c in cases] == [("h-validation-r1", 'The answer to "Q?" is "A".', 2)]
    assert trajectories.final_cases(seen, spark.createDataFrame([(" q?",)], "question string"), seed="s", per_source=5).count() == 0
    seeds = trajectories.seeds_of(seen, "h", order="id").withColumn("ord", F.when(F.col("seed_id") == "h-train-r1", 0).otherwise(1))
    assert rows_of(seeds, "seed_id", "variant") == [("h-train-r1", "research"), ("h-train-r2", "verification")]
    got = [r["seed_id"] for r in trajectories.padded(seeds, 5).orderBy("ord").collect()]
    assert got == ["h-train-r1", "h-train-r2", "h-train-r1-verification", "h-train-r2-research", "h-train-r1-verification-2"]


def rows_of(df, *columns):
    return rows(df, *columns)


def test_failure_labels_against_a_plain_version(spark):
    r = random.Random(11)
    ids = [f"c{i}" for i in range(9)]

    def ndcg(ranked, grades):
        gain = lambda gs: sum((2**g - 1) / math.log2(k + 2) for k, g in enumerate(gs[:5]) if g > 0)
        best = gain(sorted((g for g in grades.values() if g > 0), reverse=True))
        return gain([grades.get(i, 0) for i in ranked]) / best if best else 0.0

    rr = lambda ranked, grades: next((1 / k for k, i in enumerate(ranked, 1) if grades.get(i, 0) > 0), 0.0)

    def plain(c):
        _, answerable, grades, b, d, f, before, after, rag, signals = c
        found = []
        if grades:
            good = {i for i, g in grades.items() if g > 0}
            recall = lambda x: len(good & set(x[:5])) / len(good) if good else 0.0
            best = max(ndcg(b, grades), ndcg(d, grades))
            found += ["lexical_mismatch"] * (recall(d) > recall(b)) + ["dense_false_positive"] * (recall(b) > 0 == recall(d))
            found += ["fusion_regression"] * bool(f and ndcg(f, grades) < best) + ["fusion_improvement"] * bool(f and ndcg(f, grades) > best)
            if before or after:
                x, y = (ndcg(before, grades), rr(before, grades)), (ndcg(after, grades), rr(after, grades))
                found += ["candidate_missing_before_rerank"] if not good & set(before) else ["reranker_improvement"] if y[0] > x[0] or y[1] > x[1] else ["reranker_regression"] if y[0] < x[0] or y[1] < x[1] else []
        elif answerable is not False:
            found.append("annotation_uncertain")
        for _, _, abstained, cited, invalid, context in rag:
            found += ["citation_invalid_id"] * bool(invalid or set(cited) - set(context)) + ["citation_missing"] * (answerable is True and not abstained and not cited)
            found += ["no_answer_false_positive"] * (answerable is False and not abstained) + ["false_abstention"] * bool(answerable is True and abstained and context) + ["correct_abstention"] * (answerable is False and abstained)
        return list(dict.fromkeys(found + [s for s in signals if s in failures.LABELS]))

    pick = lambda: r.sample(ids, r.randint(0, 7))
    cases = [(f"k{i:03}", r.choice([True, False, None]), {x: r.randint(0, 3) for x in r.sample(ids, r.randint(0, 3))}, pick(), pick(), pick(), pick(), pick(),
              [(n, "a", r.random() < 0.4, r.sample(ids, r.randint(0, 2)), r.sample(ids, r.randint(0, 1)), r.sample(ids, r.randint(0, 5))) for n in ("baseline", "reranked")[: r.randint(0, 2)]], r.sample(["context_noise", "odd", "fusion_improvement"], r.randint(0, 2))) for i in range(150)]
    out = failures.analyze(spark.createDataFrame([*cases, cases[0]], failures.CASE))
    assert {x["case_id"]: x["labels"] for x in out.collect()} == {c[0]: plain(c) for c in cases}
    order = [s for s, _ in failures.STAGES]
    assert len(failures.LABELS) == 44 and all(x["stages"] == sorted(x["stages"], key=order.index) for x in out.collect())
    empty = failures.analyze(spark.createDataFrame([("n", None, None, None, None, None, None, None, None, None)], failures.CASE)).first()
    assert empty["labels"] == ["annotation_uncertain"] and empty["first_stage"] == "annotation"


def test_claim_evaluation(spark):
    cases = spark.createDataFrame([("c", ["cats"], ["e1", "e2", "e3"])], "case_id string, accepted array<string>, evidence_ids array<string>")
    gold = spark.createDataFrame([("c", 1, "Cats purr loudly", ["e1", "e2"], ["e3"]), ("c", 2, "Dogs bark", [], [])], "case_id string, gold_no int, gold_text string, supporting array<string>, contradicting array<string>")
    said = {"full": "Cats purr loudly [E:e1] [E:e2].", "part": "Cats purr loudly [E:e1] [E:x].", "against": "Cats purr loudly [E:e3]!", "none": "", "unknown": "Fish swim. Dogs bark [E:e1]."}
    answers = spark.createDataFrame([("c", m, "Cats!" if m == "full" else "no", t, 1.0, 2) for m, t in said.items()], "case_id string, mode string, answer string, report string, latency_ms double, total_tokens int")
    out = {r["mode"]: r for r in evaluate.evaluate_claims(cases, gold, answers).collect()}
    assert out["full"]["failures"] == [] and out["full"]["precision"] == out["full"]["coverage"] == 1.0
    assert out["part"]["failures"] == ["answer_incorrect", "invalid_citation", "partial_support"] and out["part"]["coverage"] == out["part"]["invalid_rate"] == 0.5
    assert out["against"]["failures"] == ["answer_incorrect", "contradicted_claim"]
    assert out["none"]["failures"] == ["answer_incorrect", "empty_report", "missing_citation"]
    assert out["unknown"]["failures"] == ["answer_incorrect", "missing_citation", "unsupported_claim"] and out["unknown"]["unsupported"] == 1.0
    modes = {r["mode"]: r for r in evaluate.mode_summary(evaluate.evaluate_claims(cases, gold, answers)).collect()}
    assert modes["full"]["failure_counts"] == {} and modes["part"]["failure_counts"]["partial_support"] == 1 and modes["full"]["exact"] == 1.0


def test_hybrid_names_its_sources(spark):
    schema = "query int, id string, rank int, score double"
    lexical, near = spark.createDataFrame([(1, "a", 1, 5.0), (1, "b", 2, 4.0)], schema), spark.createDataFrame([(1, "b", 1, 0.9), (1, "c", 2, 0.8), (1, "z", 9, 0.1)], schema)
    out = retrieval.hybrid(lexical, near, top_k=3, candidate_k=3).orderBy("rank").collect()
    assert [x["id"] for x in out] == ["b", "a", "c"] and out[0]["sources"] == ["bm25", "dense"] and out[0]["source_ranks"] == {"bm25": 2, "dense": 1} and out[1]["source_scores"] == {"bm25": 5.0}
    assert out[0]["score"] == pytest.approx(sum(out[0]["contributions"].values()))
    for bad in ({"top_k": 0}, {"top_k": 5, "candidate_k": 3}, {"constant": 0}):
        with pytest.raises(ValueError):
            retrieval.hybrid(lexical, near, **bad)


def test_overlap_returns_rows_without_overlap(spark):
    r = random.Random(3)
    sets = [(i, sorted({r.choice("abcdefgh") for _ in range(r.randint(0, 4))})) for i in range(30)]
    asked = [(1, ["a", "b"]), (2, ["z"]), (3, []), (4, ["h"])]
    out = retrieval.overlap(spark.createDataFrame(sets, "id int, words array<string>"), spark.createDataFrame(asked, "query int, words array<string>"), top_k=8)
    want = [(q, i, n, k) for q, w in asked for k, (n, i) in enumerate(sorted(((len(set(w) & set(s)), i) for i, s in sets), key=lambda x: (-x[0], x[1]))[:8], 1)]
    assert rows(out, "query", "id", "score", "rank") == sorted(want)


def test_ingestion(spark):
    docs = spark.createDataFrame([("d1", "uploaded", "h1", "completed", 800, 120, "f1"), ("d2", "demo", "h2", "indexing", 800, 120, "f2"), ("d3", "evaluation", "h3", "completed", 800, 120, "f3"), ("d4", "uploaded", "h4", "failed", 800, 120, "f4")], "document_id string, corpus_namespace string, content_hash string, status string, chunk_size int, chunk_overlap int, original_filename string")
    up = spark.createDataFrame([("uploaded", "h1", 800, 120), ("uploaded", "h1", 900, 120), ("uploaded", "h4", 800, 120), ("uploaded", "new", 800, 120)], "corpus_namespace string, content_hash string, chunk_size int, chunk_overlap int")
    assert rows(ingest.register(docs, up), "content_hash", "chunk_size", "created", "duplicate") == [("h1", 800, False, True), ("h1", 900, False, False), ("h4", 800, False, False), ("new", 800, True, False)]
    doomed = spark.createDataFrame([("d1",), ("d2",), ("x",)], "document_id string")
    assert sorted((r[0], r[1] or "") for r in ingest.deletable(docs, doomed).collect()) == [("d1", ""), ("d2", "read_only_corpus"), ("x", "document_not_found")]
    marked = ingest.mark_deleting(docs, doomed)
    assert rows(marked.where("status = 'deleting'"), "document_id") == [("d1",)]
    assert rows(ingest.delete_flow(marked, doomed, rebuilt=True), "document_id") == [("d2",), ("d3",), ("d4",)]
    assert marked.count() == 4 and ingest.delete_flow(marked, doomed, rebuilt=False).where("document_id = 'd1' AND status = 'completed'").count() == 1
    kids = spark.createDataFrame([("d1", 1), ("d2", 1)], "document_id string, n int")
    assert rows(ingest.replace_children(kids, spark.createDataFrame([("d1", 7), ("d1", 8)], "document_id string, n int"), "document_id"), "document_id", "n") == [("d1", 7), ("d1", 8), ("d2", 1)]
    with pytest.raises(ValueError):
        ingest.replace_children(kids, kids, "document_id", immutable=docs.where("corpus_namespace = 'demo'"))
    log = spark.createDataFrame([("d1", 1, "pending", None), ("d1", 2, "chunking", None), ("d2", 1, "parsing", None), ("d2", 2, "failed", "no_chunks"), ("d2", 3, "indexing", None)], "document_id string, seq int, stage string, error_code string")
    assert sorted((r["document_id"], r["status"], r["progress"], r["error_code"] or "") for r in ingest.ingestion_status(log).collect()) == [("d1", "chunking", 40, ""), ("d2", "failed", 100, "no_chunks")]
    raw = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfa  b\r\n"),), (bytearray(b"\xff"),), (bytearray(b" \n"),)], "c binary").select(ingest.decode(F.col("c")).alias("d")).select("d.*").collect()
    assert [(r["text"], r["error"]) for r in raw] == [("a b", None), (None, "invalid_utf8"), (None, "no_extractable_text")]


def test_markdown_blocks(spark):
    text = "intro\n# Title #\nbody one\n```\n# no heading\n```\n## Part\n\n\n\ntext\n### Empty\n# Second\nend"
    docs = spark.createDataFrame([(1, text, "file"), (2, "", "f"), (3, "plain", "f")], "doc_id int, text string, name string")
    out = ingest.markdown_blocks(docs, title_col="name")
    got = [(r["doc"], r["block"], r["title"], r["section"], r["text"]) for r in out.orderBy("doc", "block").collect()]
    assert got == [(1, 0, "file", None, "intro"), (1, 1, "Title", "Title", "body one\n```\n# no heading\n```"), (1, 2, "Title", "Part", "text"), (1, 3, "Title", "Second", "end"), (3, 0, "f", None, "plain")]
    assert {r["doc"]: r["text"] for r in ingest.text_to_hash(out).collect()}[3] == "[page=;section=]\nplain"


def plain_url(url):
    """One form of a URL by the standard library."""
    from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

    try:
        p = urlsplit(url.strip())
        if p.scheme.lower() not in ("http", "https") or not p.hostname or p.username or p.password:
            return None
        host = p.hostname.encode("idna").decode("ascii").lower()
        host = f"[{host}]" if ":" in host else host
        host += f":{p.port}" if p.port and (p.scheme.lower(), p.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return None
    items = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in T.TRACKING and not k.lower().startswith("utm_")]
    return urlunsplit((p.scheme.lower(), host, __import__("re").sub("/+", "/", p.path or "/"), urlencode(sorted(items)), ""))


def test_urls_in_one_form(spark):
    r = random.Random(3)
    hosts = ["Example.com", "bücher.de", "[::1]", "[FE80::1]", "a..b", ".a", "a.", "x" * 64, "日本.jp", "EXAMPLE.org", "", "u@h.de", "u:p@h.de", "@h.de", "münchen.DE", "[::1", "127.0.0.1"]
    ports = ["", "", ":80", ":443", ":8080", ":", ":0", ":0080", ":x", ":70000"]
    parts = ["q=%41b+c", "c", "b=", "=v", "utm_source=x", "UTM_a=1", "ref=1", "fbclid=2", "q=a%2Fb", "z=%zz", "a=b=c", "é=ü", "x=*~-_.", "k=%E4%B8%AD", "", "p= "]
    urls = [r.choice(["http", "HTTPS", "https", "ftp"]) + "://" + r.choice(hosts) + r.choice(ports) + r.choice(["", "/", "//a//b", "/é/%41", "/a;b"]) + r.choice(["", "?" + "&".join(r.choices(parts, k=r.randint(0, 5)))]) + r.choice(["", "#f?x"]) for _ in range(1500)]
    urls += ["", "http:example.com", " https://a.de/x ", "http://[::1]:8080/?b&a", "//a.de", "mailto:a@b.de"]
    out = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", T.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in out} == {i: plain_url(u) for i, u in enumerate(urls)}
    assert plain_url("https://bücher.de:443/a?q=%41b+c&c&utm_x=1") == "https://xn--bcher-kva.de/a?c=&q=Ab+c" and plain_url("http://[::1]:8080") == "http://[::1]:8080/"


def test_search_in_compatible_form(spark):
    docs = spark.createDataFrame([(1, "BM25 ranking", "x"), (2, "other words", "Ｂｍ２５ ranking"), (3, "Ｂｍ２５", "ﬁle ranking"), (4, None, None)], "doc_id int, title string, text string")
    index = retrieval.build_index(docs, title_col="title")
    asked = retrieval.query_terms(spark.createDataFrame([(1, "bm25"), (2, "ｆｉｌｅ")], "q int, t string"), id_col="q", text_col="t")
    hits = retrieval.bm25(index, asked).collect()
    assert {(r["query"], r["id"]) for r in hits} == {(1, 1), (1, 2), (1, 3), (2, 3)} and max((r for r in hits if r["query"] == 1), key=lambda r: r["score"])["id"] == 3
    import unicodedata

    samples = "".join(chr(c) for c in range(1, 0x3200) if not 0xD800 <= c < 0xE000) + "".join(map(chr, range(0x4E00, 0xA000, 7)))
    rows = spark.createDataFrame([(c, c * 2 + "e") for c in samples], "c string, t string").select("t", T.compatible(F.col("t")).alias("n")).collect()
    assert all(r["n"] == unicodedata.normalize("NFKC", r["t"]) for r in rows)
    again = retrieval.build_index(docs, title_col="title")
    assert again.postings.inputFiles() == index.postings.inputFiles() and retrieval.build_index(docs, title_col="title", title_weight=3.0).postings.inputFiles() != index.postings.inputFiles()


def test_a_header_that_fits_exactly_is_packed(spark):
    blocks = spark.createDataFrame([("q", 1, "h" * 4, "abcd"), ("q", 2, "g" * 2, "later")], "query string, rank int, header string, content string")
    got = [(r["packed"], r["truncated"]) for r in retrieval.pack(blocks, max_chars=9 + 2 + 3).orderBy("rank").collect()]
    assert got == [("hhhh\nabcd", False), ("gg\n", True)]
    assert retrieval.pack(blocks, max_chars=9 + 2 + 2).count() == 1


def test_dense_in_batches_and_blocks(spark, monkeypatch):
    import numpy as np

    g = np.random.default_rng(5)
    x = g.normal(size=(300, 6))
    x[10], x[11] = 0, x[12]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, []), (302, [float("nan")] * 6), (303, [1.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(3)
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 8 * 6 * 7)
    got = {(r["query"], r["rank"]): (r["id"], round(r["score"], 9)) for r in retrieval.dense(df, df.where("vec_id % 10 = 2 OR vec_id > 298"), top_k=5).collect()}
    u = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and len(v) == 6 and np.isfinite(v).all() and any(v)}
    for q in [i for i in u if i % 10 == 2 or i > 298]:
        best = sorted((-round(float(u[i] @ u[q]), 9), i) for i in u)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert got[303, 1] == (303, 1.0) and len(got) == 1 + 5 * len([i for i in u if i % 10 == 2 or i > 298])


def test_near_pairs_at_every_distance(spark):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = list(enumerate(base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(4)]))
    df = spark.createDataFrame([(i, p >> 32, p & 0xFFFFFFFF) for i, p in prints], "id int, hi bigint, lo bigint")
    first = {}
    for i, p in prints:
        first.setdefault(p, i)
    nodes = [(i, p) for p, i in first.items()]
    for distance in (1, 3):
        want = {(min(a, b), max(a, b), (p ^ q).bit_count()) for n, (a, p) in enumerate(nodes) for b, q in nodes[n + 1 :] if (p ^ q).bit_count() <= distance}
        got = [tuple(x) for x in corpus.near_pairs(df, distance=distance).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_pairs_broadcast_no_keyed_prints(spark):
    prints = storage.materialize(spark.range(64).select("id", F.col("id").alias("hi"), F.xxhash64("id").bitwiseAND(0xFFFFFFFF).alias("lo")), "prints")
    plan = corpus.near_pairs(prints)._jdf.queryExecution().sparkPlan().toString()  # small tables, which are broadcast where nothing forbids it
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_near_pair_count_broadcasts_no_prints(spark):
    prints = storage.materialize(spark.range(64).select("id", (F.col("id") % 24).alias("hi"), F.lit(5).cast("long").alias("lo")), "prints")
    counted = corpus.near_pair_count(prints)
    seen = [i % 24 for i in range(64)]
    assert counted.first()["pairs"] == sum((a ^ b).bit_count() <= 3 for k, a in enumerate(seen) for b in seen[:k])
    plan = counted._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_dense_holds_no_more_than_a_tile_of_scores(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(6).integers(-2, 3, size=(900, 3)).astype(float)  # many equal vectors, many ties
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id int, embedding array<double>").coalesce(1)
    monkeypatch.setattr(retrieval, "SCORE_BYTES", 8 * 9 * 50)
    found = retrieval.dense(df, df.where("vec_id % 100 = 1"), top_k=4)
    got = {(r["query"], r["rank"]): r["id"] for r in found.collect()}
    u = {i: v / np.linalg.norm(v) for i, v in enumerate(x) if v.any()}
    asked = [i for i in u if i % 100 == 1]
    assert got == {(q, k + 1): i for q in asked for k, (_, i) in enumerate(sorted((-round(float(u[i] @ u[q]), 9), i) for i in u)[:4])}
    best = retrieval._Best(2, 3)
    for first in range(0, 900, 7):
        best.add(np.array([[i % 5, -i] for i in range(first, min(first + 7, 900))], dtype=float), __import__("pyarrow").array(range(first, min(first + 7, 900))))
    assert best.ids.to_pylist() == [4, 9, 14, 0, 1, 2]  # no more is held than what is passed on


def test_judgments_of_groups_are_those_of_their_queries(spark):
    r = random.Random(8)
    hits = spark.createDataFrame([(q, i, n + 1) for q in range(9) for n, i in enumerate(r.sample(range(60), 10))], "query int, id int, rank int")
    groups = spark.createDataFrame([(q, q % 4) for q in range(9)], "query int, group int")
    of_groups = spark.createDataFrame([(g, i, r.randint(0, 3)) for g in range(3) for i in r.sample(range(60), 25)], "group int, id int, grade int")
    each = groups.join(of_groups, "group").select("query", "id", "grade")
    want = {x["query"]: tuple(x) for x in evaluate.metric_bundle(hits, each).collect()}
    got = {x["query"]: tuple(x) for x in evaluate.metric_bundle(hits, of_groups, groups=groups).collect()}
    assert set(got) == set(want) == {0, 1, 2, 4, 5, 6, 8} and all(got[q] == pytest.approx(want[q]) for q in want)


def test_judgments_are_not_broadcast(spark):
    qrels = storage.materialize(spark.range(3000).select((F.col("id") % 10).alias("group"), "id", (F.col("id") % 3 + 1).alias("grade")), "qrels")
    hits = spark.createDataFrame([(0, 4, 1), (0, 10, 2), (2, 12, 1)], "group long, id long, rank int")
    graded = evaluate.judged(hits, qrels, of="group")
    assert rows(graded, "group", "id", "grade") == [(0, 4, 0), (0, 10, 2), (2, 12, 1)]
    plan = graded._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_equal_hits_have_equal_gains_whatever_their_order(spark):
    hits = [(10 * n + g, f"{n}-{rank}", rank) for g in range(10) for n in range(20) for rank in range(1, 11)]
    random.Random(3).shuffle(hits)
    qrels = spark.range(200).selectExpr("id AS query").crossJoin(spark.range(1, 11).selectExpr("id AS rank")).selectExpr("query", "concat(query div 10, '-', rank) AS id", "cast(1 + rank % 3 AS int) AS grade")
    got = evaluate.metric_bundle(spark.createDataFrame(hits, "query long, id string, rank int").repartition(7), qrels)
    assert len({r["ndcg_10"] for r in got.collect()}) == 1


def test_lengths_of_judged_documents_are_not_gathered(spark):
    qrels = storage.materialize(spark.range(900).selectExpr("id % 3 AS group", "id", "1 AS grade"), "qrels")
    docs = storage.materialize(spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 < 2 THEN repeat('x', cast(id AS int) + 100) END AS text"), "docs")
    sizes = analysis_queries._lengths(qrels, docs)
    assert rows(sizes, "group", "relevant", "lengths") == [(0, 300, [100, 997]), (1, 300, [101, 998]), (2, 300, [])]
    assert "Broadcast" not in sizes._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["compare_retrievers", "retriever_evaluation"])
def test_judgments_are_stored_once_for_all_queries_of_a_label(spark, monkeypatch, name):
    stored = {}
    monkeypatch.setattr(analysis_queries, "materialize", lambda df, n: stored.setdefault(n, storage.materialize(df, n)))
    getattr(analysis_queries, name)(spark, "/root/testdata/sf0.001")
    assert 0 < stored["qrels"].count() <= stored["vectors"].where("id % 7 = 0").count()


def test_bm25_rankings_without_pairs(spark, monkeypatch):
    r = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(r.choices("abcdefgh", weights=[40, 20, 9, 5, 3, 2, 1, 1], k=r.randint(0, 12)))) for i in range(200)] + [(900, None)], "doc_id int, text string")
    asked = retrieval.query_terms(spark.createDataFrame([(f"q{i}", " ".join(r.choices("abcdefghz", k=4))) for i in range(7)] + [("none", "z")], "q string, text string"), id_col="q", text_col="text")
    index = retrieval.build_index(docs)
    monkeypatch.setattr(retrieval, "SCORE_BYTES", 8 * 100)
    monkeypatch.setattr(retrieval, "bm25", None)
    monkeypatch.setattr(retrieval, "bm25_contributions", (contributions := retrieval.bm25_contributions) and None)
    got = retrieval.bm25_rankings(index, asked, top_k=5, bs=(0.75, 0.0)).collect()
    for b in (0.75, 0.0):
        scored = contributions(index, asked, b=b).groupBy("query", "id").agg(F.sum("contribution").alias("score"))
        want = sorted((x["query"], x["rank"], x["id"], round(x["score"], 9)) for x in retrieval.top_hits(scored, 5).collect())
        assert sorted((x["query"], x["rank"], x["id"], round(x["score"], 9)) for x in got if x["b"] == b) == want and want


def test_bm25_rankings_broadcast_no_lengths(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5}") for i in range(60)], "doc_id int, text string")
    asked = retrieval.query_terms(spark.createDataFrame([("q", "w1 w3")], "q string, text string"), id_col="q", text_col="text")
    plan = retrieval.bm25_rankings(retrieval.build_index(docs), asked, top_k=5)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "BroadcastHashJoin [term#" in plan and "SortMergeJoin [id#" in plan


def test_labels_beyond_the_bound_are_merged(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(analysis_queries, "broadcast_if_small", lambda df, **k: storage.broadcast_if_small(df, 10, **k))
    monkeypatch.setattr(analysis_queries, "materialize", lambda df, n: (plans.setdefault(n, df._jdf.queryExecution().sparkPlan().toString()), storage.materialize(df, n))[1])
    docs = analysis_queries._vectors(spark, "/root/testdata/sf0.001")[0]
    assert docs.count() == 200 and all("SortMergeJoin [no#" in plans[n] and "BroadcastHashJoin [no#" not in plans[n] for n in ("vectors", "asked"))


def test_every_text_has_a_vector(spark, tmp_path):
    sign = lambda w: (lambda h: (h % 64, h >> 63))(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little"))
    at = {}
    for i in range(10_000):  # two words in one slot with opposite signs
        slot, s = sign(f"w{i}")
        if at.setdefault(slot, (i, s))[1] != s:
            break
    texts = [(1, None), (2, ""), (3, " \n "), (4, f"w{at[slot][0]} w{i}"), (5, "one two two")]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("title", F.lit(""))
    got = {r["id"]: r["vector"] for r in vectors.refresh(df, str(tmp_path), model="m", embed=V.hashing_embedder(64), dimension=64).collect()}
    assert sorted(got) == ["1", "2", "3", "4", "5"] and all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in got.values())
    want = [0] * 64
    for w in "one two two".split():
        want[sign(w)[0]] += 1 if sign(w)[1] else -1
    assert got["5"] == pytest.approx([x / math.sqrt(sum(y * y for y in want)) for x in want])


def test_passages_by_their_rarest_word(spark):
    docs = spark.createDataFrame([(1, "a b  c\na b d"), (2, "b c"), (3, None), (4, "c a b d e"), (5, "abd")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "a b d"), (4, "zz"), (5, ""), (6, None), (7, "e"), (8, "b d e f")], "item_id int, text string")
    assert sorted(map(tuple, corpus.containment(docs, items).collect())) == [(1, 1), (1, 2), (1, 3), (2, 2), (4, 1), (4, 3), (4, 7)]


def test_common_words(spark):
    from collections import Counter

    r = random.Random(2)
    rows = [([r.choice("abcd") for _ in range(r.randint(0, 9))], [r.choice("abcd") for _ in range(r.randint(0, 9))]) for _ in range(100)]
    got = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, l array<string>, r array<string>").select("i", T.common(F.col("l"), F.col("r")).alias("n")).collect()
    assert {x["i"]: x["n"] for x in got} == {i: sum((Counter(a) & Counter(b)).values()) for i, (a, b) in enumerate(rows)}
