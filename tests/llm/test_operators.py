"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd inputs."""

import functools
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import decontaminate, html_extract, licenses, minhash, mixing, quality_knn, quality_rules, token_counts, token_store, toxicity

from .conftest import prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return WORD.findall(t or "")


# ---- HTML extraction


@pytest.fixture(scope="module")
def labeller():
    return html_extract.trained()


def test_labels_made_up_pages(labeller):
    xs, ys = html_extract.labelled_pages(150, 4242)
    right = [((p >= 0.5) == y).mean() for p, y in zip(labeller.probabilities(xs), ys, strict=True)]
    assert np.mean(right) > 0.97


@pytest.mark.parametrize("family", sorted(html_extract.FAMILIES))
def test_labels_pages_of_other_layouts(labeller, family):
    r, kept, said_chars, right = random.Random(77), 0, 0, 0
    for _ in range(60):
        page, said = html_extract.family_page(family, r)
        blocks = html_extract.blocks_of(page)
        got = [b.text for b, p in zip(blocks, labeller.probabilities([html_extract.vectors(blocks)])[0], strict=True) if p >= 0.5]
        assert [b.text for b in blocks if b.text in said]
        kept, said_chars, right = kept + sum(map(len, got)), said_chars + sum(map(len, said)), right + sum(len(t) for t in got if t in said)
    assert right >= 0.9 * said_chars and right >= 0.97 * kept


def test_pages_that_are_not_made_up(labeller):
    """Hand-made pages in four layouts: divs without a telling name, an encyclopaedia, a layout table, an article with its footer."""
    pages = {
        "<div class=x1><div class=css-a>Home</div><div class=css-a>World</div></div><div class=css-z><div class=css-k><h1>River floods the old town</h1><div class=css-p>Heavy rain on Monday night sent the river over its banks and into the streets of the old town, officials said.</div>"
        "<div class=css-p>More than two hundred people left their homes, and the bridge was closed until further notice.</div><div class=css-p>Water levels are expected to fall by Thursday, the weather service said.</div></div><div class=css-m><div>More on this story</div><a href=/1>Flood warnings</a> <a href=/2>How to prepare</a></div></div>":
        ["River floods the old town", "Heavy rain on Monday night sent the river over its banks and into the streets of the old town, officials said.", "More than two hundred people left their homes, and the bridge was closed until further notice.", "Water levels are expected to fall by Thursday, the weather service said."],
        "<h1>Red fox</h1><table class=infobox><tr><th>Kingdom:</th><td>Animalia</td></tr><tr><th>Phylum:</th><td>Chordata</td></tr></table><p>The red fox is the largest of the true foxes and one of the most widely distributed members of the order Carnivora.</p><div class=toc><h2>Contents</h2><ul><li><a href=#1>1 Range</a></li>"
        "<li><a href=#2>2 Diet</a></li></ul></div><h2>Range</h2><p>It is present across the entire Northern Hemisphere.</p><h2>Diet</h2><p>Red foxes are omnivores with a highly varied diet.</p><div id=footer><ul><li>This page was last edited on 3 May 2024.</li><li><a href=/p>Privacy policy</a></li></ul></div>":
        ["Red fox", "The red fox is the largest of the true foxes and one of the most widely distributed members of the order Carnivora.", "Range", "It is present across the entire Northern Hemisphere.", "Diet", "Red foxes are omnivores with a highly varied diet."],
        "<table><tr><td><a href=/>Home</a> <a href=/l>Links</a></td><td><h2>My garden</h2><p>I have grown roses for twenty years, and every spring they come back.</p><p>This year the frost came late and some were lost.</p></td></tr></table>":
        ["My garden", "I have grown roses for twenty years, and every spring they come back.", "This year the frost came late and some were lost."],
        "<article><h1>How to bake bread</h1><p>Mix the flour and the water and let it rest for an hour before you add the salt.</p><p>Bake it hot.</p><footer>Tags: <a href=/t>bread</a>, <a href=/u>baking</a></footer></article>":
        ["How to bake bread", "Mix the flour and the water and let it rest for an hour before you add the salt.", "Bake it hot."],
    }
    for page, want in pages.items():
        blocks = html_extract.blocks_of(page)
        assert [b.text for b, p in zip(blocks, labeller.probabilities([html_extract.vectors(blocks)])[0], strict=True) if p >= 0.5] == want


def test_extracts_the_article(spark, labeller):
    page = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav><div class=ad>Buy now, it is cheap.</div><article><h1>A &lt;head&gt;</h1><p>First  sentence\n here. And another one, longer than before.<br><p>Tea &amp; cake were served at the table. Nobody came.</p></article><footer>&copy; 2024 someone. All rights reserved.</footer>"
    rows = [(1, "u", page, "x"), (2, None, None, None), (3, "u", "", "y"), (3, "u", "", "y"), (None, "u", "<div><p>", "z"), (5, "u", "<p>" + "long words. " * 40_000, "z")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, he_text string")
    out = html_extract.extract(df, labeller=labeller)
    got = out.collect()
    assert out.columns == ["page_id", "url", "he_text", "he_blocks", "he_kept"] and len(got) == 6
    assert {r["page_id"]: r["he_text"] for r in got}[1] == "A <head>\nFirst sentence here. And another one, longer than before.\nTea & cake were served at the table. Nobody came."
    assert [r["he_text"] for r in got if r["page_id"] in (2, 3)] == ["", "", ""]
    assert html_extract.extract(df.limit(0), labeller=labeller).count() == 0


@given(st.text(alphabet="<>/pdiva=\"' &;!-x\n", max_size=80))
@settings(max_examples=200, deadline=None)
def test_blocks_take_any_markup(page):
    for b in html_extract.blocks_of(page):
        assert b.text == b.text.strip() != ""


def test_deep_pages_keep_all_open_elements():
    shut = "<div class=deep>" * 100
    page = f"<main>{shut}<svg><g>no text</g></svg><section><section>inside</section>between</section>text{'</div>' * 100}below</main><footer>end</footer>"
    got = {b.text: b for b in html_extract.blocks_of(page)}
    assert list(got) == ["inside", "between", "text", "below", "end"]
    assert [got[t].depth for t in got] == [103, 102, 101, 1, 1] and got["end"].path == ("footer",) and got["between"].path[-1] == "section"
    full = html_extract._path_vector(("main", *["div deep"] * 100))
    assert np.allclose(html_extract.vectors([got["text"]])[0, : html_extract.PATH_DIM], full, atol=1e-3)
    assert len(html_extract.blocks_of("<div>x<p>y" * 40_000)) == 80_000


@pytest.mark.parametrize("bad", ['<a "', '<a x="', "<a x='b\"", "<", "</", "<!--", "<a =", '<p title="5" tall">', "<a\n", "<script>", "<!", "<a x=y'"])
def test_any_markup_is_read_in_linear_time(bad):
    began = time.process_time()
    html_extract.blocks_of(bad * 60_000)
    assert time.process_time() - began < 5


def test_attributes_are_read_as_the_standard_says():
    def texts(page):
        return [b.text for b in html_extract.blocks_of(page)]

    assert texts("<div data-x=it's>Hello there</div><p>it don't matter</p><p>tail</p>") == ["Hello there", "it don't matter", "tail"]
    assert texts('<p title="5" tall">One two</p>') == ["One two"]
    assert texts("<p>a < b and <3 c</p></ x><p>d</p><!--><p>e</p><!-- x --!><p>f</p><?php x ?><p>g<p a=\">h\">i</p><p x=\"unclosed>j") == ["a < b and <3 c", "d", "e", "f", "g", "i"]
    assert html_extract._element("div", ' data-x="class=no" CLASS=Main-text class=second id = \'a_b\' style="Display: none"') == "div main text a b hidden"


def test_blocks_agree_with_the_library_parser():
    """On well-formed pages, the text between tags is what the standard library's parser gives."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.now, self.off = [], [], 0

        def cut(self):
            if t := " ".join("".join(self.now).split()):
                self.out.append(t)
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag in html_extract.BLOCK or tag in html_extract.HIDDEN_TAGS:
                self.cut()
            self.now += [" "] * (tag == "br")
            self.off += tag in html_extract.HIDDEN_TAGS

        def handle_endtag(self, tag):
            if tag in html_extract.BLOCK or tag in html_extract.HIDDEN_TAGS:
                self.cut()
            self.off -= tag in html_extract.HIDDEN_TAGS

        def handle_data(self, data):
            if not self.off:
                self.now.append(data)

    r = random.Random(6)
    for _ in range(150):
        page, _ = html_extract.sample_page(r)
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.cut()
        assert [b.text for b in html_extract.blocks_of(page)] == plain.out


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(2)
    model = html_extract.Labeller(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, sizes = r.normal(size=(3, 5, html_extract.DIM)) * 0.3, np.array([5, 3, 1])
    mask = np.arange(5)[None, :] < sizes[:, None]
    y = (r.random((3, 5)) < 0.5) * mask
    x *= mask[:, :, None]

    def loss():
        p = model._forward(x, sizes)[0]
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum() + 0.5e-4 * (model.p["wd"] ** 2).sum()

    grads = model._gradients(x, sizes, y)
    for name, grad in grads.items():
        flat, own = model.p[name].reshape(-1), np.asarray(grad).reshape(-1)
        for i in r.choice(len(flat), min(6, len(flat)), replace=False):
            kept = flat[i]
            flat[i] = kept + 1e-3
            up = loss()
            flat[i] = kept - 1e-3
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-3 - own[i]) < 1e-3 * max(1, abs(own[i])) + 2e-5, name


# ---- token counts


def test_greedy_counts(spark, odd, none):
    r = random.Random(3)
    for _ in range(300):
        some = lambda n: ["".join(r.choice("ab") for _ in range(r.randint(1, 5))) for _ in range(n)]
        starting, continuing = some(r.randint(1, 6)), some(r.randint(0, 6))
        a = token_counts.Automaton(starting, continuing)
        for _ in range(20):
            w = "".join(r.choice("aaabbbc") for _ in range(r.randint(0, 12)))
            assert a.count(w) == token_counts.greedy_count(w, set(starting), set(continuing))
    path = public_tokenizers.path("piece_bpe_32k.model")
    s, c = map(set, token_counts.vocabulary(path))
    out = token_counts.count_tokens(odd, vocabulary_path=path).collect()
    want = Counter()
    for row in odd.collect():
        each = [token_counts.greedy_count(w, s, c) for w in words(row["text"])]
        want[row["doc_id"], len(each), sum(map(abs, each)), each.count(-1)] += 1
    assert Counter(map(tuple, out)) == want
    assert token_counts.count_tokens(none, vocabulary_path=path).count() == 0


def test_long_words_are_counted_whole(spark):
    a = token_counts.Automaton(["ab", "a"], ["abc", "b", "c", "a"])
    word = "abcab" * 300
    assert a.count(word) == token_counts.greedy_count(word, {"ab", "a"}, {"abc", "b", "c", "a"}) > 500
    path = public_tokenizers.path("piece_bpe_32k.model")
    url = "information" * 40
    df = spark.createDataFrame([(1, f"see {url} here")], "doc_id bigint, text string")
    row = token_counts.count_tokens(df, vocabulary_path=path).first()
    assert row["n_words"] == 3 and row["n_unknown"] == 0 and row["n_tokens"] > 40


# ---- near duplicates


def shingles(t, width=5):
    w = words(lower(t))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def components(texts, hundredths):
    """{id: (set size, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= hundredths * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(r, n, size, change):
    """A text and copies with some words changed, each from the one before or the first."""
    out = [prose(r, size).split()]
    for _ in range(n - 1):
        w = list(r.choice(out))
        for _ in range(change):
            w[r.randrange(len(w))] = f"z{r.randint(0, 10**6)}"
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("hundredths", [80, 85])
def test_near_duplicates_match_all_pairs(spark, hundredths):
    r = random.Random(hundredths)
    texts = []
    for size, change in ((40, 1), (120, 2), (120, 3), (300, 4), (300, 8), (900, 12)):
        texts += family(r, 12, size, change)
    texts += [texts[0]] * 5 + [texts[1].upper()] * 3 + ["", " ", "a", "A", "a b c d", "a b c d e"]
    shared = prose(r, 70)
    texts += [shared + " " + prose(r, 12) for _ in range(40)]  # one passage in many: similar, mostly not enough
    ids = list(range(len(texts)))
    r.shuffle(ids)
    docs = dict(zip(ids, texts, strict=True))
    out = minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), hundredths=hundredths)
    want = components(docs, hundredths)
    got = {x["doc"]: (x["n_shingles"], x["component"]) for x in out.collect()}
    assert got == want and len({c for _, c in want.values()}) < len(docs)


def test_near_duplicates_odd(odd, none, odd_rows):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by = defaultdict(set)
    for r in got:
        by[r["doc"]].add((r["component"], r["kept"]))
    assert by[5] == {(5, True)} and by[6] == by[7] == {(5, False)} and by[0] == {(0, True)} and by[12] == {(5, False)} and by[None] == {(5, False), (None, True)}
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_compare_each_text_of_an_id(spark):
    r = random.Random(8)
    a, b, c = (prose(r, 50) for _ in range(3))
    rows = [(7, a), (7, b), (3, b), (9, c), (9, c), (None, c + " more"), (None, prose(r, 40)), (4, prose(r, 40))]
    got = sorted((x["doc"] or -1, x["component"] or -1, x["kept"]) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(-1, -1, True), (-1, 9, False), (3, 3, True), (4, 4, True), (7, 3, False), (7, 7, True), (9, 9, True), (9, 9, True)]


def test_unlike_words_hash_apart():
    def thue_morse(n, x="a", y="b"):
        for _ in range(n):
            x, y = x + y, y + x
        return x, y

    seen = set()
    texts = [w for n in range(11) for w in thue_morse(n)] + ["\0" * n for n in range(1, 30)] + ["a" * n for n in range(3, 60)] + ["x\0", "x", "\0x", "é" * 12, "é" * 13]
    for w in texts:
        seen.add(int(minhash.word_hashes(w)[0]))
    assert len(seen) == len(set(texts))
    one, other = thue_morse(9)
    assert not set(minhash.shingle_set("x y z w " + one)) & set(minhash.shingle_set("x y z w " + other))
    assert (minhash.word_hashes("The  cat\nTHE\tcat") == minhash.word_hashes("the cat the cat")).all()


def test_star_components(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(r.randint(0, 90), r.randint(0, 90)) for _ in range(60)] + [(5, 5), (1, 0), (0, 1)]
    root = list(range(200))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    seen = {x for a, b in edges if a != b for x in (a, b)}
    got = {x["doc"]: x["component"] for x in minhash.star_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for i in seen}


def test_bands_miss_no_pair_at_the_threshold():
    for t in (0.8, 0.85):
        assert (1 - t**minhash.ROWS) ** minhash.band_count(t) <= minhash.MISS


# ---- decontamination


def tokens(t):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t)) if w]


def contaminated(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[k : k + 10])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = tokens(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= owners
        out[d] = (len(w), len(hit), len(found), sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
    return out


def test_contamination_matches_brute_force(spark, odd, none):
    r = random.Random(9)
    plain = lambda n: " ".join(r.choice("the of a red blue green".split()) for _ in range(n))  # noqa: E731  only common words
    items = [(i, prose(r, r.randint(5, 40), 60)) for i in range(30)] + [(100, "the of"), (101, ""), (102, None), (103, "Ünïcode-Wörter 12"), (104, plain(14)), (104, plain(14)), (105, "red red red")]
    docs = []
    for i in range(60):
        t = plain(40) + " " + prose(r, 40, 60)
        for _ in range(r.randint(0, 3)):
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(w) - 1))
            t += " " + " ".join(w[a : a + r.randint(8, 25)]).upper() + "; " + prose(r, 10, 60)
        docs.append((i, t))
    docs += [(1000, None), (1001, ""), (1002, "Ünïcode, wörter? no; Ünïcode wörter 12")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), bench)
    got = {x["doc"]: (x["n_words"], x["n_hit"], x["n_items"], sha256(",".join(x["items"]).encode()).hexdigest()) for x in out.collect()}
    assert got == contaminated(docs, items)
    assert decontaminate.contamination(odd, bench).count() == 18
    hit = next(t for i, t in docs if contaminated([(i, t)], items)[i][1])
    rows = [(None, hit), (None, docs[0][1]), (5, hit), (5, "nothing here"), (5, hit), (None, None)]
    got = [(x["doc"], x["n_hit"]) for x in decontaminate.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()]
    n, first = contaminated([(0, hit)], items)[0][1], contaminated([(0, docs[0][1])], items)[0][1]
    assert Counter(got) == Counter([(None, n), (None, first), (5, n), (5, 0), (5, n), (None, 0)])
    assert decontaminate.contamination(none, bench).count() == 0
    assert {x["n_hit"] for x in decontaminate.contamination(odd, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    """Windows that hold all words of a phrase, against every window of every document."""
    r = random.Random(5)
    docs = [(1, "b x a y c"), (2, "a q q q q b c"), (3, "c b a")] + [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))) for i in range(4, 40)]
    phrases = [(7, ["a", "b", "c"]), (8, ["d", "d", "e"]), (9, ["h"]), (10, ["a", "e", "g", "h"]), (11, ["a", "zz"])]
    frame = spark.createDataFrame(phrases, "phrase_id bigint, terms array<string>")
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"), frame.select(F.explode("terms").alias("term")))
    for span in (3, 5, 9):
        want = {(d, p, k) for d, t in docs for p, terms in phrases for w in [t.split()] for k in range(len(w)) if w[k] in terms and set(terms) <= set(w[k : k + span])}
        assert {(x["doc"], x["phrase_id"], x["start"]) for x in decontaminate.proximity_hits(index, frame, span=span).collect()} == want


# ---- toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_what_edit_distance_does():
    terms = ["idiot", "worthless", "abominable", "scum"]
    m, r = toxicity.Matcher([toxicity.Term(t, False, 1.0) for t in terms]), random.Random(2)
    for _ in range(3000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(w))
            w[k : k + r.randint(0, 1)] = r.choice(["", "x", "i"])
        w = "".join(w)
        best = min(((edits(w, t), t) for t in terms if edits(w, t) <= toxicity.budget(t)), default=None)
        got = m.match(w)
        assert (got is None) == (best is None) and (best is None or got[1] == best[0])


def test_stems_match_any_ending():
    m = toxicity.Matcher([toxicity.Term("lowei", True, 2.0)])
    assert m.match("loweischaft") == (2.0, 0) and m.match("loweschaft") == (2.0, 1) and m.match("schaft") is None


def test_quotation_is_told_from_abuse():
    m = toxicity.Matcher([toxicity.Term("idiot", False, 3.0)])
    plain = toxicity.features("you are an idiot here", m, {})
    assert plain[0] > 0 and plain[4] == 0
    for t in ('they used "the idiot word" once', "he said idiot to me"):
        f = toxicity.features(t, m, {})
        assert f[4] > f[0]
    abuse = ("You’re an idiot and don’t come back", "You're an idiot and don't come back", "a 5\" idiot of 6\" height", "there it is \" and\nyou idiot \" too", "“open and you\nidiot” here", "rock ’n’ idiot")
    for t in abuse:
        f = toxicity.features(t, m, {})
        assert f[0] > 0 and f[4] == 0, t
    for t in ("„idiot“ stood there", "»idiot« stood there", "«idiot» stood there", "‘don’t be an idiot’ it ran", "the “idiot” bit", 'a 5" pipe and "an idiot word"'):
        f = toxicity.features(t, m, {})
        assert f[4] > 2 * f[0], t


def test_windows_are_scored_and_not_looked_up():
    m = toxicity.Matcher([toxicity.Term("idiot", False, 3.0), toxicity.Term("stupid", False, 3.0)])
    odds = lambda t, learned=None: [round(toxicity.quotation(h, learned or {}), 3) for h in toxicity.find_hits(t, m, {})[0]]
    for abuse in ("you are an idiot and nobody calls you", "he wrote that you stupid idiot", "an idiot here"):
        assert max(odds(abuse)) <= 0.5 and toxicity.features(abuse, m, {})[4] == 0.0 and toxicity.features(abuse, m, {})[0] > 1
    for said in ("he wrote that the idiot had left", "she said: \u201cyou are an idiot\u201d and left", "nobody calls him an idiot"):
        assert min(odds(said)) > 0.8
    assert odds("such an idiot", {"such": 1.0})[0] > 0.7 > 0.3 > odds("such an idiot", {"such": -1.0})[0]


def test_window_words_are_held_against_their_hit_words():
    # a word that goes with one hit word alone says nothing; one that is found in rows that are not toxic more than its hits are, does
    counts = [("", "a", 200, 200), ("", "b", 200, 0), ("the", "a", 100, 100), ("le", "b", 100, 0), ("", "c", 100, 50), ("heard", "c", 40, 0), ("hey", "c", 40, 40), ("seldom", "c", 3, 0)]
    odds = toxicity.window_odds(counts)
    assert set(odds) == {"the", "le", "heard", "hey"} and odds["the"] == odds["le"] == 0.0 and odds["heard"] > 0.4 and odds["hey"] < -0.4
    assert toxicity.window_odds([]) == {}



def auc(y, s):
    y, order = np.array(y), np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    for v in set(s):
        at = np.array(s) == v
        ranks[at] = np.mean(np.argsort(order)[at]) + 1
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_held_out_accuracy(spark, kind, odd, none):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        y, t = int(r.random() < 0.3), prose(r, r.randint(10, 80), 2000)
        if kind == "toxicity":
            t = t + r.choice([" vermin ", " scoundrel ", " scoundrl "]) + prose(r, 5) if y else t
        else:
            y, t = 1 - y, t.replace(" ", "%% ").upper() if y else t
        docs.append((i, t))
        labels.append((i, y))
    d, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("quality", F.col("toxic"))
    score = toxicity.score if kind == "toxicity" else quality_knn.score
    out = {x["doc"]: x["score"] for x in score(d, lab.where("doc_id % 5 <> 0")).collect()}
    held = [i for i in range(900) if i % 5 == 0]
    assert auc([labels[i][1] for i in held], [out[i] for i in held]) > 0.95
    assert all(0 <= v <= 1 for v in out.values())
    assert score(odd, lab.where("doc_id % 5 <> 0")).count() == 18 and score(none, lab).count() == 0
    assert {x["score"] < 0.01 for x in score(d, lab.limit(0)).collect()} == {True}


def test_votes_are_exact_neighbours():
    r = np.random.default_rng(1)
    counts, labels = r.random((60, quality_knn.MARKS), dtype=np.float32), r.integers(0, 2, 60)
    space = quality_knn.Space(counts, labels)
    asked = r.random((7, quality_knn.MARKS), dtype=np.float32)
    near = space.project(asked) @ space.points.T
    for i, p in enumerate(space.vote(asked)):
        top = sorted(range(60), key=lambda j: -near[i, j])[: quality_knn.VOTERS]
        w = [max(near[i, j], 0) ** quality_knn.SHARPNESS for j in top]
        assert p == pytest.approx((sum(a * labels[j] for a, j in zip(w, top, strict=True)) + 0.5 * labels.mean()) / (sum(w) + 0.5), rel=1e-4)


def test_quality_tells_wording():
    r, known = random.Random(5), {}
    some = ["".join(r.choice("bcdfghklmnprstv") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(800)]
    text = lambda y: " ".join(r.choice(some[:400] if y else some[400:]) for _ in range(r.randint(30, 90))) + "."
    labels = [i % 2 for i in range(600)]
    counts = np.stack([quality_knn.mark_counts(text(y), known) for y in labels])
    scores = quality_knn.Space(counts[:400], np.array(labels[:400])).vote(counts[400:])
    assert auc(labels[400:], scores) > 0.95
    assert quality_knn._shape("a1" * 20) == "a0" * 20
    a, b = (quality_knn.mark_counts(t, {}) for t in ("one two\nThree 4", "one Three\ntwo 4"))
    start, end, _ = quality_knn.LINES
    assert (a[start:end] != b[start:end]).any()


# ---- quality rules


def stats(t):
    w, t = words(t), t or ""
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark, odd, none):
    r = random.Random(8)
    texts = [prose(r, 30, 6) + "\n" + " ".join(["a b c d e f g h i"] * r.randint(0, 4)) + "\n#* x\n#* x\n\n" + prose(r, 20) for _ in range(30)] + ["a " * 9, "a " * 8, "a " * 7]
    extra = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for df in (odd, extra):
        got = df.select("text", quality_rules.text_stats(F.col("text")).alias("c")).select("text", *[f"c.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]).collect()
        for r in got:
            assert tuple(r)[1:] == stats(r["text"])
    out = quality_rules.judge(odd)
    assert out.count() == 18 and set(odd.columns) - {"qr_kept"} < set(out.columns)
    assert quality_rules.judge(none).count() == 0
    assert out.where("qr_base_failed AND qr_kept").count() == 0
    clash = {"doc": "k0", "score": "g", "kept": "row", "component": "c", "mx_size": "f0_g", "qr_kept": "qr_other"}
    named = quality_rules.judge(odd.withColumnsRenamed(clash))
    assert named.where("k0 = 'd' AND g = 's' AND row = 'k' AND c = 'c' AND f0_g = 'm' AND qr_other = 'q' AND qr_kept IS NOT NULL").count() == 18


def test_outliers_go_and_clean_documents_stay(spark):
    r = random.Random(6)
    rows = []
    for i in range(600):
        t, bad = prose(r, r.randint(40, 200), 3000), i % 10 == 0
        rows.append((i, t.replace(" ", "%%% ") if bad else t, "en", f"s{i % 3}", bad))
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, bad boolean")).collect()
    assert {x["bad"] for x in out if not x["qr_kept"]} == {True} and sum(not x["qr_kept"] for x in out) == 60


def test_repeats_reject_by_themselves(spark):
    r = random.Random(16)
    lines = lambda n: ["".join(r.choice("bcdfghklmnprstv") + r.choice("aeiou") for _ in range(3)) + " " + prose(r, 3, 3000) for _ in range(n)]
    rows = []
    for i in range(400):
        own, bad = lines(20), i % 20 == 0
        if bad:  # half of the lines twice, no window of eight words twice
            own = own[:10] + own[9::-1]
        rows.append((i, "\n".join(own), "en", "s", bad))
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, bad boolean")).collect()
    bad = [x for x in out if x["bad"]]
    assert all(x["qr_n_dup_lines"] == 10 for x in bad) and {x["qr_n_repeat_words"] for x in bad} == {0}
    assert {x["qr_kept"] for x in bad} == {False} and sum(not x["qr_kept"] for x in out if not x["bad"]) == 0
    assert all(share / floor**2 > quality_rules.CHI2_CUT for share, floor in ((0.9, quality_rules.FLOORS[3]), (quality_rules.MAX_REPEAT / 100, quality_rules.FLOORS[4])))


def plain_mcd(x, floors, tries=30):
    """(log determinant, mean, factor) of the lowest of many converged concentration runs over exact subsets."""
    r, h, best = np.random.default_rng(1), int(np.ceil(0.75 * len(x))), (np.inf,)
    for _ in range(tries):
        own = x[r.choice(len(x), 12, replace=False)]
        for _ in range(60):
            mean, cov = own.mean(axis=0), np.cov(own.T, bias=True) + np.diag(np.array(floors) ** 2)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            own = x[np.argsort(d, kind="stable")[:h]]
        mean, factor = own.mean(axis=0), np.linalg.cholesky(np.cov(own.T, bias=True) + np.diag(np.array(floors) ** 2))
        best = min(best, (np.log(np.diag(factor)).sum(), mean, factor), key=lambda b: b[0])
    return best


def test_estimate_has_a_low_determinant_and_distances_are_mahalanobis(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 5)) * np.array([0.3, 0.4, 0.5, 0.9, 0.7]) + r.normal(size=(400, 1))
    x[:60] += np.array([9.0, -6.0, 4.0, 0.0, 0.0])  # a seventh lies elsewhere
    k = np.floor(x * quality_rules.SCALE + 0.5).astype(int)
    rows = spark.createDataFrame([("en", None, *map(int, v)) for v in k], "lang string, source string, k0 bigint, k1 bigint, k2 bigint, k3 bigint, k4 bigint")
    fit = quality_rules.fit_mcd(rows).where("g.level = 0")
    row = fit.first()
    mean, factor = np.array([row[f"m{i}"] for i in range(5)]), np.zeros((5, 5))
    for i in range(5):
        for j in range(i + 1):
            factor[i, j] = row[f"l{i}{j}"]
    got = [v[0] for v in quality_rules._measured(rows.crossJoin(fit)).select("d2").collect()]
    y = k / quality_rules.SCALE
    want = [(v - mean) @ np.linalg.inv(factor @ factor.T) @ (v - mean) for v in y]
    assert np.allclose(got, want)
    low, centre, _ = plain_mcd(y, quality_rules.FLOORS)
    assert row["logdet"] < low + 0.1 and np.allclose(mean, centre, atol=0.15) and row["g"]["source"] is None
    again = quality_rules.fit_mcd(rows.repartition(7)).where("g.level = 0").first()
    assert again == row  # to the last digit, however the rows lie


# ---- licences


def best_run(text, template):
    """(dice, -first word, -words) of the best run, by trying every run of words."""
    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text)) if x]
    grams, own, best = list(zip(w, w[1:], strict=False)), set(map(tuple, (g.split() for g in licenses.template_bigrams(template)))), (0.0, 0, 0)
    for a in range(len(grams)):
        seen = set()
        for z in range(a, min(len(grams), a + 2 * len(own))):
            seen |= {grams[z]} & own
            best = max(best, (2 * len(seen) / (len(own) + z - a + 1), -(a + 1), -(z - a + 2)))
    return best


def test_licence_matches_brute_force(spark, odd, none):
    r = random.Random(1)
    notices = [t for _, t in licenses.TEMPLATES]
    texts = [r.choice(["\n", " "]).join(r.choice(notices).upper().replace(" ", r.choice([" ", "\n"])) if r.random() < 0.4 else prose(r, 12) for _ in range(3)) for _ in range(8)]
    texts += ["Released  under\tthe MIT license", "under the", "All rights are reserved. All rights reserved", *notices[:24]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id bigint, text string")
    for row in licenses.scan(df).collect():
        want = {(k, *b) for k, (_, t) in enumerate(licenses.TEMPLATES) if (b := best_run(row["text"], t))[0] >= licenses.THRESHOLD}
        assert {(m["template"], m["dice"], -m["first_word"], -m["n_words"]) for m in row["ls_matches"]} == want
        assert [m["dice"] for m in row["ls_matches"]] == sorted((m["dice"] for m in row["ls_matches"]), reverse=True)
    assert licenses.scan(odd).count() == 18 and licenses.scan(none).count() == 0
    named = licenses.scan(odd.withColumnsRenamed({"doc": "key", "score": "of", "kept": "row", "component": "matches"}))
    assert named.columns[-1] == "ls_matches" and named.where("key = 'd' AND of = 's' AND row = 'k' AND matches = 'c'").count() == 18


def test_notices_are_found_wherever_they_stand(spark):
    mit = licenses._MIT_GRANT, licenses._MIT_NOTICE, licenses._MIT_WARRANTY
    wrapped = "\n".join(re.findall(r".{1,70}(?: |$)", "MIT License Copyright (c) 2024 Ann Body " + " ".join(mit)))
    r = random.Random(4)
    texts = {
        1: ("some words\nAll rights reserved.\nmore words", "Proprietary"),
        2: ("some words\n" + mit[0], "MIT"),
        3: (prose(r, 300) + "\n" + wrapped + "\n" + prose(r, 300), "MIT"),
        4: (prose(r, 300) + "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n" + "other words " * 60, "BSD"),
        5: (" ".join(re.split(" ", "one two three four five six seven eight nine ten eleven twelve. Released under the MIT License.")), "MIT"),
        6: (prose(r, 200) + "\n" + "\n".join(re.findall(r".{1,60}(?: |$)", licenses._GPL_NOTICE)), "GPL"),
        7: (prose(r, 200), None),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id bigint, text string")
    got = {x["doc_id"]: [m["license"] for m in x["ls_matches"]] for x in licenses.scan(df).collect()}
    for i, (_, name) in texts.items():
        assert got[i][:1] == ([name] if name else [])


def test_licence_sql_agrees_on_long_lines(spark):
    import duckdb

    from corvane.llm import queries

    text = "Released under the MIT License. " * 2_001
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()["ls_matches"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO documents VALUES (1, ?)", [text])
    row = con.sql(queries.ORACLE_SQL["op7_licenses"]).df().iloc[0]
    assert row["n_matches"] == len(got) == 1 and row["license"] == got[0]["license"] == "MIT" and row["first_word"] == got[0]["first_word"] == 1


# ---- token blocks


@given(st.lists(st.integers(0, 49407), max_size=700), st.integers(0, 3))
@settings(max_examples=40, deadline=None)
def test_coder_round_trip(ids, times):
    x = np.array(ids * (times + 1), dtype=np.int64)
    if len(x):
        lanes, coded = token_store.code_ids(x)
        assert (token_store.decode_ids(memoryview(coded), len(x), lanes) == x).all()


def test_coder_gains_from_repetition():
    r = np.random.default_rng(0)
    x = np.tile(r.integers(0, 49408, 500), 400)
    lanes, coded = token_store.code_ids(x)
    assert len(coded) < len(x) * 0.5
    assert (token_store.decode_ids(memoryview(coded), len(x), lanes) == x).all()


def test_damage_is_found():
    data = bytearray(token_store.pack_block([1, None], [2, 1], np.array([5, 2, 2])))
    ids, lengths, back = token_store.unpack_block(bytes(data))
    assert ids == [1, None] and list(lengths) == [2, 1] and list(back) == [5, 2, 2]
    data[-1] ^= 1
    with pytest.raises(ValueError):
        token_store.unpack_block(bytes(data))


@given(st.lists(st.text(alphabet="aZé É’'tmdrelv'sßİΣσ\x1c\x85\xa0 　éñ1२²½!%<|\n\tﬁ你-endoftext>", max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_pieces_encode_as_the_whole_text(texts):
    lengths, ids = piece_encoder().encode(texts)
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
    for k, t in enumerate(texts):
        assert list(ids[at[k] : at[k + 1]]) == fresh_tokenizer().encode(t, add_special_tokens=False).ids


@functools.cache
def piece_encoder():
    return token_store.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))


@functools.cache
def fresh_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_every_character_of_the_alphabet_encodes_as_the_library_does():
    alphabet = [chr(i) for i in range(256)] + list("€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ中Ａé̀Σ\u2028\u3000")
    texts = [a + b + c for a in ("x", "'", "1", " ") for b in alphabet for c in ("", "'s", "7", "'LL z")] + ["'" * 3 + "s'ss'reve'v'rE", "y" * 70 + "'d" + "!" * 40, "ñ" * 24 + " " + "ñ" * 25]
    lengths, ids = piece_encoder().encode(texts)
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
    for k, t in enumerate(texts):
        assert list(ids[at[k] : at[k + 1]]) == fresh_tokenizer().encode(t, add_special_tokens=False).ids, t


def test_added_tokens_encode_as_the_library_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), token_store.PieceEncoder(path)
    texts = ["end <|endoftext|> of", "a<|startoftext|>b<|endoftext|>", "<|ENDOFTEXT|> <|endoftext| >", "é<|endoftext|>你 <|endoftext|>\x1cx", "<|endoftext|>"]
    lengths, ids = encoder.encode(texts)
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
    for k, t in enumerate(texts):
        assert list(ids[at[k] : at[k + 1]]) == plain.encode(t, add_special_tokens=False).ids
    assert 49407 in ids[: at[1]]


def plain_digests(rows, tokenizer):
    """[(doc, start, n_tokens, crc32)] in ascending order of id, nulls first."""
    out, start = [], 0
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_blocks_read_back(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(7)
    rows = [(i * 3, prose(r, r.randint(0, 200))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    blocks = token_store.write_blocks(df, vocabulary_path=path, block_ids=5000)
    assert blocks.count() > 3
    got = [tuple(x) for x in token_store.read_blocks(blocks).orderBy("start").collect()]
    assert got == plain_digests(rows, token_store.PieceEncoder(path).tokenizer)
    assert token_store.read_blocks(token_store.write_blocks(none, vocabulary_path=path)).count() == 0
    out = token_store.read_blocks(token_store.write_blocks(odd, vocabulary_path=path)).orderBy("start").collect()
    assert len(out) == 18 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:], strict=False))


# ---- mixing


def test_targets_by_water_filling(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 500), ("d", 5), (None, 300), ("e", 0)]
    got = {x["source"]: x["target"] for x in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
    names = ["a", "b", "c", "d", "e", None]
    weight, size = dict(zip(names, [5, 2, 1, 5, 2, 1], strict=True)), dict(sizes)
    left, capped = 1.5 * sum(size.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            capped[s] = 2.0 * size[s]
            left -= capped[s]
    want = capped | share
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_mix_comes_near_the_targets(spark, odd, none):
    r = random.Random(2)
    rows = [(i, prose(r, r.randint(1, 60)), r.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((x["doc_id"], x["mx_copies"]) for x in out) == sorted((x["doc_id"], x["mx_copies"]) for x in again)
    taken, target = Counter(), {}
    for x in out:
        assert x["mx_size"] == len(words(x["text"])) and 0 <= x["mx_copies"] <= 2
        taken[x["source"]] += x["mx_copies"] * x["mx_size"]
        target[x["source"]] = x["mx_target"]
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items())
    assert mixing.emit(mixing.mix(df)).count() == sum(x["mx_copies"] for x in out)
    assert mixing.mix(odd).count() == 18 and mixing.mix(none).count() == 0
    assert mixing.emit(mixing.mix(odd)).columns == [c for c in odd.columns if c != "mx_size"]


def test_items_without_an_id_count(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "nothing here")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, item), (7, item), (None, item[4:])], "item_id bigint, text string")
    got = {r["doc"]: (r["n_items"], r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (2, ["7"]), 2: (0, [])}


def test_proximity_of_items(spark, odd, none):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))) for i in range(60)] + [(None, None), (3, "")]
    items = [(i, " ".join(r.choice("abcdefghz") for _ in range(r.randint(1, 6)))) for i in range(5)]
    got = {r["doc"]: (r["n_windows"], r["n_phrases"]) for r in decontaminate.proximity(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), width=4, span=7).collect()}
    phrases = {tuple(w[i : i + 4]) for _, t in items for w in [t.split()] for i in range(max(1, len(w) - 3))}
    want = {}
    for d, t in docs:
        w = (t or "").split()
        found = {(p, i) for p in phrases for i in range(len(w)) if w[i] in p and set(p) <= set(w[i : i + 7])}
        if found:
            want[d] = (len(found), len({p for p, _ in found}))
    assert got == want and len(want) > 10
    assert decontaminate.proximity(odd, spark.createDataFrame(items, "item_id bigint, text string")).count() >= 0
    assert decontaminate.proximity(none, none.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_votes_of_equally_near_rows_go_by_their_order():
    g = np.random.default_rng(3)
    counts = np.zeros((60, quality_knn.MARKS), dtype=np.float32)
    counts[:, :40] = g.random((60, 40))
    counts[10:50] = counts[10]  # forty rows alike
    labels = np.array([1] * 25 + [0] * 35)
    space = quality_knn.Space(counts, labels)
    near = space.project(counts[10:11]) @ space.points.T
    order = np.lexsort((np.arange(60), -near[0]))[: quality_knn.VOTERS]
    w = np.maximum(near[0][order], 0) ** quality_knn.SHARPNESS
    want = ((w * space.labels[order]).sum() + 0.5 * space.base) / (w.sum() + 0.5)
    assert np.allclose(space.vote(counts[10:11]), want) and set(order) <= set(range(10, 50))


def test_licences_named_in_a_line(spark):
    rows = [(1, "// SPDX-License-Identifier: Apache-2.0"), (2, "# SPDX-License-Identifier: GPL-2.0-or-later"), (3, "available under CC-BY-SA 3.0"), (4, "spdx license")]
    got = {r["doc_id"]: [m["license"] for m in r["ls_matches"]][:1] for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["GPL-2.0-or-later"], 3: ["CC-BY-SA-3.0"], 4: []}
