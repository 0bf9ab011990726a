"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse.

`learn_lexicon` finds words and word beginnings (stems) that mark toxic training rows, by the log-likelihood ratio over counts
of documents. The terms form a trie. `Matcher` runs the Levenshtein automata of all terms against the trie at once, as one
lazily determinised automaton whose states are sets of (trie node, edits): a word costs one lookup per character. Each hit has
a context score, a sum over its window: quotation marks around it and words of reporting speak for quotation, words that address
someone for abuse, and every other word for what the training rows show of it. A logistic model over a document's exact,
misspelled and quoted hits, shared out by that score, gives the document's score.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The bound on labelled rows that the lexicon and the model learn from; all terms that pass the tests below are kept.
FIT_ROWS = 20_000
#: A stem is a word's first MIN_STEM to MAX_STEM letters; longer terms are whole words.
MIN_STEM, MAX_STEM, MIN_DOCS, MIN_RATIO, MIN_EVIDENCE = 4, 10, 3, 15.0, 16.0
WINDOW = 4
#: What is known of windows beforehand, as log odds of quotation: marks around the hit, a word of reporting, one that addresses someone.
MARKED, REPORTED, ADDRESSED = 4.0, 2.0, -2.0
#: A window word learned from needs LEAST_SEEN exact hits; its log odds are drawn to 0 as by PULL hits more.
LEAST_SEEN, PULL = 10, 20.0
ADDRESS = frozenset("you your yours yourself you're ur du dich dir dein deine ihr euch euer tu toi ton ta tes vous votre vos tú ti te tus usted ustedes vosotros".split())
REPORTING = frozenset("said says wrote writes called calls quoted quote quotes sagte schrieb nannte zitat zitierte dit écrit appelé cité citation dijo escribió llamó citó cita".split())
#: Marks that open a quotation, and those that end one which the first opened.
PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "\"": "\""}
_MARKS = "\"“”„«»‘’"
_WORD = re.compile(r"[^\W_]+")
FEATURES = 8
_STATES = 200_000


class Term(NamedTuple):
    text: str
    stem: bool
    weight: float


def budget(term: str) -> int:
    """Edits allowed: none below 5 letters, one below 10, then two."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Matcher:
    """Longest-known-word lookup with errors: match(word) -> (weight, edits) of the best term, or None."""

    def __init__(self, terms: list[Term]):
        self.edges: list[dict[str, int]] = [{}]
        self.at: dict[int, list[tuple[int, bool, float]]] = {}  # node -> (edits allowed, stem, weight)
        self.most = [0]
        for t in terms:
            node, k = 0, budget(t.text)
            self.most[0] = max(self.most[0], k)
            for c in t.text:
                nxt = self.edges[node].get(c)
                if nxt is None:
                    nxt = self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    self.most.append(0)
                node = nxt
                self.most[node] = max(self.most[node], k)
            self.at.setdefault(node, []).append((k, t.stem, t.weight))
        self.letters = {c for e in self.edges for c in e}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset[tuple[int, int]], int] = {}
        self.sets: list[frozenset[tuple[int, int]]] = []
        self.moves: list[dict[str, int]] = []
        self.stem_hit: list[tuple[float, int] | None] = []
        self.end_hit: list[tuple[float, int] | None] = []
        self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        stack = list(pairs)
        while stack:  # letters of the term that the word lacks
            node, e = stack.pop()
            if e > self.most[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            stack += [(child, e + 1) for child in self.edges[node].values()]
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hits = [(w, e, stem) for node, e in key for k, stem, w in self.at.get(node, ()) if e <= k]
            rank = lambda h: (-h[1], h[0])  # noqa: E731  fewest edits, then weight
            self.stem_hit.append(max(((w, e) for w, e, s in hits if s), key=rank, default=None))
            self.end_hit.append(max(((w, e) for w, e, s in hits), key=rank, default=None))
        return self.ids[key]

    def match(self, word: str) -> tuple[float, int] | None:
        if len(self.sets) > _STATES:
            self._reset()
        state, found = 0, None
        for c in word:
            c = c if c in self.letters else "\x00"
            nxt = self.moves[state].get(c)
            if nxt is None:
                pairs: set[tuple[int, int]] = set()
                for node, e in self.sets[state]:
                    pairs.add((node, e + 1))  # a letter too many
                    for x, child in self.edges[node].items():
                        pairs.add((child, e + (x != c)))
                nxt = self.moves[state][c] = self._state(pairs)
            state = nxt
            if not self.sets[state]:
                return found
            hit = self.stem_hit[state]
            if hit and (found is None or (-hit[1], hit[0]) > (-found[1], found[0])):
                found = hit
        hit = self.end_hit[state]
        return hit if hit and (found is None or (-hit[1], hit[0]) > (-found[1], found[0])) else found


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Stretches of text between an opening mark and the next mark that ends it, in the same line.

    A mark between letters or digits is an apostrophe, and a straight mark right after a digit, where nothing is open, stands for
    inches. A straight mark opens only before something other than white space. What is not closed in its line is no quotation.
    """
    out, opened, ends = [], -1, ""
    for m in _MARK.finditer(text):
        c, i = m[0], m.start()
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if c == "\n":
            opened = -1
        elif before.isalnum() and after.isalnum():
            continue
        elif opened >= 0 and c in ends:
            out.append((opened, i))
            opened = -1
        elif opened < 0 and c in PAIRS and after and not after.isspace() and not (c == "\"" and before.isdigit()):
            opened, ends = i, PAIRS[c]
    return out


_MARK = re.compile(f"[{_MARKS}\n]")


class Hit(NamedTuple):
    word: str
    weight: float
    edits: int
    marked: bool  # inside quotation marks
    window: list[str]  # the words around it


def find_hits(text: str | None, matcher: Matcher, known: dict[str, tuple[float, int] | None]) -> tuple[list[Hit], int]:
    """The hits of a text, each with its window, and how many words the text has."""
    text = (text or "").lower()
    tokens = _WORD.findall(text)
    hits = []
    for i, t in enumerate(tokens):
        try:
            m = known[t]
        except KeyError:
            m = known[t] = matcher.match(t)
        if m:
            hits.append((i, m, t))
    inside: set[int] = set()
    spans = quoted_spans(text) if hits and any(c in text for c in PAIRS) else []
    if spans:
        starts, wanted = [a for a, _ in spans], {h[0] for h in hits}
        for i, m in enumerate(_WORD.finditer(text)):
            if i in wanted and (k := bisect.bisect_right(starts, m.start()) - 1) >= 0 and m.start() < spans[k][1]:
                inside.add(i)
    return [Hit(t, w, e, i in inside, tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + WINDOW + 1]) for i, (w, e), t in hits], len(tokens)


def quotation(hit: Hit, learned: dict[str, float]) -> float:
    """The chance, from 0 to 1, that a hit is quoted and not meant: 1/2 is where its window says nothing, and that counts as meant."""
    odds = MARKED * hit.marked
    for x in hit.window:
        odds += REPORTED if x in REPORTING else ADDRESSED if x in ADDRESS else learned.get(x, 0.0)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def features(text: str | None, matcher: Matcher, known: dict[str, tuple[float, int] | None], learned: dict[str, float] | None = None) -> list[float]:
    """(abuse: exact sum, misspelled sum, strongest, per 100 words; quotation: sum, strongest; kinds of term; any).

    A hit whose window speaks for quotation counts as quotation by as much as it does, and as abuse by the rest.
    """
    hits, n_words = find_hits(text, matcher, known)
    if not hits:
        return [0.0] * FEATURES
    exact = fuzzy = top = said = said_top = 0.0
    kinds = set()
    for h in hits:
        w = h.weight / (1 + h.edits)
        quoted = max(0.0, 2 * quotation(h, learned or {}) - 1)
        said, said_top = said + w * quoted, max(said_top, w * quoted)
        meant = w * (1 - quoted)
        if quoted < 0.5:
            kinds.add(h.word)
        top = max(top, meant)
        if h.edits:
            fuzzy += meant
        else:
            exact += meant
    rate = (exact + fuzzy) * 100 / max(n_words, 1)
    return [np.log1p(exact), np.log1p(fuzzy), top, np.log1p(rate), np.log1p(said), said_top, np.log1p(len(kinds)), float(exact > 0.5)]


def _marks(text: str) -> set[str]:
    """The distinct words of a text (=word) and their beginnings (word*)."""
    words = set(_WORD.findall(text.lower()))
    return {f"={w}" for w in words} | {f"{w[:k]}*" for w in words for k in range(MIN_STEM, min(MAX_STEM, len(w)) + 1)}


def learn_lexicon(rows: DataFrame) -> list[Term]:
    """rows (text, label, non-null) -> terms; the counts are aggregated on the executors, and the few that pass come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                m = list(_marks(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.string()), pa.array([label] * len(m), pa.int64())], names=["mark", "label"])

    n1, n = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    n1, n0 = n1 or 0, n - (n1 or 0)
    if not n1 or not n0:
        return []
    counts = rows.mapInArrow(run, "mark string, label bigint").groupBy("mark").agg(F.sum("label").alias("d1"), F.count(F.lit(1)).alias("d"))
    a, b = F.col("d1").cast("double"), (F.col("d") - F.col("d1")).cast("double")
    ratio = ((a + 0.5) / (n1 + 1.0)) / ((b + 0.5) / (n0 + 1.0))
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    evidence = F.lit(2.0) * (part(a, F.col("d") * n1 / n) + part(b, F.col("d") * n0 / n))
    good = counts.withColumn("ratio", ratio).withColumn("evidence", evidence).where((F.col("d1") >= MIN_DOCS) & (F.col("ratio") >= MIN_RATIO) & (F.col("evidence") >= MIN_EVIDENCE))
    found = good.collect()
    by = {r["mark"]: (r["d1"], float(np.log(r["ratio"]))) for r in found}
    # the longest beginning that loses no document, or the word itself, and nothing below a term already taken
    stems = {m[:-1]: v for m, v in by.items() if m[-1] == "*"}
    deeper = {s[:-1] for s, v in stems.items() if s[:-1] in stems and v[0] >= 0.95 * stems[s[:-1]][0]}
    terms: list[Term] = []
    for s, (_, weight) in sorted(stems.items(), key=lambda x: (len(x[0]), x[0])):
        if s in deeper or any(t.text == s[: len(t.text)] for t in terms):
            continue
        own = by.get(f"={s}")
        whole = own is not None and own[0] >= 0.95 * stems[s][0]
        terms.append(Term(s, not whole, weight))
    taken = [t.text for t in terms]
    terms += [Term(m[1:], False, v[1]) for m, v in sorted(by.items()) if m[0] == "=" and not any(m[1:].startswith(t) for t in taken)]
    return sorted(terms, key=lambda t: (-t.weight, t.text))


def window_odds(counts: Iterable[tuple[str, str, int, int]]) -> dict[str, float]:
    """(window word, hit word, hits, toxic ones) -> what a window word says for quotation, as log odds.

    A word is held against what the hit words alone would give: how many of its hits stand in rows that are not toxic, and how many
    would if each hit word's did as often as anywhere. So words that only go with a language or a topic say nothing. The empty window
    word counts all hits of a hit word.
    """
    rows = list(counts)
    share = {hit: (n - toxic) / n for word, hit, n, toxic in rows if word == ""}
    total = sum(n for word, _, n, _ in rows if word == "")
    pull = PULL * sum(n - toxic for word, _, n, toxic in rows if word == "") / max(total, 1) + 1.0
    seen: dict[str, list[float]] = {}
    for word, hit, n, toxic in rows:
        if word:
            own = seen.setdefault(word, [0.0, 0.0, 0.0])
            own[0], own[1], own[2] = own[0] + n, own[1] + n - toxic, own[2] + n * share[hit]
    return {w: math.log((clean + pull) / (expected + pull)) for w, (n, clean, expected) in seen.items() if n >= LEAST_SEEN}


def learn_windows(rows: DataFrame, terms: list[Term]) -> dict[str, float]:
    """`window_odds` of rows (text, label): the exact hits are counted on the executors, by window word and hit word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, known = Matcher(terms), {}
        for batch in batches:
            found: list[tuple[str, str, int]] = []
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for h in find_hits(text, matcher, known)[0]:
                    if not h.edits:
                        found += [(x, h.word, label) for x in {"", *h.window} - REPORTING - ADDRESS]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "hit", "label"])

    counts = rows.mapInArrow(run, "word string, hit string, label bigint").groupBy("word", "hit").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
    often = counts.groupBy("word").agg(F.sum("n").alias("all")).where((F.col("all") >= LEAST_SEEN) | (F.col("word") == "")).select("word")
    return window_odds((r["word"], r["hit"], r["n"], r["toxic"]) for r in counts.join(often, "word").collect())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (last: bias) by Newton's method with a ridge."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    pull = np.diag([ridge * len(x)] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + pull
        step = np.linalg.solve(h, z.T @ (p - y) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """(doc, score, predicted) for every row of docs; `labels` holds the rows that may be learned from.

    At most `fit_rows` labels are used, those first by a hash of the id. Null labels or ids there are ignored; repeated ids
    learn once per row. Null and empty texts have no hit and get the model's score for that. Null document ids pass through.
    Without labels of both kinds: score 0. Other columns are not read. Empty table: no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    chosen = labels.select(F.col(label_id_col).alias("doc"), F.col(label_col).cast("long").alias("label")).dropna().orderBy(F.xxhash64("doc"), "doc").limit(fit_rows)
    train = materialize(rows.join(F.broadcast(chosen), "doc").select("text", "label"), "toxicity_train")
    terms, learned = learn_lexicon(train), {}
    if terms:
        learned = learn_windows(train, terms)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher, known = Matcher(terms), {}
            for batch in batches:
                x = [features(t, matcher, known, learned) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("label")], names=["x", "label"])

        # in an order of its own, so that reruns add up alike
        sample = sorted(train.mapInArrow(measure, "x array<double>, label bigint").collect(), key=lambda r: (r["x"], r["label"]))
        weights = logistic(np.array([r["x"] for r in sample]), np.array([r["label"] for r in sample], dtype=float))
    else:
        weights = np.array([0.0] * FEATURES + [-30.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, known = Matcher(terms), {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            x = np.array([features(t, matcher, known, learned) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(p, pa.float64())], names=["doc", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, score double").withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))
