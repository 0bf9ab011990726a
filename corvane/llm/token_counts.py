"""Greedy longest-match word-piece counts without building pieces.

The vocabulary (pieces that start a word, and pieces that go on) becomes one trie with failure links: a node that cannot go on
fails to the node that the rest of its text reaches after the longest pieces have been cut off, and the link carries how many
pieces that cuts. A word is then counted in one pass, without going back. Words with a character that no piece covers count as
one unknown token, as greedy word-piece tokenizers do.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts kept in a worker, and the longest words (in bytes) whose counts are kept; longer ones are counted each time.
CACHE_WORDS, CACHE_BYTES = 500_000, 100


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(starting pieces, continuing pieces) from a sentencepiece model file: those with a word-start mark, and the others."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return sorted({p[1:] for p in pieces if p[0] == "▁" and len(p) > 1}), sorted({p for p in pieces if p[0] != "▁"})


class Automaton:
    """Nodes are numbers; node 0 is the start of a word, node 1 the start of a continuing piece."""

    def __init__(self, starting: list[str], continuing: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, starting), (1, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = self.edges[node].get(c)
                    if nxt is None:
                        nxt = self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    node = nxt
                ends[node] = True
        n = len(self.edges)
        #: Where to go on when a node has no edge for the next character (-1: nowhere), and the pieces that this cuts off.
        self.fail, self.popped = [-1] * n, [0] * n
        queue: deque[tuple[int, int, str]] = deque((r, child, c) for r in (0, 1) for c, child in self.edges[r].items())
        while queue:
            parent, node, c = queue.popleft()
            if ends[node]:
                self.fail[node], self.popped[node] = 1, 1
            else:
                at, cut = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.edges[at]:
                    cut += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.edges[at][c], cut
            queue.extend((node, child, x) for x, child in self.edges[node].items())

    def count(self, word: str) -> int:
        """Pieces of the greedy longest match from the left; -1, an unknown word, if there is none; 0 for an empty word."""
        node, cut = 0, 0
        edges, fail, popped = self.edges, self.fail, self.popped
        for c in word:
            nxt = edges[node].get(c)
            while nxt is None:
                cut += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
                nxt = edges[node].get(c)
            node = nxt
        while node not in (0, 1):  # what is left is cut by the same links
            cut += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return cut


def greedy_count(word: str, starting: set[str], continuing: set[str]) -> int:
    """The plain definition, for tests: cut the longest piece again and again."""
    longest = max(map(len, starting | continuing), default=0) if len(word) > 100 else len(word)
    at, n = 0, 0
    while at < len(word):
        pieces = continuing if at else starting
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in pieces:
                at, n = end, n + 1
                break
        else:
            return -1
    return n


def count_tokens(docs: DataFrame, *, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_words, n_tokens, n_unknown) for every row, over the whole text.

    Words are parted by ASCII white space and may have any length. Null and empty texts: 0.
    Null ids pass through; repeated rows are counted each; other columns are not read. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starting, continuing = vocabulary(vocabulary_path)
        automaton, known = Automaton(starting, continuing), {}
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column("text").to_pylist():
                words = Counter(text.encode("utf-8", "surrogatepass").split()) if text else {}
                tokens = unknown = 0
                if len(known) > CACHE_WORDS:
                    known.clear()
                for raw, times in words.items():
                    n = known.get(raw)
                    if n is None:
                        n = automaton.count(raw.decode("utf-8", "surrogatepass"))
                        if len(raw) <= CACHE_BYTES:
                            known[raw] = n
                    tokens += times * abs(n)
                    unknown += times * (n < 0)
                n_words.append(sum(words.values()))
                n_tokens.append(tokens)
                n_unknown.append(unknown)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_unknown, pa.int64())], names=["doc", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
