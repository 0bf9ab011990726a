"""Web pages as evidence: title and visible text by the standard library's parser, in Arrow batches."""

from __future__ import annotations

import html
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a tag does to the text around it. Content of hidden elements is not shown; those of lines end a line.
HIDDEN = "script style noscript svg"
LINES = "p div article section li br h1 h2"
HIDES, BREAKS, NAMES = 1, 2, 4
EFFECT = dict.fromkeys(HIDDEN.split(), HIDES) | dict.fromkeys(LINES.split(), BREAKS) | {"title": NAMES}


class _Tokens(HTMLParser):
    """The tokens of a page in order: (1, effect of the tag opened), (-1, effect of the tag closed), (0, text)."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, int | str]] = []
        self.feed(page)

    def note(self, side: int, tag: str) -> None:
        effect = EFFECT.get(tag, 0)
        if effect and not (side < 0 and tag == "br"):
            self.found.append((side, effect))

    def handle_starttag(self, tag, attrs):
        self.note(1, tag)

    def handle_endtag(self, tag):
        self.note(-1, tag)

    def handle_data(self, data):
        self.found.append((0, data))


def compact(parts: Iterable[str]) -> str:
    """Parts joined by a space, character references decoded, white space inside lines collapsed, blank lines dropped."""
    lines = (" ".join(x.split()) for x in html.unescape(" ".join(parts)).splitlines())
    return "\n".join(filter(None, lines))


def page_text(page: str | None) -> tuple[str, str]:
    """(title, text) of a page; the title is part of the text too. Text inside hidden elements is left out of both."""
    shown, titles, depth, naming = [], [], 0, False
    for side, what in _Tokens(page or "").found:
        if side == 0:
            shown += [what] * (depth == 0)
            titles += [what] * (depth == 0 and naming)
        elif what == HIDES:
            depth = max(0, depth + side)
        elif what == NAMES:
            naming = side > 0
        else:
            shown.append("\n")
    return compact(titles), compact(shown)


def untrusted(content: Column) -> Column:
    """Content marked as not to be obeyed."""
    return F.concat(F.lit("<UNTRUSTED_WEB_CONTENT>\n"), content, F.lit("\n</UNTRUSTED_WEB_CONTENT>"))


def texts(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, title, text) of every page; null and empty pages have empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [page_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array([b[0] for b in both], pa.string()), pa.array([b[1] for b in both], pa.string())], names=["page", "title", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page"), F.col(html_col).alias("html")).mapInArrow(run, f"page {kind}, title string, text string")
