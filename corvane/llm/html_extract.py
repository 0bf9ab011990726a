"""Main text of web pages: a bidirectional LSTM labels every block of a page in its context.

`blocks_of` cuts a page into leaf blocks with their tag paths. Each block becomes a vector: hashed tags, classes and ids of its
path, hashed words, and a few measures. A small numpy bidirectional LSTM reads all blocks of the page and says which belong to
the article. It is trained here, from pages that `sample_page` and the families of `FAMILIES` make up: many layouts, with and without
telling tag names, whose blocks' labels are known. Nothing is downloaded and no page of the corpus is learned from.
"""

from __future__ import annotations

import html
import itertools
import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 128, 48, 10, 16
DIM = PATH_DIM + WORD_DIM + MEASURES
TRAIN_PAGES, EPOCHS, SEED = 2_400, 10, 7

#: Attributes as the HTML standard's tokenizer reads them: a quote opens a value only right after an equals sign. No part gives
#: back what it took, so any markup is read in linear time. A value without its closing quote takes all that follows.
_VALUE = r"""(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\t\n\f\r >"'][^\t\n\f\r >]*+))?+)?+"""
_NAME = r"(=[^\t\n\f\r />=]*+|[^\t\n\f\r />=]++)"
_ATTRIBUTES = re.sub(r"\((?!\?)", "(?:", f"(?:[\\t\\n\\f\\r /]++|{_NAME}{_VALUE})*+")
#: A comment, another declaration, an end tag without a name, or a tag: (slash, name, attributes, end unless the page ends first).
_TAG = re.compile(rf"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?![a-zA-Z])[^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\t\n\f\r />]*+)({_ATTRIBUTES})(>|\Z))""", re.S)
_ATTR = re.compile(_NAME + _VALUE)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is not text, and those that are read as raw text up to their end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\t\n\f\r />]){_ATTRIBUTES}(?:>|\Z)", re.I) for t in RAW}
HIDDEN_TAGS = RAW | frozenset("template svg math object audio video canvas map select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
}


#: Elements of a path that a block names one by one; those above are summed as the page is read, so a deep page costs no more.
NEAR = 64


class Block(NamedTuple):
    path: tuple[str, ...]  # one entry for each of the NEAR innermost open elements: tag and the words of its class, id and role
    text: str
    link_chars: int
    depth: int
    above: np.ndarray | None  # the sum of all other open elements' vectors


@lru_cache(maxsize=50_000)
def _element(tag: str, attributes: str) -> str:
    words, seen = [tag], set()
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in seen:  # the first of a name counts
            continue
        seen.add(name)
        if name == "style":
            words += ["hidden"] * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in ("hidden", "aria-hidden"):
            words += ["hidden"] * (value.lower() != "false")
        elif name in ("class", "id", "role"):
            words += [w.lower() for w in _PART.findall(html.unescape(value))]
    return " ".join(words)


def blocks_of(page: str | None) -> list[Block]:
    """The blocks with text of a page in order; none for a null or empty page. Broken markup is taken as far as it goes."""
    out: list[Block] = []
    if not page:
        return out
    tags: list[str] = []  # of the open elements
    elements: list[str] = []
    places: dict[str, list[int]] = {}  # where each tag is open
    sums: list[np.ndarray] = []  # of the vectors of the outermost elements
    text: list[str] = []
    links, in_link, hidden, at = 0, False, 0, 0

    def above() -> np.ndarray | None:
        n = len(elements) - NEAR
        while len(sums) < n:
            v = _element_vector(elements[len(sums)])
            sums.append(sums[-1] + v if sums else v)
        return sums[n - 1] if n > 0 else None

    def flush() -> None:
        nonlocal links
        if text:
            words = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if words:
                out.append(Block(tuple(elements[-NEAR:]), words, links, len(elements), above()))
        links = 0

    def nearest(some: set[str]) -> int:
        return max((places[t][-1] for t in some if places.get(t)), default=-1)

    def pop(some: set[str], stop: set[str]) -> None:
        nonlocal hidden
        i = nearest(some)
        if i < 0 or nearest(stop) > i:
            return
        for t in tags[i:]:
            hidden -= t in HIDDEN_TAGS
            places[t].pop()
        del tags[i:], elements[i:], sums[i:]

    def add(piece: str) -> None:
        nonlocal links
        if piece and not hidden:
            text.append(piece)
            links += len(piece) * in_link

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2] or not m[4]:  # no tag, or one that the page's end cuts off
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCK or tag in HIDDEN_TAGS:
                flush()
                pop({tag}, set())
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            in_link = True
        elif tag in RAW:
            flush()
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
        elif tag in BLOCK or tag in HIDDEN_TAGS:
            flush()
            if tag in _CLOSES:
                pop(*_CLOSES[tag])
            elif tag in BLOCK and places.get("p"):
                pop({"p"}, {"button", "td", "th", "caption"})
            if tag not in VOID and not m[3].endswith("/"):
                places.setdefault(tag, []).append(len(tags))
                tags.append(tag)
                elements.append(_element(tag, m[3]))
                hidden += tag in HIDDEN_TAGS
    flush()
    return out


@lru_cache(maxsize=100_000)
def _spot(word: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h % dim, 1.0 if h >> 31 else -1.0


@lru_cache(maxsize=20_000)
def _element_vector(element: str) -> np.ndarray:
    """What an element other than the innermost adds to its path's vector."""
    v = np.zeros(PATH_DIM, dtype=np.float32)
    tag, *names = element.split()
    for word in [f"<{tag}>", *names]:
        i, s = _spot(word, PATH_DIM)
        v[i] += s * (0.8 if word[0] == "<" else 1.0)
    return v


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIM, dtype=np.float32)
    for up, element in enumerate(reversed(path)):
        tag, *names = element.split()
        for word in [f"<{tag}>", *([f"leaf:{tag}"] if not up else []), *names]:
            i, s = _spot(word, PATH_DIM)
            v[i] += s * (1.0 if up == 0 or word[0] != "<" else 0.8)
    return v


def vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), DIM), dtype=np.float32)
    if not blocks:
        return out
    texts = [b.text for b in blocks]
    words = [t.lower().split() for t in texts]
    counts = np.array(list(map(len, words)))
    spots = np.array([zlib.crc32(w) for w in "\n".join(itertools.chain.from_iterable(words)).encode("utf-8", "surrogatepass").split(b"\n")], dtype=np.uint32)
    place = np.repeat(np.arange(len(blocks)) * WORD_DIM, counts) + spots[: counts.sum()] % WORD_DIM
    sums = np.bincount(place, (spots[: counts.sum()] >> 31) * 2.0 - 1.0, len(blocks) * WORD_DIM).reshape(-1, WORD_DIM)
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] = sums / (np.sqrt(np.maximum(counts, 1)) * 2)[:, None]
    sizes = np.array(list(map(len, texts)))
    rows = []
    for i, (b, n, k) in enumerate(zip(blocks, sizes.tolist(), counts.tolist(), strict=True)):
        out[i, :PATH_DIM] = _path_vector(b.path)
        if b.above is not None:
            out[i, :PATH_DIM] += b.above
        t, leaf = b.text, b.path[-1].split(" ", 1)[0] if b.path else ""
        marks = t.count(".") + t.count(",") + t.count(";") + t.count("!") + t.count("?")
        rows.append((
            math.log1p(n) / 6, min(1.0, b.link_chars / max(n, 1)), math.log1p(k) / 4, min(1.0, marks * 10 / max(n, 1)),
            i / len(blocks), leaf[:1] == "h" and leaf[1:].isdigit(), leaf == "p", t[-1:] in ".!?\"”", "©" in t or "@" in t, b.depth / 10,
        ))
    out[:, PATH_DIM + WORD_DIM :] = rows
    return out


# ---- made-up pages -----------------------------------------------------------------------------------------------------------

_GOOD = "content post entry article story text body main postcontent maincontent articlebody".split()
_BAD = {
    "nav": "nav menu navigation navbar topmenu breadcrumb breadcrumbs pagination".split(),
    "header": "header masthead top sitehead branding".split(),
    "footer": "footer bottom legal copyright colophon".split(),
    "side": "sidebar aside widget related recommended trending tags".split(),
    "notice": "notice cookie consent alert popup modal gdpr banner".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion".split(),
    "form": "form login signup newsletter subscribe search contact".split(),
    "comments": "comments comment reply responses discussion respond commentlist".split(),
    "share": "share social sharing follow".split(),
}
_STOCK = {
    "nav": ["Home", "About", "Contact", "News", "Archive", "Login"], "notice": ["We use cookies to improve your experience.", "Accept all", "This site uses cookies."], "ad": ["Advertisement", "Buy now and save", "Sponsored"],
    "form": ["Subscribe to our newsletter", "Your email", "Send", "Search", "Password"], "comments": ["Reply", "says:", "Leave a comment", "3 comments", "Posted by"], "footer": ["© 2024 All rights reserved.", "Privacy policy", "Terms of use"],
    "share": ["Share", "Tweet", "Follow us"], "side": ["Related posts", "Most read", "Tags"], "header": ["Welcome", "The Daily"],
}


def sample_page(r: random.Random) -> tuple[str, list[str]]:
    """(page, texts of its article blocks in order)."""
    parts = ["".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouäéó") for _ in range(r.randint(1, 4))) for _ in range(60)]
    said: list[str] = []

    def words(n: int) -> str:
        return " ".join(r.choice(parts) for _ in range(n))

    def sentence(n: int | None = None) -> str:
        return words(n or r.randint(2, 18)).capitalize() + "."

    odd = r.random()  # some pages hold tables as text, symbols, shouting, or one word again and again

    def prose(n: int) -> str:
        t = " ".join(sentence() for _ in range(n))
        if odd < 0.05:
            return t.replace(" ", " | ")
        if odd < 0.10:
            return " ".join(w + r.choice(["***", "%%%", "$$$", "###", "!!"]) for w in t.split())
        if odd < 0.14:
            return t.upper().replace(" ", "!! ")
        if odd < 0.18:
            return " ".join([r.choice(parts)] * r.randint(5, 60))
        if odd < 0.22:
            return words(r.randint(1, 3)).capitalize() + r.choice([".", ""])
        return t

    telling = r.random() < 0.85  # else class names say nothing

    def attrs(names: list[str]) -> str:
        if not telling or r.random() < 0.15:
            return "" if r.random() < 0.5 else f' class="{r.choice(["a", "b", "c", "wrap", "row", "col", "box", "inner"])}{r.randint(1, 9)}"'
        name = r.choice(names)
        if r.random() < 0.3:
            name = r.choice(["site-", "page-", "block_", "the-"]) + name
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def wrap(tag: str, names: list[str], inner: str) -> str:
        return f"<{tag}{attrs(names)}>{inner}</{tag}>"

    def link(t: str) -> str:
        return f'<a href="/{r.randint(1, 999)}">{t}</a>'

    def label(kind: str) -> str:
        return r.choice(_STOCK.get(kind, ["More"])) if r.random() < 0.4 else words(r.randint(1, 3))

    def chrome(kind: str) -> str:
        names = _BAD[kind]
        if kind == "nav":
            items = "".join(f"<li>{link(label(kind))}" + r.choice(["</li>", "</li>", ""]) for _ in range(r.randint(2, 9)))
            return wrap(r.choice(["nav", "nav", "div", "header"]), names, f"<ul>{items}</ul>")
        if kind == "header":
            return wrap(r.choice(["header", "div"]), names, f"<{(t := r.choice(['div', 'p', 'h2']))}>{label(kind)}</{t}>")
        if kind == "footer":
            return wrap(r.choice(["footer", "footer", "div"]), names, r.choice([label(kind), f"&copy; {words(2)} &middot; {prose(1)}", f"<p>{link(label(kind))} {link(label(kind))}</p><p>{prose(1)}</p>", f"<p>&copy; {prose(r.randint(1, 3))}</p>"]))
        if kind == "side":
            return wrap(r.choice(["aside", "div", "section"]), names, f"<h3>{label(kind)}</h3>" + r.choice(["<ul>" + "".join(f"<li>{link(words(r.randint(2, 7)))}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<p>{prose(r.randint(1, 4))}</p>", f"<p>{prose(1)}</p><p>{prose(2)}</p>"]))
        if kind == "notice":
            return wrap(r.choice(["div", "div", "section", "aside", "dialog"]), names, r.choice([f"<p>{label(kind)}</p><button>{words(1)}</button>", prose(r.randint(1, 3)), f"<p>{prose(2)}</p>"]))
        if kind == "ad":
            return wrap(r.choice(["div", "div", "aside", "section", "p"]), names, r.choice([prose(r.randint(1, 3)), label(kind), link(words(4))]))
        if kind == "form":
            return wrap("form" if r.random() < 0.7 else "div", names, f"<label>{label(kind)}</label><input type=text><button>{label(kind)}</button>" + (f"<p>{prose(1)}</p>" if r.random() < 0.5 else ""))
        if kind == "comments":
            each = "".join(wrap(r.choice(["div", "li", "article"]), ["comment", "reply", "commentbody"], f"<{(t := r.choice(['b', 'div', 'h4']))}>{words(1)}</{t}><p>{prose(r.randint(1, 5))}</p>" + r.choice(["", link("Reply")])) for _ in range(r.randint(1, 5)))
            return wrap(r.choice(["section", "div", "ol"]), names, r.choice([f"<h3>{label(kind)}</h3>", ""]) + each)
        return wrap("div", names, " ".join(link(label(kind)) for _ in range(r.randint(2, 4))))

    def article() -> str:
        def keep(t: str) -> str:
            said.append(t)
            return t

        out = []
        if r.random() < 0.85:
            out.append(f"<h1>{keep(words(r.randint(2, 10)).capitalize() + r.choice(['', '.', '?']))}</h1>")
        for i in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.70:
                t = keep(prose(r.randint(1, 8)) if r.random() < 0.9 else sentence(r.randint(1, 3)))
                out.append(r.choice([f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>"]))
            elif kind < 0.78:
                out.append(f"<h{(k := r.randint(2, 4))}>{keep(words(r.randint(1, 6)).capitalize())}</h{k}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{keep(sentence())}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.90:
                out.append(f"<blockquote><p>{keep(prose(2))}</p></blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{keep(words(2))}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind < 0.97:
                out.append(f"<p>{keep(prose(1) + ' ' + (w := words(2)) + ' ' + (s := sentence()))}</p>".replace(f" {w} {s}", f" {link(w)} {s}"))
            else:
                out.append(chrome(r.choice(["ad", "share", "side"])))
        return "".join(out)

    body, tag = article(), r.choice(["article", "article", "article", "main", "div", "div", "section"])
    if tag == "div" and not telling:
        body = "".join(body)
    main = f"<{tag}{attrs(_GOOD) if tag != 'article' or r.random() < 0.4 else ''}>{body}</{tag}>"
    if r.random() < 0.4:
        main = wrap(r.choice(["main", "div"]), ["main", "content", "container", "page"], main + (chrome("comments") if r.random() < 0.4 else ""))
    before = [chrome(k) for k in r.sample(["nav", "header", "notice", "ad", "form", "share", "side", "nav", "ad"], r.randint(0, 4))]
    after = [chrome(k) for k in r.sample(["footer", "side", "comments", "ad", "form", "share", "notice", "nav", "footer", "comments"], r.randint(0, 4))]
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>", said


class _Maker:
    """Words, sentences and attributes of one made-up page, and the texts of its article so far."""

    def __init__(self, r: random.Random):
        self.r, self.said = r, []
        self.parts = ["".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouäéó") for _ in range(r.randint(1, 4))) for _ in range(60)]
        self.prefix = r.choice(["css-", "sc-", "jsx-", "x", "_", "c"])

    def words(self, least: int, most: int) -> str:
        return " ".join(self.r.choice(self.parts) for _ in range(self.r.randint(least, most)))

    def title(self, least: int = 2, most: int = 9) -> str:
        return self.words(least, most).capitalize()

    def prose(self, least: int, most: int) -> str:
        return " ".join(self.words(4, 20).capitalize() + self.r.choice([".", ".", ".", "!", "?"]) for _ in range(self.r.randint(least, most)))

    def keep(self, text: str) -> str:
        self.said.append(text)
        return text

    def blank(self) -> str:
        """A class name that says nothing."""
        return f' class="{self.prefix}{"".join(self.r.choice("abcdefghkmnpqrtxyz0123456789") for _ in range(self.r.randint(3, 7)))}"'

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randint(1, 9999)}">{text}</a>'

    def links(self, least: int, most: int, tag: str = "li") -> str:
        return "".join(f"<{tag}>{self.link(self.title(1, 6))}</{tag}>" for _ in range(self.r.randint(least, most)))

    def wrapped(self, inner: str, least: int = 0, most: int = 5) -> str:
        for _ in range(self.r.randint(least, most)):
            inner = f"<div{self.blank()}>{inner}</div>"
        return inner

    def page(self, body: str) -> tuple[str, list[str]]:
        return f"<!DOCTYPE html><html><head><title>{self.title()}</title></head><body>{body}</body></html>", self.said


def _plain_divs(m: _Maker) -> str:
    """News built of divs alone, class names that say nothing; lists of other stories with or without a heading; a byline."""
    r = m.r
    p = r.choice(["div", "div", "p"])
    same = m.blank()
    body = [f"<h1{m.blank()}>{m.keep(m.title(3, 12))}</h1>"] if r.random() < 0.9 else []
    for _ in range(r.randint(2, 14)):
        body.append(f"<{p}{same}>{m.keep(m.prose(1, 6))}</{p}>")
        if r.random() < 0.12:
            body.append(f"<h2>{m.keep(m.title(2, 6))}</h2>")
        if r.random() < 0.08:
            body.append(m.wrapped(r.choice([m.link(m.title(3, 9)), "Advertisement", f"<span>{m.words(1, 3)}</span>"]), 1, 2))
    more = lambda: m.wrapped(r.choice(["", f"<h2>{r.choice(['More on this story', 'Related', 'Read more', 'Most read', m.title(1, 4)])}</h2>", f"<div{m.blank()}>{r.choice(['More on this story', 'Top stories'])}</div>"]) + r.choice([f"<ul>{m.links(2, 12)}</ul>", m.links(2, 8, "div")]), 1, 4)
    menu = m.wrapped(m.links(2, 9, r.choice(["div", "span", "li"])), 1, 4)
    foot = m.wrapped(r.choice([m.links(2, 10, "div"), f"<div>&copy; {m.words(1, 4)}</div>", f"<div>{m.prose(1, 2)}</div>" + m.links(1, 4, "span")]), 1, 4)
    return menu + (more() if r.random() < 0.2 else "") + m.wrapped("".join(body), 1, 7) + (more() if r.random() < 0.7 else "") + (foot if r.random() < 0.8 else "")


def _tables(m: _Maker) -> str:
    """A page laid out in tables: a menu cell beside the text, bars above and below."""
    r = m.r
    p = lambda: r.choice(["<p>{}</p>", "<p>{}", "<font size=2>{}</font><hr>", "<div>{}</div>"]).format(m.keep(m.prose(1, 6)))
    menu = r.choice(["<br>".join(m.link(m.title(1, 2)) for _ in range(r.randint(2, 9))), " | ".join(m.link(m.title(1, 2)) for _ in range(r.randint(2, 6))), f"<ul>{m.links(2, 8)}</ul>", " ".join(m.link(m.title(1, 1)) for _ in range(r.randint(2, 3)))])
    top = f"<tr><td colspan=2>{r.choice([m.title(1, 3), m.link(m.title(1, 3)), f'<h2>{m.title(1, 3)}</h2>'])}</td></tr>" if r.random() < 0.6 else ""
    head = f"<{(t := r.choice(['h1', 'h2', 'h3']))}>{m.keep(m.title())}</{t}>" if r.random() < 0.8 else ""
    text = head + "".join(p() for _ in range(r.randint(2, 9)))
    cells = [f"<td width=150>{menu}</td>", f"<td>{text}</td>"]
    if r.random() < 0.3:
        cells.append(f"<td>{m.links(2, 6, 'p')}</td>")
    foot = f"<tr><td colspan=2>{r.choice([f'&copy; {m.words(1, 4)}', m.link(m.title(1, 2)) + ' ' + m.link(m.title(1, 2)), f'Last updated {m.words(1, 3)}', m.prose(1, 1)])}</td></tr>" if r.random() < 0.7 else ""
    return r.choice(["<center>", "", "<div>"]) + f"<table>{top}<tr>{''.join(cells)}</tr>{foot}</table>"


def _encyclopaedia(m: _Maker) -> str:
    """A reference page: a contents list, a box of facts, sections, lists of sources, lines on the page itself."""
    r = m.r
    names = (lambda n: f' id="{n}"' if r.random() < 0.5 else f' class="{n}"') if r.random() < 0.6 else (lambda n: m.blank())
    heads = [m.title(1, 4) for _ in range(r.randint(1, 7))]
    box = f"<table{names('infobox')}>" + "".join(f"<tr><th>{m.title(1, 2)}:</th><td>{m.title(1, 3)}</td></tr>" for _ in range(r.randint(2, 9))) + "</table>"
    toc = f"<div{names('toc')}>{r.choice(['<h2>Contents</h2>', '<div>Contents</div>', ''])}<ul>" + "".join(f"<li>{m.link(f'{i + 1} {h}')}</li>" for i, h in enumerate(heads)) + "</ul></div>"
    lead = "".join(f"<p>{m.keep(m.prose(1, 6))}</p>" for _ in range(r.randint(1, 3)))
    top = f"<h1>{m.said.insert(0, t := m.title(1, 5)) or t}</h1>"
    body = ""
    for h in heads:
        body += f"<h2>{m.keep(h)}</h2>" + "".join(f"<p>{m.keep(m.prose(1, 6))}</p>" for _ in range(r.randint(1, 4)))
        if r.random() < 0.25:
            body += "<ul>" + "".join(f"<li>{m.keep(m.prose(1, 1))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
    site = f"<div{names('sitenav')}><ul>{m.links(3, 14)}</ul></div>"
    last = r.choice([f"This page was last edited on {m.words(2, 4)}.", f"Last modified: {m.words(1, 3)}", f"Text is available under {m.words(2, 6)}; additional terms may apply."])
    foot = f"<div{names('footer')}><ul><li>{last}</li>{m.links(1, 6)}</ul></div>" if r.random() < 0.7 else f"<div{names('footer')}><p>{last}</p></div>"
    cats = f"<div{names('catlinks')}>{m.link('Categories')}: <ul>{m.links(1, 6)}</ul></div>" if r.random() < 0.5 else ""
    parts = [box if r.random() < 0.7 else "", lead, toc if r.random() < 0.8 else "", body]
    return (site if r.random() < 0.5 else "") + f"<div{names('content')}>{top}{''.join(parts)}</div>" + cats + (site if r.random() < 0.5 else "") + foot


def _portal(m: _Maker) -> str:
    """A magazine page: cards of other stories around, byline and date above, tags and an author's box below the text."""
    r = m.r
    cards = lambda: "<section" + m.blank() + ">" + r.choice(["", f"<h2>{r.choice(['Trending', 'You may also like', m.title(1, 3)])}</h2>"]) + "".join(f"<div{m.blank()}>{m.link(f'<h3>{m.title(3, 9)}</h3>')}" + r.choice(["", f"<p>{m.prose(1, 1)}</p>"]) + "</div>" for _ in range(r.randint(2, 7))) + "</section>"
    head = f"<h1>{m.keep(m.title(3, 12))}</h1>"
    by = f"<div{m.blank()}>{r.choice(['By ', 'Von ', ''])}{m.link(m.title(2, 2))}</div><time>{r.randint(1, 28)} {m.words(1, 1)} 20{r.randint(10, 25)}</time>" if r.random() < 0.7 else ""
    body = ""
    for _ in range(r.randint(3, 16)):
        body += f"<p>{m.keep(m.prose(1, 5))}</p>"
        kind = r.random()
        if kind < 0.07:
            body += f"<h2>{m.keep(m.title(2, 6))}</h2>"
        elif kind < 0.12:
            body += f"<blockquote>{m.keep(m.prose(1, 2))}</blockquote>"
        elif kind < 0.20:
            body += r.choice(["<figure><img src=x></figure>", f"<div{m.blank()}>{m.link(m.title(4, 9))}</div>"])
    tags = f"<footer>{r.choice(['Tags: ', 'Filed under: ', ''])}{', '.join(m.link(m.words(1, 2)) for _ in range(r.randint(1, 6)))}</footer>" if r.random() < 0.6 else ""
    author = f"<div{m.blank()}><h4>{m.title(2, 2)}</h4><p>{m.prose(1, 2)}</p>{m.link('More from ' + m.title(1, 2))}</div>" if r.random() < 0.3 else ""
    bar = f"<header><nav><ul>{m.links(3, 10)}</ul></nav></header>" if r.random() < 0.7 else m.wrapped(m.links(3, 9, "span"), 1, 3)
    foot = f"<footer><ul>{m.links(2, 9)}</ul><p>{r.choice(['&copy; ' + m.words(2, 4), m.prose(1, 2)])}</p></footer>"
    tag = r.choice(["article", "div", "main"])
    return bar + (cards() if r.random() < 0.3 else "") + m.wrapped(f"<{tag}>{head}{by}{body}{tags}</{tag}>", 0, 4) + author + (cards() if r.random() < 0.7 else "") + foot


#: Families of layouts besides the plain one of `sample_page`; those trained on, each time with FAMILY_SHARE of the pages.
FAMILIES = {"plain divs": _plain_divs, "tables": _tables, "encyclopaedia": _encyclopaedia, "portal": _portal}
TRAINED_ON, FAMILY_SHARE = ("plain divs", *FAMILIES), 0.1


def family_page(name: str, r: random.Random) -> tuple[str, list[str]]:
    m = _Maker(r)
    return m.page(FAMILIES[name](m))


# ---- the labeller ------------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = SEED):
        g, k = np.random.default_rng(seed), 1 / np.sqrt(DIM)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p |= {f"wx{d}": g.normal(0, k, (DIM, 4 * HIDDEN)), f"wh{d}": g.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"b{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
        self.p |= {"wo": g.normal(0, 0.2, 2 * HIDDEN), "wd": np.zeros(DIM), "bo": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """x: pages, steps, DIM (already turned round for the backward pass)."""
        n, steps, _ = x.shape
        pre = x @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32)
        hs, tape = np.zeros((n, steps, HIDDEN), dtype=np.float32), []
        for t in range(steps):
            z = pre[:, t] + h @ self.p[f"wh{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = np.split(gates, 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            tape.append((h, c, i, f, o, g, tc, m))
            c, h = m * c2 + (1 - m) * c, m * (o * tc) + (1 - m) * h
            hs[:, t] = h
        return hs, tape

    @staticmethod
    def _turn(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each page's steps back to front; the padding stays behind."""
        at = np.arange(x.shape[1])[None, :]
        order = np.where(at < sizes[:, None], sizes[:, None] - 1 - at, at)
        return np.take_along_axis(x, order[:, :, None], axis=1)

    def _forward(self, x: np.ndarray, sizes: np.ndarray) -> tuple:
        mask = (np.arange(x.shape[1])[None, :] < sizes[:, None]).astype(np.float32)
        back = self._turn(x, sizes)
        hf, tf = self._run(x, mask, "f")
        hb, tb = self._run(back, mask, "b")
        both = np.concatenate([hf, self._turn(hb, sizes)], axis=2)
        return _sigmoid(both @ self.p["wo"] + x @ self.p["wd"] + self.p["bo"]), both, mask, back, tf, tb

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page its blocks' chances to be article text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            some = order[at : at + 64]
            while len(some) > 1 and len(some) * len(pages[some[-1]]) > 20_000:
                some = some[: len(some) // 2]
            at += len(some)
            x, sizes = _padded([pages[i] for i in some])
            y = self._forward(x, sizes)[0]
            for row, i in enumerate(some):
                out[i] = y[row, : sizes[row]]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, batch: int = 32, seed: int = SEED) -> Labeller:
        g, moments = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        by_length, step = np.argsort([len(p) for p in pages], kind="stable"), 0
        for epoch in range(epochs):
            groups = [by_length[i : i + batch] for i in range(0, len(pages), batch)]
            for k in g.permutation(len(groups)):
                x, sizes = _padded([pages[i] for i in groups[k]])
                y = np.zeros(x.shape[:2], dtype=np.float32)
                for row, i in enumerate(groups[k]):
                    y[row, : sizes[row]] = labels[i]
                grads = self._gradients(x, sizes, y)
                step += 1
                lr = rate * (1 - epoch / epochs) + rate * 0.05
                for name, grad in grads.items():
                    m, v = moments[name]
                    m += 0.1 * (np.clip(grad, -1, 1) - m)
                    v += 0.01 * (np.clip(grad, -1, 1) ** 2 - v)
                    self.p[name] -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def _gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, both, mask, back, tf, tb = self._forward(x, sizes)
        e = (p - y) * mask / mask.sum()
        grads = {"wo": np.einsum("ns,nsh->h", e, both), "wd": x.reshape(-1, DIM).T @ e.reshape(-1) + 1e-4 * self.p["wd"], "bo": np.array([e.sum()])}
        dh_all = e[:, :, None] * self.p["wo"]
        for d, tape, seq, dh_seq in (("f", tf, x, dh_all[:, :, :HIDDEN]), ("b", tb, back, self._turn(dh_all[:, :, HIDDEN:], sizes))):
            dh, dc = np.zeros_like(tape[0][0]), np.zeros_like(tape[0][0])
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            gh = np.zeros_like(self.p[f"wh{d}"])
            for t in range(x.shape[1] - 1, -1, -1):
                h, c, i, f, o, g, tc, m = tape[t]
                dh = dh + dh_seq[:, t]
                do, dct = dh * m * tc, dc * m + dh * m * o * (1 - tc * tc)
                dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                dz_all[:, t] = dz
                gh += h.T @ dz
                dh, dc = dh * (1 - m) + dz @ self.p[f"wh{d}"].T, dc * (1 - m) + dct * f
            grads |= {f"wx{d}": seq.reshape(-1, DIM).T @ dz_all.reshape(-1, 4 * HIDDEN), f"wh{d}": gh, f"b{d}": dz_all.sum(axis=(0, 1))}
        return grads


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), sizes.max(), DIM), dtype=np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
    return x, sizes


def labelled_pages(n: int, seed: int, families: tuple[str, ...] = ()) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Vectors and labels of n made-up pages: of each family FAMILY_SHARE, the others of `sample_page`."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(n):
        k = int(r.random() / FAMILY_SHARE)
        page, said = family_page(families[k], r) if k < len(families) else sample_page(r)
        blocks, at, y = blocks_of(page), 0, []
        for b in blocks:
            hit = at < len(said) and b.text == said[at]
            at += hit
            y.append(float(hit))
        if at == len(said):
            xs.append(vectors(blocks))
            ys.append(np.array(y, dtype=np.float32))
    return xs, ys


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    return Labeller(seed).fit(*labelled_pages(pages, seed, TRAINED_ON), epochs=epochs)


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", labeller: Labeller | None = None, threshold: float = 0.5) -> DataFrame:
    """All columns of pages but html_col, and he_text (blocks labelled article, joined by a line feed), he_blocks, he_kept (counts).

    Null and empty pages, and pages without an article block: empty text. Null ids and repeated rows pass through. Broken
    markup is read as the HTML standard's tokenizer reads it, pages of any length whole. Columns may have any names: only columns
    he_text, he_blocks and he_kept of pages are replaced. Empty table: no rows.
    """
    model = labeller or trained()
    kept = [c for c in pages.columns if c not in (html_col, "he_text", "he_blocks", "he_kept")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{html_col}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                blocks = [blocks_of(h) for h in part.column("html").to_pylist()]
                chosen = [[b.text for b, p in zip(bs, ps, strict=True) if p >= threshold] for bs, ps in zip(blocks, model.probabilities([vectors(b) for b in blocks]), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(["\n".join(c) for c in chosen], pa.string()), pa.array(map(len, blocks), pa.int32()), pa.array(map(len, chosen), pa.int32())], names=["row", "he_text", "he_blocks", "he_kept"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, he_text string, he_blocks int, he_kept int").select("row.*", "he_text", "he_blocks", "he_kept")
