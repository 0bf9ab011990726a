"""Token-id output: documents as token ids in independent, checksummed blocks of an adaptive context-mixing range coder.

A block holds whole documents. Its ids are cut into equal lanes that are coded side by side with one shared model, so that every
model and coder step is one numpy operation over all lanes. For each id three predictions are mixed: order 0 (adaptive counts
of all ids), order 1 (the id last seen after this id) and order 2 (the id last seen after this pair). The mixture gives the
predicted ids of order 1 and 2 weights learned from how often they were right at their present confidence, and the rest to
order 0. The model learns after each round of steps, in the encoder and the decoder alike, and starts anew in each block.

Blocks are rows of a table written and committed by Spark, so a lost executor's blocks are written again:
(part, block, n_docs, n_ids, data). `part` follows the order of document ids, `block` counts within it.

data := magic, version, n_docs, n_ids, lanes, crc32 of what follows | document ids, nulls, lengths (deflated) | lane sizes | lanes
"""

from __future__ import annotations

import codecs
import itertools
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

VOCABULARY, END_ID = 49408, 2
BLOCK_IDS, LANES, MIN_STEPS = 1 << 21, 4096, 64
_MAGIC, _VERSION = b"CVTK", 1
_HEAD = struct.Struct("<4sHIIIII")
_UNIT, _TOTAL = 17, 24  # order 0 counts sum to 2^17; one unit of weight is as much, and there are 2^7 of them
_PAIRS = 16


class _Model:
    """Counts, predicted ids and mixing weights; learns from a round of (context, id) columns."""

    def __init__(self, size: int):
        self.size = size
        self.seen = np.zeros(size, dtype=np.int64)
        # id last seen and confidence in one number: id * 4 + confidence
        self.after1, self.after2 = np.zeros(size, dtype=np.int32), np.zeros(1 << _PAIRS, dtype=np.int32)
        self.right = np.ones((16, 2), dtype=np.int64)  # by confidence of both: ids that order 2, or else order 1, got right
        self.tried = np.full(16, 8, dtype=np.int64)
        self._settle()

    def _settle(self) -> None:
        room, total = (1 << _UNIT) - self.size, int(self.seen.sum())
        self.freq = np.ones(self.size, dtype=np.int64)
        if total:
            self.freq += self.seen * room // total
        spare = (1 << _UNIT) - int(self.freq.sum())
        self.freq[: spare % self.size] += 1
        self.freq += spare // self.size
        self.cum = np.concatenate([[0], np.cumsum(self.freq)]).astype(np.int32)
        self.freq = self.freq.astype(np.int32)
        share = self.right * 120 // self.tried[:, None]
        self.w2, self.w1 = share[:, 0].astype(np.int32), share[:, 1].astype(np.int32)
        self.w0 = 128 - self.w1 - self.w2

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(self.size, dtype=np.int32), self.freq)

    @staticmethod
    def pair(older: np.ndarray, newer: np.ndarray) -> np.ndarray:
        return ((older * np.uint32(40503) + newer) * np.uint32(2654435761)) >> np.uint32(32 - _PAIRS)

    def predict(self, older: np.ndarray, newer: np.ndarray) -> tuple[np.ndarray, ...]:
        """Predicted ids of order 1 and 2, the contexts and their confidences. older, newer: uint32."""
        h = self.pair(older, newer)
        one, two = self.after1.take(newer), self.after2.take(h)
        state = ((two & 3) << 2 | one & 3).astype(np.uint8)
        one >>= 2
        two >>= 2
        return one, two, h, state

    def learn(self, newer: np.ndarray, ids: np.ndarray, p1: np.ndarray, p2: np.ndarray, h: np.ndarray, state: np.ndarray) -> None:
        """ids: int32; all arrays flat, in coding order."""
        case = (state << 2 | (p2 == ids).view(np.uint8) << 1 | (p1 == ids).view(np.uint8)).astype(np.intp)
        self.seen += np.bincount(ids, minlength=self.size)
        kept = ids << 2
        self.after1[newer.astype(np.intp)] = kept | _SURER1.take(case)
        self.after2[h.astype(np.intp)] = kept | _SURER2.take(case)
        seen = np.bincount(case, minlength=64).reshape(16, 4)
        self.tried += seen.sum(axis=1)
        self.right[:, 0] += seen[:, 2] + seen[:, 3]
        self.right[:, 1] += seen[:, 1]
        self._settle()


#: The confidence of each order after a case (confidence of order 2, of order 1, hit of order 2, of order 1; two bits each, and one).
_SURER1 = np.array([min((c >> 2 & 3) + 1, 3) if c & 1 else 0 for c in range(64)], dtype=np.int32)
_SURER2 = np.array([min((c >> 4) + 1, 3) if c & 2 else 0 for c in range(64)], dtype=np.int32)


def _interval(model: _Model, sym: np.ndarray, p1: np.ndarray, p2: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and width, out of 2^24, of the ids' shares of the mixture."""
    w1, w2, w0 = model.w1.take(state), model.w2.take(state), model.w0.take(state)
    start = w0 * model.cum.take(sym)
    start += (w1 * (p1 < sym) + w2 * (p2 < sym)) << _UNIT
    width = w0 * model.freq.take(sym)
    width += (w1 * (p1 == sym) + w2 * (p2 == sym)) << _UNIT
    return start, width


def _rounds(steps: int) -> Iterator[tuple[int, int]]:
    at, width = 0, 1
    while at < steps:
        yield at, min(steps, at + width)
        at, width = at + width, min(32, width * 2)


def code_ids(ids: np.ndarray, size: int = VOCABULARY) -> tuple[int, bytes]:
    """(lanes, coded bytes) of ids below `size`."""
    n = len(ids)
    lanes = max(1, min(LANES, n // MIN_STEPS))
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, dtype=np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    context = np.concatenate([np.zeros((2, lanes), dtype=np.uint32), grid.astype(np.uint32)])
    # every step writes at most two words of a lane, mostly less than one: rows are added as lanes reach the last ones
    model, out = _Model(size), np.zeros((steps // 2 + 16, lanes), dtype=np.int32)
    low, span, lane = np.zeros(lanes, dtype=np.int64), np.full(lanes, (1 << 48) - 1, dtype=np.int64), np.arange(lanes)
    flat, at = out.reshape(-1), lane.copy()  # at: where in `flat` each lane writes next
    for a, b in _rounds(steps):
        if at.max() // lanes + 2 * (b - a) + 8 > len(out):
            out = np.concatenate([out, np.zeros((max(len(out) // 2, 2 * (b - a) + 8), lanes), dtype=np.int32)])
            flat = out.reshape(-1)
        told = []
        for c in range(a, b, 8):
            d = min(b, c + 8)
            sym, older, newer = grid[c:d], context[c:d], context[c + 1 : d + 1]
            p1, p2, h, state = model.predict(older, newer)
            told.append((p1, p2, h, state))
            start, width = _interval(model, sym, p1, p2, state)
            for s in range(d - c):
                r = span >> _TOTAL
                low += r * start[s]
                np.multiply(r, width[s], out=span)
                high = low >> 32
                k = np.flatnonzero(high >> 16)
                if len(k):  # carries into the words before
                    flat[at[k] - lanes] += 1
                    low[k] -= 1 << 48
                    high[k] &= 0xFFFF
                flat[at] = high  # lanes that do not move on write here again
                moved = (span < (1 << 32)).astype(np.int64)
                at += moved * lanes
                low -= (high << 32) * moved
                moved <<= 4
                low <<= moved
                span <<= moved
                k = np.flatnonzero(span < (1 << 32))
                while len(k):
                    v = low[k]
                    flat[at[k]] = v >> 32
                    low[k] = (v & 0xFFFFFFFF) << 16
                    at[k] += lanes
                    span[k] <<= 16
                    k = k[span[k] < (1 << 32)]
        p1, p2, h, state = (np.concatenate(x).ravel() for x in zip(*told, strict=True))
        model.learn(context[a + 1 : b + 1].ravel(), grid[a:b].ravel(), p1, p2, h, state)
    for _ in range(3):
        flat[at] = low >> 32
        low = (low & 0xFFFFFFFF) << 16
        at += lanes
    used = at // lanes
    out = out[: used.max()]
    out[np.arange(len(out))[:, None] >= used] = 0  # words that were written ahead
    for row in range(len(out) - 1, 0, -1):  # carries, from the last words back
        out[row - 1] += out[row] >> 16
    words = np.ascontiguousarray((out & 0xFFFF).astype("<u2").T)
    return lanes, used.astype("<u4").tobytes() + words[np.arange(len(out)) < used[:, None]].tobytes()


def decode_ids(coded: memoryview, n: int, lanes: int, size: int = VOCABULARY) -> np.ndarray:
    """The n ids that code_ids was given."""
    steps = -(-n // lanes)
    lengths = np.frombuffer(coded, dtype="<u4", count=lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(coded, dtype="<u2", offset=4 * lanes).astype(np.int32), np.zeros(3, dtype=np.int32)])
    at = np.cumsum(lengths) - lengths
    code = words[at].astype(np.int64) << 32 | words[at + 1].astype(np.int64) << 16 | words[at + 2]
    at += 3
    model, span = _Model(size), np.full(lanes, (1 << 48) - 1, dtype=np.int64)
    context = np.zeros((steps + 2, lanes), dtype=np.uint32)
    for a, b in _rounds(steps):
        slots, cum, freq, told = model.slots(), model.cum, model.freq, []
        for s in range(a, b):
            p1, p2, h, state = model.predict(context[s], context[s + 1])
            told.append((p1, p2, h, state))
            w1, w2, w0 = model.w1.take(state), model.w2.take(state), model.w0.take(state)
            r = span >> _TOTAL
            v = np.minimum(code // r, (1 << _TOTAL) - 1).astype(np.int32)
            lo, hi = np.minimum(p1, p2), np.maximum(p1, p2)
            both = (w1 + w2) << _UNIT
            wl = np.where(p1 < p2, w1, w2) << _UNIT
            np.copyto(wl, both, where=p1 == p2)
            wh = both - wl
            low_at = w0 * cum.take(lo)
            low_size = w0 * freq.take(lo) + wl
            high_at = w0 * cum.take(hi) + wl
            high_size = w0 * freq.take(hi) + wh
            below = v - low_at
            past = v - high_at
            rest = v - (below >= low_size) * wl - (past >= high_size) * wh
            sym = slots.take(np.minimum(rest // w0, (1 << _UNIT) - 1))
            start, width = w0 * cum.take(sym) + (v - rest), w0 * freq.take(sym)
            in_low, in_high = below.view(np.uint32) < low_size.view(np.uint32), past.view(np.uint32) < high_size.view(np.uint32)
            # the low one last: it holds the other's place too where both predict one id
            for mine, put, place, wide in ((in_high, hi, high_at, high_size), (in_low, lo, low_at, low_size)):
                np.copyto(sym, put, where=mine)
                np.copyto(start, place, where=mine)
                np.copyto(width, wide, where=mine)
            context[s + 2] = sym
            code -= r * start
            np.multiply(r, width, out=span)
            moved = (span < (1 << 32)).astype(np.int64)
            ahead = words.take(at, mode="clip") * moved
            at += moved
            moved <<= 4
            code <<= moved
            code |= ahead
            span <<= moved
            k = np.flatnonzero(span < (1 << 32))
            while len(k):
                code[k] = (code[k] << 16) | words[at[k]]
                at[k] += 1
                span[k] <<= 16
                k = k[span[k] < (1 << 32)]
        p1, p2, h, state = (np.concatenate(x) for x in zip(*told, strict=True))
        model.learn(context[a + 1 : b + 1].ravel(), context[a + 2 : b + 2].ravel().view(np.int32), p1, p2, h, state)
    return np.ascontiguousarray(context[2:].T).reshape(-1)[:n].astype(np.int64)


def pack_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    numbers = np.array([x or 0 for x in doc_ids], dtype="<i8")
    index = zlib.compress(np.diff(numbers, prepend=0).astype("<i8").tobytes() + bytes(x is None for x in doc_ids) + np.array(lengths, dtype="<u4").tobytes(), 6)
    lanes, coded = code_ids(ids)
    body = struct.pack("<I", len(index)) + index + coded
    return _HEAD.pack(_MAGIC, _VERSION, len(doc_ids), len(ids), lanes, zlib.crc32(body), len(body)) + body


def unpack_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids); a ValueError says what is damaged."""
    magic, version, n_docs, n_ids, lanes, crc, size = _HEAD.unpack_from(data)
    body = memoryview(data)[_HEAD.size :]
    if magic != _MAGIC or version != _VERSION or len(body) != size:
        raise ValueError("not a token block of this version, or cut short")
    if zlib.crc32(body) != crc:
        raise ValueError("token block: the checksum differs")
    k = struct.unpack_from("<I", body)[0]
    index = zlib.decompress(body[4 : 4 + k])
    numbers = np.cumsum(np.frombuffer(index, dtype="<i8", count=n_docs))
    nulls = index[8 * n_docs : 9 * n_docs]
    lengths = np.frombuffer(index, dtype="<u4", offset=9 * n_docs).astype(np.int64)
    return [None if z else int(x) for x, z in zip(numbers, nulls, strict=True)], lengths, decode_ids(body[4 + k :], n_ids, lanes)


def _foreign(error: UnicodeError) -> tuple[bytes, int]:
    return _FOREIGN_BYTE * (error.end - error.start), error.end


#: A byte that the one-byte alphabet does not use: it stands for every character outside it, one for one.
_FOREIGN_BYTE = b"\x81"
codecs.register_error("corvane_foreign", _foreign)
_SPACE, _LETTER, _DIGIT, _OTHER, _FOREIGN = range(5)


def _byte_tables() -> tuple[bytes, np.ndarray, dict[int, str]]:
    """Lower case, class and byte-level spelling of each character of the one-byte alphabet (cp1252)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    lower, kind, spelt = bytearray(range(256)), np.full(256, _FOREIGN, dtype=np.uint8), {}
    for b in range(1, 256):
        try:
            c = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            continue
        lower[b] = c.lower().encode("cp1252")[0]
        category = unicodedata.category(c)
        space = category == "Zs" or c in "\t\n\x0b\x0c\r"
        kind[b] = _SPACE if space else _LETTER if category[0] == "L" else _DIGIT if category[0] == "N" else _OTHER
        if not space:
            spelt[ord(c)] = "".join(letters[x] for x in c.encode())
    return bytes(lower), kind, spelt


class PieceEncoder:
    """Ids of texts through the tokenizers library's model, a piece at a time.

    The tokenizer file normalises (NFC, lower case), cuts a text into pieces (contractions, runs of letters, single digits, runs
    of other characters; white space is dropped) and codes each piece by itself. Texts are written in one byte a character, and
    numpy cuts whole batches into pieces. A piece of up to KEY bytes is three numbers, which are its exact key in a table of
    SLOTS places; only pieces that are not there go to the library's model. Words with characters outside the alphabet, and
    texts that may hold an added token, go through the whole tokenizer as they are.
    """

    KEY, SLOTS, MOST_IDS = 24, 1 << 20, 1 << 23

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        #: Tokens that the library cuts out of a text before anything else.
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.holds_added = re.compile("|".join(map(re.escape, added)) if added else "(?!)", re.I).search
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a piece
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.lower, self.kind, self.spelt = _byte_tables()
        self.mask = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(self.KEY + 1)], dtype=np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.keys = [np.zeros(self.SLOTS, dtype=np.uint64) for _ in range(3)]
        self.begin, self.size = np.zeros(self.SLOTS, dtype=np.int32), np.zeros(self.SLOTS, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint16)
        self.used = 0

    def _keep(self, fresh: list[int] | np.ndarray) -> int:
        """Append ids to the store; their place."""
        at = self.used
        self.used += len(fresh)
        while self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[at : self.used] = fresh
        return at

    def _code(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of the ids of pieces."""
        spelt = b" ".join(pieces).decode("cp1252").translate(self.spelt)
        ids = np.array(self.model.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, dtype=np.uint16)
        end = np.flatnonzero(self.last[ids]) + 1
        if len(end) != len(pieces) or end[-1] != len(ids):
            raise ValueError("the vocabulary lacks the ends of some pieces")
        return self._keep(ids) + np.concatenate([[0], end[:-1]]), np.diff(end, prepend=0)

    def _pieces(self, data: bytes, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all pieces, and the classes of all bytes."""
        kind = self.kind[raw]
        cut = np.empty(len(raw), dtype=bool)
        cut[0] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == _DIGIT
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(raw))
        i = np.flatnonzero(raw[start] == 39)
        if len(i):  # an apostrophe that starts a piece may take one or two of the letters after it
            at = start[i]
            one, two = raw[np.minimum(at + 1, len(raw) - 1)], raw[np.minimum(at + 2, len(raw) - 1)]
            take = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8)).astype(np.int64)
            take += 2 * (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
            end[i] += take
            i = i[take > 0]
            start[i + 1] += take[take > 0]
        good = (kind[start] != _SPACE) & (start < end)
        return start[good], end[good], kind

    def _outside(self, texts: list[str], offsets: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces outside of words with foreign characters, and those words as pieces of their own: starts, ends, places, sizes."""
        blank = np.flatnonzero(kind == _SPACE)
        words = np.unique(np.searchsorted(blank, np.flatnonzero(kind == _FOREIGN)))
        good = ~np.isin(np.searchsorted(blank, start), words)
        begin = np.concatenate([[0], blank + 1])[words]
        doc = np.searchsorted(offsets, begin, side="right") - 1
        stop = np.append(blank, len(kind))[words]
        found = [texts[d][a:b] for d, a, b in zip(doc.tolist(), (begin - offsets[doc]).tolist(), (stop - offsets[doc]).tolist(), strict=True)]
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(found, add_special_tokens=False)]
        size = np.array(list(map(len, coded)), dtype=np.int64)
        place = self._keep(list(itertools.chain.from_iterable(coded))) + np.cumsum(size) - size
        return start[good], end[good], begin, place, size

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of texts, without an end id."""
        if self.used > self.MOST_IDS:
            self._clear()
        whole = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if t and "<" in t and self.holds_added(t)}
        texts = ["" if t is None or i in whole else t for i, t in enumerate(texts)]
        parts = [t.encode("cp1252", "corvane_foreign") for t in texts]
        sizes = np.array(list(map(len, parts)), dtype=np.int64) + 1
        offsets = np.cumsum(sizes) - sizes
        data = b"\n".join(parts).translate(self.lower) + b"\n"
        start, end, kind = self._pieces(data, np.frombuffer(data, dtype=np.uint8))
        extra = None
        if _FOREIGN_BYTE in data or b"\0" in data:
            start, end, *extra = self._outside(texts, offsets, kind, start, end)
        place, size = self._look_up(data, start, end)
        if extra is not None:
            order = np.argsort(np.concatenate([start, extra[0]]), kind="stable")
            start, place, size = (np.concatenate(x)[order] for x in zip((start, place, size), extra, strict=True))
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids.take(np.repeat(place - total[:-1], size) + np.arange(total[-1]))
        edge = total[np.searchsorted(start, np.append(offsets, len(data)))]
        lengths = np.diff(edge)
        if whole:
            each = np.split(ids, edge[1:-1])
            for i, own in whole.items():
                each[i], lengths[i] = np.array(own, dtype=np.uint16), len(own)
            ids = np.concatenate(each)
        return lengths, ids

    def _look_up(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of the ids of the pieces data[start:end]."""
        padded = data + bytes(self.KEY)
        view = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        size = end - start
        short = np.minimum(size, self.KEY)
        key = [view[start + 8 * k] & self.mask[np.clip(short - 8 * k, 0, 8)] for k in range(3)]
        h = key[0] * np.uint64(0x9E3779B97F4A7C15) ^ key[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ key[2] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        slot = (h >> np.uint64(64 - 20)).astype(np.int64)
        known = (self.keys[0][slot] == key[0]) & (self.keys[1][slot] == key[1]) & (self.keys[2][slot] == key[2]) & (size <= self.KEY)
        place, count = self.begin[slot].astype(np.int64), self.size[slot].astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            _, first, same = np.unique(h[new], return_index=True, return_inverse=True)
            first = new[first]
            alike = (size[new] <= self.KEY) & (size[first][same] <= self.KEY)
            for k in key:
                alike &= k[new] == k[first][same]
            at, n = self._code([data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            place[new], count[new] = at[same], n[same]
            kept = size[first] <= self.KEY
            s = slot[first][kept]
            for table, k in zip(self.keys, key, strict=True):
                table[s] = k[first][kept]
            self.begin[s], self.size[s] = at[kept], n[kept]
            odd = new[~alike]  # long pieces, and any that only share a hash
            if len(odd):
                place[odd], count[odd] = self._code([data[a:b] for a, b in zip(start[odd].tolist(), end[odd].tolist(), strict=True)])
        return place, count


@lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    """One for each Python worker: tasks that run in it one after another share the pieces it knows."""
    return PieceEncoder(path)


def write_blocks(docs: DataFrame, *, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every text (null: empty), append end_id, and write blocks in ascending order of the integer id (null first).

    Repeated rows and ids are documents of their own. Other columns are not read. Empty table: no blocks.
    """
    ordered = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block, doc_ids, lengths, chunks, size = _encoder(vocabulary_path), 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            data = pack_block(doc_ids, lengths, np.concatenate(chunks))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["block", "n_docs", "n_ids", "data"])

        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for i in range(0, len(ids), 512):
                counts, flat = encoder.encode(texts[i : i + 512])
                at = np.concatenate([[0], np.cumsum(counts)])
                for j, doc in enumerate(ids[i : i + 512]):
                    own = np.append(flat[at[j] : at[j + 1]], np.uint16(end_id))
                    if size and size + len(own) > block_ids:
                        yield close()
                        block, doc_ids, lengths, chunks, size = block + 1, [], [], [], 0
                    doc_ids.append(doc)
                    lengths.append(len(own))
                    chunks.append(own)
                    size += len(own)
        if doc_ids:
            yield close()

    blocks = ordered.mapInArrow(run, "block int, n_docs bigint, n_ids bigint, data binary")
    return materialize(blocks.select(F.spark_partition_id().alias("part"), "*"), "token_blocks")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the blocks; checksums are verified."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within")).join(parts, F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("block").alias("b"), (F.col("base") + F.col("within")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, data in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("data"), strict=True):
                doc_ids, lengths, ids = unpack_block(data.as_py())
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                edge = np.concatenate([[0], np.cumsum(lengths)])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(edge[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["part", "block", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = blocks.select("part", "block", "data").mapInArrow(run, "part int, block int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(places, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
