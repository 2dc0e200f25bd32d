"""Benchmark decontamination by pigeonhole edit matching.

An item may differ from a passage by k = RATE * its length edits, rounded down. Of k + 1 pieces that it is split into,
one at least is in the passage unchanged. So every document is searched for exact hits of all pieces, and the text
around a hit, as far as k edits can reach, is compared with the whole item by Myers' bit-parallel edit distance, which
gives the least distance of the item to any part of that text. The result is exact: all pairs within k.

An item that is too short for an edit (k = 0) matches where it stands unchanged between word limits: a neighbouring
letter or digit of a script that writes blanks between words makes it a part of a longer word, which isn't the item.

Text is compared in lower case with ASCII white space, one for one, as blanks. A piece is found by its first 8 bytes,
or by all of a shorter one: the bytes at every offset of the documents are looked up in a bit table, one look for each
length of head that the items need (with items of 8 bytes or more and ``RATE`` that is one). Hits, the text around them and the
distances are arrays; long stretches of overlapping hits are cut into parts that overlap by a match's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import U64, flat, ship, slices, tidied

RATE = 0.05
#: Items are broadcast in parts of about so many bytes of text; all parts are searched in one pass over the documents.
PART_BYTES = 32 << 20
RESULT = "doc_id long, item_id long, distance int"
_BITS = 22
#: Offsets and hits that are worked on at once.
_BLOCK = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = bytes(32 if c in (9, 10, 11, 12, 13, 28, 29, 30, 31) else c for c in range(256))
_UNSPACED = r"฀-໿က-႟ក-៿぀-ヿ㐀-鿿가-힯\U00020000-\U0003ffff"


def normal(text: str) -> str:
    """Lower case, ASCII white space as blanks; one character for each, whatever stands beside it."""
    low = text.replace("İ", "i").lower().replace("ς", "σ")
    return low.encode().translate(_BLANK).decode()


def allowed(n: int, rate: float = RATE) -> int:
    return int(n * rate)


@lru_cache(1 << 14)
def standing(item: str) -> re.Pattern:
    """The item between word limits."""
    word = re.compile(rf"[^\W{_UNSPACED}]")
    return re.compile((rf"(?<![^\W{_UNSPACED}])" if word.match(item[0]) else "") + re.escape(item) + (rf"(?![^\W{_UNSPACED}])" if word.match(item[-1]) else ""))


def myers(item: str, text: str) -> int:
    """The least edit distance of the item to any part of the text: bit-parallel over whole-number words of any length."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return best


def distances(items: list[str], texts: list[str]) -> np.ndarray:
    """``myers`` of each item and text, all at once: one step for a character of all texts, words of 64 bits."""
    m = np.array([len(x) for x in items])
    n = np.array([len(x) for x in texts])
    out = m.copy()
    todo = np.flatnonzero((m > 0) & (n > 0))
    if len(todo) < 24:  # too few for arrays to pay
        for t in todo:
            out[t] = myers(items[t], texts[t])
        return out
    order = todo[np.lexsort((n[todo], -(-m[todo] // 64)))]
    for words in np.unique(-(-m[order] // 64)):
        group = order[-(-m[order] // 64) == words]
        for at in range(0, len(group), 4096):
            part = group[at : at + 4096]
            out[part] = _columns([items[t] for t in part], [texts[t] for t in part], int(words))
    return out


def _columns(items: list[str], texts: list[str], words: int) -> np.ndarray:
    """``myers`` of items of the same number of words."""
    number: dict[str, int] = {}
    which = np.array([number.setdefault(x, len(number)) for x in items])
    m = np.array([len(x) for x in items])
    codes = np.frombuffer("".join(number).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lens = np.array([len(x) for x in number])
    of = np.repeat(np.arange(len(number)), lens)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
    keys, row = np.unique(of << 21 | codes, return_inverse=True)
    peq = np.zeros((len(keys) + 1, words), U64)
    np.bitwise_or.at(peq, (row, place >> 6), U64(1) << (place & 63).astype(U64))
    n = np.array([len(x) for x in texts])
    first = np.cumsum(n) - n
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    want = np.repeat(which, n) << 21 | letters
    row = np.searchsorted(keys, want)
    row = np.where(keys[np.minimum(row, len(keys) - 1)] == want, row, len(keys))

    one, full = U64(1), U64(0xFFFFFFFFFFFFFFFF)
    pv, mv = np.full((words, len(items)), full), np.zeros((words, len(items)), U64)
    last = ((m - 1) & 63).astype(U64)
    score, best = m.copy(), m.copy()
    order = np.argsort(-n, kind="stable")  # the longest first, so that the live ones are a front
    first, last, score, best, ends = first[order], last[order], score[order], best[order], n[order]
    for step in range(int(n.max())):
        k = int(np.searchsorted(-ends, -step, "left"))  # texts longer than step
        eq = peq[row[first[:k] + step]]
        carry_p, carry_m = np.zeros(k, U64), np.zeros(k, U64)
        for w in range(words):
            p, q, e = pv[w, :k], mv[w, :k], eq[:, w]
            xv = e | q
            e = e | carry_m
            xh = (((e & p) + p) ^ p) | e
            ph = q | ~(xh | p)
            mh = p & xh
            if w == words - 1:
                score[:k] += ((ph >> last[:k]) & one).astype(np.int64) - ((mh >> last[:k]) & one).astype(np.int64)
            up, down = ph >> U64(63), mh >> U64(63)
            ph, mh = ph << one | carry_p, mh << one | carry_m
            pv[w, :k] = mh | ~(xv | ph)
            mv[w, :k] = ph & xv
            carry_p, carry_m = up, down
        np.minimum(best[:k], score[:k], out=best[:k])
    out = np.empty(len(items), np.int64)
    out[order] = best
    return out


class Items:
    """Benchmark items with their different pieces, by head, and the table of the heads."""

    def __init__(self, rows: list[tuple[int | None, str]], rate: float = RATE):
        rows = [(i, t) for i, t in rows if t]
        self.ids = [r[0] for r in rows]
        self.text = [normal(r[1]) for r in rows]
        self.size = np.array([len(t.encode()) for t in self.text], np.int64)
        self.chars = np.array([len(t) for t in self.text], np.int64)
        self.budget = np.array([allowed(len(t), rate) for t in self.text], np.int64)
        found: dict[tuple[int, bytes], list[int]] = {}
        for n, t in enumerate(self.text):
            k = int(self.budget[n])
            cuts = [len(t) * i // (k + 1) for i in range(k + 2)]
            before = 0
            for a, b in zip(cuts, cuts[1:]):
                p = t[a:b].encode()
                span = found.setdefault((n, p), [before, before])
                span[1] = before
                before += len(p)
        pieces = [p for _, p in found]
        self.owner = np.array([n for n, _ in found], np.int64)
        self.least, self.most = (np.array([s[x] for s in found.values()], np.int64) for x in (0, 1))
        self.length = np.array([len(p) for p in pieces], np.int64)
        word = lambda x: int.from_bytes(x, "little")
        heads, tails = np.array([word(p[:8]) for p in pieces], U64), np.array([word(p[-8:]) for p in pieces], U64)
        width = np.minimum(self.length, 8)
        self.looks = []  # (bytes of the head, mask, heads in order, their pieces, table)
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            own = own[np.argsort(heads[own], kind="stable")]
            table = np.zeros(1 << _BITS, bool)
            table[self._slot(heads[own])] = True
            self.looks.append((int(w), U64((1 << 8 * int(w)) - 1), heads[own], own, table))
        self.tails = tails

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return ((x * _SPREAD) >> U64(64 - _BITS)).astype(np.int64)

    def _hits(self, padded: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, pieces) of the pieces' heads and tails, a block at a time."""
        words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        for w, mask, heads, own, table in self.looks:
            for lo in range(0, n, 8 * _BLOCK):
                hi = min(n, lo + 8 * _BLOCK)
                at = []
                for r in range(8):
                    x = padded[lo + r : lo + r + (hi - lo + 7) // 8 * 8].view("<u8").astype(U64, copy=False)
                    if w < 8:
                        x = x & mask
                    p = np.flatnonzero(table[self._slot(x)])
                    if len(p):
                        a = np.searchsorted(heads, x[p])
                        at.append(lo + r + 8 * p[heads[np.minimum(a, len(heads) - 1)] == x[p]])
                pos = np.sort(np.concatenate(at)) if at else np.zeros(0, np.int64)
                pos = pos[pos < hi]
                if not len(pos):
                    continue
                here = words[pos].copy().view("<u8").ravel() & mask
                a, b = np.searchsorted(heads, here, "left"), np.searchsorted(heads, here, "right")
                done = np.cumsum(b - a)
                i = 0
                while i < len(pos):
                    j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + _BLOCK, "right")))
                    many = (b - a)[i:j]
                    p = np.repeat(pos[i:j], many)
                    q = own[np.repeat(a[i:j], many) + np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)]
                    fits = p + self.length[q] <= n
                    p, q = p[fits], q[fits]
                    if w == 8:
                        tail = words[p + self.length[q] - 8].copy().view("<u8").ravel()
                        p, q = p[tail == self.tails[q]], q[tail == self.tails[q]]
                    yield p, q
                    i = j

    def search(self, data: np.ndarray, off: np.ndarray, texts: bytes) -> Iterator[tuple[int, int, int]]:
        """(document, item, distance) of all pairs within the budget, for a slice of normal text."""
        n = len(data)
        if not self.ids or not n:
            return
        padded = np.zeros(n + 24, np.uint8)
        padded[:n] = data
        spans: list[tuple[np.ndarray, ...]] = []
        for p, q in self._hits(padded, n):
            doc = np.searchsorted(off, p, "right") - 1
            inside = p + self.length[q] <= off[doc + 1]
            p, q, doc = p[inside], q[inside], doc[inside]
            item = self.owner[q]
            reach = 4 * self.budget[item] + 4  # bytes
            s = np.maximum(off[doc], p - self.most[q] - reach)
            e = np.minimum(off[doc + 1], p - self.least[q] + self.size[item] + reach)
            spans.append(_merged(doc, item, s, e))
        if not spans:
            return
        doc, item, s, e = _merged(*(np.concatenate(c) for c in zip(*spans)))
        if not len(doc):
            return
        pair = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
        pairs = list(zip(pair.tolist(), np.r_[pair[1:], len(doc)].tolist()))
        best = np.full(len(pairs), 1 << 30)
        owner, names, windows = [], [], []
        whole: tuple[int, str] = (-1, "")
        for x, (a, b) in enumerate(pairs):
            d, i = int(doc[a]), int(item[a])
            if not self.budget[i]:
                if whole[0] != d:
                    whole = d, texts[off[d] : off[d + 1]].decode("utf-8", "replace")
                best[x] = 0 if standing(self.text[i]).search(whole[1]) else best[x]
                continue
            parts = [texts[u:v].decode("utf-8", "ignore") for u, v in zip(s[a:b].tolist(), e[a:b].tolist())]
            if any(self.text[i] in t for t in parts):
                best[x] = 0
                continue
            reach = int(self.chars[i] + self.budget[i])  # no match is longer
            for t in parts:
                for at in range(0, max(len(t) - reach, 1), reach + 1):
                    owner.append(x)
                    names.append(self.text[i])
                    windows.append(t[at : at + 2 * reach + 1])
        if owner:
            np.minimum.at(best, np.array(owner), distances(names, windows))
        for x in np.flatnonzero(best <= self.budget[item[pair]]):
            yield int(doc[pair[x]]), int(item[pair[x]]), int(best[x])


def _merged(doc: np.ndarray, item: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping stretches of a document and item made one, in order."""
    order = np.lexsort((s, item, doc))
    doc, item, s, e = doc[order], item[order], s[order], e[order]
    if not len(doc):
        return doc, item, s, e
    pair = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    shift = pair * (int(e.max()) + 1)  # keeps one pair's stretches from the next one's
    far = np.maximum.accumulate(e + shift)
    at = np.flatnonzero(np.r_[True, (s + shift)[1:] > far[:-1]])
    return doc[at], item[at], s[at], (far - shift)[np.r_[at[1:], len(doc)] - 1]


def _flat_normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """A slice in normal form: (bytes, offsets, the same bytes)."""
    raw = data[off[0] : off[-1]].tobytes()
    if raw.isascii():
        out = raw.lower().translate(_BLANK)
        return np.frombuffer(out, np.uint8), off - off[0], out
    low = normal(raw.decode("utf-8", "replace"))
    out = low.encode()
    own = np.frombuffer(out, np.uint8)
    was = data[off[0] : off[-1]]
    if len(own) == len(was) and np.array_equal(own & 0xC0 == 0x80, was & 0xC0 == 0x80):  # every character as long as it was
        return own, off - off[0], out
    parts = [normal(raw[a - off[0] : b - off[0]].decode("utf-8", "replace")).encode() for a, b in zip(off, off[1:])]
    out = b"".join(parts)
    return np.frombuffer(out, np.uint8), np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64), out


def _shared(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, rate: float) -> list:
    """The items in broadcast parts, made on the driver one part at a time. A part's size is set; a larger benchmark
    has more of them, and workers hold one at a time."""
    if not 0 <= rate < 1:
        raise ValueError("the rate must be 0 or more and below 1")
    spark = docs.sparkSession
    ship(spark)
    src = benchmark.select(benchmark[f"`{item_col}`"].cast("long").alias("i"), benchmark[f"`{text_col}`"].cast("string").alias("t")).filter("t <> ''")
    size = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // PART_BYTES))
    parts = (src if n == 1 else src.filter(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == k) for k in range(n))
    return [spark.sparkContext.broadcast(Items([tuple(r) for r in p.collect()], rate)) for p in parts]


def _found(parts: list, column: pa.Array) -> Iterator[tuple[list, int, int, int]]:
    """(ids of the items, row, item, distance) of a batch's texts, part by part; of several parts, one is held at a time."""
    data, off, _ = flat(column)
    for part in parts:
        items = part.value
        for i, j in slices(off):
            own, at, raw = _flat_normal(data, off[i : j + 1])
            for d, item, k in items.search(own, at, raw):
                yield items.ids, i + d, item, k
        if len(parts) > 1:
            part.__dict__.pop("_value", None)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, item_id and distance of every document row and item with an edit distance within the item's budget.

    No shuffle: one pass over id and text, whatever the size of the benchmark. Null or empty texts match nothing, nor do items
    that are null or empty; an item of any other length is searched for. Rows with the same id are searched each by
    itself, as are equal items; a null id is carried along. An empty benchmark or an empty table gives no rows. Other
    columns, whatever their names, aren't read. Texts of any length are searched whole."""
    parts = _shared(docs, benchmark, item_col, item_text_col, rate)
    src = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(row, ids[item], k) for ids, row, item, k in _found(parts, b.column(1))]
            if found:
                rows, items, k = zip(*found)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(items, pa.int64()), pa.array(k, pa.int32())], names=["doc_id", "item_id", "distance"])

    return src.mapInArrow(tidied(run), RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The documents that match no item, with all their columns, decided in the pass that copies them.

    Null and empty texts stay, as do all rows where the benchmark is empty. Each row is decided by its own text, so of
    rows with the same id some may stay, and equal rows stay or go together. Columns are carried along whatever their names and nulls; an
    empty table stays empty."""
    parts = _shared(docs, benchmark, item_col, item_text_col, rate)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for _, row, *_ in _found(parts, b.column(at)):
                keep[row] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(tidied(run), docs.schema)
