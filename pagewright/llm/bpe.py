"""Byte-pair encoding by speculation and verification, and decoding.

A text is cut into words by the vocabulary's pattern. For each distinct word of a slice of documents

1. greedy longest match proposes tokens,
2. every pair of neighbouring tokens, of all words at once, is checked for compatibility: whether merging by rank
   would itself leave a boundary between the two. The check unwinds the last merges on either side of the boundary
   and looks for a merge across it that would have come first; it runs over arrays, one step for all pairs,
3. words with an incompatible pair, and only those, are merged exactly, by rank, with a heap.

A sequence of tokens whose neighbours are all compatible is the encoding that merging by rank gives, so the result
is exact. Words that a worker has seen keep their tokens in a table, which is emptied at ``CACHE`` words or
``CACHE_BYTES`` bytes. A word is looked up there by a 64-bit hash and known by its bytes, which are compared; words whose hash is
another word's are encoded by themselves.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .buffers import BYTE, as_array, flat, gather, mix, powers, ship, slices, string_array, tidied

#: What the cutting below follows, as a regular expression.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CACHE = 400_000
CACHE_BYTES = 32 << 20
SLOTS = 1 << 20
NEVER = np.int32(1 << 30)
RESULT = "doc_id long, n_tokens int, token_ids array<int>"
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    kind = {"L": 1, "N": 2}
    to = np.array([kind.get(unicodedata.category(chr(c))[0], 3) for c in range(0x110000)], np.uint8)
    to[_SPACES] = 0
    return to


def cut(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words start, among code points; ``first`` marks the first of each document."""
    kind = classes()[codes]
    n = len(codes)
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    e = np.flatnonzero((kind[1:] != 0) & (kind[:-1] == 0) & ~first[1:]) + 1  # a word after white space
    starts[e - 1] = True
    starts[e] = codes[e - 1] != 32  # takes one space with it
    q = np.flatnonzero(codes == 39)
    q = q[(q + 1 < n) & starts[q]]
    q = q[(kind[q + 1] == 1) & ~first[q + 1]]
    if len(q):
        x = codes[q + 1]
        y = np.where(q + 2 < n, codes[np.minimum(q + 2, n - 1)], 0)
        y[(q + 2 < n) & first[np.minimum(q + 2, n - 1)]] = 0
        one = np.isin(x, [ord(c) for c in "sdmt"])
        two = ~one & (((x == 108) & (y == 108)) | ((x == 118) & (y == 101)) | ((x == 114) & (y == 101)))
        for which, k in ((one, 2), (two, 3)):
            starts[q[which] + 1] = False
            after = q[which] + k
            starts[after[after < n]] = True
    return starts


class Table:
    """64-bit keys to 32-bit values by open addressing, for whole arrays at once."""

    def __init__(self, slots: int):
        self.bits = np.uint64(64 - slots.bit_length() + 1)
        self.mask = slots - 1
        self.keys, self.values = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for keys that aren't there."""
        at = self._home(keys)
        out = self.values[at]
        live = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[live]
        while len(live):
            at = (at + 1) & self.mask
            v = self.values[at]
            out[live] = v
            more = (v >= 0) & (self.keys[at] != keys[live])
            live, at = live[more], at[more]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are distinct and new."""
        at = self._home(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.values[at] < 0
            # of those that want the same slot, one gets it
            _, one = np.unique(np.where(free, at, -1), return_index=True)
            one = one[free[one]]
            self.keys[at[one]], self.values[at[one]] = keys[todo[one]], values[todo[one]]
            rest = np.ones(len(todo), bool)
            rest[one] = False
            taken = self.values[at] >= 0
            todo, at = todo[rest], np.where(taken, (at + 1) & self.mask, at)[rest]


class Bpe:
    """A vocabulary of byte strings with ranks, the tables of its merges, and the words seen so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        n = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * n
        for t, r in ranks.items():
            self.tokens[r] = t
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.at = np.r_[0, np.cumsum(self.lengths)]
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        keys, made = [], []
        for r, t in enumerate(self.tokens):
            if len(t) > 1:
                parts = self.merge(t, r)
                if len(parts) == 2:
                    self.left[r], self.right[r] = parts
                for k in range(1, len(t)):
                    if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                        keys.append(a << 32 | b)
                        made.append(r)
        self.pairs = Table(1 << max(16, (4 * len(keys)).bit_length()))
        self.pairs.put(np.array(keys, np.uint64), np.array(made, np.int32))
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.clear()

    def clear(self) -> None:
        self.seen = Table(SLOTS)
        self.n_words = 0
        self.counts, self.firsts, self.all = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.spell, self.starts = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # the bytes of the words

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, or NEVER."""
        r = self.pairs.get(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
        return np.where(r < 0, NEVER, r)

    def merge(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact merging by rank, the leftmost of equal ranks first; only by ranks under ``below``, if given."""
        ranks = self.ranks
        limit = len(self.tokens) if below is None else below
        n = len(word)
        end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], limit)) < limit]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, e = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or end[nxt[i]] != e:
                continue
            j = nxt[i]
            alive[j] = False
            end[i], nxt[i] = end[j], nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (q := ranks.get(word[i : end[nxt[i]]], limit)) < limit:
                    heapq.heappush(heap, (q, i, end[nxt[i]]))
            if prev[i] >= 0 and (q := ranks.get(word[prev[i] : end[i]], limit)) < limit:
                heapq.heappush(heap, (q, prev[i], end[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = nxt[i]
        return out

    def merge_all(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many words at once: each step merges one pair, the best, of every unfinished word."""
        if not words:
            return []
        lens = np.array([len(w) for w in words])
        width = int(lens.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        tok = self.byte_ids[raw]
        cols = np.arange(width)
        tok = np.where(cols < lens[:, None], tok, -1).ravel()
        nxt = np.where(cols + 1 < lens[:, None], cols + 1, -1).astype(np.int32).ravel()
        prv = np.broadcast_to(cols - 1, (len(words), width)).astype(np.int32).ravel()
        rank = np.full((len(words), width), NEVER, np.int32)
        if width > 1:
            t = tok.reshape(-1, width)
            has = cols[1:] < lens[:, None]
            r = rank[:, :-1]
            r[has] = self.joined(t[:, :-1][has], t[:, 1:][has])
        live = np.arange(len(words))
        flat_rank = rank.ravel()
        while len(live):
            at = np.argmin(rank[live], axis=1)
            i = live * width + at
            good = flat_rank[i] < NEVER
            live, i = live[good], i[good]
            if not len(live):
                break
            base = live * width
            j = base + nxt[i]
            tok[i] = flat_rank[i]
            tok[j] = -1
            flat_rank[j] = NEVER
            after = nxt[j]
            nxt[i] = after
            has = after >= 0
            k = base[has] + after[has]
            prv[k] = (i - base)[has]
            flat_rank[i] = NEVER
            flat_rank[i[has]] = self.joined(tok[i[has]], tok[k])
            before = prv[i]
            has = before >= 0
            k = base[has] + before[has]
            flat_rank[k] = self.joined(tok[k], tok[i[has]])
        tok = tok.reshape(-1, width)
        return [row[row >= 0] for row in tok]

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from the left (every single byte is a token): (tokens of all words, how many each has)."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.uint16)
        bounds = np.cumsum(lens + 1)
        raw[bounds - 1] = 256  # in no token, so that no match crosses it
        text = raw.tobytes().decode("utf-16-le")
        tokens = np.array([t for _, t in self.automaton.iter_long(text)], np.int64)
        bounds -= np.arange(1, len(words) + 1)
        ends = np.cumsum(self.lengths[tokens])
        return tokens, np.bincount(np.searchsorted(bounds, ends, "left"), minlength=len(words))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair whether merging its bytes by rank gives just the two tokens."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40, np.int64)
        while len(live):
            made = self.joined(a, b)
            bad = (made < NEVER) & (made < limit)
            ok[live[bad]] = False
            go = ~bad
            live, a, b, limit = live[go], a[go], b[go], limit[go]
            # undo the later of the two merges; where that one is a byte, the other
            la, lb = self.right[a], self.left[b]
            a_done, b_done = la == a, lb == b
            undo_a = np.where(a > b, ~a_done, b_done & ~a_done)
            undo_b = ~undo_a & ~b_done
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, la, a), np.where(undo_b, lb, b)
            go = undo_a | undo_b
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, how many each has)."""
        tokens, counts = self.greedy(words)
        if len(tokens) < 2:
            return tokens.astype(np.int32), counts
        word = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(tokens[inner] << 32 | tokens[inner + 1], return_inverse=True)
        bad = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        failing = np.unique(word[inner[bad]])
        if not len(failing):
            return tokens.astype(np.int32), counts
        lens = np.array([len(words[w]) for w in failing])
        exact: dict[int, np.ndarray] = {}
        for lo, hi in ((0, 12), (12, 20), (20, 40)):  # alike in length, so that little is padding
            group = failing[(lens > lo) & (lens <= hi)]
            exact.update(zip(group.tolist(), self.merge_all([words[w] for w in group])))
        for w in failing[lens > 40]:
            exact[int(w)] = np.array(self.merge(words[w]), np.int32)
        fails = np.zeros(len(words), bool)
        fails[failing] = True
        kept = tokens[~fails[word]].astype(np.int32)
        counts = counts.copy()
        counts[failing] = [len(exact[int(w)]) for w in failing]
        out = np.empty(int(counts.sum()), np.int32)
        mine = np.repeat(fails, counts)
        out[~mine] = kept
        out[mine] = np.concatenate([exact[int(w)] for w in failing])
        return out, counts

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all documents of UTF-8 text, how many each has)."""
        n = len(off) - 1
        whole = data[off[0] : off[-1]]
        if not len(whole):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        codes = np.frombuffer(whole.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((whole & 0xC0) != 0x80)
        first = np.zeros(len(whole), bool)
        full = off[1:] > off[:-1]
        first[(off[:-1] - off[0])[full]] = True
        starts = at[cut(codes, first[at])]
        ends = np.r_[starts[1:], len(whole)]
        within = np.arange(len(whole)) - np.repeat(starts, ends - starts)
        v = BYTE[whole]
        v *= powers(int((ends - starts).max()))[within]
        keys = mix(np.add.reduceat(v, starts) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        if self.n_words > CACHE or len(self.spell) > CACHE_BYTES:
            self.clear()
        ids = self.seen.get(keys)
        missing = np.flatnonzero(ids < 0)
        raw = whole.tobytes()
        if len(missing):
            new, where, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            words = [raw[s:e] for s, e in zip(starts[missing[where]].tolist(), ends[missing[where]].tolist())]
            numbers = self._learn(words)
            ids[missing] = numbers[back]
            if self.n_words < SLOTS * 3 // 4:
                self.seen.put(new, numbers)
        # a word is the table's only if it is spelt alike
        lens = ends - starts
        place = np.repeat(self.starts[ids] - starts, lens)
        place += np.arange(len(whole))
        np.minimum(place, len(self.spell) - 1, out=place)
        same_length = np.diff(self.starts)[ids] == lens
        alike = self.spell[place] == whole
        wrong = np.flatnonzero(~(same_length & np.logical_and.reduceat(alike, starts)))
        if len(wrong):
            own: dict[bytes, int] = {}
            which = [own.setdefault(raw[starts[w] : ends[w]], len(own)) for w in wrong.tolist()]
            ids[wrong] = self._learn(list(own))[which]
        counts, firsts = self.counts[ids], self.firsts[ids]
        done = np.cumsum(counts)
        where = np.ones(int(done[-1]), np.int64)
        where[0] = firsts[0]
        where[done[:-1]] = firsts[1:] - (firsts[:-1] + counts[:-1]) + 1
        out = self.all[np.cumsum(where)]
        total = np.r_[0, done][np.searchsorted(starts, off - off[0])]
        if self.n_words >= SLOTS * 3 // 4:
            self.clear()
        return out, np.diff(total)

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """The numbers of new words, whose tokens and bytes are kept from here on."""
        tokens, counts = self.encode_words(words)
        numbers = np.arange(self.n_words, self.n_words + len(words), dtype=np.int32)
        self.all, self.counts = np.concatenate([self.all, tokens]), np.concatenate([self.counts, counts])
        self.firsts = np.r_[0, np.cumsum(self.counts)]
        self.spell = np.concatenate([self.spell, np.frombuffer(b"".join(words), np.uint8)])
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum([len(w) for w in words])]
        self.n_words += len(words)
        return numbers

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all documents, their offsets); ids outside the vocabulary have no bytes."""
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < len(self.tokens))
        safe = np.where(known, ids, 0)
        lens = np.where(known, self.lengths[safe], 0)
        offsets = np.r_[0, np.cumsum(lens)][np.r_[0, np.cumsum(counts)]]
        starts = self.at[safe]
        return gather(self.bytes, starts, starts + lens), offsets


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


@lru_cache(2)
def load(path: str) -> Bpe:
    """The vocabulary at a path that every worker can read; made once a worker."""
    return Bpe(read_ranks(path))


@lru_cache(2)
def _of_bytes(raw: bytes) -> Bpe:
    return Bpe({base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())})


def shared(spark, path: str):
    """A function that gives workers the vocabulary, which travels as a broadcast of its file's bytes (a vocabulary's
    size is fixed: it doesn't grow with the data)."""
    with open(path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    return lambda: _of_bytes(raw.value)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens and token_ids. No shuffle: one pass over id and text.

    A null text has null token_ids and 0 tokens, an empty one an empty list. Every text decodes to itself. Rows with
    the same id are encoded each by itself; other columns aren't read."""
    ship(docs.sparkSession)
    get = shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for b in batches:
            data, off, _ = flat(b.column(1))
            for i, j in slices(off):
                part = as_array(b.column(1).slice(i, j - i))
                ids, counts = bpe.encode(data, off[i : j + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids, pa.int32()), mask=part.is_null() if part.null_count else None)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(counts.astype(np.int32)), lists], names=["doc_id", "n_tokens", "token_ids"])

    return docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text")).mapInArrow(tidied(run), RESULT)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and text of token lists; null for a null list. Bytes that aren't UTF-8 become the replacement sign, and
    ids that the vocabulary doesn't have are left out."""
    ship(encoded.sparkSession)
    get = shared(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = as_array(b.column(1).slice(i, 256))
                counts = np.array(part.value_lengths().fill_null(0), np.int64)
                ids = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                data, off = bpe.decode(ids, counts)
                valid = part.is_valid().to_numpy(zero_copy_only=False)
                raw = data.tobytes()
                try:
                    raw.decode()
                    text = string_array(data, off, valid)
                except UnicodeDecodeError:
                    text = pa.array([raw[s:e].decode("utf-8", "replace") if v else None for s, e, v in zip(off, off[1:], valid)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256).cast(pa.int64()), text], names=["doc_id", "text"])

    return encoded.select(encoded[f"`{id_col}`"].cast("long").alias("doc_id"), encoded[f"`{ids_col}`"].cast("array<int>").alias("token_ids")).mapInArrow(tidied(run), "doc_id long, text string")
