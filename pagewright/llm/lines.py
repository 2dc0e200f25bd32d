"""Line dedup by sharded minimal perfect hashing.

Lines are known by 128-bit hashes. A batch of documents counts its lines by itself and sends each distinct one once, packed:
hash, occurrences and least document. A shard (a residue of the hash) adds them up and makes a minimal perfect hash
over the lines that occur often enough in the corpus; it numbers them without holding them, and arrays by that number keep a
64-bit fingerprint, the number of occurrences and the first document. The shards' arrays are written as rows.

Documents then probe the arrays where they are: the arrays are broadcast, a line's hash gives its shard and number, and a
line that isn't in the arrays (most lines aren't) has another fingerprint. Neither lines nor texts are shuffled or joined. Arrays
larger than ``BROADCAST_BYTES`` aren't broadcast: the documents' packed hashes go to the shards and probe them
there, and what they find is joined to the documents. The result is the same.

The hash has levels: a level's bit array marks the places that exactly one of its keys takes, the keys that collide
go to the next level, and a key's number is the rank of its bit (Limasset et al., 2017).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from ..session import ensure_checkpoint_dir
from .buffers import PACKED, U64, flat, fresh, gather, ids_of, mix, pack, packed_groups, shards_of, ship, slices, string_array, tidied, unpack

#: A line that occurs so many times in the corpus keeps only its first occurrence. Lines with fewer stay: with 2, near
#: copies of a document would be cut down to the lines in which they differ.
MIN_COUNT = 4
#: Arrays up to this size are broadcast to the documents; larger ones are probed where they are.
BROADCAST_BYTES = 64 << 20


class PerfectHash:
    """A minimal perfect hash of distinct keys of twice 64 bits."""

    GAMMA = 2.0

    def __init__(self, keys: np.ndarray, more: np.ndarray):
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        base, level, left, rest = 0, 0, keys.astype(U64), more.astype(U64)
        while len(left):
            size = max(64, int(len(left) * self.GAMMA))
            at = self._place(left, rest, level, size)
            once = np.bincount(at, minlength=size) == 1
            words = np.packbits(once, bitorder="little")
            words = np.pad(words, (0, -len(words) % 8)).view(U64)
            ranks = np.r_[0, np.cumsum(np.bitwise_count(words))].astype(np.int64)
            self.levels.append((size, base, words, ranks))
            base += int(ranks[-1])
            left, rest = left[~once[at]], rest[~once[at]]
            level += 1
        self.n = base

    @staticmethod
    def _place(keys: np.ndarray, more: np.ndarray, level: int, size: int | np.ndarray) -> np.ndarray:
        c = U64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (mix(mix(keys + c) + more) % np.asarray(size).astype(U64)).astype(np.int64)

    def __call__(self, keys: np.ndarray, more: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for some (not all) keys that aren't in the set."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (size, base, words, ranks) in enumerate(self.levels):
            if not len(todo):
                break
            at = self._place(keys[todo], more[todo], level, size)
            w, bit = at >> 6, (at & 63).astype(U64)
            hit = (words[w] >> bit) & U64(1) == 1
            below = np.bitwise_count(words[w] & ((U64(1) << bit) - U64(1))).astype(np.int64)
            out[todo[hit]] = (base + ranks[w] + below)[hit]
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        return b"".join(np.int64(size).tobytes() + words.tobytes() for size, _, words, _ in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        out = cls(np.zeros(0, U64), np.zeros(0, U64))
        at = 0
        while at < len(raw):
            size = int(np.frombuffer(raw, np.int64, 1, at)[0])
            words = np.frombuffer(raw, U64, (size + 63) // 64, at + 8)
            ranks = np.r_[0, np.cumsum(np.bitwise_count(words))].astype(np.int64)
            out.levels.append((size, out.n, words, ranks))
            out.n += int(ranks[-1])
            at += 8 + words.nbytes
        return out


class LineIndex:
    """The arrays of a shard: fingerprint, occurrences and first document of each line with ``min_count`` occurrences."""

    def __init__(self, mph: PerfectHash, prints: np.ndarray, counts: np.ndarray, first: np.ndarray):
        self.mph, self.prints, self.counts, self.first = mph, prints, counts, first

    @classmethod
    def build(cls, keys: np.ndarray, more: np.ndarray, docs: np.ndarray, counts: np.ndarray, min_count: int) -> LineIndex:
        order = np.lexsort((more, keys))
        keys, more, docs, counts = keys[order], more[order], docs[order], counts[order].astype(np.int64)
        cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])]) if len(keys) else np.zeros(0, np.int64)
        total = np.add.reduceat(counts, cut) if len(keys) else counts
        least = np.minimum.reduceat(docs, cut) if len(keys) else docs
        many = total >= min_count
        keys, more = keys[cut][many], more[cut][many]
        mph = PerfectHash(keys, more)
        at = mph(keys, more)
        out = cls(mph, np.zeros(mph.n, U64), np.zeros(mph.n, np.int64), np.zeros(mph.n, np.int64))
        out.prints[at], out.counts[at], out.first[at] = more, total[many], least[many]
        return out

    def probe(self, keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrences, first document) of each; no occurrences for a line that isn't in the arrays, which its
        fingerprint tells."""
        if not self.mph.n:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = self.mph(keys, more)
        known = (at >= 0) & (self.prints[at] == more)
        return np.where(known, self.counts[at], 0), self.first[at]

    def to_row(self) -> list[bytes]:
        return [self.mph.to_bytes(), self.prints.tobytes(), self.counts.tobytes(), self.first.tobytes()]

    @classmethod
    def from_row(cls, bits: bytes, prints: bytes, counts: bytes, first: bytes) -> LineIndex:
        return cls(PerfectHash.from_bytes(bits), np.frombuffer(prints, U64), np.frombuffer(counts, np.int64), np.frombuffer(first, np.int64))


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the lines of documents; an empty document has one empty line."""
    lo, hi = int(off[0]), int(off[-1])
    breaks = np.flatnonzero(data[lo:hi] == 10) + lo
    starts = np.r_[off[:-1], breaks + 1]
    doc = np.r_[np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1]
    ends = np.r_[off[1:], breaks]
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
    ends = np.r_[starts[1:] - 1, hi] if len(starts) else starts
    ends[last] = off[1:]
    return starts, ends, doc


def trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without blanks, tabs and carriage returns at their ends."""
    s, e = starts.copy(), ends.copy()
    blank = np.zeros(256, bool)
    blank[[32, 9, 13]] = True
    live = np.flatnonzero(e > s)
    while len(live):
        live = live[blank[data[s[live]]]]
        s[live] += 1
        live = live[e[live] > s[live]]
    live = np.flatnonzero(e > s)
    while len(live):
        live = live[blank[data[e[live] - 1]]]
        e[live] -= 1
        live = live[e[live] > s[live]]
    return s, e


def line_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, document) of each line, and of those that aren't empty when trimmed their places among the lines and the two
    halves of their hashes."""
    starts, ends, doc = line_spans(data, off)
    s, e = trimmed(data, starts, ends)
    full = np.flatnonzero(e > s)
    lo = int(off[0])
    raw = data[lo : off[-1]].tobytes()
    digests = b"".join([xxh3_128_digest(raw[a:b]) for a, b in zip((s[full] - lo).tolist(), (e[full] - lo).tolist())])
    halves = np.frombuffer(digests, ">u8").astype(U64).reshape(-1, 2)
    return starts, ends, doc, full, halves[:, 0].copy(), halves[:, 1].copy()


INDEX = "shard int, bits binary, prints binary, counts binary, first binary"
_FIELDS = ("bits", "prints", "counts", "first")


def tallied(h: np.ndarray, g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """(halves of the hash, least document, occurrences) of the distinct lines: however common a line is, its shard gets one
    record of it a batch."""
    order = np.lexsort((d, g, h))
    h, g, d = h[order], g[order], d[order]
    cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[cut], g[cut], d[cut], np.diff(np.r_[cut, len(h)])


def line_index(docs: DataFrame, id_col: str, text_col: str, min_count: int, shards: int, parts: int) -> DataFrame:
    """The shards' arrays, one row a shard that has lines."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, _ = flat(b.column(1))
            ids, _ = ids_of(b.column(0))
            found = []
            for i, j in slices(off):
                *_, doc, full, h, g = line_hashes(data, off[i : j + 1])
                found.append((h, g, ids[i:j][doc[full]]))
            if found:
                h, g, d, n = tallied(*(np.concatenate(c) for c in zip(*found)))
                yield pack((h % U64(shards)).astype(np.int32), [h, g, d, n])

    def build(t: pa.Table) -> pa.Table:
        h, g, d, n = unpack(t.column("packed"), [U64, U64, np.int64, np.int64])
        index = LineIndex.build(h, g, d, n, min_count)
        return pa.table([pa.array(t.column("shard").to_pylist()[:1], pa.int32()), *(pa.array([x], pa.binary()) for x in index.to_row())], names=["shard", *_FIELDS])

    src = docs.select(docs[f"`{id_col}`"].cast("long").alias("i"), docs[f"`{text_col}`"].cast("string").alias("t")).filter("t is not null")
    return packed_groups(src.mapInArrow(tidied(send), PACKED), parts).applyInArrow(build, INDEX)


#: (halves of line hashes, ids of their documents, numbers of their rows) -> (whether a line repeats, whether this document is its first).
Lookup = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class ShardArrays:
    """The arrays of all shards end to end, probed for lines of any shard at once."""

    def __init__(self, rows: list[tuple], shards: int):
        self.shards = shards
        of = [(r[0], LineIndex.from_row(*r[1:])) for r in sorted(rows)]
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.prints, self.first = join([x.prints for _, x in of], U64), join([x.first for _, x in of], np.int64)
        offset = np.cumsum([0, *(x.mph.n for _, x in of)])
        self.levels = []  # by shard: places (0 where there is no such level), where its words begin, the number before; then all words and ranks
        for level in range(max((len(x.mph.levels) for _, x in of), default=0)):
            size, begin, base = (np.zeros(shards, np.int64) for _ in range(3))
            words, ranks, at = [], [], 0
            for k, (shard, x) in enumerate(of):
                if level < len(x.mph.levels):
                    size[shard], below, w, r = x.mph.levels[level]
                    begin[shard], base[shard] = at, offset[k] + below
                    words.append(w)
                    ranks.append(r[:-1])
                    at += len(w)
            self.levels.append((size, begin, base, np.concatenate(words), np.concatenate(ranks)))

    def __call__(self, h: np.ndarray, g: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many, first = np.zeros(len(h), bool), np.zeros(len(h), bool)
        todo = np.arange(len(h))
        shard = (h % U64(self.shards)).astype(np.int64)
        for level, (size, begin, base, words, ranks) in enumerate(self.levels):
            todo = todo[size[shard[todo]] > 0]
            if not len(todo):
                break
            s = shard[todo]
            at = PerfectHash._place(h[todo], g[todo], level, size[s])
            w, bit = begin[s] + (at >> 6), (at & 63).astype(U64)
            hit = (words[w] >> bit) & U64(1) == 1
            below = np.bitwise_count(words[w] & ((U64(1) << bit) - U64(1))).astype(np.int64)
            number = (base[s] + ranks[w] + below)[hit]
            here = todo[hit]
            known = self.prints[number] == g[here]
            many[here] = known
            first[here] = known & (self.first[number] == ids[here])
            todo = todo[~hit]
        return many, first


def found_by_shards(docs: DataFrame, index: DataFrame, id_col: str, text_col: str, shards: int, parts: int) -> DataFrame:
    """By document (id; the largest for null) the lines of it that repeat, for arrays that are too large to
    broadcast: _pw_doc, and _pw_lines with the halves of the hash and whether this document is the first."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, _ = flat(b.column(1))
            ids, _ = ids_of(b.column(0))
            found = []
            for i, j in slices(off):
                *_, doc, full, h, g = line_hashes(data, off[i : j + 1])
                found.append((h, g, ids[i:j][doc[full]]))
            if found:
                h, g, d = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((d, g, h))
                h, g, d = h[order], g[order], d[order]
                one = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
                yield pack((h[one] % U64(shards)).astype(np.int32), [h[one], g[one], d[one]])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        h, g, d = unpack(left.column("packed"), [U64, U64, np.int64])
        at = np.zeros(0, np.int64)
        if right.num_rows and len(h):
            n, first = LineIndex.from_row(*(right.column(c)[0].as_py() for c in _FIELDS)).probe(h, g)
            at = np.flatnonzero(n > 0)
            own = (first == d)[at].astype(U64)
        at_order = np.argsort(d[at], kind="stable")
        at = at[at_order]
        blob = np.stack([h[at], g[at], own[at_order]], axis=1) if len(at) else np.zeros((0, 3), U64)
        d = d[at]
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
        lines = [blob[a:b].tobytes() for a, b in zip(cut, np.r_[cut[1:], len(d)])]
        return pa.table({"_pw_doc": pa.array(d[cut], pa.int64()), "_pw_lines": pa.array(lines, pa.binary())})

    src = docs.select(docs[f"`{id_col}`"].cast("long").alias("i"), docs[f"`{text_col}`"].cast("string").alias("t")).filter("t is not null")
    found = packed_groups(src.mapInArrow(tidied(send), PACKED), parts).cogroup(packed_groups(index, parts)).applyInArrow(answer, "_pw_doc long, _pw_lines binary")
    return found.groupBy("_pw_doc").agg(F.collect_list("_pw_lines").alias("_pw_lines"))


def joined(lists: pa.Array) -> Lookup:
    """Lookup among the lines that came with each document."""
    known: dict[int, dict[tuple[int, int], int]] = {}

    def look(h: np.ndarray, g: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = []
        for x, y, r in zip(h.tolist(), g.tolist(), rows.tolist()):
            if r not in known:
                known.clear()
                known[r] = {(a, b): c for part in lists[r].as_py() or [] for a, b, c in np.frombuffer(part, U64).reshape(-1, 3).tolist()}
            got.append(known[r].get((x, y), -1))
        own = np.array(got, np.int64)
        return own >= 0, own == 1

    return look


def _cut(texts: pa.Array, ids: np.ndarray, look: Lookup) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts without the lines that go, lines before, lines gone)."""
    data, off, valid = flat(texts)
    n = len(off) - 1
    before, removed = np.zeros(n, np.int64), np.zeros(n, np.int64)
    pieces: list[pa.Array] = []
    for i, j in slices(off):
        own = off[i : j + 1]
        starts, ends, doc, full, h, g = line_hashes(data, own)
        keep = np.ones(len(starts), bool)
        rows = doc[full] + i
        many, first = look(h, g, ids[rows], rows)
        keep[full[many & ~first]] = False
        here = np.flatnonzero(many & first)  # of these the first in the document stays
        if len(here):
            order = here[np.lexsort((here, g[here], h[here], rows[here]))]
            same = (rows[order][1:] == rows[order][:-1]) & (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
            keep[full[order[1:][same]]] = False
        before[i:j] = np.where(valid[i:j], np.bincount(doc, minlength=j - i), 0)
        removed[i:j] = np.bincount(doc, weights=~keep, minlength=j - i)
        if keep.all():
            pieces.append(string_array(data[own[0] : own[-1]], own - own[0], valid[i:j]))
            continue
        d = doc[keep]
        final = np.r_[d[1:] != d[:-1], True] if len(d) else np.zeros(0, bool)
        # a kept line takes its line break along, but for the last one kept
        s, e = starts[keep], ends[keep] + ~final
        out = gather(data, s, e)
        lens = np.bincount(d, weights=e - s, minlength=j - i).astype(np.int64)
        pieces.append(string_array(out, np.r_[0, np.cumsum(lens)], valid[i:j]))
    return pa.concat_arrays(pieces) if pieces else pa.array([], pa.string()), before, removed


def _cutting(docs: DataFrame, id_col: str, text_col: str, min_count: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], tuple[pa.Array, np.ndarray, np.ndarray]]]:
    """The documents with what is needed to cut them, and what cuts a batch of them."""
    spark = docs.sparkSession
    ship(spark)
    ensure_checkpoint_dir(spark)
    shards, parts = shards_of(docs)
    index = line_index(docs, id_col, text_col, min_count, shards, parts).checkpoint()
    size = index.agg(F.sum(sum(F.length(c) for c in _FIELDS))).first()[0] or 0
    where, at = docs.columns.index(id_col), docs.columns.index(text_col)
    if size <= BROADCAST_BYTES:
        rows = spark.sparkContext.broadcast([tuple(bytes(x) if k else x for k, x in enumerate(r)) for r in index.collect()])
        cache: dict[str, Lookup] = {}

        def probe(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            if "look" not in cache:
                cache["look"] = ShardArrays(rows.value, shards)
            return _cut(b.column(at), ids_of(b.column(where))[0], cache["look"])

        return docs, probe
    doc, lines = fresh(docs, "_pw_doc"), fresh(docs, "_pw_lines")
    r = found_by_shards(docs, index, id_col, text_col, shards, parts).toDF(doc, lines)
    nulls = F.coalesce(docs[f"`{id_col}`"].cast("long"), F.lit(2**63 - 1))
    with_lines = docs.join(r, nulls == r[doc], "left").drop(doc)
    return with_lines, lambda b: _cut(b.column(at), ids_of(b.column(where))[0], joined(b.column(b.num_columns - 1)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """One row a document: doc_id, text without repeated lines, n_lines before, n_removed.

    Lines are compared without blanks, tabs and carriage returns at their ends; empty lines always stay. A line with
    ``min_count`` or more occurrences in the corpus stays only where it comes first: in the document with the least
    id, at its first place there. Rows with the same id count as one document for that, each keeping its own first
    occurrence; rows with a null id count as one document after all others. A null text stays null, with 0 lines; a
    text all of whose lines go becomes empty, and an empty text has one empty line. Texts and lines of any length are
    read whole. An empty table gives no rows. Other columns, whatever their names, aren't read."""
    own = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    rows, cut = _cutting(own, "doc_id", "text", min_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, before, removed = cut(b)
            yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array(before.astype(np.int32)), pa.array(removed.astype(np.int32))], names=["doc_id", "text", "n_lines", "n_removed"])

    return rows.mapInArrow(tidied(run), "doc_id long, text string, n_lines int, n_removed int")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", min_count: int = MIN_COUNT) -> DataFrame:
    """The documents with their columns, repeated lines taken out of the text; the length column, if there is one,
    gets the new number of characters. A document left without any line but empty ones goes; others stay.

    What repeats is as in ``dedup_lines``. Null texts and texts that were empty before stay as they are. Other
    columns are carried along whatever their names and nulls; an empty table stays empty."""
    names = docs.columns
    at = names.index(text_col)
    count_at = names.index(length_col) if length_col in names else None
    rows, cut = _cutting(docs, id_col, text_col, min_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, _, removed = cut(b)
            cols = b.columns[: len(names)]
            cols[at] = text
            if count_at is not None:
                n = pc.utf8_length(text).cast(cols[count_at].type)
                cols[count_at] = pc.if_else(pa.array(removed > 0), n, cols[count_at])
            left = pc.or_(pa.array(removed == 0), pc.fill_null(pc.match_substring_regex(text, r"[^ \t\r\n]"), False))
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(left)

    return rows.mapInArrow(tidied(run), docs.schema)


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
     k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
     o AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, min(doc_id) OVER (PARTITION BY key) AS first_doc,
                  row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS nth FROM k),
     m AS (SELECT *, key = '' OR n < 4 OR (doc_id = first_doc AND nth = 1) AS keep FROM o),
     g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '') AS text,
                  CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE NOT keep) AS INTEGER) AS n_removed FROM m GROUP BY doc_id)
SELECT d.doc_id, g.text, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed FROM documents d LEFT JOIN g USING (doc_id)
"""
