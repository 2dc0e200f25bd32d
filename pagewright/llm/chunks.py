"""Substring dedup by content-defined chunking.

A gear hash rolls over the text's bytes, h = (h << 1) + G[byte] in 16 bits, so it depends on the last 16 bytes; where
it falls below a bound, a chunk ends. Chunk ends therefore depend on the bytes around them alone: text inserted before
a passage shifts the passage's chunks but doesn't change them. Chunks are deduplicated by a 64-bit digest. The digests
go to shards packed (one row for each shard and slice of documents); a shard sorts them and sends the chunks that
several documents hold on to shards of documents, packed as well; what a group of documents can tell by itself is settled there. A
document's neighbouring repeated chunks make a span, and spans of ``MIN_SPAN`` bytes or more are passages that repeat. A
chunk is kept where it comes first: in the document with the least id. Two chunks whose digests meet by
chance don't make a span, which takes a run of chunks that repeat.

All 16 shifted additions of the rolling hash are done by doubling, in four passes over the bytes of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import PACKED, U64, flat, fresh, ids_of, mix, of_kind, pack, packed_groups, shards_of, ship, slices, span_hashes, tidied, unpack

#: Mean length of a chunk, and the length of the spans that count, in bytes: shorter repeats are phrases.
MEAN, MIN_SPAN = 24, 160
#: A chunk is cut at this length, counted from its start, even where the hash finds no end: in runs of a repeated letter
#: or the like. Text put in before such a run shifts its chunks but doesn't change them; text put in within it does.
LONGEST = 1024
GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)
SPANS = "doc_id long, start long, length long, n_chunks int, kept boolean"


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            x = h.copy()
            x[k:] += h[:-k] << np.uint16(k)
            h = x
    return h


def chunk(data: np.ndarray, off: np.ndarray, mean: int = MEAN, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the chunks of documents, in order; they cover all bytes. A document's end ends a chunk."""
    lo, hi = int(off[0]), int(off[-1])
    cut = np.zeros(hi - lo + 1, bool)
    if hi > lo:
        cut[1:] = gear(data[lo:hi]) < (1 << 16) // mean
        for k in range(1, 16):  # the hash here would also depend on the document before
            cut[np.minimum(off[:-1] - lo + k, hi - lo)] = False
    cut[off - lo] = True
    at = np.flatnonzero(cut) + lo
    if len(at) and at[0] != lo:
        at = np.r_[lo, at]
    starts, ends = at[:-1], at[1:]
    if len(starts) and (ends - starts).max() > longest:
        n = (ends - starts + longest - 1) // longest
        k = np.arange(int(n.sum())) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        s = np.repeat(starts, n) + k * longest
        ends = np.minimum(s + longest, np.repeat(ends, n))
        starts = s
    return starts, ends


SETTLED = 1
#: Bytes of text whose chunks are settled together.
GROUP = 8 << 20


def settle(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a group of documents can tell by itself: a chunk that several of them hold repeats, and in all but the one
    with the least id it isn't the first. Only that one's records are sent, so however common a chunk is, its shard
    gets no more than one document's records a group.

    (positions to send, for every position whether its chunk is known to repeat, positions that are settled)."""
    order = np.lexsort((d, h))
    at = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.r_[at, len(h)])
    sd = d[order]
    last = at + size - 1
    repeats = np.repeat(sd[at] != sd[last], size) if len(h) else np.zeros(0, bool)
    later = repeats & (sd != np.repeat(sd[at], size)) if len(h) else repeats
    known = np.zeros(len(h), bool)
    known[order] = repeats
    return np.sort(order[~later]), known, np.sort(order[later])


def repeated(docs: DataFrame, id_col: str, text_col: str, mean: int, longest: int, shards: int, parts: int) -> DataFrame:
    """The chunks that two documents or more hold, packed by shards of documents: document, start, length, whether first here."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, _ = flat(b.column(1))
            ids, _ = ids_of(b.column(0))
            for i, j in slices(off, GROUP):
                found = []
                for x, y in slices(off[i : j + 1]):
                    x, y = i + x, i + y
                    s, e = chunk(data, off[x : y + 1], mean, longest)
                    d = np.searchsorted(off[x : y + 1], s, "right") - 1
                    found.append((span_hashes(data, s, e), ids[x:y][d], (s - off[x:y][d]).astype(np.uint32), (e - s).astype(np.uint32)))
                h, d, s, n = (np.concatenate(c) for c in zip(*found))
                sent, known, later = settle(h, d)
                yield pack((h[sent] % U64(shards)).astype(np.int32), [h[sent], d[sent], s[sent], n[sent], known[sent]])
                if len(later):
                    yield pack((mix(d[later]) % U64(shards)).astype(np.int32), [d[later], s[later], n[later]], SETTLED)

    def answer(t: pa.Table) -> pa.Table:
        h, d, s, n, known = unpack(of_kind(t, 0), [U64, np.int64, np.uint32, np.uint32, bool])
        order = np.argsort(h, kind="stable")
        h = h[order]
        group = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        d, known = d[order], known[order]
        lo, hi = (np.minimum.reduceat(d, group), np.maximum.reduceat(d, group)) if len(h) else (d, d)
        several = (lo != hi) | np.maximum.reduceat(known, group) if len(h) else known
        size = np.diff(np.r_[group, len(h)])
        many = np.repeat(several, size)
        own = (d == np.repeat(lo, size))[many]
        sel = order[many]
        late_d, late_s, late_n = unpack(of_kind(t, SETTLED), [np.int64, np.uint32, np.uint32])
        d = np.r_[d[many], late_d]
        return pa.Table.from_batches([pack((mix(d) % U64(shards)).astype(np.int32), [d, np.r_[s[sel], late_s], np.r_[n[sel], late_n], np.r_[own, np.zeros(len(late_d), bool)]])])

    src = docs.select(docs[f"`{id_col}`"].cast("long").alias("i"), docs[f"`{text_col}`"].cast("string").alias("t")).filter("i is not null and t is not null")
    return packed_groups(src.mapInArrow(tidied(send), PACKED), parts).applyInArrow(answer, PACKED)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN, min_span: int = MIN_SPAN, longest: int = LONGEST) -> DataFrame:
    """One row for each passage of a document that repeats in other documents: doc_id, start and length in bytes of
    the text's UTF-8, n_chunks, and whether it is kept (no document with a lesser id holds its chunks).

    A span is a run of neighbouring chunks that several ids hold, all first here or all first elsewhere, in a run of
    both kinds of ``min_span`` bytes or more. Repeats within one document don't count. Null ids, null and empty texts
    have no spans. Rows with the same id count as one document, whose chunks are counted once where they start alike; rows
    that repeat with their id therefore have the spans of one of them. An empty table gives no rows. Texts of any length up
    to 4 GB are read whole. Other columns, whatever their names, aren't read."""
    ship(docs.sparkSession)
    shards, parts = shards_of(docs)

    def run(t: pa.Table) -> pa.Table:
        d, s, n, own = unpack(t.column("packed"), [np.int64, np.uint32, np.uint32, bool])
        return pa.table(dict(zip(("doc_id", "start", "length", "n_chunks", "kept"), _runs(d, s.astype(np.int64), s.astype(np.int64) + n, own, min_span))))

    return packed_groups(repeated(docs, id_col, text_col, mean, longest, shards, parts), parts).applyInArrow(run, SPANS)


def _runs(d: np.ndarray, s: np.ndarray, e: np.ndarray, own: np.ndarray, min_span: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, number of chunks, whether first here) of the spans of many documents' chunks."""
    order = np.lexsort((e, s, d))
    d, s, e, own = d[order], s[order], e[order], own[order]
    one = np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])] if len(d) else np.zeros(0, bool)
    d, s, e, own = d[one], s[one], e[one], own[one]
    if not len(d):
        return d, s, e, np.zeros(0, np.int32), own
    opens = np.r_[True, (d[1:] != d[:-1]) | (s[1:] != e[:-1])]
    at = np.flatnonzero(opens)
    last = np.r_[at[1:], len(d)] - 1
    long = np.repeat(e[last] - s[at] >= min_span, np.diff(np.r_[at, len(d)]))
    part = np.flatnonzero(opens | np.r_[True, own[1:] != own[:-1]])
    stop = np.r_[part[1:], len(d)]
    keep = long[part]
    part, stop = part[keep], stop[keep]
    return d[part], s[part], e[stop - 1] - s[part], (stop - part).astype(np.int32), own[part]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN, min_span: int = MIN_SPAN, longest: int = LONGEST) -> DataFrame:
    """The documents with all their columns, without the passages that an earlier document holds. A cut within a
    character takes the whole character along.

    Rows with the same id lose the same places. Null ids, null and empty texts stay as they are, and of texts that are
    equal under several ids the one with the least id stays. Other columns are carried along whatever their names
    and nulls; an empty table stays empty."""
    doc, cut = fresh(docs, "_pw_doc"), fresh(docs, "_pw_cut")
    gone = spans(docs, id_col, text_col, mean, min_span, longest).filter("not kept").groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("start", "length")).alias(cut))
    j = docs.join(gone, docs[f"`{id_col}`"].cast("long") == gone[doc], "left").drop(doc)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for k, cuts in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if cuts and texts[k] is not None:
                    raw, out, end = texts[k].encode(), [], 0
                    for c in sorted(cuts, key=lambda c: c["start"]):
                        out.append(raw[end : c["start"]])
                        end = c["start"] + c["length"]
                    texts[k] = b"".join([*out, raw[end:]]).decode("utf-8", "ignore")
            cols = b.columns[:-1]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return j.mapInArrow(tidied(run), docs.schema)
