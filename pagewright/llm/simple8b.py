"""Token ids as Simple-8b words.

A 64-bit word holds a selector in its top 4 bits and as many equally wide values below as the selector says. Values
are packed in blocks of ``BLOCK``, each block starting a word, and the word at which each block starts is kept, so a
block can be decoded without those before it and all words of all documents at once.

Selector 0 is the escape for values that 60 bits can't hold (and negative ones): two words, the low and the high
half of the value, so that the kind of every word can be read from the word itself.

At each position the encoder takes the selector that fits the most values. The choice at a position doesn't depend
on earlier ones, so it is made for all positions at once; then all blocks are walked together, one word a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .buffers import U64, as_array, flat, ship, slices, tidied

#: (values, bits of each) by selector; 0 is the escape.
KINDS = ((1, 32), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
PER = np.array([k[0] for k in KINDS], np.int64)
BITS = np.array([k[1] for k in KINDS], np.int64)
BLOCK = 256
RESULT = "doc_id long, n_ids int, packed binary, block_offsets array<int>"


def encode(ids: np.ndarray, counts: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words of each list, word at which each block of each list starts, blocks of each list) for the int64
    ``ids`` of lists of ``counts`` values. An empty list has neither words nor blocks."""
    counts = counts.astype(np.int64)
    ids = ids.astype(np.int64)
    n = len(ids)
    blocks = (counts + block - 1) // block
    if not n:
        return np.zeros(0, U64), np.zeros(len(counts), np.int64), np.zeros(0, np.int64), blocks
    first_of_list = np.r_[0, np.cumsum(counts)[:-1]]
    of = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(blocks)[:-1]], blocks)
    start = first_of_list[of] + nth * block
    end = np.minimum(start + block, (first_of_list + counts)[of])
    values = ids.view(U64)
    # the blocks side by side, each with zeros behind it: a word may reach beyond the end of its block
    pitch = block + 64
    place = np.repeat(np.arange(len(start)) * pitch - start, end - start) + np.arange(n)
    kind = np.zeros(len(start) * pitch + 64, np.uint8)
    kind[place] = _kinds(values)
    wide = np.zeros(len(kind), U64)
    wide[place] = values
    best = _choose(kind)
    at = np.arange(len(start)) * pitch
    stop = at + (end - start)
    live = np.arange(len(start))
    where, owner = [], []
    while len(live):
        i = at[live]
        where.append(i)
        owner.append(live)
        i = i + PER[best[i]]
        at[live] = i
        live = live[i < stop[live]]
    where, owner_all = np.concatenate(where), np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    where, owner_all = where[order], owner_all[order]
    s = best[where]
    out = np.zeros(len(where), U64)
    for k in range(1, len(KINDS)):
        w = np.flatnonzero(s == k)
        if len(w):
            per, bits = KINDS[k]
            i = where[w]
            v = wide[i]
            for j in range(1, per):
                v |= wide[i + j] << U64(bits * j)
            out[w] = v | U64(k << 60)
    esc = np.flatnonzero(s == 0)
    if len(esc):
        v = wide[where[esc]]
        out[esc] = v & U64(0xFFFFFFFF)
        out = np.insert(out, esc + 1, v >> U64(32))
        owner_all = np.insert(owner_all, esc + 1, owner_all[esc])
    per_block = np.bincount(owner_all, minlength=len(start))
    block_at = np.r_[0, np.cumsum(per_block)[:-1]]
    per_list = np.bincount(of, weights=per_block, minlength=len(counts)).astype(np.int64)
    list_at = np.r_[0, np.cumsum(per_list)[:-1]]
    return out, per_list, block_at - list_at[of], blocks


_SMALL = np.searchsorted(2 ** BITS[1:] - 1, np.arange(1 << 16)).astype(np.uint8) + 1


def _kinds(values: np.ndarray) -> np.ndarray:
    """Of each value the selector with the least bits that hold it; one beyond the last where none does."""
    out = _SMALL[np.minimum(values, U64(0xFFFF)).astype(np.int64)]
    large = np.flatnonzero(values > U64(0xFFFF))
    if len(large):
        out[large] = np.searchsorted((2 ** BITS[1:] - 1).astype(U64), values[large]) + 1
    return out


def _choose(kind: np.ndarray) -> np.ndarray:
    """At each position the selector that fits the most values from there on; 0 to escape."""
    most = {1: kind}
    for a, b in ((1, 1), (2, 1), (2, 2), (4, 1), (4, 2), (4, 3), (4, 4), (8, 2), (8, 4), (8, 7), (15, 5), (15, 15), (30, 30)):
        x = most[a].copy()
        np.maximum(x[:-a], most[b][a:], out=x[:-a])
        most[a + b] = x
    best = np.zeros(len(kind), np.uint8)
    for s in range(len(KINDS) - 1, 0, -1):
        np.copyto(best, np.uint8(s), where=most[KINDS[s][0]] <= s)
    return best


def decode(words: np.ndarray, sizes: np.ndarray, counts: np.ndarray, block_words: np.ndarray, blocks: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids of lists with ``sizes`` words and ``counts`` values each; ``block_words`` and ``blocks`` as encode() gives them."""
    counts = counts.astype(np.int64)
    out = np.zeros(int(counts.sum()), U64)
    if not len(out):
        return out.view(np.int64)
    s = (words >> U64(60)).astype(np.int64)
    per = PER[s]
    esc = np.flatnonzero(s == 0)
    low, high = esc[::2], esc[1::2]
    per[high] = 0
    list_at = np.r_[0, np.cumsum(sizes)[:-1]]
    of = np.repeat(np.arange(len(counts)), blocks)
    block_at = block_words + list_at[of]
    nth = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(blocks)[:-1]], blocks)
    start = np.r_[0, np.cumsum(counts)[:-1]][of] + nth * block
    end = start + np.minimum(block, counts[of] - nth * block)
    before = np.r_[0, np.cumsum(per)]
    word_block = np.repeat(np.arange(len(block_at)), np.diff(np.r_[block_at, len(words)]))
    to = start[word_block] + before[:-1] - before[block_at][word_block]
    limit = end[word_block]
    for k in range(1, len(KINDS)):
        w = np.flatnonzero(s == k)
        if not len(w):
            continue
        n, bits = KINDS[k]
        mask = U64((1 << bits) - 1)
        v, p, e = words[w], to[w], limit[w]
        for j in range(n):
            has = p + j < e
            if not has.any():
                break
            out[p[has] + j] = (v[has] >> U64(bits * j)) & mask
    if len(esc):
        out[to[low]] = words[low] | (words[high] << U64(32))
    return out.view(np.int64)


def pack_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, n_ids, packed (little-endian Simple-8b words) and block_offsets (the word at which
    each block of ``block`` ids starts). The ids are those of ``bpe.encode``. No shuffle.

    A null text has null packed and block_offsets and 0 ids; an empty one has no words and no blocks. Rows with the
    same id are packed each by itself; other columns aren't read."""
    ship(docs.sparkSession)
    get = bpe.shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = get()
        for b in batches:
            data, off, valid = flat(b.column(1))
            for i, j in slices(off):
                ids, counts = coder.encode(data, off[i : j + 1])
                yield _batch(b.column(0).slice(i, j - i).cast(pa.int64()), ids, counts, valid[i:j], block)

    return docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text")).mapInArrow(tidied(run), RESULT)


def _batch(doc_id: pa.Array, ids: np.ndarray, counts: np.ndarray, valid: np.ndarray, block: int) -> pa.RecordBatch:
    words, sizes, block_words, blocks = encode(ids, counts, block)
    mask = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    off = np.r_[0, np.cumsum(sizes * 8)].astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(counts), [mask, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(words.astype("<u8")).view(np.uint8))])
    at = np.r_[0, np.cumsum(blocks)].astype(np.int32)
    starts = pa.ListArray.from_arrays(pa.array(at), pa.array(block_words.astype(np.int32)), mask=None if valid.all() else pa.array(~valid))
    return pa.RecordBatch.from_arrays([doc_id, pa.array(counts.astype(np.int32)), packed, starts], names=["doc_id", "n_ids", "packed", "block_offsets"])


def pack_ids(lists: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", block: int = BLOCK) -> DataFrame:
    """As ``pack_tokens``, of lists of whole numbers that are there already. A null within a list isn't allowed for in
    the coding and is left out."""
    ship(lists.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = as_array(b.column(1).slice(i, 1024))
                valid = part.is_valid().to_numpy(zero_copy_only=False)
                flat_ids = part.flatten()
                counts = np.array(part.value_lengths().fill_null(0), np.int64)
                if flat_ids.null_count:
                    there = flat_ids.is_valid().to_numpy(zero_copy_only=False)
                    counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[there], minlength=len(counts))
                    flat_ids = flat_ids.drop_null()
                yield _batch(b.column(0).slice(i, 1024).cast(pa.int64()), flat_ids.cast(pa.int64()).to_numpy(zero_copy_only=False), counts, valid, block)

    return lists.select(lists[f"`{id_col}`"].cast("long").alias("doc_id"), lists[f"`{ids_col}`"].cast("array<long>").alias("ids")).mapInArrow(tidied(run), RESULT)


def unpack_ids(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id and token_ids (array<long>) from the result of ``pack_tokens`` or ``pack_ids``; null for null."""
    ship(packed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                data, off, valid = flat(part.column(2))
                counts = as_array(part.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                words = np.frombuffer(data[off[0] : off[-1]].tobytes(), "<u8").astype(U64)
                starts = as_array(part.column(3))
                blocks = np.array(starts.value_lengths().fill_null(0), np.int64)
                ids = decode(words, np.diff(off) // 8, np.where(valid, counts, 0), starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64), blocks, block)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(valid, counts, 0))].astype(np.int32)), pa.array(ids), mask=None if valid.all() else pa.array(~valid))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "token_ids"])

    return packed.select("doc_id", "n_ids", "packed", "block_offsets").mapInArrow(tidied(run), "doc_id long, token_ids array<long>")
