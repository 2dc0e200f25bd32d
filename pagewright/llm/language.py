"""Language identification with hyperdimensional profiles.

A letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted by its
distance from the n-gram's end: ``v(abc) = shift(shift(a) * b) * c``, which is the product of ``a`` rolled twice,
``b`` rolled once and ``c``. A text's vector bundles (adds) the vectors of all its n-grams, with their counts. A
language's prototype bundles the texts of a bounded sample of labelled rows, each scaled to length one. A document
gets the language whose prototype has the largest cosine with its vector.

Letters are lower-cased; runs of anything else count as one space, also at both ends. The bundling is a product of
two matrices, n-gram counts of a slice of documents by the vectors of the n-grams which that slice holds: integers
below 2^24 in float32, hence exact and the same on any machine and in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import as_array, flat, ship, slices, tidied

DIM = 1024
ORDER = 3
#: Labelled rows of each language that make its prototype: those with the least hash of doc_id.
FIT_ROWS = 400
#: A document is rejected below this cosine, or if its best language leads the next by less than this.
MIN_COSINE, MIN_LEAD = 0.08, 0.005
SPACE = 32
GRAMS = 6000

RESULT = "doc_id long, lang string, predicted string, cosine double, lead double, accepted boolean"


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point the letter that it counts as."""
    to = np.full(0x110000, SPACE, np.int32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()
            to[c] = ord(low) if len(low) == 1 else c
    return to


@lru_cache(1 << 14)
def letter_vector(c: int, dim: int) -> np.ndarray:
    return (np.random.default_rng([c, 77]).integers(0, 2, dim) * 2 - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray, dim: int) -> np.ndarray:
    """Of n-grams, rows of letters: their vectors."""
    out = None
    n = grams.shape[1]
    for k in range(n):
        found, at = np.unique(grams[:, k], return_inverse=True)
        table = np.stack([np.roll(letter_vector(int(c), dim), n - 1 - k) for c in found])
        part = table[at.reshape(-1)]
        out = part if out is None else out * part
    return out


def text_vectors(data: np.ndarray, off: np.ndarray, dim: int = DIM, order: int = ORDER) -> np.ndarray:
    """The bundled vectors, one row a document of the slice; zeros where there is no n-gram."""
    n = len(off) - 1
    out = np.zeros((n, dim), np.float64)
    whole = data[off[0] : off[-1]]
    if not len(whole):
        return out
    codes = np.frombuffer(whole.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starting = (whole & 0xC0) != 0x80
    chars = np.r_[0, np.cumsum(starting)]
    if chars[-1] != len(codes):  # not UTF-8: count document by document
        codes = np.concatenate([np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(off, off[1:])])
        lens = [len(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(off, off[1:])]
        coff = np.r_[0, np.cumsum(lens)]
    else:
        coff = chars[off - off[0]]
    full = np.diff(coff)
    # a space before and after each document
    seq = np.full(len(codes) + 2 * n, SPACE, np.int32)
    doc = np.repeat(np.arange(n), full + 2)
    seq[np.arange(len(codes)) + 2 * np.repeat(np.arange(n), full) + 1] = letters()[codes]
    keep = np.r_[True, ~((seq[1:] == SPACE) & (seq[:-1] == SPACE) & (doc[1:] == doc[:-1]))]
    seq, doc = seq[keep], doc[keep]
    if len(seq) < order:
        return out
    present = np.zeros(0x110000, bool)
    present[seq] = True
    alphabet = np.flatnonzero(present)
    m = len(alphabet)
    compact = np.zeros(0x110000, np.int32)
    compact[alphabet] = np.arange(m, dtype=np.int32)
    seq = compact[seq]
    same = doc[order - 1 :] == doc[: len(doc) - order + 1]
    kind = np.int32 if m**order < 1 << 31 else np.int64
    code = np.zeros(len(seq) - order + 1, kind)
    for k in range(order):
        code = code * kind(m) + seq[k : len(seq) - order + 1 + k]
    code, doc = code[same], doc[: len(same)][same]
    if not len(code):
        return out
    if m**order <= 4_000_000:
        seen = np.zeros(m**order, bool)
        seen[code] = True
        found = np.flatnonzero(seen)
        to = np.zeros(m**order, np.int32)
        to[found] = np.arange(len(found))
        at = to[code]
    else:
        found, at = np.unique(code, return_inverse=True)
    grams = np.stack([alphabet[found // m ** (order - 1 - k) % m] for k in range(order)], axis=1)
    u = len(found)
    for lo in range(0, u, GRAMS):
        hi = min(u, lo + GRAMS)
        mine = slice(None) if u <= GRAMS else (at >= lo) & (at < hi)
        counts = np.bincount(doc[mine].astype(np.int64) * (hi - lo) + at[mine] - lo, minlength=n * (hi - lo)).reshape(n, hi - lo)
        out += counts.astype(np.float32) @ gram_vectors(grams[lo:hi], dim).astype(np.float32)
    return out


def _cosines(v: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1)
    return np.round((v @ prototypes.T) / np.where(norm > 0, norm, 1)[:, None], 9)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, dim: int = DIM, order: int = ORDER) -> tuple[list[str], np.ndarray]:
    """(languages, their prototypes of length one) from at most ``fit_rows`` rows of each label.

    Rows without a label, id or text don't count. The sample is chosen from the id and label columns alone; the
    driver gets one vector a language. Ids are taken to be the rows' own: all texts of a chosen id are bundled, for the
    label that sorts last where it has several. An empty table gives no languages."""
    spark = docs.sparkSession
    ship(spark)
    key = F.xxhash64(F.col("id"))
    labelled = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{lang_col}`"].alias("lang")).filter("id is not null and lang is not null")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(key, "id"))
    picked: dict[str, list[int]] = {}
    for i, x in labelled.withColumn("nth", nth).filter(F.col("nth") <= fit_rows).select("id", "lang").collect():
        picked.setdefault(x, []).append(i)
    names = sorted(picked)
    lang_of = {i: k for k, x in enumerate(names) for i in picked[x]}
    if not lang_of:
        return [], np.zeros((0, dim))
    ids = spark.createDataFrame([(i, k) for i, k in lang_of.items()], "id long, k int")
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("string").alias("t")).filter("t is not null").join(F.broadcast(ids), "id").select("k", "t")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_rows = np.zeros((len(names), dim)), False
        for b in batches:
            any_rows |= b.num_rows > 0
            k = as_array(b.column(0)).to_numpy(zero_copy_only=False)
            data, off, _ = flat(b.column(1))
            for i, j in slices(off, rows=256):
                v = text_vectors(data, off[i : j + 1], dim, order)
                norm = np.linalg.norm(v, axis=1)
                np.add.at(sums, k[i:j], np.round(v / np.where(norm > 0, norm, 1)[:, None] * (1 << 40)))  # whole numbers: any order of adding gives the same
        if any_rows:  # most tasks hold no row of the sample and send nothing
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    sums = np.zeros((len(names), dim))
    for r in rows.mapInArrow(tidied(bundle), "sums binary").collect():
        sums += np.frombuffer(r[0], np.float64).reshape(sums.shape)
    norm = np.linalg.norm(sums, axis=1)
    some = norm > 0
    return [x for x, y in zip(names, some) if y], sums[some] / norm[some, None]


def _judge(texts: pa.Array, names: list[str], prototypes: np.ndarray, dim: int, order: int, min_cosine: float, min_lead: float):
    data, off, valid = flat(texts)
    best, cosine, lead = [], [], []
    for i, j in slices(off, rows=256):
        v = text_vectors(data, off[i : j + 1], dim, order)
        if not names:
            c = np.zeros((j - i, 1))
        else:
            c = _cosines(v, prototypes)
        b = np.argmax(c, axis=1)
        top = c[np.arange(j - i), b]
        rest = c.copy()
        rest[np.arange(j - i), b] = -1
        best.append(np.where(v.any(axis=1) if names else False, b, -1))
        cosine.append(top)
        lead.append(top - rest.max(axis=1) if c.shape[1] > 1 else np.ones(j - i))
    z = lambda x, k: np.concatenate(x).astype(k) if x else np.zeros(0, k)
    best, cosine, lead = z(best, np.int64), z(cosine, float), z(lead, float)
    best[~valid] = -1
    known = best >= 0
    accepted = known & (cosine >= min_cosine) & (lead >= min_lead)
    return best, known, cosine, lead, accepted


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: tuple[list[str], np.ndarray] | None = None, dim: int = DIM, order: int = ORDER, min_cosine: float = MIN_COSINE, min_lead: float = MIN_LEAD) -> DataFrame:
    """One row a document: its label, the predicted language, the cosine with that prototype, the lead over the next,
    and whether the prediction is accepted. No shuffle: one pass over id, text and label after ``fit``.

    A text that is null, empty or without letters has no n-gram but of spaces: it gets a null language, null
    figures, and isn't accepted. Of equal cosines the language that sorts first wins. Rows with the same id are
    judged each by itself. Without any labelled row, no document is accepted. A null id is carried along."""
    ship(docs.sparkSession)
    names, prototypes = model or fit(docs, id_col, text_col, lang_col, dim=dim, order=order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, known, cosine, lead, accepted = _judge(b.column(2), names, prototypes, dim, order, min_cosine, min_lead)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    b.column(1),
                    pa.array([names[k] if k >= 0 else None for k in best], pa.string()),
                    pa.array(cosine, pa.float64(), mask=~known),
                    pa.array(lead, pa.float64(), mask=~known),
                    pa.array(accepted, pa.bool_()),
                ],
                names=["doc_id", "lang", "predicted", "cosine", "lead", "accepted"],
            )

    src = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{lang_col}`"].cast("string").alias("lang"), docs[f"`{text_col}`"].cast("string").alias("text"))
    return src.mapInArrow(tidied(run), RESULT)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: tuple[list[str], np.ndarray] | None = None, min_cosine: float = MIN_COSINE, min_lead: float = MIN_LEAD) -> DataFrame:
    """The accepted documents with all their columns, decided in the one pass that copies them.

    Which are accepted is as in ``identify``: null, empty and letterless texts go, as do texts between two languages;
    rows with the same id are judged each by itself, equal rows alike, and a null id or label doesn't matter. Other columns are carried
    along whatever their names and nulls; an empty table stays empty."""
    ship(docs.sparkSession)
    names, prototypes = model or fit(docs, id_col, text_col, lang_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *_, accepted = _judge(b.column(at), names, prototypes, DIM, ORDER, min_cosine, min_lead)
            yield b.filter(pa.array(accepted))

    return docs.mapInArrow(tidied(run), docs.schema)
