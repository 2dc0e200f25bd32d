"""Document fingerprints that add up: a homomorphic multiset hash.

A paragraph (a line, without white space at its ends; empty ones don't count) is hashed to a vector of 32 numbers of
32 bits: block j of 8 numbers is SHA-256 of the paragraph's SHA-256, ":" and j. A document's fingerprint is the sum
of its paragraphs' vectors, each number modulo 2^32, so it doesn't depend on their order, repeats count, and a
paragraph can be added or taken away without reading the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import flat, ship, slices, tidied

BLOCKS = 4
LANES = 8 * BLOCKS
RESULT = "doc_id long, n_paragraphs int, fingerprint string"
_ENDS = b" \t\r"
_TAILS = [b":%d" % j for j in range(BLOCKS)]


def vectors(paragraphs: list[bytes]) -> np.ndarray:
    """One row of 32 numbers for each paragraph."""
    parts = []
    for p in paragraphs:
        h = sha256(p).hexdigest().encode()
        for t in _TAILS:
            parts.append(sha256(h + t).digest())
    return np.frombuffer(b"".join(parts), ">u4").reshape(-1, LANES).astype(np.uint64)


def paragraphs_of(raw: bytes) -> list[bytes]:
    return [p for x in raw.split(b"\n") if (p := x.strip(_ENDS))]


def to_hex(lanes: np.ndarray) -> str:
    return (lanes & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint64)


def of_text(text: str) -> str:
    found = paragraphs_of(text.encode())
    return to_hex(vectors(found).sum(axis=0, dtype=np.uint64) if found else np.zeros(LANES, np.uint64))


def insert(fingerprint: str, paragraph: str) -> str:
    """The fingerprint of a document that has one paragraph more (or several, given as lines)."""
    return to_hex(from_hex(fingerprint) + from_hex(of_text(paragraph)))


def delete(fingerprint: str, paragraph: str) -> str:
    """The fingerprint of a document that has one paragraph less (or several, given as lines)."""
    return to_hex(from_hex(fingerprint) + (np.uint64(1 << 32) - from_hex(of_text(paragraph))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_paragraphs and fingerprint (256 hexadecimal digits). No shuffle.

    A null text has a null fingerprint and 0 paragraphs; one without paragraphs has the sum of nothing, all zeros.
    Rows with the same id each have their own; other columns aren't read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, valid = flat(b.column(1))
            prints: list[str | None] = []
            n: list[int] = []
            for i, j in slices(off):
                raw = data[off[i] : off[j]].tobytes()
                own = (off[i : j + 1] - off[i]).tolist()
                found = [paragraphs_of(raw[s:e]) for s, e in zip(own, own[1:])]
                counts = [len(x) for x in found]
                sums = np.zeros((j - i, LANES), np.uint64)
                rows = np.repeat(np.arange(j - i), counts)
                if len(rows):
                    some, first = np.unique(rows, return_index=True)
                    sums[some] = np.add.reduceat(vectors([p for x in found for p in x]), first, axis=0)
                text = to_hex(sums)
                prints += [text[k * 8 * LANES : (k + 1) * 8 * LANES] if v else None for k, v in enumerate(valid[i:j])]
                n += counts
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(prints, pa.string())], names=["doc_id", "n_paragraphs", "fingerprint"])

    return docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text")).mapInArrow(tidied(run), RESULT)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The sum (or, with sign -1, the difference) of two fingerprint columns, without leaving the JVM."""
    lane = lambda c, i: F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long")
    return F.concat(*[F.lpad(F.lower(F.hex(F.pmod(lane(a, i) + F.lit(sign) * lane(b, i), F.lit(1 << 32)))), 8, "0") for i in range(LANES)])


ORACLE = """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL),
     p AS (SELECT doc_id, sha256(trim(raw, ' ' || chr(9) || chr(13))) AS h FROM l WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''),
     b AS (SELECT doc_id, j, sha256(h || ':' || j) AS d FROM p, range(4) t(j)),
     s AS (SELECT doc_id, j, i, sum(CAST('0x' || substr(d, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) % 4294967296 AS v FROM b, range(8) t(i) GROUP BY doc_id, j, i),
     f AS (SELECT doc_id, string_agg(printf('%08x', CAST(v AS BIGINT)), '' ORDER BY j, i) AS fingerprint FROM s GROUP BY doc_id),
     n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS INTEGER) AS n_paragraphs,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(f.fingerprint, repeat('0', 256)) END AS fingerprint
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN n USING (doc_id)
"""
