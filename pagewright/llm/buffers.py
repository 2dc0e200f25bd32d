"""Arrow string columns as flat numpy buffers, and the packed shuffle that several operators share.

Every operator works on slices of whole documents of about ``SLICE`` bytes, so a Python worker's memory doesn't
depend on the size of an Arrow batch (one document longer than that is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, write_file

SLICE = 1 << 20
U64 = np.uint64


def _trimmer():  # noqa: ANN202
    """glibc's call that hands freed memory back to the system; nothing where there is no such call."""
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def tidied(f):  # noqa: ANN001, ANN201
    """A function over batches that gives memory back when its task ends: workers are used again and again, by tasks of other
    stages, and several live side by side in an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trimmer()(0)

    return run


def as_array(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column; a null has no bytes."""
    col = as_array(col)
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, ob, db = col.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(ob, kind, n + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(db, np.uint8) if db is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if not col.null_count else col.is_valid().to_numpy(zero_copy_only=False)
    return data, off, valid


def ids_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(int64 values, valid) of an id column; a null reads as the largest id, so it never comes first."""
    col = as_array(col)
    valid = col.is_valid().to_numpy(zero_copy_only=False) if col.null_count else np.ones(len(col), bool)
    if not pa.types.is_int64(col.type):
        col = col.cast(pa.int64())
    if col.null_count:
        col = col.fill_null(np.iinfo(np.int64).max)
    return col.to_numpy(zero_copy_only=False).astype(np.int64, copy=False), valid


def slices(off: np.ndarray, limit: int = SLICE, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def segment_of(starts: np.ndarray, n: int) -> np.ndarray:
    """For positions 0..n-1 the index of the segment that holds each; ``starts`` may repeat (empty segments)."""
    mark = np.zeros(n + 1, np.int32)
    mark += np.bincount(starts[1:], minlength=n + 1)[: n + 1].astype(np.int32)
    return np.cumsum(mark[:n], dtype=np.int32)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    p = np.empty(max(n, 1), U64)
    p[0] = 1
    if n > 1:
        p[1:] = BASE
        np.multiply.accumulate(p, out=p)
    return p


#: Bytes that are hashed as one block, and a random number for each byte value at each place in it.
HASH_BLOCK = 64
_CELL = np.random.default_rng(64).integers(0, 1 << 64, HASH_BLOCK * 256, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], spans ordered and disjoint. A block of 64 bytes is the mixed sum of the
    random numbers of its bytes at their places, and a span the mixed sum of its blocks, each mixed with its number, so
    no pattern of repeats makes sums meet as it does with a polynomial of a power of two."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    out = np.zeros(len(starts), U64)
    short = (lens > 0) & (lens <= HASH_BLOCK)
    if short.any():  # one block
        out[short] = mix(_block_sums(data, starts[short], lens[short]) + BASE)
    long = np.flatnonzero(lens > HASH_BLOCK)
    if len(long):
        s, length = starts[long], lens[long]
        blocks = (length + HASH_BLOCK - 1) // HASH_BLOCK
        span = np.repeat(np.arange(len(s)), blocks)
        number = np.arange(len(span)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        sums = _block_sums(data, s[span] + number * HASH_BLOCK, np.minimum(length[span] - number * HASH_BLOCK, HASH_BLOCK))
        out[long] = np.add.reduceat(mix(sums + (number + 1).astype(U64) * BASE), np.cumsum(blocks) - blocks)
    return mix(out + lens.astype(U64) * U64(0xD6E8FEB86659FD93))


def _block_sums(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The sums of the random numbers of the bytes of blocks, none of them empty or longer than ``HASH_BLOCK``."""
    first = np.cumsum(lens) - lens
    place = np.arange(int(first[-1] + lens[-1]), dtype=np.int64)
    cell = place - np.repeat(first, lens)
    place += np.repeat(starts - first, lens)
    cell <<= 8
    cell |= data[place]
    return np.add.reduceat(_CELL[cell], first)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    lens = ends - starts
    some = lens > 0
    s, length = starts[some], lens[some]
    if not len(s):
        return np.zeros(0, np.uint8)
    where = np.ones(int(length.sum()), np.int64)
    where[0] = s[0]
    at = np.cumsum(length[:-1])
    where[at] = s[1:] - (s[:-1] + length[:-1]) + 1
    return data[np.cumsum(where)]


def string_array(data: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    n = len(off) - 1
    mask = None
    if valid is not None and not valid.all():
        mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), n, [mask, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def archive() -> bytes:
    """This package as a zip archive."""
    import io
    import os
    import zipfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: on one machine from where the driver has it, on a cluster as an archive
    in the shared folder, which executors fetch."""
    import os

    sc = spark.sparkContext
    if sc.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        env = sc.environment
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    elif getattr(sc, "_pagewright_shipped", None) is None:
        path = f"{ensure_checkpoint_dir(spark)}/pagewright.zip"
        write_file(spark, path, archive())
        sc.addPyFile(path)
        sc._pagewright_shipped = path


#: Bytes of files that make one shard of a packed shuffle; a shard's records are held by one Python worker.
SHARD_BYTES = 8 << 20


def input_bytes(df: DataFrame) -> int | None:
    """The size of what a frame is read from, as its sources tell it without a job; None if one of them doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return sum(sizes) if all(x < 1 << 60 for x in sizes) else None


def shards_of(docs: DataFrame) -> tuple[int, int]:
    """(shards, partitions) of a packed shuffle of what is in ``docs``: both follow its size, so that a shard's records
    stay a few MB whatever the size of the corpus; four shards to a partition make these even. Where the
    sources don't tell their size, that of the rows is added up."""
    spark = docs.sparkSession
    size = input_bytes(docs)
    if size is None:
        strings = [c for c, t in docs.dtypes if t == "string"]
        size = docs.agg(F.sum(F.lit(8) + sum((F.coalesce(F.octet_length(docs[f"`{c}`"]), F.lit(0)) for c in strings), F.lit(0))).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (4 * SHARD_BYTES)))
    return 4 * parts, parts


def packed_groups(df: DataFrame, parts: int):
    """Groups of shards over as many partitions as their number asks for."""
    return df.repartition(parts, "shard").groupBy("shard")


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


PACKED = "shard int, kind int, packed binary"


def pack(shard: np.ndarray, columns: list[np.ndarray], kind: int = 0) -> pa.RecordBatch:
    """One row per shard present: the columns of its records, each as one run of bytes, behind their count. ``kind``
    tells records of different columns apart."""
    order = np.argsort(shard, kind="stable")
    sh = shard[order]
    cuts = np.flatnonzero(np.r_[True, sh[1:] != sh[:-1]]) if len(sh) else np.zeros(0, np.int64)
    cols = [c[order] for c in columns]
    ends = np.r_[cuts[1:], len(sh)]
    blobs = [np.int64(e - s).tobytes() + b"".join(c[s:e].tobytes() for c in cols) for s, e in zip(cuts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(sh[cuts].astype(np.int32), pa.int32()), pa.array(np.full(len(cuts), kind, np.int32)), pa.array(blobs, pa.binary())], names=["shard", "kind", "packed"])


def unpack(blobs: pa.ChunkedArray | pa.Array, kinds: list) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in blobs:
        raw = b.as_buffer()
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        at = 8
        for i, kind in enumerate(kinds):
            parts[i].append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]


def of_kind(t: pa.Table, kind: int) -> pa.ChunkedArray:
    """The blobs of a kind in a shard's table."""
    return t.column("packed").filter(pc.equal(t.column("kind"), kind))


def narrow(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, by exact name, so that other columns can't clash."""
    return df.select(*[df[f"`{c}`"] for c in cols])
