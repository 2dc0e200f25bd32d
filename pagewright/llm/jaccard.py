"""Documents whose sets of word n-grams have a Jaccard similarity of THRESHOLD or more: their classes and numbers of links
(``classes``), all pairs of them (``jaccard_pairs``), or one of each class (``keep_one``).

1. One pass makes each document's MinHash values and a digest of its set. Documents with equal sets are one set from
   here on, so that copies cost nothing more. 16 bits of a value are kept: different ones look equal once in 65,536
   times, which can add a candidate and lose none.
2. Sets that agree in all values of a band meet in a bucket; buckets go to shards, packed. Buckets with the same least
   set are compared in one shard, so that a set's values travel about once for each group of similar sets. A bucket of more than
   ``BLOCK`` sets is numbered in blocks there, and its members are copied to the pairs of blocks only after they have met their
   values, where they are spread over all tasks. Each pair of blocks is compared by itself, so no bucket is cut and
   none is held as a whole.
3. Bayesian pruning: the values of a pair are compared ``STEP`` at a time. With m of n equal, and any similarity
   taken as equally likely at first, the similarity has the posterior Beta(m + 1, n - m + 1); a pair is dropped when
   its chance of reaching the threshold falls below ``TOLERANCE``. A pair is looked at in the first band in which it
   agrees and in no other.
4. The rest are verified exactly, on their full sets of 64-bit n-gram hashes. Pairs are verified where the least
   partner of their lesser member leads, so that a set travels about once for each group of similar sets. Unless pairs
   are asked for, a task gives a row for each of its sets, not for each pair: what it is linked with, and how often.

A word is a run of ASCII letters and digits and of characters beyond ASCII, in lower case. A document of fewer words
than N has one n-gram of all its words; one without words has an empty set and no partners.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .buffers import PACKED, U64, as_array, flat, fresh, mix, pack, packed_groups, shards_of, ship, slices, span_hashes, tidied, unpack

N = 3
THRESHOLD = 0.55
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-3
BLOCK = 2048
#: Ids are broadcast up to so many; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Tasks know the ids that have candidates up to so many (8 bytes each); beyond, texts are shuffled to meet them.
FILTER_ROWS = 8_000_000
PAIRS = 200_000

_r = np.random.default_rng(99)
_A = (_r.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _r.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = U64(0x9E3779B97F4A7C15)
_SPREAD = np.uint32(0x9E3779B1)
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _WORD[_c] = True


def ngrams(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents) of the distinct n-grams of documents in lower case, ordered by document."""
    lo, hi = int(off[0]), int(off[-1])
    docs = len(off) - 1
    if hi == lo:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    w = _WORD[data[lo:hi]]
    first = np.zeros(hi - lo + 1, bool)
    first[off - lo] = True
    before = np.r_[False, w[:-1]]
    starts = np.flatnonzero(w & (~before | first[:-1])) + lo
    ends = np.flatnonzero(w & np.r_[~w[1:] | first[1:-1], True]) + lo + 1
    h = span_hashes(data, starts, ends)
    doc = np.searchsorted(off, starts, "right") - 1
    count = np.bincount(doc, minlength=docs)
    grams = np.zeros(max(len(h) - n + 1, 0), U64)
    for k in range(n):
        grams = grams * _ODD + mix(h[k : len(h) - n + 1 + k] + U64(k)) if len(grams) else grams
    same = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
    g, d = mix(grams[same]), doc[: len(grams)][same]
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        at = np.r_[0, np.cumsum(count)]
        extra = []
        for x in few:
            v = U64(0)
            with np.errstate(over="ignore"):
                for k in range(count[x]):
                    v = v * _ODD + mix(h[at[x] + k : at[x] + k + 1] + U64(k))[0]
            extra.append(v + U64(count[x]))
        g, d = np.r_[g, mix(np.array(extra, U64))], np.r_[d, few]
        order = np.argsort(d, kind="stable")
        g, d = g[order], d[order]
    _, one = np.unique(g + mix(d.astype(U64) + U64(7)), return_index=True)
    one.sort()
    return g[one], d[one]


def lower(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return flat(pc.utf8_lower(as_array(texts)))


def signatures(g: np.ndarray, d: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, a second one, number of n-grams, MinHash values) of each document."""
    digest, second, count = _digests(g, d, docs)
    values = np.zeros((docs, HASHES), np.uint32)
    some = np.flatnonzero(count)
    if len(some):
        at = np.r_[0, np.cumsum(count[some])[:-1]]
        x = (g >> U64(32)).astype(np.uint32)
        for k in range(HASHES):
            values[some, k] = np.minimum.reduceat(x * _A[k] + _B[k], at)
    return digest, second, count, (values * _SPREAD >> np.uint32(16)).astype(np.uint16)


def _signed(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, _ = lower(b.column(1))
            for i, j in slices(off):
                g, d = ngrams(data, off[i : j + 1], n)
                digest, second, count, values = signatures(g, d, j - i)
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).take(pa.array(some)), pa.array(digest[some]), pa.array(second[some]), pa.array([v.tobytes() for v in values[some]], pa.binary())],
                    names=["doc", "digest", "second", "sig"],
                )

    src = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc"), docs[f"`{text_col}`"].cast("string").alias("t")).filter("doc is not null and t is not null")
    return src.mapInArrow(tidied(run), "doc long, digest long, second long, sig binary")


def least_matches(threshold: float, tolerance: float = TOLERANCE, step: int = STEP, hashes: int = HASHES) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped): P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in [*range(step, hashes, step), hashes]:
        p, m = 0.0, 0
        while (p := p + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append((n, m))
    return out


def _bands(values: np.ndarray) -> np.ndarray:
    v = values.reshape(len(values), BANDS, ROWS)
    key = np.zeros((len(values), BANDS), U64)
    for k in range(ROWS):
        key = key * _ODD + v[:, :, k].astype(U64)
    return mix(key + np.arange(BANDS, dtype=U64) * U64(0x632BE59BD9B4E019))


def _values(col: pa.Array) -> np.ndarray:
    data, off, _ = flat(col)
    return data[off[0] : off[-1]].view(np.uint16).reshape(-1, HASHES) if len(off) > 1 else np.zeros((0, HASHES), np.uint16)


def _members(sets: DataFrame, shards: int, parts: int, block: int) -> DataFrame:
    """The members of buckets of two sets or more: (bucket, band, rep), the bucket's least set, and the number of its block
    and of the bucket's blocks."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep = as_array(b.column(0)).to_numpy(zero_copy_only=False)
            keys = _bands(_values(b.column(1))).ravel()
            yield pack((keys % U64(shards)).astype(np.int32), [keys, np.repeat(rep, BANDS), np.tile(np.arange(BANDS, dtype=np.uint8), len(rep))])

    def answer(t: pa.Table) -> pa.Table:
        key, rep, band = unpack(t.column("packed"), [U64, np.int64, np.uint8])
        order = np.lexsort((rep, key))
        key, rep, band = key[order], rep[order], band[order]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[cut, len(key)])
        place = np.arange(len(key)) - np.repeat(cut, size)
        blocks, lead = np.repeat(-(-size // block), size), np.repeat(rep[cut], size)
        good = np.repeat(size > 1, size)
        return pa.table({"bucket": pa.array(key[good].view(np.int64)), "band": pa.array(band[good].astype(np.int32)), "rep": pa.array(rep[good]), "lead": pa.array(lead[good]), "own": pa.array((place // block)[good].astype(np.int32)), "blocks": pa.array(blocks[good].astype(np.int32))})

    return packed_groups(sets.mapInArrow(tidied(send), PACKED), parts).applyInArrow(answer, "bucket long, band int, rep long, lead long, own int, blocks int")


def _enumerate(task: np.ndarray, side: np.ndarray, limit: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs to compare, of rows ordered by (task, side), about ``limit`` at a time."""
    cut = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
    left, right, held = [], [], 0
    for s, e in zip(cut.tolist(), np.r_[cut[1:], len(task)].tolist()):
        k = s + int(np.searchsorted(side[s:e], 1))
        for i in range(s, k if k < e else e - 1):
            lo = k if k < e else i + 1
            left.append(np.full(e - lo, i))
            right.append(np.arange(lo, e))
            held += e - lo
            if held >= limit:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _candidates(members: DataFrame, sets: DataFrame, shards: int, parts: int, threshold: float, tolerance: float) -> DataFrame:
    """(a, b), a < b, of the pairs of sets that pruning leaves. Small buckets are compared a shard at a time; a pair of
    blocks of a large one is a group of its own, of at most twice ``BLOCK`` sets. A set comes to a shard once, with all
    that it is a member of there."""
    steps = least_matches(threshold, tolerance)

    def compare(t: pa.Table) -> pa.Table:
        values, lists = _values(as_array(t.column("sig"))), as_array(t.column("at"))
        get = lambda c: pc.struct_field(lists.flatten(), c).to_numpy(zero_copy_only=False)
        task, band, side = get("task"), get("band"), get("side")
        rep = as_array(t.column("rep")).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(rep)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        order = np.lexsort((rep[row], side, task))
        task, band, side, row = task[order], band[order], side[order], row[order]
        keys = _bands(values)
        earlier = np.arange(BANDS)
        out = []
        for i, j in _enumerate(task, side):
            first = band[i]
            i, j = row[i], row[j]
            agree = keys[i] == keys[j]
            new = ~(agree & (earlier < first[:, None])).any(axis=1)
            i, j = i[new], j[new]
            same, at = np.zeros(len(i), np.int64), 0
            for n, least in steps:
                same += (values[i, at:n] == values[j, at:n]).sum(axis=1)
                at = n
                live = same >= least
                i, j, same = i[live], j[live], same[live]
            out.append((np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])))
        a, b = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    near = F.when(F.col("shard") < shards, F.pmod("lead", F.lit(shards))).otherwise(F.col("shard"))
    tasks = _tasks(members, shards).withColumn("shard", near).repartition("rep")
    lists = tasks.groupBy("rep", "shard").agg(F.collect_list(F.struct("task", "band", "side")).alias("at"))
    return packed_groups(lists.join(sets, "rep").select("rep", "shard", "at", "sig"), parts).applyInArrow(compare, "a long, b long")


def _tasks(rows: DataFrame, shards: int) -> DataFrame:
    """Members of buckets (with whatever else they carry) copied to the tasks they take part in: task, side (1 is to be
    compared with 0) and shard, which is a group of small buckets or one pair of blocks."""
    more = [c for c in rows.columns if c not in ("bucket", "own", "blocks")]
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("bucket", "own", "blocks", *more, other.alias("other"))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    task = F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", lo, hi))
    shard = F.when(F.col("blocks") == 1, F.pmod("bucket", F.lit(shards))).otherwise(F.lit(shards) + F.pmod(task, F.lit(1 << 62)))
    return rows.select(task.alias("task"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), *more, shard.alias("shard"))


def _verified(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, shards: int, parts: int, block: int, linked: bool) -> DataFrame:
    """(a, b, jaccard) of the candidate pairs that reach the threshold; if ``linked``, of each task's sets that are in such
    a pair (rep, root, links): the least set that these pairs connect it with, and its partners' documents."""
    both = pairs.select(F.col("a").alias("rep"), F.col("a").alias("o")).unionAll(pairs.select(F.col("b"), F.col("a")))
    hub = both.groupBy("rep").agg(F.min("o").alias("hub"))
    # a hub's pairs are one task, or as many as there are pairs of blocks of its sets
    sized = pairs.join(hub.withColumnRenamed("rep", "a"), "a")
    size = sized.groupBy("hub").agg(F.approx_count_distinct("b").alias("n"))
    part = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col("n") / F.lit(block)))
    task = F.xxhash64("hub", part("a"), part("b"))
    # hubs with few sets share a shard; a pair of blocks of a large one is a group of its own
    shard = F.when(F.col("n") <= block, F.pmod(task, F.lit(shards))).otherwise(F.lit(shards) + F.pmod(task, F.lit(1 << 62)))
    tasks = sized.join(size, "hub").select("a", "b", shard.alias("shard")).checkpoint()
    need = tasks.select("shard", F.col("a").alias("rep")).unionAll(tasks.select("shard", F.col("b"))).distinct()
    ids = need.groupBy("rep").agg(F.collect_list("shard").alias("shards")).join(sizes, "rep").select("doc", "rep", "owners", "shards").checkpoint()
    many = ids.count()
    src = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc"), docs[f"`{text_col}`"].cast("string").alias("t")).filter("doc is not null and t is not null")
    # texts aren't shuffled for their ids' sake, short of ``FILTER_ROWS``
    held = docs.sparkSession.sparkContext.broadcast(np.sort(as_array(ids.select("doc").toArrow().column(0)).to_numpy())) if many <= FILTER_ROWS else None

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if held is not None:
                doc, known = as_array(b.column(0)).to_numpy(zero_copy_only=False), held.value
                b = b.take(pa.array(np.flatnonzero(np.searchsorted(known, doc, "right") > np.searchsorted(known, doc))))
            data, off, _ = lower(b.column(1))
            for i, j in slices(off):
                g, d = ngrams(data, off[i : j + 1], n)
                at = np.searchsorted(d, np.arange(j - i + 1))
                digest, second, count = _digests(g, d, j - i)
                some = np.flatnonzero(count)
                grams = pa.array([np.sort(g[at[k] : at[k + 1]]).tobytes() for k in some.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(some)), pa.array(digest[some]), pa.array(_told_apart(digest, second)[some]), grams], names=["doc", "plain", "mixed", "grams"])

    near = src if held is not None else src.join(ids.select("doc"), "doc", "left_semi")
    full = near.mapInArrow(tidied(gather), "doc long, plain long, mixed long, grams binary").join(F.broadcast(ids) if many <= BROADCAST_ROWS else ids, "doc")
    full = full.filter("rep = plain or rep = mixed").select(F.explode("shards").alias("shard"), "rep", "owners", "grams")

    def verify(p: pa.Table, s: pa.Table) -> pa.Table:
        rep, owners = s.column("rep").to_numpy(), s.column("owners").to_numpy()
        a, b, out = jaccards(p.column("a").to_numpy(), p.column("b").to_numpy(), rep, as_array(s.column("grams")), threshold)
        if not linked:
            return pa.table({"a": pa.array(a), "b": pa.array(b), "jaccard": pa.array(out)})
        rep, one = np.unique(rep, return_index=True)
        x, y, owners = np.searchsorted(rep, a), np.searchsorted(rep, b), owners[one]
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, x, owners[y])
        np.add.at(links, y, owners[x])
        some = np.flatnonzero(links)
        return pa.table({"rep": pa.array(rep[some]), "root": pa.array(rep[roots(x, y, len(rep))[some]]), "links": pa.array(links[some])})

    return packed_groups(tasks, parts).cogroup(packed_groups(full, parts)).applyInArrow(verify, "rep long, root long, links long" if linked else "a long, b long, jaccard double")


def roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least node that the edges (x, y) connect each of the nodes 0..n-1 with."""
    root = np.arange(n)
    while len(x):
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return root


def jaccards(a: np.ndarray, b: np.ndarray, rep: np.ndarray, grams: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (a, b) of sets, given as packed n-gram hashes, those that reach the threshold: (a, b, jaccard). The
    n-grams are numbered, each a marks its own, and all its partners read the marks at once."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(a) or not len(rep):
        return none
    rep, one = np.unique(rep, return_index=True)
    grams = grams.take(pa.array(one))
    data, off, _ = flat(grams)
    size = np.diff(off) // 8
    first = np.r_[0, np.cumsum(size)]
    distinct, number = np.unique(np.frombuffer(data[off[0] : off[-1]].tobytes(), U64), return_inverse=True)
    x, y = np.searchsorted(rep, a), np.searchsorted(rep, b)
    near = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])
    x, y = x[near], y[near]
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    common = np.zeros(len(x), np.int64)
    mark = np.zeros(len(distinct), bool)
    cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    for s, e in zip(cut.tolist(), np.r_[cut[1:], len(x)].tolist()):
        own = number[first[x[s]] : first[x[s] + 1]]
        mark[own] = True
        for i in range(s, e, 256):
            them = y[i : min(i + 256, e)]
            n = size[them]
            at = np.cumsum(n) - n
            where = np.arange(int(n.sum())) + np.repeat(first[them] - at, n)
            common[i : i + len(them)] = np.add.reduceat(mark[number[where]].astype(np.int32), at)
        mark[own] = False
    share = common / (size[x] + size[y] - common) if len(x) else np.zeros(0)
    good = share >= threshold
    return rep[x[good]], rep[y[good]], share[good]


def _digests(g: np.ndarray, d: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, a second one, number of n-grams) of each document's set."""
    count = np.bincount(d, minlength=docs)
    digest, second = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    some = np.flatnonzero(count)
    if len(some):
        at = np.r_[0, np.cumsum(count[some])[:-1]]
        digest[some] = mix(np.add.reduceat(mix(g), at) + count[some].astype(U64)).view(np.int64)
        second[some] = np.add.reduceat(mix(g * _ODD + U64(1)), at).view(np.int64)
    return digest, second, count


def _told_apart(digest: np.ndarray, second: np.ndarray) -> np.ndarray:
    """What stands for a set whose digest is that of another set as well."""
    return mix(digest.view(U64) ^ mix(second.view(U64))).view(np.int64)


def _owned(docs: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(digests of sets and their values: digest, sig, a row for each document; the documents of each set: doc, rep)."""
    spark = docs.sparkSession
    ship(spark)
    ensure_checkpoint_dir(spark)
    signed = _signed(docs, id_col, text_col, n).checkpoint()
    clash = [r["digest"] for r in signed.groupBy("digest").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).filter("lo <> hi").select("digest").collect()]
    if clash:  # different sets with one digest, which take two digests to tell apart: none but by chance in far more than 10^9 sets
        apart = F.pandas_udf(lambda d, s: pd.Series(_told_apart(d.to_numpy(), s.to_numpy())), "long")
        signed = signed.withColumn("digest", F.when(F.col("digest").isin(clash), apart("digest", "second")).otherwise(F.col("digest"))).checkpoint()
    return signed, signed.select("doc", F.col("digest").alias("rep")).distinct().checkpoint()


def _similar(signed: DataFrame, owners: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, tolerance: float, block: int, linked: bool) -> DataFrame:
    """What ``_verified`` gives of the sets of documents."""
    shards, parts = shards_of(docs)
    # not a checkpoint: members and values come out of one shuffle, which has the sets' values by their digests
    sets = signed.groupBy("digest").agg(F.min("sig").alias("sig")).select(F.col("digest").alias("rep"), "sig")
    pairs = _candidates(_members(sets, shards, parts, block), sets, shards, parts, threshold, tolerance).checkpoint()
    sizes = owners.groupBy("rep").agg(F.min("doc").alias("doc"), F.count("*").alias("owners"))
    return _verified(pairs, sizes, docs, id_col, text_col, n, threshold, shards, parts, block, linked)


def jaccard_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """doc_a < doc_b and jaccard of all pairs of documents at the threshold or above, copies included.

    Null ids, null texts and texts without words have no partners. Rows with the same id are one document with as
    many sets as differ; it is paired with others once, by its most similar set, and never with itself; equal rows
    count once. As many rows come out as there are pairs, which is quadratic in the size of a group; ``classes`` and ``keep_one``
    don't make them. Texts of any length are read whole. An empty table gives no rows. Other columns, whatever their names, aren't
    read."""
    signed, ensure = _owned(docs, id_col, text_col, n)
    found = _similar(signed, ensure, docs, id_col, text_col, n, threshold, tolerance, block, False)
    of = lambda r, d: ensure.select(F.col("rep").alias(r), F.col("doc").alias(d))
    near = found.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y", "jaccard")
    several = ensure.groupBy("rep").count().filter("count > 1").select("rep")
    twins = ensure.join(several, "rep")
    equal = twins.select("rep", F.col("doc").alias("x")).join(twins.select("rep", F.col("doc").alias("y")), "rep").filter("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    both = near.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard").filter("doc_a < doc_b").unionAll(equal.toDF("doc_a", "doc_b", "jaccard"))
    return both.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard")) if _several_rows(ensure) else both


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row for each id of the table: the id, class_id and links.

    Links are the pairs of ``jaccard_pairs`` that a document is in, copies among them; classes are what links connect, a
    class_id is the least id of its class. Documents without partners (null texts and texts without words are such) are
    classes of their own, with no links; null ids are one row with a null class. Copies are counted, not paired. Only where rows
    of an id have different texts are the pairs of sets (and of different documents that have a set in common) written
    down, as a pair of documents is one link then by however many sets it comes. An empty table gives no rows."""
    signed, owners = _owned(docs, id_col, text_col, n)
    several = _several_rows(owners)
    found = _similar(signed, owners, docs, id_col, text_col, n, threshold, tolerance, block, not several).checkpoint()
    if several:
        units, edges = _merged(owners, found)
        weight = units.groupBy("unit").agg(F.count("*").alias("links"))
        both = edges.select("a", "b").unionAll(edges.select(F.col("b"), F.col("a")))
        links = both.join(weight.withColumnRenamed("unit", "b"), "b").groupBy(F.col("a").alias("unit")).agg(F.sum("links").alias("links"))
    else:
        units, edges = owners.withColumnRenamed("rep", "unit"), found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
        links = found.groupBy(F.col("rep").alias("unit")).agg(F.sum("links").alias("links"))
    groups = components(docs.sparkSession, edges).withColumnRenamed("node", "unit")
    sizes = units.groupBy("unit").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    near = sizes.join(links, "unit", "left").join(groups, "unit", "left").filter("n > 1 or links is not null")
    near = near.select("unit", "first", F.coalesce("least", "unit").alias("g"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")).checkpoint()
    of = near.join(near.groupBy("g").agg(F.min("first").alias("class")), "g").select("unit", "class", "links")
    linked = units.join(of, "unit").select("doc", "class", "links")
    ids = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc")).distinct()
    return ids.join(linked, "doc", "left").select(F.col("doc").alias(id_col), F.coalesce("class", "doc").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def _merged(owners: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where documents have several sets: (documents with the least one that has the same sets: doc, unit; the pairs of these
    units that have sets in common or similar ones: a, b)."""
    held = owners.groupBy("doc").agg(F.count("*").alias("k"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    key = ["k", "lo", "hi", "x", "y"]
    units = held.join(held.groupBy(*key).agg(F.min("doc").alias("unit")), key).select("doc", "unit").checkpoint()
    sets = owners.join(units.filter("doc = unit"), "doc").select("unit", "rep").checkpoint()
    of = lambda r, d: sets.select(F.col("rep").alias(r), F.col("unit").alias(d))
    near = found.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y").unionAll(of("rep", "x").join(of("rep", "y"), "rep").select("x", "y"))
    return units, near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct().checkpoint()


def _several_rows(owners: DataFrame) -> bool:
    """Whether any id has more than one set."""
    return bool(owners.groupBy("doc").count().filter("count > 1").limit(1).count())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, least node of its component) of the nodes of edges (a, b): least labels spread over edges, and labels
    are replaced by their own labels, until nothing changes."""
    ensure_checkpoint_dir(spark)
    both = edges.select("a", "b").unionAll(edges.select(F.col("b"), F.col("a"))).distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("least")).checkpoint()
    while True:
        seen = both.join(label.select(F.col("node").alias("b"), "least"), "b").groupBy(F.col("a").alias("node")).agg(F.min("least").alias("near"))
        spread = label.join(seen, "node").select("node", F.least("least", "near").alias("new"), "least")
        jump = label.select(F.col("node").alias("new"), F.col("least").alias("beyond"))
        after = spread.join(jump, "new", "left").select("node", F.least("new", F.coalesce("beyond", "new")).alias("new"), "least").checkpoint()
        changed = after.filter("new <> least").limit(1).count()
        label = after.select("node", F.col("new").alias("least"))
        if not changed:
            return label


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns, one of each group of similar ones: the least id. Groups are the connected
    components of the pairs. Documents without words, null ids and null texts stay; all rows of an id stay or go, so a row that
    repeats with its id stays as often as it is there. Other columns are carried along whatever their names and
    nulls; an empty table stays empty."""
    spark = docs.sparkSession
    signed, owners = _owned(docs, id_col, text_col, n)
    found = _similar(signed, owners, docs, id_col, text_col, n, threshold, TOLERANCE, BLOCK, True)
    groups = components(spark, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    grouped = owners.join(groups, owners["rep"] == groups["node"], "left").select("doc", F.coalesce("least", "rep").alias("g")).checkpoint()
    kept = grouped.groupBy("g").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").select("g", "first")
    name = fresh(docs, "_pw_gone")
    gone = grouped.join(kept, "g").filter("doc <> first").select(F.col("doc").alias(name)).distinct().checkpoint()
    few = gone.count() <= BROADCAST_ROWS
    side = F.broadcast(gone) if few else gone.hint("shuffle_hash")
    return docs.join(side, docs[f"`{id_col}`"].cast("long") == side[name], "left_anti")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS t FROM documents WHERE text IS NOT NULL),
     g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
                ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS gram FROM w WHERE len(t) > 0),
     n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
     p AS (SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, count(*) AS common FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT doc_a, doc_b, common / CAST(u.n + v.n - common AS DOUBLE) AS jaccard
FROM p JOIN n u ON u.doc_id = doc_a JOIN n v ON v.doc_id = doc_b WHERE common / CAST(u.n + v.n - common AS DOUBLE) >= 0.55
"""

#: Classes and links by the pairs of ``ORACLE``.
CLASSES = (
    "WITH RECURSIVE pairs AS ("
    + ORACLE
    + r"""),
     e AS (SELECT doc_a AS x, doc_b AS y FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
     ids AS (SELECT DISTINCT doc_id FROM documents),
     reach AS (SELECT doc_id AS x, doc_id AS y FROM ids UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
     c AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
     l AS (SELECT x, count(*) AS links FROM e GROUP BY x)
SELECT doc_id, class_id, coalesce(links, 0) AS links FROM ids LEFT JOIN c ON c.x = doc_id LEFT JOIN l ON l.x = doc_id
"""
)
