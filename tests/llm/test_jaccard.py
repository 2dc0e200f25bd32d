import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import same
from pyspark.sql import functions as F

from pagewright.llm import jaccard as J
from pagewright.llm.buffers import flat


def grams(t, n=J.N):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, t=J.THRESHOLD):
    out = {}
    g = [(d, grams(x)) for d, x in rows if d is not None]
    for k, (a, x) in enumerate(g):
        for b, y in g[k + 1 :]:
            if a != b and x and y and len(x & y) / len(x | y) >= t:
                p = (min(a, b), max(a, b))
                out[p] = max(out.get(p, 0), len(x & y) / len(x | y))
    return out


def make_rows():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(4))
    rows, n = [], 0
    for size, words in ((2, 40), (3, 100), (60, 80), (5, 7)):
        base = [word() for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randrange(0, max(1, words // 20) + 1)):
                w[rnd.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
        rows += [(n, ", ".join(base).upper()), (n + 1, " ".join(base))]
        n += 2
    rows += [(n + k, " ".join(word() for _ in range(50))) for k in range(20)]
    return rows + [(900, ""), (901, None), (902, "one"), (903, "One!"), (904, "two words"), (905, "..."), (None, rows[0][1]), (3, rows[0][1]), (3, rows[0][1]), (906, "x y " * 30_000)]


def test_shingles_against_slow():
    texts = [t or "" for _, t in make_rows()[:-1]] + ["a-b_c d.e f", "É É é", "1 2 3 4"]
    data, off, _ = J.lower(pa.array(texts))
    g, d = J.ngrams(data, off)
    counts = np.bincount(d, minlength=len(texts))
    assert counts.tolist() == [len(grams(t)) for t in texts]
    of = [set(g[d == k].tolist()) for k in range(len(texts))]
    for a in range(0, len(texts), 7):
        for b in range(0, len(texts), 5):
            assert len(of[a] & of[b]) == len(grams(texts[a]) & grams(texts[b]))


@pytest.mark.parametrize("block", [J.BLOCK, 8])
def test_all_pairs(spark, block):
    """Large buckets are compared block by block; no pair is lost or comes twice."""
    rows = make_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int")
    got = [(r.doc_a, r.doc_b, r.jaccard) for r in J.jaccard_pairs(docs, block=block).collect()]
    assert len({g[:2] for g in got}) == len(got)
    want = brute(rows)
    assert all(want.get(g[:2]) == g[2] for g in got)
    assert len(got) >= 0.97 * len(want)


def test_no_task_is_large(spark):
    """A bucket of 20,000 sets is spread over pairs of blocks, each a group of its own, and all its pairs are covered."""
    block = 2048
    rows = spark.range(20_000).select(F.lit(5).cast("long").alias("bucket"), F.lit(0).alias("band"), F.col("id").alias("rep"), (F.col("id") / block).cast("int").alias("own"), F.lit(10).alias("blocks"))
    small = spark.range(20_000).select((F.col("id") / 2).cast("long").alias("bucket"), F.lit(0).alias("band"), F.col("id").alias("rep"), F.lit(0).alias("own"), F.lit(1).alias("blocks"))
    tasks = J._tasks(rows.unionAll(small), 4).checkpoint()
    large = tasks.filter("shard >= 4").groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("task").alias("t"), F.count_if(F.col("side") == 1).alias("right")).collect()
    assert len(large) == 55 and all(r.n <= 2 * block and r.t == 1 for r in large)
    assert sum((r.n - r.right) * r.right if r.right else r.n * (r.n - 1) // 2 for r in large) == 20_000 * 19_999 // 2
    assert tasks.filter("shard < 4").count() == 20_000 and tasks.filter("shard < 4 and side = 1").count() == 0


def test_jaccards_against_sets():
    r = np.random.default_rng(1)
    sets = {k * 7: set(r.integers(0, 60, r.integers(1, 50)).tolist()) for k in range(40)}
    packed = pa.array([np.array(sorted(v), np.uint64).tobytes() for v in sets.values()], pa.binary())
    pairs = [(a, b) for a in sets for b in sets if a < b]
    got = J.jaccards(*(np.array(c) for c in zip(*pairs)), np.array(list(sets)), packed, 0.4)
    share = lambda x, y: len(x & y) / len(x | y)
    assert dict(zip(zip(got[0].tolist(), got[1].tolist()), got[2].tolist())) == {(a, b): share(sets[a], sets[b]) for a, b in pairs if share(sets[a], sets[b]) >= 0.4}


def test_equal_digests(spark, monkeypatch):
    """Different sets whose digests meet are still different sets."""
    digests, signatures = J._digests, J.signatures  # both are sent to the workers as they are here
    monkeypatch.setattr(J, "_digests", lambda g, d, n: (digests(g, d, n)[0] & 3, *digests(g, d, n)[1:]))
    monkeypatch.setattr(J, "signatures", lambda g, d, n: (signatures(g, d, n)[0] & 3, *signatures(g, d, n)[1:]))
    rows = make_rows()[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in J.jaccard_pairs(docs).collect()}
    assert all(want.get(k) == v for k, v in got.items()) and len(got) >= 0.97 * len(want)


def test_oracle(spark, sf_dir, duck):
    same(J.jaccard_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet")), duck.execute(J.ORACLE).df())


def classes_of(ids, pairs):
    """{id: (least id of its class, number of links)}"""
    link, n = {d: d for d in ids}, dict.fromkeys(ids, 0)
    root = lambda x: x if link[x] == x else root(link[x])
    for a, b in pairs:
        x, y = root(a), root(b)
        link[max(x, y)] = min(x, y)
        n[a] += 1
        n[b] += 1
    return {d: (root(d), n[d]) for d in link}


@pytest.mark.parametrize("several", [False, True])
@pytest.mark.parametrize("block", [J.BLOCK, 8])
def test_classes(spark, block, several):
    """One row for each id, with the class and the number of its pairs, where ids have one set and where some have several."""
    rows = make_rows()
    rows = [*rows, (12, rows[70][1]), (13, rows[70][1]), (13, rows[12][1]), (905, rows[2][1])] if several else [r for r in rows if r[0] != 3] + [(20, rows[20][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int")
    pairs = {(r.doc_a, r.doc_b) for r in J.jaccard_pairs(docs, block=block).collect()}
    assert pairs <= brute(rows).keys() and len(pairs) >= 0.97 * len(brute(rows))
    out = J.classes(docs, block=block).collect()
    assert len(out) == len({d for d, _ in rows})
    got = {r.doc_id: (r.class_id, r.links) for r in out}
    assert got.pop(None) == (None, 0)
    assert got == classes_of({d for d, _ in rows if d is not None}, pairs)


def test_classes_are_a_row_each(spark, tmp_path):
    """The query's rows follow its documents, not the pairs in a group of copies; no link between different texts is lost."""
    from pagewright.llm.queries import QUERIES

    words = [f"w{k}" for k in range(200)]
    near = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(0, 200, 4)]
    rows = [(k, near[k % 50]) for k in range(150)] + [(500, "something else is said here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op9_jaccard_join"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(k, 0, 149) for k in range(150)} | {(500, 500, 0)}
    assert got.count() == len(rows)


@pytest.mark.parametrize(("broadcast", "known"), [(0, 1 << 30), (0, 0)])
def test_ids_that_are_many(spark, monkeypatch, broadcast, known):
    """The result is the same where ids are joined by a shuffle, and where tasks don't know them."""
    docs = spark.createDataFrame(make_rows(), "doc_id long, text string")
    want = {tuple(r) for r in J.classes(docs).collect()}
    monkeypatch.setattr(J, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(J, "FILTER_ROWS", known)
    assert {tuple(r) for r in J.classes(docs).collect()} == want


def test_classes_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.classes(docs).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d"), (None, None), (3, "a b c d")], "doc_id long, text string")
    assert {tuple(r) for r in J.classes(odd).collect()} == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (None, None, 0)}


def test_classes_oracle(spark, sf_dir, duck):
    same(J.classes(spark.read.parquet(f"{sf_dir}/documents.parquet")), duck.execute(J.CLASSES).df())


def test_roots():
    r = np.random.default_rng(5)
    for n, m in ((1, 0), (50, 20), (400, 390), (3000, 3500)):
        x, y = r.integers(0, n, m), r.integers(0, n, m)
        assert J.roots(x, y, n).tolist() == [c for c, _ in classes_of(range(n), zip(x.tolist(), y.tolist())).values()]
    k = r.permutation(5000)
    assert not J.roots(k[:-1], k[1:], 5000).any()


def test_a_set_travels_once(spark):
    """Values of similar sets go once to a shard, not once for each bucket that they share."""
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(300)) + f" end{k}") for k in range(20)], "doc_id long, text string")
    signed, _ = J._owned(docs, "doc_id", "text", J.N)
    sets = signed.select(F.col("digest").alias("rep"), "sig")
    members = J._members(sets, 8, 2, J.BLOCK)
    assert members.count() > 400 and members.select("rep", "lead").distinct().count() <= 60


def test_keep_one(spark):
    rows = make_rows()
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, node long")
    link = {d: d for d, _ in rows}
    root = lambda x: x if link[x] == x else root(link[x])
    for a, b in brute(rows):
        x, y = root(a), root(b)
        link[max(x, y)] = min(x, y)
    want = {d for d in link if d is None or root(d) == d}
    out = J.keep_one(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want
    assert J.keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.least for r in J.components(spark, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_pruning_bounds():
    """A pair at the threshold is dropped with a small chance only."""
    r = np.random.default_rng(0)
    bounds = J.least_matches(0.7)
    m = np.cumsum(r.random((20_000, J.HASHES)) < 0.7, axis=1)
    kept = np.all([m[:, n - 1] >= least for n, least in bounds], axis=0)
    assert kept.mean() > 0.98
    low = np.cumsum(r.random((20_000, J.HASHES)) < 0.4, axis=1)
    assert np.all([low[:, n - 1] >= least for n, least in bounds], axis=0).mean() < 0.02


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_pairs(docs).count() == 0
    one = docs.unionAll(spark.range(1).select(F.col("id"), F.lit("a b c d")))
    assert J.jaccard_pairs(one).count() == 0 and J.keep_one(one).count() == 1
