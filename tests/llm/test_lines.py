from collections import Counter

import numpy as np
from conftest import same

from pagewright.llm import lines as L


def brute(rows, min_count):
    """Rows (id, text) without repeated lines, by a count over all of them."""
    big = 2**63 - 1
    key = lambda x: x.strip(" \t\r")
    n, first = Counter(), {}
    for i, t in rows:
        for x in (t.split("\n") if t is not None else ()):
            n[key(x)] += 1
            first[key(x)] = min(first.get(key(x), big), big if i is None else i)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        seen, kept, all_lines = set(), [], t.split("\n")
        for x in all_lines:
            k = key(x)
            if k == "" or n[k] < min_count or (first[k] == (big if i is None else i) and k not in seen):
                kept.append(x)
            seen.add(k)
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, min_count):
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, gone string")
    return sorted((tuple(r) for r in L.dedup_lines(docs, min_count=min_count).collect()), key=str)


def test_oracle(spark, sf_dir, duck):
    same(L.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")), duck.execute(L.ORACLE).df())


def test_edges(spark):
    rows = [
        (5, "a\nb\na \n\nc"), (2, "a\nb"), (9, "\ta\r\n\n"), (7, None), (8, ""), (None, "a\nz\nz"), (None, "a\nz"), (5, "b\nu"), (11, "é\n漢\né"), (12, "é"), (13, "a"),
        (14, "b\n" * 30_000 + "end"),
    ]
    for m in (1, 2, 3, 4, 100):
        assert run(spark, rows, m) == brute(rows, m), m
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.dedup_lines(empty).count() == 0 and L.drop_repeated_lines(empty).count() == 0


def test_random(spark):
    r = np.random.default_rng(4)
    rows = [(int(r.integers(0, 40)), "\n".join(r.choice(["x", "y ", "z", "", "w" * 50, "é", *map(str, range(30))], r.integers(0, 12)))) for _ in range(200)]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_tally():
    """What a batch sends is one record for each distinct line."""
    r = np.random.default_rng(9)
    h, g, d = r.integers(0, 3, 400).astype(np.uint64), r.integers(0, 2, 400).astype(np.uint64), r.integers(0, 60, 400)
    sh, sg, sd, n = L.tallied(h, g, d)
    want = {}
    for x, y, z in zip(h.tolist(), g.tolist(), d.tolist()):
        k, m = want.get((x, y), (z, 0))
        want[x, y] = min(k, z), m + 1
    assert {(x, y): (z, m) for x, y, z, m in zip(sh.tolist(), sg.tolist(), sd.tolist(), n.tolist())} == want


def test_probed_by_shards(spark, monkeypatch):
    """Arrays too large to broadcast give the same, also beside columns that are named as the join's own."""
    monkeypatch.setattr(L, "BROADCAST_BYTES", -1)
    r = np.random.default_rng(5)
    rows = [(int(r.integers(0, 40)), "\n".join(r.choice(["x", "y ", "z", "", "w" * 50, "é", *map(str, range(30))], r.integers(0, 12)))) for _ in range(200)]
    rows += [(None, "x\nx\nq"), (7, None), (8, "")]
    assert run(spark, rows, 4) == brute(rows, 4)
    docs = spark.createDataFrame([(*x, k, str(k)) for k, x in enumerate(rows)], "doc_id long, text string, _pw_doc int, _pw_lines string")
    out = L.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    got = {x._pw_doc: (x.doc_id, x.text, x._pw_lines) for x in out.collect()}
    monkeypatch.undo()
    assert got == {x._pw_doc: (x.doc_id, x.text, x._pw_lines) for x in L.drop_repeated_lines(docs).collect()} and len(got) > 20


def test_stage(spark):
    rows = [(1, "s\nown", "en", "q", 5), (2, "s", "en", "q", 1), (3, "s\nmine", "en", "q", 6), (4, "s\n", "en", "q", 2), (5, "", "en", "q", 0), (6, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = L.drop_repeated_lines(docs)
    assert out.schema == docs.schema
    assert sorted(tuple(r) for r in out.collect() if r.text is not None) == [(1, "s\nown", "en", "q", 5), (3, "mine", "en", "q", 4), (5, "", "en", "q", 0)]
    assert out.filter("doc_id = 6").count() == 1


def test_perfect_hash():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 64, 65, 5000):
        keys, more = r.integers(0, 2**64, n, dtype=np.uint64), r.integers(0, 2**64, n, dtype=np.uint64)
        keys[: n // 2] = 7  # told apart by the other half
        h = L.PerfectHash(keys, more)
        assert sorted(h(keys, more).tolist()) == list(range(len(keys))) and h.n == len(keys)
        back = L.PerfectHash.from_bytes(h.to_bytes())
        assert back(keys, more).tolist() == h(keys, more).tolist()


def test_fingerprint_rejects_foreign_lines():
    """Lines that aren't in the arrays get numbers of lines that are, and only the fingerprint tells them apart."""
    u = lambda *x: np.array(x, np.uint64)
    index = L.LineIndex.from_row(*L.LineIndex.build(u(7, 7, 9, 8), u(1, 1, 3, 4), np.array([3, 1, 2, 5]), np.array([1, 2, 5, 2]), 3).to_row())
    counts, first = index.probe(u(7, 9, 8), u(1, 3, 4))
    assert counts.tolist() == [3, 5, 0] and first.tolist()[:2] == [1, 2]
    r = np.random.default_rng(3)
    keys, more = r.integers(0, 2**64, 4000, dtype=np.uint64), r.integers(0, 2**64, 4000, dtype=np.uint64)
    index = L.LineIndex.build(keys[:2000], more[:2000], np.zeros(2000, np.int64), np.full(2000, 4), 4)
    assert (index.mph(keys[2000:], more[2000:]) >= 0).sum() > 500
    assert (index.probe(keys[2000:], more[2000:])[0] == 0).all() and (index.probe(keys[:2000], more[:2000])[0] == 4).all()


def test_patterns_that_polynomials_confuse(spark):
    """Thue-Morse lines have equal hashes under any polynomial modulo a power of two."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(k, f"{x}\n{k}") for k, x in enumerate([a, b, a, b])]
    assert run(spark, rows, 2) == brute(rows, 2) and run(spark, rows, 3) == brute(rows, 3)
