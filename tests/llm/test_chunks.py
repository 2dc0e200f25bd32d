import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from pagewright.llm import chunks as C
from pagewright.llm.buffers import flat


def slow_gear(raw):
    h, out = 0, []
    for b in raw:
        h = (h << 1) + int(C.GEAR[b]) & 0xFFFF
        out.append(h)
    return out


def slow_chunks(text):
    raw = text.encode()
    out, start = [], 0
    for i, h in enumerate(slow_gear(raw)):
        if (i + 1 >= 16 and h < (1 << 16) // C.MEAN) or i + 1 == len(raw):
            while i + 1 - start > C.LONGEST:
                out.append((start, start + C.LONGEST))
                start += C.LONGEST
            if i + 1 > start:
                out.append((start, i + 1))
            start = i + 1
    return out


TEXTS = ["", "short", "é漢" * 40, "a" * 5000, "The quick brown fox " * 30, "x"]


def test_chunks_against_slow():
    data, off, _ = flat(pa.array(TEXTS))
    s, e = C.chunk(data, off)
    got = defaultdict(list)
    for a, b in zip(s, e):
        d = int(np.searchsorted(off, a, "right")) - 1
        got[d].append((int(a - off[d]), int(b - off[d])))
    for k, t in enumerate(TEXTS):
        assert got[k] == slow_chunks(t), t


def brute(rows, min_span=C.MIN_SPAN):
    held = defaultdict(set)
    for d, t in rows:
        if d is not None and t:
            for a, b in slow_chunks(t):
                held[t.encode()[a:b]].add(d)
    out = set()
    for d, t in rows:
        if d is None or not t:
            continue
        runs, raw = [], t.encode()
        for a, b in slow_chunks(t):
            owners = held[raw[a:b]]
            if len(owners) > 1:
                if runs and runs[-1][-1][1] == a:
                    runs[-1].append((a, b, min(owners)))
                else:
                    runs.append([(a, b, min(owners))])
        for run in runs:
            if run[-1][1] - run[0][0] >= min_span:
                part = []
                for c in [*run, None]:
                    if part and (c is None or (c[2] == d) != (part[-1][2] == d)):
                        out.add((d, part[0][0], part[-1][1] - part[0][0], len(part), part[0][2] == d))
                        part = []
                    part.append(c)
    return out


def make_rows():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rnd.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(55) for _ in range(4)]
    rows = [(k, f"{text(rnd.randrange(5, 60))} {passages[k % 4]} {text(rnd.randrange(5, 60))}") for k in range(16)]
    rows += [(100 + k, text(120)) for k in range(10)]
    rows += [(200, passages[0] + passages[0]), (201, None), (202, ""), (None, passages[1]), (203, "q" * 40_000), (204, "q" * 30_000)]
    return rows, passages


def test_spans(spark):
    rows, _ = make_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    got = {tuple(r) for r in C.spans(docs).collect()}
    assert got == brute(rows)
    assert {r[0] for r in got} >= set(range(16)) and not {r[0] for r in got} & set(range(100, 110))
    assert C.spans(docs.limit(0)).count() == 0


def test_dedup(spark):
    rows, passages = make_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    out = C.dedup_substrings(docs)
    assert out.schema == docs.schema and out.count() == len(rows)
    got = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    was = dict(rows)
    for k in range(4):
        assert passages[k] in got[k]
    for k in range(4, 16):
        assert passages[k % 4] not in got[k] and len(was[k]) - len(got[k]) > 150
    assert all(got[k] == was[k] for k in range(100, 110))


def test_corpus_recall(spark, sf_dir):
    """Every document that shares 60 words in a row with another has a span."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = defaultdict(set)
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 59):
            held[" ".join(w[i : i + 60])].add(d)
    truth = {d for s in held.values() if len(s) > 1 for d in s}
    got = {r.doc_id for r in C.spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert len(truth & got) >= 0.95 * len(truth)
