import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import decontaminate as D


def distance(item, text):
    """Least edit distance of the item to any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abcé", min_size=1, max_size=80), st.text("abcé", max_size=100))
def test_myers(item, text):
    assert D.myers(item, text) == distance(item, text)


def edited(t, k, rnd):
    t = list(t)
    for _ in range(k):
        at = rnd.randrange(len(t))
        t[at : at + 1] = rnd.choice(([], ["q"], [t[at], "é"]))
    return "".join(t)


@pytest.fixture(scope="module")
def cases(spark, sf_dir):
    rnd = random.Random(8)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(6).collect()]
    items += [(100, "short"), (101, None), (102, items[0][1]), (103, "é漢" * 30)]
    docs = [(r.doc_id, r.text[:700]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(12).collect()]
    n = 1000
    for i, t in items:
        if t and len(t) >= 20:
            for k in (0, 1, 3, 6, 12, 25):
                pad = docs[rnd.randrange(12)][1]
                docs.append((n, pad[:50] + edited(t, k, rnd) + pad[50:90]))
                n += 1
            docs.append((n, edited(t.upper().replace(" ", "\n"), 2, rnd)))
            docs.append((n + 1, t[: len(t) // 2]))
            n += 2
    docs += [(None, items[0][1]), (5, None), (6, ""), (1000, docs[12][1])]
    return items, docs


def stands(item, text):
    """Whether the item is in the text with no letter or digit beside it, unless one of the two is written without blanks."""
    spaced = lambda c: (c.isalnum() or c == "_") and not "\u3040" <= c <= "\u9fff"
    at = text.find(item)
    while at >= 0:
        before, after = text[at - 1 : at] if at else "", text[at + len(item) : at + len(item) + 1]
        if not (before and spaced(before) and spaced(item[0])) and not (after and spaced(after) and spaced(item[-1])):
            return True
        at = text.find(item, at + 1)
    return False


def brute(items, docs, rate=0.05):
    out = []
    for d, t in docs:
        for i, x in items:
            if t and x:
                x, low = D.normal(x), D.normal(t)
                budget = int(len(x) * rate)
                k = distance(x, low) if budget else 0 if stands(x, low) else 1
                if k <= budget:
                    out.append((d, i, k))
    return sorted(out, key=str)


def frames(spark, cases):
    items, docs = cases
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")


def test_all_pairs(spark, cases):
    docs, items = frames(spark, cases)
    got = sorted((tuple(r) for r in D.matches(docs, items).collect()), key=str)
    assert got == brute(*cases) and len(got) > 20


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.25, 0.4])
def test_all_rates_and_lengths(rate):
    """Items of 1 to 200 characters, whose pieces are as short as two bytes, against the full table."""
    rnd = random.Random(int(rate * 100))
    for alphabet in ("ab ", "abcdefghijklmnopqrstuvwxyz     ", "é漢 a😀"):
        word = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
        items = [(i, word(n)) for i, n in enumerate((1, 2, 3, 5, 8, 13, 19, 20, 31, 67, 90, 200))]
        docs = []
        for _, t in items:
            k = int(len(t) * rate)
            for n in (0, 1, k, k + 1):
                docs.append((len(docs), word(40) + rnd.choice(["", " "]) + edited(t, n, rnd) + rnd.choice(["", " "]) + word(40)))
        found = D.Items(items, rate)
        raw = [t.encode() for _, t in docs]
        off = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
        own, at, flat = D._flat_normal(np.frombuffer(b"".join(raw), np.uint8), off)
        assert sorted(((d, found.ids[i], k) for d, i, k in found.search(own, at, flat)), key=str) == brute(items, docs, rate)


def test_repeated_letters():
    """A megabyte of one letter against an item of that letter takes about a second at most, and not minutes."""
    own = np.full(1 << 20, 97, np.uint8)
    for item, want in (("a" * 80, [(0, 0, 0)]), ("a" * 79 + "b", [(0, 0, 1)]), ("a" * 40 + "b" + "a" * 39 + "c", [(0, 0, 2)])):
        began = time.time()
        assert list(D.Items([(0, item)]).search(own, np.array([0, len(own)]), own.tobytes())) == want
        assert time.time() - began < 10


def test_normal_form_of_slices():
    """Letters that get longer or shorter in lower case don't move the texts behind them; sigma doesn't depend on what follows."""
    texts = ["K" + "x" * 20, "ȺȺ end", "ΑΣ", "b", "İI"]
    raw = [t.encode() for t in texts]
    off = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    _, at, flat = D._flat_normal(np.frombuffer(b"".join(raw), np.uint8), off)
    assert [flat[a:b].decode() for a, b in zip(at, at[1:])] == [D.normal(t) for t in texts]


def test_in_parts(spark, cases, monkeypatch):
    monkeypatch.setattr(D, "PART_BYTES", 400)
    docs, items = frames(spark, cases)
    assert sorted((tuple(r) for r in D.matches(docs, items).collect()), key=str) == brute(*cases)
    found = {r[0] for r in brute(*cases)}
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in cases[1]} - found


def test_empty(spark, cases):
    docs, items = frames(spark, cases)
    assert D.matches(docs.limit(0), items).count() == 0
    assert D.matches(docs, items.limit(0)).count() == 0
    assert D.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_very_long(spark, cases):
    docs = spark.createDataFrame([(1, "filler " * 300_000 + cases[0][0][1] + " filler" * 1000)], "doc_id long, text string")
    assert [tuple(r) for r in D.matches(docs, frames(spark, cases)[1].filter("item_id < 100")).collect()] == [(1, cases[0][0][0], 0)]
