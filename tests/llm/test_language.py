import numpy as np
import pyarrow as pa

from pagewright.llm import language as L
from pagewright.llm.buffers import flat


def brute(text, dim=L.DIM):
    """The text's vector, one n-gram at a time."""
    chars = [L.letters()[ord(c)] for c in text]
    seq = [L.SPACE]
    for c in [*chars, L.SPACE]:
        if not (c == L.SPACE and seq[-1] == L.SPACE):
            seq.append(c)
    out = np.zeros(dim)
    for a, b, c in zip(seq, seq[1:], seq[2:]):
        out += np.roll(L.letter_vector(int(a), dim), 2).astype(int) * np.roll(L.letter_vector(int(b), dim), 1) * L.letter_vector(int(c), dim)
    return out


TEXTS = ["Hello, world!", "", "1234 !!", "Éçè été", "漢字 test", "a", " x ", "ẞß İ", "word " * 50, "mixed 漢😀 text"]


def test_vectors_against_brute_force():
    data, off, _ = flat(pa.array(TEXTS))
    got = L.text_vectors(data, off)
    for k, t in enumerate(TEXTS):
        assert (got[k] == brute(t)).all(), t


def test_vectors_dont_depend_on_the_slice(monkeypatch):
    data, off, _ = flat(pa.array(TEXTS))
    whole = L.text_vectors(data, off)
    monkeypatch.setattr(L, "GRAMS", 7)
    assert (L.text_vectors(data, off) == whole).all()
    assert (np.concatenate([L.text_vectors(data, off[k : k + 2]) for k in range(len(TEXTS))]) == whole).all()


def test_held_out_accuracy(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = L.fit(docs.filter("doc_id % 2 = 0"), fit_rows=100)
    rows = L.identify(docs.filter("doc_id % 2 = 1"), model=model).collect()
    assert len(rows) == docs.filter("doc_id % 2 = 1").count()
    assert np.mean([r.lang == r.predicted for r in rows]) > 0.97
    assert np.mean([r.accepted for r in rows]) > 0.98


def test_edges(spark):
    rows = [(1, "the cat and the hat", "en", 0.5), (2, "le chat et la maison", "fr", 0.5), (3, None, "en", 0.5), (4, "", "fr", 0.5), (5, "12 !!", None, 0.5), (None, "the hat", "en", 0.5), (1, "the cat and the hat", "en", 0.5), (7, "the cat " * 20000, None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, cosine double")
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].predicted == "en" and by[2].predicted == "fr" and by[7].predicted == "en"
    assert all(by[k].predicted is None and by[k].cosine is None and not by[k].accepted for k in (3, 4, 5))
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, None, 7}
    assert L.identify(docs.limit(0)).count() == 0
    assert not any(r.accepted for r in L.identify(docs.filter("lang is null")).collect())


def test_decision_against_slow(spark):
    """Cosine, lead, ties and acceptance, from the vectors by hand."""
    import math

    texts = ["the cat and the hat", "der hund und die katze", "", None, "123 456", "the", "zzzz qqqq xxxx"]
    data, off, _ = L.flat(pa.array([t or "" for t in texts]))
    v = L.text_vectors(data, off)
    names = ["aa", "bb", "cc"]
    unit = lambda x: x / math.sqrt(sum(float(a) ** 2 for a in x))
    prototypes = np.stack([unit(v[0].astype(float)), unit(v[0].astype(float)), unit(v[1].astype(float))])  # aa and bb tie
    rows = [(k, t, "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, cosine int")
    got = {r.doc_id: r for r in L.identify(docs, model=(names, prototypes)).collect()}
    for k, t in enumerate(texts):
        length = math.sqrt(sum(float(a) ** 2 for a in v[k]))
        r = got[k]
        if t is None or not any(c.isalpha() for c in t):
            assert (r.predicted, r.cosine, r.lead, r.accepted) == (None, None, None, False)
            continue
        cos = [sum(float(a) * float(b) for a, b in zip(v[k], p)) / length for p in prototypes]
        top = max(range(3), key=lambda i: (round(cos[i], 9), -i))
        lead = cos[top] - max(c for i, c in enumerate(cos) if i != top)
        assert r.predicted == names[top] and abs(r.cosine - cos[top]) < 1e-6 and abs(r.lead - lead) < 1e-6
        assert r.accepted == (cos[top] >= L.MIN_COSINE and lead >= L.MIN_LEAD)
    assert got[0].predicted == "aa" and not got[0].accepted and got[1].predicted == "cc" and got[1].accepted
