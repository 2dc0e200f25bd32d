import random

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import bpe
from pagewright.llm.buffers import flat
from pagewright.llm.queries import vocabulary

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["", " ", "\n", "  \n\n  x ", "'s", "it's we'll I'm 'tis ''s '", "a" * 5000, " " * 3000, "ab" * 4000, "漢字かな 😀 é x　y", "½ ²3 Ⅷ 12", "x\r\n\ty  ", "\x1c\x1d|\x00"]


@pytest.fixture(scope="module")
def coder():
    return bpe.load(vocabulary())


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def encode(coder, texts):
    data, off, _ = flat(pa.array(texts))
    ids, n = coder.encode(data, off)
    at = np.r_[0, np.cumsum(n)]
    return [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))], ids, n


def test_equals_merging_by_rank(coder, reference):
    rnd = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "é", "漢", "😀", "'s", "'ll", "'", "re", "12", "!", "…", "　", "the", "ing", "zz", "Th", "_"]
    texts = ODD + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(80))) for _ in range(2000)]
    got, ids, n = encode(coder, texts)
    assert got == [reference.encode_ordinary(t) for t in texts]
    data, off = coder.decode(ids, n)
    assert [data[a:b].tobytes().decode() for a, b in zip(off, off[1:])] == texts


def test_speculation_is_checked(coder):
    """Words whose greedy tokens aren't right are among those found incompatible, and no others are merged anew."""
    words = [w.encode() for w in (" thntblere", " hello", " eauenaux", "worldwide", " ouieré", "aaaaab", " antidisestablishmentarianism")]
    tokens, counts = coder.greedy(words)
    at = np.r_[0, np.cumsum(counts)]
    for k, w in enumerate(words):
        own = tokens[at[k] : at[k + 1]]
        ok = bool(coder.compatible(own[:-1], own[1:]).all()) if len(own) > 1 else True
        assert ok == (own.tolist() == coder.merge(w))


@pytest.mark.parametrize("hashed", [True, False])
def test_words_are_known_by_their_bytes(coder, reference, monkeypatch, hashed):
    """Thue-Morse words have equal hashes; with ``hashed`` off, all words of a length do. Each still gets its own tokens."""
    coder.clear()
    if not hashed:
        monkeypatch.setattr(bpe, "mix", lambda x: np.full(len(x), 5, np.uint64))
    texts = []
    for n in (1024, 2048):
        a = "a"
        while len(a) < n:
            a += a.translate(str.maketrans("ab", "ba"))
        texts += [a, a.translate(str.maketrans("ab", "ba"))]
    texts += ["one two one six", "one ten two", " five nine one"]
    for _ in range(2):
        got, ids, n = encode(coder, texts)
        assert got == [reference.encode_ordinary(t) for t in texts]
        data, off = coder.decode(ids, n)
        assert [data[a:b].tobytes().decode() for a, b in zip(off, off[1:])] == texts
    coder.clear()


def test_very_long_words(coder):
    """Hundreds of kilobytes without a blank are one word, which is merged exactly."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(300_000)), "z" * 1_000_000]
    _, ids, n = encode(coder, texts)
    data, off = coder.decode(ids, n)
    assert [data[a:b].tobytes().decode() for a, b in zip(off, off[1:])] == texts
    assert ids[: n[0]].tolist() == coder.merge(texts[0].encode())


def test_cache_is_emptied(coder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    for t in ("one two three four five", "six seven one two"):
        assert encode(coder, [t])[0] == [reference.encode_ordinary(t)]


def test_frames(spark):
    rows = [(1, "Hello there", 9), (2, None, 9), (3, "", 9), (3, "again", 9), (None, "no id", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    out = bpe.encode(docs, vocabulary())
    got = sorted(((r.doc_id, r.n_tokens, r.token_ids) for r in out.collect()), key=str)
    assert [g[1:] for g in got if g[0] == 2] == [(0, None)]
    assert [] in [g[2] for g in got if g[0] == 3]
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(out, vocabulary()).collect()), key=str)
    assert back == sorted([(r[0], r[1]) for r in rows], key=str)
    assert bpe.encode(docs.limit(0), vocabulary()).count() == 0


def test_decode_bad_ids(spark):
    rows = spark.createDataFrame([(1, [15496, 10**6, -1]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert sorted((r.doc_id, r.text) for r in bpe.decode(rows, vocabulary()).collect()) == [(1, "Hello"), (2, None), (3, "")]


def test_corpus(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id: r.token_ids for r in bpe.encode(docs, vocabulary()).collect()}
    assert all(ids[r.doc_id] == reference.encode_ordinary(r.text) for r in docs.collect())
