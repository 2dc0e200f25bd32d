import numpy as np
import pytest

from pagewright.llm import simple8b as S
from pagewright.llm.queries import vocabulary


def test_round_trips():
    r = np.random.default_rng(3)
    for k in range(200):
        counts = r.integers(0, 600, r.integers(0, 10))
        n = int(counts.sum())
        ids = r.integers(0, 1 << int(r.integers(1, 62)), n) >> r.integers(0, 60, n)
        if k % 4 == 1:
            ids = r.integers(-5, 50_000, n)
        if k % 4 == 2:
            ids = np.where(r.random(n) < 0.05, r.integers(-(2**63), 2**63 - 1, n), ids % 7)
        block = 64 if k % 2 else 256
        assert (S.decode(*[S.encode(ids, counts, block)[i] for i in (0, 1)], counts, *S.encode(ids, counts, block)[2:], block) == ids).all()


@pytest.mark.parametrize("value", [0, 1, 2**60 - 1, 2**60, 2**63 - 1, -1, -(2**63)])
def test_edges(value):
    ids = np.array([value] * 5 + [3, value], np.int64)
    w, s, b, n = S.encode(ids, np.array([7]))
    assert S.decode(w, s, np.array([7]), b, n).tolist() == ids.tolist()


def test_widths():
    """60 ones take one word; an escape takes two."""
    assert len(S.encode(np.ones(60, np.int64), np.array([60]))[0]) == 1
    assert len(S.encode(np.array([-1]), np.array([1]))[0]) == 2


def test_blocks_stand_alone():
    ids = np.arange(1000)
    w, s, b, n = S.encode(ids, np.array([1000]), 256)
    assert n.tolist() == [4] and b[0] == 0 and (np.diff(b) > 0).all()
    lone = S.decode(w[b[2] : b[3]], np.array([b[3] - b[2]]), np.array([256]), np.array([0]), np.array([1]), 256)
    assert (lone == ids[512:768]).all()


def test_frames(spark):
    rows = [(1, [5, -7, 2**62], "x"), (2, None, "x"), (3, [], "x"), (3, [1] * 700, "x"), (None, [9], "x")]
    lists = spark.createDataFrame(rows, "doc_id long, token_ids array<long>, packed string")
    back = S.unpack_ids(S.pack_ids(lists))
    assert sorted(((r.doc_id, r.token_ids) for r in back.collect()), key=str) == sorted([r[:2] for r in rows], key=str)
    holes = spark.createDataFrame([(1, [1, None, 2])], "doc_id long, token_ids array<long>")
    assert S.unpack_ids(S.pack_ids(holes)).first().token_ids == [1, 2]
    assert S.pack_ids(lists.limit(0)).count() == 0


def test_corpus(spark, sf_dir):
    from pagewright.llm import bpe

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id: r.token_ids for r in bpe.encode(docs, vocabulary()).collect()}
    back = {r.doc_id: r.token_ids for r in S.unpack_ids(S.pack_tokens(docs, vocabulary())).collect()}
    assert ids == back


def test_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in S.pack_tokens(docs, vocabulary()).collect()}
    assert got[1].packed is None and got[1].n_ids == 0 and got[2].packed == b"" and got[2].block_offsets == []


def slow_words(values, block):
    """Words of one list: at each place the selector that fits the most of the values that are left in the block."""
    kinds = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
    out, starts = [], []
    for lo in range(0, len(values), block):
        part, i = values[lo : lo + block], 0
        starts.append(len(out))
        while i < len(part):
            for n, bits in kinds:
                some = part[i : i + n]
                if all(0 <= v < 1 << bits for v in some) and (len(some) == n or len(some) == len(part) - i):
                    out.append(len(some))
                    i += len(some)
                    break
            else:
                out += [1, 0]
                i += 1
    return len(out), starts


def test_sizes_against_slow_encoder():
    """No list takes more words than a slow greedy encoder needs, and blocks start at the same words."""
    r = np.random.default_rng(12)
    for _ in range(60):
        top = int(r.choice([1, 2, 50, 1000, 60_000, 1 << 40]))
        values = r.integers(0, top + 1, int(r.integers(0, 700)))
        words, sizes, _, blocks = S.encode(values, np.array([len(values)]), 256)[:4]
        n, starts = slow_words(values.tolist(), 256)
        assert len(words) <= n and len(starts) == -(-len(values) // 256)
