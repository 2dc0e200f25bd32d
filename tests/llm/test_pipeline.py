from pyspark.sql import types as T

import corpus_pipeline as CP
from pagewright.llm import bpe, decontaminate, jaccard, language
from pagewright.llm.queries import vocabulary


def test_stages(spark, sf_dir):
    """Each stage against brute force on what the stage before it left."""
    from test_jaccard import brute as similar
    from test_lines import brute as lined

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in CP.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    left = [docs]
    for _, stage in CP.STAGES:
        left.append(stage(spark, left[-1], sf_dir).checkpoint())
        if len(left) < 6:
            assert [(f.name, f.dataType) for f in left[-1].schema] == [(f.name, f.dataType) for f in docs.schema]
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in left[:5]]

    judged = {r.doc_id for r in language.identify(docs).filter("accepted").collect()}
    assert {d for d, _ in rows[1]} == judged and len(judged) > 0.98 * len(rows[0])

    before = dict(rows[1])
    want = {(d, t) for d, t, n, gone in lined(rows[1], 4) if not gone or t.strip(" \t\r\n")}
    assert set(rows[2]) == want and all(before[d] == t or len(t) < len(before[d]) for d, t in rows[2])

    link = {d: d for d, _ in rows[2]}
    root = lambda x: x if link[x] == x else root(link[x])
    for a, b in similar(rows[2]):
        x, y = root(a), root(b)
        link[max(x, y)] = min(x, y)
    assert {d for d, _ in rows[3]} == {d for d in link if root(d) == d}

    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {d for d, _ in rows[4]}
    for d, t in rows[3]:
        if any(x in decontaminate.normal(t) for x in items):
            assert d not in kept
    assert len(kept) > 0.8 * len(rows[3])

    coder = bpe.load(vocabulary())
    texts = dict(rows[4])
    for r in left[5].collect():
        assert b"".join(coder.tokens[i] for i in r.token_ids).decode() == texts[r.doc_id]


def test_run(spark, sf_dir):
    out = CP.run(spark, sf_dir)
    assert out.schema.fieldNames() == ["doc_id", "n_tokens", "token_ids"] and out.count() > 0


def test_empty_and_nulls(spark, sf_dir):
    """What is left by each stage, beside columns that the operators use as names of their own."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    schema = T.StructType([*schema.fields, *[T.StructField(n, T.StringType()) for n in ("shard", "_pw_doc", "_pw_gone", "_pw_lines")]])
    word = "the of and the in a text that is of some length and has the words of it "
    rows = [(1, None, None, None, None), (None, word, "en", "s", 14), (2, "", "en", "s", 0), (3, word, "en", "s", 14), (3, word, "en", "s", 14), (4, "123 456", "en", "s", 7), (5, word * 20_000, "en", "s", None)]
    docs = spark.createDataFrame([(*r, "x", "y", None, "z") for r in rows], schema)
    one, two = [(3, 72), (3, 72), (5, 1_440_000), (None, 72)], [(3, 72), (3, 72), (None, 72)]  # 5 has the n-grams of 3
    want = [one, one, two, two]
    empty = spark.createDataFrame([], schema)
    for (name, stage), left in zip(CP.STAGES, [*want, None]):
        docs, empty = stage(spark, docs, sf_dir).checkpoint(), stage(spark, empty, sf_dir).checkpoint()
        assert empty.count() == 0
        if left is not None:
            assert docs.columns == schema.names
            assert sorted(((r.doc_id, len(r.text)) for r in docs.collect()), key=str) == sorted(left, key=str), name
    assert sorted(((r.doc_id, r.n_tokens > 0) for r in docs.collect()), key=str) == sorted([(3, True), (3, True), (None, True)], key=str)


def test_results_dont_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    a = {tuple(r) for r in jaccard.jaccard_pairs(docs.repartition(7)).collect()}
    b = {tuple(r) for r in jaccard.jaccard_pairs(docs.coalesce(1)).collect()}
    assert a == b
