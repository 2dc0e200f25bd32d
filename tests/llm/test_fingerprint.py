import random

from conftest import same

from pagewright.llm import fingerprint as P


def test_oracle(spark, sf_dir, duck):
    same(P.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), duck.execute(P.ORACLE).df())


def test_order_and_increments():
    lines = ["one", "two", "two", " three\t", "", "é 漢"]
    f = P.of_text("\n".join(lines))
    rnd = random.Random(1)
    for _ in range(5):
        rnd.shuffle(lines)
        assert P.of_text("\n".join(lines)) == f
    assert P.insert(P.of_text("one\ntwo"), "two\nthree\né 漢") == f
    assert P.delete(f, "two") == P.of_text("one\ntwo\nthree\né 漢")
    assert P.delete(P.of_text("x"), "x") == P.of_text("") == "0" * 256
    assert P.of_text("one\ntwo") != P.of_text("one\ntwo\ntwo")


def test_columns_add_up(spark):
    df = spark.createDataFrame([(P.of_text("a\nb"), P.of_text("c")), (P.of_text(""), P.of_text("z"))], "a string, b string")
    rows = df.select(P.combine(df.a, df.b).alias("s"), P.combine(df.a, df.b, -1).alias("d")).collect()
    assert rows[0].s == P.of_text("a\nb\nc") and rows[1].s == P.of_text("z")
    assert P.insert(rows[0].d, "c") == P.of_text("a\nb")


def test_edges(spark):
    rows = [(1, None, "q"), (2, "", "q"), (2, "x\ny", "q"), (None, "y\r\n x ", "q"), (5, "z\n" * 100_000, "q")]
    got = P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    assert len(got) == 5
    by = {(r.doc_id, r.n_paragraphs): r.fingerprint for r in got}
    assert by[(1, 0)] is None and by[(2, 0)] == "0" * 256 and by[(2, 2)] == by[(None, 2)] and (5, 100_000) in by
    assert P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, x string").limit(0)).count() == 0
