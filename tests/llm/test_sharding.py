import math
from collections import defaultdict

from pagewright.llm import sharding as S


def check(docs, out, splitters, shards, slack):
    """Every record once, in the range where its key falls; no range too large that could be divided."""
    rows = out.collect()
    assert len(rows) == docs.count()
    size = defaultdict(int)
    keys = defaultdict(set)
    for r in rows:
        want = sum(S.order(*s) <= S.order(r.source, r.doc_id) for s in splitters)
        assert r.shard == want
        size[want] += max(1, len((r.text or "").encode()))
        keys[want].add((r.source, r.doc_id))
    share = sum(size.values()) / shards
    assert all(v <= slack * share or len(keys[k]) == 1 for k, v in size.items())


def test_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for shards, samples in ((8, 3), (30, 2), (1, 5)):
        splitters, n = S.splitters_of(docs, "source", "doc_id", "text", shards, samples)
        assert n == shards
        assert splitters == sorted(set(splitters), key=lambda s: S.order(*s))
        check(docs, S.shard(docs, shards=shards, samples=samples), splitters, shards, S.SLACK)


def test_partition_is_the_shard(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = S.shard(docs, shards=5, samples=4).select("shard", F.spark_partition_id().alias("p"))
    assert out.filter("shard <> p").count() == 0


def test_edges(spark):
    rows = [(None, None, "x", 7), (None, 1, None, 7), ("a", 2, "", 7), ("a", 2, "", 7), ("hot", 3, "y" * 50000, 7)] + [("hot", k, "z" * 100, 7) for k in range(4, 200)]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string, shard int")
    splitters, _ = S.splitters_of(docs, "source", "doc_id", "text", 4, 2)
    out = S.shard(docs, shards=4, samples=2)
    assert out.columns == docs.columns
    check(docs, out, splitters, 4, S.SLACK)
    assert S.shard(docs.limit(0)).count() == 0


def test_many_splitters(spark):
    """Beyond 64 splitters the place is found in two steps."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), "id")
    cuts = sorted(((str(i), i) for i in range(0, 1000, 5)), key=lambda s: S.order(*s))
    got = df.withColumn("r", S.range_of(F.col("k"), F.col("id"), cuts, T.StringType(), T.LongType())).collect()
    assert all(r.r == sum(S.order(*c) <= S.order(r.k, r.id) for c in cuts) for r in got)


def test_number_of_shards_follows_the_size(spark, sf_dir):
    """One for every target's bytes; more than the driver cuts by itself come from subdividing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = sum(max(1, len(r.text.encode())) for r in docs.select("text").collect())
    for target, coarse in ((total // 3, 512), (total // 40, 4)):
        splitters, n = S.splitters_of(docs, "source", "doc_id", "text", None, 3, target=target, coarse=coarse)
        assert n == -(-total // target)
        check(docs, S.shard(docs, shards=n, samples=3), S.splitters_of(docs, "source", "doc_id", "text", n, 3)[0], n, S.SLACK)
        size, keys = defaultdict(int), defaultdict(set)
        for r in docs.collect():
            at = sum(S.order(*s) <= S.order(r.source, r.doc_id) for s in splitters)
            size[at] += len(r.text.encode())
            keys[at].add((r.source, r.doc_id))
        assert all(v <= S.SLACK * total / n or len(keys[k]) == 1 for k, v in size.items())


def test_searched_table(spark, monkeypatch):
    """Many splitters are searched in a table, with the same result as by literals."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    rows = [(k, i) for k in (None, "", "a", "b", "é", "漢") for i in (None, 0, 5, 7, 100)]
    cuts = sorted([("a", 5), ("a", 7), ("b", 0), ("é", 5), (None, 7)], key=lambda s: S.order(*s))
    monkeypatch.setattr(S, "LITERALS", 2)
    for id_type, cast in ((T.LongType(), lambda i: i), (T.StringType(), lambda i: None if i is None else str(i))):
        mine = [(k, cast(i)) for k, i in rows]
        own = sorted([(k, cast(i)) for k, i in cuts], key=lambda s: S.order(*s))
        df = spark.createDataFrame(mine, T.StructType([T.StructField("k", T.StringType()), T.StructField("i", id_type)]))
        a = S.placed_by(spark, F.col("k"), F.col("i"), own, T.StringType(), id_type)
        b = S.range_of(F.col("k"), F.col("i"), own, T.StringType(), id_type)
        for r in df.select("k", "i", a.alias("a"), b.alias("b")).collect():
            assert r.a == r.b == sum(S.order(*c) <= S.order(r.k, r.i) for c in own)


def test_sample_against_brute_force(spark, sf_dir):
    """What is drawn is what a slow race draws, and the splitters are its weighted quantiles."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("source", "doc_id", F.greatest(F.octet_length("text"), F.lit(1)).cast("double").alias("w"), F.pmod(F.xxhash64("source", "doc_id"), F.lit(1 << 52)).alias("h")).collect()
    total, pieces, samples = sum(r.w for r in rows), 4, 10
    drawn = sorted(((r.source, r.doc_id, r.w) for r in rows if -math.log((r.h + 0.5) / 2**52) / r.w < pieces * samples / total), key=lambda r: S.order(r[0], r[1]))
    assert 20 <= len(drawn) <= 60
    weight = [w / (1 - math.exp(-w * pieces * samples / total)) for *_, w in drawn]
    want, run = [], 0.0
    for (k, i, _), w in zip(drawn, weight):
        if run and len(want) < pieces - 1 and run + w / 2 >= sum(weight) * (len(want) + 1) / pieces:
            want.append((k, i))
        run += w
    assert S.splitters_of(docs, "source", "doc_id", "text", pieces, samples, slack=1e9)[0] == want


def test_weighted_quantiles():
    sample = [("k", i, 1.0 + 9 * (i % 2), i * 0.1) for i in range(100)]
    cuts = S.quantiles(sample, 4, None)
    sums, at = [0.0], 0
    for r in sample:
        if at < len(cuts) and (r[0], r[1]) == cuts[at]:
            sums.append(0.0)
            at += 1
        sums[-1] += r[2]
    assert len(sums) == 4 and max(sums) - min(sums) <= 20
    assert math.isclose(sum(sums), sum(r[2] for r in sample))
    assert S.quantiles([], 4, None) == []
