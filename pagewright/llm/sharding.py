"""Shards of even size by sampled splitters.

1. The number of shards follows the total size: one for every ``TARGET`` bytes.
2. A size-weighted sample of keys is drawn by an exponential race: a record of size w gets the score -ln(u)/w, u from
   a hash of its key and id, and is drawn if its score is below a line that lets through about as many as wanted (all
   where there aren't more). Each sampled key stands for its size over its chance of being drawn.
3. The sample's weighted quantiles are the splitters, and a record's range is the number of splitters not above it. The
   driver cuts up to ``COARSE`` ranges from a sample of its own; these are then subdivided like any other that is too large.
4. Sizes of all ranges are added up over all records. A range above ``SLACK`` times the even share is subdivided by
   splitters sampled within it, a task for each range, twice as densely each time, until none is left that can be
   divided. Only splitters and the ranges that are too large come to the driver.

Records are ordered by (key, id), so that one key with most of the data (a hot source) is divided by id. A record's
range is found by comparing with literals where splitters are few, and by searching a broadcast sorted table otherwise;
that table has an entry a shard, some 10 MB for the shards of 100 TB.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ensure_checkpoint_dir
from .buffers import ship

#: Bytes of text in a shard: what a consumer reads as one file.
TARGET = 64 << 20
SAMPLES = 200
SLACK = 1.25
#: Ranges that the driver cuts by itself.
COARSE = 512
#: Splitters that are written into the plan as literals; more are searched in a broadcast table.
LITERALS = 4096


def score(key: Column, ident: Column, size: Column) -> Column:
    """The race: low scores win, in proportion to size."""
    u = (F.pmod(F.xxhash64(key, ident), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / size


def quantiles(sample: list[tuple], pieces: int, limit: float | None) -> list[tuple]:
    """Splitters, as (key, id), that cut the sample of (key, id, size, score) into pieces of equal weight.

    ``limit`` is the line below which scores were drawn; None if the sample holds everything."""
    rows = sorted(sample, key=lambda r: order(r[0], r[1]))
    weight = [r[2] if limit is None else r[2] / max(-math.expm1(-r[2] * limit), 1e-12) for r in rows]
    total, out, run, k = sum(weight), [], 0.0, 1
    for n, (r, w) in enumerate(zip(rows, weight)):
        if n and k < pieces and run + w / 2 >= total * k / pieces:  # nearer to the quantile than the place behind it
            if (r[0], r[1]) != (rows[0][0], rows[0][1]) and (not out or out[-1] != (r[0], r[1])):
                out.append((r[0], r[1]))
            while k < pieces and run + w / 2 >= total * k / pieces:
                k += 1
        run += w
    return out


def order(key, ident) -> tuple:
    """Sorts as Spark does: nulls first, text by its UTF-8 bytes."""
    one = lambda x: (0, b"") if x is None else (1, x.encode() if isinstance(x, str) else x)
    return one(key), one(ident)


def range_of(key: Column, ident: Column, splitters: list[tuple], key_type, id_type) -> Column:
    """How many splitters aren't above (key, id)."""
    if not splitters:
        return F.lit(0)
    here = F.struct(key.alias("k"), ident.alias("i"))
    coarse = splitters[::64]

    def lit(rows: list[tuple]) -> Column:
        return F.array(*[F.struct(F.lit(k).cast(key_type).alias("k"), F.lit(i).cast(id_type).alias("i")) for k, i in rows])

    def below(part: Column) -> Column:
        return F.size(F.filter(part, lambda s: s <= here))

    if len(splitters) <= 64:
        return below(lit(splitters))
    block = below(lit(coarse))  # 0, or one more than the number of the 64 that hold the place
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * 64 + below(F.slice(lit(splitters), (block - 1) * 64 + 1, F.lit(64))))


class Splitters:
    """Sorted splitters for searching: the distinct keys, and the ids of each."""

    def __init__(self, splitters: list[tuple]):
        self.keys: list[tuple] = []
        self.first: list[int] = []
        self.ids: list = []
        whole = all(isinstance(i, int) for _, i in splitters)
        for n, (k, i) in enumerate(splitters):
            if not self.keys or self.keys[-1] != order(k, None)[0]:
                self.keys.append(order(k, None)[0])
                self.first.append(n)
                self.ids.append([])
            self.ids[-1].append(i if whole else order(None, i)[1])
        self.first.append(len(splitters))
        self.ids = [np.array(x, np.int64) for x in self.ids] if whole else self.ids

    def place(self, keys: pd.Series, ids: pd.Series) -> pd.Series:
        """How many splitters aren't above each (key, id)."""
        out = np.zeros(len(keys), np.int32)
        for key, at in keys.groupby(keys, sort=False, dropna=False).indices.items() if len(keys) else ():
            k = order(None if pd.isna(key) else key, None)[0]
            n = bisect_right(self.keys, k) - 1
            if n < 0:
                continue
            if self.keys[n] != k:
                out[at] = self.first[n + 1]
                continue
            own = ids.iloc[at]
            if isinstance(self.ids[n], np.ndarray) and not own.isna().any():
                out[at] = self.first[n] + np.searchsorted(self.ids[n], own.to_numpy(np.int64), "right")
            else:
                known = [order(None, int(x))[1] for x in self.ids[n]] if isinstance(self.ids[n], np.ndarray) else self.ids[n]
                out[at] = [self.first[n] + bisect_right(known, order(None, None if pd.isna(i) else i if isinstance(i, str) else int(i))[1]) for i in own]
        return pd.Series(out)


def placed_by(spark: SparkSession, key: Column, ident: Column, splitters: list[tuple], key_type: T.DataType, id_type: T.DataType) -> Column:
    """``range_of``, or the same by search in a broadcast table. Keys and ids of other types than text and whole
    numbers are compared with literals whatever their number."""
    searchable = isinstance(key_type, T.StringType) and isinstance(id_type, (T.StringType, T.LongType, T.IntegerType))
    if len(splitters) <= LITERALS or not searchable:
        return range_of(key, ident, splitters, key_type, id_type)
    ship(spark)
    table = spark.sparkContext.broadcast(Splitters(splitters))
    return F.pandas_udf(lambda k, i: table.value.place(k, i), "int")(key, ident)


def splitters_of(docs: DataFrame, key_col: str, id_col: str, text_col: str, shards: int | None = None, samples: int = SAMPLES, slack: float = SLACK, target: int = TARGET, coarse: int = COARSE) -> tuple[list[tuple], int]:
    """The splitters for ``docs``, and the number of shards that the total size asks for; an even share is the total
    over that number."""
    spark = docs.sparkSession
    ship(spark)
    ensure_checkpoint_dir(spark)
    c = lambda x: docs[f"`{x}`"]
    # the size of a record is that of its text, 1 at least; only (key, id, size) is read again and again
    small = docs.select(c(key_col).alias("k"), c(id_col).alias("i"), F.greatest(F.coalesce(F.octet_length(c(text_col).cast("string")), F.lit(0)), F.lit(1)).cast("double").alias("w")).checkpoint()
    kt, it = small.schema["k"].dataType, small.schema["i"].dataType
    scored = small.withColumn("s", score(F.col("k"), F.col("i"), F.col("w")))

    def line(k: int, weight: float, n: int) -> float | None:
        return k / weight if n > k else None

    whole = small.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), F.count("*").alias("n")).first()
    shards = shards or max(1, math.ceil(whole["w"] / target))
    share = whole["w"] / shards
    pieces = min(shards, coarse)
    limit = line(pieces * samples, whole["w"], whole["n"])
    splitters = quantiles([tuple(r) for r in (scored if limit is None else scored.filter(F.col("s") < limit)).collect()], pieces, limit)
    kept = T.StructType([T.StructField("k", kt), T.StructField("i", it), T.StructField("r", T.IntegerType())])
    for turn in count():  # each turn adds a splitter to every range that is too large, so this ends
        placed = scored.withColumn("r", placed_by(spark, F.col("k"), F.col("i"), splitters, kt, it))
        key = F.struct("k", "i")
        found = placed.groupBy("r").agg(F.sum("w").alias("w"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.max_by(key, F.struct("w", "k", "i")).alias("big"), F.count("*").alias("n"))
        over = found.filter((F.col("w") > slack * share) & ~F.col("lo").eqNullSafe(F.col("hi"))).checkpoint()
        total = over.agg(F.sum(F.ceil(F.col("w") / share)).alias("p"), F.sum("w").alias("w"), F.sum("n").alias("n")).first()
        if not total["n"]:
            return splitters, shards
        inside = placed.join(F.broadcast(over.select("r", "lo", F.ceil(F.col("w") / share).alias("p"))) if total["p"] <= 100_000 else over.select("r", "lo", F.ceil(F.col("w") / share).alias("p")), "r")
        limit = line(int(total["p"]) * samples << min(turn, 10), total["w"], total["n"])
        drawn = inside if limit is None else inside.filter(F.col("s") < limit)
        made = drawn.select("r", "k", "i", "w", "s", "lo", "p").groupBy("r").applyInArrow(_cutting(limit, kept), kept).collect()
        new = [(m["k"], m["i"]) for m in made]
        # where the sample doesn't tell two keys apart the largest record is set apart, or what comes after it
        stuck = over.filter(~F.col("r").isin(sorted({m["r"] for m in made}))) if len(made) < 10_000 else over.join(spark.createDataFrame([(m["r"],) for m in made], "r int").distinct(), "r", "left_anti")
        rest = stuck.select("r", F.when(~F.col("big").eqNullSafe(F.col("lo")), F.col("big")).alias("big"), "lo").collect()
        new += [tuple(x["big"]) for x in rest if x["big"] is not None]
        first = [x["r"] for x in rest if x["big"] is None]
        if first:
            after = inside.filter(F.col("r").isin(first) & (F.struct("k", "i") > F.struct(F.col("lo.k").alias("k"), F.col("lo.i").alias("i"))))
            new += [tuple(m["m"]) for m in after.groupBy("r").agg(F.min(key).alias("m")).collect()]
        splitters = sorted({*splitters, *new}, key=lambda x: order(*x))


def _cutting(limit: float | None, schema: T.StructType):
    """The splitters within one range, from what was drawn of it."""

    def cut(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        lo = order(rows[0]["lo"]["k"], rows[0]["lo"]["i"])
        new = quantiles([(r["k"], r["i"], r["w"], r["s"]) for r in rows], rows[0]["p"], limit)
        return pa.Table.from_pylist([{"k": k, "i": i, "r": rows[0]["r"]} for k, i in new if order(k, i) > lo], to_arrow_schema(schema))

    return cut


def shard(docs: DataFrame, key_col: str = "source", id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, samples: int = SAMPLES, slack: float = SLACK, target: int = TARGET) -> DataFrame:
    """All records, with the number of their shard in ``shard``, moved to the partition of that number. There is a shard for
    every ``target`` bytes of text, or as many as ``shards`` says.

    Shards are ranges of (key, id) in Spark's order, nulls first. A record has the size of its text in bytes, and 1 at
    least, also where the text is null or empty. Records with equal key and id stay together, so a shard may be larger than the
    limit if such records, or one very long record alone, are. Equal rows are all there. Other columns are carried along
    whatever their nulls; one named ``shard`` is replaced. An empty table has no shards and gives no rows."""
    splitters, _ = splitters_of(docs, key_col, id_col, text_col, shards, samples, slack, target)
    kt, it = docs.schema[key_col].dataType, docs.schema[id_col].dataType
    out = docs.withColumn("shard", placed_by(docs.sparkSession, docs[f"`{key_col}`"], docs[f"`{id_col}`"], splitters, kt, it))
    return out.repartitionById(len(splitters) + 1, F.col("shard"))
