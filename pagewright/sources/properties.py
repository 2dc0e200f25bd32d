"""Properties of files as columns: office core properties, EXIF tags; JSON lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from ..functions.metadata import exif_datetime
from .office import CORE, core_properties, exif

_MAP = MapType(StringType(), StringType())


@F.pandas_udf(_MAP)
def _core(content: pd.Series) -> pd.Series:
    def one(c: bytes | None) -> dict | None:
        try:
            return {k: v for k, v in core_properties(bytes(c)).items() if v is not None} if c is not None else None
        except Exception:  # noqa: BLE001  a file that isn't an archive has no properties
            return None

    return content.map(one)


@F.pandas_udf(_MAP)
def _exif(content: pd.Series) -> pd.Series:
    return content.map(lambda c: exif(bytes(c)) if c is not None else None)


def core(content: Column) -> Column:
    """A struct of an office archive's core properties; null for other content."""
    m = _core(content)
    return F.when(m.isNotNull(), F.struct(*[m[k].alias(k) for k in CORE]))


def exif_tags(content: Column) -> Column:
    """A map of a JPEG's EXIF tags, empty where it has none."""
    return _exif(content)


def taken_at(content: Column) -> Column:
    """The time that a JPEG's EXIF block gives; null where it is missing or malformed."""
    return exif_datetime(_exif(content)["DateTime"])


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, a file for each partition, nulls left out."""
    df.write.option("ignoreNullFields", "true").json(path)
