"""Recorded layouts: what a PDF parser or a recognition model gave, as JSON, to the rows that ``operators.layout`` takes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = "array<struct<page:int,line_no:int,text:string,bbox:array<double>,block_type:int>>"
BOXES = "array<struct<page:int,box_id:int,label:int,bbox:array<double>>>"


def _box(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]).drop("bbox")


def lines(recorded: DataFrame, column: str = "lines") -> DataFrame:
    """doc_id, page, line_no, text, block_type and the box of each text line."""
    return _box(recorded.select("doc_id", F.inline(F.from_json(column, LINES))))


def boxes(recorded: DataFrame, column: str = "layout") -> DataFrame:
    """doc_id, page, box_id, label and the box of each layout box."""
    return _box(recorded.select("doc_id", F.inline(F.from_json(column, BOXES))))


def pdf_lines(files: DataFrame) -> DataFrame:
    """The same columns as ``lines``, from the text layers of PDF files (doc_id, content), with y pointing down. Files that
    can't be read have no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .pdf import lines as read

        for b in batches:
            out: list[dict] = []
            for doc, content in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    out += [{"doc_id": doc, **r} for r in read(content)]
                except Exception:  # noqa: BLE001, S112
                    continue
            kinds = {"doc_id": pa.int64(), "page": pa.int32(), "line_no": pa.int32(), "text": pa.string(), "block_type": pa.int32(), **dict.fromkeys(("x0", "y0", "x1", "y1"), pa.float64())}
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in out], t) for k, t in kinds.items()], names=list(kinds))

    return files.select("doc_id", "content").mapInArrow(run, "doc_id long, page int, line_no int, text string, block_type int, x0 double, y0 double, x1 double, y1 double")


def fast_text(recorded: DataFrame) -> DataFrame:
    """Elements of a PDF's own text lines (y pointing up), in order of their place on each page, typed by their text."""
    from ..functions.classify import element_text, element_type
    from ..functions.metadata import element_id
    from ..operators.layout import sort_page_elements

    rows = lines(recorded).filter(F.trim("text") != "")
    rows = rows.select("doc_id", F.col("page").alias("page_number"), "x0", F.col("y0"), element_type(F.col("text")).alias("type"), element_text(F.col("text")).alias("text"))
    return sort_page_elements(rows.withColumn("element_id", element_id(F.col("text"))))
