"""What SQL can't say by itself, for use in SQL: functions, and a table function to join laterally with a table of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.udtf import UserDefinedTableFunction


class _HtmlElements:
    def eval(self, html: str) -> Iterator[tuple]:
        from pagewright.sources.html import read

        for i, e in enumerate(read(html or "")):
            yield i, e.get("page_number"), e.get("kind"), e.get("tag"), e["text"]


class _Paragraphs:
    def eval(self, text: str, most: int) -> Iterator[tuple]:
        from pagewright.sources.plain import paragraphs

        for i, e in enumerate(paragraphs(text or "", most)):
            yield i, e["text"]


@F.pandas_udf(StringType())
def table_to_markdown(html: pd.Series) -> pd.Series:
    from pagewright.sources.html import table_to_markdown as one

    return html.map(lambda h: None if h is None else one(h)["text"])


@F.pandas_udf(StringType())
def markdown_to_html(text: pd.Series) -> pd.Series:
    from pagewright.sources.plain import markdown_to_html as one

    return text.map(lambda t: None if t is None else one(t))


def register(spark: SparkSession) -> None:
    """``table_to_markdown(html)``, ``markdown_to_html(text)``, and the table functions ``html_elements(html)`` and
    ``text_paragraphs(text, most)``."""
    spark.udf.register("table_to_markdown", table_to_markdown)
    spark.udf.register("markdown_to_html", markdown_to_html)
    tables: dict[str, UserDefinedTableFunction] = {
        "html_elements": F.udtf(_HtmlElements, returnType="ord int, page_number int, kind string, tag string, text string"),
        "text_paragraphs": F.udtf(_Paragraphs, returnType="ord int, text string"),
    }
    for name, f in tables.items():
        spark.udtf.register(name, f)


def exactly_one(**given) -> None:
    """An error unless just one argument is given and not empty."""
    if sum(v is not None and v != "" for v in given.values()) != 1:
        raise ValueError(f"exactly one of {', '.join(given)} must be given")
