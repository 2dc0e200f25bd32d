"""What parsers give: raw element rows, one Python boundary for each file; types are decided in Columns afterwards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import classify as C
from ..functions import text as X
from ..functions.metadata import element_id, file_directory, file_name, last_modified
from ..schema import metadata

FIELDS: dict[str, str] = {
    "page_number": "int",
    "kind": "string",
    "text": "string",
    "tag": "string",
    "ancestortags": "array<string>",
    "heading": "boolean",
    "language": "string",
    "link_texts": "array<string>",
    "link_urls": "array<string>",
    "emphasized_text_contents": "array<string>",
    "emphasized_text_tags": "array<string>",
    "text_as_html": "string",
    "page_name": "string",
    "section": "string",
    "header_footer_type": "string",
    "extra_data": "string",
    "name": "string",
    "sent_from": "array<string>",
    "sent_to": "array<string>",
    "subject": "string",
    "date": "string",
    "attached_to_filename": "string",
    "attachment_name": "string",
    "error": "string",
}
#: Files whose elements make one batch.
ROWS = 64
SCHEMA = "doc_id bigint, ord int, " + ", ".join(f"`{k}` {v}" for k, v in FIELDS.items())


def parse_files(files: DataFrame, parser: Callable[[dict], Iterator[dict]], *columns: str) -> DataFrame:
    """Raw rows of ``parser``, which gets a row's columns and gives dicts of ``FIELDS``. A file that fails gives one row
    with the error, so it doesn't end the job."""

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, cols = b.schema.names, [c.to_pylist() for c in b.columns]
            for at in range(0, b.num_rows, ROWS):
                out: list[dict] = []
                for values in zip(*(c[at : at + ROWS] for c in cols)):
                    row = dict(zip(names, values))
                    try:  # all of a file or none
                        out += [{**r, "doc_id": row["doc_id"], "ord": i} for i, r in enumerate(parser(row))]
                    except Exception as e:  # noqa: BLE001
                        out.append({"doc_id": row["doc_id"], "ord": 0, "error": f"{type(e).__name__}: {e}"[:500]})
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in schema], schema=schema)

    return files.select("doc_id", *columns).mapInArrow(run, SCHEMA)


def classify(raw: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Element rows: the parser's kind where it has one, else the type that the text decides; rows without a type go."""
    t = F.col("text")
    heading = F.coalesce("heading", F.lit(False))
    zh = F.coalesce(F.col("language") == "zh", F.lit(False))
    bare = X.clean_bullets(X.strip(t))
    narrative = ~heading & C.is_possible_narrative_text(t)
    title = F.when(zh, C.is_possible_title(t, language="zh")).otherwise(C.is_possible_title(t))
    kind = (
        F.when(F.col("kind").isNotNull(), F.col("kind"))
        .when(C.is_bulleted_text(t), F.when(bare != "", "ListItem"))
        .when(C.is_us_city_state_zip(t), "Address")
        .when(C.is_email_address(t), "EmailAddress")
        .when(F.length(t) < 2, F.lit(None))
        .when(narrative, "NarrativeText")
        .when(title, "Title")
        .otherwise("UncategorizedText")
    )
    text = F.when(F.col("kind").isNull() & C.is_bulleted_text(t), bare).otherwise(t)
    out = raw.withColumn("type", kind).withColumn("text", text)
    return out if keep_empty else out.filter("type is not null and error is null")


def elements(raw: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Element rows in the schema, with ids and metadata; ``files`` (doc_id, path, modificationTime, filetype) adds names."""
    rows = classify(raw)
    given = {k: F.col(k) for k in ("page_number", "page_name", "section", "header_footer_type", "link_texts", "link_urls", "emphasized_text_contents", "emphasized_text_tags", "text_as_html", "extra_data", "sent_from", "sent_to", "subject", "attached_to_filename")}
    if files is not None:
        f = files.select("doc_id", F.col("path").alias("_path"), last_modified(F.col("modificationTime")).alias("_mod"), F.col("filetype").alias("_ft"))
        rows = rows.join(f, "doc_id", "left")
        given |= {"filename": F.coalesce("attachment_name", file_name(F.col("_path"))), "file_directory": F.when(F.col("attachment_name").isNull(), file_directory(F.col("_path"))), "last_modified": F.coalesce("date", "_mod"), "filetype": F.col("_ft")}
    else:
        given["last_modified"] = F.col("date")
    return rows.select("doc_id", "ord", "page_number", element_id(F.col("text")).alias("element_id"), "type", "text", F.lit(None).cast("boolean").alias("checked"), "name", F.lit(None).cast("timestamp").alias("datestamp"), metadata(**given).alias("metadata"))
