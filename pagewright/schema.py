"""The element row, its nested metadata, and the names of element types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = "array<struct<x:double,y:double>>"
COORDINATES = f"struct<points:{POINTS},system:string,layout_width:double,layout_height:double>"
DATA_SOURCE = "struct<url:string,version:string,record_locator:map<string,string>,date_created:string,date_modified:string,date_processed:string>"
REGEX_METADATA = "map<string,array<struct<text:string,start:int,end:int>>>"

METADATA_FIELDS: dict[str, str] = {
    "coordinates": COORDINATES,
    "data_source": DATA_SOURCE,
    "filename": "string",
    "file_directory": "string",
    "last_modified": "string",
    "filetype": "string",
    "attached_to_filename": "string",
    "page_number": "int",
    "page_name": "string",
    "url": "string",
    "link_urls": "array<string>",
    "link_texts": "array<string>",
    "sent_from": "array<string>",
    "sent_to": "array<string>",
    "subject": "string",
    "section": "string",
    "header_footer_type": "string",
    "emphasized_text_contents": "array<string>",
    "emphasized_text_tags": "array<string>",
    "text_as_html": "string",
    "regex_metadata": REGEX_METADATA,
    "extra_data": "string",
}
METADATA = "struct<" + ",".join(f"{k}:{v}" for k, v in METADATA_FIELDS.items()) + ">"
ELEMENT_FIELDS: dict[str, str] = {
    "doc_id": "bigint",
    "ord": "int",
    "page_number": "int",
    "element_id": "string",
    "type": "string",
    "text": "string",
    "checked": "boolean",
    "name": "string",
    "datestamp": "timestamp",
    "metadata": METADATA,
}
ELEMENTS = ", ".join(f"{k} {v}" for k, v in ELEMENT_FIELDS.items())

#: The types that a serialised element may name, and the type each stands for.
TYPE_OF_NAME: dict[str, str] = {
    "UncategorizedText": "UncategorizedText",
    "Text": "NarrativeText",
    "NarrativeText": "NarrativeText",
    "BulletedText": "ListItem",
    "ListItem": "ListItem",
    "List-item": "ListItem",
    "Title": "Title",
    "Figure": "FigureCaption",
    "FigureCaption": "FigureCaption",
    "Image": "Image",
    "Address": "Address",
    "EmailAddress": "EmailAddress",
    "Table": "Table",
    "Header": "Header",
    "Footer": "Footer",
    "PageBreak": "PageBreak",
    "CheckBox": "CheckBox",
    "Checked": "CheckBox",
    "Unchecked": "CheckBox",
}
TEXT_TYPES = sorted(set(TYPE_OF_NAME.values()) - {"CheckBox", "PageBreak"})


def canonical_type(name: Column) -> Column:
    """The type of a serialised name; null for unknown names."""
    return F.create_map(*[F.lit(x) for kv in TYPE_OF_NAME.items() for x in kv])[name]


def metadata(**given: Column) -> Column:
    """A metadata struct with the given fields, all others null."""
    unknown = set(given) - set(METADATA_FIELDS)
    if unknown:
        raise ValueError(f"no such metadata fields: {sorted(unknown)}")
    return F.struct(*[(given[k] if k in given else F.lit(None)).cast(v).alias(k) for k, v in METADATA_FIELDS.items()])


def element_schema() -> T.StructType:
    return T._parse_datatype_string(ELEMENTS)
