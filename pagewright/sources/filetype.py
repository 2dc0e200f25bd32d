"""What kind of file something is: by its content type, its first bytes, its name, and, for archives, its members."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.metadata import base64_content, extension, file_name

TYPES = "UNK EMPTY PDF DOC DOCX JPG PNG EML XML HTML MD ORG RST XLSX PPTX XLS PPT RTF TXT JSON EPUB MSG ODT CSV TSV ZIP".split()
_EXTENSIONS = """
PDF pdf; DOC doc; DOCX docx; JPG jpg jpeg; PNG png; EML eml; XML xml; HTML htm html; MD md; ORG org; RST rst; XLSX xlsx; PPTX pptx; XLS xls; PPT ppt; RTF rtf; JSON json;
EPUB epub; MSG msg; ODT odt; CSV csv; TSV tsv tab; ZIP zip; TXT txt text log js py java cpp cc cxx c cs php rb swift ts go
"""
EXTENSIONS = {"." + e: k.split()[0] for k in _EXTENSIONS.replace("\n", " ").split(";") for e in k.split()[1:]}
_OOXML = "application/vnd.openxmlformats-officedocument."
MIME = {
    "PDF": ["application/pdf"],
    "DOC": ["application/msword"],
    "DOCX": [_OOXML + "wordprocessingml.document"],
    "XLSX": [_OOXML + "spreadsheetml.sheet"],
    "PPTX": [_OOXML + "presentationml.presentation"],
    "XLS": ["application/vnd.ms-excel"],
    "PPT": ["application/vnd.ms-powerpoint"],
    "JPG": ["image/jpeg"],
    "PNG": ["image/png"],
    "TXT": ["text/plain"],
    "CSV": ["text/csv", "application/csv", "text/x-csv", "application/x-csv", "text/comma-separated-values", "text/x-comma-separated-values"],
    "TSV": ["text/tsv"],
    "MD": ["text/markdown", "text/x-markdown"],
    "ORG": ["text/org"],
    "RST": ["text/x-rst"],
    "EPUB": ["application/epub", "application/epub+zip"],
    "JSON": ["application/json"],
    "RTF": ["application/rtf", "text/rtf"],
    "HTML": ["text/html"],
    "XML": ["application/xml", "text/xml"],
    "ODT": ["application/vnd.oasis.opendocument.text"],
    "EML": ["message/rfc822"],
    "MSG": ["application/vnd.ms-outlook", "application/x-ole-storage"],
    "EMPTY": ["inode/x-empty"],
}
CODE_NAMES = "go java javascript php python ruby swift typescript c++ csharp".split()
MAIL_START = r"\A(?:MIME-Version: 1.0[^\n]*\n)?Date:"
MAIL_FIELDS = ("\nMessage-ID:", "\nSubject:", "\nFrom:", "\nTo:")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def type_of_extension(path: Column) -> Column:
    return F.coalesce(_map(EXTENSIONS)[extension(path)], F.lit("UNK"))


def type_of_mime(mime: Column) -> Column:
    return _map({m: k for k, ms in MIME.items() for m in ms})[F.lower(F.trim(F.substring_index(mime, ";", 1)))]


def mime_of_type(kind: Column) -> Column:
    return _map({k: ms[0] for k, ms in MIME.items()})[kind]


def is_code_mime_type(mime: Column) -> Column:
    """Source code of a known language; Go by its full name, as its short one is in many words."""
    return (mime == "text/x-go") | F.exists(F.array(*[F.lit(c) for c in CODE_NAMES if c != "go"]), lambda c: F.contains(mime, c))


def is_json(text: Column) -> Column:
    """Whether the text parses as JSON of an object or a list; the whole text counts, not only its head."""
    opens = text.rlike(r"\A\s*[\[{]")
    return opens & F.try_parse_json(F.when(opens, text)).isNotNull()


def comma_count(line: Column) -> Column:
    """Commas outside of double quotes."""
    return F.length(F.regexp_replace(F.regexp_replace(line, r'"[^"]*"', ""), "[^,]", ""))


def is_csv(text: Column) -> Column:
    """At least two lines, and as many commas outside of double quotes, one at least, in each that holds anything; quotes
    may hold line breaks."""
    bare = F.regexp_replace(text, r'"[^"]*"', "q")
    lines = F.filter(F.split(bare, r"\r?\n"), lambda x: F.trim(x) != "")
    n = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))
    alike = F.transform(F.array(n), lambda n: (F.size(n) >= 2) & F.coalesce(F.array_min(n) > 0, F.lit(False)) & (F.array_min(n) == F.array_max(n)))
    return F.get(alike, F.lit(0))  # as an argument, the list is made once


def is_mail(text: Column) -> Column:
    """Whether the text starts with a date and has the fields of a mail after it, in their usual order."""
    at = F.lit(1)
    for field in MAIL_FIELDS:
        at = F.when(at > 0, F.call_function("locate", F.lit(field), text, at)).otherwise(0)
    return text.rlike(MAIL_START) & (at > 0)


def is_text(text: Column) -> Column:
    """Whether there is no NUL and other control characters are less than one in a hundred, in all of the text."""
    odd = F.length(text) - F.length(F.regexp_replace(text, "[\\x01-\\x08\\x0E-\\x1A\\x1C-\\x1F]", ""))
    return ~text.contains("\0") & (odd * 100 <= F.length(text))


@F.pandas_udf(StringType())
def _wide_text(content: pd.Series) -> pd.Series:
    from .plain import decode

    return content.map(lambda c: decode(c)[1] if c is not None else None)


def sniffed(content: Column) -> Column:
    """Bytes as characters for telling types apart, one for one, which never fails: what tells types is ASCII in UTF-8,
    Latin-1, GB18030 and their like. Only text in two or four bytes a character, which has a mark, is decoded."""
    wide = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF") | F.hex(F.substring(content, 1, 4)).isin("0000FEFF")
    plain = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 1 << 30)).otherwise(content)
    return F.when(wide, _wide_text(F.when(wide, content))).otherwise(F.decode(plain, "ISO-8859-1"))


@F.pandas_udf(StringType())
def _archive_type(content: pd.Series) -> pd.Series:
    from .office import archive_type

    return content.map(lambda c: archive_type(c) if c is not None else None)


def _once(value: Column, f) -> Column:  # noqa: ANN001
    """``f`` of a value that is made once, as the argument of a lambda; columns that are projected before are put in again
    wherever they are used."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def type_of_content(content: Column, path: Column) -> Column:
    """By the first bytes; text is told apart by all of it, and by the name where the text doesn't decide. No bytes
    make this fail, whatever their encoding. Archives are opened, and only they are sent to Python."""
    zipped = F.hex(F.substring(content, 1, 4)) == "504B0304"
    known = F.struct(content.alias("content"), sniffed(content).alias("text"), _archive_type(F.when(zipped, content)).alias("archive"), type_of_extension(path).alias("name"))

    def kind(x: Column, text_like: Column) -> Column:
        magic, text, by_name = F.hex(F.substring(x["content"], 1, 8)), x["text"], x["name"]
        return (
            F.when(x["content"].isNull() | (F.length(x["content"]) == 0), "EMPTY")
            .when(magic.startswith("25504446"), "PDF")
            .when(magic.startswith("FFD8FF"), "JPG")
            .when(magic.startswith("89504E470D0A1A0A"), "PNG")
            .when(magic.startswith("7B5C727466"), "RTF")
            .when(magic.startswith("504B0304"), x["archive"])
            .when(magic.startswith("D0CF11E0A1B11AE1"), F.when(by_name.isin("DOC", "XLS", "PPT", "MSG"), by_name).otherwise("MSG"))
            .when(text_like & is_mail(text), "EML")
            .when(text_like & ~by_name.isin("UNK", "TXT", "ZIP"), by_name)
            .when(text_like & is_json(text), "JSON")
            .when(text_like & text.rlike(r"(?i)\A\s*(<!doctype html|<html)"), "HTML")
            .when(text_like & text.rlike(r"\A\s*<\?xml"), "XML")
            .when(text_like & is_csv(text), "CSV")
            .when(text_like, "TXT")
            .otherwise(by_name)
        )

    return _once(known, lambda x: _once(is_text(x["text"]), lambda text_like: kind(x, text_like)))


def scan(spark: SparkSession, path: str, recursive: bool = True, **options: str) -> DataFrame:
    """Files below a path: doc_id (a hash of the path), path, modificationTime, length, content. Give ``pathGlobFilter``
    to choose by name; filters on path, time and length reach the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path).withColumn("doc_id", F.xxhash64("path"))


def detect(files: DataFrame, content_type: str | None = None) -> DataFrame:
    """With ``filetype``: the content type's if it is known (a column), else the content's."""
    own = type_of_content(F.col("content"), F.col("path"))
    return files.withColumn("filetype", F.coalesce(type_of_mime(F.col(content_type)), own) if content_type else own)


def profile(files: DataFrame) -> DataFrame:
    """filename, path, filesize, extension and filetype of files."""
    return detect(files).select(file_name(F.col("path")).alias("filename"), "path", F.col("length").alias("filesize"), extension(F.col("path")).alias("extension"), "filetype")


def profile_base64(rows: DataFrame, contents: str = "contents", names: str = "filename") -> DataFrame:
    """The same of files given as base64 text."""
    b = rows.withColumn("_c", base64_content(F.col(contents)))
    return b.select(F.col(names).alias("filename"), F.length("_c").alias("filesize"), extension(F.col(names)).alias("extension"), type_of_content(F.col("_c"), F.col(names)).alias("filetype"))
