"""Files to elements: one scan, one parser call a file, and everything else in Columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import staging
from ..sources import filetype, mail, markup, office, ole, pdf, plain
from ..sources.html import read as read_html
from ..sources.raw import elements, parse_files

#: Kinds that need a program, a model or a network that isn't here.
UNAVAILABLE = {
    "JPG": "a recognition model; give its layout as rows to operators.layout instead",
    "PNG": "a recognition model; give its layout as rows to operators.layout instead",
    "ZIP": "a known kind of archive",
    "UNK": "a known kind of file",
}


def parse_one(row: dict, options: dict | None = None) -> Iterator[dict]:
    """Raw elements of one file (filetype, content)."""
    o = options or {}
    kind, content = row["filetype"], row["content"] or b""
    if kind == "EMPTY":
        return
    if kind in UNAVAILABLE:
        raise ValueError(f"{kind} files need {UNAVAILABLE[kind]}")
    most = o.get("max_partition", 1500)
    if kind == "DOCX":
        yield from office.read_docx(content, o.get("include_page_breaks", True), o.get("language", "zh"))
    elif kind == "PPTX":
        yield from office.read_pptx(content, o.get("include_page_breaks", True), o.get("include_slide_notes", False))
    elif kind == "XLSX":
        yield from office.read_xlsx(content, o.get("include_header", True))
    elif kind == "ODT":
        yield from office.read_odt(content)
    elif kind == "EPUB":
        yield from office.read_epub(content)
    elif kind == "EML":
        yield from mail.read_mail(content, o.get("content_source", "text/html"), o.get("include_headers", False), most, o.get("with_attachments", False))
    elif kind == "PDF":
        found = list(pdf.read_pdf(content, o.get("include_page_breaks", True)))
        if not found:
            raise ValueError("no text layer; give the layout of the pages as rows to operators.layout instead")
        yield from found
    elif kind == "XLS":
        yield from ole.read_xls(content, o.get("include_header", True))
    elif kind == "DOC":
        yield from ole.read_doc(content, o.get("include_page_breaks", True))
    elif kind == "PPT":
        yield from ole.read_ppt(content, o.get("include_page_breaks", True))
    elif kind == "MSG":
        yield from ole.read_msg(content, most, o.get("with_attachments", False))
    elif kind == "RTF":
        yield from markup.read_rtf(content.decode("latin-1"), o.get("include_page_breaks", True))
    else:
        _, text = plain.decode(content, o.get("encoding"))
        if kind == "ORG":
            yield from markup.read_org(text)
        elif kind == "RST":
            yield from markup.read_rst(text)
        elif kind == "HTML":
            yield from read_html(text)
        elif kind == "MD":
            yield from plain.read_markdown(text)
        elif kind == "XML":
            yield from plain.read_xml(text, o.get("xml_keep_tags", False), o.get("xml_path", "."), most)
        elif kind == "JSON":
            yield from plain.read_isd(text)
        elif kind in ("CSV", "TSV"):
            yield from plain.read_separated(text, "," if kind == "CSV" else "\t", o.get("include_header", False))
        else:
            yield from plain.paragraphs(text, most)


def raw(files: DataFrame, **options) -> DataFrame:
    """Raw rows of files (doc_id, path, content, filetype), errors included."""
    unknown = files.select("doc_id", "content", "filetype")
    return parse_files(unknown, lambda r: parse_one(r, options), "content", "filetype")


def partition(files: DataFrame, content_type: str | None = None, url: str | None = None, regex_patterns: dict[str, str] | None = None, include_metadata: bool = True, **options) -> DataFrame:
    """Element rows of files as ``sources.filetype.scan`` gives them. Files that can't be read give none; ``errors`` has
    the reasons. ``url`` names a column with the files' addresses, ``regex_patterns`` adds matches to the metadata."""
    known = files if "filetype" in files.columns else filetype.detect(files, content_type)
    return _elements(raw(known, **options), known, url, regex_patterns, include_metadata)


def partition_and_errors(files: DataFrame, content_type: str | None = None, url: str | None = None, regex_patterns: dict[str, str] | None = None, include_metadata: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """What ``partition`` and ``errors`` give, each file parsed once: its raw rows are kept for both (persisted, so the caller may
    free them with ``spark.catalog.clearCache()`` when both are written)."""
    known = files if "filetype" in files.columns else filetype.detect(files, content_type)
    rows = raw(known, **options).persist()
    return _elements(rows, known, url, regex_patterns, include_metadata), rows.filter("error is not null").select("doc_id", "error")


def _elements(rows: DataFrame, known: DataFrame, url: str | None, regex_patterns: dict[str, str] | None, include_metadata: bool) -> DataFrame:
    from ..functions.metadata import regex_metadata, strip_metadata

    out = elements(rows, known)
    if url:
        out = out.join(known.select("doc_id", F.col(url).alias("_url")), "doc_id", "left").withColumn("metadata", F.col("metadata").withField("url", F.col("_url"))).drop("_url")
    if regex_patterns:
        found = regex_metadata(F.col("text"), regex_patterns)
        out = out.withColumn("metadata", F.col("metadata").withField("regex_metadata", F.when(F.size(found) > 0, found)))
    return out if include_metadata else strip_metadata(out)


def errors(files: DataFrame, **options) -> DataFrame:
    """doc_id and why its file couldn't be read."""
    known = files if "filetype" in files.columns else filetype.detect(files)
    return raw(known, **options).filter("error is not null").select("doc_id", "error")


MODES = ("partition", "local_partition", "text", "vis", "topdf")


def serve(files: DataFrame, mode: str = "text", **options) -> DataFrame:
    """A response for each file: status_code, status_message, text, html_text, partitions (JSON). A file that can't be
    read has status 400 and the reason."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if mode == "topdf":
        return to_pdf(files, **options)
    known = files if "filetype" in files.columns else filetype.detect(files)
    rows = raw(known, **options).persist()  # each file is parsed once, for what it holds and for why it failed
    body = elements(rows, known)
    none = F.lit(None).cast("string")
    if mode == "partition":
        done = staging.isd_documents(body).select("doc_id", none.alias("text"), none.alias("html_text"), F.col("isd").alias("partitions"))
    elif mode == "vis":
        done = staging.html_page(body).select("doc_id", none.alias("text"), F.col("html").alias("html_text"), none.alias("partitions"))
    else:
        done = staging.plain_text(body).select("doc_id", "text", none.alias("html_text"), none.alias("partitions"))
    failed = rows.filter("error is not null").groupBy("doc_id").agg(F.first("error").alias("error"))
    out = known.select("doc_id").join(done, "doc_id", "left").join(failed, "doc_id", "left")
    code = F.when(F.col("error").isNull(), 200).otherwise(400)
    return out.select("doc_id", code.alias("status_code"), F.coalesce("error", F.lit("success")).alias("status_message"), "text", "html_text", "partitions")


def to_pdf(files: DataFrame, **options) -> DataFrame:
    """A PDF for each file: doc_id, status_code, status_message and pdf (bytes). PDF files are taken as they are, images
    become a page, and of other files the plain text is set. A file that can't be read has status 400 and the reason."""
    known = files if "filetype" in files.columns else filetype.detect(files)
    rows = raw(known.filter(~F.col("filetype").isin("PDF", "JPG", "PNG")), **options).persist()
    text = staging.plain_text(elements(rows)).select("doc_id", "text")
    failed = rows.filter("error is not null").groupBy("doc_id").agg(F.first("error").alias("error"))
    j = known.select("doc_id", "filetype", F.when(F.col("filetype").isin("PDF", "JPG", "PNG"), F.col("content")).alias("content")).join(text, "doc_id", "left").join(failed, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for kind, content, words, error in zip(*(c.to_pylist() for c in b.columns[1:])):
                made = None
                if error is None:
                    try:
                        made = content if kind == "PDF" else pdf.image_to_pdf(content) if kind in ("JPG", "PNG") else pdf.text_to_pdf(words or "")
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"[:500]
                out.append((400 if error else 200, error or "success", made))
            code, message, made = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.int32()), pa.array(message, pa.string()), pa.array(made, pa.binary())], names=["doc_id", "status_code", "status_message", "pdf"])

    return j.select("doc_id", "filetype", "content", "text", "error").mapInArrow(run, "doc_id long, status_code int, status_message string, pdf binary")


def kept_tables(kind: Column, infer: Column, skip: tuple[str, ...] = ("PDF", "JPG", "PNG")) -> Column:
    """Whether tables are wanted: where asked for, but for the kinds that are left out."""
    return infer & ~kind.isin(*skip)
