"""Plain text, Markdown, XML, JSON lists of elements, and separated values, for parsers that work a file at a time.

Where a table of texts is at hand, ``functions.paragraphs.partition_text`` does the same in Columns; this is for the
bodies of files that need a parser anyway.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree as ET

from .html import markdown, read

ENCODINGS = ("utf-8", "iso_8859_1")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]”’]*\s+|(?<=[。！？])")


def decode(content: bytes, encoding: str | None = None) -> tuple[str, str]:
    """(encoding, text): a byte-order mark decides, then UTF-8 if it fits, else Latin-1, which fits anything."""
    if encoding:
        return encoding, content.decode(encoding)
    for mark, enc in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return enc, content.decode(enc, "replace")
    for enc in ENCODINGS:
        try:
            return enc, content.decode(enc)
        except UnicodeDecodeError:
            continue
    return "utf-8", content.decode("utf-8", "replace")


def pack(text: str, most: int | None) -> list[str]:
    """Sentences packed to chunks of at most ``most`` characters, long ones cut at blanks."""
    if most is None or len(text) <= most:
        return [text] if text.strip() else []
    out, now = [], ""
    for s in _SENTENCE.split(text):
        while len(s) > most:
            cut = s.rfind(" ", 1, most + 1)
            cut = cut if cut > 0 else most
            if now:
                out.append(now)
                now = ""
            out.append(s[:cut].rstrip())
            s = s[cut:].lstrip()
        if s and now and len(now) + 1 + len(s) > most:
            out.append(now)
            now = s
        elif s:
            now = f"{now} {s}" if now else s
    return [*out, now] if now else out


def paragraphs(text: str, most: int | None = 1500) -> Iterator[dict]:
    for p in re.split(r"\s*\n\s*", text.strip()):
        for c in pack(p, most):
            yield {"text": c}


def read_xml(text: str, keep_tags: bool = False, path: str = ".", most: int | None = 1500) -> Iterator[dict]:
    """The texts of the leaves below ``path``, or the markup as text."""
    if keep_tags:
        yield from paragraphs(text, most)
        return
    for top in ET.fromstring(text).iterfind(path):
        for e in top.iter():
            if len(e) == 0 and e.text and e.text.strip():
                yield from paragraphs(e.text, most)


def _inline(s: str) -> str:
    s = escape(s, quote=False)
    s = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", s)
    s = re.sub(r"\[([^\]]+)\]\(([^)\s]+)[^)]*\)", r'<a href="\2">\1</a>', s)
    s = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"<b>\2</b>", s)
    s = re.sub(r"(?<!\w)([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)", r"<i>\2</i>", s)
    return re.sub(r"`([^`]+)`", r"\1", s)


def markdown_to_html(text: str) -> str:
    """The common part of Markdown: headings, lists, tables, rules, fenced code, quotes, paragraphs, inline marks."""
    out: list[str] = []
    lines = text.replace("\r\n", "\n").split("\n")
    i, para = 0, []

    def flush() -> None:
        if para:
            out.append("<p>" + _inline(" ".join(para)) + "</p>")
            para.clear()

    while i < len(lines):
        s = lines[i].strip()
        nxt = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if not s:
            flush()
        elif s.startswith(("```", "~~~")):
            flush()
            code = []
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(s[:3]):
                code.append(lines[i])
                i += 1
            out.append("<p>" + escape("\n".join(code), quote=False) + "</p>")
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", s):
            flush()
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
        elif not para and re.fullmatch(r"(?:[-*_]\s*){3,}", s):
            out.append("<hr>")
        elif re.fullmatch(r"=+|-{2,}", nxt) and not s.startswith(("-", "*", "+", "|")):
            flush()
            out.append(f"<h{1 if nxt[0] == '=' else 2}>{_inline(s)}</h{1 if nxt[0] == '=' else 2}>")
            i += 1
        elif "|" in s and re.fullmatch(r"\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?", nxt):
            flush()
            rows = [s]
            i += 2
            while i < len(lines) and "|" in lines[i]:
                rows.append(lines[i].strip())
                i += 1
            i -= 1
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_inline(c.strip())}</td>" for c in r.strip("|").split("|")) + "</tr>" for r in rows) + "</table>")
        elif m := re.match(r"(?:[-*+]|\d+[.)])\s+(.*)", s):
            flush()
            out.append(f"<li>{_inline(m[1])}</li>")
        else:
            para.append(re.sub(r"^>\s?", "", s))
        i += 1
    flush()
    return "\n".join(out)


def read_markdown(text: str) -> Iterator[dict]:
    yield from read(markdown_to_html(text))


def read_separated(text: str, separator: str = ",", include_header: bool = False) -> Iterator[dict]:
    """One Table of all rows; the first, the names, is left out unless it is wanted."""
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=separator) if r]
    rows = rows if include_header else rows[1:]
    if rows:
        html = "<table>" + "".join("<tr>" + "".join(f"<td>{escape(c, quote=False)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
        yield {"kind": "Table", "text": "\n".join(" ".join(r) for r in rows), "text_as_html": html}


def table_text(text: str, separator: str = ",") -> str:
    return markdown([r for r in csv.reader(io.StringIO(text), delimiter=separator) if r], widen=3)


def read_isd(text: str) -> Iterator[dict]:
    """Elements of a JSON list; unknown types are left out, text that isn't a list is an error."""
    from ..schema import TYPE_OF_NAME

    if not re.match(r"\A\s*\[\s*\{?", text):
        raise ValueError("not a JSON list of elements")
    for e in json.loads(text):
        kind = TYPE_OF_NAME.get(e.get("type") or "") if isinstance(e, dict) else None
        if kind:
            m = e.get("metadata") or {}
            yield {"kind": kind, "text": e.get("text"), "page_number": m.get("page_number"), "text_as_html": m.get("text_as_html"), "page_name": m.get("page_name"), "section": m.get("section")}


def as_json_list(rows: list[dict]) -> str:
    return json.dumps(rows, ensure_ascii=False)
