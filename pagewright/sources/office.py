"""Office archives (zip and XML, standard library only): DOCX, XLSX, PPTX, ODT, EPUB, and their core properties."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree as ET

from .html import bulleted, expanded_rows, markdown, norm, read
from .tree import parse

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"

STYLE_KINDS = {
    **dict.fromkeys(("Caption", "Intense Quote", "Macro Text", "No Spacing", "Quote", "TOCHeading"), None),
    **dict.fromkeys(("Title", "Subtitle"), "Title"),
    **dict.fromkeys([f"List{x}{n}" for x in ("", " Bullet", " Continue", " Number") for n in ("", " 2", " 3")] + ["List Paragraph"], "ListItem"),
    "List": "ListItem",
}


def _zip(content: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(content))


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets by id, as names in the archive."""
    name = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if name not in z.namelist():
        return {}
    out = {}
    for r in ET.fromstring(z.read(name)).iter(REL + "Relationship"):
        t = r.get("Target", "")
        out[r.get("Id", "")] = t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(part), t))
    return out


def _html_table(rows: list[list[str]]) -> str:
    return "<table>" + "".join("<tr>" + "".join(f"<td>{escape(c, quote=False)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


# ---- DOCX -----------------------------------------------------------------------------------------------------------


def _runs_text(p: ET.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag == W + "tab":
            out.append("\t")
        elif x.tag in (W + "br", W + "cr") and x.get(W + "type") != "page":
            out.append("\n")
    return "".join(out)


def _emphasised(p: ET.Element) -> tuple[list[str], list[str]]:
    texts, tags = [], []
    for r in p.iter(W + "r"):
        pr = r.find(W + "rPr")
        text = "".join(t.text or "" for t in r.iter(W + "t")).strip()
        if pr is None or not text:
            continue
        for tag in ("b", "i"):
            on = pr.find(W + tag)
            if on is not None and on.get(W + "val") not in ("0", "false"):
                texts.append(text)
                tags.append(tag)
    return texts, tags


def _breaks(e: ET.Element) -> bool:
    return any(b.get(W + "type") == "page" for b in e.iter(W + "br")) or e.find(f".//{W}lastRenderedPageBreak") is not None


def _headers_footers(z: zipfile.ZipFile, sect: ET.Element, rels: dict[str, str], kind: str) -> Iterator[dict]:
    for ref in sect.findall(W + f"{kind}Reference"):
        name = rels.get(ref.get(R + "id", ""))
        if name and name in z.namelist():
            text = "\n".join(_runs_text(p) for p in ET.fromstring(z.read(name)).iter(W + "p"))
            if text.strip():
                form = {"default": "primary", "first": "first_page", "even": "even_page"}.get(ref.get(W + "type", "default"), "primary")
                yield {"kind": kind.capitalize(), "text": text, "header_footer_type": form}


def read_docx(content: bytes, include_page_breaks: bool = True, language: str = "zh") -> Iterator[dict]:
    """Paragraphs, tables, headers and footers in order. Headings are titles with their level; pages are counted where
    the document holds page breaks."""
    z = _zip(content)
    part = "word/document.xml"
    rels = _rels(z, part)
    styles: dict[str, str] = {}
    if "word/styles.xml" in z.namelist():
        for s in ET.fromstring(z.read("word/styles.xml")).iter(W + "style"):
            name = s.find(W + "name")
            styles[s.get(W + "styleId", "")] = name.get(W + "val", "") if name is not None else ""
    body = ET.fromstring(z.read(part)).find(W + "body")
    if body is None:
        return
    sections = list(body.iter(W + "sectPr"))
    page = 1 if _breaks(body) else None
    if sections:
        yield from _headers_footers(z, sections[0], rels, "header")
    section = 0
    for e in body:
        if e.tag == W + "tbl":
            rows = [["\n".join(_runs_text(p) for p in c.iter(W + "p")) for c in r.findall(W + "tc")] for r in e.findall(W + "tr")]
            html = _html_table(rows)
            et, eg = _emphasised(e)
            yield {"kind": "Table", "text": markdown(expanded_rows(parse(html)), widen=3), "text_as_html": html, "page_number": page, "emphasized_text_contents": et or None, "emphasized_text_tags": eg or None}
        elif e.tag == W + "p":
            text = _runs_text(e).strip("\n")
            if text.strip():
                ref = e.find(f"{W}pPr/{W}pStyle")
                style = styles.get(ref.get(W + "val", ""), ref.get(W + "val", "")) if ref is not None else ""
                et, eg = _emphasised(e)
                row: dict = {"text": text, "page_number": page, "language": language, "emphasized_text_contents": et or None, "emphasized_text_tags": eg or None}
                level = re.match(r"[Hh]eading (\d+)", style)
                if "eading" in style:
                    row |= {"kind": "Title", "extra_data": json.dumps({"title_level": int(level[1])}) if level else None}
                elif e.find(f"{W}pPr/{W}numPr") is not None:
                    row["kind"] = "ListItem"
                elif STYLE_KINDS.get(style):
                    row["kind"] = STYLE_KINDS[style]
                elif not bulleted(text):
                    row["heading"] = False
                yield row
        end = e if e.tag == W + "sectPr" else e.find(f"{W}pPr/{W}sectPr")
        if end is not None:
            yield from _headers_footers(z, end, rels, "footer")
            section += 1
            if section < len(sections):
                yield from _headers_footers(z, sections[section], rels, "header")
        if page is not None and _breaks(e):
            page += 1
            if include_page_breaks:
                yield {"kind": "PageBreak", "text": ""}


# ---- XLSX -----------------------------------------------------------------------------------------------------------


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def xlsx_sheets(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows of texts) of each sheet."""
    z = _zip(content)
    names = z.namelist()
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(S + "si")]
    rels = _rels(z, "xl/workbook.xml")
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet"):
        part = rels.get(sheet.get(R + "id", ""))
        if not part or part not in names:
            continue
        rows: list[list[str]] = []
        for r in ET.fromstring(z.read(part)).iter(S + "row"):
            cells: list[str] = []
            for c in r.iter(S + "c"):
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                v = c.find(S + "v")
                kind = c.get("t")
                if kind == "s" and v is not None:
                    text = shared[int(v.text or 0)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(S + "t"))
                elif kind == "b" and v is not None:
                    text = "True" if v.text == "1" else "False"
                else:
                    text = (v.text or "") if v is not None else ""
                cells += [""] * (at - len(cells)) + [text]
            rows.append(cells)
        width = max(map(len, rows), default=0)
        yield sheet.get("name", ""), [r + [""] * (width - len(r)) for r in rows]


def read_xlsx(content: bytes, include_header: bool = True) -> Iterator[dict]:
    """A Table for each sheet, sheets counted as pages."""
    for n, (name, rows) in enumerate(xlsx_sheets(content), 1):
        rows = rows if include_header else rows[1:]
        if rows:
            yield {"kind": "Table", "text": markdown(rows, widen=3), "text_as_html": _html_table(rows), "page_number": n, "page_name": name}


# ---- PPTX -----------------------------------------------------------------------------------------------------------


def _title_like(text: str) -> bool:
    return bool(text) and len(text) <= 30 and not re.search("[。；！|;!]", text)


def read_pptx(content: bytes, include_page_breaks: bool = True, include_slide_notes: bool = False) -> Iterator[dict]:
    """Shapes of each slide by top and left. The first one is a title if it lies near the top and reads like one."""
    z = _zip(content)
    pres = ET.fromstring(z.read("ppt/presentation.xml"))
    size = pres.find(P + "sldSz")
    page_box = [int(size.get("cx", 0)), int(size.get("cy", 0))] if size is not None else [9144000, 6858000]
    rels = _rels(z, "ppt/presentation.xml")
    slides = [rels[s.get(R + "id", "")] for s in pres.iter(P + "sldId") if s.get(R + "id", "") in rels]
    for n, name in enumerate(slides, 1):
        tree = ET.fromstring(z.read(name)).find(f"{P}cSld/{P}spTree")
        if include_slide_notes:
            for target in _rels(z, name).values():
                if "notesSlide" in target and target in z.namelist():
                    text = "\n".join("".join(t.text or "" for t in p.iter(A + "t")) for p in ET.fromstring(z.read(target)).iter(A + "p")).strip()
                    if text:
                        yield {"kind": "NarrativeText", "text": text, "page_number": n}
        shapes = []
        for k, sp in enumerate(tree if tree is not None else ()):
            if sp.tag not in (P + "sp", P + "graphicFrame", P + "pic"):
                continue
            off, ext = sp.find(f".//{A}off"), sp.find(f".//{A}ext[@cx]")
            if off is None:
                off = sp.find(f"{P}xfrm/{A}off")
            box = [int(off.get("x", 0)) if off is not None else 0, int(off.get("y", 0)) if off is not None else 0, int(ext.get("cx", 0)) if ext is not None else 0, int(ext.get("cy", 0)) if ext is not None else 0]
            shapes.append((box[1], box[0], k, box, sp))
        for index, (*_, box, sp) in enumerate(sorted(shapes, key=lambda s: s[:3])):
            table = sp.find(f".//{A}tbl")
            if table is not None:
                rows = [["\n".join("".join(t.text or "" for t in p.iter(A + "t")) for p in c.iter(A + "p")) for c in r.findall(A + "tc")] for r in table.findall(A + "tr")]
                html = _html_table(rows)
                if any(c.strip() for r in rows for c in r):
                    yield {"kind": "Table", "text": markdown(expanded_rows(parse(html)), widen=3), "text_as_html": html, "page_number": n}
                continue
            body = sp.find(P + "txBody")
            if body is None:
                continue
            whole = "\n".join("".join((x.text or "") if x.tag == A + "t" else "\n" if x.tag == A + "br" else "" for x in p.iter()) for p in body.iter(A + "p"))
            title = index == 0 and abs(box[3] - box[1]) / max(page_box[1], 1) <= 0.2 and _title_like(norm(whole))
            text = norm(whole) if title else re.sub(r"[ \t]+", " ", re.sub(r"\s*\n\s*", "\n", whole)).strip()
            if not text:
                continue
            row = {"text": text, "page_number": n, "page_name": "paragraph", "text_as_html": json.dumps({"bbox": box, "page_bbox": page_box}), "language": "zh"}
            yield row | ({"kind": "Title"} if title else {})
        if include_page_breaks and n < len(slides):
            yield {"kind": "PageBreak", "text": ""}


# ---- ODT and EPUB ---------------------------------------------------------------------------------------------------

_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_TB = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_O = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"


def read_odt(content: bytes) -> Iterator[dict]:
    """Headings, paragraphs, list items and tables of an OpenDocument text."""
    body = ET.fromstring(_zip(content).read("content.xml")).find(f"{_O}body/{_O}text")

    def walk(e: ET.Element, in_list: bool) -> Iterator[dict]:
        for x in e:
            if x.tag == _TB + "table":
                rows = [[" ".join("".join(p.itertext()) for p in c.iter(_T + "p")) for c in r.findall(_TB + "table-cell")] for r in x.iter(_TB + "table-row")]
                yield {"kind": "Table", "text": markdown(rows, widen=3), "text_as_html": _html_table(rows)}
            elif x.tag in (_T + "h", _T + "p"):
                text = "".join(x.itertext()).strip()
                if text:
                    level = x.get(_T + "outline-level")
                    kind = "Title" if x.tag == _T + "h" else "ListItem" if in_list else None
                    yield {"kind": kind, "text": text, "extra_data": json.dumps({"title_level": int(level)}) if level and kind == "Title" else None}
            else:
                yield from walk(x, in_list or x.tag == _T + "list")

    if body is not None:
        yield from walk(body, False)


def read_epub(content: bytes) -> Iterator[dict]:
    """HTML items in the order of the spine, each with the title of the last entry of the contents that points at it;
    an item that none points at goes on with the title before."""
    z = _zip(content)
    ns = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "n": "http://www.daisy.org/z3986/2005/ncx/"}
    root = ET.fromstring(z.read("META-INF/container.xml")).find(".//c:rootfile", ns)
    opf_name = root.get("full-path") if root is not None else next(n for n in z.namelist() if n.endswith(".opf"))
    opf = ET.fromstring(z.read(opf_name))
    base = posixpath.dirname(opf_name)
    at = lambda href: posixpath.normpath(posixpath.join(base, href.split("#")[0]))
    items = {i.get("id"): i for i in opf.iterfind(".//o:item", ns)}
    toc: dict[str, str] = {}
    for i in items.values():
        if i.get("media-type") == "application/x-dtbncx+xml" and at(i.get("href", "")) in z.namelist():
            for p in ET.fromstring(z.read(at(i.get("href", "")))).iterfind(".//n:navPoint", ns):
                label, target = p.find("n:navLabel/n:text", ns), p.find("n:content", ns)
                if label is not None and target is not None:
                    toc[at(target.get("src", ""))] = label.text or ""
        elif "nav" in (i.get("properties") or "").split() and at(i.get("href", "")) in z.namelist():
            for a in parse(z.read(at(i.get("href", ""))).decode("utf-8", "replace")).below("a"):
                if a.attrs.get("href"):
                    toc[at(a.attrs["href"])] = norm(a.content())
    section = None
    for ref in opf.iterfind(".//o:itemref", ns):
        item = items.get(ref.get("idref"))
        if item is None or "html" not in (item.get("media-type") or "") or "nav" in (item.get("properties") or "").split():
            continue
        name = at(item.get("href", ""))
        section = toc.get(name, section)
        if name in z.namelist():
            yield from read(z.read(name).decode("utf-8", "replace"), section)


# ---- properties -----------------------------------------------------------------------------------------------------

CORE = ("category", "contentStatus", "created", "creator", "description", "identifier", "keywords", "language", "lastModifiedBy", "lastPrinted", "modified", "revision", "subject", "title", "version")


def core_properties(content: bytes) -> dict[str, str | None]:
    """The core properties of an office archive; missing ones are None."""
    z = _zip(content)
    found: dict[str, str | None] = dict.fromkeys(CORE)
    if "docProps/core.xml" in z.namelist():
        for e in ET.fromstring(z.read("docProps/core.xml")):
            name = e.tag.rsplit("}", 1)[-1]
            if name in found:
                found[name] = e.text
    return found


def archive_type(content: bytes) -> str:
    """DOCX, XLSX, PPTX, ODT, EPUB or ZIP, by the members that must be there."""
    try:
        z = _zip(content)
        names = set(z.namelist())
    except zipfile.BadZipFile:
        return "UNK"
    for kind, need in (("DOCX", {"docProps/core.xml", "word/document.xml"}), ("XLSX", {"xl/workbook.xml"}), ("PPTX", {"docProps/core.xml", "ppt/presentation.xml"})):
        if need <= names:
            return kind
    if "word/document.xml" in names:
        return "DOCX"
    if "ppt/presentation.xml" in names:
        return "PPTX"
    if "mimetype" in names:
        kind = z.read("mimetype").strip()
        if kind == b"application/epub+zip":
            return "EPUB"
        if kind == b"application/vnd.oasis.opendocument.text":
            return "ODT"
    return "ZIP"


EXIF_TAGS = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight"}


def exif(content: bytes) -> dict[str, str]:
    """Tags of a JPEG's EXIF block, as text."""
    import struct

    at = content.find(b"Exif\0\0")
    if content[:2] != b"\xff\xd8" or at < 0:
        return {}
    t = content[at + 6 :]
    o = "<" if t[:2] == b"II" else ">"
    out: dict[str, str] = {}

    def read_dir(pos: int, depth: int = 0) -> None:
        if pos + 2 > len(t) or depth > 2:
            return
        for k in range(struct.unpack_from(o + "H", t, pos)[0]):
            p = pos + 2 + 12 * k
            if p + 12 > len(t):
                return
            tag, kind, n = struct.unpack_from(o + "HHI", t, p)
            size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 1) * n
            q = p + 8 if size <= 4 else struct.unpack_from(o + "I", t, p + 8)[0]
            if tag == 0x8769:
                read_dir(struct.unpack_from(o + "I", t, p + 8)[0], depth + 1)
            elif tag in EXIF_TAGS:
                if kind == 2:
                    out[EXIF_TAGS[tag]] = t[q : q + n].split(b"\0")[0].decode("latin-1")
                elif kind in (3, 4):
                    out[EXIF_TAGS[tag]] = str(struct.unpack_from(o + ("H" if kind == 3 else "I"), t, q)[0])

    read_dir(struct.unpack_from(o + "I", t, 4)[0])
    return out
