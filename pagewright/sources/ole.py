"""Old binary office files: the compound file and what XLS, DOC, PPT and MSG keep in it, with the standard library."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

from .html import markdown, read
from .office import _html_table
from .plain import paragraphs

_END = 0xFFFFFFFA


class Compound:
    """The streams of a compound file, by path."""

    def __init__(self, content: bytes):
        if content[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ValueError("not a compound file")
        self.data = content
        shift, mini_shift = struct.unpack_from("<HH", content, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        first_dir, self.cutoff, first_mini, first_difat = (struct.unpack_from("<I", content, x)[0] for x in (48, 56, 60, 68))
        difat = list(struct.unpack_from("<109I", content, 76))
        seen: set[int] = set()
        while first_difat < _END and first_difat not in seen:
            seen.add(first_difat)
            part = struct.unpack(f"<{self.size // 4}I", self._sector(first_difat))
            difat += part[:-1]
            first_difat = part[-1]
        self.fat = [x for s in difat if s < _END for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        self.mini = [x for (x,) in struct.iter_unpack("<I", self._chain(first_mini))] if first_mini < _END else []
        entries = self._chain(first_dir)
        self.entries = []
        for at in range(0, len(entries) - 127, 128):
            e = entries[at : at + 128]
            n = struct.unpack_from("<H", e, 64)[0]
            left, right, child, start = *struct.unpack_from("<III", e, 68), struct.unpack_from("<I", e, 116)[0]
            self.entries.append((e[: max(n - 2, 0)].decode("utf-16-le", "ignore"), e[66], left, right, child, start, struct.unpack_from("<Q", e, 120)[0]))
        self.small = self._chain(self.entries[0][5]) if self.entries else b""
        self.paths: dict[str, int] = {}
        if self.entries:
            self._walk(self.entries[0][4], "", set())

    def _sector(self, n: int) -> bytes:
        part = self.data[(n + 1) * self.size : (n + 2) * self.size]
        return part.ljust(self.size, b"\0")

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < len(self.fat) and n not in seen:
            seen.add(n)
            out.append(self._sector(n))
            n = self.fat[n]
        return b"".join(out)

    def _walk(self, k: int, above: str, seen: set[int]) -> None:
        todo = [(k, above)]
        while todo:
            k, above = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            name, kind, left, right, child, *_ = self.entries[k]
            if kind == 2:
                self.paths[above + name] = k
            todo += [(left, above), (right, above)]
            if kind == 1:
                todo.append((child, above + name + "/"))

    def __contains__(self, path: str) -> bool:
        return path in self.paths

    def __getitem__(self, path: str) -> bytes:
        *_, start, size = self.entries[self.paths[path]]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < len(self.mini) and start not in seen:
            seen.add(start)
            out.append(self.small[start * self.mini_size : (start + 1) * self.mini_size])
            start = self.mini[start]
        return b"".join(out)[:size]


# ---- XLS ------------------------------------------------------------------------------------------------------------


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _rk(v: int) -> str:
    x = float(v >> 2 if not v & 0x80000000 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", v & 0xFFFFFFFC))[0]
    return _number(x / 100 if v & 1 else x)


class _Shared:
    """The reader of shared strings, which go on from record to record; each record starts with the width of its letters."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n > 0 and self.k < len(self.parts):
            piece = self.parts[self.k][self.at : self.at + n]
            out += piece
            self.at += len(piece)
            n -= len(piece)
            if n > 0:
                self.k, self.at = self.k + 1, 0
        return out

    def text(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while n:
            if self.k < len(self.parts) and self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                wide = self.take(1)[0] & 1
            if self.k >= len(self.parts):
                break
            fit = min(n, (len(self.parts[self.k]) - self.at) // (2 if wide else 1)) or n
            raw = self.take(fit * (2 if wide else 1))
            out += raw.decode("utf-16-le" if wide else "latin-1", "replace")
            n -= fit
        self.take(4 * runs + more)
        return out


def _string16(b: bytes) -> str:
    n, flags = struct.unpack_from("<HB", b)
    return b[3 : 3 + 2 * n].decode("utf-16-le", "replace") if flags & 1 else b[3 : 3 + n].decode("latin-1")


def xls_sheets(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """Name and rows of each sheet of a BIFF8 workbook; formulas count with their last values."""
    ole = Compound(content)
    book = ole["Workbook"] if "Workbook" in ole else ole["Book"]
    sheets, shared, at = [], [], 0
    records = []
    while at + 4 <= len(book):
        kind, n = struct.unpack_from("<HH", book, at)
        records.append((at, kind, book[at + 4 : at + 4 + n]))
        at += 4 + n
    place = {r[0]: k for k, r in enumerate(records)}
    for k, (_, kind, b) in enumerate(records):
        if kind == 0x85:
            start, _, what, n, flags = struct.unpack_from("<IBBBB", b)
            sheets.append((start, b[8 : 8 + 2 * n].decode("utf-16-le") if flags & 1 else b[8 : 8 + n].decode("latin-1"), what))
        elif kind == 0xFC:
            parts = [b[8:]]
            while k + len(parts) < len(records) and records[k + len(parts)][1] == 0x3C:
                parts.append(records[k + len(parts)][2])
            reader = _Shared(parts)
            shared = [reader.text() for _ in range(struct.unpack_from("<I", b, 4)[0])]
    for start, name, what in sheets:
        if what or start not in place:
            continue
        cells: dict[tuple[int, int], str] = {}
        last = None
        for _, kind, b in records[place[start] + 1 :]:
            if kind == 0x0A:
                break
            here = struct.unpack_from("<HH", b) if len(b) >= 4 else (0, 0)
            if kind == 0xFD:
                n = struct.unpack_from("<I", b, 6)[0]
                cells[here] = shared[n] if n < len(shared) else ""
            elif kind == 0x203:
                cells[here] = _number(struct.unpack_from("<d", b, 6)[0])
            elif kind == 0x27E:
                cells[here] = _rk(struct.unpack_from("<I", b, 6)[0])
            elif kind == 0xBD:
                for j in range((len(b) - 6) // 6):
                    cells[here[0], here[1] + j] = _rk(struct.unpack_from("<I", b, 6 + 6 * j)[0])
            elif kind == 0x204:
                cells[here] = _string16(b[6:])
            elif kind == 0x205:
                cells[here] = ("True" if b[6] else "False") if not b[7] else ""
            elif kind == 0x06:
                last = here
                if b[12:14] != b"\xff\xff":
                    cells[here] = _number(struct.unpack_from("<d", b, 6)[0])
                elif b[6] == 1:
                    cells[here] = "True" if b[8] else "False"
            elif kind == 0x207 and last:
                cells[last] = _string16(b)
        width = max((c for _, c in cells), default=-1) + 1
        yield name, [[cells.get((r, c), "") for c in range(width)] for r in sorted({r for r, _ in cells})]


def read_xls(content: bytes, include_header: bool = True) -> Iterator[dict]:
    """A Table for each sheet, sheets counted as pages."""
    for n, (name, rows) in enumerate(xls_sheets(content), 1):
        rows = rows if include_header else rows[1:]
        if rows:
            yield {"kind": "Table", "text": markdown(rows, widen=3), "text_as_html": _html_table(rows), "page_number": n, "page_name": name}


# ---- DOC and PPT ----------------------------------------------------------------------------------------------------


def doc_text(content: bytes) -> str:
    """The main text of a Word 97 document, by its piece table; a paragraph ends with a line break, a page with a form feed."""
    ole = Compound(content)
    main = ole["WordDocument"]
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & 0x100:
        raise ValueError("the file is encrypted")
    table = ole["1Table" if flags & 0x200 else "0Table"]
    start, size = struct.unpack_from("<II", main, 0x01A2)
    chars = struct.unpack_from("<I", main, 0x4C)[0]
    clx, at = table[start : start + size], 0
    while at < len(clx) and clx[at] == 1:
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if at >= len(clx) or clx[at] != 2:
        raise ValueError("no piece table")
    n = (struct.unpack_from("<I", clx, at + 1)[0] - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", clx, at + 5)
    out = []
    for k in range(n):
        fc = struct.unpack_from("<I", clx, at + 5 + 4 * (n + 1) + 8 * k + 2)[0]
        length = ends[k + 1] - ends[k]
        if fc & 0x40000000:
            fc = (fc & 0x3FFFFFFF) // 2
            out.append(main[fc : fc + length].decode("cp1252", "replace"))
        else:
            out.append(main[fc : fc + 2 * length].decode("utf-16-le", "replace"))
    text = "".join(out)[:chars]
    text = re.sub("\x13[^\x14\x15]*\x14?|\x15", "", text)  # fields keep what they show
    return re.sub("[\x00-\x06\x08\x0e-\x1f]", "", text.replace("\x0b", "\n").replace("\r", "\n"))


def read_doc(content: bytes, include_page_breaks: bool = True) -> Iterator[dict]:
    """Paragraphs; runs of cells are rows of a Table; pages are counted at page breaks."""
    page = 1
    for n, sheet in enumerate(doc_text(content).split("\x0c")):
        if n and include_page_breaks:
            yield {"kind": "PageBreak", "text": ""}
        page += n > 0
        rows: list[list[str]] = []
        for line in [*sheet.split("\n"), ""]:
            while "\x07\x07" in line:  # the end of a row
                row, line = line.split("\x07\x07", 1)
                rows.append([c.strip() for c in row.split("\x07")])
            if rows and line.strip("\x07 ") == "" and not line.startswith("\x07"):
                yield {"kind": "Table", "text": markdown(rows, widen=3), "text_as_html": _html_table(rows), "page_number": page}
                rows = []
            elif line.strip("\x07 "):
                if rows:
                    yield {"kind": "Table", "text": markdown(rows, widen=3), "text_as_html": _html_table(rows), "page_number": page}
                    rows = []
                yield {"text": line.replace("\x07", " ").strip(), "page_number": page, "language": "zh"}


def _atoms(b: bytes, depth: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(kind, instance, content) of a presentation's records, those in containers included; a container comes before them."""
    at = 0
    while at + 8 <= len(b):
        head, kind, n = struct.unpack_from("<HHI", b, at)
        body = b[at + 8 : at + 8 + n]
        yield kind, head >> 4, body
        if head & 15 == 15 and depth < 32:
            yield from _atoms(body, depth + 1)
        at += 8 + n


def read_ppt(content: bytes, include_page_breaks: bool = True) -> Iterator[dict]:
    """The texts of each slide of a PowerPoint 97 file; the first one is a title if it reads like one."""
    slides: list[list[str]] = []
    listed: list[list[str]] = []
    into: list[list[str]] | None = None
    for kind, instance, body in _atoms(Compound(content)["PowerPoint Document"]):
        if kind == 0x0FF0 and instance == 0:  # the outline: a persist atom before each slide's texts
            into = listed
        elif kind == 0x03F3 and into is listed:
            listed.append([])
        elif kind == 0x03EE:
            slides.append([])
            into = slides
        elif kind in (0x03F8, 0x03F0, 0x0FF0):  # masters, notes and other lists
            into = None
        elif kind in (0x0FA0, 0x0FA8) and into:
            text = body.decode("utf-16-le" if kind == 0x0FA0 else "cp1252", "replace")
            into[-1] += [x.strip() for x in re.split("[\r\n]", text.replace("\x0b", " ")) if x.strip()]
    for n in range(max(len(slides), len(listed))):
        texts = [*(listed[n] if n < len(listed) else []), *(slides[n] if n < len(slides) else [])]
        for k, t in enumerate(texts):
            title = k == 0 and len(t) <= 30 and not re.search("[。；！|;!]", t)
            yield {"text": t, "page_number": n + 1, "page_name": "paragraph", "language": "zh"} | ({"kind": "Title"} if title else {})
        if include_page_breaks and n + 1 < max(len(slides), len(listed)):
            yield {"kind": "PageBreak", "text": ""}


# ---- MSG ------------------------------------------------------------------------------------------------------------


def _property(ole: Compound, tag: str, above: str = "") -> str | None:
    for kind, encoding in (("001F", "utf-16-le"), ("001E", "cp1252"), ("0102", "utf-8")):
        path = f"{above}__substg1.0_{tag}{kind}"
        if path in ole:
            return ole[path].decode(encoding, "replace").rstrip("\0")
    return None


def _sent(ole: Compound) -> str | None:
    raw = ole["__properties_version1.0"] if "__properties_version1.0" in ole else b""
    for at in range(32, len(raw) - 15, 16):
        if struct.unpack_from("<I", raw, at)[0] in (0x00390040, 0x0E060040):
            return (datetime(1601, 1, 1) + timedelta(microseconds=struct.unpack_from("<Q", raw, at + 8)[0] // 10)).isoformat()
    return None


def read_msg(content: bytes, max_partition: int | None = 1500, with_attachments: bool = False) -> Iterator[dict]:
    """The body's elements (HTML if there is any), all with the message's metadata; texts that are attached after them if wanted."""
    ole = Compound(content)
    split = lambda v: [x.strip() for x in v.split(";") if x.strip()] if v else None
    sender = _property(ole, "0C1F") or _property(ole, "0C1A")
    meta = {"sent_from": split(sender), "sent_to": split(_property(ole, "0E04")), "subject": _property(ole, "0037"), "date": _sent(ole)}
    html, plain = _property(ole, "1013"), _property(ole, "1000")
    for row in read(html) if html else paragraphs(plain or "", max_partition):
        yield row | meta
    if with_attachments:
        for folder in sorted({p.split("/")[0] + "/" for p in ole.paths if p.startswith("__attach")}):
            name = _property(ole, "3707", folder) or _property(ole, "3704", folder) or ""
            path = f"{folder}__substg1.0_37010102"
            if path not in ole:
                continue
            try:
                text = ole[path].decode("utf-8")
            except UnicodeDecodeError:
                continue
            for row in read(text) if name.lower().endswith((".html", ".htm")) else paragraphs(text, max_partition):
                yield row | meta | {"attachment_name": name, "attached_to_filename": meta["subject"]}
