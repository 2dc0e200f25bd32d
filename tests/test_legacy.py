"""PDF, old binary office files, RTF, Org and reStructuredText, on files made here."""

import struct
import zlib

import pytest

from pagewright.operators import layout as L
from pagewright.plans import partition as PL
from pagewright.sources import layout as SL
from pagewright.sources import markup, ole, pdf

END, FREE, FATSECT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with large sectors only for long streams and mini sectors for short ones; folders of one level."""
    sectors, fat, mini, minifat = [], [], b"", []

    def put(data: bytes) -> int:
        n = max(1, -(-len(data) // 512))
        first = len(sectors)
        sectors.extend(data[k * 512 : k * 512 + 512].ljust(512, b"\0") for k in range(n))
        fat.extend([*range(first + 1, first + n), END])
        return first

    entries = [["Root Entry", 5, FREE, FREE, FREE, END, 0]]
    folders: dict[str, int] = {}
    below: dict[int, list[int]] = {0: []}
    for path, data in streams.items():
        *above, name = path.split("/")
        parent = 0
        if above:
            if above[0] not in folders:
                folders[above[0]] = len(entries)
                below[0].append(len(entries))
                below[len(entries)] = []
                entries.append([above[0], 1, FREE, FREE, FREE, 0, 0])
            parent = folders[above[0]]
        if len(data) >= 4096:
            start = put(data)
        else:
            start = len(minifat)
            n = max(1, -(-len(data) // 64))
            mini += data.ljust(n * 64, b"\0")
            minifat += [*range(start + 1, start + n), END]
        below[parent].append(len(entries))
        entries.append([name, 2, FREE, FREE, FREE, start, len(data)])
    for parent, kids in below.items():  # a list to the right will do for a tree
        if kids:
            entries[parent][4] = kids[0]
            for a, b in zip(kids, kids[1:]):
                entries[a][3] = b
    entries[0][5], entries[0][6] = put(mini), len(mini)
    first_mini = put(struct.pack(f"<{len(minifat)}I", *minifat)) if minifat else END
    raw = b"".join((n.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(n) + 2, k, 1, left, right, child) + bytes(36) + struct.pack("<IQ", s, z) for n, k, left, right, child, s, z in entries)
    first_dir = put(raw)
    n = 1
    while len(fat) + n > n * 128:
        n += 1
    at = len(sectors)
    table = [*fat, *[FATSECT] * n]
    table += [FREE] * (n * 128 - len(table))
    sectors += [struct.pack("<128I", *table[k * 128 : k * 128 + 128]) for k in range(n)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, n, first_dir, 0, 4096, first_mini, 1, END, 0)
    return head + struct.pack("<109I", *[*range(at, at + n), *[FREE] * (109 - n)]) + b"".join(sectors)


def record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def workbook() -> bytes:
    text = lambda s, wide: struct.pack("<HB", len(s), wide) + s.encode("utf-16-le" if wide else "latin-1")
    strings = [text("Name", 0), text("数量", 1), text("a long one " * 5, 0)]
    cut = len(strings[0]) + len(strings[1]) + 3 + 20
    whole = b"".join(strings)
    globals_ = record(0x809, bytes(16))
    sheet = lambda rows: record(0x809, bytes(16)) + b"".join(rows) + record(0x0A, b"")
    cell = lambda r, c, body: struct.pack("<HHH", r, c, 0) + body
    one = sheet([
        record(0xFD, cell(0, 0, struct.pack("<I", 0))), record(0xFD, cell(0, 1, struct.pack("<I", 1))), record(0xFD, cell(1, 0, struct.pack("<I", 2))), record(0x203, cell(1, 1, struct.pack("<d", 2.5))),
        record(0x27E, cell(2, 0, struct.pack("<I", 7 << 2 | 2))), record(0xBD, struct.pack("<HH", 3, 0) + struct.pack("<HIHI", 0, (125 << 2) | 3, 0, (12 << 2) | 2) + struct.pack("<H", 1)),
        record(0x06, cell(4, 0, struct.pack("<d", 9.0) + bytes(8))), record(0x06, cell(4, 1, b"\0\0\0\0\0\0\xff\xff" + bytes(8))), record(0x207, text("shown", 0)), record(0x205, cell(5, 0, b"\1\0")),
    ])
    two = sheet([record(0x204, cell(0, 0, text("only", 0)))])
    names = ["First", "Second"]
    size = len(globals_) + sum(4 + 8 + len(n) for n in names) + 4 + 8 + cut + 4 + 1 + len(whole) - cut + 4
    starts = [size, size + len(one)]
    bounds = b"".join(record(0x85, struct.pack("<IBBBB", s, 0, 0, len(n), 0) + n.encode()) for s, n in zip(starts, names))
    sst = record(0xFC, struct.pack("<II", 3, 3) + whole[:cut]) + record(0x3C, b"\0" + whole[cut:])
    return compound({"Workbook": globals_ + bounds + sst + record(0x0A, b"") + one + two + bytes(5000)})


def test_xls():
    sheets = dict(ole.xls_sheets(workbook()))
    assert sheets == {"First": [["Name", "数量"], ["a long one " * 5, "2.5"], ["7", ""], ["1.25", "12"], ["9", "shown"], ["True", ""]], "Second": [["only"]]}
    rows = list(ole.read_xls(workbook()))
    assert [(r["kind"], r["page_number"], r["page_name"]) for r in rows] == [("Table", 1, "First"), ("Table", 2, "Second")] and "<td>2.5</td>" in rows[0]["text_as_html"]


def word_file() -> bytes:
    parts = ["Heading\r", "Some text that is 中文 here.\r\x0c", "a\x07b\x07\x07c\x07d\x07\x07", "Last \x13 HYPERLINK x \x14shown\x15 one.\r"]
    whole = "".join(parts)
    main = bytearray(0x400)
    raw = whole.encode("utf-16-le")
    first = parts[0].encode("cp1252")
    struct.pack_into("<H", main, 10, 0x200)
    struct.pack_into("<I", main, 0x4C, len(whole))
    at = len(main)
    main += first.ljust(16, b"\0") + raw[2 * len(first) :]
    ends = struct.pack("<III", 0, len(first), len(whole))
    pieces = struct.pack("<HIH", 0, 0x40000000 | at * 2, 0) + struct.pack("<HIH", 0, at + 16, 0)
    clx = b"\x01\x02\x00zz\x02" + struct.pack("<I", len(ends) + len(pieces)) + ends + pieces
    struct.pack_into("<II", main, 0x01A2, 0, len(clx))
    return compound({"WordDocument": bytes(main), "1Table": clx})


def test_doc():
    rows = list(ole.read_doc(word_file()))
    assert [r["text"] for r in rows if r.get("kind") != "Table"] == ["Heading", "Some text that is 中文 here.", "", "Last shown one."]
    table = next(r for r in rows if r.get("kind") == "Table")
    assert table["text_as_html"] == "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>" and table["page_number"] == 2


def show_file() -> bytes:
    atom = lambda kind, body, v=0: struct.pack("<HHI", v, kind, len(body)) + body
    box = lambda kind, body, instance=0: atom(kind, body, 15 | instance << 4)
    outline = box(0x0FF0, atom(0x03F3, bytes(20)) + atom(0x0FA0, "Welcome".encode("utf-16-le")) + atom(0x0FA8, b"first point\rsecond") + atom(0x03F3, bytes(20)) + atom(0x0FA8, b"The end; really"))
    return compound({"PowerPoint Document": box(0x03E8, outline) + box(0x03F8, atom(0x0FA8, b"master")) + box(0x03EE, atom(0x0FA8, b"in a box")) + box(0x03EE, b"")})


def test_ppt():
    rows = list(ole.read_ppt(show_file()))
    assert [(r["text"], r.get("page_number"), r.get("kind")) for r in rows] == [("Welcome", 1, "Title"), ("first point", 1, None), ("second", 1, None), ("in a box", 1, None), ("", None, "PageBreak"), ("The end; really", 2, None)]


def message() -> bytes:
    u = lambda s: s.encode("utf-16-le")
    when = struct.pack("<IIQ", 0x00390040, 6, 133_000_000_000_000_000)
    return compound({
        "__substg1.0_0037001F": u("Hello"), "__substg1.0_1000001F": u("plain body text here"), "__substg1.0_10130102": b"<html><body><p>A body of the mail.</p></body></html>", "__substg1.0_0C1F001F": u("a@b.org"),
        "__substg1.0_0E04001F": u("x@y.org; z@y.org"), "__properties_version1.0": bytes(32) + when, "__attach_version1.0_#00000000/__substg1.0_3707001F": u("n.txt"), "__attach_version1.0_#00000000/__substg1.0_37010102": b"attached words",
    })


def test_msg():
    rows = list(ole.read_msg(message(), with_attachments=True))
    assert [r["text"] for r in rows] == ["A body of the mail.", "attached words"]
    assert rows[0]["sent_from"] == ["a@b.org"] and rows[0]["sent_to"] == ["x@y.org", "z@y.org"] and rows[0]["subject"] == "Hello" and rows[0]["date"].startswith("2022-06-18T")
    assert rows[1]["attachment_name"] == "n.txt"


TEXT = "A heading\n\nThe quick brown fox jumps over the lazy dog, and then it goes on and on until the line is full and breaks.\n中文的一段文字。\nIt’s “fine” (really) \\ 50%."


def test_pdf_round_trip():
    made = pdf.text_to_pdf(TEXT)
    rows = list(pdf.lines(made))
    assert "".join(r["text"] for r in rows).replace(" ", "") == TEXT.replace("\n", "").replace(" ", "")
    assert all(r["page"] == 1 and r["x0"] < r["x1"] and r["y0"] < r["y1"] for r in rows) and [r["y0"] for r in rows] == sorted(r["y0"] for r in rows)
    long = pdf.text_to_pdf("line\n" * 150)
    assert {r["page"] for r in pdf.lines(long)} == {1, 2, 3, 4} and sum(r["text"] == "line" for r in pdf.lines(long)) == 150
    assert list(pdf.lines(pdf.text_to_pdf(""))) == []


def test_pdf_by_hand():
    """Object streams, ToUnicode maps, differences, TJ with gaps, forms, and a stream without its length."""
    cmap = b"1 beginbfchar <0001> <4F60> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] >>", b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /eacute /fi /uni4E2D] >> >>"]
    heads, body = "", b""
    for n, o in zip((1, 2, 5), inner):
        heads += f"{n} {len(body)} "
        body += o + b" "
    packed = zlib.compress(heads.encode() + body)
    content = b"q 1 0 0 1 10 0 cm BT /A 10 Tf 0 80 Td [(AB) -2000 (C)] TJ 0 -12 Td (x\\)y) Tj ET Q BT /B 10 Tf 1 0 0 1 10 40 Tm <00010002> Tj ET /F Do"
    objects = {
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /A 5 0 R /B 6 0 R >> /XObject << /F 8 0 R >> >> >>", 4: b"<< >>\nstream\n" + content + b"\nendstream",
        6: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [<< /DW 1000 /W [1 [900 500]] >>] /ToUnicode 7 0 R >>", 7: b"<< /Length %d >>\nstream\n%b\nendstream" % (len(cmap), cmap),
        8: b"<< /Subtype /Form /Matrix [1 0 0 1 0 -30] >>\nstream\nBT /A 8 Tf 10 50 Td (form) Tj ET\nendstream", 9: b"<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%b\nendstream" % (len(heads), len(packed), packed),
    }
    raw = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>"
    assert [r["text"] for r in pdf.lines(raw)] == ["éfi 中", "x)y", "你a", "form"]
    with pytest.raises(ValueError, match="encrypted"):
        list(pdf.lines(raw + b" trailer << /Encrypt 3 0 R >>"))


def test_images_to_pdf():
    png = lambda kind, b: struct.pack(">I", len(b)) + kind + b + bytes(4)
    image = b"\x89PNG\r\n\x1a\n" + png(b"IHDR", struct.pack(">IIBBBBB", 3200, 2, 8, 2, 0, 0, 0)) + png(b"IDAT", zlib.compress((b"\0" + bytes(9600)) * 2)) + png(b"IEND", b"")
    made = pdf.Pdf(pdf.image_to_pdf(image))
    assert made.pages()[0]["MediaBox"] == [0, 0, 1600, 1] and made.objects[4][0]["Width"] == 3200
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03" + bytes(9)
    assert pdf.Pdf(pdf.image_to_pdf(jpeg)).pages()[0]["MediaBox"] == [0, 0, 32, 16]
    with pytest.raises(ValueError):
        pdf.image_to_pdf(b"GIF89a")


RTF = r"""{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Times;}}{\*\generator x;}\pard First {\b bold} caf\'e9 \u20013?\u25991?.\par
\trowd a\cell b\cell\row c\cell d\cell\row\pard After\line broken \{x\}\par}"""


def test_rtf():
    rows = list(markup.read_rtf(RTF))
    assert [r["text"] for r in rows if r.get("kind") is None] == ["First bold café 中文.", "After", "broken {x}"]
    assert [r["text_as_html"] for r in rows if r.get("kind") == "Table"] == ["<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"]
    assert markup.rtf_text(r"{\rtf1\ansi\ansicpg936 \'d6\'d0\'ce\'c4}") == "中文"


def test_org_and_rst():
    org = "#+TITLE: Whole\n* TODO Part one :tag:\nSome *bold* text with [[http://x.org][a link]].\n- one\n- two\n\n| a | b |\n|---+---|\n| 1 | 2 |\n#+BEGIN_SRC sh\n* not a heading\n#+END_SRC\n"
    rows = list(markup.read_org(org))
    texts = [r["text"] for r in rows]
    assert texts[:2] == ["Whole", "Part one"] and any("Some bold text with a link." in t for t in texts) and {"one", "two"} <= set(texts)
    assert any(r.get("kind") == "Table" for r in rows) and any("* not a heading" in t for t in texts)
    rst = "Title\n=====\n\nSome ``code`` and `a link <http://x.org>`_.\n\nSub\n---\n\n* one\n* two\n\n=== ===\nA   B\n=== ===\n1   2\n=== ===\n\n.. image:: x.png\n   :alt: gone\n\n.. note:: Kept words.\n\n+---+---+\n| c | d |\n+---+---+\n| 3 | 4 |\n+---+---+\n"
    rows = list(markup.read_rst(rst))
    texts = [r["text"] for r in rows]
    assert texts[0] == "Title" and "Sub" in texts and "Some code and a link." in texts and "Kept words." in texts and not any("gone" in t for t in texts)
    assert sum(r.get("kind") == "Table" for r in rows) == 2


def test_through_the_plan(spark):
    made = {"a.pdf": pdf.text_to_pdf(TEXT), "b.xls": workbook(), "c.doc": word_file(), "d.ppt": show_file(), "e.msg": message(), "f.rtf": RTF.encode(), "g.org": b"* Head\nSome text is here.\n", "h.rst": b"Head\n====\n\nSome text is here.\n", "i.pdf": b"%PDF-1.4 nothing"}
    files = spark.createDataFrame([(k, f"/d/{n}", None, bytearray(c)) for k, (n, c) in enumerate(made.items())], "doc_id long, path string, modificationTime timestamp, content binary")
    rows, errors = PL.partition_and_errors(files)
    got = {r.filename: r.n for r in rows.groupBy("metadata.filename").count().withColumnRenamed("count", "n").collect()}
    assert set(got) == set(made) - {"i.pdf"} and [r.doc_id for r in errors.collect()] == [8]
    lines = SL.pdf_lines(files.filter("doc_id = 0"))
    assert lines.count() == len(list(pdf.lines(made["a.pdf"])))
    ordered = L.reading_order(lines.select("doc_id", "page", "line_no", "text", "x0", "y0", "x1", "y1")).orderBy("ord").collect()
    assert [r.line_no for r in ordered] == sorted(r.line_no for r in ordered)
    made = {r.doc_id: r for r in PL.serve(files, "topdf").collect()}
    assert all(made[k].status_code == 200 for k in range(9)) and "Some text is here." in " ".join(x["text"] for x in pdf.lines(bytes(made[6].pdf)))
