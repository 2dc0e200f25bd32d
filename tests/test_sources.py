"""Parsers and plans on files made here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.plans import partition as PL
from pagewright.sources import filetype as T
from pagewright.sources import html as H
from pagewright.sources import mail, office, plain


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = archive(
    **{
        "docProps/core.xml": '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>Report</dc:title><dc:creator>Me</dc:creator></cp:coreProperties>',
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/document.xml": f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Overview</w:t></w:r></w:p>
<w:p><w:r><w:t>The system is running well and it was </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>tested</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>first item</w:t></w:r></w:p>
<w:p><w:r><w:br w:type="page"/></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
</w:body></w:document>""",
    }
)
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
XLSX = archive(
    **{
        "docProps/core.xml": "<x/>",
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><t>x</t></si></sst>",
        "xl/worksheets/s1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": f'<worksheet {S}><sheetData><row><c t="inlineStr"><is><t>only</t></is></c></row></sheetData></worksheet>',
    }
)
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def shape(text, x, y):
    return f'<p:sp><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="50" cy="20"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'


PPTX = archive(
    **{
        "docProps/core.xml": "<x/>",
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="1" r:id="r1"/><p:sldId id="2" r:id="r2"/></p:sldIdLst><p:sldSz cx="1000" cy="1000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide1.xml": f"<p:sld {P}><p:cSld><p:spTree>{shape('below it was running', 0, 500)}{shape('My title', 0, 10)}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/slide2.xml": f"<p:sld {P}><p:cSld><p:spTree>{shape('second one is here', 0, 900)}</p:spTree></p:cSld></p:sld>",
    }
)
EPUB = archive(
    **{
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/c.opf"/></rootfiles></container>',
        "OPS/c.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "OPS/t.ncx": '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Part one</text></navLabel><content src="a.xhtml#x"/></navPoint></navMap></ncx>',
        "OPS/a.xhtml": "<html><body><p>It was a dark night and all were sleeping.</p></body></html>",
        "OPS/b.xhtml": "<html><body><p>It was still dark when they were woken.</p></body></html>",
    }
)
ODT = archive(
    **{
        "mimetype": "application/vnd.oasis.opendocument.text",
        "content.xml": '<o:document-content xmlns:o="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:t="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><o:body><o:text><t:h t:outline-level="2">Head</t:h><t:p>It is running and was tested.</t:p><t:list><t:list-item><t:p>item</t:p></t:list-item></t:list></o:text></o:body></o:document-content>',
    }
)
EML = b"""MIME-Version: 1.0
Date: Fri, 26 Mar 2021 11:04:09 +1200
Message-ID: <1@x>
Subject: News
From: Ann Lee <ann@x.com>
To: Bob <bob@x.com>, c@x.com
Content-Type: multipart/mixed; boundary=B

--B
Content-Type: text/plain; charset=utf-8

Plain text is here and it was sent.
--B
Content-Type: text/html; charset=utf-8
Content-Transfer-Encoding: quoted-printable

<p>It was caf=C3=A9 time and [image: cup.png] we were =
drinking.</p>
--B
Content-Type: text/plain
Content-Disposition: attachment; filename=note.txt

The note was attached to it.
--B--
"""
FILES = {
    "a.docx": DOCX,
    "b.xlsx": XLSX,
    "c.pptx": PPTX,
    "d.epub": EPUB,
    "e.odt": ODT,
    "f.eml": EML,
    "g.md": b"# Head\n\nIt was *running* and is [here](x).\n\n- a.1 one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n",
    "h.csv": b"a,b,c\n1,2,3\n4,5,6\n",
    "i.tsv": b"a\tb\n1\t2\n",
    "j.json": b'[{"type": "Title", "text": "T", "metadata": {"page_number": 2}}, {"type": "Odd", "text": "x"}, {"type": "Text", "text": "n"}]',
    "k.xml": b"<a><b>It was running in the leaf.</b><c><d>another leaf is here</d></c></a>",
    "l.html": b"<html><body><h1>Hello</h1><p>It is a page that was written.</p><table><tr><td>1</td></tr></table></body></html>",
    "m.txt": "It was été here and they were running.\n\n- point".encode(),
    "n.pdf": b"%PDF-1.4 x",
    "o.bin": b"\x00\x01\x02",
    "q": b"x,y\n1,2\n",
    "r.xml": b"<broken",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for k, v in FILES.items():
        (folder / k).write_bytes(v)
    return T.detect(T.scan(spark, str(folder))).persist()


def of(rows, files, name):
    ids = {r.path.rsplit("/", 1)[1]: r.doc_id for r in files.select("path", "doc_id").collect()}
    return [r for r in rows if r.doc_id == ids[name]]


@pytest.fixture(scope="module")
def rows(files):
    return PL.partition(files, regex_patterns={"num": "[0-9]+"}).orderBy("doc_id", "ord").collect()


def test_types(files):
    got = {r.path.rsplit("/", 1)[1]: r.filetype for r in files.select("path", "filetype").collect()}
    want = {"a.docx": "DOCX", "b.xlsx": "XLSX", "c.pptx": "PPTX", "d.epub": "EPUB", "e.odt": "ODT", "f.eml": "EML", "g.md": "MD", "h.csv": "CSV", "i.tsv": "TSV", "j.json": "JSON", "k.xml": "XML", "l.html": "HTML", "m.txt": "TXT", "n.pdf": "PDF", "o.bin": "UNK", "q": "CSV", "r.xml": "XML"}
    assert got == want
    p = T.profile(files).filter("filename = 'h.csv'").first()
    assert (p.filesize, p.extension, p.filetype) == (len(FILES["h.csv"]), ".csv", "CSV")


def test_docx(rows, files):
    got = of(rows, files, "a.docx")
    assert [(r.type, r.text, r.page_number) for r in got] == [("Title", "Overview", 1), ("NarrativeText", "The system is running well and it was tested", 1), ("ListItem", "first item", 1), ("PageBreak", "", None), ("Table", "| a | b |\n| --- | --- |", 2)]
    assert got[0].metadata.extra_data == '{"title_level": 1}' and got[1].metadata.emphasized_text_contents == ["tested"]
    assert got[0].metadata.filename == "a.docx" and got[0].metadata.filetype == "DOCX"
    props = office.core_properties(DOCX)
    assert props["title"] == "Report" and props["creator"] == "Me" and props["category"] is None


def test_xlsx(rows, files):
    got = of(rows, files, "b.xlsx")
    assert [(r.type, r.metadata.page_name, r.page_number) for r in got] == [("Table", "One", 1), ("Table", "Two", 2)]
    assert got[0].text == "| name |  | 3 |\n| --- | --- | --- |\n| x |  |  |"


def test_pptx(rows, files):
    got = of(rows, files, "c.pptx")
    assert [(r.type, r.text, r.page_number) for r in got] == [("Title", "My title", 1), ("NarrativeText", "below it was running", 1), ("PageBreak", "", None), ("NarrativeText", "second one is here", 2)]


def test_epub_and_odt(rows, files):
    assert [(r.type, r.metadata.section) for r in of(rows, files, "d.epub")] == [("NarrativeText", "Part one")] * 2
    assert [(r.type, r.text) for r in of(rows, files, "e.odt")] == [("Title", "Head"), ("NarrativeText", "It is running and was tested."), ("ListItem", "item")]


def test_mail(rows, files):
    got = of(rows, files, "f.eml")
    assert [(r.type, r.text) for r in got] == [("NarrativeText", "It was café time and we were drinking."), ("Image", "cup.png")] or [r.text.replace("  ", " ") for r in got] == ["It was café time and we were drinking.", "cup.png"]
    m = got[0].metadata
    assert m.sent_from == ["Ann Lee <ann@x.com>"] and m.sent_to == ["Bob <bob@x.com>", "c@x.com"] and m.subject == "News" and m.last_modified.startswith("2021-03-26T11:04:09")
    full = list(mail.read_mail(EML, "text/plain", include_headers=True, with_attachments=True))
    assert {"Sender", "Recipient", "Subject", "MetaData"} <= {r["kind"] for r in full if r.get("kind")}
    assert [r["text"] for r in full if r.get("attachment_name")] == ["The note was attached to it."]
    assert [r for r in full if r.get("kind") == "Sender"][0]["name"] == "Ann Lee"
    with pytest.raises(ValueError):
        list(mail.read_mail(EML, "text/odd"))


def test_texts(rows, files):
    assert [(r.type, r.text) for r in of(rows, files, "g.md")] == [("Title", "Head"), ("NarrativeText", "It was running and is here."), ("ListItem", "a.1 one"), ("ListItem", "two"), ("Table", "| a | b |\n| --- | --- |\n| 1 | 2 |")]
    assert [(r.type, r.text) for r in of(rows, files, "h.csv")] == [("Table", "1 2 3\n4 5 6")]
    assert [(r.type, r.text) for r in of(rows, files, "i.tsv")] == [("Table", "1 2")]
    assert [(r.type, r.text, r.page_number) for r in of(rows, files, "j.json")] == [("Title", "T", 2), ("NarrativeText", "n", None)]
    assert [r.text for r in of(rows, files, "k.xml")] == ["It was running in the leaf.", "another leaf is here"]
    assert [r.type for r in of(rows, files, "l.html")] == ["Title", "NarrativeText", "Table"]
    assert [(r.type, r.text) for r in of(rows, files, "m.txt")] == [("NarrativeText", "It was été here and they were running."), ("ListItem", "point")]
    assert of(rows, files, "h.csv")[0].metadata.regex_metadata["num"][0].text == "1"


def test_empty_files(spark):
    """A scan doesn't list files without bytes; a table may hold them."""
    f = T.detect(spark.createDataFrame([(1, "a.txt", None, bytearray()), (2, "b.txt", None, None)], "doc_id long, path string, modificationTime timestamp, content binary"))
    assert [r.filetype for r in f.collect()] == ["EMPTY"] * 2
    assert PL.partition(f).count() == 0 and PL.errors(f).count() == 0


def test_errors_and_modes(files):
    bad = {r.error.split(":")[0] for r in PL.errors(files).collect()}
    assert bad == {"ValueError", "ParseError"} and PL.errors(files).count() == 3
    got = {r.status_code for r in PL.serve(files, "text").collect()}
    assert got == {200, 400}
    page = PL.serve(files.filter("filetype = 'HTML'"), "vis").first()
    assert "<h1>Hello</h1>" in page.html_text
    assert '"type":"Title"' in PL.serve(files.filter("filetype = 'HTML'"), "partition").first().partitions
    made = {r.doc_id: r for r in PL.serve(files, "topdf").collect()}
    assert len(made) == files.count() and all((r.pdf is None) == (r.status_code == 400) and (r.pdf is None or bytes(r.pdf[:5]) == b"%PDF-") for r in made.values())
    assert sum(r.status_code == 200 for r in made.values()) > len(made) // 2
    with pytest.raises(ValueError):
        PL.serve(files, "odd")


def test_tables():
    t = "<table><thead><th>A</th><th>B</th></thead><tbody><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"
    assert H.table_to_markdown(t)["text"] == "| A | B |\n| --- | --- |\n| 1 | 2 |\n| 1 | 3 |"
    assert H.merge_html_tables([t, t], True).count("<tr>") == 4
    assert H.merge_html_tables([t, t], False).count("<td>A</td>") == 1
    assert H.merge_html_tables([]) == "" and H.markdown([]) == ""
    wide = "<table><tr><td colspan=2>x</td><td>y</td></tr></table>"
    assert H.expanded_rows(H.parse(wide)) == [["x", "x", "y"]]


def test_html_traps():
    got = [r["text"] for r in H.read("<div><script>var t='</p>'</script><p>one two<p>three four</div><main><article><li>a<li>b</article></main>")]
    assert got == ["a", "b"]
    deep = "<div>" * 20000 + "deep text" + "</div>" * 20000
    assert [r["text"] for r in H.read(deep)] == ["deep text"]
    assert list(H.read("")) == []


def test_decode():
    assert plain.decode(b"\xef\xbb\xbfx") == ("utf-8-sig", "x")
    assert plain.decode("é".encode()) == ("utf-8", "é")
    assert plain.decode(b"\xe9") == ("iso_8859_1", "é")
    assert plain.decode("é".encode("utf-16"))[1] == "é"


def test_predicates(spark):
    df = spark.createDataFrame([('a,"b,c",d',), ("text/x-python",)], "t string")
    assert [r[0] for r in df.select(T.comma_count(df.t)).collect()] == [2, 0]
    assert [r[0] for r in df.select(T.is_code_mime_type(df.t)).collect()] == [False, True]
    assert df.select(T.type_of_mime(F.lit("text/html; charset=utf-8"))).first()[0] == "HTML"


def test_remote(spark):
    """A small server in this process answers; what it refuses comes back as an error."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from pagewright.sources import remote

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/a.html" else 404)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(b"<p>It was fetched from here.</p>")

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"partitions": [{"type": "Title", "text": body["filename"]}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    got = remote.fetch(spark.createDataFrame([(1, base + "/a.html"), (2, base + "/no")], "doc_id long, url string"))
    typed = T.detect(got.withColumn("path", F.col("url")), "content_type")
    assert {r.doc_id: (r.filetype, r.error is None) for r in typed.collect()} == {1: ("HTML", True), 2: ("EMPTY", False)}
    files = spark.createDataFrame([(7, "/x/n.txt", bytearray(b"x"))], "doc_id long, path string, content binary")
    assert [(r.doc_id, r.type, r.text) for r in remote.partition_via_api(files, base).collect()] == [(7, "Title", "n.txt")]
    server.shutdown()
    with pytest.raises(ValueError):
        remote.translation_model("xx")
    with pytest.raises(NotImplementedError):
        remote.translate("x")


def test_no_bytes_end_the_job(spark):
    """Whatever the encoding and wherever a letter lies, a file has a type and elements, and its neighbours keep theirs."""
    han = "毛泽东选集第一卷。"
    texts = {f"u{n}{k}": ("x" * k + han * 200).encode()[: 4090 + n] for n in range(0, 21, 3) for k in range(3)}
    texts |= {
        "latin1": ("café déjà vu. " * 400).encode("latin-1"), "gb": (han * 500).encode("gb18030"), "utf16": (han * 300).encode("utf-16"), "utf16be": b"\xfe\xff" + (han * 300).encode("utf-16-be"),
        "cut": (han * 100).encode()[:-1], "bad": b"plain \xff\xfe\x80 text, more of it. " * 300, "bom": b"\xef\xbb\xbf" + (han * 300).encode(), "page": ("<html><body><p>" + han * 400 + "</p></body></html>").encode(),
    }
    rows = [(k, f"/d/{name}.txt", None, bytearray(c)) for k, (name, c) in enumerate(texts.items())]
    rows += [(1000 + k, f"/d/{k}", None, bytearray(b"A short plain text about files.")) for k in range(200)]
    files = T.detect(spark.createDataFrame(rows, "doc_id long, path string, modificationTime timestamp, content binary"))
    kinds = {r.doc_id: r.filetype for r in files.select("doc_id", "filetype").collect()}
    names = list(texts)
    assert {names[k]: v for k, v in kinds.items() if k < 1000 and v != "TXT"} == {"page": "HTML"}
    assert all(v == "TXT" for k, v in kinds.items() if k >= 1000)
    found = {r.doc_id: r.n for r in PL.partition(files).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert set(found) == set(kinds) and PL.errors(files).count() == 0


def test_types_by_all_of_the_text(spark):
    lines = "\n".join(["a,b,c"] * 10)
    cases = {
        "csv": (lines + "\n1,2,3\n", "CSV"), "late": (lines + "\n1,2\n", "TXT"), "quoted": ('a,b\n"x, y\nz",2\n', "CSV"), "json": ("[" + "1, " * 5000 + "2]", "JSON"), "nojson": ("[" + "1, " * 5000 + "2", "TXT"),
        "mail": ("MIME-Version: 1.0\nDate: Fri, 16 Dec 2022\nMessage-ID: <a>\nX: y\nSubject: s\nFrom: a\nTo: b\n\nhi", "EML"), "nomail": ("Date: x\nSubject: s\nMessage-ID: a\nFrom: a\nTo: b\n", "TXT"),
        "binary": ("text " * 2000 + "\0", "UNK"), "xml": ("<?xml version='1.0'?><a>b</a>", "XML"),
    }
    rows = [(k, f"/d/{n}", None, bytearray(t.encode())) for k, (n, (t, _)) in enumerate(cases.items())]
    got = T.detect(spark.createDataFrame(rows, "doc_id long, path string, modificationTime timestamp, content binary"))
    assert {r.path[3:]: r.filetype for r in got.select("path", "filetype").collect()} == {n: k for n, (_, k) in cases.items()}


def test_one_conversation_a_file_over_all_cores(spark, sf_dir):
    """Files made of few bytes each still go over all cores."""
    from pagewright import operator_queries as Q

    files = Q._typed(spark, sf_dir, "cast(conv_id as string)", "TXT")
    files.cache().count()
    try:
        assert files.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        assert files.select("doc_id").distinct().count() == files.count()
    finally:
        files.unpersist()


def test_file_types_look_once(spark):
    """The text is looked through once, whatever the number of branches that look at the text; odd characters count as before."""
    from pagewright.sources import filetype as T

    rows = [(0, b"a,b\n1,2\n"), (1, b"a,b\n\"1,\n1\",2\n\n"), (2, b"a,b\n1\n"), (3, b"x" * 99 + b"\x01"), (4, b"x" * 98 + b"\x01"), (5, b"{\"a\": 1}"), (6, b"\xfe\xff\0a\0,\0b\0\n\0c\0,\0d"), (7, None), (8, b"")]
    files = spark.createDataFrame([(k, "/d/f", None if c is None else bytearray(c)) for k, c in rows], "doc_id long, path string, content binary")
    df = T.detect(files)
    got = {r.doc_id: r.filetype for r in df.collect()}
    assert got == {0: "CSV", 1: "CSV", 2: "TXT", 3: "TXT", 4: "UNK", 5: "JSON", 6: "CSV", 7: "EMPTY", 8: "EMPTY"}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("x1A") == 1


def test_base64_profile_looks_once(spark):
    from pagewright.sources import filetype as T

    df = T.profile_base64(spark.createDataFrame([("data:text/plain;base64,YSxiCjEsMgo=", "x"), ("eHg=", "y.md")], "contents string, filename string"))
    assert sorted((r.filename, r.filesize, r.filetype) for r in df.collect()) == [("x", 8, "CSV"), ("y.md", 2, "MD")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("x1A") == 1
