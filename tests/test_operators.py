"""Layout, element and staging operators on small cases that the driver's tables don't hold."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import elements as E
from pagewright.operators import layout as L
from pagewright.operators import staging as K
from pagewright.schema import metadata


def boxes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, page int, line_no int, x0 double, y0 double, x1 double, y1 double")


def test_assign_lines(spark):
    lines = boxes(spark, [(1, 1, k, 0.0, 10.0 * k, 100.0, 10.0 * k + 8) for k in range(6)])
    lay = spark.createDataFrame([(1, 1, 0, 4, -1.0, -1.0, 101.0, 29.0), (1, 1, 1, 4, -1.0, -1.0, 101.0, 9.0), (1, 1, 2, 5, -1.0, 39.0, 101.0, 60.0)], "doc_id long, page int, box_id int, label int, x0 double, y0 double, x1 double, y1 double")
    got = {r.line_no: (r.block_no, r.box_id) for r in L.assign_lines(lines, lay).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (3, None), 4: (4, 2), 5: (4, 2)}


def test_reading_order(spark):
    b = boxes(spark, [(1, 1, 0, 50.0, 10.0, 90.0, 20.0), (1, 1, 1, 0.0, 12.0, 40.0, 20.0), (1, 1, 2, 0.0, 40.0, 40.0, 50.0), (1, 1, 3, 60.0, 38.0, 90.0, 50.0)])
    got = [r.line_no for r in L.reading_order(b).orderBy("ord").collect()]
    assert got == [1, 0, 2, 3]


def test_same_line(spark):
    b = boxes(spark, [(1, 1, 0, 50.0, 10.0, 90.0, 20.0), (1, 1, 1, 0.0, 12.0, 40.0, 20.0), (1, 1, 2, 0.0, 40.0, 40.0, 50.0)])
    assert {r.line_no: (r.line, r.pos) for r in L.same_line_boxes(b).collect()} == {0: (0, 1), 1: (0, 0), 2: (1, 0)}


def test_columns(spark):
    two = [(1, 1, k, 0.0 if k % 2 else 52.0, 10.0 * k, 48.0 if k % 2 else 100.0, 10.0 * k + 8) for k in range(6)]
    one = [(2, 1, k, 0.0, 10.0 * k, 100.0, 10.0 * k + 8) for k in range(3)]
    got = {(r.doc_id, r.line_no): r.column for r in L.columns(boxes(spark, two + one)).collect()}
    assert all(got[(1, k)] == (0 if k % 2 else 1) for k in range(6)) and all(got[(2, k)] == 0 for k in range(3))


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 0.0, 10.0), (1, 5.0, 20.0), (1, 20.0, 30.0), (1, 50.0, 60.0)], "doc_id long, x0 double, x1 double")
    m = L.merge_intervals(rows, "x0", "x1", "doc_id")
    assert sorted((r.x0, r.x1) for r in m.collect()) == [(0.0, 20.0), (20.0, 30.0), (50.0, 60.0)]
    free = L.free_intervals(m.withColumn("a", F.lit(-20.0)).withColumn("b", F.lit(65.0)), "x0", "x1", "a", "b", "doc_id")
    assert sorted((r.x0, r.x1) for r in free.collect()) == [(-20.0, 0.0), (20.0, 20.0), (30.0, 50.0)]


def test_formulas(spark):
    lines = boxes(spark, [(1, 1, k, 0.0, 10.0 * k, 100.0, 10.0 * k + 8) for k in range(4)]).withColumn("text", F.concat(F.lit("t"), "line_no")).withColumn("block_type", F.lit(0))
    f = spark.createDataFrame([(1, 1, 7, "isolated", "$x$", -1.0, 9.0, 101.0, 29.0), (1, 1, 8, "isolated", "$y$", 500.0, 0.0, 510.0, 5.0)], "doc_id long, page int, box_id int, type string, text string, x0 double, y0 double, x1 double, y1 double")
    got = [(r.line_no, r.text, r.block_type) for r in L.formula_lines(lines, f).orderBy("line_no").collect()]
    assert got == [(0, "t0", 0), (1, "$x$", L.FORMULA), (3, "t3", 0)]
    e = boxes(spark, [(1, 1, 0, 20.0, 0.0, 30.0, 8.0), (1, 1, 0, 60.0, 0.0, 70.0, 8.0)])
    assert sorted((r.x0, r.x1) for r in L.split_line(lines.filter("line_no = 0"), e).collect()) == [(0.0, 20.0), (30.0, 60.0), (70.0, 100.0)]


def test_stitch_paragraphs(spark):
    cols = "doc_id long, page int, ord int, layout_type int, text string, x0 double, x1 double, l_x0 double, l_x1 double, l_y0 double, l_y1 double, f_x0 double, f_x1 double, f_y0 double, f_y1 double"
    b = lambda d, p, o, t, text, lw=100.0, fx=0.0: (d, p, o, t, text, 0.0, 100.0, 0.0, lw, 0.0, 10.0, fx, 100.0, 0.0, 10.0)
    rows = [b(1, 1, 0, 3, "head"), b(1, 1, 1, 4, "starts here and"), b(1, 2, 0, 4, "goes on"), b(1, 3, 0, 4, "and on"), b(2, 1, 0, 4, "short", 50.0), b(2, 2, 0, 4, "other"), b(3, 1, 0, 4, "a"), b(3, 2, 0, 4, "indented", fx=30.0)]
    got = [(r.doc_id, r.page, r.text, r.pages) for r in L.stitch_paragraphs(spark.createDataFrame(rows, cols)).orderBy("doc_id", "page", "ord").collect()]
    assert got == [(1, 1, "head", [1]), (1, 1, "starts here and goes on and on", [1, 2, 3]), (2, 1, "short", [1]), (2, 2, "other", [2]), (3, 1, "a", [1]), (3, 2, "indented", [2])]


def test_stitch_tables(spark):
    t = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    u = "| x | y |\n| --- | --- |\n| 3 | 4 |"
    rows = [(1, 1, 0, t, 100.0), (1, 2, 0, t, 102.0), (2, 1, 0, t, 100.0), (2, 2, 0, u, 100.0), (3, 1, 0, t, 100.0), (3, 2, 0, u, 150.0)]
    got = {(r.doc_id, r.page): r.md for r in L.stitch_tables(spark.createDataFrame(rows, "doc_id long, page int, ord int, md string, width double")).collect()}
    assert got == {(1, 1): t + "\n| 1 | 2 |", (2, 1): t + "\n| x | y |\n| 3 | 4 |", (3, 1): t, (3, 2): u}


def test_markdown(spark):
    df = spark.createDataFrame([([["a", "b"], ["1"]],), ([],), ([["a"], ["1", "2"]],)], "rows array<array<string>>")
    got = [r[0] for r in df.select(L.markdown_table(df.rows)).collect()]
    assert got == ["| a | b |\n| --- | --- |\n| 1 |", "", "| a |\n| --- | --- |\n| 1 | 2 |"]
    assert [r[0] for r in df.select(L.markdown_table(df.rows, None)).collect()][2] == "| a |\n| --- |\n| 1 | 2 |"


def test_layout_elements(spark):
    rows = [(1, 3, "T", ["T"], [[0.0]], [1]), (1, 4, "ab c", ["ab", "c"], [[0.0], [1.0]], [1, 2]), (1, 6, "head", ["head"], [[0.0]], [1]), (1, 5, "| a |", ["| a |"], [[0.0]], [1, 1])]
    got = L.layout_elements(spark.createDataFrame(rows, "doc_id long, layout_type int, text string, lines array<string>, boxes array<array<double>>, pages array<int>")).collect()
    assert [r.type for r in got] == ["Title", "UncategorizedText", "Table"]
    assert json.loads(got[1].extra_data) == {"bboxes": [[0.0], [1.0]], "pages": [1, 2], "indexes": [[0, 1], [2, 2]], "types": ["paragraph", "paragraph"]}
    assert json.loads(got[2].extra_data)["pages"] == [1] and json.loads(got[2].extra_data)["indexes"] == [[0, 4]]


def test_strategy(spark):
    rows = [("auto", True, True, True, True), ("auto", False, True, False, False), ("auto", False, False, True, True), ("hi_res", False, False, False, True), ("ocr_only", False, True, False, False)]
    df = spark.createDataFrame(rows, "s string, t boolean, e boolean, m boolean, o boolean")
    assert [r[0] for r in df.select(L.pdf_strategy(df.s, df.t, df.e, df.m, df.o)).collect()] == ["hi_res", "fast", "ocr_only", "ocr_only", "fast"]


def make(spark):
    rows = [(1, k, 1 + k // 2, t, x, f"id{k}") for k, (t, x) in enumerate([("Title", "A"), ("NarrativeText", "b"), ("Table", "c"), ("NarrativeText", "d [image: e.png] f")])]
    e = spark.createDataFrame(rows, "doc_id long, ord int, page_number int, type string, text string, element_id string")
    return e.withColumn("metadata", metadata(page_number=F.col("page_number"), text_as_html=F.when(F.col("type") == "Table", F.lit("<table>\n</table>")), sent_from=F.array(F.lit("x"), F.lit("y"))))


def test_boilerplate(spark):
    rows = [(1, 0, 1, ["header"]), (1, 1, 1, ["div"]), (1, 2, 1, ["footer"]), (1, 3, 1, ["div"]), (1, 4, 2, ["header"]), (1, 5, 3, ["table", "tr"]), (1, 6, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, page_number int, ancestortags array<string>")
    got = [(r.ord, r.page_number) for r in E.drop_boilerplate(df, True, True).orderBy("ord").collect()]
    assert got == [(1, 1), (6, 2)]


def test_pages_round_trip(spark):
    e = make(spark)
    back = E.flatten_pages(E.to_pages(e))
    assert [(r.ord, r.page_number, r.type, r.text) for r in back.orderBy("ord").collect()] == [(r.ord, r.page_number, r.type, r.text) for r in e.orderBy("ord").collect()]


def test_positional_join_checks(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "doc_id long, ord int, a string")
    b = spark.createDataFrame([(1, 0, "p"), (1, 1, "q")], "doc_id long, ord int, b string")
    assert sorted((r.a, r.b) for r in E.positional_join(a, b).collect()) == [("x", "p"), ("y", "q")]
    with pytest.raises(Exception, match="different lengths"):
        E.positional_join(a, b.filter("ord = 0")).collect()


def test_toc(spark):
    items = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "doc_id long, ord int, href string")
    toc = spark.createDataFrame([(1, "a", "One", 0), (1, "a", "One again", 1), (1, "c", "Three", 2)], "doc_id long, href string, title string, toc_ord int")
    assert [r.section for r in E.toc_join(items, toc).orderBy("ord").collect()] == ["One again", "One again", "Three"]


def test_images_and_lists(spark):
    got = [(r.type, r.text) for r in E.embedded_images(make(spark).drop("metadata")).orderBy("ord").collect()]
    assert got == [("Title", "A"), ("NarrativeText", "b"), ("Table", "c"), ("NarrativeText", "d  f"), ("Image", "e.png")]
    rows = spark.createDataFrame([(1, 0, "List", "1. one\n2. two"), (1, 1, "Checked", "x"), (1, 2, "List", "• a\n• b"), (1, 3, "Odd", "y")], "doc_id long, ord int, type string, text string")
    assert [(r.type, r.text, r.checked) for r in E.normalize_layout(rows).orderBy("ord").collect()] == [("ListItem", "one", None), ("ListItem", "two", None), ("CheckBox", "x", True), ("ListItem", "a", None), ("ListItem", "b", None), ("UncategorizedText", "y", None)]


def test_isd(spark):
    e = make(spark)
    one = json.loads(K.isd(e).filter("ord = 2").first().isd)
    assert one == {"type": "Table", "element_id": "id2", "text": "c", "metadata": {"page_number": 2, "text_as_html": "<table>\n</table>", "sent_from": ["x", "y"]}}
    docs = K.isd_documents(e)
    assert [x["text"] for x in json.loads(docs.first().isd)] == ["A", "b", "c", "d [image: e.png] f"]
    assert [(r.ord, r.type) for r in K.from_isd(docs).orderBy("ord").collect()] == [(0, "Title"), (1, "NarrativeText"), (2, "Table"), (3, "NarrativeText")]
    bad = spark.createDataFrame([(1, "[1]"), (2, "{}"), (3, None), (4, '[{"type":"Nope","text":"x"}]')], "doc_id long, isd string")
    assert K.from_isd(bad).count() == 0


def test_sinks(spark, tmp_path):
    e = make(spark)
    assert K.plain_text(e).first().text == "A\n\nb\n\nc\n\nd [image: e.png] f"
    page = K.html_page(e).first().html
    assert "<h1>A</h1>" in page and "<table> </table>" in page and page.count("#EBEBEB") == 1 and page.count("#ABBAEA") == 1
    flat = K.flat(e).orderBy("ord").first()
    assert flat.sender == "x" and flat.page_number == 1 and "coordinates_system" in K.flat(e).columns
    csv = K.csv_columns(e)
    assert all(t == "string" or t in ("bigint", "int", "double", "boolean") for _, t in csv.dtypes)
    csv.write.csv(str(tmp_path / "c"), header=True)
    K.write_isd(e, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert "coordinates_system" not in K.drop_empty_columns(K.flat(e)).columns
    rows = json.loads(K.baseplate(e).first().rows)["rows"]
    assert [r["data"]["text"] for r in rows] == ["A", "b", "c", "d [image: e.png] f"]
    assert K.weaviate(e).columns[-2:] == ["text", "category"] and {"name": "text", "dataType": ["text"]} in K.weaviate_class()["properties"]
    assert [r.text for r in K.transformers_chunks(e.select("doc_id", "ord", "text"), 4, 2).filter("ord = 3").orderBy("chunk").collect()] == ["d [image:", "e.png] f"]


def test_stage_checks(spark):
    e = make(spark)
    with pytest.raises(Exception, match="taken"):
        K.prodigy(e, F.create_map(F.lit("ID"), F.lit("1"))).collect()
    with pytest.raises(Exception, match="attachment"):
        K.label_box(e, "http://x", attachments=F.array(F.struct(F.lit("odd").alias("type"), F.lit("v").alias("value")))).collect()
    bad = spark.createDataFrame([(1, 0, [("odd",)], 0.5)], "doc_id long, ord int, result array<struct<type:string>>, score double")
    with pytest.raises(Exception, match="allowed"):
        K.label_studio(e, predictions=bad).collect()
    fine = spark.createDataFrame([(1, 0, [("labels",)], 0.5)], "doc_id long, ord int, result array<struct<type:string>>, score double")
    task = json.loads(K.label_studio(e, predictions=fine).filter("ord = 0").first().task)
    assert task["data"] == {"text": "A", "ref_id": "id0"} and task["predictions"][0]["score"] == 0.5
    with pytest.raises(ValueError):
        K.argilla(e, "odd")
    assert K.argilla(e, "token_classification").filter("ord = 1").first().tokens == ["b"]


def test_coordinates(spark):
    from pagewright.functions.metadata import convert_coordinates
    from pagewright.schema import COORDINATES

    df = spark.createDataFrame([(([(10.0, 20.0)], "PixelSpace", 100.0, 200.0),), ((None, "PixelSpace", None, None),)], f"c {COORDINATES}")
    got = [r[0] for r in df.select(convert_coordinates(df.c, "PointSpace", 1000, 1000)).collect()]
    assert (got[0].points[0].x, got[0].points[0].y) == (100.0, 900.0) and got[1] is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_pages(spark, pages=300):
    import random

    r = random.Random(5)
    rows = [(p, 1, k, float(r.randrange(40)), float(r.randrange(60)), 50.0, 0.0) for p in range(pages) for k in range(r.randrange(1, 9))]
    return [(*x[:6], x[4] + r.choice((4.0, 9.0, 30.0))) for x in rows]


def test_reading_order_many_pages(spark):
    """As insertion says, and without a frame of its own for each page."""
    rows = random_pages(spark)
    df = L.reading_order(boxes(spark, rows))
    assert "FlatMapGroupsInPandas" not in plan(df)
    want = {}
    for p in {x[0] for x in rows}:
        res = sorted((x for x in rows if x[0] == p), key=lambda x: (x[4], x[3]))
        for i in range(1, len(res)):
            j = i
            while j > 0 and abs(res[j][4] - res[j - 1][4]) < 10 and res[j][3] < res[j - 1][3]:
                res[j - 1], res[j] = res[j], res[j - 1]
                j -= 1
        want[p] = [(x[3], x[4]) for x in res]
    got = {}
    for r in df.orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.x0, r.y0))
    assert got == want


def test_same_line_many_pages(spark):
    """As all pairs say, and without a frame of its own for each page; a box without a left side is the last of its line."""
    rows = random_pages(spark)
    df = L.same_line_boxes(boxes(spark, rows))
    assert "FlatMapGroupsInPandas" not in plan(df)
    want = []
    for p in {x[0] for x in rows}:
        left, n = sorted((x for x in rows if x[0] == p), key=lambda x: (x[4], x[3])), 0
        while left:
            a = left[0]
            row = [a, *(b for b in left[1:] if (min(a[6], b[6]) - max(a[4], b[4])) / min(a[6] - a[4], b[6] - b[4]) > 0.1)]
            left = [b for b in left if not any(b is x for x in row)]
            want += [(p, n, k, x[3]) for k, x in enumerate(sorted(row, key=lambda x: x[3]))]
            n += 1
    assert sorted((r.doc_id, r.line, r.pos, r.x0) for r in df.collect()) == sorted(want)
    b = boxes(spark, [(1, 1, 0, None, 10.0, 90.0, 20.0), (1, 1, 1, 0.0, 12.0, 40.0, 20.0)])
    assert {r.line_no: (r.line, r.pos) for r in L.same_line_boxes(b).collect()} == {0: (0, 1), 1: (0, 0)}
