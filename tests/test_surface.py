"""Properties, the data source, SQL functions, sinks by file."""

import struct

import pytest

from pagewright.operators import staging as K
from pagewright.plans import sql
from pagewright.sources import properties as R
from pagewright.sources.datasource import FolderSource


def jpeg(tags):
    """A JPEG head with an EXIF block of text tags."""
    body, data = b"", b""
    at = 8 + 2 + 12 * len(tags) + 4
    for tag, text in tags.items():
        raw = text.encode() + b"\0"
        body += struct.pack("<HHII", tag, 2, len(raw), at + len(data))
        data += raw
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + body + b"\0\0\0\0" + data
    return b"\xff\xd8\xff\xe1\0\0Exif\0\0" + tiff


def test_properties(spark):
    from test_sources import DOCX

    rows = [(1, bytearray(DOCX)), (2, bytearray(b"x")), (3, None), (4, bytearray(jpeg({0x010F: "Maker", 0x0132: "2020:01:31 10:20:30"}))), (5, bytearray(jpeg({0x0132: "bad date, bad"})))]
    df = spark.createDataFrame(rows, "doc_id long, content binary")
    got = {r.doc_id: r for r in df.select("doc_id", R.core(df.content).alias("core"), R.exif_tags(df.content).alias("exif"), R.taken_at(df.content).alias("at")).collect()}
    assert got[1].core.title == "Report" and got[1].core.revision is None and got[2].core is None and got[3].core is None
    assert got[4].exif["Make"] == "Maker" and str(got[4].at) == "2020-01-31 10:20:30" and got[5].at is None and got[2].exif == {}


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    R.write_jsonl(df, str(tmp_path / "j"))
    assert sorted((r.id, r.t) for r in R.read_jsonl(spark, str(tmp_path / "j"), "id long, t string").collect()) == [(1, "a"), (2, None)]


def test_data_source(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(5):
        (tmp_path / "d" / f"{k}.txt").write_text("x" * k)
    spark.dataSource.register(FolderSource)
    df = spark.read.format("pagewright_folder").option("filesPerPartition", 2).load(str(tmp_path / "d"))
    assert sorted((r.path[-5:], r.length, bytes(r.content)) for r in df.collect()) == [(f"{k}.txt", k, b"x" * k) for k in range(5)]


def test_sql(spark, sf_dir):
    sql.register(spark)
    spark.read.parquet(f"{sf_dir}/pages.parquet").limit(5).createOrReplaceTempView("some_pages")
    rows = spark.sql("SELECT page_id, e.* FROM some_pages, LATERAL html_elements(html) e").collect()
    assert len(rows) > 5 and {"ord", "kind", "tag", "text"} <= set(rows[0].asDict())
    assert spark.sql("SELECT table_to_markdown('<table><tr><td>a</td></tr></table>')").first()[0] == "| a |\n| --- |"
    assert [r.text for r in spark.sql("SELECT p.text FROM (SELECT 'a b\n\nc' AS t), LATERAL text_paragraphs(t, 100) p").collect()] == ["a b", "c"]
    with pytest.raises(ValueError):
        sql.exactly_one(a=None, b="")
    sql.exactly_one(a=1, b=None)


def test_text_files(spark, tmp_path):
    df = spark.createDataFrame([("i1", "a"), ("i1", "a"), ("i2", "é")], "element_id string, text string")
    K.write_texts(df, str(tmp_path / "t"))
    assert {p.name: p.read_text() for p in (tmp_path / "t").iterdir()} == {"i1.txt": "a", "i2.txt": "é"}
