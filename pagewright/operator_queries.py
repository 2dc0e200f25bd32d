"""Queries of single operators over inputs made from the given tables, each compared with SQL as a whole.

Inputs are made by the same rule in Columns and in SQL; what is done with them is the operator's on one side and SQL's on
the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import classify as C
from .functions import metadata as M
from .functions import paragraphs as P
from .functions import text as X
from .operators import elements as E
from .operators import layout as L
from .operators import staging as K
from .plans import partition as PL
from .queries import _ELEMENTS, _INTER, _ITEMS, _LAYOUT, _LINES, WS, conversation_elements, items, layout_boxes, line_boxes, query, read, strip_sql
from .sources import filetype as FT
from .sources.html import partition_html
from .streaming import ingest

_FULL = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_C = "conversations"


def made(name: str, table: str, key: str, given: str, own: str, f, sql: str) -> None:
    """A query of one Column function over an input that is given as a Spark expression and in SQL (``t`` there)."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        d = read(spark, folder, table).select(*[F.col(k) for k in key.split(", ")], F.expr(given).alias("t"))
        return d.select(*[F.col(k) for k in key.split(", ")], f(F.col("t")).alias("v"))

    run.__name__ = name
    query(f"SELECT {key}, {sql} AS v FROM (SELECT {key}, {own} AS t FROM {table})")(run)


def _l(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# ---- text -----------------------------------------------------------------------------------------------------------

made("empty_line_ratio", "documents", "doc_id", "text", "text", P.empty_line_ratio, rf"len(list_filter(string_split(t, chr(10)), lambda z: NOT regexp_matches(z, '{_FULL}'))) / CAST(len(string_split(t, chr(10))) AS DOUBLE)")
made("bytes_to_string", "documents", "doc_id", "decode(encode(text, 'UTF-8'), 'ISO-8859-1')", "text", X.bytes_string_to_string, "t")
_WRONG = [("\u0091", "‘"), ("\u0092", "’"), ("\u0093", "“"), ("\u0094", "”"), ("&apos;", "'"), ("â\u0080\u0099", "'"), ("â\u0080“", "—"), ("â\u0080”", "–"), ("â\u0080˜", "‘"), ("â\u0080¦", "…"), ("â\u0080™", "’"), ("â\u0080œ", "“"), ("â\u0080?", "”"), ("â\u0080ť", "”"), ("â\u0080ś", "“"), ("â\u0080¨", "—"), ("â\u0080ł", "″"), ("â\u0080Ž", ""), ("â\u0080‚", ""), ("â\u0080‰", ""), ("â\u0080‹", ""), ("â\u0080", "")]
_ALL_WRONG = " ".join(w for w, _ in _WRONG)


def _replaced(t: str) -> str:
    for a, b in _WRONG:
        t = f"replace({t}, {_l(a)}, {_l(b)})"
    return t


@query(f"SELECT doc_id, {_replaced('text || ' + _l(_ALL_WRONG))} AS v FROM documents")
def unicode_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", X.replace_unicode_quotes(F.concat("text", F.lit(_ALL_WRONG))).alias("v"))


_MARKED = "CASE turn % 4 WHEN 0 THEN '1.' || turn || ' ' || text WHEN 1 THEN 'a.b.c. ' || text WHEN 2 THEN '1..2 ' || text ELSE text END"
_HEAD = f"list_filter(regexp_split_to_array({strip_sql('t')}, '{WS}+'), lambda w: w <> '')"
_GOOD = f"contains({_HEAD}[1], '.') AND NOT contains({_HEAD}[1], '..')"
made("ordered_bullets_cleaned", _C, "conv_id, turn", _MARKED, _MARKED, X.clean_ordered_bullets, f"CASE WHEN {_GOOD} AND length(split_part({_HEAD}[1], '.', 1)) <= 2 THEN array_to_string({_HEAD}[2:], ' ') ELSE t END")
for _i, _name in enumerate(("section", "sub_section", "sub_sub_section")):
    made(f"ordered_bullet_{_name}", _C, "conv_id, turn", _MARKED, _MARKED, lambda t, n=_name: X.extract_ordered_bullets(t)[n], f"CASE WHEN {_GOOD} AND length(list_filter(string_split({_HEAD}[1], '.'), lambda p: p <> '')[1]) <= 2 THEN list_filter(string_split({_HEAD}[1], '.'), lambda p: p <> '')[{_i + 1}] END")
_PHONE = "CASE turn % 3 WHEN 0 THEN 'Phone Number: 215-867-' || lpad(CAST(conv_id % 10000 AS STRING), 4, '0') WHEN 1 THEN '+1 (415) 555 01' || lpad(CAST(conv_id % 100 AS STRING), 2, '0') || ' x12 ' ELSE text || '!' END"
made("phone_extracted", _C, "conv_id, turn", _PHONE, _PHONE, X.extract_us_phone_number, strip_sql(r"regexp_extract(t, '(?:\+?([0-9]{1,3}))?[-. (]*([0-9]{3})?[-. )]*([0-9]{3})[-. ]*([0-9]{4})(?: *x([0-9]+))?[ \t-\r]*$')"))
made("mime_decoded", _C, "conv_id, turn", "trim(regexp_replace(text, '[=\\\\s]+', ' ')) || '=C3=A9=3D1'", r"trim(regexp_replace(text, '[=\s]+', ' ', 'g')) || 'é=1'", X.replace_mime_encodings, "t")
made("mail_dates", "events", "event_id", "'x; ' || date_format(ts, 'EEE, d MMM yyyy HH:mm:ss') || ' +0000 (UTC)'", "date_trunc('second', ts)", X.extract_datetimetz, "t")
made("sentence_counts", _C, "conv_id, turn", "regexp_replace(text, '[^\\\\x20-\\\\x7e]', 'x')", r"regexp_replace(text, '[^\x20-\x7e]', 'x', 'g')", C.sentence_count, r"""CASE WHEN trim(t) = '' THEN 0 ELSE CAST(1 + len(regexp_extract_all(t, '[.!?]["'')\]]* +[^ ]')) AS INTEGER) END""")
made("verb_predicate", _C, "conv_id, turn", "regexp_replace(text, '[^\\\\x20-\\\\x7e]', 'x')", r"regexp_replace(text, '[^\x20-\x7e]', 'x', 'g')", C.contains_verb, f"regexp_matches(t, {_l(C.VERB)})")
_PLACES = "CASE conv_id % 6 WHEN 0 THEN 'Doylestown, PA 18901' WHEN 1 THEN ' DOYLESTOWN, PENNSYLVANIA 18901-1234' WHEN 2 THEN 'Mobile, AL 36601' WHEN 3 THEN 'New York, New York, 10001' WHEN 4 THEN 'Nowhere, ZZ 12345' ELSE text END"
made("place_predicate", _C, "conv_id, turn", _PLACES, _PLACES, C.is_us_city_state_zip, f"regexp_matches({strip_sql('t')}, {_l(C.CITY_STATE_ZIP)})")
made("known_word", _C, "conv_id, turn", "text", "text", lambda t: C.contains_english_word(t, ["the", "Nicht", "of"]), r"len(list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}'']+'), lambda w: w IN ('the', 'nicht', 'of'))) > 0")
made("date_argument", "events", "event_id", "CASE event_id % 4 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 2 THEN date_format(ts, 'dd/MM/yyyy') ELSE 'x' END", "event_id % 4", C.is_valid_date_arg, "t IN (0, 1)")
made("code_mime", _C, "conv_id, turn", "CASE turn % 4 WHEN 0 THEN 'text/x-go' WHEN 1 THEN 'text/x-python' WHEN 2 THEN 'text/gopher' ELSE 'text/plain' END", "turn % 4", FT.is_code_mime_type, "t IN (0, 1)")
made("chinese_character", "documents", "doc_id", "substring(text, 1, 1)", "substr(text, 1, 1)", C.is_chinese, "regexp_matches(t, '^[一-鿿]$')")
made("full_width", _C, "conv_id, turn", "array('\"a, b\" (c)!', concat(\"'\", cast(conv_id as string), \"' and \\\"\"))", "'“a，b”（c）！;‘' || conv_id || '’and“'", lambda t: F.array_join(X.half_to_full_width(t), ";"), "t")
made("list_as_table", _C, "conv_id, turn", "array('a', cast(conv_id as string))", "'<table><thead>' || chr(10) || '<th>a</th>' || chr(10) || '<th>' || conv_id || '</th>' || chr(10) || '</thead></table>'", L.list_to_table, "t")
made("bulleted_paragraph", _C, "conv_id, turn", "concat('• one ', cast(conv_id as string), '\n goes on\n• two\n· three')", "'• one ' || conv_id || ' goes on|• two|· three'", lambda t: F.array_join(F.transform(P.group_bullet_paragraph(t), X.strip), "|"), "t")
_NUMBERED = "array_join(transform(sequence(0, cast(conv_id % 37 as int)), i -> concat('w', lpad(cast(i as string), 8, '0'), '.')), '{}')"
_NUMBERS = "list_transform(range(0, conv_id % 37 + 1), lambda i: 'w' || lpad(CAST(i AS VARCHAR), 8, '0') || '.')"
_GROUPED = "array_to_string(list_transform(range(0, (len(t) + {0} - 1) // {0}), lambda k: array_to_string(t[k * {0} + 1 : k * {0} + {0}], ' ')), '|')"
made("fitted_chunks", _C, "conv_id, turn", _NUMBERED.format(" "), _NUMBERS, lambda t: F.array_join(P.split_content_to_fit_max(t, 50), "|"), _GROUPED.format(4))
made("packed_paragraphs", _C, "conv_id, turn", _NUMBERED.format("\\n"), _NUMBERS, lambda t: F.array_join(P.split_by_paragraph(t, 25, 60), "|"), _GROUPED.format(5))
_HYPHENS = "transform(regexp_extract_all(text, '[A-Za-z0-9]+', 0), (w, i) -> if(i % 3 = 0, concat(w, '-'), w))"
made("joined_lines", _C, "conv_id, turn", _HYPHENS, r"list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w, i: CASE WHEN i % 3 = 1 THEN w || '-' ELSE w END)", X.join_lines, r"coalesce(replace(regexp_replace(array_to_string(t, chr(10)), '([A-Za-z])-\n([a-z])', '\1\2', 'g'), chr(10), ' '), '')")
_BROKEN = r"replace(replace(regexp_replace(text, '[^A-Za-z0-9 .,]', ''), ' the ', chr(10)), ' and ', chr(10) || chr(10))"
_PARTS = "list_filter(string_split(t, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(10)) <> '')"


def _grouped(p: str) -> str:
    short = f"len(list_filter(string_split({p}, chr(10)), lambda z: len(string_split(trim(z), ' ')) >= 5)) = 0"
    return f"CASE WHEN {short} THEN array_to_string(list_filter(string_split({p}, chr(10)), lambda z: trim(z) <> ''), chr(10) || chr(10)) ELSE regexp_replace({p}, '[ ]*\\n[ ]*', ' ', 'g') END"


@query(f"SELECT conv_id, turn, array_to_string(list_transform({_PARTS}, lambda p: {_grouped('p')}), chr(10) || chr(10)) AS v FROM (SELECT conv_id, turn, {_BROKEN} AS t FROM conversations WHERE NOT regexp_matches(text, '(^|[^A-Za-z])[eE][^A-Za-z]'))".replace("'[^A-Za-z0-9 .,]', ''", "'[^A-Za-z0-9 .,]', '', 'g'"))
def broken_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    c = read(spark, folder, _C).filter("NOT text rlike '(^|[^A-Za-z])[eE][^A-Za-z]'").select("conv_id", "turn", F.expr(_BROKEN.replace("chr(10)", "'\\n'")).alias("t"))
    return c.select("conv_id", "turn", P.group_broken_paragraphs(F.col("t")).alias("v"))


@query(rf"SELECT conv_id, turn, t || chr(10) || chr(10) || chr(10) || t AS v FROM (SELECT conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') AS t FROM conversations WHERE regexp_matches(text, '{_FULL}'))")
def auto_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Two lines of which none is blank."""
    c = read(spark, folder, _C).filter(F.col("text").rlike(r"(?U)\S")).select("conv_id", "turn", F.regexp_replace("text", r"\s+", " ").alias("t"))
    return c.select("conv_id", "turn", P.auto_paragraph_grouper(F.concat("t", F.lit("\n"), "t")).alias("v"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    e = ingest.windowed_counts(read(spark, folder, "events"), "ts", "1 hour", None, "1 hour", "event_type")
    return e.select("event_type", F.col("window.start").alias("start"), "n")


# ---- elements -------------------------------------------------------------------------------------------------------


@query(f"""WITH a AS (SELECT l_orderkey AS k, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS p FROM lineitem),
b AS (SELECT l_orderkey AS k, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_suppkey) AS p FROM lineitem)
SELECT k AS doc_id, CAST(p - 1 AS INTEGER) AS ord, l_partkey, l_quantity FROM a JOIN b USING (k, p)""")
def positional_join(spark: SparkSession, folder: str) -> DataFrame:
    """Two lists of each order, by part and by falling quantity, zipped."""
    from pyspark.sql import Window

    li = read(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    place = lambda *by: (F.row_number().over(Window.partitionBy("doc_id").orderBy(*by)) - 1).alias("ord")
    left = li.select("doc_id", place("l_partkey", "l_suppkey", "l_linenumber"), "l_partkey")
    right = li.select("doc_id", place(F.desc("l_quantity"), "l_linenumber", "l_suppkey"), "l_quantity")
    return E.positional_join(left, right).select("doc_id", "ord", "l_partkey", "l_quantity")


@query(f"""WITH i AS (SELECT l_orderkey AS doc_id, n AS ord, 'h' || (l_partkey % 5) AS href, l_quantity FROM {_ITEMS}),
t AS (SELECT doc_id, href, max_by('t' || ord, ord) AS title FROM i WHERE l_quantity > 25 GROUP BY 1, 2)
SELECT i.doc_id, i.ord, last_value(title IGNORE NULLS) OVER (PARTITION BY i.doc_id ORDER BY i.ord) AS section FROM i LEFT JOIN t ON i.doc_id = t.doc_id AND i.href = t.href""")
def contents_join(spark: SparkSession, folder: str) -> DataFrame:
    i = items(spark, folder).select(F.col("l_orderkey").alias("doc_id"), F.col("n").alias("ord"), F.concat(F.lit("h"), (F.col("l_partkey") % 5).cast("string")).alias("href"), "l_quantity")
    toc = i.filter("l_quantity > 25").select("doc_id", "href", F.concat(F.lit("t"), F.col("ord").cast("string")).alias("title"), F.col("ord").alias("toc_ord"))
    return E.toc_join(i.drop("l_quantity"), toc).select("doc_id", "ord", "section")


@query(f"SELECT doc_id, ord, lower(regexp_replace(text, '[-–]', ' ', 'g')) AS text FROM (SELECT doc_id, ord, {strip_sql('text')} AS text FROM ({_ELEMENTS}))")
def cleaners_applied(spark: SparkSession, folder: str) -> DataFrame:
    return E.apply_cleaners(conversation_elements(spark, folder), X.strip, lambda t: F.regexp_replace(t, "[-–]", " "), F.lower).select("doc_id", "ord", "text")


@query(f"SELECT doc_id, CAST(ord // 2 AS BIGINT) AS page_number, string_agg(text, '|' ORDER BY ord) AS texts FROM ({_ELEMENTS}) GROUP BY 1, 2")
def pages_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    e = conversation_elements(spark, folder).withColumn("page_number", F.floor(F.col("ord") / 2)).withColumn("ord", F.col("ord").cast("int"))
    return E.to_pages(e).select("doc_id", "page_number", F.array_join(F.transform("elements", lambda x: x["text"]), "|").alias("texts"))


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS ord, text FROM ({_ELEMENTS})")
def pages_flattened(spark: SparkSession, folder: str) -> DataFrame:
    e = conversation_elements(spark, folder).withColumn("page_number", F.floor(F.col("ord") / 2)).withColumn("ord", F.col("ord").cast("int"))
    pages = E.to_pages(e).withColumn("elements", F.transform("elements", lambda x: F.struct(x["text"].alias("text"))))
    return E.flatten_pages(pages).select("doc_id", "ord", "text")


@query(f"""WITH e AS (SELECT doc_id, ord, ord // 3 AS p, ord % 4 AS k FROM ({_ELEMENTS})),
f AS (SELECT *, max(CASE WHEN k = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, p ORDER BY ord) AS over FROM e WHERE k <> 3)
SELECT doc_id, ord, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY p) AS INTEGER) AS page_number FROM f WHERE over = 0 AND k <> 1""")
def boilerplate_dropped(spark: SparkSession, folder: str) -> DataFrame:
    tags = F.when(F.col("ord") % 4 == 1, F.array(F.lit("header"))).when(F.col("ord") % 4 == 2, F.array(F.lit("div"), F.lit("footer"))).when(F.col("ord") % 4 == 3, F.array(F.lit("table")))
    e = conversation_elements(spark, folder).withColumn("page_number", F.floor(F.col("ord") / 3)).withColumn("ancestortags", tags)
    return E.drop_boilerplate(e, True, True).select("doc_id", "ord", "page_number")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'own.txt' END AS filename, CASE WHEN doc_id % 3 = 0 THEN 7 ELSE 1 END AS page_number, CAST(NULL AS VARCHAR) AS url, true AS stripped FROM documents")
def metadata_merged(spark: SparkSession, folder: str) -> DataFrame:
    from .schema import metadata

    own = metadata(filename=F.lit("own.txt"), page_number=F.lit(1))
    new = metadata(filename=F.when(F.col("doc_id") % 2 == 0, "new"), page_number=F.when(F.col("doc_id") % 3 == 0, 7))
    d = read(spark, folder, "documents").select("doc_id", M.merge_metadata(own, new).alias("metadata"))
    gone = M.strip_metadata(d).select("doc_id", F.col("metadata").isNull().alias("stripped"))
    return d.join(gone, "doc_id").select("doc_id", "metadata.filename", "metadata.page_number", "metadata.url", "stripped")


@query("""WITH r AS (SELECT conv_id AS doc_id, turn, turn % 4 AS k FROM conversations),
e AS (SELECT doc_id, turn, 0 AS i, CASE k WHEN 0 THEN 'Title' WHEN 1 THEN 'CheckBox' WHEN 2 THEN 'UncategorizedText' END AS type, 't' || turn AS text, CASE WHEN k = 1 THEN true END AS checked FROM r WHERE k < 3
 UNION ALL SELECT doc_id, turn, 0, 'ListItem', 'one', NULL FROM r WHERE k = 3 UNION ALL SELECT doc_id, turn, 1, 'ListItem', 'two ' || turn, NULL FROM r WHERE k = 3)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn, i) - 1 AS INTEGER) AS ord, type, text, checked FROM e""")
def layout_normalized(spark: SparkSession, folder: str) -> DataFrame:
    k, t = F.col("turn") % 4, F.col("turn").cast("string")
    kind = F.when(k == 0, "Title").when(k == 1, "Checked").when(k == 2, "Strange").otherwise("List")
    text = F.when(k == 3, F.concat(F.lit("1. one\n2. two "), t)).otherwise(F.concat(F.lit("t"), t))
    rows = read(spark, folder, _C).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), kind.alias("type"), text.alias("text"))
    return E.normalize_layout(rows).select("doc_id", "ord", "type", "text", "checked")


@query(f"SELECT doc_id, ord, type, text, element_id, 'f.txt' AS filename, CASE WHEN ord > 0 THEN '[\"u' || ord || '\"]' END AS link_urls FROM ({_ELEMENTS})")
def csv_sink(spark: SparkSession, folder: str) -> DataFrame:
    from .schema import metadata

    e = conversation_elements(spark, folder).withColumn("metadata", metadata(filename=F.lit("f.txt"), link_urls=F.when(F.col("ord") > 0, F.array(F.concat(F.lit("u"), F.col("ord").cast("string"))))))
    return K.csv_columns(e, []).select("doc_id", F.col("ord").cast("long").alias("ord"), "type", "text", "element_id", "filename", "link_urls")


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS n, type, element_id, text FROM ({_ELEMENTS})")
def baseplate_stage(spark: SparkSession, folder: str) -> DataFrame:
    rows = F.from_json("rows", "struct<rows:array<struct<data:struct<type:string,element_id:string,text:string>,metadata:map<string,string>>>>")["rows"]
    return K.baseplate(conversation_elements(spark, folder)).select("doc_id", F.posexplode(rows).alias("n", "r")).select("doc_id", "n", "r.data.*")


@query(f"SELECT doc_id, ord, text, CASE WHEN type = 'Table' THEN substr(text, 1, 3) || '/W/0/3;' || substr(text, 5, 2) || '/V/4/6' ELSE '' END AS entities FROM ({_ELEMENTS})")
def datasaur_stage(spark: SparkSession, folder: str) -> DataFrame:
    e = conversation_elements(spark, folder)
    one = lambda at, n, k: e.filter("type = 'Table'").select("doc_id", "ord", F.substring("text", at + 1, n).alias("text"), F.lit(k).alias("type"), F.lit(at).alias("start_idx"), F.lit(at + n).alias("end_idx"))
    found = K.datasaur(e, one(4, 2, "V").unionByName(one(0, 3, "W")))
    return found.select("doc_id", "ord", "text", F.array_join(F.transform("entities", lambda x: F.concat_ws("/", x["text"], x["type"], x["start_idx"].cast("string"), x["end_idx"].cast("string"))), ";").alias("entities"))


# ---- layout ---------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, box_id, label, x0 FROM ({_LAYOUT}) WHERE label <> 5 UNION ALL SELECT doc_id, box_id, 5 AS label, x0 + 1 FROM ({_LAYOUT}) WHERE label = 3")
def table_detector(spark: SparkSession, folder: str) -> DataFrame:
    boxes = layout_boxes(spark, folder)
    return L.merge_table_detector(boxes, boxes.filter("label = 3").withColumn("x0", F.col("x0") + 1)).select("doc_id", "box_id", "label", "x0")


_FORMULAS = f"SELECT doc_id, box_id, 'f' || box_id AS text, x0 - 1 AS x0, y0, x1, y1 FROM ({_LAYOUT}) WHERE label = 5"


@query(f"""WITH m AS (SELECT a.doc_id, a.line_no, b.box_id, b.text AS f, b.x0 AS fx FROM ({_LINES}) a JOIN ({_FORMULAS}) b ON a.doc_id = b.doc_id WHERE {_INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0)) > 0.7),
o AS (SELECT doc_id, box_id, min(line_no) AS line_no, any_value(f) AS f, any_value(fx) AS fx FROM m GROUP BY 1, 2), t AS (SELECT doc_id, line_no, min_by(f, box_id) AS text, min_by(fx, box_id) AS x0 FROM o GROUP BY 1, 2)
SELECT doc_id, line_no, text, x0 FROM ({_LINES}) a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = a.doc_id AND m.line_no = a.line_no) UNION ALL SELECT * FROM t""")
def formula_lines(spark: SparkSession, folder: str) -> DataFrame:
    f = layout_boxes(spark, folder).filter("label = 5").select("doc_id", "page", "box_id", F.lit("isolated").alias("type"), F.concat(F.lit("f"), F.col("box_id").cast("string")).alias("text"), (F.col("x0") - 1).alias("x0"), "y0", "x1", "y1")
    return L.formula_lines(line_boxes(spark, folder), f).select("doc_id", "line_no", "text", "x0")


_HALVES = f"SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN 0.0 WHEN doc_id % 3 = 0 THEN 90.0 ELSE 102.0 END AS x0, CASE WHEN line_no % 2 = 0 THEN 98.0 ELSE 200.0 END AS x1 FROM ({_LINES})"


@query(f"""WITH h AS ({_HALVES}), k AS (SELECT doc_id, bool_or(line_no % 2 = 0) AND bool_or(line_no % 2 = 1) AS split FROM h GROUP BY 1)
SELECT doc_id, line_no, CASE WHEN split AND doc_id % 3 <> 0 AND line_no % 2 = 1 THEN 1 ELSE 0 END AS "column" FROM h JOIN k USING (doc_id)""")
def page_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Left and right blocks, which overlap in every third document."""
    left = F.col("line_no") % 2 == 0
    b = line_boxes(spark, folder).withColumn("x0", F.when(left, 0.0).when(F.col("doc_id") % 3 == 0, 90.0).otherwise(102.0)).withColumn("x1", F.when(left, 98.0).otherwise(200.0))
    return L.columns(b).select("doc_id", "line_no", "column")


@query(f"""WITH t AS (SELECT l_orderkey AS doc_id, n AS page, 100.0 + 20 * (l_partkey % 2) AS w FROM {_ITEMS}), j AS (SELECT *, coalesce((w - lag(w) OVER o) / lag(w) OVER o < 0.05, false) AS joins FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY page)),
i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS g FROM j)
SELECT doc_id, min(page) AS page, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || page || ' | x |', chr(10) ORDER BY page) AS md FROM i GROUP BY doc_id, g""")
def stitched_tables(spark: SparkSession, folder: str) -> DataFrame:
    md = F.concat(F.lit("| a | b |\n| --- | --- |\n| "), F.col("n").cast("string"), F.lit(" | x |"))
    t = items(spark, folder).select(F.col("l_orderkey").alias("doc_id"), F.col("n").alias("page"), F.lit(0).alias("ord"), md.alias("md"), (100.0 + 20 * (F.col("l_partkey") % 2)).cast("double").alias("width"))
    return L.stitch_tables(t).select("doc_id", "page", "md")


@query(f"""WITH i AS (SELECT l_orderkey AS doc_id, n, 'p' || l_partkey AS t, sum(CASE WHEN l_quantity > 25 AND n > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM {_ITEMS})
SELECT doc_id, CAST(min(n) AS INTEGER) AS page, string_agg(t, ' ' ORDER BY n) AS text FROM i GROUP BY doc_id, g""")
def stitched_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as the only blocks of pages, those with a quantity above 25 going on from the page before."""
    li = items(spark, folder).select(F.col("l_orderkey").alias("doc_id"), F.col("n").alias("page"), F.lit(0).alias("ord"), F.lit(L.TEXT).alias("layout_type"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"), "l_quantity")
    start = F.when(F.col("l_quantity") > 25, 0.0).otherwise(30.0)
    n = {"x0": 0.0, "x1": 100.0, "y0": 0.0, "y1": 10.0}
    b = li.select("*", *[F.lit(v).alias(k) for k, v in n.items()], *[F.lit(v).alias("l_" + k) for k, v in n.items()], *[(start if k == "x0" else F.lit(v)).alias("f_" + k) for k, v in n.items()])
    return L.stitch_paragraphs(b).select("doc_id", "page", "text")


@query(f"SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, line_no) - 1 AS INTEGER) AS shape_index, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, line_no) = 1 AND abs(8.0 - y0) / 50.0 <= 0.2 AS is_title FROM ({_LINES})")
def slide_shapes(spark: SparkSession, folder: str) -> DataFrame:
    shapes = line_boxes(spark, folder).select("doc_id", F.lit(1).alias("slide"), F.col("line_no").alias("shape_no"), F.col("y0").alias("top"), F.col("x0").alias("left"), F.lit(8.0).alias("height"), F.lit(50.0).alias("slide_height"))
    return L.slide_title(L.order_shapes(shapes)).select("doc_id", F.col("shape_no").alias("line_no"), "shape_index", "is_title")


@query(f"SELECT doc_id, x0, CAST((line_no - 1) // 2 AS INTEGER) AS row_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY (line_no - 1) // 2, x0) - 1 AS INTEGER) AS ord FROM ({_LINES})")
def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    """Two boxes a row, a few points apart in height, from left to right."""
    row = F.floor((F.col("line_no") - 1) / 2)
    b = line_boxes(spark, folder).withColumn("y0", (row * 30 + F.col("line_no") % 2 * 5).cast("double")).withColumn("row_no", row.cast("int"))
    return L.reading_order(b).select("doc_id", "x0", "row_no", "ord")


@query(f"SELECT doc_id, CAST((line_no - 1) // 3 AS INTEGER) AS line, x0, CAST(row_number() OVER (PARTITION BY doc_id, (line_no - 1) // 3 ORDER BY x0) - 1 AS INTEGER) AS pos FROM ({_LINES})")
def same_lines(spark: SparkSession, folder: str) -> DataFrame:
    y = (F.floor((F.col("line_no") - 1) / 3) * 20).cast("double")
    return L.same_line_boxes(line_boxes(spark, folder).withColumn("y0", y).withColumn("y1", y + 8)).select("doc_id", "line", "x0", "pos")


@query(f"SELECT doc_id, line_no, x0 / 200.0 * 400.0 AS x, 1.0 * 800.0 - (1.0 - y0 / 100.0) * 800.0 AS y FROM ({_LINES})")
def coordinates_scaled(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of a page of 200 x 100 on one of 400 x 800."""
    points = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")))
    c = F.struct(points.alias("points"), F.lit("PixelSpace").alias("system"), F.lit(200.0).alias("layout_width"), F.lit(100.0).alias("layout_height"))
    b = line_boxes(spark, folder).select("doc_id", "line_no", F.get(M.convert_coordinates(c, "PixelSpace", 400, 800)["points"], F.lit(0)).alias("p"))
    return b.select("doc_id", "line_no", "p.x", "p.y")


@query(f"SELECT a.doc_id, a.line_no, a.x0 <= b.x0 AND b.x0 <= a.x1 AS holds, greatest(a.x0, b.x0) < least(a.x1, b.x1) AS overlaps, a.x0 <= b.x0 AND b.x0 <= a.x1 AND (b.x0 - a.x0 <= 5 OR a.x1 - b.x1 <= 5 OR abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) <= 5) AS aligned FROM ({_LINES}) a JOIN ({_LAYOUT}) b ON a.doc_id = b.doc_id AND a.line_no = b.box_id")
def segments(spark: SparkSession, folder: str) -> DataFrame:
    b = layout_boxes(spark, folder).select("doc_id", F.col("box_id").alias("line_no"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    a = [F.col(c) for c in ("x0", "x1", "b0", "b1")]
    return line_boxes(spark, folder).join(b, ["doc_id", "line_no"]).select("doc_id", "line_no", C.segment_contains(*a).alias("holds"), C.segments_overlap(*a).alias("overlaps"), C.segments_align(*a, 5, 1).alias("aligned"))


@query(f"SELECT doc_id, line_no, x0, y0, x1, y1 FROM ({_LINES})")
def polygons(spark: SparkSession, folder: str) -> DataFrame:
    box = L.polygon_box(L.box_polygon(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    return line_boxes(spark, folder).select("doc_id", "line_no", box.alias("b")).select("doc_id", "line_no", "b.*")


@query("SELECT n_regionkey AS doc_id, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY 1")
def markdown_tables(spark: SparkSession, folder: str) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_name"], x["n_nationkey"].cast("string")))
    n = read(spark, folder, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(rows.alias("r"))
    return n.select("doc_id", L.markdown_table(F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), "r")).alias("md"))


@query("SELECT doc_id, string_agg(cells, ';' ORDER BY r) AS cells FROM (SELECT n_regionkey AS doc_id, n_nationkey % 3 AS r, string_agg(n_name, ',' ORDER BY n_nationkey) AS cells FROM nation GROUP BY 1, 2) GROUP BY 1")
def cell_grid(spark: SparkSession, folder: str) -> DataFrame:
    cells = read(spark, folder, "nation").select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") % 3).alias("row"), F.floor(F.col("n_nationkey") / 3).alias("col"), F.col("n_name").alias("text"))
    return L.grid(cells).select("doc_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"))


# ---- files ----------------------------------------------------------------------------------------------------------

_KINDS = "HTML JSON CSV XML EML PDF UNK TXT".split()


def _file_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of all kinds, most of them as UTF-8, every third plain text as Latin-1 or cut within a letter."""
    t = F.regexp_replace("text", "[,<\\x00-\\x08\\x0e-\\x1f]", "")
    k = F.col("doc_id") % 8
    body = (
        F.when(k == 0, F.concat(F.lit("<html><p>"), t)).when(k == 1, F.to_json(F.struct(t.alias("t")))).when(k == 2, F.concat(F.lit("a,b\n"), F.regexp_replace(t, '["\n\r]', " "), F.lit(",2\n")))
        .when(k == 3, F.concat(F.lit("<?xml version='1.0'?><a/>"), t)).when(k == 4, F.concat(F.lit("Date: x\nMessage-ID: y\nSubject: z\nFrom: a\nTo: b\n\n"), t)).when(k == 5, F.concat(F.lit("%PDF-1.4 "), t)).when(k == 6, F.concat(F.lit("x\0"), t)).otherwise(F.concat(F.lit("words "), t))
    )
    raw = F.encode(body, "UTF-8")
    latin = F.encode(F.regexp_replace(body, "[^\\x00-\\xff]", "ÿ"), "ISO-8859-1")
    content = F.when((k == 7) & (F.col("doc_id") % 3 == 0), latin).when((k == 7) & (F.col("doc_id") % 3 == 1), F.concat(raw, F.unhex(F.lit("E6AF")))).otherwise(raw)
    return read(spark, folder, "documents").select("doc_id", F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), content.alias("content"))


@query("SELECT doc_id, ['" + "', '".join(_KINDS) + "'][doc_id % 8 + 1] AS filetype FROM documents")
def file_types(spark: SparkSession, folder: str) -> DataFrame:
    return FT.detect(_file_rows(spark, folder)).select("doc_id", "filetype")


@query("SELECT 'd' || doc_id || '.md' AS filename, CAST(octet_length(encode(text)) AS INTEGER) AS filesize, '.md' AS extension, CASE WHEN text = '' THEN 'EMPTY' ELSE 'MD' END AS filetype FROM documents WHERE NOT regexp_matches(text, '[\\x00-\\x08\\x0e-\\x1f]')")
def base64_profile(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents").filter("NOT text rlike '[\\\\x00-\\\\x08\\\\x0e-\\\\x1f]'")
    d = d.select(F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8"))).alias("contents"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"))
    return FT.profile_base64(d)


def _typed(spark: SparkSession, folder: str, body: str, kind: str) -> DataFrame:
    d = P.spread(read(spark, folder, _C).filter("turn = 0"), "conv_id").dropDuplicates(["conv_id"])
    return d.select(F.col("conv_id").alias("doc_id"), F.lit("/d/f").alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.encode(F.expr(body), "UTF-8").alias("content"), F.lit(kind).alias("filetype"))


_FIRST = "(SELECT DISTINCT conv_id FROM conversations WHERE turn = 0)"


@query(f"SELECT conv_id AS doc_id, 'Table' AS type, '<table><tr><td>' || conv_id || '</td><td>x, y</td></tr><tr><td>z</td><td>&lt;</td></tr></table>' AS html FROM {_FIRST}")
def csv_files(spark: SparkSession, folder: str) -> DataFrame:
    f = _typed(spark, folder, "concat('a,b\\n', cast(conv_id as string), ',\"x, y\"\\nz,<\\n')", "CSV")
    return PL.partition(f).select("doc_id", "type", F.col("metadata.text_as_html").alias("html"))


@query(f"SELECT conv_id AS doc_id, unnest(['Sender', 'Recipient', 'Subject', 'MetaData']) AS type, unnest(['a' || conv_id || '@b.org', 'c@d.org', 's ' || conv_id, 'v']) AS text, unnest(['Ann Lee', '', NULL, 'X-Own']) AS name FROM {_FIRST}")
def mail_headers(spark: SparkSession, folder: str) -> DataFrame:
    f = _typed(spark, folder, "concat('From: Ann Lee <a', cast(conv_id as string), '@b.org>\\nTo: <c@d.org>\\nSubject: s ', cast(conv_id as string), '\\nX-Own: v\\n\\nbody')", "EML")
    return PL.partition(f, include_headers=True, content_source="text/plain").filter(F.col("type").isin("Sender", "Recipient", "Subject", "MetaData")).select("doc_id", "type", "text", "name")


@query(f"SELECT conv_id AS doc_id, unnest(['Title', 'Title']) AS type, unnest(['One ' || conv_id, 'Two']) AS text FROM {_FIRST}")
def json_files(spark: SparkSession, folder: str) -> DataFrame:
    f = _typed(spark, folder, "concat('[{\"type\": \"Title\", \"text\": \"One ', cast(conv_id as string), '\"}, {\"type\": \"Nothing\", \"text\": \"gone\"}, {\"type\": \"Title\", \"text\": \"Two\"}]')", "JSON")
    return PL.partition(f).select("doc_id", "type", "text")


@query(f"SELECT conv_id AS doc_id, CAST(unnest([0, 1]) AS INTEGER) AS ord, unnest(['leaf ' || conv_id, 'deep']) AS text FROM {_FIRST}")
def xml_files(spark: SparkSession, folder: str) -> DataFrame:
    f = _typed(spark, folder, "concat('<?xml version=\"1.0\"?><a><b>leaf ', cast(conv_id as string), '</b><c> <d>deep</d></c></a>')", "XML")
    return PL.partition(f).select("doc_id", "ord", "text")


@query(f"SELECT conv_id AS doc_id, unnest(['Title', 'ListItem', 'ListItem', 'NarrativeText']) AS type, unnest(['Head ' || conv_id, 'one', 'two', 'This is a sentence that says a thing.']) AS text FROM {_FIRST}")
def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    f = _typed(spark, folder, "concat('# Head ', cast(conv_id as string), '\\n\\n- one\\n- two\\n\\nThis is a sentence that says a thing.\\n')", "MD")
    return PL.partition(f).select("doc_id", "type", "text")


@query(f"SELECT conv_id AS doc_id, 200 AS status_code, 'success' AS status_message, 'Head ' || conv_id || chr(10) || chr(10) || 'This is a sentence that says a thing.' AS text FROM {_FIRST}")
def served_text(spark: SparkSession, folder: str) -> DataFrame:
    f = _typed(spark, folder, "concat('# Head ', cast(conv_id as string), '\\n\\nThis is a sentence that says a thing.\\n')", "MD")
    return PL.serve(f, "text").select("doc_id", "status_code", "status_message", "text")


@query(f"SELECT conv_id AS doc_id, CAST(unnest([1, 1, 2]) AS INTEGER) AS page, unnest(['Line one of ' || conv_id, 'Line two', 'after the break']) AS text FROM {_FIRST}")
def pdf_text(spark: SparkSession, folder: str) -> DataFrame:
    """Text set as PDF and read again from the PDF's bytes, with a page full of lines between."""
    from .sources.layout import pdf_lines

    f = _typed(spark, folder, "concat('Line one of ', cast(conv_id as string), '\\nLine two', repeat('\\n', 46), 'after the break\\n')", "TXT").select("doc_id", F.col("content").cast("string").alias("t"))

    def make(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        from .sources.pdf import text_to_pdf

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_to_pdf(t) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "content"])

    files = f.mapInArrow(make, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("content", T.BinaryType())]))
    return pdf_lines(files).select("doc_id", "page", "text")


@query("SELECT page_id AS doc_id, 'strong ' || page_id AS emphasized, 'b' AS tag, 'Some words and strong ' || page_id || ' text that says things.' AS text FROM pages")
def page_emphasis(spark: SparkSession, folder: str) -> DataFrame:
    """Emphasis of paragraphs, as it comes with the elements."""
    html = F.concat(F.lit("<html><body><div><p>Some words and <b>strong "), F.col("page_id").cast("string"), F.lit("</b> text that says things.</p></div></body></html>"))
    e = partition_html(P.spread(read(spark, folder, "pages")).select("page_id", html.alias("html")), "page_id")
    first = lambda c: F.get(F.col(f"metadata.{c}"), F.lit(0))
    return e.select("doc_id", first("emphasized_text_contents").alias("emphasized"), first("emphasized_text_tags").alias("tag"), "text")
