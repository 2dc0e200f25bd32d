"""Driver queries: the operators over the given tables, each with the same in SQL where SQL can say it.

``QUERIES`` maps a name to a function of (spark, folder); ``ORACLES`` maps it to SQL for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import classify as C
from .functions import metadata as M
from .functions import paragraphs as P
from .functions import text as X
from .operators import elements as E
from .operators import layout as L
from .operators import staging as K
from .sources import filetype as T
from .sources.html import partition_html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: DuckDB: white space as Python and (?U)\s know it, and stripping of it.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BUL = r"[\-*\x{95}\x{b7}\x{2022}\x{2023}\x{2043}\x{204c}\x{204d}\x{2219}\x{25cb}\x{25cf}\x{25d8}\x{25e6}\x{2619}\x{2765}\x{2767}\x{29be}\x{29bf}\x{3164}\x{f0b7}]"


def strip_sql(e: str) -> str:
    return rf"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scalar(name: str, table: str, key: str, f, sql: str, where: str | None = None) -> None:
    """A query of one expression over a table's texts."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        d = read(spark, folder, table)
        return d.select(*[F.col(k) for k in key.split(", ")], f(F.col("text")).alias("v"))

    run.__name__ = name
    query(f"SELECT {key}, {sql} AS v FROM {table}")(run)


_PARAS = rf"SELECT doc_id, lang, unnest(regexp_split_to_array({strip_sql('text')}, '{WS}*\n{WS}*')) AS t FROM documents"


def paragraph_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", F.posexplode(P.split_paragraphs(F.col("text"))).alias("ord", "t")).filter("t <> ''")


@query(
    rf"""WITH e AS (SELECT * FROM ({_PARAS}) WHERE t <> '')
SELECT lang, CASE WHEN regexp_matches(lower(t), '[a-z0-9.\-+_]+@[a-z0-9.\-+_]+\.[a-z]+') THEN 'HasEmail'
  WHEN NOT regexp_matches(t, '[，。、；！|,;!]') AND length(t) <= 12 THEN 'Title' ELSE 'UncategorizedText' END AS type,
  count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars, count(DISTINCT substr(sha256(t), 1, 32)) AS n_ids
FROM e GROUP BY 1, 2"""
)
def element_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs by language and kind: how many, how long, how many different ones."""
    e = paragraph_rows(read(spark, folder, "documents"))
    kind = F.when(F.lower("t").rlike(X.EMAIL), "HasEmail").when(C.is_possible_title(F.col("t"), language="zh"), "Title").otherwise("UncategorizedText")
    return e.groupBy("lang", kind.alias("type")).agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"), F.count_distinct(M.element_id(F.col("t"))).alias("n_ids"))


@query(f"SELECT doc_id, substr(sha256(t), 1, 32) AS element_id, count(*) AS n FROM ({_PARAS}) WHERE t <> '' GROUP BY 1, 2")
def paragraph_ids(spark: SparkSession, folder: str) -> DataFrame:
    e = paragraph_rows(read(spark, folder, "documents"))
    return e.groupBy("doc_id", M.element_id(F.col("t")).alias("element_id")).agg(F.count("*").alias("n"))


scalar("clean_non_ascii", "documents", "doc_id", X.clean_non_ascii_chars, r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')")
scalar("clean_bullets", "documents", "doc_id", X.clean_bullets, rf"CASE WHEN regexp_matches(text, '^{BUL}([^\-*\x{{95}}\x{{b7}}\x{{2022}}]|$)') THEN {strip_sql('substr(text, 2)')} ELSE text END")
scalar("clean_whitespace", "documents", "doc_id", X.clean_extra_whitespace, strip_sql(r"regexp_replace(regexp_replace(text, '[\x{a0}\n]', ' ', 'g'), ' {2,}', ' ', 'g')"))
scalar("clean_dashes", "documents", "doc_id", X.clean_dashes, strip_sql(r"regexp_replace(text, '[-\x{2013}]', ' ', 'g')"))
scalar("clean_trailing_punctuation", "documents", "doc_id", X.clean_trailing_punctuation, rf"regexp_replace({strip_sql('text')}, '[.,:;]+$', '')")
scalar("remove_punctuation", "documents", "doc_id", X.remove_punctuation, r"regexp_replace(text, '\pP', '', 'g')")
scalar("norm_text", "documents", "doc_id", X.norm_text, strip_sql(f"regexp_replace(text, '{WS}+', ' ', 'g')"))
scalar(
    "clean_all",
    "conversations",
    "conv_id, turn",
    lambda t: X.clean(t, extra_whitespace=True, dashes=True, trailing_punctuation=True, lowercase=True),
    strip_sql(r"regexp_replace(regexp_replace(" + strip_sql(r"regexp_replace(regexp_replace(" + strip_sql("lower(text)") + r", '[.,:;]+$', ''), '[-\x{2013}]', ' ', 'g')") + r", '[\x{a0}\n]', ' ', 'g'), ' {2,}', ' ', 'g')"),
)
scalar("clean_prefix", "conversations", "conv_id, turn", lambda t: X.clean_prefix(t, "(?:the|and|is)", ignore_case=True), rf"regexp_replace(regexp_replace(text, '(?i)^(?:(?:the|and|is))', ''), '^{WS}+', '')")
scalar("clean_postfix", "conversations", "conv_id, turn", lambda t: X.clean_postfix(t, r"(?:the|of)\."), rf"regexp_replace(regexp_replace(text, '(?:(?:the|of)\.)$', ''), '{WS}+$', '')")
scalar("text_before", "conversations", "conv_id, turn", lambda t: X.extract_text_before(t, "the"), rf"CASE WHEN position('the' IN text) > 0 THEN regexp_replace(substr(text, 1, position('the' IN text) - 1), '{WS}+$', '') END")
scalar("text_after", "conversations", "conv_id, turn", lambda t: X.extract_text_after(t, "the"), rf"CASE WHEN position('the' IN text) > 0 THEN regexp_replace(substr(text, position('the' IN text) + 3), '^{WS}+', '') END")
scalar("nth_match", "documents", "doc_id", lambda t: X.nth_match(t, "[A-Z][a-z]+", 1), "regexp_extract_all(text, '[A-Z][a-z]+')[2]")
scalar("emails", "documents", "doc_id", lambda t: F.array_join(X.extract_email_address(t), ","), r"coalesce(array_to_string(regexp_extract_all(lower(text), '[a-z0-9.\-+_]+@[a-z0-9.\-+_]+\.[a-z]+'), ','), '')")
scalar("ip_addresses", "documents", "doc_id", lambda t: F.array_join(X.extract_ip_address(t), ","), r"array_to_string(regexp_extract_all(text, '(?:[0-9]{1,2}(?:\.[0-9]{1,2}){3}|[a-z0-9]{4}:(?::[a-z0-9]{4}){4}%?[0-9]*)'), ',')")
scalar("ip_names", "documents", "doc_id", lambda t: F.array_join(X.extract_ip_address_name(t), ","), r"array_to_string(regexp_extract_all(text, '[a-zA-Z0-9-]*(?:\.[a-zA-Z]*){2}'), ',')")
scalar("mapi_ids", "documents", "doc_id", lambda t: F.array_join(X.extract_mapi_id(t), ","), r"replace(array_to_string(regexp_extract_all(text, '[0-9]*(?:\.[0-9]*){3};'), ','), ';', '')")
scalar("new_line_groups", "documents", "doc_id", P.new_line_grouper, rf"array_to_string(list_filter(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: string_split(text, chr(10))[i] || CASE WHEN i < len(string_split(text, chr(10))) THEN chr(10) ELSE '' END), lambda z: regexp_matches(z, '[^\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]')), chr(10) || chr(10))")
scalar("alpha_ratio_low", "documents", "doc_id", C.under_non_alpha_ratio, rf"coalesce(length(regexp_replace(text, '[^\pL]', '', 'g')) / CAST(nullif(length(regexp_replace(text, '{WS}', '', 'g')), 0) AS DOUBLE) < 0.5, false)")
scalar("zh_title", "conversations", "conv_id, turn", lambda t: C.is_possible_title(t, language="zh"), "length(text) > 0 AND NOT regexp_matches(text, '[，。、；！|,;!]') AND length(text) <= 12")
scalar("email_predicate", "documents", "doc_id", C.is_email_address, rf"regexp_matches({strip_sql('text')}, '^[a-z0-9.\-+_]+@[a-z0-9.\-+_]+\.[a-z]+')")
scalar("emoji_predicate", "documents", "doc_id", C.contains_emoji, r"regexp_matches(text, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23F3}]')")
scalar("image_predicate", "documents", "doc_id", C.has_embedded_image, r"regexp_matches(text, '\[image: [^\]]+\]')")
scalar("word_predicate", "benchmark", "item_id", lambda t: C.is_english_word(F.substring_index(t, " ", 1)), r"regexp_matches(split_part(text, ' ', 1), '^[A-Za-z0-9''\-]+$')")
scalar("bulleted_predicate", "documents", "doc_id", C.is_bulleted_text, rf"regexp_matches({strip_sql('text')}, '^{BUL}([^\-*\x{{95}}\x{{b7}}\x{{2022}}]|$)')")
scalar("phone_numbers", "documents", "doc_id", X.contains_us_phone_number, r"regexp_matches(text, '[0-9]{3}[-. ]*[0-9]{4}(?: *x[0-9]+)?[\t-\r ]*$')")
scalar("upper_predicate", "documents", "doc_id", C.is_upper, r"regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '\p{Ll}')")



@query(
    """WITH RECURSIVE w AS (SELECT conv_id, turn, string_split(text, ' ') AS s FROM conversations),
r AS (SELECT conv_id, turn, unnest(range(0, CAST(ceil(len(s) / 16.0) AS BIGINT))) AS k, s FROM w)
SELECT conv_id, turn, CAST(k AS INTEGER) AS chunk, array_to_string(s[k * 16 + 1 : k * 16 + 16], ' ') AS text FROM r"""
)
def token_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut to windows of 18 words with 2 kept back."""
    c = read(spark, folder, "conversations")
    return c.select("conv_id", "turn", F.posexplode(P.chunk_by_attention_window(F.col("text"), 18, 2)).alias("chunk", "text"))


_ROLES = "CASE role WHEN 'system' THEN 'Title' WHEN 'assistant' THEN 'NarrativeText' WHEN 'user' THEN 'Table' ELSE 'UncategorizedText' END"


def conversation_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as documents, turns as elements, roles as types."""
    c = read(spark, folder, "conversations")
    kind = F.when(F.col("role") == "system", "Title").when(F.col("role") == "assistant", "NarrativeText").when(F.col("role") == "user", "Table").otherwise("UncategorizedText")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), kind.alias("type"), "text", M.element_id(F.col("text")).alias("element_id"))


_ELEMENTS = f"SELECT conv_id AS doc_id, turn AS ord, {_ROLES} AS type, text, substr(sha256(text), 1, 32) AS element_id FROM conversations"


@query(
    f"""WITH e AS ({_ELEMENTS}), l AS (SELECT *, lag(type) OVER w AS b, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
p AS (SELECT doc_id, ord, CASE WHEN n = 1 THEN CASE WHEN type = 'Title' THEN text || chr(10) ELSE text END
 WHEN type = 'Title' AND b = 'Title' THEN chr(10) || text || chr(10)
 WHEN type IN ('Title', 'Table') THEN chr(10) || chr(10) || text || chr(10) ELSE chr(10) || text END AS piece FROM l)
SELECT doc_id, string_agg(piece, '' ORDER BY ord) AS text FROM p GROUP BY doc_id"""
)
def plain_text_sink(spark: SparkSession, folder: str) -> DataFrame:
    return K.plain_text(conversation_elements(spark, folder))


@query(
    f"""WITH e AS ({_ELEMENTS}), i AS (SELECT *, coalesce(sum(CASE WHEN type NOT IN ('Title', 'Table') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx FROM e)
SELECT doc_id, '' || string_agg(CASE WHEN type = 'Title' THEN '<h1>' || text || '</h1>' ELSE '<p style="' || CASE WHEN idx % 2 = 0 THEN 'background-color: #EBEBEB;' ELSE 'background-color: #ABBAEA;' END || '">' || replace(text, chr(10), '<br>') || '</p>' END, chr(10) ORDER BY ord) || '' AS html
FROM i WHERE type <> 'Table' GROUP BY doc_id"""
)
def html_sink(spark: SparkSession, folder: str) -> DataFrame:
    return K.html_page(conversation_elements(spark, folder), "", "")


@query(f"SELECT doc_id, ord, json_extract_string(j, '$.type') AS type, json_extract_string(j, '$.element_id') AS element_id, json_extract_string(j, '$.text') AS text FROM (SELECT doc_id, ord, json_object('type', type, 'element_id', element_id, 'text', text) AS j FROM ({_ELEMENTS}))")
def isd_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Elements to JSON lists and back."""
    back = K.from_isd(K.isd_documents(conversation_elements(spark, folder).withColumn("ord", F.col("ord").cast("int"))))
    w = Window.partitionBy("doc_id").orderBy("ord")
    first = conversation_elements(spark, folder).groupBy("doc_id").agg(F.min("ord").alias("o"))
    return back.withColumn("n", F.row_number().over(w) - 1).join(first, "doc_id").select("doc_id", (F.col("o") + F.col("n")).alias("ord"), "type", "element_id", "text")


@query(f"SELECT doc_id, ord, type, text, element_id, CAST(NULL AS VARCHAR) AS sender, 'f' || doc_id || '.txt' AS filename, CAST(ord AS INTEGER) AS page_number FROM ({_ELEMENTS})")
def flat_metadata(spark: SparkSession, folder: str) -> DataFrame:
    from .schema import metadata

    e = conversation_elements(spark, folder)
    e = e.withColumn("metadata", metadata(filename=F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")), page_number=F.col("ord")))
    flat = K.flat(e).withColumn("ord", F.col("ord").cast("long"))
    return flat.select("doc_id", "ord", "type", "text", "element_id", "sender", "filename", "page_number")


@query(f"SELECT doc_id, ord, 'https://x.org/d/' || element_id || '.txt' AS data, element_id AS externalId FROM ({_ELEMENTS})")
def label_box_stage(spark: SparkSession, folder: str) -> DataFrame:
    return K.label_box(conversation_elements(spark, folder), "https://x.org/d//").drop("attachments")


@query(f"SELECT doc_id, ord, text, element_id AS id, CAST(ord AS VARCHAR) AS turn FROM ({_ELEMENTS})")
def prodigy_stage(spark: SparkSession, folder: str) -> DataFrame:
    p = K.prodigy(conversation_elements(spark, folder), F.create_map(F.lit("Turn"), F.col("ord").cast("string")))
    return p.select("doc_id", "ord", "text", F.col("meta")["id"].alias("id"), F.col("meta")["turn"].alias("turn"))


@query(f"SELECT doc_id, ord, text, element_id AS ref_id FROM ({_ELEMENTS})")
def label_studio_stage(spark: SparkSession, folder: str) -> DataFrame:
    t = K.label_studio(conversation_elements(spark, folder))
    return t.select("doc_id", "ord", F.get_json_object("task", "$.data.text").alias("text"), F.get_json_object("task", "$.data.ref_id").alias("ref_id"))



@query(f"SELECT doc_id, ord, text, type AS category FROM ({_ELEMENTS})")
def weaviate_stage(spark: SparkSession, folder: str) -> DataFrame:
    return K.weaviate(conversation_elements(spark, folder)).select("doc_id", F.col("ord").cast("long").alias("ord"), "text", "category")



@query(f"SELECT doc_id, ord, text, element_id AS id FROM ({_ELEMENTS})")
def argilla_stage(spark: SparkSession, folder: str) -> DataFrame:
    return K.argilla(conversation_elements(spark, folder), "text_classification")


@query(f"SELECT type, count(*) AS n FROM ({_ELEMENTS}) WHERE type IN ('Title', 'Table') GROUP BY type")
def filter_types(spark: SparkSession, folder: str) -> DataFrame:
    return E.count_by_type(E.filter_element_types(conversation_elements(spark, folder), include=["Title", "Table"]), "type")


@query(f"SELECT doc_id, ord, text FROM ({_ELEMENTS}) WHERE type = 'NarrativeText'")
def narrative_only(spark: SparkSession, folder: str) -> DataFrame:
    return E.narrative(conversation_elements(spark, folder)).select("doc_id", "ord", "text")


@query(f"WITH e AS ({_ELEMENTS}), a AS (SELECT doc_id, min(ord) AS a FROM e WHERE type = 'Table' GROUP BY doc_id) SELECT e.doc_id, e.ord FROM e JOIN a USING (doc_id) WHERE e.ord > a.a")
def after_anchor(spark: SparkSession, folder: str) -> DataFrame:
    e = conversation_elements(spark, folder)
    return E.after_element(e, e.filter("type = 'Table'").groupBy("doc_id").agg(F.min("ord").alias("ord"))).select("doc_id", "ord")


@query(f"WITH e AS ({_ELEMENTS}), a AS (SELECT doc_id, max(ord) AS a FROM e WHERE type = 'Table' GROUP BY doc_id) SELECT e.doc_id, e.ord FROM e JOIN a USING (doc_id) WHERE e.ord < a.a")
def before_anchor(spark: SparkSession, folder: str) -> DataFrame:
    e = conversation_elements(spark, folder)
    return E.before_element(e, e.filter("type = 'Table'").groupBy("doc_id").agg(F.max("ord").alias("ord"))).select("doc_id", "ord")


@query(
    f"""WITH e AS (SELECT *, CAST(ord // 2 AS BIGINT) AS page_number FROM ({_ELEMENTS})), m AS (SELECT doc_id, max(page_number) AS m FROM e GROUP BY 1),
b AS (SELECT doc_id, page_number, max(ord) AS ord, 'PageBreak' AS type, 1 AS a FROM e JOIN m USING (doc_id) WHERE page_number < m GROUP BY doc_id, page_number),
u AS (SELECT doc_id, page_number, ord, type, 0 AS a FROM e UNION ALL SELECT * FROM b)
SELECT doc_id, page_number, type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, ord, a) - 1 AS INTEGER) AS ord FROM u"""
)
def page_breaks(spark: SparkSession, folder: str) -> DataFrame:
    e = conversation_elements(spark, folder).withColumn("page_number", F.floor(F.col("ord") / 2))
    return E.insert_page_breaks(e).select("doc_id", "page_number", "type", "ord")


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, ord) - 1 AS INTEGER) AS ord, type FROM (SELECT doc_id, ord, type, 0 AS p FROM ({_ELEMENTS}) WHERE type = 'Title' UNION ALL SELECT doc_id, ord, type, 1 FROM ({_ELEMENTS}) WHERE type <> 'Title')")
def concat_lists(spark: SparkSession, folder: str) -> DataFrame:
    e = conversation_elements(spark, folder)
    return E.concat_elements(e.filter("type = 'Title'"), e.filter("type <> 'Title'")).select("doc_id", "ord", "type")


@query(f"SELECT doc_id, ord, max(CASE WHEN type = 'Table' THEN text END) OVER (PARTITION BY doc_id, g) AS section FROM (SELECT *, count(CASE WHEN type = 'Table' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS g FROM ({_ELEMENTS}))")
def forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    e = conversation_elements(spark, folder).withColumn("mark", F.when(F.col("type") == "Table", F.col("text")))
    return E.forward_fill(e, "mark", "section").select("doc_id", "ord", "section")


@query(f"SELECT doc_id, ord, CAST(1 + coalesce(sum(CASE WHEN type = 'Table' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS page_number FROM ({_ELEMENTS})")
def page_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    return E.page_numbers(conversation_elements(spark, folder), F.col("type") == "Table").select("doc_id", "ord", "page_number")



@query(
    """WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-zA-Z]+'))) AS w FROM benchmark),
d AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS word FROM conversations)
SELECT conv_id, turn, count(*) AS n FROM d WHERE length(word) > 1 AND lower(word) IN (SELECT w FROM w) GROUP BY 1, 2"""
)
def word_list_join(spark: SparkSession, folder: str) -> DataFrame:
    cut = lambda d: F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("word")
    b = read(spark, folder, "benchmark")
    words = read(spark, folder, "conversations").select("conv_id", "turn", cut(None))
    return E.word_list_semi_join(words, b.select(cut(None))).groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


# ---- layout over boxes made from the line items ---------------------------------------------------------------------

_ITEMS = "(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS n FROM lineitem)"
_LINES = """SELECT l_orderkey AS doc_id, 1 AS page, n AS line_no, 'line ' || n AS text,
 CAST(l_partkey % 50 AS DOUBLE) AS x0, CAST(n * 10 AS DOUBLE) AS y0, CAST(l_partkey % 50 + 40 + l_suppkey % 30 AS DOUBLE) AS x1, CAST(n * 10 + 8 AS DOUBLE) AS y1 FROM """ + _ITEMS
_LAYOUT = """SELECT l_orderkey AS doc_id, 1 AS page, n AS box_id, CASE WHEN l_suppkey % 3 = 0 THEN 5 WHEN l_suppkey % 3 = 1 THEN 4 ELSE 3 END AS label,
 CAST(l_partkey % 30 AS DOUBLE) AS x0, CAST(n * 10 - l_partkey % 7 AS DOUBLE) AS y0, CAST(l_partkey % 30 + 90 AS DOUBLE) AS x1, CAST(n * 10 + 20 AS DOUBLE) AS y1 FROM """ + _ITEMS


def items(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, folder, "lineitem").withColumn("n", F.row_number().over(w))


def line_boxes(spark: SparkSession, folder: str) -> DataFrame:
    li = items(spark, folder)
    d = lambda e: F.expr(e).cast("double")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("n").alias("line_no"), F.concat(F.lit("line "), F.col("n").cast("string")).alias("text"),
        d("l_partkey % 50").alias("x0"), d("n * 10").alias("y0"), d("l_partkey % 50 + 40 + l_suppkey % 30").alias("x1"), d("n * 10 + 8").alias("y1"),
    )


def layout_boxes(spark: SparkSession, folder: str) -> DataFrame:
    li = items(spark, folder)
    d = lambda e: F.expr(e).cast("double")
    label = F.when(F.col("l_suppkey") % 3 == 0, 5).when(F.col("l_suppkey") % 3 == 1, 4).otherwise(3)
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("n").alias("box_id"), label.alias("label"),
        d("l_partkey % 30").alias("x0"), d("n * 10 - l_partkey % 7").alias("y0"), d("l_partkey % 30 + 90").alias("x1"), d("n * 10 + 20").alias("y1"),
    )


_INTER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0.0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0.0)"


@query(f"SELECT a.doc_id, a.line_no, b.box_id FROM ({_LINES}) a JOIN ({_LAYOUT}) b ON a.doc_id = b.doc_id WHERE {_INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0)) > 0.7")
def spatial_containment(spark: SparkSession, folder: str) -> DataFrame:
    return L.containment_join(line_boxes(spark, folder), layout_boxes(spark, folder)).select("doc_id", "line_no", F.col("b_box_id").alias("box_id"))


@query(f"SELECT a.doc_id, a.line_no, b.box_id FROM ({_LINES}) a JOIN ({_LAYOUT}) b ON a.doc_id = b.doc_id WHERE {_INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_INTER}) > 0.2")
def spatial_iou(spark: SparkSession, folder: str) -> DataFrame:
    return L.iou_join(line_boxes(spark, folder), layout_boxes(spark, folder)).select("doc_id", "line_no", F.col("b_box_id").alias("box_id"))


@query(
    f"""WITH m AS (SELECT a.doc_id, a.line_no, b.box_id, b.label FROM ({_LINES}) a JOIN ({_LAYOUT}) b ON a.doc_id = b.doc_id WHERE {_INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_INTER}) > 0.2),
c AS (SELECT doc_id, line_no, label, count(*) AS n, min(box_id) AS f FROM m GROUP BY 1, 2, 3),
v AS (SELECT doc_id, line_no, max_by(label, n * 1000 - f) AS common, max(CASE WHEN label = 4 THEN 1 ELSE 0 END) AS t, count(*) AS k FROM c GROUP BY 1, 2)
SELECT a.doc_id, a.line_no, CAST(coalesce(CASE WHEN t = 1 AND k > 1 THEN 4 ELSE common END, 999) AS INTEGER) AS layout_type FROM ({_LINES}) a LEFT JOIN v ON a.doc_id = v.doc_id AND a.line_no = v.line_no"""
)
def block_labels(spark: SparkSession, folder: str) -> DataFrame:
    return L.block_labels(line_boxes(spark, folder), layout_boxes(spark, folder), "line_no").select("doc_id", "line_no", "layout_type")


@query(f"SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({_LINES}) GROUP BY 1, 2")
def bounding_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return L.bounding_box(line_boxes(spark, folder), "doc_id", "page")


@query(
    f"""WITH v AS (SELECT DISTINCT doc_id, line_no FROM ({_LINES}) WHERE x0 < 35), i AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM v),
r AS (SELECT doc_id, g, min(line_no) AS s, count(*) AS n FROM i GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) AS q FROM r)
SELECT doc_id, s AS start, n FROM k WHERE q = 1"""
)
def longest_runs(spark: SparkSession, folder: str) -> DataFrame:
    return L.longest_run(line_boxes(spark, folder).filter("x0 < 35"), "line_no", "doc_id")


@query(
    f"""WITH o AS (SELECT doc_id, x0, x1, max(x1) OVER (PARTITION BY doc_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, line_no FROM ({_LINES})),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR x0 >= m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT doc_id, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY doc_id, k"""
)
def merged_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return L.merge_intervals(line_boxes(spark, folder), "x0", "x1", "doc_id")


@query(f"SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, line_no) - 1 AS INTEGER) AS ord FROM ({_LINES})")
def page_sort(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_boxes(spark, folder).withColumnRenamed("page", "page_number").withColumn("element_id", F.col("line_no"))
    return L.sort_page_elements(rows).select("doc_id", "line_no", "ord")


@query(f"SELECT doc_id, line_no, x1 - x0 >= 60 AND y1 - y0 >= 8 AS v FROM ({_LINES})")
def valid_boxes(spark: SparkSession, folder: str) -> DataFrame:
    b = line_boxes(spark, folder)
    return b.select("doc_id", "line_no", C.is_valid_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 8, 60).alias("v"))



@query(f"SELECT doc_id, line_no, text FROM ({_LINES}) a WHERE NOT EXISTS (SELECT 1 FROM ({_LAYOUT}) b WHERE b.doc_id = a.doc_id AND b.box_id = a.line_no AND b.label = 5)")
def masked_rows(spark: SparkSession, folder: str) -> DataFrame:
    masks = layout_boxes(spark, folder).filter("label = 5").select("doc_id", F.col("box_id").alias("line_no"))
    return E.exclude_rows(line_boxes(spark, folder), masks, "doc_id", "line_no").select("doc_id", "line_no", "text")





# ---- files and pages ------------------------------------------------------------------------------------------------




@query(rf"""SELECT page_id, {strip_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages""")
def page_titles(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "pages").select("page_id", X.norm_text(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query()
def html_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements of all pages; the parser has no SQL form."""
    return partition_html(P.spread(read(spark, folder, "pages")), "page_id").select("doc_id", "ord", "page_number", "element_id", "type", "text")


@query()
def text_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Typed, packed paragraphs of all documents; sentences and verbs have no SQL form."""
    return P.partition_text(read(spark, folder, "documents"))


@query()
def regex_metadata(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents").select("doc_id", M.regex_metadata(F.col("text"), {"number": r"[0-9]+", "upper": r"\b[A-Z]{3,}\b"}).alias("m"))
    return d.select("doc_id", F.explode("m").alias("name", "found")).select("doc_id", "name", F.posexplode("found").alias("nth", "f")).select("doc_id", "name", "nth", "f.*")


@query(r"SELECT doc_id, count(*) AS n, string_agg(m, ' ' ORDER BY i) AS texts FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS m, generate_subscripts(regexp_extract_all(text, '[0-9]+'), 1) AS i FROM documents) GROUP BY doc_id")
def regex_matches(spark: SparkSession, folder: str) -> DataFrame:
    found = M.regex_metadata(F.col("text"), {"n": "[0-9]+"})["n"]
    d = read(spark, folder, "documents").select("doc_id", found.alias("f")).filter("f is not null")
    return d.select("doc_id", F.size("f").cast("long").alias("n"), F.array_join(F.transform("f", lambda x: x["text"]), " ").alias("texts"))



@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL")
def key_union(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").select(F.from_json("props", "map<string,string>").alias("m"))
    return E.key_union(e, "m")


@query("SELECT doc_id, regexp_extract('/data/' || lang || '/' || doc_id || '.txt', '([^/]*)$', 1) AS filename, '/data/' || lang AS file_directory FROM documents")
def file_names(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, folder, "documents").select("doc_id", M.file_name(path).alias("filename"), M.file_directory(path).alias("file_directory"))



@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS last_modified FROM events")
def last_modified(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select("event_id", M.last_modified(F.col("ts")).alias("last_modified"))


@query("SELECT event_id, ts AS parsed FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def exif_dates(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").select("event_id", F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("s"))
    return e.select("event_id", M.exif_datetime(F.col("s")).alias("parsed"))


@query(r"SELECT doc_id, source, replace(regexp_replace(replace(lower('ISO-8859-8-' || CASE WHEN doc_id % 2 = 0 THEN 'I' ELSE 'E' END), '_', '-'), '^(iso-8859-[68])-[ie]$', '\1'), '-', '_') AS enc FROM documents")
def encoding_names(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents")
    return d.select("doc_id", "source", X.normalize_encoding(F.concat(F.lit("ISO-8859-8-"), F.when(F.col("doc_id") % 2 == 0, "I").otherwise("E"))).alias("enc"))


@query("SELECT doc_id, CASE WHEN n > 200 OR n / CAST(nullif(length(text), 0) AS DOUBLE) > 0.5 THEN 'zh' ELSE 'eng' END AS lang, length(text) < 200 AS is_scan FROM (SELECT doc_id, text, length(regexp_replace(text, '[^一-龥]', '', 'g')) AS n FROM documents)")
def page_languages(spark: SparkSession, folder: str) -> DataFrame:
    return L.page_language(read(spark, folder, "documents").drop("lang")).select("doc_id", "lang", "is_scan")


@query("SELECT conv_id, turn, text FROM conversations WHERE turn >= 2 AND turn < 4")
def page_slices(spark: SparkSession, folder: str) -> DataFrame:
    c = read(spark, folder, "conversations").withColumn("page_number", F.col("turn") + 1)
    return E.page_slice(c, 2, 2).select("conv_id", "turn", "text")


from . import operator_queries  # noqa: E402, F401  (adds its queries to the tables above)
