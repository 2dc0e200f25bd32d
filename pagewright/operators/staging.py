"""Staging: element rows to the formats of sinks, as Columns and aggregates; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import flat_columns
from ..functions.paragraphs import chunk_by_attention_window
from ..schema import ELEMENT_FIELDS, METADATA_FIELDS, TYPE_OF_NAME, canonical_type

IGNORE_NULLS = {"ignoreNullFields": "true"}


def with_all_fields(elements: DataFrame) -> DataFrame:
    """Element rows with every field of the schema; missing ones are null."""
    return elements.select(*[(F.col(k) if k in elements.columns else F.lit(None)).cast(v).alias(k) for k, v in ELEMENT_FIELDS.items()])


def isd(elements: DataFrame) -> DataFrame:
    """doc_id, ord and the element as JSON: type, element_id, text or checked, metadata without nulls."""
    e = with_all_fields(elements)
    meta = F.col("metadata")
    keep = F.struct(*[(F.when(F.size(meta[k]) > 0, meta[k]) if k == "regex_metadata" else meta[k]).alias(k) for k in METADATA_FIELDS])
    text = F.when(F.col("type") == "CheckBox", F.to_json(F.struct("type", "element_id", "checked", keep.alias("metadata")), IGNORE_NULLS)).otherwise(F.to_json(F.struct("type", "element_id", keep.alias("metadata"), "text"), IGNORE_NULLS))
    return e.select("doc_id", "ord", text.alias("isd"))


def isd_documents(elements: DataFrame) -> DataFrame:
    """One JSON list a document."""
    rows = isd(elements).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "isd"))).alias("e"))
    return rows.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["isd"]), ","), F.lit("]")).alias("isd"))


def write_isd(elements: DataFrame, path: str) -> None:
    """JSON lines, a file for each partition."""
    isd(elements).select(F.col("isd").alias("value")).write.text(path)


def from_isd(docs: DataFrame, id_col: str = "doc_id", json_col: str = "isd") -> DataFrame:
    """Element rows of JSON lists; rows of unknown types go, text that isn't a list gives none."""
    schema = "array<struct<type:string,element_id:string,text:string,checked:boolean,metadata:" + "struct<" + ",".join(f"{k}:{v}" for k, v in METADATA_FIELDS.items()) + ">>>"
    good = F.when(F.col(json_col).rlike(r"\A\s*\[\s*\{?"), F.from_json(json_col, schema))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(good).alias("ord", "e")).select("doc_id", "ord", "e.*")
    return rows.withColumn("type", canonical_type(F.col("type"))).filter("type is not null")


def flat(elements: DataFrame) -> DataFrame:
    """Elements with their metadata in flat columns, nested names joined by ``_``; ``sender`` is the first of sent_from."""
    e = with_all_fields(elements)
    meta = flat_columns(e.schema["metadata"].dataType, "metadata", cut="metadata_")
    return e.select("doc_id", "ord", "type", "text", "element_id", F.get("metadata.sent_from", F.lit(0)).alias("sender"), *meta)


def csv_columns(elements: DataFrame, regex_names: list[str] | None = None) -> DataFrame:
    """``flat`` with texts only, as CSV can hold: lists and maps as JSON, and a column for each regex name (found in one
    pass if not given)."""
    f = flat(elements)
    if regex_names is None:
        regex_names = [r[0] for r in f.select(F.explode(F.map_keys("regex_metadata"))).distinct().orderBy(1).collect()]
    out = []
    for field in f.schema.fields:
        if field.name == "regex_metadata":
            continue
        simple = field.dataType.typeName() in ("string", "long", "integer", "double", "boolean")
        out.append(F.col(field.name) if simple else F.to_json(field.name).alias(field.name))
    return f.select(*out, *[F.to_json(F.col("regex_metadata")[n]).alias(f"regex_metadata_{n}") for n in regex_names])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row: one pass of counts."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if not counts[c]])


def _in_order(piece: Column, key: str = "doc_id") -> list:
    return [key, F.struct("ord", piece.alias("piece")).alias("p")]


def plain_text(elements: DataFrame) -> DataFrame:
    """One text a document. What comes before and after an element follows from its type and the one before."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = F.lag("type").over(w)
    first = F.row_number().over(w) == 1
    t = F.coalesce(F.col("text"), F.lit(""))
    piece = (
        F.when(first, F.when(F.col("type") == "Title", F.concat(t, F.lit("\n"))).otherwise(t))
        .when((F.col("type") == "Title") & (before == "Title"), F.concat(F.lit("\n"), t, F.lit("\n")))
        .when(F.col("type").isin("Title", "Table"), F.concat(F.lit("\n\n"), t, F.lit("\n")))
        .otherwise(F.concat(F.lit("\n"), t))
    )
    return _joined(elements.select(*_in_order(piece)), "")


def _joined(rows: DataFrame, separator: str, out: str = "text") -> DataFrame:
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["piece"]), separator).alias(out))


STYLES = ("background-color: #EBEBEB;", "background-color: #ABBAEA;")
HTML_HEAD = "<html><head><style>table{border-collapse:collapse;width:100%}td,th{border:1px solid #ddd;padding:8px;text-align:left}</style></head><body>\n"
HTML_TAIL = "</body></html>"


def html_page(elements: DataFrame, head: str = HTML_HEAD, tail: str = HTML_TAIL) -> DataFrame:
    """One page a document: titles as headings, tables as they are, the rest as paragraphs of alternating colour."""
    other = ~F.col("type").isin("Title", "Table")
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    idx = F.coalesce(F.sum(other.cast("int")).over(w), F.lit(0))
    table = F.col("metadata")["text_as_html"] if "metadata" in elements.columns else F.col("text_as_html") if "text_as_html" in elements.columns else F.lit(None).cast("string")
    style = F.when(idx % 2 == 0, STYLES[0]).otherwise(STYLES[1])
    piece = (
        F.when(F.col("type") == "Title", F.concat(F.lit("<h1>"), "text", F.lit("</h1>")))
        .when(F.col("type") == "Table", F.replace(table, F.lit("\n"), F.lit(" ")))
        .otherwise(F.concat(F.lit('<p style="'), style, F.lit('">'), F.replace("text", F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    )
    rows = elements.select(*_in_order(piece)).filter("p.piece <> ''")
    return _joined(rows, "\n", "html").select("doc_id", F.concat(F.lit(head), "html", F.lit(tail)).alias("html"))


def argilla(elements: DataFrame, task: str, tokens: Column | None = None, **columns: Column) -> DataFrame:
    """Records for labelling: text and id, tokens for token classification, further columns as given."""
    if task not in ("text_classification", "token_classification", "text2text"):
        raise ValueError(f"no such task: {task}")
    from ..functions.classify import words

    more = [F.coalesce(tokens, words(F.col("text"))).alias("tokens") if tokens is not None else words(F.col("text")).alias("tokens")] if task == "token_classification" else []
    return elements.select("doc_id", "ord", "text", F.col("element_id").alias("id"), *more, *[c.alias(k) for k, c in columns.items()])


def baseplate(elements: DataFrame) -> DataFrame:
    """One JSON object a document: rows of data (type, element_id, text) and flat metadata without nulls."""
    f = flat(elements)
    data = ("type", "element_id", "text")
    meta = [c for c in f.columns if c not in ("doc_id", "ord", "sender", *data)]
    row = F.struct("ord", F.struct(*data).alias("data"), F.struct(*meta).alias("metadata"))
    rows = f.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord"), F.to_json(F.struct(row["data"].alias("data"), row["metadata"].alias("metadata")), IGNORE_NULLS).alias("j")))).alias("r"))
    return rows.select("doc_id", F.concat(F.lit('{"rows":['), F.array_join(F.transform("r", lambda x: x["j"]), ","), F.lit("]}")).alias("rows"))


def datasaur(elements: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """text and its entities: array of (text, type, start_idx, end_idx), from rows (doc_id, ord, text, type, start_idx, end_idx)."""
    kind = "array<struct<text:string,type:string,start_idx:int,end_idx:int>>"
    if entities is None:
        return elements.select("doc_id", "ord", "text", F.array().cast(kind).alias("entities"))
    missing = {"text", "type", "start_idx", "end_idx"} - set(entities.columns)
    if missing:
        raise ValueError(f"entities lack {sorted(missing)}")
    e = entities.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct(F.col("start_idx").cast("int").alias("start_idx"), F.col("end_idx").cast("int").alias("end_idx"), F.col("text").alias("t"), F.col("type").alias("k")))).alias("_e"))
    j = elements.select("doc_id", "ord", "text").join(e, ["doc_id", "ord"], "left")
    return j.select("doc_id", "ord", "text", F.coalesce(F.transform("_e", lambda x: F.struct(x["t"].alias("text"), x["k"].alias("type"), x["start_idx"].alias("start_idx"), x["end_idx"].alias("end_idx"))), F.array().cast(kind)).alias("entities"))


def label_box(elements: DataFrame, url_prefix: str, external_ids: Column | None = None, attachments: Column | None = None) -> DataFrame:
    """data (where the text's file will be), externalId and attachments (array of (type, value), types in capitals)."""
    ident = external_ids if external_ids is not None else F.col("element_id")
    a = attachments if attachments is not None else F.array().cast("array<struct<type:string,value:string>>")
    good = F.forall(a, lambda x: F.upper(x["type"]).isin("IMAGE", "VIDEO", "RAW_TEXT", "HTML", "TEXT_URL"))
    checked = F.when(good, F.transform(a, lambda x: F.struct(F.upper(x["type"]).alias("type"), x["value"].alias("value")))).otherwise(F.raise_error(F.lit("no such type of attachment")).cast("array<struct<type:string,value:string>>"))
    return elements.select("doc_id", "ord", F.concat(F.lit(url_prefix.rstrip("/") + "/"), ident, F.lit(".txt")).alias("data"), checked.alias("attachments"), ident.alias("externalId"))


def write_texts(elements: DataFrame, folder: str) -> None:
    """A file ``<element_id>.txt`` for each element, in a folder that all executors share. Ids stand for texts, so a
    task that runs twice writes the same again."""

    def write(rows) -> None:  # noqa: ANN001
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, f"{r.element_id}.txt"), "w", encoding="utf-8") as f:
                f.write(r.text or "")

    elements.select("element_id", "text").dropDuplicates(["element_id"]).foreachPartition(write)


LABEL_STUDIO_TYPES = (
    "brush brushlabels choices datetime ellipse ellipselabels hypertextlabels keypoint keypointlabels labels number paragraphlabels polygon polygonlabels ranker rating rectangle rectanglelabels taxonomy textarea timeserieslabels"
).split()


def label_studio(elements: DataFrame, annotations: DataFrame | None = None, predictions: DataFrame | None = None, text_field: str = "text", id_field: str = "ref_id") -> DataFrame:
    """Tasks as JSON: data, and annotations and predictions from rows (doc_id, ord, result: array<struct<type,...>>, and
    score for predictions). Types of results and scores are checked."""
    out = elements.select("doc_id", "ord", F.struct(F.col("text").alias(text_field), F.col("element_id").alias(id_field)).alias("data"))
    for name, rows in (("annotations", annotations), ("predictions", predictions)):
        if rows is None:
            continue
        good = F.forall("result", lambda r: r["type"].isin(LABEL_STUDIO_TYPES))
        fields = ["result"] + (["score"] if name == "predictions" else [])
        if name == "predictions":
            good = good & F.col("score").between(0, 1)
        fine = rows.filter(F.when(good, True).otherwise(F.raise_error(F.lit("a result's type or score isn't allowed")).cast("boolean")))
        out = out.join(fine.groupBy("doc_id", "ord").agg(F.collect_list(F.struct(*fields)).alias(name)), ["doc_id", "ord"], "left")
    return out.select("doc_id", "ord", F.to_json(F.struct(*[c for c in out.columns if c not in ("doc_id", "ord")]), IGNORE_NULLS).alias("task"))


def prodigy(elements: DataFrame, metadata: Column | None = None) -> DataFrame:
    """text and meta (map of strings, keys in lower case, with the element's id under ``id``, which is its own alone)."""
    own = F.create_map(F.lit("id"), F.col("element_id"))
    if metadata is None:
        return elements.select("doc_id", "ord", "text", own.alias("meta"))
    low = F.transform_keys(metadata, lambda k, _: F.lower(k))
    checked = F.when(~F.map_contains_key(low, "id"), low).otherwise(F.raise_error(F.lit("the key id is taken")).cast("map<string,string>"))
    return elements.select("doc_id", "ord", "text", F.map_concat(own, checked).alias("meta"))


def prodigy_csv(staged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """text and a column for each metadata key; the keys are found in one pass if they aren't given."""
    if keys is None:
        keys = [r[0] for r in staged.select(F.explode(F.map_keys("meta"))).distinct().orderBy(1).collect()]
    return staged.select("text", *[F.col("meta")[k].alias(k) for k in keys])


WEAVIATE_EXCLUDED = ("coordinates", "data_source", "regex_metadata", "emphasized_text_contents", "emphasized_text_tags")


def weaviate(elements: DataFrame) -> DataFrame:
    """Objects for a vector store: all metadata but nested ones, text and category."""
    e = with_all_fields(elements)
    return e.select("doc_id", "ord", *[F.col("metadata")[k].alias(k) for k in METADATA_FIELDS if k not in WEAVIATE_EXCLUDED], "text", F.col("type").alias("category"))


def weaviate_class(name: str = "Element") -> dict:
    """The class that holds such objects."""
    kinds = {"string": "text", "int": "int", "array<string>": "text[]"}
    properties = [{"name": k, "dataType": [kinds[v]]} for k, v in METADATA_FIELDS.items() if k not in WEAVIATE_EXCLUDED]
    return {"class": name, "properties": [*properties, {"name": "text", "dataType": ["text"]}, {"name": "category", "dataType": ["text"]}]}


def transformers_chunks(elements: DataFrame, max_input_size: int, buffer: int = 2, separator: str = " ") -> DataFrame:
    """Elements cut to chunks that fit a window; ``chunk`` numbers them."""
    return elements.select(*[c for c in elements.columns if c != "text"], F.posexplode(chunk_by_attention_window(F.col("text"), max_input_size, buffer, separator)).alias("chunk", "text"))


def known_types() -> list[str]:
    return sorted(set(TYPE_OF_NAME.values()))
