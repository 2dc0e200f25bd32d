"""Relational operators over element rows. Order is the ``ord`` column, never the order of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Ids or words are broadcast up to so many rows.
BROADCAST_ROWS = 200_000


def apply_cleaners(elements: DataFrame, *cleaners) -> DataFrame:
    """Column functions, one after the other, on the text."""
    return elements.withColumn("text", reduce(lambda c, f: f(c), cleaners, F.col("text")))


def filter_element_types(elements: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    if (include is None) == (exclude is None):
        raise ValueError("give either include or exclude")
    return elements.filter(F.col("type").isin(include) if include is not None else ~F.col("type").isin(exclude))


def narrative(elements: DataFrame) -> DataFrame:
    return elements.filter(F.col("type") == "NarrativeText")


def flatten_pages(pages: DataFrame) -> DataFrame:
    """Rows of (doc_id, page_number, elements: array of structs) as element rows in reading order."""
    rows = pages.select("doc_id", "page_number", F.posexplode("elements").alias("pos", "e")).select("doc_id", "page_number", "pos", "e.*")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "pos")) - 1).drop("pos")


def to_pages(elements: DataFrame) -> DataFrame:
    """Element rows grouped to pages, elements in order."""
    rest = [c for c in elements.columns if c not in ("doc_id", "page_number")]
    rows = F.collect_list(F.struct("ord", *[c for c in rest if c != "ord"]))
    return elements.groupBy("doc_id", "page_number").agg(F.array_sort(rows, lambda a, b: a["ord"] - b["ord"]).alias("elements"))


def after_element(elements: DataFrame, anchors: DataFrame) -> DataFrame:
    """Elements strictly after their document's anchor (doc_id, ord)."""
    return elements.join(anchors.select("doc_id", F.col("ord").alias("_anchor")), "doc_id").filter(F.col("ord") > F.col("_anchor")).drop("_anchor")


def before_element(elements: DataFrame, anchors: DataFrame) -> DataFrame:
    """Elements strictly before their document's anchor (doc_id, ord)."""
    return elements.join(anchors.select("doc_id", F.col("ord").alias("_anchor")), "doc_id").filter(F.col("ord") < F.col("_anchor")).drop("_anchor")


def drop_boilerplate(elements: DataFrame, skip_headers_and_footers: bool = False, skip_table_text: bool = False) -> DataFrame:
    """Without elements inside tables, headers or footers (by ``ancestortags``); the first element in a footer ends its
    page. Pages that are left are numbered anew."""
    tags = F.coalesce(F.col("ancestortags"), F.array().cast("array<string>"))
    inside = lambda *names: F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))
    out = elements
    if skip_table_text:
        out = out.filter(~inside("table"))
    if skip_headers_and_footers:
        page = Window.partitionBy("doc_id", "page_number").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("_over", F.max(inside("footer").cast("int")).over(page)).filter((F.col("_over") == 0) & ~inside("header")).drop("_over")
    return out.withColumn("page_number", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page_number")))


def insert_page_breaks(elements: DataFrame, after_last: bool = False) -> DataFrame:
    """With a PageBreak row after each page but the last (or after the last as well); ``ord`` is numbered anew."""
    last = F.max("page_number").over(Window.partitionBy("doc_id"))
    pages = elements.groupBy("doc_id", "page_number").agg(F.max("ord").alias("ord")).withColumn("_last", last)
    if not after_last:
        pages = pages.filter("page_number < _last")
    breaks = pages.select("doc_id", "page_number", "ord", F.lit("PageBreak").alias("type"), F.lit("").alias("text"), F.lit(1).alias("_after"))
    both = elements.withColumn("_after", F.lit(0)).unionByName(breaks, allowMissingColumns=True)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "ord", "_after")) - 1).drop("_after")


def concat_elements(*parts: DataFrame) -> DataFrame:
    """Element lists one after the other, by document; ``ord`` is numbered anew."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("_part", "ord")) - 1).drop("_part")


def exclude_rows(rows: DataFrame, masked: DataFrame, *keys: str) -> DataFrame:
    return rows.join(masked.select(*keys).distinct(), list(keys), "left_anti")


def positional_join(left: DataFrame, right: DataFrame, key: str = "doc_id", pos: str = "ord") -> DataFrame:
    """Rows of the same document and position; an error where one side has a position that the other lacks."""
    r = right.withColumn("_right", F.lit(True))
    both = left.withColumn("_left", F.lit(True)).join(r, [key, pos], "full")
    ok = F.col("_left") & F.col("_right")
    return both.withColumn("_ok", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("the lists have different lengths")).cast("boolean"))).filter("_ok").drop("_ok", "_left", "_right")


def toc_join(items: DataFrame, toc: DataFrame) -> DataFrame:
    """Items (doc_id, ord, href) with the title of the last entry in the contents that has their href; an item without
    one goes on with the title before it."""
    last = toc.groupBy("doc_id", "href").agg(F.max_by("title", "toc_ord").alias("_title"))
    return forward_fill(items.join(last, ["doc_id", "href"], "left"), "_title", "section").drop("_title")


def forward_fill(rows: DataFrame, column: str, out: str | None = None) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out or column, F.last(column, ignorenulls=True).over(w))


def page_numbers(rows: DataFrame, is_break: Column) -> DataFrame:
    """A running page number, from 1, that each break raises for the rows after it."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("page_number", 1 + F.coalesce(F.sum(is_break.cast("int")).over(w), F.lit(0)).cast("int"))


def section_numbers(rows: DataFrame, is_section: Column) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("section_number", F.coalesce(F.sum(is_section.cast("int")).over(w), F.lit(0)).cast("int"))


def running_index(rows: DataFrame, counts: Column, out: str = "idx") -> DataFrame:
    """How many rows before this one count."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(counts.cast("int")).over(w), F.lit(0)).cast("int"))


def word_list_semi_join(words: DataFrame, vocabulary: DataFrame, column: str = "word") -> DataFrame:
    """Rows whose lower-cased word is in the list. The list is broadcast when it is small, else both sides shuffle."""
    listed = vocabulary.select(F.lower(column).alias("_word")).distinct()
    small = listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return words.join(F.broadcast(listed) if small else listed, (F.lower(words[column]) == F.col("_word")) & (F.length(words[column]) > 1), "left_semi")


def count_by_type(files: DataFrame, column: str = "filetype") -> DataFrame:
    return files.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def key_union(rows: DataFrame, maps: str) -> DataFrame:
    """The distinct keys of a map column."""
    return rows.select(F.explode(F.map_keys(maps)).alias("key")).distinct()


def page_slice(rows: DataFrame, start: int = 0, n: int | None = None) -> DataFrame:
    """Rows of ``n`` pages from page ``start`` (from 0) on; page_number is from 1."""
    out = rows.filter(F.col("page_number") > start)
    return out if n is None else out.filter(F.col("page_number") <= start + n)


def embedded_images(elements: DataFrame) -> DataFrame:
    """With an Image row after each element that holds ``[image: ...]``, for the first such; ``ord`` is numbered anew."""
    from ..functions.classify import embedded_image

    mark = embedded_image(F.col("text"))
    rows = elements.withColumn("_image", mark)
    plain = rows.withColumn("text", F.when(F.col("_image").isNotNull(), X.strip(F.regexp_replace("text", r"\[image: [^\]]+\]", ""))).otherwise(F.col("text"))).withColumn("_after", F.lit(0))
    images = rows.filter("_image is not null").withColumn("text", F.col("_image")).withColumn("type", F.lit("Image")).withColumn("_after", F.lit(1))
    both = plain.unionByName(images).drop("_image")
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "_after")) - 1).drop("_after")


def list_items(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with a whole list as their text, exploded to its items: by enumeration (``1.``, ``2.`` ...) if there is any,
    else by bullets."""
    numbered = F.col(text).rlike(r"(?m)^\s*\d{1,3}\.\s")
    parts = F.when(numbered, F.split(text, r"(?m)(?:^|\n)\s*\d{1,3}\.\s+")).otherwise(F.split(text, rf"(?:^|\n)\s*{X.BULLET}\s*|{X.BULLET}"))
    return rows.select("*", F.posexplode(F.filter(F.transform(parts, X.strip), lambda z: z != "")).alias("item", "_part")).withColumn(text, F.col("_part")).withColumn("type", F.lit("ListItem")).drop("_part")


def normalize_layout(rows: DataFrame) -> DataFrame:
    """Layout rows (doc_id, ord, type, text) as elements: names of types mapped, check marks as CheckBox with their
    state, lists as their items."""
    from ..schema import canonical_type

    lists = list_items(rows.filter("type = 'List'"))
    rest = rows.filter("type <> 'List' or type is null").withColumn("item", F.lit(0))
    out = rest.withColumn("checked", F.when(F.col("type") == "Checked", True).when(F.col("type") == "Unchecked", False)).withColumn("type", F.coalesce(canonical_type(F.col("type")), F.lit("UncategorizedText")))
    both = out.unionByName(lists, allowMissingColumns=True)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "item")) - 1).drop("item")
