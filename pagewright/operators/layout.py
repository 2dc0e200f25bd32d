"""Layout algebra: text lines and layout boxes of pages as rows, joined in space and stitched over pages.

Keys are (doc_id, page); all equi-joins are on them, so one shuffle on the document serves a whole chain. Rules that
are greedy by nature run a page at a time in ``applyInPandas``; everything else is joins, windows and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEAL, IMAGE, TITLE, TEXT, TABLE, HEADER, PAGE_NUMBER, FOOTER = range(1, 9)
UNLABELLED, FORMULA = 999, 1000
KEPT = (TITLE, TEXT, TABLE, UNLABELLED, FORMULA)
CONTAIN, IOU = 0.70, 0.2
PAGE = ("doc_id", "page")
BOX = ("x0", "y0", "x1", "y1")


def area(p: str = "") -> Column:
    return (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))


def intersection(a: str = "", b: str = "b_") -> Column:
    w = F.least(a + "x1", b + "x1") - F.greatest(a + "x0", b + "x0")
    h = F.least(a + "y1", b + "y1") - F.greatest(a + "y0", b + "y0")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _boxes(df: DataFrame, prefix: str = "b_") -> DataFrame:
    return df.select(*PAGE, *[F.col(c).alias(prefix + c) for c in df.columns if c not in PAGE])


def _meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of a page whose boxes overlap; b's columns start with ``b_``."""
    touch = (F.col("x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("x1")) & (F.col("y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("y1"))
    return a.join(_boxes(b), list(PAGE)).filter(touch)


def containment_join(lines: DataFrame, layout: DataFrame, threshold: float = CONTAIN) -> DataFrame:
    """Lines with the layout boxes that hold more than ``threshold`` of their area, and the share."""
    share = intersection() / F.nullif(area(), F.lit(0.0))
    return _meeting(lines, layout).withColumn("share", share).filter(F.col("share") > threshold)


def iou_join(blocks: DataFrame, layout: DataFrame, threshold: float = IOU) -> DataFrame:
    """Blocks with the layout boxes of a higher intersection over union."""
    iou = intersection() / F.nullif(area() + area("b_") - intersection(), F.lit(0.0))
    return _meeting(blocks, layout).withColumn("iou", iou).filter(F.col("iou") > threshold)


def block_labels(blocks: DataFrame, layout: DataFrame, key: str = "block_no") -> DataFrame:
    """Each block's label: the commonest among the boxes that it meets, the first of equals; a paragraph wins wherever it
    is among several labels; ``UNLABELLED`` where it meets none."""
    met = iou_join(blocks, layout)
    counts = met.groupBy(*PAGE, key, "b_label").agg(F.count("*").alias("n"), F.min("b_box_id").alias("first"))
    vote = counts.groupBy(*PAGE, key).agg(
        F.max_by("b_label", F.struct("n", -F.col("first"))).alias("common"), F.max((F.col("b_label") == TEXT).cast("int")).alias("has_text"), F.count("*").alias("labels")
    )
    label = F.when((F.col("has_text") == 1) & (F.col("labels") > 1), TEXT).otherwise(F.col("common"))
    return blocks.join(vote.select(*PAGE, key, label.alias("layout_type")), [*PAGE, key], "left").withColumn("layout_type", F.coalesce("layout_type", F.lit(UNLABELLED)))


def merge_table_detector(layout: DataFrame, detected: DataFrame) -> DataFrame:
    """Layout boxes without the generic tables, and the table detector's boxes."""
    return layout.filter(F.col("label") != TABLE).unionByName(detected.withColumn("label", F.lit(TABLE)), allowMissingColumns=True)


def formula_lines(lines: DataFrame, formulas: DataFrame, threshold: float = CONTAIN) -> DataFrame:
    """Lines with isolated formulas put in: the first line that a formula covers becomes the formula, the others that it
    covers go. A formula that covers no line changes nothing."""
    met = _meeting(lines, formulas.filter("type = 'isolated'"))
    covered = met.filter(intersection() / F.nullif(area(), F.lit(0.0)) > threshold)
    first = covered.groupBy(*PAGE, "b_box_id").agg(F.min("line_no").alias("line_no"), F.first("b_text").alias("formula"), *[F.first(f"b_{c}").alias(f"f_{c}") for c in BOX])
    masked = covered.select(*PAGE, "line_no").distinct()
    taken = first.groupBy(*PAGE, "line_no").agg(F.min_by(F.struct("formula", *[f"f_{c}" for c in BOX]), "b_box_id").alias("f"))
    new = lines.join(taken, [*PAGE, "line_no"]).select(*[F.col("f.formula").alias("text") if c == "text" else F.col(f"f.f_{c}").alias(c) if c in BOX else F.lit(FORMULA).alias(c) if c == "block_type" else F.col(c) for c in lines.columns])
    return lines.join(masked, [*PAGE, "line_no"], "left_anti").unionByName(new)


def split_line(lines: DataFrame, embedded: DataFrame) -> DataFrame:
    """Parts of lines (doc_id, page, line_no, x0, x1) that are left between the embedded boxes on them."""
    on = _meeting(lines, embedded)
    w = Window.partitionBy(*PAGE, "line_no").orderBy("b_x0", "b_x1")
    seen = F.max("b_x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = on.select(*PAGE, "line_no", F.coalesce(seen, F.col("x0")).alias("g0"), F.col("b_x0").alias("g1"))
    tail = on.groupBy(*PAGE, "line_no").agg(F.max("b_x1").alias("g0"), F.first("x1").alias("g1"))
    return gaps.unionByName(tail).filter("g0 < g1").select(*PAGE, "line_no", F.col("g0").alias("x0"), F.col("g1").alias("x1"))


def bounding_box(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def polygon_box(points: Column) -> Column:
    """The upright box around an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def box_polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))


def longest_run(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The longest run of consecutive whole numbers of each group, the first of equals: start and n."""
    distinct = rows.select(*keys, value).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    runs = distinct.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(value).alias("start"), F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.max_by(F.struct("start", "n"), F.struct(F.col("n"), -F.col("start"))).alias("r")).select(*keys, "r.start", "r.n")


def merge_intervals(rows: DataFrame, lo: str, hi: str, *keys: str) -> DataFrame:
    """The union of intervals that overlap (touching ends don't)."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    seen = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(seen.isNull() | (F.col(lo) >= seen), 1).otherwise(0)
    rows = rows.select(*keys, lo, hi).withColumn("_new", new)
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "_g").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_g")


def free_intervals(merged: DataFrame, lo: str, hi: str, whole_lo: str, whole_hi: str, *keys: str, margin: float = 10) -> DataFrame:
    """The gaps between merged intervals, and margins of the whole wider than ``margin``."""
    w = Window.partitionBy(*keys).orderBy(lo)
    rows = merged.withColumn("_next", F.lead(lo).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    parts = F.array(
        F.when(F.col("_first") & (F.col(lo) - F.col(whole_lo) > margin), F.struct(F.col(whole_lo).alias("g0"), F.col(lo).alias("g1"))),
        F.when(F.col("_next").isNotNull(), F.struct(F.col(hi).alias("g0"), F.col("_next").alias("g1"))),
        F.when(F.col("_next").isNull() & (F.col(whole_hi) - F.col(hi) > margin), F.struct(F.col(hi).alias("g0"), F.col(whole_hi).alias("g1"))),
    )
    return rows.select(*keys, F.explode(F.array_compact(parts)).alias("g")).select(*keys, F.col("g.g0").alias(lo), F.col("g.g1").alias(hi))


def _nulls_last(v: float) -> tuple[bool, float]:
    return (True, 0.0) if v != v else (False, v)


def _by_page(rows: DataFrame, given: list[str], f, **new: str) -> DataFrame:  # noqa: ANN001
    """Rows with new whole numbers, which ``f`` finds a page at a time from lists of numbers (NaN for null).

    A page is a row while that is done: only the given columns cross to Python, in batches of many pages, and all others stay
    in the JVM. Frames and a Python call for each page took 240 s over 60,000 boxes."""

    def run(*cols):  # noqa: ANN002, ANN202
        import pyarrow as pa

        ends = [0, *cols[0].value_lengths().cast("int64").to_numpy(zero_copy_only=False).cumsum().tolist()]
        flat = [c.flatten().fill_null(float("nan")).to_pylist() for c in cols]
        out: list[list[int]] = [[] for _ in new]
        for a, b in zip(ends, ends[1:]):
            got = f(*[c[a:b] for c in flat])
            for o, g in zip(out, got if len(new) > 1 else [got]):
                o += g
        offsets = pa.array(ends, pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(o, pa.int32())) for o in out], names=list(new))

    call = F.arrow_udf(run, "struct<" + ",".join(f"{k}:array<int>" for k in new) + ">")
    pages = rows.groupBy(*PAGE).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in PAGE])).alias("_rows"))
    pages = pages.withColumn("_new", call(*[F.col(f"_rows.{c}").cast("array<double>") for c in given]))
    each = pages.select(*PAGE, F.explode(F.arrays_zip("_rows", *[F.col(f"_new.{k}").alias(k) for k in new])).alias("_r"))
    return each.select(*[F.col(c) if c in PAGE else F.col(f"_r._rows.{c}") for c in rows.columns], *[F.col(f"_r.{k}").cast(t).alias(k) for k, t in new.items()])


def columns(blocks: DataFrame, offset: float = 20) -> DataFrame:
    """Blocks with the number of their column: two columns where the blocks' x-intervals make just two segments, cover
    more than 0.9 of the width and the gap between them starts within ``offset`` of the middle; else one."""
    whole = blocks.groupBy(*PAGE).agg(F.min("x0").alias("w0"), F.max("x1").alias("w1"))
    segs = merge_intervals(blocks, "x0", "x1", *PAGE)
    shape = segs.groupBy(*PAGE).agg(F.count("*").alias("n"), F.sum(F.col("x1") - F.col("x0")).alias("cover"), F.min("x1").alias("g0"), F.max("x0").alias("g1")).join(whole, list(PAGE))
    middle = (F.col("w0") + F.col("w1")) / 2
    two = (F.col("n") == 2) & (F.col("cover") / F.nullif(F.col("w1") - F.col("w0"), F.lit(0.0)) > 0.9) & (F.abs(F.col("g0") - middle) <= offset)
    split = shape.select(*PAGE, F.when(two, F.col("g1")).alias("_split"))
    return blocks.join(split, list(PAGE)).withColumn("column", F.when(F.col("x0") >= F.col("_split"), 1).otherwise(0)).drop("_split")


def page_language(pages: DataFrame, text: str = "text") -> DataFrame:
    """``lang`` (zh for more than 200 CJK characters or more than half) and ``is_scan`` (fewer than 200 characters)."""
    n = F.length(F.regexp_replace(text, r"[^一-龥]", ""))
    total = F.length(text)
    return pages.withColumn("lang", F.when((n > 200) | (n / F.nullif(total, F.lit(0)) > 0.5), "zh").otherwise("eng")).withColumn("is_scan", F.coalesce(total, F.lit(0)) < 200)


def reading_order(blocks: DataFrame, threshold: float = 10) -> DataFrame:
    """Blocks of a page from top to bottom; neighbours at about the same height from left to right, by insertion: a block
    moves up past blocks whose tops differ by less than ``threshold`` and that start further right. ``ord`` is the place."""

    def place(y: list, x: list) -> list[int]:
        res = sorted(range(len(y)), key=lambda i: (*_nulls_last(y[i]), *_nulls_last(x[i])))
        for i in range(1, len(res)):
            r, j = res[i], i
            while j > 0 and abs(y[r] - y[res[j - 1]]) < threshold and x[r] < x[res[j - 1]]:
                res[j] = res[j - 1]
                j -= 1
            res[j] = r
        out = [0] * len(res)
        for n, r in enumerate(res):
            out[r] = n
        return out

    return _by_page(blocks.drop("ord"), ["y0", "x0"], place, ord="int")


def sort_page_elements(rows: DataFrame) -> DataFrame:
    """``ord`` by top, left and id; rows without coordinates last."""
    w = Window.partitionBy("doc_id").orderBy("page_number", F.asc_nulls_last("y0"), F.asc_nulls_last("x0"), "element_id")
    return rows.withColumn("ord", F.row_number().over(w) - 1)


def order_shapes(shapes: DataFrame) -> DataFrame:
    """Shapes of a slide by top and left, missing ones as 0: ``shape_index`` from 0."""
    w = Window.partitionBy("doc_id", "slide").orderBy(F.coalesce("top", F.lit(0)), F.coalesce("left", F.lit(0)), "shape_no")
    return shapes.withColumn("shape_index", F.row_number().over(w) - 1)


def slide_title(shapes: DataFrame) -> DataFrame:
    """Whether a shape is its slide's title: the first one, near the top."""
    near = F.abs(F.col("height") - F.col("top")) / F.col("slide_height") <= 0.2
    return shapes.withColumn("is_title", (F.col("shape_index") == 0) & F.coalesce(near, F.lit(False)))


def assign_lines(lines: DataFrame, layout: DataFrame, threshold: float = CONTAIN) -> DataFrame:
    """Lines with the block that they belong to. Layout boxes take the longest run of consecutive lines that they hold
    (tables and images: all lines), boxes with more lines first, each only if none of its lines is taken; a line that
    is left is a block of its own. ``block_no`` is the least line of the block."""
    held = containment_join(lines, layout, threshold)
    free = held.filter(F.col("b_label").isin(TABLE, IMAGE)).select(*PAGE, "b_box_id", "line_no")
    run = longest_run(held.filter(~F.col("b_label").isin(TABLE, IMAGE)), "line_no", *PAGE, "b_box_id")
    runs = run.select(*PAGE, "b_box_id", F.explode(F.sequence("start", (F.col("start") + F.col("n") - 1).cast(dict(lines.dtypes)["line_no"]))).alias("line_no"))
    cand = free.unionByName(runs).groupBy(*PAGE, "b_box_id").agg(F.array_sort(F.collect_set("line_no")).alias("ls"))

    def greedy(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        taken: set = set()
        out = []
        rows = sorted(zip(pdf["doc_id"], pdf["page"], pdf["b_box_id"], pdf["ls"]), key=lambda r: (-len(r[3]), r[2]))
        for d, p, box, ls in rows:
            if not taken.intersection(ls):
                taken.update(ls)
                out += [(d, p, int(x), int(min(ls)), box) for x in ls]
        return pd.DataFrame(out, columns=["doc_id", "page", "line_no", "block_no", "box_id"])

    types = dict(lines.dtypes)
    picked = cand.groupBy(*PAGE).applyInPandas(greedy, f"doc_id {types['doc_id']}, page {types['page']}, line_no {types['line_no']}, block_no {types['line_no']}, box_id {dict(layout.dtypes)['box_id']}")
    return lines.join(picked, [*PAGE, "line_no"], "left").withColumn("block_no", F.coalesce("block_no", "line_no"))


def same_line_boxes(boxes: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Boxes with the number of their line: from the top, a box starts a line with all free boxes whose height overlaps
    with its own by more than ``threshold`` of the lesser height; in a line, ``pos`` goes from left to right."""

    def number(ys0: list, xs: list, ys1: list) -> tuple[list[int], list[int]]:
        by = sorted(range(len(xs)), key=lambda i: (*_nulls_last(ys0[i]), *_nulls_last(xs[i])))
        y0, y1 = [ys0[i] for i in by], [ys1[i] for i in by]
        whole = sum(y == y for y in y0)  # boxes without a top come last
        line, pos, n = [-1] * len(by), [0] * len(by), 0
        for i in range(len(by)):
            if line[by[i]] >= 0:
                continue
            row, j = [], i
            while j < len(by):
                if j > i and j < whole and y0[j] >= y1[i] and threshold >= 0:  # nor does any box below it reach this one
                    j = whole
                    continue
                if line[by[j]] < 0 and (j == i or (min(y1[i], y1[j]) - max(y0[i], y0[j])) / max(min(y1[i] - y0[i], y1[j] - y0[j]), 1e-9) > threshold):
                    line[by[j]] = n
                    row.append(by[j])
                j += 1
            for k, r in enumerate(sorted(row, key=lambda r: _nulls_last(xs[r]))):
                pos[r] = k
            n += 1
        return line, pos

    return _by_page(boxes, ["y0", "x0", "y1"], number, line="int", pos="int")


def layout_elements(blocks: DataFrame) -> DataFrame:
    """Elements of labelled blocks (lines: array of text, boxes: array of arrays): type, text and extra_data as JSON with
    boxes, pages, kinds, and the range of characters of each line, both ends included."""
    kind = F.when(F.col("layout_type") == TITLE, "title").when(F.col("layout_type") == TABLE, "table").otherwise("paragraph")
    ends = F.aggregate(
        F.transform("lines", lambda x: F.length(x)),
        F.struct(F.array().cast("array<array<int>>").alias("r"), F.lit(0).alias("at")),
        lambda a, n: F.struct(F.array_append(a["r"], F.array(a["at"], a["at"] + n - 1)).alias("r"), (a["at"] + n).alias("at")),
        lambda a: a["r"],
    )
    ranges = F.when(F.col("layout_type") == TABLE, F.array(F.array(F.lit(0), F.length("text") - 1))).otherwise(ends)
    extra = F.to_json(F.struct(F.col("boxes").alias("bboxes"), F.array_distinct("pages").alias("pages"), ranges.alias("indexes"), F.transform("boxes", lambda _: kind).alias("types")))
    kinds = F.when(F.col("layout_type") == TITLE, "Title").when(F.col("layout_type") == TEXT, "UncategorizedText").when(F.col("layout_type") == TABLE, "Table").otherwise("NarrativeText")
    return blocks.filter(F.col("layout_type").isin(*KEPT)).withColumn("type", kinds).withColumn("extra_data", extra)


def small_image_text(elements: DataFrame, least: int = 24) -> DataFrame:
    """Without Image elements whose text is short or has no blank."""
    return elements.filter(~((F.col("type") == "Image") & ((F.length("text") < least) | ~F.col("text").contains(" "))))


# ---- stitching over pages -------------------------------------------------------------------------------------------


def stitch_paragraphs(blocks: DataFrame, language: str = "eng", full: float = 0.8, indent: float = 0.8, height: float = 0.3) -> DataFrame:
    """Blocks (doc_id, page, ord, layout_type, text, and the first and last line's boxes f_* and l_*) with paragraphs that
    run over a page's end made one, on the earlier page.

    The last block of a page goes on in the first of the next page if both are paragraphs, its last line is nearly as
    wide as the page's text, the next one isn't indented, and line heights are alike."""
    page = Window.partitionBy(*PAGE)
    doc = Window.partitionBy("doc_id").orderBy("page", "ord")
    b = blocks.withColumn("_p0", F.min("x0").over(page)).withColumn("_p1", F.max("x1").over(page))
    b = b.withColumn("_first", F.row_number().over(page.orderBy("ord")) == 1)
    prev = {c: F.lag(c).over(doc) for c in ("layout_type", "l_x0", "l_x1", "l_y0", "l_y1", "_p0", "_p1")}
    h = F.col("f_y1") - F.col("f_y0")
    joins = (
        F.col("_first")
        & (prev["layout_type"] == TEXT)
        & (F.col("layout_type") == TEXT)
        & ((prev["l_x1"] - prev["l_x0"]) / (prev["_p1"] - prev["_p0"]) > full)
        & ((F.col("f_x0") - F.col("_p0")) / h < indent)
        & (F.abs(prev["l_y1"] - prev["l_y0"] - h) / h < height)
    )
    b = b.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    b = b.withColumn("_island", F.sum((~F.col("_joins")).cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    from ..functions.text import join_lines

    parts = F.array_sort(F.collect_list(F.struct("page", "ord", "text")))
    out = b.groupBy("doc_id", "_island").agg(F.min("page").alias("page"), F.min_by("ord", F.struct("page", "ord")).alias("ord"), F.min_by("layout_type", F.struct("page", "ord")).alias("layout_type"), parts.alias("_parts"), F.array_sort(F.collect_set("page")).alias("pages"))
    return out.select("doc_id", "page", "ord", "layout_type", join_lines(F.transform("_parts", lambda x: x["text"]), language).alias("text"), "pages")


def markdown_columns(md: Column) -> Column:
    return F.split(F.substring_index(md, "\n", 1), r" \| ")


def merge_markdown(a: Column, b: Column) -> Column:
    """Table b put below table a: without its header if that is a's, else with it as a row."""
    rows = F.split(b, "\n")
    body = F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(0)))
    return F.concat_ws("\n", a, F.array_join(F.when(markdown_columns(a) == markdown_columns(b), body).otherwise(F.concat(F.slice(rows, 1, 1), body)), "\n"))


def stitch_tables(tables: DataFrame, width: float = 0.05) -> DataFrame:
    """Tables (doc_id, page, ord, md, width) that go on over a page's end made one: next to each other, with as many
    columns, and the next one not wider by more than ``width``."""
    doc = Window.partitionBy("doc_id").orderBy("page", "ord")
    joins = (
        (F.col("page") == F.lag("page").over(doc) + 1)
        & ((F.col("width") - F.lag("width").over(doc)) / F.lag("width").over(doc) < width)
        & (F.size(markdown_columns(F.col("md"))) == F.size(markdown_columns(F.lag("md").over(doc))))
    )
    t = tables.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    t = t.withColumn("_island", F.sum((~F.col("_joins")).cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = t.groupBy("doc_id", "_island").agg(F.array_sort(F.collect_list(F.struct("page", "ord", "md"))).alias("p"), F.min("page").alias("page"))
    first = F.get("p", F.lit(0))
    md = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), first["md"], lambda a, x: merge_markdown(a, x["md"]))
    return g.select("doc_id", "page", first["ord"].alias("ord"), md.alias("md"), F.array_distinct(F.transform("p", lambda x: x["page"])).alias("pages"))


def markdown_table(rows: Column, widen: int | None = 3) -> Column:
    """An array of rows (arrays of cells) as a table; the first row is the head. The rule below the head is as long as
    the longest row if that is at most ``widen`` longer than the head (None: never)."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    head = F.size(F.get(rows, F.lit(0)))
    most = F.array_max(F.transform(rows, lambda r: F.size(r)))
    n = head if widen is None else F.when(most - head <= widen, most).otherwise(head)
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0)))), F.array(line(F.array_repeat(F.lit("---"), n))), body), "\n"))


def list_to_table(cells: Column) -> Column:
    """A list as the head of an HTML table."""
    return F.concat(F.lit("<table><thead>\n"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<th>"), c, F.lit("</th>"))), "\n"), F.lit("\n</thead></table>"))


def grid(cells: DataFrame) -> DataFrame:
    """Cells (doc_id, row, col, text) as rows of texts in order of their columns, cells of a place joined by blanks."""
    c = cells.groupBy("doc_id", "row", "col").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("t"))
    r = c.groupBy("doc_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "t"))), lambda x: x["t"]).alias("cells"))
    return r.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"))


def pdf_strategy(strategy: Column, wants_tables: Column, extractable: Column, has_layout_model: Column, has_ocr: Column, is_image: bool = False) -> Column:
    """The way a PDF or an image is read: as asked for where that can be done, else what can."""
    fast = F.lit(False) if is_image else extractable
    auto = F.when(F.lit(is_image) | wants_tables, "hi_res").when(fast, "fast").otherwise("ocr_only")
    want = F.when(strategy == "auto", auto).otherwise(strategy)
    return (
        F.when((want == "hi_res") & has_layout_model, "hi_res")
        .when((want == "hi_res") & fast, "fast")
        .when((want == "hi_res") & has_ocr, "ocr_only")
        .when((want == "ocr_only") & has_ocr, "ocr_only")
        .when((want == "ocr_only") & fast, "fast")
        .when((want == "ocr_only") & has_layout_model, "hi_res")
        .when((want == "fast") & fast, "fast")
        .when((want == "fast") & has_ocr, "ocr_only")
        .when((want == "fast") & has_layout_model, "hi_res")
        .otherwise(F.raise_error(F.lit("no way to read this file here")).cast("string"))
    )
