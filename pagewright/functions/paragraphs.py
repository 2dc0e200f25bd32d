"""Paragraphs: grouping of broken lines, splitting, packing to a size, chunking by tokens.

A document stays one row until it is exploded. Packing goes from piece to piece, and a fold over an array copies what it has
at each step, so texts that have to be packed go to Python, in Arrow batches and only they; the rest stays in Columns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import classify as C
from . import text as X

LINE_ENDS = r"(?<=\n)"
_DOUBLE = r"(?U)(?:\s*\n\s*){2}"


def _blank(t: Column) -> Column:
    return ~t.rlike(r"(?U)\S")


def new_line_grouper(t: Column) -> Column:
    """Every line is a paragraph: blank ones go, each keeps its line break, and an empty line comes between."""
    return F.array_join(F.filter(F.split(t, LINE_ENDS), lambda z: ~_blank(z)), "\n\n")


def group_bullet_paragraph(p: Column) -> Column:
    """The bulleted items of a paragraph, with their line breaks as blanks. A lone ``e`` at a line's start is a bullet."""
    marked = X.strip(F.regexp_replace(p, X.E_BULLET, "·"))
    items = F.split(marked, f"(?={X.BULLET})(?<!{X.BULLET})")
    return F.transform(F.filter(items, lambda z: z != ""), lambda z: F.regexp_replace(z, X.PARAGRAPH, " "))


def _lines(p: Column) -> Column:
    """Lines of a paragraph, split at breaks and at bullets; a bullet that isn't followed by another is a piece of its own."""
    marked = F.regexp_replace(p, rf"({X.BULLET})(?!{X.BULLET}|\z)", "\u0001$1\u0001")
    return F.flatten(F.transform(F.split(marked, "\u0001"), lambda z: F.when(z.rlike(f"^{X.BULLET}$"), F.array(z)).otherwise(F.split(z, rf"{X.PARAGRAPH}(?!{X.BULLET}|\z)"))))


def group_broken_paragraphs(t: Column) -> Column:
    """Lines of a paragraph joined by blanks; bulleted paragraphs by item; lines that are all short stay apart."""

    def one(p: Column) -> Column:
        lines = _lines(p)
        short = F.forall(lines, lambda z: F.size(F.split(X.strip(z), " ")) < 5)
        bare = X.strip(p)
        return (
            F.when(bare.rlike(X.LEADING_BULLET) | bare.rlike(r"^e(?=\s)"), group_bullet_paragraph(p))
            .when(short, F.filter(lines, lambda z: ~_blank(z)))
            .otherwise(F.array(F.regexp_replace(p, X.PARAGRAPH, " ")))
        )

    parts = F.filter(F.split(t, _DOUBLE), lambda p: ~_blank(p))
    return F.array_join(F.flatten(F.transform(parts, one)), "\n\n")


blank_line_grouper = group_broken_paragraphs


def empty_line_ratio(t: Column, max_line_count: int | None = None) -> Column:
    """The share of blank lines, among the first ones if a number is given."""
    lines = F.split(t, LINE_ENDS)
    head = F.slice(lines, 1, max_line_count) if max_line_count else lines
    return F.size(F.filter(head, _blank)) / F.size(head)


def auto_paragraph_grouper(t: Column, max_line_count: int | None = None, threshold: float = 0.1) -> Column:
    """Line by line where blank lines are rare, else by blank lines. All lines count unless ``max_line_count`` says how many."""
    return F.when(empty_line_ratio(t, max_line_count) < threshold, new_line_grouper(t)).otherwise(blank_line_grouper(t))


def split_paragraphs(t: Column) -> Column:
    """The array of a text's paragraphs, before any packing."""
    return F.split(X.strip(t), X.PARAGRAPH)


_SENTENCE_END = re.compile(C.SENTENCE_END.replace("[^\\s]", "[^ \\t-\\r]").replace("\\s+", "[ \\t-\\r]+"))


def _halves(s: str) -> list[str]:
    """A text cut at the blank that is nearest to its middle, the later one of two; in the very middle if there is none."""
    mid = len(s) // 2
    after, before = s.find(" ", mid) - mid, mid - s.rfind(" ", 0, mid + 1)
    at = mid
    if 0 <= after < mid and (before > mid or after <= before):
        at = mid + after
    elif before < mid:
        at = mid - before
    return [s[:at].rstrip(), s[at:].lstrip()]


def _packed(pieces: list[tuple[str, bool]], n: int) -> list[str]:
    """Pieces joined by blanks as long as n characters aren't exceeded; a piece may have to start anew."""
    out: list[str] = []
    now: list[str] = []
    size = 0
    for s, anew in pieces:
        if now and (anew or size + 1 + len(s) > n):
            out.append(" ".join(now))
            now = []
        size = size + 1 + len(s) if now else len(s)
        if size:
            now.append(s)
    return [*out, " ".join(now)] if now else out


def _fitted(t: str, n: int) -> list[str]:
    """``split_content_to_fit_max`` of one paragraph."""
    if len(t) <= n:
        return [t] if t.strip() else []
    pieces: list[tuple[str, bool]] = []
    for s in _SENTENCE_END.split(t):
        if not s.strip():
            continue
        if len(s) <= n:
            pieces.append((s, False))
        elif len(s) < 2 * n:
            pieces += [(x, True) for x in _halves(s)]
        else:
            words = [w[i : i + n] for w in s.split() for i in range(0, len(w), n)]
            pieces += [(x, True) for x in _packed([(w, False) for w in words], n)]
    return _packed(pieces, n)


def _combined(parts: list[str], most: int, least: int) -> list[str]:
    out: list[list[str]] = []
    size, opened = 0, False
    for x in parts:
        if opened and size + 1 + len(x) <= most:
            out[-1].append(x)
            size += 1 + len(x)
        else:
            out.append([x])
            size, opened = len(x), len(x) < least
    return [" ".join(x) for x in out]


def _by_python(f, parts: Column, when: Column) -> Column:  # noqa: ANN001
    """``f`` of the lists where it is wanted; other rows cross to Python as nulls."""
    call = F.pandas_udf(lambda col: pd.Series([None if x is None else f(list(x)) for x in col], dtype=object), ArrayType(StringType()))
    return call(F.when(when, parts))


def _fit_all(parts: Column, n: int) -> Column:
    long = F.exists(parts, lambda p: F.length(p) > n)
    return F.when(long, _by_python(lambda ps: [x for p in ps for x in _fitted(p, n)], parts, long)).otherwise(F.filter(parts, lambda p: ~_blank(p)))


def split_content_to_fit_max(t: Column, max_partition: int = 1500) -> Column:
    """A paragraph's sentences packed into chunks of at most ``max_partition`` characters. A sentence that is longer is
    halved at a blank if it is less than twice as long, else wrapped at words; its last part is packed on."""
    return F.when(t.isNotNull(), _fit_all(F.array(t), max_partition))


def combine_paragraphs_less_than_min(parts: Column, max_partition: int = 1500, min_partition: int = 0) -> Column:
    """Paragraphs shorter than the minimum take in the next ones as long as the maximum isn't exceeded."""
    if not min_partition:
        return parts
    short = F.exists(parts, lambda p: F.length(p) < min_partition)
    return F.when(short, _by_python(lambda ps: _combined(ps, max_partition, min_partition), parts, short)).otherwise(parts)


def split_by_paragraph(t: Column, min_partition: int = 0, max_partition: int | None = 1500) -> Column:
    """All paragraphs of a text, packed to the given sizes."""
    parts = split_paragraphs(t)
    if max_partition:
        parts = _fit_all(parts, max_partition)
    return combine_paragraphs_less_than_min(parts, max_partition or 1 << 30, min_partition)


def chunk_by_attention_window(t: Column, max_input_size: int, buffer: int = 2, separator: str = " ", count: str = "words") -> Column:
    """Segments between separators packed greedily into chunks of at most ``max_input_size - buffer`` tokens.

    ``count`` says how a segment's tokens are counted: ``words`` (one for each segment) or ``chars``. A chunk that is
    followed by another ends with the bare separator. A segment that is too long by itself is an error."""
    if not 0 <= buffer < max_input_size:
        raise ValueError("the buffer must be 0 or more and below the window's size")
    most = max_input_size - buffer
    segments = F.split(t, separator)
    if count == "words":

        def cut(segs: Column) -> Column:
            chunk = lambda k: F.array_join(F.slice(segs, k * most + 1, most), separator)
            last = F.floor((F.size(segs) - 1) / most).cast("int")
            return F.transform(F.sequence(F.lit(0), last), lambda k: F.when(k < last, F.concat(chunk(k), F.lit(separator.strip()))).otherwise(chunk(k)))

        # in a lambda whatever isn't its argument is evaluated again for each element, so lists are made arguments
        return F.get(F.transform(F.array(segments), lambda segs: F.get(F.transform(F.array(cut(segs)), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)), F.lit(0))), F.lit(0))

    def pack(parts: list[str]) -> list[str]:
        out: list[str] = []
        now, size = "", 0
        run: list[str] = []
        for s in parts:
            if len(s) > most:
                raise ValueError("a segment is longer than the window")
            if size + len(s) > most:
                out.append(separator.join(run) + separator.strip())
                run, size = [], 0
            run = run if size else []
            run.append(s)
            size += len(s)
        now = separator.join(run)
        return [*out, now] if now else out

    return _by_python(pack, segments, t.isNotNull())


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """The rows over all cores where there are fewer partitions than cores, as with one small file; otherwise as it is.

    With a key, rows of a key come together, in some tasks a core: for keys that are dear to work on, as a shuffle that follows
    them by itself is joined to few tasks when what it moves is small."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if key:
        return df.repartition(max(4 * cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)
    return df.repartition(cores) if max(df.rdd.getNumPartitions() // 4, 1) < cores else df


def partition_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paragraph_grouper: str | None = "auto", min_partition: int = 0, max_partition: int | None = 1500, language: str = "en") -> DataFrame:
    """Paragraph elements of texts: doc_id, ord, element_id, type, text. ``paragraph_grouper`` is auto, new_line,
    blank_line or None (off)."""
    if max_partition is not None and not 0 <= min_partition <= max_partition:
        raise ValueError("0 <= min_partition <= max_partition must hold")
    group = {"auto": auto_paragraph_grouper, "new_line": new_line_grouper, "blank_line": blank_line_grouper, None: lambda t: t}[paragraph_grouper]
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")))
    parts = rows.select("doc_id", F.posexplode(split_by_paragraph(group(F.col("_t")), min_partition, max_partition)).alias("ord", "raw")).withColumn("raw", X.strip("raw")).filter("raw <> ''")
    parts = parts.withColumn("_n", C.sentence_words(F.col("raw")))
    return parts.select("doc_id", "ord", C.element_type(F.col("raw"), language, F.col("_n")).alias("type"), C.element_text(F.col("raw")).alias("text")).select("doc_id", "ord", F.substring(F.sha2("text", 256), 1, 32).alias("element_id"), "type", "text")
