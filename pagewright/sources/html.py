"""HTML: pages to raw elements by walking a cleaned tree, and tables to Markdown.

A page's main part (``main``) is read, article by article, each a page of its own. Of each node in document order the
first of these applies: a table (its innermost maximal tables, or itself) becomes a Table; a text tag with few children
becomes a text element; a div with children and text of its own gives that text; a list item gives a ListItem. What an
element was made of isn't read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .raw import elements, parse_files
from .tree import Node, parse

ALLOWED = frozenset("article b br dd div figcaption font footer h1 h2 h3 h4 h5 h6 header li main p span table tbody td th tr".split())
TABLE_HTML = frozenset("table tbody td th tr".split())
TEXT_TAGS = frozenset("a font p span td".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
EMPTY = frozenset(("br", "hr"))
EMPHASIS = ("b", "em", "i", "span", "strong")
_BULLETS = "".join(map(chr, (0x2D, 0x2A, 0x95, 0xB7, 0x2022, 0x2023, 0x2043, 0x204C, 0x204D, 0x2219, 0x25CB, 0x25CF, 0x25D8, 0x25E6, 0x2619, 0x2765, 0x2767, 0x29BE, 0x29BF, 0x3164, 0xF0B7)))
_BULLET = re.compile(f"[{re.escape(_BULLETS)}](?![{re.escape(_BULLETS)}])")
_ADDRESS = re.compile(r"[a-z0-9.\-+_]+@[a-z0-9.\-+_]+\.[a-z]+")


def norm(s: str) -> str:
    return " ".join(s.split())


def bulleted(s: str) -> bool:
    return bool(_BULLET.match(s.strip()))


def text_of(n: Node, tail: bool = True) -> str:
    return (n.content() + (n.tail if tail else "")).strip()


def table_rows(table: Node, separator: str = " ") -> list[list[str]]:
    """Texts of the cells; empty cells and rows are left out."""
    rows = []
    for tr in table.below("tr"):
        cells = [c for c in (separator.join(t for t in map(norm, _texts(e)) if t) for e in tr.children) if c]
        if cells:
            rows.append(cells)
    return rows


def _texts(n: Node) -> Iterator[str]:
    for k, x in enumerate(n.iter()):
        yield x.text
        if k:
            yield x.tail


def expanded_rows(table: Node, separator: str = " ") -> list[list[str]]:
    """Texts of the cells, those that span rows or columns repeated over all of them; the head's cells come first."""
    rows = []
    for head in table.below("thead"):
        cells = [t for th in head.below("th") for t in map(norm, _texts(th)) if t]
        if cells and not any(True for _ in head.below("tr")):
            rows.append(cells)
    pending: dict[tuple[int, int], str] = {}
    for r, tr in enumerate(table.below("tr")):
        row: list[str] = []
        for e in tr.children:
            while (r, len(row)) in pending:
                row.append(pending.pop((r, len(row))))
            text = separator.join(t for t in map(norm, _texts(e)) if t)
            span = lambda k: max(1, int(e.attrs.get(k) or 1)) if (e.attrs.get(k) or "1").isdigit() else 1  # noqa: B023, E731
            for _ in range(span("colspan")):
                for k in range(1, span("rowspan")):
                    pending[(r + k, len(row))] = text
                row.append(text)
        while (r, len(row)) in pending:
            row.append(pending.pop((r, len(row))))
        if row:
            rows.append(row)
    return rows


def markdown(rows: list[list[str]], widen: int | None = None) -> str:
    """Rows as a Markdown table, the first one as its head."""
    if not rows:
        return ""
    line = lambda r: "| " + " | ".join(r) + " |"
    n, most = len(rows[0]), max(map(len, rows))
    if widen is not None and most - n <= widen:
        n = most
    return "\n".join([line(rows[0]), line(["---"] * n), *map(line, rows[1:])])


def table_to_markdown(html: str) -> dict[str, str]:
    """text (Markdown) and html (cleaned) of the first table in the markup, or of the markup as a whole."""
    root = parse(html)
    table = next(root.below("table"), root)
    return {"text": markdown(expanded_rows(table), widen=3), "html": table.html(TABLE_HTML | {"thead"})}


def merge_html_tables(tables: list[str], has_header: bool = False) -> str:
    """The rows of all tables in one; heads of later ones go (``has_header``) or become rows."""
    if not tables:
        return ""
    kept = TABLE_HTML | {"thead"}
    out = ["<table>"]
    for k, html in enumerate(tables):
        t = next(parse(html).below("table"), None)
        if t is None:
            continue
        for head in t.below("thead"):
            if not k:
                out.append(head.html(kept))
            elif not has_header:
                rows = list(head.below("tr"))
                if rows:
                    out += [r.html(kept) for r in rows]
                else:
                    out.append("<tr>" + "".join(f"<td>{norm(c.content())}</td>" for c in head.below("th")) + "</tr>")
        out += [r.html(kept) for r in t.below("tr") if "thead" not in r.ancestors()]
    return "\n".join([*out, "</table>"])


def _table_elements(n: Node) -> Iterator[dict]:
    inner = list(n.below("table"))
    within = {id(x) for t in inner for x in t.below("table")}
    for t in [t for t in inner if id(t) not in within] or [n]:
        yield {"kind": "Table", "text": markdown(table_rows(t)), "tag": "table", "text_as_html": t.html(TABLE_HTML), "ancestortags": t.ancestors()}


def _is_text_tag(n: Node, most: int = 5) -> bool:
    if len(n.children) > most + sum(c.tag in EMPTY for c in n.children):
        return False
    if n.tag in TEXT_TAGS or n.tag in HEADINGS:
        return True
    if n.tag != "div":
        return False
    return not n.children or (all(c.tag == "span" for c in n.children) and bulleted(n.children[0].text))


def _links(n: Node) -> tuple[list[str], list[str]]:
    found = [(x.text, x.attrs["href"]) for x in n.iter() if x.attrs.get("href")]
    return [f[0] for f in found], [f[1] for f in found]


def _emphasis(n: Node) -> tuple[list[str], list[str]]:
    found = [(t, x.tag) for x in n.iter() if x.tag in EMPHASIS and (t := text_of(x, False))]
    return [f[0] for f in found], [f[1] for f in found]


def _element(n: Node, text: str, kind: str | None = None, tag: str | None = None) -> dict | None:
    """None where no element would be made of the text."""
    if kind is None and (not _BULLET.sub("", text, count=1).strip() if bulleted(text) else len(text) < 2):
        return None
    if not text:
        return None
    lt, lu = _links(n)
    et, eg = _emphasis(n)
    return {"kind": kind, "text": norm(text), "tag": tag or n.tag, "ancestortags": n.ancestors(), "heading": n.tag in HEADINGS, "language": "zh", "link_texts": lt or None, "link_urls": lu or None, "emphasized_text_contents": et or None, "emphasized_text_tags": eg or None}


def walk(root: Node) -> Iterator[dict]:
    """Raw elements of one article."""
    done: set[int] = set()
    for n in root.iter():
        if id(n) in done:
            continue
        if n.tag == "table":
            yield from _table_elements(n)
            done.update(id(x) for x in n.below())
        elif _is_text_tag(n):
            text = text_of(n)
            e = _element(n, text) if text else None
            if e:
                yield e
                done.update(id(x) for x in n.below())
        elif n.tag == "div" and n.children and n.text.strip():
            e = _element(n, n.text.strip(), tag="div")
            if e:
                yield e | {"ancestortags": []}
        elif n.tag in ("li", "dd"):
            e = _element(n, text_of(n), "ListItem")
            if e:
                yield e
                done.update(id(x) for x in n.below())
        elif n.tag == "div" and bulleted(text_of(n)):
            nxt = n.next()
            if nxt is not None and (e := _element(nxt, text_of(nxt), "ListItem")):
                yield e
                done.update(id(x) for x in nxt.below())


def read(text: str, section: str | None = None) -> Iterator[dict]:
    """Raw elements of a page, articles numbered as pages from 1."""
    root = parse(text, ALLOWED)
    root = next(root.below("main"), root)
    articles = list(root.below("article")) or [d for d in root.below("div") if d.attrs.get("itemprop") == "articleBody"] or [root]
    inner = {id(x) for a in articles for x in a.below("article")}
    page = 1
    for a in articles:
        if id(a) in inner:
            continue
        found = False
        for e in walk(a):
            found = True
            yield e | {"page_number": page, "section": section}
        page += found


def partition_html(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """Element rows of HTML texts."""
    src = pages.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{html_col}` as html")
    return elements(parse_files(src, lambda r: read(r["html"] or ""), "html"))
