"""A small HTML tree, made by the standard library's tokeniser, with implied end tags and void tags."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening the tag closes these, up to the nearest of the bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul"
CLOSES |= {t: ({"p"}, {"div", "td", "th", "li", "body", "article", "section", "main", "table"}) for t in _BLOCKS.split()}


class Node:
    __slots__ = ("tag", "attrs", "text", "tail", "children", "parent")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.text, self.tail = "", ""
        self.children: list[Node] = []

    def iter(self) -> Iterator[Node]:
        """This node and all below, in document order; no recursion, so depth is no limit."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def below(self, *tags: str) -> Iterator[Node]:
        it = self.iter()
        next(it)
        return (n for n in it if not tags or n.tag in tags)

    def content(self) -> str:
        """All text within."""
        out: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            out.append(x.text)
            for c in reversed(x.children):
                stack.append(c.tail)
                stack.append(c)
        return "".join(out)

    def ancestors(self) -> list[str]:
        """Tags from the root down to the parent."""
        out, n = [], self.parent
        while n is not None:
            out.append(n.tag)
            n = n.parent
        return out[::-1]

    def next(self) -> Node | None:
        if self.parent is None:
            return None
        at = self.parent.children.index(self)
        return self.parent.children[at + 1] if at + 1 < len(self.parent.children) else None

    def html(self, allowed: frozenset[str] | None = None, attrs: tuple[str, ...] = ("colspan", "rowspan")) -> str:
        """Markup with only the allowed tags; what is in others stays."""
        out: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            keep = allowed is None or x.tag in allowed
            if keep:
                out.append("<" + x.tag + "".join(f' {k}="{escape(v or "")}"' for k, v in x.attrs.items() if k in attrs) + ">")
            out.append(escape(x.text, quote=False))
            if keep and x.tag not in VOID:
                stack.append(f"</{x.tag}>")
            for c in reversed(x.children):
                stack.append(escape(c.tail, quote=False))
                stack.append(c)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self, drop: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.drop, self.skipping = drop, 0

    def _add_text(self, data: str) -> None:
        top = self.open[-1]
        if top.children:
            top.children[-1].tail += data
        else:
            top.text += data

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.drop:
            self.skipping += tag not in VOID
            return
        if self.skipping or tag in ("html", "body", "head"):
            return
        if tag in CLOSES:
            close, bound = CLOSES[tag]
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in close:
                    del self.open[k:]
                elif self.open[k].tag in bound:
                    break
        node = Node(tag, dict(attrs), self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in self.drop and tag not in VOID:
            self.skipping -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag in self.drop:
            self.skipping = max(0, self.skipping - 1)
            return
        if self.skipping:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self._add_text(data)


DROPPED = frozenset("script style template noscript iframe object applet embed button select textarea".split())


def _splice(root: Node, allowed: frozenset[str]) -> None:
    """Takes away tags that aren't allowed; what they hold stays in their place."""
    for n in reversed(list(root.iter())):
        kept: list[Node] = []

        def add(text: str, n: Node = n, kept: list[Node] = kept) -> None:
            if kept:
                kept[-1].tail += text
            else:
                n.text += text

        for c in n.children:
            if c.tag in allowed:
                kept.append(c)
            else:
                add(c.text)
                for x in c.children:
                    x.parent = n
                    kept.append(x)
                add(c.tail)
        n.children = kept


def parse(text: str, allowed: frozenset[str] | None = None, drop: frozenset[str] = DROPPED) -> Node:
    """The tree of a page. ``drop`` goes with all it holds; of tags that aren't allowed only the tag goes."""
    b = _Builder(drop)
    b.feed(text)
    b.close()
    if allowed is not None:
        _splice(b.root, allowed)
    return b.root
