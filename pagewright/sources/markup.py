"""RTF, Org and reStructuredText: their common part, as text or by way of Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .html import markdown
from .office import _html_table
from .plain import read_markdown

_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)
_HIDDEN = set("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr footnote themedata datastore listtable listoverridetable rsidtbl generator xmlnstbl".split())
_SIGNS = {"par": "\n", "sect": "\n", "page": "\f", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "cell": "\x07", "row": "\x07\n", "~": " ", "emspace": " ", "enspace": " "}


def rtf_text(raw: str) -> str:
    """The text of an RTF file; cells end with a bell sign, rows with a bell and a line break, pages with a form feed."""
    if not raw.lstrip().startswith("{\\rtf"):
        raise ValueError("not an RTF file")
    page = re.search(r"\\ansicpg(\d+)", raw)
    code = f"cp{page[1]}" if page else "cp1252"
    out: list[str] = []
    held = bytearray()  # bytes of a letter that takes several
    stack: list[tuple[bool, int]] = []
    hidden, skip, left = False, 1, 0

    def put(s: str) -> None:
        nonlocal left
        if held:
            try:
                out.append(held.decode(code, "replace"))
            except LookupError:
                out.append(held.decode("cp1252", "replace"))
            held.clear()
        out.append(s)

    for m in _RTF.finditer(raw):
        word, number, byte, sign, brace, letter = m.groups()
        if brace == "{":
            stack.append((hidden, skip))
        elif brace == "}":
            put("")
            hidden, skip = stack.pop() if stack else (False, 1)
        elif word:
            if word in _HIDDEN:
                hidden = True
            elif word == "uc":
                skip = int(number or 1)
            elif not hidden and word == "u" and number:
                put(chr(int(number) % 65536))
                left = skip
            elif not hidden and word in _SIGNS:
                put(_SIGNS[word])
        elif sign == "*":
            hidden = True
        elif hidden:
            continue
        elif byte:
            if left:
                left -= 1
            else:
                held.append(int(byte, 16))
        elif sign:
            put(_SIGNS.get(sign, sign if sign in "\\{}" else ""))
        elif letter is not None:
            if left:
                left -= 1
            else:
                put(letter)
    put("")
    text = "".join(out)
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def read_rtf(raw: str, include_page_breaks: bool = False) -> Iterator[dict]:
    """Paragraphs, and neighbouring rows of cells as a Table."""
    for n, sheet in enumerate(rtf_text(raw).split("\f"), 1):
        if n > 1 and include_page_breaks:
            yield {"kind": "PageBreak", "text": ""}
        rows: list[list[str]] = []
        for line in [*sheet.split("\n"), ""]:
            if "\x07" in line:
                rows.append([c.strip() for c in line.rstrip("\x07").split("\x07")])
                continue
            if rows:
                yield {"kind": "Table", "text": markdown(rows, widen=3), "text_as_html": _html_table(rows), "page_number": n}
                rows = []
            if line.strip():
                yield {"text": re.sub(r"[ \t]+", " ", line).strip(), "page_number": n}


def org_to_markdown(text: str) -> str:
    out: list[str] = []
    code = False
    for line in text.replace("\r\n", "\n").split("\n"):
        s = line.strip()
        if re.match(r"#\+(begin|end)_", s, re.I):
            code = s.lower().startswith("#+begin") and s.lower().split("_", 1)[1].split()[0] in ("src", "example", "verse") or (code and not s.lower().startswith("#+end"))
            if re.match(r"#\+(begin|end)_(src|example)", s, re.I):
                out.append("```")
            continue
        if code:
            out.append(line)
            continue
        if m := re.match(r"#\+title:\s*(.*)", s, re.I):
            out += ["# " + m[1], ""]
            continue
        if s.startswith(("#+", "# ")) or s == "#" or re.fullmatch(r":[A-Z_]+:.*", s):
            continue
        if m := re.match(r"(\*+)\s+(?:(?:TODO|DONE)\s+)?(.*?)(?:\s+:[\w@:]+:)?$", line):
            out += ["", "#" * min(len(m[1]), 6) + " " + m[2], ""]
            continue
        if re.fullmatch(r"\|[-+|]+\|?", s):
            out.append("|" + "|".join("---" for _ in re.split(r"\+", s.strip("|"))) + "|")
            continue
        line = re.sub(r"\[\[([^\]]+)\]\[([^\]]+)\]\]", r"[\2](\1)", line)
        line = re.sub(r"\[\[([^\]]+)\]\]", r"\1", line)
        line = re.sub(r"(?<![\w*])\*(?=\S)([^*\n]+?)(?<=\S)\*(?![\w*])", r"**\1**", line)
        line = re.sub(r"(?<![\w/])/(?=\S)([^/\n]+?)(?<=\S)/(?![\w/])", r"*\1*", line)
        out.append(re.sub(r"(?<!\w)[=~](?=\S)([^=~\n]+?)(?<=\S)[=~](?!\w)", r"`\1`", line))
    return "\n".join(out)


def rst_to_markdown(text: str) -> str:
    lines = text.replace("\r\n", "\n").expandtabs(4).split("\n")
    out: list[str] = []
    levels: list[str] = []
    rule = lambda s: re.fullmatch(r"([=\-`:'\"~^_*+#<>.])\1{2,}", s)
    i = 0

    def heading(kind: str, title: str) -> None:
        if kind not in levels:
            levels.append(kind)
        out.extend(["", "#" * min(levels.index(kind) + 1, 6) + " " + title, ""])

    while i < len(lines):
        s, nxt = lines[i].rstrip(), lines[i + 1].rstrip() if i + 1 < len(lines) else ""
        after = lines[i + 2].rstrip() if i + 2 < len(lines) else ""
        if rule(s) and nxt.strip() and after == s:
            heading(s[0] * 2, nxt.strip())
            i += 3
        elif re.fullmatch(r"=+(?: +=+)+", s):  # a simple table
            cuts = [m.span() for m in re.finditer("=+", s)]
            rows: list[list[str]] = []
            i += 1
            while i < len(lines) and lines[i].strip():
                if not re.fullmatch(r"[=\- ]+", lines[i].strip()):
                    rows.append([lines[i][a : b if k + 1 < len(cuts) else None].strip() for k, (a, b) in enumerate(cuts)])
                i += 1
            out += ["", *_table(rows), ""]
        elif re.fullmatch(r"\+(?:[-=]+\+)+", s.strip()):  # a grid table
            rows, now = [], None
            while i < len(lines) and lines[i].strip().startswith(("+", "|")):
                x = lines[i].strip()
                if x.startswith("+"):
                    rows += [now] if now else []
                    now = None
                else:
                    cells = [c.strip() for c in x.strip("|").split("|")]
                    now = [f"{a} {b}".strip() for a, b in zip(now, cells)] if now and len(now) == len(cells) else cells
                i += 1
            out += ["", *_table(rows), ""]
        elif s.strip() and not s.startswith(" ") and rule(nxt) and len(nxt) >= min(len(s), 4) and not rule(s):
            heading(nxt[0], s)
            i += 2
        elif re.match(r"\.\. ", s) or s == "..":
            shows = re.match(r"\.\. (?:code|code-block|sourcecode|parsed-literal)::", s)
            i += 1
            body = []
            while i < len(lines) and (not lines[i].strip() or lines[i].startswith(" ")):
                body.append(lines[i].strip())
                i += 1
            kept = [x for x in body if not re.match(r":[\w-]+:", x)]
            if shows:
                out += ["```", *kept, "```"]
            elif re.match(r"\.\. (?:note|warning|tip|important|caution|hint|attention|danger|error|admonition)::", s):
                out += [*([s.split("::", 1)[1].strip()] if s.split("::", 1)[1].strip() else []), *kept, ""]
        else:
            s = re.sub(r"``([^`]+)``", r"`\1`", s)
            s = re.sub(r"`([^`<]+?)\s*<([^>]+)>`__?", r"[\1](\2)", s)
            s = re.sub(r":[\w:+-]+:`([^`]+)`", r"\1", s)
            s = re.sub(r"^(\s*)#\.\s", r"\g<1>1. ", s)
            out.append(re.sub(r"::$", ":", s))
            i += 1
    return "\n".join(out)


def _table(rows: list[list[str]]) -> list[str]:
    line = lambda r: "| " + " | ".join(r) + " |"
    return [line(rows[0]), "|" + "---|" * len(rows[0]), *map(line, rows[1:])] if rows else []


def read_org(text: str) -> Iterator[dict]:
    yield from read_markdown(org_to_markdown(text))


def read_rst(text: str) -> Iterator[dict]:
    yield from read_markdown(rst_to_markdown(text))
