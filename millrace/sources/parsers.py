"""Files to elements: a registry of parsers by extension, run in Arrow batches.

A parser takes a file's bytes or text and yields element dictionaries. A row whose type is
unknown, or whose parser fails, gives one fallback element, so that no document is lost.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELDS = {
    "element_type": T.StringType(), "text": T.StringType(), "level": T.IntegerType(), "ordered": T.BooleanType(), "item_number": T.StringType(),
    "markdown_representation": T.StringType(), "caption": T.StringType(), "code": T.StringType(), "language": T.StringType(), "page_number": T.IntegerType(),
}
ELEMENT = T.StructType([T.StructField(n, t) for n, t in _FIELDS.items()])
_ARROW = {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_()}


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def pipe_table(rows: list[list[str]], spaced: bool = False) -> str:
    """Rows as a Markdown table, the first one being the header; with spaces in the separator if they are asked for."""
    width = max(map(len, rows))
    filled = [[c.replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in filled]
    rule = ["---"] * width
    return "\n".join([lines[0], "| " + " | ".join(rule) + " |" if spaced else "|" + "|".join(rule) + "|", *lines[1:]])


def text_elements(content: str) -> Iterator[dict]:
    """One narrative element for the whole text."""
    if content.strip():
        yield {"element_type": "narrative_text", "text": content.strip()}


_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
_BULLET = re.compile(r"(\s*)(?:([-*+])|(\d+)[.)])\s+(.*)")
_RULE = re.compile(r"\s*(?:-{3,}|\*{3,}|_{3,})\s*$")
_SEPARATOR = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def markdown_elements(content: str) -> Iterator[dict]:
    """Headings, paragraphs, nested list items with level and number, tables, code, rules and quotations."""
    lines, i, held = content.splitlines(), 0, []

    def paragraph():
        text = "\n".join(held).strip()
        held.clear()
        return [{"element_type": "narrative_text", "text": text}] if text else []

    while i < len(lines):
        line = lines[i]
        if fence := re.match(r"\s*(```+|~~~+)\s*(\S*)", line):
            yield from paragraph()
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(fence[1])), len(lines))
            yield {"element_type": "code_block", "code": "\n".join(lines[i + 1 : end]), "language": fence[2] or None}
            i = end
        elif m := _HEADING.match(line):
            yield from paragraph()
            yield {"element_type": "title", "text": m[2], "level": len(m[1])}
        elif _RULE.match(line) and not held:
            yield {"element_type": "page_break"}
        elif m := _BULLET.match(line):
            yield from paragraph()
            level = len(m[1].expandtabs(4)) // 2
            yield {"element_type": "list_item", "text": m[4].strip(), "level": level, "ordered": m[3] is not None, "item_number": m[3]}
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _SEPARATOR.match(lines[i + 1]):
            yield from paragraph()
            end = next((j for j in range(i + 2, len(lines)) if "|" not in lines[j]), len(lines))
            rows = [[c.strip() for c in re.split(r"(?<!\\)\|", re.sub(r"^\s*\||\|\s*$", "", r))] for r in [line, *lines[i + 2 : end]]]
            yield {"element_type": "table", "markdown_representation": pipe_table(rows)}
            i = end - 1
        elif line.lstrip().startswith(">"):
            yield from paragraph()
            end = next((j for j in range(i, len(lines)) if not lines[j].lstrip().startswith(">")), len(lines))
            yield {"element_type": "narrative_text", "text": "\n".join(re.sub(r"^\s*>\s?", "", x) for x in lines[i:end]).strip()}
            i = end - 1
        elif line.strip():
            held.append(line)
        else:
            yield from paragraph()
        i += 1
    yield from paragraph()


#: Tags that hold nothing to read (fixed values).
IGNORED = {"script", "style", "nav", "footer", "header", "aside", "form", "meta", "link", "button", "input", "noscript", "iframe", "canvas", "svg", "path"}
#: Tags that hold blocks, so that text before and after them stays apart (fixed values).
CONTAINERS = {"div", "section", "article", "main", "body", "figure", "figcaption", "details", "summary"}
#: Tags that never have content (fixed values of the language).
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Tags that are elements of their own.
_BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "table", "pre", "blockquote", "hr"}


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent", "holds_block")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.children, self.parent, self.holds_block = tag, attrs, [], parent, False

    def find(self, tag: str):
        stack = [self]
        while stack:
            node = stack.pop()
            if node.tag == tag:
                return node
            stack += [c for c in reversed(node.children) if isinstance(c, _Node)]
        return None

    def all(self, tags: tuple[str, ...]) -> list:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.tag in tags and node is not self:
                out.append(node)
            stack += [c for c in reversed(node.children) if isinstance(c, _Node)]
        return out

    def text(self, skip: tuple[str, ...] = ()) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in IGNORED and (node is self or node.tag not in skip):
                stack += reversed(node.children)
        return "".join(out)


class _Tree(HTMLParser):
    """A tree of any HTML: what isn't closed ends with its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.open: dict[str, int] = {}  # how many of a tag are open

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS or tag in CONTAINERS:  # a block ends an open paragraph, and with it what is open inside
            self._end("p", ("li", "td", "th", "blockquote", *CONTAINERS))
        if tag in ("li", "td", "th", "tr"):
            self._end(tag, ("ul", "ol", "table"))
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag in _BLOCKS:
            above = self.at
            while above is not None and not above.holds_block:
                above.holds_block, above = True, above.parent
        if tag not in _VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def _end(self, tag, within=()):
        if not self.open.get(tag):
            return
        node = self.at
        while node is not None and node.tag != tag and node.tag not in within:
            node = node.parent
        if node is not None and node.tag == tag and node.parent is not None:
            while self.at is not node.parent:
                self.open[self.at.tag] -= 1
                self.at = self.at.parent

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        self.at.children.append(data)


def html_elements(content: str) -> Iterator[dict]:
    """Elements of the main part: article, else main, else body, else all of the page."""
    tree = _Tree()
    tree.feed(content)
    tree.close()
    root = tree.root
    main = root.find("article") or root.find("main") or root.find("body") or root
    yield from _blocks(main)


def _blocks(node: _Node) -> Iterator[dict]:
    """Elements below a node in reading order; loose text between blocks is narrative."""
    loose: list[str] = []
    stack: list = list(reversed(node.children))

    def flush():
        text = _squeezed("".join(loose))
        loose.clear()
        return [{"element_type": "narrative_text", "text": text}] if text else []

    while stack:
        child = stack.pop()
        if isinstance(child, str):
            loose.append(child)
        elif child.tag in IGNORED:
            continue
        elif child.tag in _BLOCKS:
            yield from flush()
            yield from _block(child)
        elif child.tag in CONTAINERS or child.holds_block:
            yield from flush()
            stack.append(_Node("br", {}, None))
            stack += reversed(child.children)
        elif child.tag == "br":
            loose.append("\n")
            if not child.parent:
                yield from flush()
        else:
            loose.append(child.text())
    yield from flush()


def _block(node: _Node) -> Iterator[dict]:
    tag = node.tag
    if tag == "hr":
        yield {"element_type": "page_break"}
    elif tag in ("ul", "ol"):
        yield from _items(node, 0)
    elif tag == "table":
        rows, caption = _table_rows(node), node.find("caption")
        said = (_squeezed(caption.text()) or None) if caption else None
        if rows or said:
            yield {"element_type": "table", "markdown_representation": pipe_table(rows, spaced=True) if rows else "", "caption": said}
    elif tag == "pre":
        code = node.find("code")
        classes = ((code.attrs.get("class") if code else "") or node.attrs.get("class") or "").split()
        language = next((c.split("-", 1)[1] for c in classes if c.startswith(("language-", "lang-"))), None)
        if text := node.text().strip("\n"):
            yield {"element_type": "code_block", "code": text, "language": language}
    elif text := _squeezed(node.text()):
        yield {"element_type": "title", "text": text, "level": int(tag[1])} if tag[0] == "h" else {"element_type": "narrative_text", "text": text}


def _items(node: _Node, level: int) -> Iterator[dict]:
    """The items of a list and of the lists in them, however deep, in reading order."""

    def begun(of: _Node, level: int) -> list:
        return [of, iter(of.children), int(of.attrs["start"]) if str(of.attrs.get("start") or "").isdigit() else 1, level]

    stack = [begun(node, level)]
    waiting: list[list] = [[]]  # lists within the item that was last told
    while stack:
        if waiting[-1]:
            stack.append(begun(waiting[-1].pop(0), stack[-1][3] + 1))
            waiting.append([])
            continue
        own, children, number, deep = stack[-1]
        child = next((c for c in children if isinstance(c, _Node) and c.tag == "li"), None)
        if child is None:
            stack.pop()
            waiting.pop()
            continue
        if text := _squeezed(child.text(skip=("ul", "ol"))):
            yield {"element_type": "list_item", "text": text, "level": deep, "ordered": own.tag == "ol", "item_number": str(number) if own.tag == "ol" else None}
        stack[-1][2] = number + 1
        waiting[-1] = [c for c in child.children if isinstance(c, _Node) and c.tag in ("ul", "ol")]


def _table_rows(table: _Node) -> list[list[str]]:
    """Cells of all rows, those of the head first; without a head the first row is the header."""
    rows = [[_squeezed(c.text()) for c in tr.all(("td", "th"))] for tr in table.all(("tr",))]
    return [r for r in rows if r]


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


_DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}docPr"


def docx_elements(content: bytes) -> Iterator[dict]:
    """Headers, titles, list items with their numbers, paragraphs, code, tables, images, page breaks and footers of a Word file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted(z.namelist())
        part = lambda name: ElementTree.fromstring(z.read(name))
        body = part("word/document.xml").find(f"{_WORD}body")
        formats = _number_formats(part("word/numbering.xml")) if "word/numbering.xml" in names else {}
        edges = {kind: [part(n) for n in names if re.fullmatch(rf"word/{kind}\d*\.xml", n)] for kind in ("header", "footer")}
    yield from _edge_elements("header", edges["header"])
    counts: dict[tuple[str, int], int] = {}
    code: list[str] = []
    for e in body if body is not None else ():
        name, text = _style(e), "" if e.tag == f"{_WORD}tbl" else _said(e)
        if code and not (e.tag == f"{_WORD}p" and _CODE_STYLE.match(name)):
            yield {"element_type": "code_block", "code": "\n".join(code)}
            code.clear()
        if e.tag == f"{_WORD}tbl":
            rows = [[_said(c) for c in r.findall(f"{_WORD}tc")] for r in e.findall(f"{_WORD}tr")]
            if rows:
                yield {"element_type": "table", "markdown_representation": pipe_table(rows), "caption": "Table"}
        elif e.tag == f"{_WORD}p":
            if any(b.get(f"{_WORD}type") == "page" for b in e.iter(f"{_WORD}br")):
                yield {"element_type": "page_break"}
            for image in e.iter(_DRAWING):
                yield {"element_type": "image", "text": image.get("descr") or image.get("title") or image.get("name") or "Image"}
            if _CODE_STYLE.match(name):
                code.append("".join(t.text or "" for t in e.iter(f"{_WORD}t")))
            elif text and (m := re.match(r"(?:Heading|heading|Title)\s*(\d*)", name)):
                yield {"element_type": "title", "text": text, "level": int(m[1] or 1)}
            elif text and (e.find(f"{_WORD}pPr/{_WORD}numPr") is not None or name.startswith("List")):
                yield _word_item(e, name, text, formats, counts)
            elif text:
                yield {"element_type": "narrative_text", "text": text}
    if code:
        yield {"element_type": "code_block", "code": "\n".join(code)}
    yield from _edge_elements("footer", edges["footer"])


_CODE_STYLE = re.compile(r"(?i)(?:html ?preformatted|source ?code|code|plain ?text|macro ?text)")


def _said(e) -> str:
    return "".join(t.text or "" for t in e.iter(f"{_WORD}t")).strip()


def _style(e) -> str:
    style = e.find(f"{_WORD}pPr/{_WORD}pStyle")
    return (style.get(f"{_WORD}val") or "") if style is not None else ""


def _edge_elements(kind: str, parts: list) -> Iterator[dict]:
    """One element for each different header or footer with a text."""
    seen = set()
    for e in parts:
        text = " ".join(filter(None, (_said(p) for p in e.iter(f"{_WORD}p"))))
        if text and text not in seen:
            seen.add(text)
            yield {"element_type": kind, "text": text}


def _number_formats(numbering) -> dict[tuple[str, int], tuple[bool, int]]:
    """(list, level) to whether it is numbered, and from which number."""
    levels = {}
    for a in numbering.iter(f"{_WORD}abstractNum"):
        for level in a.iter(f"{_WORD}lvl"):
            kind, start = level.find(f"{_WORD}numFmt"), level.find(f"{_WORD}start")
            numbered = kind is not None and kind.get(f"{_WORD}val") not in ("bullet", "none")
            levels[a.get(f"{_WORD}abstractNumId"), int(level.get(f"{_WORD}ilvl") or 0)] = (numbered, int(start.get(f"{_WORD}val")) if start is not None else 1)
    out = {}
    for n in numbering.iter(f"{_WORD}num"):
        abstract = n.find(f"{_WORD}abstractNumId")
        out |= {(n.get(f"{_WORD}numId"), lvl): v for (i, lvl), v in levels.items() if abstract is not None and i == abstract.get(f"{_WORD}val")}
    return out


def _word_item(e, style: str, text: str, formats: dict, counts: dict) -> dict:
    """A list item with its level and, in a numbered list, its number; a higher level starts the lower ones anew."""
    mark = e.find(f"{_WORD}pPr/{_WORD}numPr")
    depth = mark.find(f"{_WORD}ilvl") if mark is not None else None
    which = mark.find(f"{_WORD}numId") if mark is not None else None
    level = int(depth.get(f"{_WORD}val")) if depth is not None else 0
    number = which.get(f"{_WORD}val") if which is not None else ""
    ordered, start = formats.get((number, level), (style.startswith("ListNumber"), 1))
    for key in [k for k in counts if k[0] == number and k[1] > level]:
        del counts[key]
    counts[number, level] = counts.get((number, level), start - 1) + 1
    return {"element_type": "list_item", "text": text, "level": level, "ordered": ordered, "item_number": str(counts[number, level]) if ordered else None}


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


_OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats of dates and times (fixed values of the file format).
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58)


def _date_styles(z: zipfile.ZipFile, names: set[str]) -> set[int]:
    """The cell styles whose number format is that of a date or a time."""
    if "xl/styles.xml" not in names:
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    # letters of dates outside of quoted text, colours, conditions and escaped characters
    own = {int(f.get("numFmtId")): re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", f.get("formatCode") or ""), re.I) is not None for f in root.iter(f"{_SHEET}numFmt")}
    cells = root.find(f"{_SHEET}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else []) if own.get(n := int(x.get("numFmtId") or 0), n in DATE_FORMATS)}


def _moment(serial: str, since_1904: bool) -> str:
    """A date's serial number as text; days before March 1900 count from a day later, as that calendar has a day too many."""
    days = float(serial)
    start = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 31 if days < 60 else 30)
    return str(start + datetime.timedelta(milliseconds=round(days * 86_400_000)))


def _sheet_files(z: zipfile.ZipFile, names: set[str]) -> list[tuple[str, str]]:
    """(name, file) of the workbook's sheets in the order of its tabs."""
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target") or ""
            targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    tabs = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"))
    if not targets:  # a workbook without relations: sheets by their numbers
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        return [(tabs[i].get("name") if i < len(tabs) else "", f) for i, f in enumerate(files)]
    found = [(t.get("name"), targets.get(t.get(f"{_OFFICE}id"))) for t in tabs]
    return [(name, file) for name, file in found if file in names and "worksheets/" in file]


def _sheet_rows(content: bytes, sheet: str | int | None = None) -> Iterator[tuple[int, str | None, Iterator[tuple[int, list[tuple[str, str]]]]]]:
    """(place from 1, name, rows as (number, cells)) of each sheet, or of one.

    A cell is its text and its kind: n(umber), d(ate), b(oolean), s (text); a blank one is an
    empty text. Rows are read from the file as they are asked for.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_SHEET}si")]
        dates = _date_styles(z, names)
        settings = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_SHEET}workbookPr")
        since_1904 = settings is not None and settings.get("date1904") in ("1", "true")

        def cell(c) -> tuple[str, str]:
            v, kind = c.find(f"{_SHEET}v"), c.get("t") or "n"
            if kind == "inlineStr":
                return "".join(t.text or "" for t in c.iter(f"{_SHEET}t")).strip(), "s"
            text = (v.text or "").strip() if v is not None else ""
            if not text or kind in ("str", "e"):
                return text, "s"
            if kind == "s":
                return shared[int(text)].strip(), "s"
            if kind == "b":
                return ("True" if text == "1" else "False"), "b"
            if kind == "d":
                return text.replace("T", " "), "d"
            return (_moment(text, since_1904), "d") if int(c.get("s") or 0) in dates else (text, "n")

        def rows(file: str) -> Iterator[tuple[int, list[tuple[str, str]]]]:
            last = 0
            with z.open(file) as opened:
                for _, row in ElementTree.iterparse(opened):
                    if row.tag != f"{_SHEET}row":
                        continue
                    cells: list[tuple[str, str]] = []
                    for c in row.findall(f"{_SHEET}c"):
                        at = 0
                        for ch in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                            at = 26 * at + ord(ch) - 64
                        at = at or len(cells) + 1
                        cells += [("", "s")] * (at - len(cells))
                        cells[at - 1] = cell(c)
                    last = int(row.get("r") or last + 1)
                    row.clear()
                    yield last, cells

        for page, (name, file) in enumerate(_sheet_files(z, names), 1):
            if sheet is None or sheet == name or sheet == page - 1 and not isinstance(sheet, bool):
                yield page, name, rows(file)


def xlsx_elements(content: bytes) -> Iterator[dict]:
    """A table for each block of rows between blank rows, sheet by sheet (page_number from 1)."""
    for page, title, rows in _sheet_rows(content):
        block, last = [], 0
        for number, told in rows:
            cells = [text for text, _ in told]
            if block and (number > last + 1 or not any(cells)):
                yield _sheet_table(block, title, page)
                block = []
            if any(cells):
                block.append(cells)
            last = number
        if block:
            yield _sheet_table(block, title, page)


def sheet_cells(content: bytes, sheet: str | int) -> Iterator[list[tuple[str, str]]]:
    """The rows of a sheet, named or by place from 0, that aren't blank; a ValueError if there is no such sheet."""
    for _, _, rows in _sheet_rows(content, sheet):
        for _, cells in rows:
            if any(text for text, _ in cells):
                yield cells
        return
    raise ValueError(f"no sheet {sheet!r}")


def column_names(header: list[str]) -> list[str]:
    """Names of a table's columns: those without one are called Unnamed: n, repeated names get .1, .2 and so on."""
    out, seen = [], {}
    for i, name in enumerate(header):
        name = name or f"Unnamed: {i}"
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
    return out


def number_or_none(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _sheet_table(block: list[list[str]], title: str | None, page: int) -> dict:
    caption = f"Sheet: {title}" if title else None
    return {"element_type": "table", "markdown_representation": pipe_table(block), "caption": caption, "page_number": page}


def pdf_elements(content: bytes) -> Iterator[dict]:
    """One narrative element for each page with page breaks between; needs the optional package pypdf."""
    from pypdf import PdfReader

    for i, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
        if i > 1:
            yield {"element_type": "page_break", "page_number": i}
        if text := (page.extract_text() or "").strip():
            yield {"element_type": "narrative_text", "text": text, "page_number": i}


#: Parsers by extension, and whether they take bytes; more can be registered.
REGISTRY = {
    ".txt": (text_elements, False), ".md": (markdown_elements, False), ".html": (html_elements, False), ".htm": (html_elements, False),
    ".docx": (docx_elements, True), ".xlsx": (xlsx_elements, True), ".pdf": (pdf_elements, True),
}


def register(extension: str, parser, takes_bytes: bool = False) -> None:
    REGISTRY[extension.lower()] = (parser, takes_bytes)


def elements_of(extension: str | None, content: bytes | str | None, registry: dict) -> list[dict]:
    """A file's elements, or one that says why there are none."""
    parser, takes_bytes = registry.get((extension or "").lower(), (None, False))
    nothing = [{"element_type": "narrative_text", "text": f"[Content Not Parsed: {extension}]"}]
    if parser is None or content is None:
        return nothing
    try:
        if takes_bytes:
            data = content if isinstance(content, bytes) else content.encode("utf-8")
        else:
            data = content.decode("utf-8", "replace") if isinstance(content, bytes) else content
        return list(parser(data)) or nothing
    except Exception as why:  # one bad file must not end the job
        return [{"element_type": "narrative_text", "text": f"[Critical Parsing Exception: {type(why).__name__}: {why}]"}]


def parsed(files: DataFrame, key: str, content: str, extension: str) -> DataFrame:
    """(key, idx, element fields) of each file; a file without elements gives one row that says so."""
    registry = dict(REGISTRY)
    schema = T.StructType([T.StructField(key, files.schema[key].dataType), T.StructField("idx", T.IntegerType()), *ELEMENT.fields])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keys, columns, places = [], {n: [] for n in _FIELDS}, []
                for i, (body, ext) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    for place, e in enumerate(elements_of(ext, body, registry)):
                        keys.append(i)
                        places.append(place)
                        for n in _FIELDS:
                            columns[n].append(e.get(n))
                arrays = [part.column(0).take(pa.array(keys, pa.int64())), pa.array(places, pa.int32())]
                arrays += [pa.array(columns[n], _ARROW[type(t)]) for n, t in _FIELDS.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return files.select(F.col(key), F.col(content), F.col(extension)).mapInArrow(run, schema)


def register_function(spark: SparkSession, name: str = "parse_files") -> None:
    """The parsers as a table function: ``SELECT * FROM parse_files(TABLE(SELECT id, content, extension ...))``.

    The table has three columns: a key of any type, which is given as text, a file's content (text or bytes) and its
    extension. Rows are (key, idx, element fields), as ``parsed`` gives them. Parsers that are
    registered later need the function registered anew.
    """
    registry = dict(REGISTRY)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("idx", T.IntegerType()), *ELEMENT.fields])

    class ParseFiles:
        def eval(self, row: Row):
            key, content, extension = row
            for place, element in enumerate(elements_of(extension, bytes(content) if isinstance(content, (bytes, bytearray)) else content, registry)):
                yield (None if key is None else str(key), place, *(element.get(n) for n in _FIELDS))

    spark.udtf.register(name, F.udtf(ParseFiles, returnType=schema))
