"""Decoders of single files into chunk trees, with the standard library: run on executors, file by file."""

from __future__ import annotations

import csv
import io
import json
import re
import tomllib
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from ..functions.markup import LenientParser
from ..functions.splitting import word_len
from ..operators.markdown import parse_blocks
from ..operators.render import Node
from .files import OOXML


def root_node(doc_id: str, mimetype: str) -> Node:
    return Node(doc_id, "root", None, None, mimetype)


def node_rows(root: Node, doc_id: str, location: str, error: str | None) -> Iterator[dict]:
    """Rows of a tree with ids that a repeated run makes again."""
    todo: list[tuple[Node, str | None, tuple[int, ...]]] = [(root, None, (0,))]
    while todo:
        n, parent, path = todo.pop()
        me = doc_id if parent is None else f"{doc_id}/{'.'.join(map(str, path[1:]))}"
        yield {
            "doc_id": doc_id, "location": location, "chunk_id": me, "parent_id": parent, "ord": path[-1], "path": list(path), "ctype": n.ctype, "mimetype": n.mimetype, "content": n.content if isinstance(n.content, str) else None,
            "content_bytes": n.content if isinstance(n.content, bytes) else None, "text": n.text, "metadata": json.dumps(n.metadata, sort_keys=True) if n.metadata else None, "error": error,
        }
        todo += [(c, me, (*path, k)) for k, c in reversed(list(enumerate(n.children)))]


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def _leaf(ctype: str, content: str | bytes, mimetype: str = "text/plain", text: str | None = None, **meta) -> Node:
    return Node("", ctype, content, text, mimetype, None, meta)


def parse_text(data: bytes, path: str) -> Node:
    return root_node("", "text/plain").add(_leaf("div", _text(data)))


def csv_line(row: list) -> str:
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_MINIMAL, escapechar="\\", doublequote=True).writerow(row)
    return out.getvalue().strip()


def parse_csv(data: bytes, path: str) -> Node:
    """A table of rows, each written anew as CSV; the dialect is guessed from the beginning of the file; a broken end leaves the rows before it."""
    whole = data.decode("utf-8", "replace")
    try:
        dialect = csv.Sniffer().sniff(whole[:1024])
    except csv.Error:
        dialect = csv.excel
    rows: list[list[str]] = []
    reader = csv.reader(io.StringIO(whole, newline=""), dialect)
    try:
        rows.extend(reader)
    except csv.Error:
        pass
    table = _leaf("table", "", merged_cells=[], first_row_with_data=0, last_row_with_data=len(rows) - 1)
    table.add(*[_leaf("tablerow", csv_line(r), row_number=k) for k, r in enumerate(rows)])
    return root_node("", "text/csv").add(table)


def parse_json(data: bytes, path: str) -> Node:
    return root_node("", "application/json").add(_leaf("div", repr(json.loads(_text(data)))))


def parse_toml(data: bytes, path: str) -> Node:
    return root_node("", "application/toml").add(_leaf("div", repr(tomllib.loads(_text(data)))))


def parse_yaml(data: bytes, path: str) -> Node:
    import yaml

    return root_node("", "application/yaml").add(_leaf("div", repr(yaml.safe_load(_text(data)))))


def parse_markdown(data: bytes, path: str) -> Node:
    return parse_blocks(_text(data), root_node("md", "text/markdown"))


def parse_ipynb(data: bytes, path: str) -> Node:
    """Cells of a notebook: markdown as blocks, code and its text output as code."""
    root = root_node("nb", "application/x-ipynb+json")
    for cell in json.loads(_text(data)).get("cells", []):
        source = "".join(cell.get("source", []))
        if cell.get("cell_type") == "markdown":
            root.add(*parse_blocks(source, Node("c", "div")).children)
        elif source.strip():
            root.add(_leaf("code" if cell.get("cell_type") == "code" else "para", source))
        for out in cell.get("outputs", []):
            text = "".join(out.get("text") or out.get("data", {}).get("text/plain") or [])
            if text.strip():
                root.add(_leaf("code", text.rstrip("\n"), output=True))
    return root


SILENT = {"script", "style", "meta", "link", "head", "template", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "main", "nav", "footer", "header", "aside", "ul", "ol", "li", "table", "tr", "pre", "blockquote", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "body", "html", "form", "caption"}


class _HtmlTree(LenientParser):
    """Headings hold what follows them by level; paragraphs, lists, tables, code; hidden and empty elements go."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = root_node("html", "text/html")
        self.heads: list[tuple[int, Node]] = [(0, self.root)]
        self.open: list[tuple[str, bool]] = []
        self.part: list[str] = []
        self.kind, self.level = "para", 0
        self.lists: list[tuple[Node, str]] = []
        self.row: list[str] | None = None
        self.table: Node | None = None

    @property
    def hidden(self) -> bool:
        return any(h for _, h in self.open)

    def flush(self) -> None:
        raw, self.part = "".join(self.part), []
        # white space is that of HTML: no-break spaces stay
        text = raw.strip("\n") if self.kind == "code" else re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f]+", " ", raw)).strip(" \n")
        if self.row is not None or not (text if self.kind == "code" else text.strip()):
            if self.row is not None and raw:
                self.part = [raw]
            return
        if self.kind == "header":
            while self.heads[-1][0] >= self.level:
                self.heads.pop()
            h = _leaf("header", text, level=self.level)
            self.heads[-1][1].add(h)
            self.heads.append((self.level, h))
        elif self.kind == "list" and self.lists:
            box, style = self.lists[-1]
            marker = "-" if style == "ul" else f"{len(box.children) + 1}."
            box.add(_leaf("list", marker).add(_leaf("inline", text)))
        else:
            self.heads[-1][1].add(_leaf("code" if self.kind == "code" else "para", text))
        self.kind = "list" if self.lists else "para"

    def handle_starttag(self, tag, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        style = a.get("style", "").replace(" ", "").lower()
        if tag == "br":
            self.part.append("\n" if self.part and not self.part[-1].endswith("\n") else "")
        if tag in VOID:
            return
        self.open.append((tag, tag in SILENT or "hidden" in a or "display:none" in style or "visibility:hidden" in style))
        if self.hidden or tag not in BLOCKS:
            if tag in ("td", "th") and self.row is not None:
                self.part = []
            return
        self.flush()
        if re.fullmatch(r"h[1-6]", tag):
            self.kind, self.level = "header", int(tag[1])
        elif tag == "pre":
            self.kind = "code"
        elif tag in ("ul", "ol"):
            box = _leaf("list", "")
            if self.lists and self.lists[-1][0].children:
                self.lists[-1][0].children[-1].add(box)
            else:
                self.heads[-1][1].add(box)
            self.lists.append((box, tag))
            self.kind = "list"
        elif tag == "table":
            self.table = _leaf("table", "")
        elif tag == "tr" and self.table is not None:
            self.row = []
        elif tag == "p":
            self.kind = "list" if self.lists else "para"

    def handle_endtag(self, tag) -> None:
        if tag in ("td", "th") and self.row is not None:
            self.row.append(" ".join("".join(self.part).split()))
            self.part = []
        if tag == "tr" and self.row is not None:
            if any(self.row):
                self.table.add(_leaf("tablerow", csv_line(self.row), row_number=len(self.table.children)))
            self.row, self.part = None, []
        if tag == "table" and self.table is not None:
            rows = self.table.children
            if len(rows) == 1 and "," not in rows[0].content:
                self.heads[-1][1].add(_leaf("para", rows[0].content))
            elif rows:
                self.heads[-1][1].add(self.table)
            self.table = None
        if tag in BLOCKS and not self.hidden:
            self.flush()
            if re.fullmatch(r"h[1-6]|pre", tag):
                self.kind = "list" if self.lists else "para"
            if tag in ("ul", "ol") and self.lists:
                box = self.lists.pop()[0]
                if not box.children and box.parent:
                    box.parent.children.remove(box)
                self.kind = "list" if self.lists else "para"
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if not self.hidden and (self.table is None or self.row is not None):
            self.part.append(data)


def parse_html(data: bytes, path: str) -> Node:
    p = _HtmlTree()
    p.feed(_text(data))
    p.close()
    p.row = None
    p.flush()
    return p.root


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element:
    return ET.fromstring(z.read(name))


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attr(e: ET.Element | None, name: str) -> str | None:
    return None if e is None else next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _find(e: ET.Element, *path: str) -> ET.Element | None:
    for want in path:
        e = next((c for c in e if _local(c) == want), None)
        if e is None:
            return None
    return e


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e.iter() if _local(c) == name]


def convert_cell(value: str | None, kind: str | None) -> str:
    """A cell's text: line ends as \\n, whole numbers without decimals, errors empty."""
    if value is None or kind == "e":
        return ""
    if kind in ("s", "str", "inlineStr"):
        return value.replace("\n", "\\n")
    try:
        x = float(value)
    except ValueError:
        return value
    return str(int(x)) if x.is_integer() else repr(x)


def _column(ref: str) -> int:
    out = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def parse_xlsx(data: bytes, path: str) -> Node:
    """A header for each sheet, its used rows as CSV rows of one width; merged cells count from the first used row."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = ["".join(t.text or "" for t in _all(si, "t")) for si in _xml(z, "xl/sharedStrings.xml") if _local(si) == "si"] if "xl/sharedStrings.xml" in names else []
    targets = {_attr(r, "Id"): _attr(r, "Target").lstrip("/") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
    root = root_node("", OOXML + "spreadsheetml.sheet")
    for sheet in _all(_xml(z, "xl/workbook.xml"), "sheet"):
        rid = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
        target = targets[rid] if targets[rid].startswith("xl/") else "xl/" + targets[rid]
        e = _xml(z, target)
        rows: dict[int, dict[int, str]] = {}
        for k, row in enumerate(_all(e, "row")):
            at = int(_attr(row, "r") or k + 1) - 1
            for j, c in enumerate(x for x in row if _local(x) == "c"):
                kind, v = _attr(c, "t"), _find(c, "v")
                raw = "".join(t.text or "" for t in _all(c, "t")) if kind == "inlineStr" else (v.text if v is not None else None)
                if kind == "s" and raw is not None:
                    raw = shared[int(raw)]
                cell = convert_cell(raw, kind)
                if cell:
                    rows.setdefault(at, {})[_column(_attr(c, "r")) if _attr(c, "r") else j] = cell
        head = _leaf("header", _attr(sheet, "name") or "", level=1)
        root.add(head)
        if not rows:
            continue
        first, last, width = min(rows), max(rows), max(max(r) for r in rows.values()) + 1
        merged = []
        for m in _all(e, "mergeCell"):
            a, _, b = (_attr(m, "ref") or "").partition(":")
            num = lambda ref: int(re.search(r"\d+", ref)[0]) - 1 - first
            merged.append([num(a), _column(a), num(b or a), _column(b or a)])
        table = _leaf("table", "", merged_cells=merged, first_row_with_data=first, last_row_with_data=last)
        for k in range(first, last + 1):
            table.add(_leaf("tablerow", csv_line([rows.get(k, {}).get(j, "") for j in range(width)]), row_number=k - first))
        head.add(table)
    for n in sorted(names):
        if n.startswith("xl/media/"):
            root.add(_leaf("figure", z.read(n), _image_type(n)))
        elif re.fullmatch(r"xl/drawings/drawing\d+\.xml", n):
            text = "\n".join(t.text for t in _all(_xml(z, n), "t") if t.text)
            if text:
                root.add(_leaf("para", text))
    return root


def _image_type(name: str) -> str:
    return "image/jpeg" if name.lower().endswith((".jpg", ".jpeg")) else "image/png"


def markdown_table(rows: list[list[str]]) -> str:
    """A pipe table with a separator below the first row; pipes are escaped."""
    lines = ["| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]]) if lines else ""


def parse_pptx(data: bytes, path: str) -> Node:
    """A div for each slide, shapes from top to bottom and left to right: titles, text with bullets by level, tables, pictures, notes."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    root = root_node("", OOXML + "presentationml.presentation")
    slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    for k, name in enumerate(slides, 1):
        slide = _leaf("div", f"**Slide {k}**", page_num=k)
        rel = name.replace("slides/", "slides/_rels/") + ".rels"
        links = {_attr(r, "Id"): _attr(r, "Target") for r in _xml(z, rel)} if rel in names else {}
        shapes = []
        for sp in (e for e in _xml(z, name).iter() if _local(e) in ("sp", "pic", "graphicFrame")):
            off = next(iter(_all(sp, "off")), None)
            shapes.append((int(_attr(off, "y") or 0), int(_attr(off, "x") or 0), len(shapes), sp))
        for *_, sp in sorted(shapes, key=lambda s: s[:3]):
            if _local(sp) == "pic":
                rid = next((v for b in _all(sp, "blip") for q, v in b.attrib.items() if q.endswith("}embed")), None)
                media = "ppt/" + links[rid].replace("../", "") if rid in links else None
                alt = " ".join((_attr(next(iter(_all(sp, "cNvPr")), None), "descr") or "").split())
                if media in names:
                    slide.add(_leaf("figure", z.read(media), _image_type(media), alt or None))
            elif tables := _all(sp, "tbl"):
                rows = [["".join(t.text or "" for t in _all(tc, "t")) for tc in _all(tr, "tc")] for tr in _all(tables[0], "tr")]
                slide.add(_leaf("table", markdown_table(rows)))
            else:
                title = _attr(next(iter(_all(sp, "ph")), None), "type") in ("title", "ctrTitle")
                lines = []
                for p in _all(sp, "p"):
                    text = "".join(t.text or "" for t in _all(p, "t"))
                    level = int(_attr(_find(p, "pPr"), "lvl") or 0)
                    if text.strip():
                        lines.append("  " * level + ("- " if level else "") + text)
                if lines:
                    slide.add(_leaf("header" if title else "para", "\n".join(lines)))
        note = next((t for t in links.values() if t and "notesSlide" in t), None)
        if note and "ppt/" + note.replace("../", "") in names:
            text = "\n".join(t for p in _all(_xml(z, "ppt/" + note.replace("../", "")), "p") if (t := "".join(x.text or "" for x in _all(p, "t")).strip()))
            if text:
                slide.add(_leaf("para", "Notes: " + text))
        root.add(slide)
    return root


def _nest(root: Node, parts: list[tuple[int, Node]]) -> Node:
    """Headers (level above 0) hold what follows them."""
    heads: list[tuple[int, Node]] = [(0, root)]
    for level, n in parts:
        if level:
            while heads[-1][0] >= level:
                heads.pop()
        heads[-1][1].add(n)
        if level:
            heads.append((level, n))
    return root


def parse_docx(data: bytes, path: str) -> Node:
    """Headings by style, list paragraphs, tables as CSV rows, pictures at the end."""
    z = zipfile.ZipFile(io.BytesIO(data))
    parts: list[tuple[int, Node]] = []
    body = _find(_xml(z, "word/document.xml"), "body")
    numbers: dict[int, int] = {}
    for e in [] if body is None else body:
        if _local(e) == "p":
            text = "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_local(x), "") for x in e.iter()).strip()
            if not text:
                continue
            style = _attr(_find(e, "pPr", "pStyle"), "val") or ""
            m = re.fullmatch(r"(?:Heading|heading)\s*(\d)|(Title)", style)
            if m:
                parts.append((int(m[1] or 1), _leaf("header", text, level=int(m[1] or 1))))
            elif _find(e, "pPr", "numPr") is not None:
                depth = int(_attr(_find(e, "pPr", "numPr", "ilvl"), "val") or 0)
                numbers[depth] = numbers.get(depth, 0) + 1
                parts.append((0, _leaf("list", "-", indent=depth).add(_leaf("inline", text))))
            else:
                parts.append((0, _leaf("para", text)))
        elif _local(e) == "tbl":
            table = _leaf("table", "")
            for k, tr in enumerate(_all(e, "tr")):
                table.add(_leaf("tablerow", csv_line([" ".join("".join(t.text or "" for t in _all(tc, "t")).split()) for tc in tr if _local(tc) == "tc"]), row_number=k))
            parts.append((0, table))
    parts += [(0, _leaf("figure", z.read(n), _image_type(n))) for n in sorted(z.namelist()) if n.startswith("word/media/")]
    return _nest(root_node("", OOXML + "wordprocessingml.document"), parts)


def parse_odt(data: bytes, path: str) -> Node:
    z = zipfile.ZipFile(io.BytesIO(data))
    parts: list[tuple[int, Node]] = []
    body = next(iter(_all(_xml(z, "content.xml"), "text")), None)
    for e in [] if body is None else body:
        text = "".join(e.itertext()).strip()
        if _local(e) == "h" and text:
            level = int(_attr(e, "outline-level") or 1)
            parts.append((level, _leaf("header", text, level=level)))
        elif _local(e) == "list":
            parts += [(0, _leaf("list", "-").add(_leaf("inline", t))) for item in _all(e, "list-item") if (t := "".join(item.itertext()).strip())]
        elif _local(e) == "table":
            table = _leaf("table", "")
            table.add(*[_leaf("tablerow", csv_line(["".join(c.itertext()).strip() for c in row if _local(c) == "table-cell"]), row_number=k) for k, row in enumerate(_all(e, "table-row"))])
            parts.append((0, table))
        elif text:
            parts.append((0, _leaf("para", text)))
    parts += [(0, _leaf("figure", z.read(n), _image_type(n))) for n in sorted(z.namelist()) if n.startswith("Pictures/")]
    return _nest(root_node("", "application/vnd.oasis.opendocument.text"), parts)


def parse_epub(data: bytes, path: str) -> Node:
    """The HTML files in the order of the spine."""
    z = zipfile.ZipFile(io.BytesIO(data))
    opf = next(_attr(r, "full-path") for r in _all(_xml(z, "META-INF/container.xml"), "rootfile"))
    e, base = _xml(z, opf), opf.rpartition("/")[0]
    items = {_attr(i, "id"): _attr(i, "href") for i in _all(e, "item")}
    root = root_node("", "application/epub+zip")
    for ref in _all(e, "itemref"):
        href = items.get(_attr(ref, "idref"))
        if href and href.endswith(("html", "htm")):
            root.add(*parse_html(z.read(f"{base}/{href}" if base else href), href).children)
    return root


def parse_rtf(data: bytes, path: str) -> Node:
    """Paragraphs of plain text; groups of fonts, styles and pictures go."""
    text = data.decode("latin-1")
    out, stack, skip, i = [], [], False, 0
    token = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}]+)")
    for m in token.finditer(text):
        word, num, hexa, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict"):
            skip = True
        elif skip:
            continue
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word == "u" and num:
            out.append(chr(int(num) % 65536))
            i = 1
        elif hexa:
            if not i:
                out.append(bytes.fromhex(hexa).decode("cp1252", "replace"))
            i = 0
        elif sign in ("\\", "{", "}"):
            out.append(sign)
        elif plain:
            out.append(plain.replace("\r", "").replace("\n", "")[i:])
            i = 0
    root = root_node("", "application/rtf")
    return root.add(*[_leaf("para", p.strip()) for p in "".join(out).split("\n") if p.strip()])


def _marked(headings: re.Pattern, level_of):
    """A parser of line markup: lines that match are headings, blank lines end paragraphs."""

    def parse(data: bytes, path: str) -> Node:
        parts: list[tuple[int, Node]] = []
        for block in re.split(r"\n\s*\n", _text(data)):
            para: list[str] = []
            for line in block.split("\n"):
                m = headings.match(line)
                if m:
                    if para:
                        parts.append((0, _leaf("para", "\n".join(para).strip())))
                        para = []
                    level, title = level_of(m)
                    parts.append((level, _leaf("header", title, level=level)))
                else:
                    para.append(line)
            if "\n".join(para).strip():
                parts.append((0, _leaf("para", "\n".join(para).strip())))
        return _nest(root_node("", "text/plain"), parts)

    return parse


parse_org = _marked(re.compile(r"(\*+) +(.*)"), lambda m: (len(m[1]), m[2].strip()))
parse_tex = _marked(re.compile(r"\s*\\(part|chapter|section|subsection|subsubsection)\*?\{([^}]*)\}"), lambda m: (["part", "chapter", "section", "subsection", "subsubsection"].index(m[1]) + 1, m[2].strip()))


def parse_rst(data: bytes, path: str) -> Node:
    """Titles underlined by a sign; levels by the order in which signs appear."""
    lines, signs, out = _text(data).split("\n"), [], []
    i = 0
    while i < len(lines):
        under = lines[i + 1] if i + 1 < len(lines) else ""
        if lines[i].strip() and re.fullmatch(r"([=\-~^\"'`#*+.:_])\1{2,}", under.strip()) and len(under.strip()) >= len(lines[i].strip()):
            s = under.strip()[0]
            if s not in signs:
                signs.append(s)
            out.append("*" * (signs.index(s) + 1) + " " + lines[i].strip())
            i += 2
        else:
            out.append(lines[i])
            i += 1
    return parse_org("\n".join(out).encode(), path)


BUILTIN = {
    "text/plain": [parse_text], "text/html": [parse_html, parse_text], "text/markdown": [parse_markdown, parse_text], "text/x-rst": [parse_rst, parse_text], "text/org": [parse_org, parse_text], "text/x-tex": [parse_tex, parse_text],
    "text/csv": [parse_csv, parse_text], "application/json": [parse_json, parse_text], "application/toml": [parse_toml, parse_text], "application/yaml": [parse_yaml, parse_text], "application/x-yaml": [parse_yaml, parse_text],
    "application/x-ipynb+json": [parse_ipynb, parse_text], OOXML + "wordprocessingml.document": [parse_docx], OOXML + "presentationml.presentation": [parse_pptx], OOXML + "spreadsheetml.sheet": [parse_xlsx],
    "application/vnd.oasis.opendocument.text": [parse_odt], "application/rtf": [parse_rtf], "text/rtf": [parse_rtf], "application/epub+zip": [parse_epub],
}


def longest_leaf(root: Node) -> int:
    """Words of the longest node, for deciding how to chunk."""
    return max(word_len(n.own) for _, n in root.walk())
