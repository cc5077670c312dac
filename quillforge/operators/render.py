"""A document's chunk tree as Python objects, and what needs the whole of it: cleaning, rendering, flattening.

The operators on DataFrames take node tables (see tree.NODE) and work document by document.
"""

from __future__ import annotations

import json
import textwrap
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.splitting import default_separators, length_function, split_repacked
from .arrow import arrow_schema, per_group

BLANK_LINE = "\n\n"


@dataclass(slots=True)
class Node:
    id: str
    ctype: str = "para"
    content: str | bytes | None = None
    text: str | None = None
    mimetype: str = "text/plain"
    summary: str | None = None
    metadata: dict = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    parent: Node | None = field(default=None, repr=False)

    def add(self, *children: Node) -> Node:
        for c in children:
            c.parent = self
            self.children.append(c)
        return self

    def walk(self, depth: int = 0) -> Iterator[tuple[int, Node]]:
        todo = [(depth, self)]
        while todo:
            d, n = todo.pop()
            yield d, n
            todo += [(d + 1, c) for c in reversed(n.children)]

    @property
    def own(self) -> str:
        return self.content if isinstance(self.content, str) else ""

    def headers_above(self) -> int:
        n, count = self.parent, 0
        while n:
            count, n = count + (n.ctype == "header"), n.parent
        return count


def build(rows: list[dict]) -> list[Node]:
    """The roots of one document's rows, children in order. A row whose parent isn't there is a root."""
    nodes = {}
    for r in rows:
        meta = r.get("metadata")
        nodes[r["chunk_id"]] = Node(r["chunk_id"], r["ctype"], r.get("content"), r.get("text"), r.get("mimetype") or "text/plain", r.get("summary"), json.loads(meta) if meta else {})
    roots = []
    for r in sorted(rows, key=lambda r: (r.get("ord") is None, r.get("ord"), r["chunk_id"])):
        parent = nodes.get(r.get("parent_id"))
        node = nodes[r["chunk_id"]]
        if parent is None or parent is node:
            roots.append(node)
        else:
            parent.add(node)
    return roots


def _gap(child: Node, current: object) -> str:
    if child.ctype == "inline":
        return " "
    if child.ctype in ("list", "tablerow"):
        return "\n"
    return BLANK_LINE if current else ""


def render_plain(node: Node) -> str:
    if node.text:
        return node.text
    out = node.own
    for c in node.children:
        if part := render_plain(c).strip():
            out += _gap(c, out) + part
    return out


def _heading(node: Node, level: int, text: str) -> str:
    return f"{'#' * level} {text}" if node.ctype == "header" and level > 0 and not text.startswith("#") else text


def render_markdown(node: Node, level: int | None = None) -> str:
    """Headings get a # for each header above and themselves, lists are indented by two, code is fenced once."""
    level = (node.headers_above() if level is None else level) + (node.ctype == "header")
    if node.text:
        out = node.text
    else:
        out = _heading(node, level, node.own)
        for c in node.children:
            part = textwrap.dedent(render_markdown(c, level).rstrip().lstrip("\n"))
            if not part:
                continue
            out += _gap(c, out) + (textwrap.indent(part, "  ") if c.ctype == "list" else part)
    if node.ctype == "code" and (body := out.strip()) and not body.startswith("```"):
        return f"```\n{body}\n```"
    return out


def render_multi(node: Node, compat: bool = False) -> list[str | dict]:
    """Strings and binary parts in order, neighbouring strings joined. The gap before a child depends on what stands before it, with ``compat`` on the node's own content only."""
    parts: list[str | dict] = []

    def put(x: str | dict) -> None:
        if isinstance(x, str) and parts and isinstance(parts[-1], str):
            parts[-1] += x
        elif x != "":
            parts.append(x)

    if node.ctype != "root" and node.content is not None:
        put(node.content if isinstance(node.content, str) else {"mimetype": node.mimetype, "text": node.summary or node.text, "content": node.content})
    own = node.content if node.ctype != "root" else None
    for c in node.children:
        inner = render_multi(c, compat)
        gap = _gap(c, own if compat else parts)
        if compat and c.ctype == "tablerow":
            gap = BLANK_LINE if own else ""
        if inner or compat:
            put(gap)
        for x in inner:
            put(x)
    return parts


def clean(node: Node) -> Node:
    """Bottom up: an empty node with one child takes the child's content, type and children over; metadata are merged, the child's first."""
    for _, n in reversed(list(node.walk())):
        if not n.content and len(n.children) == 1:
            c = n.children[0]
            n.mimetype, n.content = c.mimetype, c.content
            if c.ctype != "inline":
                n.ctype = c.ctype
            n.metadata = {**n.metadata, **c.metadata}
            n.children = []
            n.add(*c.children)
    return node


def flatten(node: Node, size: int = -1, length: Callable[[str], int] | str | None = None, separators: list[str] | None = None, level: int | None = None) -> list[tuple[str, list[str]]]:
    """(markdown, ids of the nodes in it): pieces of at most ``size``, -1 for no bound, in document order."""
    count = length_function(length)
    most = float("inf") if size == -1 else size
    level = (node.headers_above() if level is None else level) + (node.ctype == "header")
    ids = lambda n: [x.id for _, x in n.walk()]
    if node.text and count(node.text) < most:
        return [(node.text, ids(node))]
    out: list[tuple[str, list[str]]] = []
    held = [node.id]

    def cut(whole: str, owners: list[str]) -> str:
        """All but the last piece of a text that is too long go out."""
        if most == float("inf") or count(whole) <= most:
            return whole
        pieces = split_repacked(whole, separators or default_separators(whole, newlines_first=True), size, None, False, count) or [""]
        out.extend((p, list(owners)) for p in pieces[:-1])
        return pieces[-1]

    def whole() -> str:
        buffer[:] = ["".join(buffer)]
        return buffer[0]

    def close() -> None:
        if text := whole().strip("\n"):
            out.append((text, held))

    # the open piece, as parts that are joined only when its length counts, and never without a bound
    buffer = [cut(_heading(node, level, node.own), held)]
    for c in node.children:
        if c.children:
            for part, owners in flatten(c, size, length, separators, level):
                if most == float("inf") or count(whole()) + count(BLANK_LINE) + count(part) <= most:
                    buffer += [BLANK_LINE, part]
                    _strip_lines(buffer)
                    held += owners
                else:
                    close()
                    buffer, held = [part], owners
            continue
        part = textwrap.dedent(render_markdown(c, level).rstrip().lstrip("\n"))
        if not part:
            continue
        gap = {"inline": " ", "list": "\n"}.get(c.ctype, BLANK_LINE)
        if c.ctype == "list":
            part = textwrap.indent(part, " ")
        if most == float("inf") or count(part + gap + whole()) <= most:
            buffer += [gap, part]
            held += ids(c)
        else:
            close()
            held = ids(c)
            buffer = [cut(part, held)]
    close()
    return out


def _strip_lines(parts: list[str]) -> None:
    """The outer line ends of parts that follow each other go."""
    for at, strip in ((0, str.lstrip), (-1, str.rstrip)):
        while parts:
            parts[at] = strip(parts[at], "\n")
            if parts[at]:
                break
            del parts[at]


def _light(ids: list, parents: list, ctypes: list, contents: list, texts: list) -> list[Node]:
    """``build`` from columns in order, for what only reads a tree: leaves share their empty children and metadata."""
    no_children, no_metadata = [], {}
    nodes = {i: Node(i, c, own, text, "text/plain", None, no_metadata, no_children) for i, c, own, text in zip(ids, ctypes, contents, texts, strict=True)}
    roots = []
    for i, p in zip(ids, parents, strict=True):
        node, parent = nodes[i], nodes.get(p)
        if parent is None or parent is node:
            roots.append(node)
        else:
            if parent.children is no_children:
                parent.children = []
            parent.add(node)
    return roots


def _shared(values: pa.Array) -> list:
    """The values as a list that holds each of them once."""
    coded = values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    return [None if k is None else words[k] for k in coded.indices.to_pylist()]


def _per_tree(nodes: DataFrame, fn: Callable[[object, list[Node]], list[dict]], schema: str) -> DataFrame:
    """Rows from the roots of each document. Only the columns that are read come to Python, as columns, and one document at a time becomes a tree."""
    target = arrow_schema(schema)
    read = [F.col(c) if c in nodes.columns else F.lit(None).cast("string").alias(c) for c in ("parent_id", "ctype", "content", "text")]
    cell = F.struct(F.isnull("ord").alias("last"), "ord", "chunk_id", *read)
    docs = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(cell)).alias("__rows"))

    def run(batches):
        for batch in batches:
            rows, ends = batch.column(1), batch.column(1).offsets.to_pylist()
            for k, doc in enumerate(batch.column(0).to_pylist()):
                ids, parents, kinds, contents, texts = [c.slice(ends[k], ends[k + 1] - ends[k]) for c in rows.values.flatten()[2:]]
                yield pa.RecordBatch.from_pylist(fn(doc, _light(ids.to_pylist(), _shared(parents), _shared(kinds), contents.to_pylist(), texts.to_pylist())), schema=target)

    return docs.mapInArrow(run, schema)


def render(nodes: DataFrame, form: str = "plain") -> DataFrame:
    """(doc_id, rendered): every document of a node table as plain text or markdown; several roots are joined by blank lines."""
    fn = {"plain": render_plain, "markdown": render_markdown}.get(form)
    if fn is None:
        raise NotImplementedError(f"no rendering {form!r} of a table; use plain or markdown")
    schema = f"doc_id {dict(nodes.dtypes)['doc_id']}, rendered string"
    return _per_tree(nodes, lambda doc, roots: [{"doc_id": doc, "rendered": BLANK_LINE.join(fn(r) for r in roots)}], schema)


def render_parts(nodes: DataFrame, compat: bool = False) -> DataFrame:
    """(doc_id, parts): every document as an array of strings and binary parts (kind, text, bytes)."""
    schema = f"doc_id {dict(nodes.dtypes)['doc_id']}, parts array<struct<kind:string,text:string,bytes:binary>>"

    def one(rows: list[dict]):
        parts = [p for r in build(rows) for p in render_multi(r, compat)]
        cells = [{"kind": "text", "text": p, "bytes": None} if isinstance(p, str) else {"kind": p["mimetype"], "text": p["text"], "bytes": p["content"]} for p in parts]
        yield {"doc_id": rows[0]["doc_id"], "parts": cells}

    return per_group(nodes, ["doc_id"], one, schema)


def flatten_to_markdown(nodes: DataFrame, size: int = -1, length: str | None = None, separators: list[str] | None = None) -> DataFrame:
    """(doc_id, pos, content, originals): size-bounded markdown pieces of every document with the ids that they come from."""
    schema = f"doc_id {dict(nodes.dtypes)['doc_id']}, pos bigint, content string, originals array<string>"

    def one(doc: object, roots: list[Node]) -> list[dict]:
        pieces = [p for r in roots for p in flatten(r, size, length, separators)]
        return [{"doc_id": doc, "pos": k, "content": text, "originals": owners} for k, (text, owners) in enumerate(pieces)]

    return _per_tree(nodes, one, schema)


def clean_tree(nodes: DataFrame) -> DataFrame:
    """The node table after ``clean``: (doc_id, chunk_id, parent_id, ord, depth, ctype, mimetype, content, metadata)."""
    schema = f"doc_id {dict(nodes.dtypes)['doc_id']}, chunk_id string, parent_id string, ord int, depth int, ctype string, mimetype string, content string, metadata string"

    def one(rows: list[dict]):
        for k, root in enumerate(build(rows)):
            order = {root.id: k}
            for depth, n in clean(root).walk():
                order |= {c.id: i for i, c in enumerate(n.children)}
                yield {
                    "doc_id": rows[0]["doc_id"], "chunk_id": n.id, "parent_id": n.parent.id if n.parent else None, "ord": order[n.id], "depth": depth, "ctype": n.ctype,
                    "mimetype": n.mimetype, "content": n.content, "metadata": json.dumps(n.metadata, sort_keys=True) if n.metadata else None,
                }

    return per_group(nodes, ["doc_id"], one, schema)
