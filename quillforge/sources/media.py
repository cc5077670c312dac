"""Pages, pictures and sound: no decoder is bundled. A vendor's extractor is registered for its media types and called once a batch of files in each
worker; what it finds is mapped to nodes here."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.render import Node
from .formats import root_node

#: Labels of layout models and vendors, in lower case with _ for other signs, to node types; others are paragraphs.
LABELS = {
    "formula": "formula", "page_header": "header", "section_header": "header", "title": "header", "header": "header", "headline": "header", "subheadline": "header", "image": "figure", "picture": "figure", "figure": "figure", "table": "table",
    "checked": "inline", "unchecked": "inline", "checkboxchecked": "inline", "checkboxunchecked": "inline", "radiobuttonchecked": "inline", "radiobuttonunchecked": "inline", "key_value_region": "inline", "list_item": "list",
    "checkbox_selected": "list", "checkbox_unselected": "list", "code": "code", "form": "div", "equation": "formula",
}
AUDIO, VIDEO = ("audio/wav", "audio/x-wav", "audio/mpeg"), ("video/mp4",)


def node_type(label: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), key), F.lit("para"))


@dataclass
class Element:
    """What an extractor finds: a box is in shares of the page; pages count from 1."""

    label: str
    content: str | bytes
    page: int = 1
    box: tuple[float, float, float, float] | None = None
    mimetype: str = "text/plain"


Extractor = Callable[[bytes, str], Iterable[Element]]


def page_parser(make: Callable[[], Extractor], by_page: bool = False) -> Callable[[bytes, str], Node]:
    """A parser for the registry; the extractor is made once a worker. With ``by_page`` elements stand below a node for each page."""
    made: list[Extractor] = []

    def parse(data: bytes, path: str) -> Node:
        if not made:
            made.append(make())
        root = root_node("", "application/pdf")
        pages: dict[int, Node] = {}
        for e in made[0](data, path):
            if by_page and e.page not in pages:
                pages[e.page] = Node("", "page", None, None, "text/plain", None, {"page": e.page, "bbox": [0, 0, 1, 1]})
                root.add(pages[e.page])
            kind = LABELS.get("_".join(e.label.lower().replace("-", " ").split()), "para")
            (pages[e.page] if by_page else root).add(Node("", kind, e.content, None, e.mimetype, None, {"label": e.label, "page": e.page, "bbox": list(e.box) if e.box else None}))
        return root

    return parse


def speech_parser(make: Callable[[], Callable[[bytes, str], list[dict]]], source: str = "audio") -> Callable[[bytes, str], Node]:
    """A parser for sound: the transcriber gives segments (start, end, text); the node holds the whole text and, as metadata, the segments."""
    made: list = []

    def parse(data: bytes, path: str) -> Node:
        if not made:
            made.append(make())
        segments = [{"start": float(s["start"]), "end": float(s["end"]), "text": s["text"]} for s in made[0](data, path)]
        text = " ".join(s["text"].strip() for s in segments)
        return root_node("", "audio/wav").add(Node("", "para", text, None, "text/plain", None, {"segments": segments, "source_type": source}))

    return parse


def ocr_lines_to_nodes(lines: DataFrame, boxes: DataFrame, keys: list[str], line_id: str) -> DataFrame:
    """lines with ``block_id``: the layout box of the highest IoU, NULL (the root) where none overlaps."""
    from ..operators.geometry import best_box

    return lines.join(best_box(lines, boxes, keys, line_id), [*keys, line_id], "left")
