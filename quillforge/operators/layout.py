"""Pages to blocks: spans of text and detected boxes become blocks in reading order with their text, and these become nodes. No PDF library takes part: spans, boxes and page sizes are tables.

spans: keys, line, ord, text, x1, y1, x2, y2 in the page's unit, font_weight, font_name, and for ``heuristic_blocks`` font_size, rotation and block_id. boxes: keys, block_id, class, and the box in shares of the page. pages: keys, width, height.
keys are the document and the page, in this order. A page is what one task holds at least.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import geometry as G
from .arrow import arrow_schema, flat_map

PICTURES = ("figure", "table", "equation")
MIN_LINES_2D = 5
PAGES_AT_ONCE = 2000
#: Classes of boxes to node types.
NODE_TYPE = {"title": "header", "caption": "para", "figure": "figure", "table": "table", "equation": "formula", "text": "para"}


def _mark(bold: bool, italic: bool) -> str:
    return "*" * (2 * bold + italic)


def emphasised(spans: list[dict]) -> str:
    """A line of spans (text, bold, italic) as markdown: all of it is marked where all spans with text are alike, else each span; asterisks are escaped."""
    some = [s for s in spans if s["text"].strip()]
    whole = _mark(all(s["bold"] for s in some), all(s["italic"] for s in some))
    out = ""
    for s in spans:
        m = "" if whole or "*" in s["text"] else _mark(s["bold"], s["italic"])
        out += f"{m}{s['text'].strip()}{m} " if m else s["text"].replace("*", "\\*")
    return f"{whole}{out.strip()}{whole} " if whole and out.strip() else out


def is_sparse(spans: list[dict], lines: list[list[dict]]) -> bool:
    """Laid out in two dimensions: spans cover little of their joint box, and some lines are much narrower than it."""
    left, right = min(s["x1"] for s in spans), max(s["x2"] for s in spans)
    whole = (right - left) * (max(s["y2"] for s in spans) - min(s["y1"] for s in spans))
    cover = sum((s["x2"] - s["x1"]) * (s["y2"] - s["y1"]) for s in spans) / whole if whole else 0.0
    wide = [max(s["x2"] for s in x) - min(s["x1"] for s in x) for x in lines]
    return cover < G.SPARSE and sum(w < G.NARROW * (right - left) for w in wide) / len(wide) >= G.NARROW_SHARE


def render_block(kind: str, spans: list[dict], fold_columns: bool = False, sparse_text: bool = True, emphasis: bool = True) -> str | None:
    """The text of a block of spans in order; None where the block is left out. Pictures, tables, equations and sparse text keep their layout, in a fence; other text runs on, with emphasis but in titles."""
    if not spans:
        return "" if kind in PICTURES else None
    by_line: dict = {}
    for s in spans:
        by_line.setdefault(s["line"], []).append(s)
    lines = list(by_line.values())
    sparse = sparse_text and len(lines) > MIN_LINES_2D and is_sparse(spans, lines)
    if kind in PICTURES or (kind == "text" and sparse):
        table, foot = kind in ("table", "text"), {k: max(s["y2"] for s in x) for k, x in by_line.items()}
        text = G.grid_text([{**s, "line_y2": foot[s["line"]]} for s in spans], 0.6 if kind == "equation" else 1.0, 0.8 if table else 1.2, table, kind == "figure", False, False, kind != "figure")
        text = G.collapse_blanks(text, True, fold_columns or kind == "equation").rstrip()
        return f"```{kind}\n{text}\n```" if text else ""
    text = "".join(emphasised(x) for x in lines) if emphasis and kind != "title" else "".join(s["text"] for s in spans)
    return text.replace("\n", " ").replace("\r", "").strip() or None


def _joint_box() -> list:
    return [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]


def lines_of(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, first_ord, last_ord, box): the lines of spans."""
    return spans.groupBy(*keys, "line").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), *_joint_box())


def _scaled(df: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    both = df.join(G.spread(pages.select(*keys, "width", "height")), keys)
    return both.withColumns(dict(zip(G.BOX, G.scaled(G.box(), F.col("width"), F.col("height")), strict=True))).drop("width", "height")


def _first_to_last(values: list[tuple]) -> list[tuple]:
    """Sorted as Spark sorts: NULL before all else, element by element."""
    return sorted(values, key=lambda v: [(x is not None, x) for x in v])


def _share(v: float | None, whole: float | None) -> float | None:
    return None if v is None or whole is None else v / whole


def _joint(boxes: list[tuple]) -> tuple:
    """The least box around boxes; what they don't have counts nothing."""
    ends = [[v for v in side if v is not None] for side in zip(*boxes, strict=True)]
    return tuple(f(e) if e else None for f, e in zip((min, min, max, max), ends, strict=True))


def _valid(b: tuple) -> bool:
    return None not in b and b[0] < b[2] and b[1] < b[3] and b[0] >= 0 and b[1] >= 0 and b[2] <= 1 and b[3] <= 1


def _taker(line: tuple, boxes: list[tuple], least: float) -> tuple | None:
    """The box (block_id, class, x1, y1, x2, y2) that takes a line in the page: ``geometry.assign_lines`` for one."""
    size, best = (line[2] - line[0]) * (line[3] - line[1]), None
    if not size > 0:
        return None
    for b in boxes:
        if None in b[2:]:
            continue
        w, h = min(line[2], b[4]) - max(line[0], b[2]), min(line[3], b[5]) - max(line[1], b[3])
        if w > 0 and h > 0 and w * h / size > least:
            rank = (_RANK[b[1]], b[0] is not None, b[0])
            if best is None or rank < best[0]:
                best = rank, b
    return best and best[1]


_RANK = {c: k for k, c in enumerate(G.CLASS_ORDER)}


def _usual_weight(weights: list) -> int:
    n = Counter(round(w) for w in weights if w is not None and w > 0)
    return min(n, key=lambda v: (-n[v], v)) if n else G.DEFAULT_FONT_WEIGHT


def blocks_of_page(spans: list[tuple], boxes: list[tuple], width: float | None, height: float | None, least: float = 0.3) -> list[tuple]:
    """(block_id, class, box, spans) in reading order. spans: (line, ord, text, x1, y1, x2, y2, font_weight, is_italic) in the page's unit, boxes: (block_id, class, x1, y1, x2, y2) in shares of it. Lines that no box takes, those
    whose spans follow each other in one block of text, are numbered on after the page's boxes; the box is that of the spans within the page, and a group without such a span goes. A line without a number belongs nowhere."""
    by_line: dict = {}
    for s in spans:
        by_line.setdefault(s[0], []).append(s)
    scale = (width, height, width, height)
    owner, loose = {}, []
    for line, of in by_line.items():
        ords = [s[1] for s in of if s[1] is not None]
        first, last = (min(ords), max(ords)) if ords else (None, None)
        joint = tuple(map(_share, _joint([s[3:7] for s in of]), scale))
        taker = _taker(joint, boxes, least) if _valid(joint) else None
        if taker is not None and line is not None:
            owner[line] = first, taker[0]
        else:
            loose.append((first, line, last))
    number = max((b[0] for b in boxes if b[0] is not None), default=-1)
    extra, before = {}, None
    for first, line, last in _first_to_last(loose) if len(loose) > 1 else loose:
        number += not (first is not None and before is not None and first - before == 1)
        before = last
        if line is not None:
            inside = [b for b in (tuple(map(_share, s[3:7], scale)) for s in by_line[line]) if _valid(b)]
            lines, found = extra.setdefault(number, ([], []))
            lines.append((first, line))
            found += inside
    for k, (lines, inside) in extra.items():
        if inside:
            owner.update((line, (first, k)) for first, line in lines)
    heavy = max(_usual_weight([s[7] for s in spans]), G.DEFAULT_FONT_WEIGHT)
    held: dict = {}
    for line, (first, k) in owner.items():
        held.setdefault(k, []).extend((first, *s) for s in by_line[line])
    every = [(*b[:2], b[2:], 0) for b in boxes] + [(k, "text", _joint(inside), 1) for k, (_, inside) in extra.items() if inside]
    out = []
    for k, kind, box, own in every:
        of = held.get(k, []) if k is not None else []
        of = _first_to_last(of) if len(of) > 1 else of
        cells = [{"line": s[1], "text": s[3], "x1": s[4], "y1": s[5], "x2": s[6], "y2": s[7], "bold": s[8] is not None and s[8] > heavy, "italic": s[9]} for s in of]
        last = max((s[2] for s in of if s[2] is not None), default=-1)
        out.append(((last, own, 0 if own else _RANK[kind], k is not None, k), (k, kind, box, cells)))
    return [b for _, b in sorted(out, key=lambda x: x[0])]


def page_blocks(spans: DataFrame, boxes: DataFrame, pages: DataFrame, keys: list[str], fold_columns: bool = False, sparse_text: bool = True, emphasis: bool = True) -> DataFrame:
    """(keys, place, block_id, class, ctype, text, n_lines, x1, y1, x2, y2): the blocks of each page in reading order. Lines go to the boxes that cover them, the rest forms blocks of text; a block's place is that of its last span.
    Spans and boxes are gathered by page, each once, and a page's are looked at together."""
    kinds = dict(spans.dtypes)
    schema = f"{keys[0]} {kinds[keys[0]]}, {keys[1]} {kinds[keys[1]]}, place bigint, block_id bigint, class string, ctype string, text string, n_lines bigint, x1 double, y1 double, x2 double, y2 double"
    target = arrow_schema(schema)
    box = [F.col(c).cast("double").alias(c) for c in G.BOX]
    cell = F.struct("line", "ord", "text", *box, "font_weight", F.contains(F.lower(F.coalesce("font_name", F.lit(""))), F.lit("ital")).alias("italic"))
    held = spans.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()).groupBy(*keys).agg(F.collect_list(cell).alias("__s"))
    held = held.join(G.spread(pages.select(*keys, F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))), keys)
    own = boxes.where(F.col("class").isin(*G.CLASS_ORDER)).groupBy(*keys).agg(F.collect_list(F.struct(F.col("block_id").cast("bigint").alias("block_id"), "class", *box)).alias("__b"))
    both = held.join(G.spread(own), keys, "full").select(*keys, "width", "height", "__s", "__b")

    def rows_of(column: pa.Array) -> Callable[[int], list[tuple]]:
        ends, none = column.offsets.to_pylist(), column.is_null().to_pylist()
        at = ends[0]
        rows = list(zip(*[c.to_pylist() for c in column.values.slice(at, ends[-1] - at).flatten()], strict=True))
        return lambda k: [] if none[k] else rows[ends[k] - at : ends[k + 1] - at]

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        wide, high, spans_of, boxes_of = batch.column(2).to_pylist(), batch.column(3).to_pylist(), rows_of(batch.column(4)), rows_of(batch.column(5))
        at, out = [], []
        for k in range(batch.num_rows):
            for place, (block, kind, b, cells) in enumerate(blocks_of_page(spans_of(k), boxes_of(k), wide[k], high[k])):
                text = render_block(kind, cells, fold_columns, sparse_text, emphasis)
                if text is not None:
                    at.append(k)
                    out.append((place, block, kind, NODE_TYPE[kind], text, len({s["line"] for s in cells}), *b))
        columns = list(zip(*out, strict=True)) or [()] * 10
        where = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *[pa.array(c, f.type) for c, f in zip(columns, list(target)[2:], strict=True)]], schema=target)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES_AT_ONCE):
                yield some(batch.slice(lo, PAGES_AT_ONCE))

    return both.mapInArrow(run, schema)


def full_pages(spans: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, x1, y1, x2, y2): each page with a line as one block that keeps its layout, in a fence."""
    lines = lines_of(spans, keys)
    cells = spans.join(G.spread(lines.select(*keys, "line", "first_ord", F.col("y2").alias("line_y2"))), [*keys, "line"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first_ord", "ord", "line", "text", *G.BOX, "line_y2"))).alias("spans"))
    both = _scaled(G.union_box(lines, keys), pages, keys).join(G.spread(cells), keys)
    kinds = dict(spans.dtypes)
    schema = f"{keys[0]} {kinds[keys[0]]}, {keys[1]} {kinds[keys[1]]}, text string, x1 double, y1 double, x2 double, y2 double"
    return flat_map(both, lambda r: [{**{k: r[k] for k in (*keys, *G.BOX)}, "text": f"```page\n{G.grid_text(r['spans'])}\n```"}], schema)


def heuristic_blocks(spans: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_id, ctype, text, x1, y1, x2, y2): blocks that the spans name (block_id), their lines as markdown; bold, short ones of no smaller type than usual are headers. All in Spark."""
    size = G.font_size(F.col("font_size"), F.col("font_name"), G.box(), F.col("rotation"), F.col("text"))
    weight = F.when(F.col("font_weight") > 0, F.col("font_weight"))
    used = spans.select(*keys, "block_id", "line", "ord", "text", *G.BOX, "font_weight", "font_name", size.alias("size")).where("block_id IS NOT NULL")
    both = G.with_usual(used, *keys, {"weight": (weight, G.DEFAULT_FONT_WEIGHT), "mode": (F.col("size"), G.DEFAULT_FONT_SIZE)})
    bold = F.col("font_weight") > F.greatest("weight", F.lit(G.DEFAULT_FONT_WEIGHT))
    lines = G.marked_lines(both, bold, [*keys, "block_id", "line", "mode"], [F.min("ord").alias("first_ord"), F.max(F.bround("size")).alias("font_size"), *_joint_box()])
    named = F.col("line").isNotNull()
    cell = F.when(named, F.struct("first_ord", F.concat("rendered", F.lit("\n")).alias("t")))
    blocks = lines.groupBy(*keys, "block_id", "mode").agg(F.array_sort(F.collect_list(cell)).alias("__t"), F.bool_and(F.when(named, F.col("bold"))).alias("all_bold"), F.max("font_size").alias("font_size"), *_joint_box())
    joined = F.array_join(F.transform("__t", lambda x: x["t"]), "")
    text = F.trim(F.replace(F.replace(joined, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")))
    found = G.headings(_scaled(blocks.where(F.size("__t") > 0).withColumn("text", text), pages, keys))
    return found.select(*keys, "block_id", F.when(F.col("is_heading"), "header").otherwise("para").alias("ctype"), "text", *G.BOX)


def block_nodes(blocks: DataFrame, keys: list[str], order: str = "place", mimetype: str = "application/pdf") -> DataFrame:
    """Node rows (doc_id, chunk_id, parent_id, ord, path, ctype, mimetype, content, text, metadata): a root for each document and its blocks by page and place. A document's first block brings its root."""
    doc, page = keys
    name = F.col(doc).cast("string")
    w = Window.partitionBy(doc).orderBy(page, order)
    k = (F.row_number().over(w) - 1).cast("int")
    meta = F.to_json(F.struct(F.struct(*G.BOX).alias("box"), (F.col(page) + 1).alias("page")))
    none = F.lit(None).cast("string")
    leaf = F.struct(F.concat("__name", F.lit("/"), F.col("__k")).alias("chunk_id"), F.col("__name").alias("parent_id"), F.col("__k").alias("ord"), F.array(F.lit(0), F.col("__k")).alias("path"), F.col("ctype").alias("ctype"), F.lit("text/plain").alias("mimetype"), F.col("text").alias("content"), none.alias("text"), meta.alias("metadata"))
    root = F.struct(F.col("__name").alias("chunk_id"), none.alias("parent_id"), F.lit(0).alias("ord"), F.array(F.lit(0)).alias("path"), F.lit("root").alias("ctype"), F.lit(mimetype).alias("mimetype"), none.alias("content"), none.alias("text"), none.alias("metadata"))
    placed = blocks.withColumn("__k", k).withColumn("__name", name)
    return placed.select(F.col(doc).alias("doc_id"), F.inline(F.when(F.col("__k") == 0, F.array(root, leaf)).otherwise(F.array(leaf))))
