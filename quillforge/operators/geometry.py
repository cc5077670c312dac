"""Page layout: boxes, lines and blocks, reading order, fonts. Boxes are four columns x1, y1, x2, y2; joins are by (doc, page), so only boxes of a page meet."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import arrow_schema

BOX = ("x1", "y1", "x2", "y2")
#: Lines go to the first class of this order that holds them.
CLASS_ORDER = ("title", "caption", "figure", "table", "equation", "text")
TEXT_CLASSES = ("text", "title", "caption", "table")
DEFAULT_FONT_SIZE, DEFAULT_FONT_WEIGHT, MODE_PAGES, UNKNOWN_SIZE = 10, 350, 5, 1.0
MIN_SPAN_CHARS = 4
#: Layout in two dimensions: multipliers of a character's width and height, what a conflict takes off them and how far at most; columns that may overlap, and characters from which a line breaks.
WIDE, HIGH, SHRINK, LEAST_WIDE, LEAST_HIGH = 0.9, 1.1, 0.1, 0.7, 0.5
CONFLICT, TOLERANCE = 2, 8
SPARSE, NARROW, NARROW_SHARE = 0.5, 0.6, 0.15


def box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in BOX]


def scaled(b: list[Column], width: Column | float, height: Column | float) -> list[Column]:
    """A box in shares of its page."""
    return [b[0] / width, b[1] / height, b[2] / width, b[3] / height]


def area(b: list[Column]) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlaps(a: list[Column], b: list[Column]) -> Column:
    """Boxes that share more than an edge."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def shared_area(a: list[Column], b: list[Column]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """The part of b that a covers; 0 for a b without area."""
    return F.when(area(b) > 0, shared_area(a, b) / area(b)).otherwise(F.lit(0.0))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Shared over joint area."""
    joint = area(a) + area(b) - shared_area(a, b)
    return F.when(joint > 0, shared_area(a, b) / joint).otherwise(F.lit(0.0))


def is_valid_box(b: list[Column]) -> Column:
    return (b[0] < b[2]) & (b[1] < b[3]) & (b[0] >= 0) & (b[1] >= 0) & (b[2] <= 1) & (b[3] <= 1)


def is_valid_span(b: list[Column], text: Column) -> Column:
    """With width, height and text, and wider than high unless it has fewer than four characters."""
    w, h = b[2] - b[0], b[3] - b[1]
    return F.coalesce((w > 0) & (h > 0) & (F.length(text) > 0) & ((F.try_divide(w, h) > 1) | (F.length(text) < MIN_SPAN_CHARS)), F.lit(False))


def union_box(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def spread(df: DataFrame) -> DataFrame:
    """df as a side of a join by sorting. Spark guesses the size of boxes, lines and usual values from the files they are made from, which may be many times less, and would send them through the driver to every executor."""
    return df.hint("merge")


def _pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of a page; right's columns get the prefix b_."""
    r = spread(right.select(*[F.col(c).alias("b_" + c) for c in right.columns]))
    cond = None
    for k in keys:
        c = F.col(k) == F.col("b_" + k)
        cond = c if cond is None else cond & c
    return left.join(r, cond)


def _class_rank(name: str) -> Column:
    return F.coalesce(*[F.when(F.col(name) == c, F.lit(k)) for k, c in enumerate(CLASS_ORDER)], F.lit(len(CLASS_ORDER)))


def assign_lines(lines: DataFrame, blocks: DataFrame, keys: list[str], line_id: str, least: float = 0.3) -> DataFrame:
    """(keys, line_id, block_id): each line's block, the first by class and number of those that cover more than ``least`` of it. Lines that reach out of the page, or have no area, have none."""
    hit = _pairs(lines.where(is_valid_box(box())), blocks, keys).where(overlap_ratio(box("b_"), box()) > least)
    return hit.groupBy(*keys, line_id).agg(F.min_by("b_block_id", F.struct(_class_rank("b_class"), F.col("b_block_id"))).alias("block_id"))


def leftover_lines(lines: DataFrame, blocks: DataFrame, keys: list[str], line_id: str, least: float = 0.3) -> DataFrame:
    """Lines that no block takes: those that none covers by more than ``least`` and those out of the page."""
    return lines.join(spread(assign_lines(lines, blocks, keys, line_id, least).select(*keys, line_id)), [*keys, line_id], "left_anti").select(*lines.columns)


def outside(lines: DataFrame, blocks: DataFrame, keys: list[str], line_id: str) -> DataFrame:
    """Lines that overlap with no block."""
    hit = _pairs(lines, blocks, keys).where(overlaps(box(), box("b_"))).select(*keys, line_id).distinct()
    return lines.join(spread(hit), [*keys, line_id], "left_anti").select(*lines.columns)


def best_box(lines: DataFrame, boxes: DataFrame, keys: list[str], line_id: str) -> DataFrame:
    """(keys, line_id, block_id, iou): the box of the highest IoU above 0, the least number on ties."""
    hit = _pairs(lines, boxes, keys).withColumn("iou", iou(box("b_"), box())).where("iou > 0")
    top = F.max_by(F.struct(F.col("b_block_id").alias("block_id"), F.col("iou")), F.struct(F.col("iou"), -F.col("b_block_id")))
    return hit.groupBy(*keys, line_id).agg(top.alias("__t")).select(*keys, line_id, "__t.block_id", "__t.iou")


def merge_tables(blocks: DataFrame, lines: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, kind, item, text, x1, y1, x2, y2): blocks of text and tables in reading order. blocks and tables: keys, block_id, box; blocks have a text; lines: keys, block_id, ord, text, box.
    A block that meets a table loses the lines that meet one, is rebuilt from the others, and goes where none is left; each table follows the first block that it meets (kind 1), one that meets none is left out. One task holds no more than the lines of a block."""
    t = tables.select(*keys, F.col("block_id").alias("table_id"), *[F.col(c).alias("t_" + c) for c in BOX])
    met = blocks.select(*keys, "block_id", *BOX).join(spread(t), keys).where(overlaps(box(), box("t_"))).select(*keys, "block_id", "table_id", *["t_" + c for c in BOX])
    touched = met.select(*keys, "block_id").distinct()
    gone = lines.join(spread(met), [*keys, "block_id"]).where(overlaps(box(), box("t_"))).select(*keys, "block_id", "ord").distinct()
    left = lines.join(spread(touched), [*keys, "block_id"], "left_semi").join(spread(gone), [*keys, "block_id", "ord"], "left_anti")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    rebuilt = left.groupBy(*keys, "block_id").agg(joined.alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    kept = blocks.join(spread(touched), [*keys, "block_id"], "left_anti").select(*keys, "block_id", "text", *BOX).unionByName(rebuilt)
    texts = kept.select(*keys, F.col("block_id").cast("bigint").alias("place"), F.lit(0).alias("kind"), F.col("block_id").cast("bigint").alias("item"), "text", *BOX)
    first = met.groupBy(*keys, "table_id").agg(F.min("block_id").alias("place"))
    own = tables.select(*keys, F.col("block_id").alias("table_id"), *BOX).join(spread(first), [*keys, "table_id"])
    own = own.select(*keys, F.col("place").cast("bigint").alias("place"), F.lit(1).alias("kind"), F.col("table_id").cast("bigint").alias("item"), F.lit(None).cast("string").alias("text"), *BOX)
    return texts.unionByName(own)


def runs(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with ``run``: numbers rows of a group whose ``order`` goes on by one alike, from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(w) == 1, 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("run", (F.sum("__new").over(w) - 1).cast("bigint")).drop("__new")


def reading_order(blocks: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_id, last_span, place): blocks by their last span's number; those without one are first (-1), ties by class, then number."""
    last = spans.groupBy(*keys, "block_id").agg(F.max("ord").alias("__last"))
    rank = _class_rank("class")
    out = blocks.join(spread(last), [*keys, "block_id"], "left").withColumn("last_span", F.coalesce(F.col("__last"), F.lit(-1)).cast("bigint"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("last_span", rank, "block_id")) - 1
    return out.select(*keys, "block_id", "last_span", place.cast("bigint").alias("place"))


def font_size(size: Column, name: Column, b: list[Column], rotation: Column, text: Column | None = None) -> Column:
    """The given size above 1, else the last number in the font's name, else, where the text has no line end, the box's height (upright or upside down) or its width (turned by a right angle), else 1."""
    named = F.try_element_at(F.regexp_extract_all(name, F.lit("([0-9]+)")), F.lit(-1)).cast("double")
    turn = F.bround(F.coalesce(rotation, F.lit(0.0)))
    by_box = F.when(turn.isin(0.0, 180.0, -180.0), b[3] - b[1]).when(turn.isin(90.0, -90.0, 270.0, -270.0), b[2] - b[0])
    if text is not None:
        by_box = F.when(~F.contains(F.coalesce(text, F.lit("")), F.lit("\n")), by_box)
    return F.when(size > 1, size).when(named.isNotNull(), named).otherwise(F.coalesce(by_box, F.lit(UNKNOWN_SIZE)))


def first_pages(df: DataFrame, doc: str = "doc_id", page: str = "page", pages: int = MODE_PAGES) -> DataFrame:
    """The rows of each document's first pages: what the usual font size and weight are taken from."""
    rank = F.dense_rank().over(Window.partitionBy(doc).orderBy(page))
    return df.where(F.col(doc).isNotNull() & F.col(page).isNotNull()).withColumn("__p", rank).where(F.col("__p") <= pages).drop("__p")


def mode_of(df: DataFrame, keys: list[str], value: Column, default: int) -> DataFrame:
    """(keys, mode): the most frequent value, rounded half to even, the least on ties."""
    n = df.select(*keys, F.bround(value).cast("bigint").alias("__v")).groupBy(*keys, "__v").agg(F.count("__v").alias("__n"))
    return n.groupBy(*keys).agg(F.coalesce(F.max_by("__v", F.struct(F.col("__n"), -F.col("__v"))), F.lit(default)).alias("mode"))


def most_frequent(values: Column, default: int) -> Column:
    """The most frequent of an array's values, rounded half to even, the least on ties: ``mode_of`` of one array."""
    whole = F.array_sort(F.filter(F.transform(values, lambda v: F.bround(v).cast("bigint")), lambda v: v.isNotNull()))
    none, zero = F.lit(None).cast("bigint"), F.lit(0)

    def step(a: Column, v: Column) -> Column:
        n = F.when(a["last"] == v, a["n"] + 1).otherwise(F.lit(1))
        more = n > a["most"]
        return F.struct(v.alias("last"), n.alias("n"), F.when(more, v).otherwise(a["best"]).alias("best"), F.when(more, n).otherwise(a["most"]).alias("most"))

    return F.coalesce(F.aggregate(whole, F.struct(none.alias("last"), zero.alias("n"), none.alias("best"), zero.alias("most")), step, lambda a: a["best"]), F.lit(default))


def with_usual(spans: DataFrame, doc: str, page: str, usual: dict[str, tuple[Column, int]], pages: int = MODE_PAGES) -> DataFrame:
    """spans with a column for each of ``usual`` (value, default): its most frequent value over the document's first pages. Documents are gathered, and laid out again: no join, and no shuffle of spans that lie by document. Rows without a document or page go."""
    cells = F.collect_list(F.struct(*[c for c in spans.columns if c != doc], *[v.alias(f"__{k}") for k, (v, _) in usual.items()]))
    docs = spans.where(F.col(doc).isNotNull() & F.col(page).isNotNull()).groupBy(doc).agg(cells.alias("__s"))
    last = F.try_element_at(F.slice(F.array_sort(F.array_distinct(F.col("__s")[page])), 1, pages), F.lit(-1))
    first = docs.withColumn("__last", last).withColumn("__f", F.filter("__s", lambda x: x[page] <= F.col("__last")))
    modes = [most_frequent(F.col("__f")[f"__{k}"], d).alias(k) for k, (_, d) in usual.items()]
    return first.select(doc, "__s", *modes).select(doc, F.inline("__s"), *usual).select(*spans.columns, *usual)


def emphasis_flags(spans: DataFrame, modes: DataFrame, keys: list[str], line_keys: list[str]) -> DataFrame:
    """(line_keys, bold, italic): lines whose spans with text are all heavier than the usual weight (at least 350), or all of a slanted font."""
    both = spans.join(spread(modes), keys)
    some = F.trim("text") != ""
    bold = F.col("font_weight") > F.greatest(F.col("mode"), F.lit(DEFAULT_FONT_WEIGHT))
    italic = F.lower(F.coalesce("font_name", F.lit(""))).contains("ital")
    every = lambda c: F.coalesce(F.bool_and(F.when(some, c)), F.lit(True))
    return both.groupBy(*line_keys).agg(every(bold).alias("bold"), every(italic).alias("italic"))


def headings(blocks: DataFrame) -> DataFrame:
    """blocks (text, all_bold, font_size, mode) with ``is_heading``: bold throughout, under 200 characters, some text, no smaller than usual."""
    text = F.trim("text")
    return blocks.withColumn("is_heading", F.col("all_bold") & (F.length(text) < 200) & (text != "") & (F.bround("font_size") >= F.col("mode")))


def layout_stats(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, char_width, line_height, coverage, short_share, is_2d): medians, the share of the joint box that spans cover, the share of lines narrower than 0.6 of it; sparse text with some short lines is laid
    out in two dimensions. One aggregate; areas are summed as decimals, so the order of rows doesn't matter."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    wide, high = F.max("x2") - F.min("x1"), F.max("y2") - F.min("y1")
    one = spans.groupBy(*keys).agg(
        F.median(w / F.length("text")).alias("char_width"), F.median(h).alias("line_height"), F.sum(area(box()).cast("decimal(20,10)")).cast("double").alias("__sum"), (wide * high).alias("__whole"), wide.alias("__wide"), F.collect_list(w).alias("__w"), F.count("*").alias("__n")
    )
    cover = F.when(F.col("__whole") > 0, F.col("__sum") / F.col("__whole")).otherwise(F.lit(0.0))
    short = F.size(F.filter("__w", lambda x: x < NARROW * F.col("__wide"))) / F.col("__n")
    out = one.select(*keys, "char_width", "line_height", F.round(cover, 6).alias("coverage"), F.round(short, 6).alias("short_share"), ((cover < SPARSE) & (short >= NARROW_SHARE)).alias("is_2d"))
    return out


def is_table_filled(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows, is_valid): tables (row, col, value) of more than two rows where each column is filled by more than 30 %."""
    filled = F.when(F.trim(F.coalesce("value", F.lit(""))) != "", 1.0).otherwise(0.0)
    cols = cells.groupBy(*keys, "col").agg(F.avg(filled).alias("__f"), F.count_distinct("row").alias("__r"))
    return cols.groupBy(*keys).agg(F.max("__r").alias("n_rows"), ((F.min("__f") > 0.3) & (F.max("__r") > 2)).alias("is_valid"))


def empty_blocks(blocks: DataFrame, lines: DataFrame, assigned: DataFrame, keys: list[str], line_id: str, least: float = 0.3) -> DataFrame:
    """blocks with n_lines, how many lines they took, and is_empty: they took none, and no line of the page is covered by more than ``least`` either."""
    took = assigned.groupBy(*keys, "block_id").agg(F.count("*").alias("__n"))
    covered = _pairs(lines, blocks, keys).where(overlap_ratio(box("b_"), box()) > least).select(*keys, F.col("b_block_id").alias("block_id"), F.lit(True).alias("__c")).distinct()
    out = blocks.join(spread(took), [*keys, "block_id"], "left").join(spread(covered), [*keys, "block_id"], "left")
    return out.withColumn("n_lines", F.coalesce("__n", F.lit(0))).withColumn("is_empty", (F.col("n_lines") == 0) & F.col("__c").isNull()).drop("__n", "__c")


def needs_ocr(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lost_share, needs_ocr): pages where over 3 of 4 blocks of a text class (tables too) lost all their lines to others, or that have none of these classes. blocks: class, n_lines, is_empty; a
    block without any text under it (is_empty) counts as filled, as it is a picture of something else."""
    lost = F.when(~F.col("is_empty") & (F.col("n_lines") == 0), 1.0).otherwise(0.0)
    share = F.avg(F.when(F.col("class").isin(*TEXT_CLASSES), lost))
    return blocks.groupBy(*keys).agg(F.round(F.coalesce(share, F.lit(1.0)), 6).alias("lost_share")).withColumn("needs_ocr", F.col("lost_share") > 0.75)


def _bare(text: str) -> str:
    return text.replace("\r", "").replace("\n", "")


def _median(values: list[float]) -> float:
    values.sort()
    k = len(values) // 2
    return values[k] if len(values) % 2 else (values[k - 1] + values[k]) / 2


def grid_text(spans: list[dict], w_mult: float = WIDE, h_mult: float = HIGH, rescale: bool = False, break_lines: bool = True, only_fitting: bool = True, strip: bool = True, by_place: bool = False) -> str:
    """Spans (text, x1, y1, x2, y2; with lines also line, the line's number, and line_y2, its foot) as text that keeps the layout: rows and columns of a grid by the median character. A span that would
    overlap what stands in its row makes the grid finer (``rescale``) or, where lines are given, begins another line (``break_lines``)."""
    cells = [(s["text"], s["x1"], s["y1"], s["x2"], s["y2"], s.get("line"), s.get("line_y2")) for s in spans]
    return grid_cells(cells, w_mult, h_mult, rescale, break_lines, only_fitting, strip, by_place)


def grid_cells(cells: list[tuple], w_mult: float = WIDE, h_mult: float = HIGH, rescale: bool = False, break_lines: bool = True, only_fitting: bool = True, strip: bool = True, by_place: bool = False) -> str:
    """``grid_text`` of tuples (text, x1, y1, x2, y2, line, line_y2)."""
    lined = any(c[5] is not None for c in cells)
    kept, seen, widths, heights = [], set(), [], []
    for text, x1, y1, x2, y2, line, foot in cells:
        starts = line not in seen
        seen.add(line)
        w, h, n = x2 - x1, y2 - y1, len(text)
        if not (lined and not _bare(text).strip()) and (not only_fitting or (w > 0 and h > 0 and n > 0 and (w / h > 1 or n < MIN_SPAN_CHARS))):
            kept.append((text, x1, y2 if foot is None else foot, starts))
            widths.append(w / n)
            heights.append(h)
    if not kept:
        return ""
    wide, high = _median(widths), _median(heights)
    if wide <= 0 or high <= 0:
        return " ".join(c[0] for c in kept)
    left, top = min(c[1] for c in kept), min(c[2] for c in kept)
    while True:
        text = _grid(kept, left, top, wide * w_mult, high * h_mult, rescale, lined and break_lines, strip, by_place)
        if text is not None:
            return text
        if w_mult - SHRINK >= LEAST_WIDE:
            w_mult -= SHRINK
        elif h_mult - SHRINK >= LEAST_HIGH:
            h_mult -= SHRINK
        else:
            rescale = False


def _grid(kept, left, top, wide, high, rescale, break_lines, strip, by_place) -> str | None:
    """None where a conflict asks for a finer grid."""
    rows: dict[int, list[tuple[int, str, bool]]] = {}
    for text, x1, foot, starts in kept:
        rows.setdefault(round((foot - top) / high), []).append((round((x1 - left) / wide), text, starts))
    out: list[str] = []
    for y in sorted(rows):
        out += [""] * (y - len(out))
        line = ""
        for x, raw, starts in sorted(rows[y], key=lambda r: r[0]) if by_place else rows[y]:
            text = _bare(raw)
            if x < len(line) - CONFLICT and text.strip():
                if rescale:
                    return None
                if break_lines and ((starts and len(line.replace(" ", "").strip()) > TOLERANCE) or abs(x - len(line)) > TOLERANCE):
                    out.append(line)
                    line = ""
            line += " " * max(1, x - len(line)) + (text.strip() if strip else text)
        out.append(line)
    return "\n".join(out) + "\n"


def collapse_blanks(text: str, rows: bool = True, columns: bool = False) -> str:
    """Of neighbouring blank rows (and columns) one stays; outer blank rows go."""
    lines = text.split("\n")
    if rows:
        lines = [x for k, x in enumerate(lines) if x.strip() or not k or lines[k - 1].strip()]
        while lines and not lines[-1].strip():
            lines.pop()
        while lines and not lines[0].strip():
            lines.pop(0)
    if columns and lines:
        width = max(map(len, lines))
        blank = [all(k >= len(x) or x[k].isspace() for x in lines) for k in range(width)]
        keep = [k for k in range(width) if not (blank[k] and k and blank[k - 1])]
        lines = ["".join(x[k] for k in keep if k < len(x)).rstrip() for x in lines if x]
    return "\n".join(lines)


def layout_text(spans: DataFrame, keys: list[str], rescale: bool = False, columns: bool = False, break_lines: bool = True) -> DataFrame:
    """(keys, rendered): the spans (ord, text, x1, y1, x2, y2; line and line_y2 where there are lines) of each group as laid-out text."""
    kinds = dict(spans.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", rendered string"
    target = arrow_schema(schema)
    cell = F.struct("ord", "text", *BOX, *[F.col(c) if c in spans.columns else F.lit(None).alias(c) for c in ("line", "line_y2")])
    shown = (F.col("text") != "") & ~F.greatest(*[F.isnull(c) for c in BOX])
    pages = spans.where(shown).groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("__rows"))

    def run(batches):
        for batch in batches:
            rows = batch.column(len(keys))
            ends = rows.offsets.to_pylist()
            cells = list(zip(*[c.to_pylist() for c in rows.values.flatten()[1:]], strict=True))
            drawn = [collapse_blanks(grid_cells(cells[lo:hi], rescale=rescale, break_lines=break_lines), True, columns) for lo, hi in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keys))], pa.array(drawn, pa.string())], schema=target)

    return pages.mapInArrow(run, schema)


def _marks(bold: Column, italic: Column) -> Column:
    return F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")


def marked_lines(spans: DataFrame, bold: Column, line_keys: list[str], more: list[Column] = ()) -> DataFrame:
    """(line_keys, bold, italic, rendered, and aggregates of one's own): ``emphasis_flags`` and ``render_lines`` in one aggregate, for spans that know whether they are bold."""
    italic, some = F.lower(F.coalesce("font_name", F.lit(""))).contains("ital"), F.trim("text") != ""
    every = lambda c: F.coalesce(F.bool_and(F.when(some, c)), F.lit(True))
    escaped, m = F.replace(F.col("text"), F.lit("*"), F.lit("\\*")), _marks(bold, italic)
    styled = F.when((m == "") | F.contains(F.col("text"), F.lit("*")), escaped).otherwise(F.concat(m, F.trim("text"), m, F.lit(" ")))
    lines = spans.groupBy(*line_keys).agg(every(bold).alias("bold"), every(italic).alias("italic"), F.collect_list(F.struct("ord", escaped.alias("e"), styled.alias("s"))).alias("__p"), *more)
    plain = F.col("bold") | F.col("italic")
    cells = F.array_sort(F.transform("__p", lambda x: F.struct(x["ord"].alias("ord"), F.when(plain, x["e"]).otherwise(x["s"]).alias("p"))))
    whole, lines = _marks(F.col("bold"), F.col("italic")), lines.withColumn("__t", F.array_join(F.transform(cells, lambda x: x["p"]), ""))
    out = F.when((F.trim("__t") == "") | (whole == ""), F.col("__t")).otherwise(F.concat(whole, F.trim("__t"), whole, F.lit(" ")))
    return lines.withColumn("rendered", out).drop("__p", "__t")


def render_lines(spans: DataFrame, line_flags: DataFrame, line_keys: list[str], mode_col: str = "mode") -> DataFrame:
    """(line_keys, rendered): the emphasised text of each line: the whole line's where all of it is bold or slanted, else each span's; asterisks are escaped."""
    bold = F.col("font_weight") > F.greatest(F.col(mode_col), F.lit(DEFAULT_FONT_WEIGHT))
    italic = F.lower(F.coalesce("font_name", F.lit(""))).contains("ital")
    escaped = F.replace(F.col("text"), F.lit("*"), F.lit("\\*"))
    m = _marks(bold, italic)
    styled = F.when((m == "") | F.contains(F.col("text"), F.lit("*")), escaped).otherwise(F.concat(m, F.trim("text"), m, F.lit(" ")))
    both = spans.join(spread(line_flags.withColumnsRenamed({"bold": "line_bold", "italic": "line_italic"})), line_keys)
    piece = F.when(F.col("line_bold") | F.col("line_italic"), escaped).otherwise(styled)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord"), piece.alias("p")))), lambda x: x["p"]), "")
    rows = both.groupBy(*line_keys, "line_bold", "line_italic").agg(joined.alias("__t"))
    whole = _marks(F.col("line_bold"), F.col("line_italic"))
    out = F.when((F.trim("__t") == "") | (whole == ""), F.col("__t")).otherwise(F.concat(whole, F.trim("__t"), whole, F.lit(" ")))
    return rows.select(*line_keys, out.alias("rendered"))


def pages_to_markdown(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, markdown): the blocks' texts by page and place, a blank line after each."""
    cells = F.array_sort(F.collect_list(F.struct("page", "ord", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n")).alias("t"))))
    return blocks.groupBy(doc).agg(F.array_join(F.transform(cells, lambda x: x["t"]), "").alias("markdown"))
