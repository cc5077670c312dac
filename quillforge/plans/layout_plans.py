"""Queries over page layout: lines, blocks and fonts made from lineitem and orders by the same SQL expressions in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import layout
from ..sources.media import node_type
from .tables import by_key, table

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
#: A line of a page for each lineitem; an expression each that reads alike in Spark and DuckDB.
SPAN = {
    "doc_id": "l_orderkey", "page": "l_suppkey % 7", "ord": f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER})",
    "x1": "l_discount * 5e0", "y1": "l_tax * 1e1", "x2": "l_discount * 5e0 + l_quantity / 8e1", "y2": "l_tax * 1e1 + 2e-2 + (l_linenumber % 3) * 5e-2 - CASE WHEN l_partkey % 17 = 0 THEN 2e-1 ELSE 0e0 END",
    "text": "CASE WHEN l_partkey % 11 = 0 THEN ' ' WHEN l_partkey % 7 = 0 THEN 'a*b' WHEN l_partkey % 5 = 0 THEN concat(l_returnflag, 'x') ELSE concat(l_returnflag, l_linestatus, '-', CAST(l_partkey AS STRING)) END",
    "font_name": "CASE WHEN l_returnflag = 'A' THEN 'Times-Italic12' WHEN l_returnflag = 'R' AND l_partkey % 3 = 0 THEN 'Arial0' WHEN l_returnflag = 'R' THEN 'A4rial9' ELSE 'Mono' END",
    "font_size": "CASE WHEN l_suppkey % 4 = 0 THEN 1e0 ELSE 8e0 + (l_partkey % 5) END", "font_weight": "300 + (l_suppkey % 5) * 100", "rotation": "CASE l_partkey % 13 WHEN 0 THEN 9e1 WHEN 1 THEN -9e1 WHEN 2 THEN 45e0 WHEN 3 THEN 180e0 WHEN 4 THEN 270e0 WHEN 5 THEN 4e-1 ELSE 0e0 END",
}
#: Three blocks on each page of an order.
BLOCK = {
    "doc_id": "o_orderkey", "page": "k % 7", "block_id": "k", "class": "CASE (o_custkey + k) % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'table' WHEN 2 THEN 'text' ELSE 'figure' END",
    "x1": "(o_custkey % 4) / 1e1", "y1": "(k % 4) / 8e0", "x2": "(o_custkey % 4) / 1e1 + 4e-1", "y2": "(k % 4) / 8e0 + 25e-2", "text": "CASE WHEN (o_custkey + k) % 3 = 0 THEN '' ELSE o_orderstatus END",
}
_BLOCKS_OF = 9


def _select(of: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {c}" for c, x in of.items())


SQL = f"spans AS (SELECT {_select(SPAN)} FROM lineitem), blocks AS (SELECT {_select(BLOCK)} FROM orders, (SELECT CAST(range AS BIGINT) AS k FROM range({_BLOCKS_OF})))"
KEYS = ["doc_id", "page"]


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines go to the tasks of their orders once, as they are, and are numbered and made spans there: what follows by order, or by order and page, needs no other shuffle."""
    own = by_key(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id"), "doc_id")
    numbered = own.withColumn("ord", F.expr(SPAN["ord"].replace("l_orderkey", "doc_id")).cast("bigint"))
    return numbered.selectExpr(*[c if c in ("doc_id", "ord") else f"{x} AS {c}" for c, x in SPAN.items()])


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders go to the tasks of their lines before they are made many boxes."""
    own = by_key(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "doc_id"), "doc_id", table(spark, sf_dir, "lineitem"))
    every = own.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_BLOCKS_OF - 1).cast("bigint"))))
    return every.selectExpr(*[c if c == "doc_id" else f"{x} AS {c}" for c, x in BLOCK.items()])


def bbox_scale(spark, sf_dir):
    s = spans(spark, sf_dir)
    w, h = G.scaled(G.box(), 2.0, 4.0), G.is_valid_box(G.box())
    return s.select("doc_id", "ord", *[c.alias("s_" + n) for c, n in zip(w, G.BOX, strict=True)], G.area(G.box()).alias("area"), h.alias("is_valid"), G.is_valid_span(G.box(), F.col("text")).alias("is_valid_span"))


def bbox_overlap(spark, sf_dir):
    p = G._pairs(spans(spark, sf_dir), blocks(spark, sf_dir), KEYS).where(G.overlaps(G.box(), G.box("b_")))
    return p.select("doc_id", "page", "ord", F.col("b_block_id").alias("block_id"), G.overlap_ratio(G.box("b_"), G.box()).alias("ratio"), G.iou(G.box("b_"), G.box()).alias("iou"))


_W, _H = "(least(s.x2, b.x2) - greatest(s.x1, b.x1))", "(least(s.y2, b.y2) - greatest(s.y1, b.y1))"
_SHARED = f"CASE WHEN {_W} > 0 AND {_H} > 0 THEN {_W} * {_H} ELSE 0e0 END"
_AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
_JOINT = f"({_AREA.format('b')} + {_AREA.format('s')} - {_SHARED})"
_PAIRS = f"""pairs AS MATERIALIZED (SELECT s.x1 >= 0 AND s.y1 >= 0 AND s.x2 > s.x1 AND s.y2 > s.y1 AND s.x2 <= 1 AND s.y2 <= 1 AS inside, s.doc_id, s.page, s.ord, b.block_id, b.class, s.x1 < b.x2 AND b.x1 < s.x2 AND s.y1 < b.y2 AND b.y1 < s.y2 AS meets,
  CASE WHEN {_AREA.format("s")} > 0 THEN {_SHARED} / {_AREA.format("s")} ELSE 0e0 END AS ratio, CASE WHEN {_JOINT} > 0 THEN {_SHARED} / {_JOINT} ELSE 0e0 END AS iou FROM spans s JOIN blocks b ON s.doc_id = b.doc_id AND s.page = b.page)"""
_RANK = "CASE class WHEN 'title' THEN 0 WHEN 'caption' THEN 1 WHEN 'figure' THEN 2 WHEN 'table' THEN 3 WHEN 'equation' THEN 4 WHEN 'text' THEN 5 ELSE 6 END"
_IN = "x1 >= 0 AND y1 >= 0 AND x2 > x1 AND y2 > y1 AND x2 <= 1 AND y2 <= 1"
_ASSIGNED = f"assigned AS MATERIALIZED (SELECT doc_id, page, ord, block_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, ord ORDER BY {_RANK}, block_id) AS k FROM pairs WHERE inside AND ratio > 0.3) WHERE k = 1)"


def bbox_union(spark, sf_dir):
    return G.union_box(spans(spark, sf_dir), KEYS)


def line_to_block(spark, sf_dir):
    return G.assign_lines(spans(spark, sf_dir), blocks(spark, sf_dir), KEYS, "ord")


def leftover_lines(spark, sf_dir):
    return G.leftover_lines(spans(spark, sf_dir), blocks(spark, sf_dir), KEYS, "ord").select("doc_id", "page", "ord")


def lines_outside(spark, sf_dir):
    return G.outside(spans(spark, sf_dir), blocks(spark, sf_dir), KEYS, "ord").select("doc_id", "page", "ord")


def best_iou_box(spark, sf_dir):
    return G.best_box(spans(spark, sf_dir), blocks(spark, sf_dir), KEYS, "ord")


def text_table_merge(spark, sf_dir):
    """Blocks of text, every third line of a page each, and the tables of the page."""
    lines = spans(spark, sf_dir).withColumn("block_id", F.col("ord") % 3).select(*KEYS, "block_id", "ord", "text", *G.BOX)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    texts = lines.groupBy(*KEYS, "block_id").agg(text.alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return G.merge_tables(texts, lines, blocks(spark, sf_dir).where("class = 'table'"), KEYS)


_MERGE = """, lines AS MATERIALIZED (SELECT doc_id, page, ord % 3 AS block_id, ord, text, x1, y1, x2, y2 FROM spans),
 texts AS MATERIALIZED (SELECT doc_id, page, block_id, string_agg(text, ' ' ORDER BY ord) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM lines GROUP BY ALL),
 tables AS MATERIALIZED (SELECT doc_id, page, block_id AS table_id, x1, y1, x2, y2 FROM blocks WHERE class = 'table'),
 met AS MATERIALIZED (SELECT doc_id, page, b.block_id, t.table_id, t.x1, t.y1, t.x2, t.y2 FROM texts b JOIN tables t USING (doc_id, page) WHERE NOT (b.x1 >= t.x2 OR b.y1 >= t.y2 OR b.x2 <= t.x1 OR b.y2 <= t.y1)),
 away AS MATERIALIZED (SELECT DISTINCT l.doc_id, l.page, l.ord FROM lines l JOIN met m USING (doc_id, page, block_id) WHERE NOT (l.x1 >= m.x2 OR l.y1 >= m.y2 OR l.x2 <= m.x1 OR l.y2 <= m.y1)),
 hit AS MATERIALIZED (SELECT DISTINCT doc_id, page, block_id FROM met),
 again AS (SELECT doc_id, page, block_id, string_agg(text, ' ' ORDER BY ord) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM lines SEMI JOIN hit USING (doc_id, page, block_id) ANTI JOIN away USING (doc_id, page, ord) GROUP BY ALL)
 SELECT doc_id, page, CAST(block_id AS BIGINT) AS place, 0 AS kind, CAST(block_id AS BIGINT) AS item, text, x1, y1, x2, y2 FROM (SELECT * FROM texts ANTI JOIN hit USING (doc_id, page, block_id) UNION ALL SELECT * FROM again)
 UNION ALL SELECT doc_id, page, CAST(min(block_id) AS BIGINT), 1, CAST(table_id AS BIGINT), NULL, x1, y1, x2, y2 FROM met GROUP BY doc_id, page, table_id, x1, y1, x2, y2"""


def span_islands(spark, sf_dir):
    """Runs of neighbouring lines of a page: (doc_id, page, run, first, last)."""
    return G.runs(spans(spark, sf_dir), KEYS, "ord").groupBy(*KEYS, "run").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))


def reading_order(spark, sf_dir):
    s = spans(spark, sf_dir).withColumn("block_id", F.col("ord") % 4 + F.col("page"))
    return G.reading_order(blocks(spark, sf_dir), s, KEYS)


def font_mode(spark, sf_dir):
    size = G.font_size(F.col("font_size"), F.col("font_name"), G.box(), F.col("rotation"), F.col("text"))
    return G.mode_of(G.first_pages(spans(spark, sf_dir)), ["doc_id"], size, G.DEFAULT_FONT_SIZE)


#: Size above 1; the last digits of the name; by the rounded rotation the height or the width; 1.
_SIZE = """CASE WHEN font_size > 1 THEN font_size WHEN regexp_matches(font_name, '[0-9]') THEN CAST(list_last(regexp_extract_all(font_name, '[0-9]+')) AS DOUBLE)
 WHEN contains(text, chr(10)) THEN 1e0 WHEN round_even(rotation, 0) IN (0, 180, -180) THEN y2 - y1 WHEN round_even(rotation, 0) IN (90, -90, 270, -270) THEN x2 - x1 ELSE 1e0 END"""
_FIRST = "(SELECT * FROM spans QUALIFY dense_rank() OVER (PARTITION BY doc_id ORDER BY page) <= 5)"
_MODE = "(SELECT doc_id, v AS mode FROM (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, v) AS k FROM (SELECT doc_id, CAST(round_even({0}, 0) AS BIGINT) AS v, count(*) AS n FROM " + _FIRST + " GROUP BY 1, 2)) WHERE k = 1)"


def emphasis(spark, sf_dir):
    s = spans(spark, sf_dir)
    modes = G.mode_of(G.first_pages(s), ["doc_id"], F.col("font_weight"), G.DEFAULT_FONT_WEIGHT)
    return G.emphasis_flags(s, modes, ["doc_id"], KEYS)


_BOLD = "font_weight > greatest(mode, 350)"
_ITAL = "contains(lower(font_name), 'ital')"
_FLAGS = f"flags AS (SELECT doc_id, page, coalesce(bool_and(CASE WHEN trim(text) <> '' THEN {_BOLD} END), true) AS bold, coalesce(bool_and(CASE WHEN trim(text) <> '' THEN {_ITAL} END), true) AS italic FROM spans JOIN {_MODE.format('font_weight')} USING (doc_id) GROUP BY doc_id, page)"


def rendered_lines(spark, sf_dir):
    s = spans(spark, sf_dir)
    modes = G.mode_of(G.first_pages(s), ["doc_id"], F.col("font_weight"), G.DEFAULT_FONT_WEIGHT)
    return G.render_lines(s.join(G.spread(modes), "doc_id"), G.emphasis_flags(s, modes, ["doc_id"], KEYS), KEYS)


_MARK = "CASE WHEN {0} AND {1} THEN '***' WHEN {0} THEN '**' WHEN {1} THEN '*' ELSE '' END"
_LINES = f"""r AS (SELECT s.doc_id, s.page, ord, f.bold, f.italic, replace(text, '*', '\\*') AS esc, {_MARK.format(_BOLD, _ITAL)} AS m, text FROM spans s JOIN {_MODE.format('font_weight')} USING (doc_id) JOIN flags f ON f.doc_id = s.doc_id AND f.page = s.page),
 t AS (SELECT doc_id, page, bold, italic, string_agg(CASE WHEN bold OR italic OR m = '' OR contains(text, '*') THEN esc ELSE m || trim(text) || m || ' ' END, '' ORDER BY ord) AS t FROM r GROUP BY ALL),
 u AS (SELECT *, {_MARK.format('bold', 'italic')} AS w FROM t) SELECT doc_id, page, CASE WHEN trim(t) = '' OR w = '' THEN t ELSE w || trim(t) || w || ' ' END AS rendered FROM u"""


def heading_detect(spark, sf_dir):
    """Pages as blocks: bold ones of no smaller type than usual are headings."""
    s = spans(spark, sf_dir)
    size = G.font_size(F.col("font_size"), F.col("font_name"), G.box(), F.col("rotation"), F.col("text"))
    s = G.with_usual(s.select(*KEYS, "ord", "text", "font_weight", "font_name", size.alias("size")), *KEYS, {"weight": (F.col("font_weight"), G.DEFAULT_FONT_WEIGHT), "mode": (F.col("size"), G.DEFAULT_FONT_SIZE)})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    bold = F.coalesce(F.bool_and(F.when(F.trim("text") != "", F.col("font_weight") > F.greatest("weight", F.lit(G.DEFAULT_FONT_WEIGHT)))), F.lit(True))
    return G.headings(s.groupBy(*KEYS, "mode").agg(text.alias("text"), F.max("size").alias("font_size"), bold.alias("all_bold"))).select(*KEYS, "is_heading")


_HEADING = f"b AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY ord) AS t, max({_SIZE}) AS size FROM spans GROUP BY doc_id, page) SELECT b.doc_id, b.page, bold AND length(trim(t)) < 200 AND trim(t) <> '' AND round_even(size, 0) >= mode AS is_heading FROM b JOIN flags USING (doc_id, page) JOIN {_MODE.format(_SIZE)} USING (doc_id)"


def layout_stats(spark, sf_dir):
    return G.layout_stats(spans(spark, sf_dir), KEYS)


_STATS = f"""u AS (SELECT doc_id, page, min(x1) AS ux1, min(y1) AS uy1, max(x2) AS ux2, max(y2) AS uy2 FROM spans GROUP BY doc_id, page),
 z AS (SELECT doc_id, page, median((x2 - x1) / length(text)) AS char_width, median(y2 - y1) AS line_height, CASE WHEN max((ux2 - ux1) * (uy2 - uy1)) > 0 THEN CAST(sum(CAST({_AREA.format('s')} AS DECIMAL(20,10))) AS DOUBLE) / max((ux2 - ux1) * (uy2 - uy1)) ELSE 0e0 END AS c,
 count(*) FILTER (x2 - x1 < 6e-1 * (ux2 - ux1)) / count(*) AS s FROM spans s JOIN u USING (doc_id, page) GROUP BY doc_id, page)
 SELECT doc_id, page, char_width, line_height, round(c, 6) AS coverage, round(s, 6) AS short_share, c < 5e-1 AND s >= 15e-2 AS is_2d FROM z"""


def table_fill(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS row", "CASE WHEN l_partkey % 3 = 0 THEN '' ELSE l_returnflag END AS c0", "l_linestatus AS c1")
    cells = cells.select("doc_id", "row", F.inline(F.array(F.struct(F.lit(0).alias("col"), F.col("c0").alias("value")), F.struct(F.lit(1).alias("col"), F.col("c1").alias("value")))))
    return G.is_table_filled(cells, ["doc_id"])


_FILL = "c AS (SELECT l_orderkey AS doc_id, avg(CASE WHEN l_partkey % 3 = 0 THEN 0e0 ELSE 1e0 END) AS f, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT doc_id, n AS n_rows, least(f, 1e0) > 3e-1 AND n > 2 AS is_valid FROM c"


def ocr_required(spark, sf_dir):
    lines, own = spans(spark, sf_dir), blocks(spark, sf_dir)
    return G.needs_ocr(G.empty_blocks(own, lines, G.assign_lines(lines, own, KEYS, "ord"), KEYS, "ord"), KEYS)


_OCR = """took AS (SELECT doc_id, page, block_id, count(*) AS n FROM assigned GROUP BY ALL), covered AS (SELECT DISTINCT doc_id, page, block_id FROM pairs WHERE ratio > 0.3),
 e AS (SELECT doc_id, page, class, coalesce(n, 0) AS n, n IS NULL AND c.block_id IS NULL AS empty FROM blocks b LEFT JOIN took USING (doc_id, page, block_id) LEFT JOIN covered c USING (doc_id, page, block_id)),
 f AS (SELECT doc_id, page, round(coalesce(avg(CASE WHEN NOT empty AND n = 0 THEN 1e0 ELSE 0e0 END) FILTER (class IN ('text', 'title', 'caption', 'table')), 1e0), 6) AS lost_share FROM e GROUP BY doc_id, page)
 SELECT *, lost_share > 75e-2 AS needs_ocr FROM f"""


def layout_text_2d(spark, sf_dir):
    """Each line of a page has one span."""
    return G.layout_text(spans(spark, sf_dir).withColumn("line", F.col("ord")), KEYS, break_lines=False)


#: Each row of the grid is a fold over its spans in order; rows without spans are blank, and of blank ones that follow each other one stays.
_GRID = """kept AS (SELECT *, trim(replace(replace(text, chr(13), ''), chr(10), '')) AS t FROM spans WHERE trim(text) <> '' AND x2 > x1 AND y2 > y1 AND ((x2 - x1) / (y2 - y1) > 1 OR length(text) < 4)),
 m AS (SELECT doc_id, page, median((x2 - x1) / length(text)) * 9e-1 AS wide, median(y2 - y1) * 11e-1 AS high, min(x1) AS lft, min(y2) AS top FROM kept GROUP BY ALL),
 cells AS (SELECT doc_id, page, ord, t, CAST(round_even((x1 - lft) / wide, 0) AS BIGINT) AS x, CAST(round_even((y2 - top) / high, 0) AS BIGINT) AS y FROM kept JOIN m USING (doc_id, page)),
 rows AS (SELECT doc_id, page, y, list_reduce(list_prepend('', list(x || '|' || t ORDER BY ord)), lambda acc, c: acc || repeat(' ', CAST(greatest(1, CAST(split_part(c, '|', 1) AS BIGINT) - length(acc)) AS INTEGER)) || substr(c, strpos(c, '|') + 1)) AS line FROM cells GROUP BY ALL),
 gaps AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS before FROM rows),
 drawn AS (SELECT doc_id, page, string_agg(CASE WHEN before IS NOT NULL THEN chr(10) ELSE '' END || CASE WHEN y - before > 1 THEN chr(10) ELSE '' END || line, '' ORDER BY y) AS rendered FROM gaps GROUP BY ALL)
 SELECT doc_id, page, coalesce(rendered, '') AS rendered FROM (SELECT DISTINCT doc_id, page FROM spans) LEFT JOIN drawn USING (doc_id, page)"""


def _page_spans(spark, sf_dir):
    """The spans with lines of two spans each, and pages twice as wide and high as the boxes say."""
    s = spans(spark, sf_dir).withColumn("page", F.col("ord") % 2).withColumn("line", F.floor(F.col("ord") / 2)).withColumn("block_id", F.floor(F.col("ord") / 4))
    return s.withColumns({c: F.col(c) * 2 for c in G.BOX})


def _page_sizes(spark, sf_dir):
    return _page_spans(spark, sf_dir).select(*KEYS, F.lit(2.0).alias("width"), F.lit(2.0).alias("height")).distinct()


def page_blocks(spark, sf_dir):
    """Blocks of each page in reading order; the text is left out where it keeps its layout."""
    s = _page_spans(spark, sf_dir)
    own = blocks(spark, sf_dir).withColumn("page", F.col("page") % 2).join(G.spread(s.select(*KEYS).distinct()), KEYS, "left_semi")
    got = layout.page_blocks(s, own, _page_sizes(spark, sf_dir), KEYS)
    return got.withColumn("text", F.when(F.col("ctype").isin("header", "para"), F.col("text")))


_TWO = "two AS MATERIALIZED (SELECT * REPLACE (ord % 2 AS page), CAST(floor(ord / 2) AS BIGINT) AS line, CAST(floor(ord / 4) AS BIGINT) AS block_id FROM spans)"
_MARKS = """CASE WHEN {0} AND {1} THEN '***' WHEN {0} THEN '**' WHEN {1} THEN '*' ELSE '' END"""
_STYLED = f"""styled AS (SELECT *, coalesce(bool_and(heavy) FILTER (trim(text) <> '') OVER l, true) AS line_bold, coalesce(bool_and(slant) FILTER (trim(text) <> '') OVER l, true) AS line_italic FROM marked WINDOW l AS (PARTITION BY doc_id, page, block_id, line)),
 pieces AS (SELECT *, {_MARKS.format('heavy', 'slant')} AS m, {_MARKS.format('line_bold', 'line_italic')} AS w FROM styled),
 joined AS (SELECT doc_id, page, block_id, line, w, min(ord) AS first_ord, string_agg(CASE WHEN w <> '' OR m = '' OR contains(text, '*') THEN replace(text, '*', '\\*') ELSE m || trim(text) || m || ' ' END, '' ORDER BY ord) AS t FROM pieces GROUP BY ALL),
 rendered AS (SELECT doc_id, page, block_id, line, first_ord, CASE WHEN w <> '' AND trim(t) <> '' THEN w || trim(t) || w || ' ' ELSE t END AS t FROM joined)"""
_PAGE_BLOCKS = _TWO + f""", own AS MATERIALIZED (SELECT doc_id, page % 2 AS page, block_id, class, x1, y1, x2, y2 FROM blocks WHERE (doc_id, page % 2) IN (SELECT (doc_id, page) FROM two)),
 lines AS MATERIALIZED (SELECT doc_id, page, line, min(ord) AS a, max(ord) AS z, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM two GROUP BY ALL),
 over AS (SELECT l.doc_id, l.page, l.line, b.block_id, greatest(0, least(b.x2, l.x2) - greatest(b.x1, l.x1)) * greatest(0, least(b.y2, l.y2) - greatest(b.y1, l.y1)) / ((l.x2 - l.x1) * (l.y2 - l.y1)) AS r, b.class
   FROM lines l JOIN own b USING (doc_id, page) WHERE l.x1 >= 0 AND l.y1 >= 0 AND l.x2 > l.x1 AND l.y2 > l.y1 AND l.x2 <= 1 AND l.y2 <= 1),
 taken AS MATERIALIZED (SELECT doc_id, page, line, block_id FROM over WHERE r > 3e-1 QUALIFY row_number() OVER (PARTITION BY doc_id, page, line ORDER BY {_RANK}, block_id) = 1),
 loose AS (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY doc_id, page ORDER BY a) = 1 THEN 0 ELSE 1 END AS fresh FROM lines ANTI JOIN taken USING (doc_id, page, line)),
 runs AS (SELECT doc_id, page, line, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY a) + coalesce((SELECT max(block_id) FROM own o WHERE o.doc_id = loose.doc_id AND o.page = loose.page), -1) AS block_id FROM loose),
 extra AS MATERIALIZED (SELECT r.doc_id, r.page, CAST(r.block_id AS BIGINT) AS block_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM two t JOIN runs r ON t.doc_id = r.doc_id AND t.page = r.page AND t.line = r.line WHERE x1 >= 0 AND y1 >= 0 AND x2 > x1 AND y2 > y1 AND x2 <= 1 AND y2 <= 1 GROUP BY ALL),
 owner AS (SELECT doc_id, page, line, CAST(block_id AS BIGINT) AS block_id FROM taken UNION ALL SELECT doc_id, page, line, CAST(block_id AS BIGINT) FROM runs SEMI JOIN extra USING (doc_id, page, block_id)),
 modes AS (SELECT doc_id, page, v AS mode FROM (SELECT doc_id, page, font_weight AS v, count(*) AS n FROM two GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, v) = 1),
 marked AS (SELECT t.doc_id, t.page, o.block_id, t.line, t.ord, t.text, font_weight > greatest(mode, 350) AS heavy, contains(lower(font_name), 'ital') AS slant FROM two t JOIN owner o ON t.doc_id = o.doc_id AND t.page = o.page AND t.line = o.line JOIN modes m ON m.doc_id = t.doc_id AND m.page = t.page),
 {_STYLED},
 plain AS (SELECT doc_id, page, block_id, max(ord) AS z, count(DISTINCT line) AS n, string_agg(text, '' ORDER BY ord) AS raw FROM marked GROUP BY ALL), texts AS (SELECT doc_id, page, block_id, string_agg(t, '' ORDER BY first_ord) AS t FROM rendered GROUP BY ALL),
 every AS (SELECT doc_id, page, block_id, class, x1, y1, x2, y2, 0 AS own FROM own UNION ALL SELECT doc_id, page, block_id, 'text', x1, y1, x2, y2, 1 FROM extra),
 placed AS (SELECT e.*, p.n, CASE WHEN class = 'title' THEN raw ELSE t END AS t, row_number() OVER (PARTITION BY e.doc_id, e.page ORDER BY coalesce(z, -1), own, CASE WHEN own = 0 THEN {_RANK} END NULLS FIRST, e.block_id) - 1 AS place FROM every e LEFT JOIN plain p ON p.doc_id = e.doc_id AND p.page = e.page AND p.block_id = e.block_id LEFT JOIN texts x ON x.doc_id = e.doc_id AND x.page = e.page AND x.block_id = e.block_id)
 SELECT doc_id, page, place, block_id, class, CASE class WHEN 'title' THEN 'header' WHEN 'figure' THEN 'figure' WHEN 'table' THEN 'table' ELSE 'para' END AS ctype, CASE WHEN class IN ('title', 'text') THEN trim(t) END AS text, coalesce(n, 0) AS n_lines, x1, y1, x2, y2
 FROM placed WHERE class IN ('figure', 'table') OR trim(coalesce(t, '')) <> ''"""


def heuristic_blocks(spark, sf_dir):
    return layout.heuristic_blocks(_page_spans(spark, sf_dir), _page_sizes(spark, sf_dir), KEYS)


_HEURISTIC = _TWO + f""", wide AS (SELECT * REPLACE (x1 * 2 AS x1, y1 * 2 AS y1, x2 * 2 AS x2, y2 * 2 AS y2), {_SIZE.replace('y2 - y1', 'y2 * 2 - y1 * 2').replace('x2 - x1', 'x2 * 2 - x1 * 2')} AS size FROM two),
 firsts AS (SELECT * FROM wide QUALIFY dense_rank() OVER (PARTITION BY doc_id ORDER BY page) <= 5),
 weights AS (SELECT doc_id, v AS mode FROM (SELECT doc_id, font_weight AS v, count(*) AS n FROM firsts GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, v) = 1),
 sizes AS (SELECT doc_id, v AS usual FROM (SELECT doc_id, round_even(size, 0) AS v, count(*) AS n FROM firsts GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, v) = 1),
 marked AS (SELECT w.*, font_weight > greatest(mode, 350) AS heavy, contains(lower(font_name), 'ital') AS slant FROM wide w JOIN weights USING (doc_id)), {_STYLED},
 texts AS (SELECT doc_id, page, block_id, trim(replace(string_agg(t || chr(10), '' ORDER BY first_ord), chr(10), ' ')) AS text FROM rendered GROUP BY ALL),
 whole AS (SELECT doc_id, page, block_id, bool_and(line_bold) AS bold, max(round_even(size, 0)) AS size, min(x1) / 2 AS x1, min(y1) / 2 AS y1, max(x2) / 2 AS x2, max(y2) / 2 AS y2 FROM styled GROUP BY ALL)
 SELECT doc_id, page, block_id, CASE WHEN bold AND length(text) < 200 AND text <> '' AND size >= usual THEN 'header' ELSE 'para' END AS ctype, text, x1, y1, x2, y2 FROM texts JOIN whole USING (doc_id, page, block_id) JOIN sizes USING (doc_id)"""


def page_nodes(spark, sf_dir):
    """The heuristic blocks as nodes under a root for each document."""
    return layout.block_nodes(heuristic_blocks(spark, sf_dir), KEYS, "block_id").select("doc_id", "chunk_id", "parent_id", "ord", "ctype", "mimetype", "content")


_NODES = f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, block_id) - 1 AS k FROM ({{0}}))
 SELECT doc_id, concat(doc_id, '/', k) AS chunk_id, CAST(doc_id AS VARCHAR) AS parent_id, CAST(k AS INTEGER) AS ord, ctype, 'text/plain' AS mimetype, text AS content FROM b
 UNION ALL SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), NULL, 0, 'root', 'application/pdf', NULL FROM b"""


def pages_to_markdown(spark, sf_dir):
    return G.pages_to_markdown(spans(spark, sf_dir))


def label_types(spark, sf_dir):
    label = F.get(F.array(*map(F.lit, ["Section-header", "Title", "Formula", "Picture", "Table", "list_item", "Text", "Page-footer", "code"])), (F.col("p_size") % 9).cast("int"))
    return table(spark, sf_dir, "part").groupBy(node_type(label).alias("ctype")).agg(F.count("*").alias("n"))


QUERIES = {
    "bbox_scale": bbox_scale, "bbox_overlap_ratio": bbox_overlap, "bbox_union": bbox_union, "line_to_block": line_to_block, "leftover_lines": leftover_lines, "lines_outside": lines_outside, "best_iou_box": best_iou_box,
    "text_table_merge": text_table_merge, "span_islands": span_islands, "reading_order": reading_order, "font_mode": font_mode, "emphasis": emphasis, "rendered_lines": rendered_lines, "heading_detect": heading_detect,
    "layout_stats_2d": layout_stats, "table_fill": table_fill, "ocr_required": ocr_required, "layout_text_2d": layout_text_2d, "page_blocks": page_blocks, "heuristic_blocks": heuristic_blocks, "page_nodes": page_nodes, "pages_to_markdown": pages_to_markdown, "label_types": label_types,
}

_S = f"WITH {SQL}".replace("AS STRING", "AS VARCHAR")
_P = f"{_S}, {_PAIRS}"
ORACLES = {
    "bbox_scale": _S + " SELECT doc_id, ord, x1 / 2e0 AS s_x1, y1 / 4e0 AS s_y1, x2 / 2e0 AS s_x2, y2 / 4e0 AS s_y2, (x2 - x1) * (y2 - y1) AS area, x1 < x2 AND y1 < y2 AND x1 >= 0 AND y1 >= 0 AND x2 <= 1 AND y2 <= 1 AS is_valid, x2 - x1 > 0 AND y2 - y1 > 0 AND length(text) > 0 AND (CASE WHEN y2 > y1 THEN (x2 - x1) / (y2 - y1) > 1 ELSE false END OR length(text) < 4) AS is_valid_span FROM spans",
    "bbox_overlap_ratio": _P + " SELECT doc_id, page, ord, block_id, ratio, iou FROM pairs WHERE meets",
    "bbox_union": _S + " SELECT doc_id, page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM spans GROUP BY doc_id, page",
    "line_to_block": f"{_P}, {_ASSIGNED} SELECT * FROM assigned",
    "leftover_lines": f"{_P}, {_ASSIGNED} SELECT doc_id, page, ord FROM spans s WHERE NOT EXISTS (SELECT 1 FROM assigned a WHERE a.doc_id = s.doc_id AND a.page = s.page AND a.ord = s.ord)",
    "lines_outside": _P + " SELECT doc_id, page, ord FROM spans s WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.meets AND p.doc_id = s.doc_id AND p.page = s.page AND p.ord = s.ord)",
    "best_iou_box": _P + " SELECT doc_id, page, ord, block_id, iou FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, ord ORDER BY iou DESC, block_id) AS k FROM pairs WHERE iou > 0) WHERE k = 1",
    "text_table_merge": f"{_S}{_MERGE}",
    "span_islands": _S + ", g AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS g FROM spans), i AS (SELECT doc_id, page, g, min(ord) AS first, max(ord) AS last FROM g GROUP BY ALL) SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY first) - 1 AS run, first, last FROM i",
    "reading_order": _S + f", l AS (SELECT doc_id, page, ord % 4 + page AS block_id, max(ord) AS m FROM spans GROUP BY ALL), j AS (SELECT b.*, coalesce(m, -1) AS last_span FROM blocks b LEFT JOIN l USING (doc_id, page, block_id)) SELECT doc_id, page, block_id, last_span, row_number() OVER (PARTITION BY doc_id, page ORDER BY last_span, {_RANK}, block_id) - 1 AS place FROM j",
    "font_mode": f"{_S} SELECT doc_id, mode FROM {_MODE.format(_SIZE)}",
    "emphasis": f"{_S}, {_FLAGS} SELECT * FROM flags", "rendered_lines": f"{_S}, {_FLAGS}, {_LINES}", "heading_detect": f"{_S}, {_FLAGS}, {_HEADING}", "layout_stats_2d": f"{_S}, {_STATS}", "table_fill": f"WITH {_FILL}", "ocr_required": f"{_P}, {_ASSIGNED}, {_OCR}", "layout_text_2d": f"{_S}, {_GRID}", "page_blocks": f"{_S}, {_PAGE_BLOCKS}", "heuristic_blocks": f"{_S}, {_HEURISTIC}", "page_nodes": _NODES.format(f"{_S}, {_HEURISTIC}"),
    "pages_to_markdown": _S + " SELECT doc_id, string_agg(text || chr(10) || chr(10), '' ORDER BY page, ord) AS markdown FROM spans GROUP BY doc_id",
    "label_types": "SELECT (['header','header','formula','figure','table','list','para','para','code'])[p_size % 9 + 1] AS ctype, count(*) AS n FROM part GROUP BY 1",
}
