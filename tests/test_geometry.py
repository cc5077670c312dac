from __future__ import annotations

from pyspark.sql import functions as F

from quillforge.operators import geometry as G
from quillforge.operators import layout


def test_overlap_ratio_is_by_the_second_box(spark):
    one = spark.range(1).select(G.overlap_ratio([F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)], [F.lit(x) for x in (0.5, 0.5, 1.5, 1.5)]).alias("r"), G.iou([F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)], [F.lit(x) for x in (0.5, 0.5, 1.5, 1.5)]).alias("i")).first()
    assert one.r == 0.25 and abs(one.i - 0.25 / 1.75) < 1e-12


def test_runs(spark):
    t = spark.createDataFrame([(1, x) for x in (0, 1, 2, 5, 6, 9)], "k int, o int")
    got = [(r.run, r.o) for r in G.runs(t, ["k"], "o").orderBy("o").collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 5), (1, 6), (2, 9)]


def test_mode_ties_go_to_the_least(spark):
    t = spark.createDataFrame([(1, 9.6), (1, 10.2), (1, 12.0), (1, 12.4), (2, None)], "k int, v double")
    assert {r.k: r.mode for r in G.mode_of(t, ["k"], F.col("v"), 7).collect()} == {1: 10, 2: 7}


def test_font_size(spark):
    cases = [
        (11.0, "A", 0.0, "x", 11.0), (1.0, "Foo12", 0.0, "x", 12.0), (1.0, "A4-Foo9b", 0.0, "x", 9.0), (1.0, "F0", 0.0, "x", 0.0), (1.0, "Foo", 0.0, "x", 0.2), (1.0, "Foo", 180.0, "x", 0.2), (1.0, "Foo", 90.0, "x", 0.5),
        (1.0, "Foo", -90.0, "x", 0.5), (1.0, "Foo", 270.0, "x", 0.5), (1.0, "Foo", -270.4, "x", 0.5), (1.0, "Foo", 45.0, "x", 1.0), (1.0, "Foo", 0.0, "a\nb", 1.0), (None, None, 0.4, "x", 0.2),
    ]
    t = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, s double, n string, r double, t string")
    b = [F.lit(x) for x in (0.0, 0.0, 0.5, 0.2)]
    assert [r.f for r in t.select("i", G.font_size(F.col("s"), F.col("n"), b, F.col("r"), F.col("t")).alias("f")).orderBy("i").collect()] == [c[4] for c in cases]


def test_valid_spans(spark):
    cases = [("abcd", 0.5, 0.2, True), ("abcd", 0.1, 0.2, False), ("abc", 0.1, 0.2, True), ("   ", 0.1, 0.2, True), ("", 0.5, 0.2, False), ("a", 0.0, 0.2, False), ("a", 0.2, 0.0, False), ("abcd", 0.2, 0.2, False), (None, 0.5, 0.2, False)]
    t = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, w double, h double")
    got = t.select("i", G.is_valid_span([F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h")], F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [c[3] for c in cases]


BOX = "doc_id int, page int, block_id bigint, class string, x1 double, y1 double, x2 double, y2 double"
LINE = "doc_id int, page int, block_id bigint, ord bigint, text string, x1 double, y1 double, x2 double, y2 double"


def test_lines_out_of_the_page_are_left_over(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "text", 0.0, 0.0, 1.0, 1.0), (1, 0, 1, "title", 0.0, 0.0, 0.5, 0.5)], BOX)
    lines = spark.createDataFrame([(1, 0, 0, 0, "in", 0.1, 0.1, 0.4, 0.2), (1, 0, 0, 1, "out", 0.8, 0.1, 1.1, 0.2), (1, 0, 0, 2, "text", 0.6, 0.6, 0.9, 0.7), (1, 0, 0, 3, "flat", 0.1, 0.3, 0.4, 0.3)], LINE).drop("block_id")
    keys = ["doc_id", "page"]
    assert {r.ord: r.block_id for r in G.assign_lines(lines, blocks, keys, "ord").collect()} == {0: 1, 2: 0}
    assert {r.text for r in G.leftover_lines(lines, blocks, keys, "ord").collect()} == {"out", "flat"}


def test_pages_that_need_recognition(spark):
    rows = [(1, 0, "table", 0, False), (1, 0, "text", 0, False), (1, 0, "title", 0, False), (1, 0, "caption", 0, False), (1, 0, "figure", 3, False)]
    rows += [(1, 1, "table", 2, False), (1, 1, "text", 0, False), (1, 1, "text", 0, False), (1, 1, "text", 0, False)]  # 3 of 4 isn't enough
    rows += [(1, 2, "text", 0, True), (1, 3, "figure", 5, False)]  # nothing under it: a picture; no block of text
    t = spark.createDataFrame(rows, "doc_id int, page int, class string, n_lines int, is_empty boolean")
    assert {r.page: r.needs_ocr for r in G.needs_ocr(t, ["doc_id", "page"]).collect()} == {0: True, 1: False, 2: False, 3: True}


def test_blocks_and_tables_merge(spark):
    keys = ["doc_id", "page"]
    lines = spark.createDataFrame([(1, 0, 0, 0, "a", 0.0, 0.0, 0.2, 0.1), (1, 0, 0, 1, "b", 0.0, 0.2, 0.2, 0.3), (1, 0, 0, 2, "c", 0.0, 0.4, 0.2, 0.5), (1, 0, 1, 3, "d", 0.0, 0.6, 0.2, 0.7), (1, 0, 2, 4, "e", 0.0, 0.9, 0.2, 1.0)], LINE)
    texts = spark.createDataFrame([(1, 0, 0, "a b c", 0.0, 0.0, 0.2, 0.5), (1, 0, 1, "d", 0.0, 0.6, 0.2, 0.7), (1, 0, 2, "e", 0.0, 0.9, 0.2, 1.0)], "doc_id int, page int, block_id bigint, text string, x1 double, y1 double, x2 double, y2 double")
    tables = spark.createDataFrame([(1, 0, 7, "table", 0.0, 0.15, 0.3, 0.35), (1, 0, 8, "table", 0.1, 0.55, 0.3, 0.75), (1, 0, 9, "table", 0.7, 0.0, 0.9, 0.9)], BOX)
    got = sorted((r.place, r.kind, r.item, r.text, r.y1, r.y2) for r in G.merge_tables(texts, lines, tables, keys).collect())
    assert got == [(0, 0, 0, "a c", 0.0, 0.5), (0, 1, 7, None, 0.15, 0.35), (1, 1, 8, None, 0.55, 0.75), (2, 0, 2, "e", 0.9, 1.0)]


def test_grid_text():
    s = lambda t, x, y, line, w=None: {"text": t, "x1": x, "y1": y, "x2": x + (w or 0.1 * len(t)), "y2": y + 0.1, "line": line}
    assert G.grid_text([]) == "" and G.grid_text([s(" ", 0.0, 0.0, 0)]) == ""
    # a character is 0.1 wide, 0.09 of the grid; rows are 0.11 high
    assert G.grid_text([s("abc", 0.0, 0.0, 0), s("de", 1.0, 0.0, 0), s("fgh", 0.0, 0.33, 1)]) == " abc       de\n\n\n fgh\n"
    # spans that would overlap: a line of more than eight characters breaks where another begins
    long = [s("abcdefghij", 0.0, 0.0, 0), s("kl", 0.2, 0.0, 1)]
    assert G.grid_text(long) == " abcdefghij\n  kl\n"
    assert G.grid_text(long, break_lines=False) == " abcdefghij kl\n"
    assert G.grid_text([{**x, "line": None} for x in long]) == " abcdefghij kl\n"
    # one of up to eight characters doesn't, unless the columns are far apart
    assert G.grid_text([s("abcdefgh", 0.0, 0.0, 0), s("kl", 0.2, 0.0, 1)]) == " abcdefgh kl\n"
    # with rescale the grid gets finer, first in width
    assert G.grid_text([s("abcdefghij", 0.0, 0.0, 0), s("kl", 0.7, 0.0, 0)], 1.0, 1.0, True) == " abcdefghij kl\n"
    assert G.grid_text([s("b", 0.5, 0.0, 0), s("a", 0.0, 0.0, 0)], by_place=True, break_lines=False) == " a    b\n"


def test_collapse():
    assert G.collapse_blanks("\n\na\n\n\n \nb\n\n") == "a\n\nb"
    assert G.collapse_blanks("a   b\nc   d", columns=True) == "a b\nc d"


def test_empty_tables(spark):
    t = spark.createDataFrame([], "doc_id int, page int, ord bigint, line bigint, x1 double, y1 double, x2 double, y2 double, text string, class string, block_id bigint, font_weight int, font_name string, font_size double, rotation double, width double, height double")
    keys = ["doc_id", "page"]
    assert G.assign_lines(t, t, keys, "ord").count() == 0 and G.layout_text(t, ["doc_id"]).count() == 0 and G.merge_tables(t, t, t, keys).count() == 0
    assert layout.page_blocks(t, t.drop("line", "ord", "text"), t.select(*keys, "width", "height"), keys).count() == 0 and layout.heuristic_blocks(t.drop("class", "width", "height"), t.select(*keys, "width", "height"), keys).count() == 0
    assert layout.full_pages(t.drop("width", "height"), t.select(*keys, "width", "height"), keys).count() == 0


def test_a_page_with_all_kinds_of_blocks(spark):
    keys = ["doc_id", "page"]
    heavy = lambda k: 700 if k == 0 else 300
    spans = [(1, 0, k, k, t, *map(float, b), heavy(k), "Times-Italic" if k == 4 else "Times") for k, (t, *b) in enumerate([
        ("Title", 10, 5, 40, 9), ("one ", 10, 20, 30, 24), ("two", 10, 26, 30, 30), ("r1", 10, 50, 20, 54), ("left", 60, 60, 80, 64), ("over", 60, 66, 80, 70), ("out", 95, 80, 120, 84)])]
    t = spark.createDataFrame(spans, "doc_id int, page int, line bigint, ord bigint, text string, x1 double, y1 double, x2 double, y2 double, font_weight int, font_name string")
    t = t.unionByName(spark.createDataFrame([(1, 0, 3, 7, "r2", 30.0, 50.0, 40.0, 54.0, 300, "Times")], t.schema)).unionByName(spark.createDataFrame([(1, 0, 9, 20, "tail", 10.0, 90.0, 30.0, 94.0, 300, "Times")], t.schema))
    boxes = spark.createDataFrame([(1, 0, 0, "text", 0.05, 0.15, 0.5, 0.35), (1, 0, 1, "title", 0.05, 0.0, 0.5, 0.12), (1, 0, 2, "table", 0.05, 0.45, 0.5, 0.6), (1, 0, 3, "figure", 0.6, 0.0, 0.9, 0.3), (1, 0, 4, "caption", 0.6, 0.4, 0.9, 0.5), (1, 0, 5, "logo", 0.0, 0.0, 1.0, 1.0)], BOX)
    pages = spark.createDataFrame([(1, 0, 100.0, 100.0)], "doc_id int, page int, width double, height double")
    got = layout.page_blocks(t, boxes, pages, keys).orderBy("place").collect()
    assert [(r["class"], r.ctype, r.text, r.n_lines) for r in got] == [
        ("figure", "figure", "", 0), ("title", "header", "Title", 1), ("text", "para", "one two", 2), ("text", "para", "*left* overout", 3), ("table", "table", "```table\n r1 r2\n```", 1), ("text", "para", "tail", 1),
    ]
    assert abs(got[3].x2 - 0.8) < 1e-12  # the box is that of the spans in the page
    nodes = layout.block_nodes(layout.page_blocks(t, boxes, pages, keys), keys).orderBy("path").collect()
    assert [n.ctype for n in nodes] == ["root", "figure", "header", "para", "para", "table", "para"] and nodes[1].parent_id == "1"
    whole = layout.full_pages(t, pages, keys).first()
    assert whole.text.startswith("```page\n") and "Title" in whole.text and abs(whole.x2 - 1.2) < 1e-12


def test_emphasis_of_a_line():
    s = lambda t, b=False, i=False: {"text": t, "bold": b, "italic": i}
    assert layout.emphasised([s("a ", True), s(" ", False), s("b", True)]) == "**a  b** "
    assert layout.emphasised([s("a", True), s("b"), s("c*", True), s(" d ", True, True)]) == "**a** bc\\****d*** "
    assert layout.emphasised([s("x*y", True, True)]) == "***x\\*y*** " and layout.emphasised([s("  ")]) == "  "


def test_sparse_text_keeps_its_layout():
    rows = [{"text": f"w{k}", "line": k, "x1": 0.0 if k % 2 else 0.8, "y1": 0.1 * k, "x2": 0.1 if k % 2 else 0.9, "y2": 0.1 * k + 0.05, "bold": False, "italic": False} for k in range(8)]
    assert layout.render_block("text", rows).startswith("```text\n") and layout.render_block("text", rows, sparse_text=False) == "w0w1w2w3w4w5w6w7"
    assert layout.render_block("text", []) is None and layout.render_block("figure", []) == "" and layout.render_block("text", [{**rows[0], "text": " "}]) is None


def test_boxes_are_never_broadcast(spark, sf):
    """Boxes are many times the files that Spark guesses their size from."""
    from quillforge.plans.catalogue import QUERIES

    for name in ("bbox_overlap_ratio", "best_iou_box", "ocr_required", "line_to_block", "leftover_lines", "lines_outside", "text_table_merge", "reading_order", "page_blocks"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan, name


def test_spans_are_shuffled_by_document_only(spark, sf):
    import __spark_entry__

    for name in ("heading_detect", "heuristic_blocks", "page_nodes", "text_table_merge", "span_islands", "layout_text_2d", "ocr_required", "page_blocks"):
        plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        assert keys and all(k.startswith("doc_id#") and not k.split(",")[1].strip().startswith("page") for k in keys), (name, keys)


def test_usual_values_are_those_of_the_joined_modes(spark):
    rows = [(1, p, o, w) for p, o, w in [(0, 1, 400.0), (0, 2, 300.0), (1, 3, 400.5), (1, 4, 300.0), (2, 5, None), (9, 6, 900.0), (7, 7, 900.0), (8, 8, 900.0), (6, 9, 900.0)]] + [(2, 0, 1, None), (3, None, 1, 5.0), (4, 3, 1, 2.5), (4, 3, 2, 3.5), (4, 2, 3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, page bigint, ord bigint, w double")
    joined = df.where("page IS NOT NULL").join(G.mode_of(G.first_pages(df), ["doc_id"], F.col("w"), 7), "doc_id")
    got = G.with_usual(df, "doc_id", "page", {"mode": (F.col("w"), 7)})
    assert got.columns == joined.columns and sorted(got.collect(), key=str) == sorted(joined.collect(), key=str)
    assert {r.doc_id: r["mode"] for r in got.collect()} == {1: 300, 2: 7, 4: 2}


def test_tasks_grow_with_the_files(spark, sf, monkeypatch):
    from quillforge.plans import layout_plans, tables

    monkeypatch.setattr(tables, "TASK_BYTES", 4000)
    s, b = layout_plans.spans(spark, sf), layout_plans.blocks(spark, sf)
    numbers = {df._jdf.queryExecution().toRdd().getNumPartitions() for df in (s, b)}
    assert len(numbers) == 1 and numbers.pop() > 4


def test_odd_lines_and_boxes_of_a_page():
    """Lines without a number belong nowhere but count in the runs; copies of a box's number share its lines; spans out of the page don't widen a block."""
    s = lambda line, o, x, y, w=300: (line, o, f"t{o}", x, y, x + 10, y + 4, w, False)
    spans = [s(0, 0, 10, 10), s(None, 1, 50, 10), s(2, 2, 50, 20), s(3, 3, 50, 30), s(5, 9, 95, 80), s(6, 12, 10, 60)]
    boxes = [(7, "text", 0.0, 0.0, 0.3, 0.3), (7, "title", 0.0, 0.0, 0.3, 0.3), (None, "figure", 0.0, 0.5, 0.3, 0.8)]
    got = layout.blocks_of_page(spans, boxes, 100.0, 100.0)
    assert [(k, kind, [c["text"] for c in cells]) for k, kind, _, cells in got] == [(None, "figure", []), (7, "title", ["t0"]), (7, "text", ["t0"]), (8, "text", ["t2", "t3"])]
    assert got[3][2] == (0.5, 0.2, 0.6, 0.34) and layout.blocks_of_page([], [], None, None) == []
    assert layout.blocks_of_page(spans, [], None, None) == []


def test_spans_are_read_once_by_page_blocks(spark, sf):
    """Lines and boxes are each gathered once, not joined step by step."""
    import __spark_entry__

    plan = __spark_entry__.queries()["page_blocks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") <= 3 and plan.count("FileScan") <= 4
