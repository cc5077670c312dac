from __future__ import annotations

from quillforge.functions.splitting import word_len
from quillforge.operators import markdown as M
from quillforge.operators.render import Node, render_markdown


def test_setext():
    text = "Title\n===\nx\n---\n```\na\n---\n```"
    want = "# Title\n## x\n```\na\n---\n```"
    assert M.atx_from_setext(text) == want


def test_setext_table_is_the_same(spark):
    texts = ["Title\n===\nx\n---\n```\na\n---\n```", "===", "a\n\n---\nb", "", "a\n--- \nb\n==="]
    t = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in M.setext_to_atx(t).collect()}
    assert got == {i: M.atx_from_setext(x) for i, x in enumerate(texts)}


def test_headings():
    s = M.cut_at_headings("intro\n# A\ntext a\n## B\ntext b\n# C\ntext c\n")
    assert [(x["heading"], x["level"], x["parent"], x["prev"]) for x in s] == [("# A", 1, None, None), ("## B", 2, 0, None), ("# C", 1, None, 0)]
    assert s[0]["content"].startswith("intro") and s[0]["section_text"].endswith("text b\n")
    assert M.cut_at_headings("# one\nonly") == [] and M.cut_at_headings("```\n# no\n# no\n```") == []
    assert [x["parent"] for x in M.cut_at_headings("## deep\n# top\n### c\n## d\n")] == [None, None, 1, 1]


def test_combine_and_collapse():
    text = "# A\nx\n# B\ny y y\n# C\nz"
    found = M.find_headings(text)
    kept = M.combine_small([f[0] for f in found], [f[2] for f in found], 5, word_len, text)
    assert [text[found[i][0] : found[i][1]] for i in kept] == ["# A", "# C"]
    text = "# A\nx\n## B\ny\n# C\nz z z z z z\n"
    found = M.find_headings(text)
    kept = M.collapse_only_children([f[0] for f in found], [f[2] for f in found], 5, word_len, text)
    assert [text[found[i][0] : found[i][1]] for i in kept] == ["# A", "# C"]


def test_split_by_heading_table(spark):
    t = spark.createDataFrame([(1, "# A\nx\n## B\ny"), (2, "plain"), (3, ""), (4, None)], "doc_id int, text string")
    got = [(r.doc_id, r.section, r.heading, r.parent) for r in M.split_by_heading(t).orderBy("doc_id", "section").collect()]
    assert got == [(1, 0, "# A", None), (1, 1, "## B", 0), (2, 0, None, None), (3, 0, None, None)]
    assert M.split_by_heading(t, 100).where("doc_id = 1").count() == 1


def test_blocks():
    text = "Top\n===\n\npara one\nstill\n\n- a\n  - b\n- c\n\n1. x\n2. y\n\n| h | k |\n|---|---|\n| 1 | 2 |\n\n```py\n# no heading\n```\n\n## Sub\n***\n<div>\nhi\n</div>\n"
    root = M.parse_blocks(text, Node("r", "root"))
    kinds = [(d, n.ctype) for d, n in root.walk()]
    assert kinds[:3] == [(0, "root"), (1, "header"), (2, "para")]
    assert [n.ctype for n in root.children[0].children] == ["para", "list", "list", "table", "code", "header"]
    assert [n.ctype for n in root.children[0].children[-1].children] == ["para", "code"]
    out = render_markdown(root)
    assert "- a" in out and "- b" in out and "1. x" in out and "2. y" in out and "| 1 | 2 |" in out
    assert M.parse_blocks("", Node("r", "root")).children == []
