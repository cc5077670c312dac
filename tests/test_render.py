from __future__ import annotations

import random

import pytest

from quillforge.operators import render as R
from quillforge.operators.render import Node


def tree():
    root = Node("r", "root")
    items = Node("l", "list", "").add(Node("l1", "list", "1.").add(Node("i1", "inline", "a")), Node("l2", "list", "2.").add(Node("i2", "inline", "b")))
    table = Node("t", "table", "").add(Node("t1", "tablerow", "x,y"), Node("t2", "tablerow", "1,2"))
    return root.add(Node("p", "para", "P"), items, table)


def test_plain():
    assert R.render_plain(tree()) == "P\n1. a\n2. b\n\nx,y\n1,2"
    assert R.render_plain(Node("x", "para", "own", text="given")) == "given"


def test_markdown():
    assert R.render_markdown(Node("r", "root").add(Node("h", "header", "H").add(Node("p", "para", "p")))) == "# H\n\np"
    deep = Node("r", "root").add(Node("a", "header", "A").add(Node("b", "header", "B"), Node("c", "header", "### C")))
    assert R.render_markdown(deep) == "# A\n\n## B\n\n### C"
    assert R.render_markdown(Node("c", "code", "x = 1\n")) == "```\nx = 1\n```" and R.render_markdown(Node("c", "code", "```\nx\n```")) == "```\nx\n```"
    assert R.render_markdown(tree()) == "P\n  1. a\n  2. b\n\nx,y\n1,2"


def test_multi():
    root = Node("r", "root").add(Node("a", "para", "one"), Node("b", "figure", b"png", mimetype="image/png", text="alt"), Node("c", "para", "two"))
    parts = R.render_multi(root)
    assert parts[0] == "one\n\n" and parts[1]["content"] == b"png" and parts[2] == "\n\ntwo"
    assert R.render_multi(root, compat=True)[0] == "one" and R.render_multi(Node("r", "root")) == []


def test_clean():
    top = Node("0", "div", "", metadata={"level": 0})
    n = top
    for k in range(1, 4):
        child = Node(str(k), "div", "", metadata={"level": k})
        n.add(child)
        n = child
    n.add(Node("4", "inline", "text", mimetype="text/markdown", metadata={"level": 4}))
    R.clean(top)
    assert (top.content, top.mimetype, top.ctype, top.metadata, top.children) == ("text", "text/markdown", "div", {"level": 4}, [])
    two = Node("a", "div", "").add(Node("b", "para", "x"), Node("c", "para", "y"))
    assert len(R.clean(two).children) == 2
    kept = Node("a", "div", "own").add(Node("b", "para", "x"))
    assert R.clean(kept).content == "own" and len(kept.children) == 1
    grand = Node("a", "div", "").add(Node("b", "header", "H").add(Node("c", "para", "x")))
    assert R.clean(grand).children[0].parent is grand


def random_tree(rng, depth=0):
    n = Node(f"n{rng.random()}", rng.choice(["para", "header", "list", "div", "inline"]), " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 12))))
    for _ in range(rng.randint(0, 3) if depth < 4 else 0):
        n.add(random_tree(rng, depth + 1))
    return n


@pytest.mark.parametrize("seed", range(30))
def test_flatten_invariants(seed):
    rng = random.Random(seed)
    t = random_tree(rng)
    ids = {n.id for _, n in t.walk()}
    words = lambda s: [w for w in s.split() if not set(w) <= {"#"}]
    for size in (-1, 5, 20):
        out = R.flatten(t, size)
        assert all(len(p.split()) <= (size if size > 0 else 10**9) for p, _ in out)
        assert all(set(o) <= ids for _, o in out)
        assert [w for p, _ in out for w in words(p)] == [w for _, n in t.walk() for w in words(n.own)]


def test_flatten_uses_text_that_fits():
    n = Node("a", "div", "x", text="ready made").add(Node("b", "para", "y"))
    assert R.flatten(n, 10) == [("ready made", ["a", "b"])] and R.flatten(Node("e", "div", ""), 10) == []


def test_tables_of_nodes(spark):
    rows = [("d", "r", None, 0, "root", None, None, None, None), ("d", "h", "r", 0, "header", None, "H", None, None), ("d", "p", "h", 0, "para", None, "text", None, None), ("e", "x", None, None, "para", None, None, None, None)]
    t = spark.createDataFrame(rows, "doc_id string, chunk_id string, parent_id string, ord int, ctype string, mimetype string, content string, text string, metadata string")
    assert {r.doc_id: r.rendered for r in R.render(t, "markdown").collect()} == {"d": "# H\n\ntext", "e": ""}
    assert [(r.doc_id, r.content) for r in R.flatten_to_markdown(t).collect()] == [("d", "# H\n\ntext")]
    assert R.render(t.limit(0)).count() == 0
    with pytest.raises(NotImplementedError):
        R.render(t, "2d")
    assert [r.content for r in R.clean_tree(t).where("doc_id = 'd'").orderBy("depth").collect()] == ["H", "text"]


def test_flatten_without_a_bound_measures_nothing_twice():
    """The work of a wide tree grows with its nodes: before, each child measured and copied all text before it."""
    seen = []
    wide = Node("r", "header", "R").add(*[Node(f"h{k}", "header", f"H{k}").add(Node(f"p{k}", "para", "x y")) for k in range(300)], *[Node(f"c{k}", "para", "word") for k in range(300)])
    (text, owners), = R.flatten(wide, -1, lambda s: seen.append(len(s)) or len(s))
    assert sum(seen) <= 2 * len(text) and owners == [n.id for _, n in wide.walk()]
    assert text == R.render_markdown(wide)


@pytest.mark.parametrize("seed", range(3))
def test_tables_give_what_their_trees_give(spark, seed):
    rng = random.Random(seed)
    rows, trees = [], {}
    for d in ("a", "b"):
        trees[d] = random_tree(rng)
        rows += [(d, n.id, n.parent.id if n.parent else None, n.parent.children.index(n) if n.parent else 0, n.ctype, n.content) for _, n in trees[d].walk()]
    rng.shuffle(rows)
    t = spark.createDataFrame(rows, "doc_id string, chunk_id string, parent_id string, ord int, ctype string, content string")
    assert {r.doc_id: r.rendered for r in R.render(t, "markdown").collect()} == {d: R.render_markdown(n) for d, n in trees.items()}
    got = R.flatten_to_markdown(t, 20).orderBy("doc_id", "pos").collect()
    assert [(r.content, r.originals) for r in got] == [p for d in ("a", "b") for p in R.flatten(trees[d], 20)]
