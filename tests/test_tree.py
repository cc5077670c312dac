from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillforge.operators import toc, tree


@pytest.fixture
def nodes(spark):
    rows = [("d", "r", None, 0), ("d", "a", "r", 0), ("d", "b", "r", 1), ("d", "a1", "a", 0), ("d", "a2", "a", 1), ("d", "b1", "b", 0), ("d", "lost", "nobody", 0), ("e", "x", None, 0)]
    t = spark.createDataFrame(rows, "doc_id string, chunk_id string, parent_id string, ord int").withColumns({"ctype": F.lit("para"), "content": F.col("chunk_id"), "mimetype": F.lit("text/plain"), "text": F.lit(None).cast("string"), "metadata": F.lit(None).cast("string")})
    return tree.with_paths(t).cache()


def test_paths_and_walk(nodes):
    got = [(r.chunk_id, r.depth) for r in tree.walk(nodes).where("doc_id = 'd'").orderBy("step").collect()]
    assert got == [("r", 0), ("a", 1), ("a1", 2), ("a2", 2), ("b", 1), ("b1", 2)]


def test_walk_from(nodes):
    start = nodes.where("chunk_id = 'a'")
    ids = lambda df: [r.chunk_id for r in df.orderBy("path").collect()]
    assert ids(tree.walk_from(nodes, start)) == ["a", "a1", "a2", "b", "b1"] and ids(tree.walk_from(nodes, start, False)) == ["a", "a1", "a2"]


def test_nav(nodes):
    one = lambda **kw: {r.chunk_id: r.target_id for r in tree.nav(nodes, **kw).collect()}
    assert one(next=1)["a"] == "b" and one(prev=1)["b"] == "a" and one(parent=2)["a1"] == "r" and one(child=2)["r"] == "a1" and one(child=3)["r"] is None
    assert set(one().values()) == {None} and one(next=1, parent=1)["a1"] == "a2"


def test_changes(spark, nodes):
    new = spark.createDataFrame([("d", "n1", "a", 0), ("d", "n2", "a", 1), ("d", "n3", "gone", 0)], "doc_id string, chunk_id string, parent_id string, ord int")
    got = {r.chunk_id: (r.ord, r.path) for r in tree.add_children(nodes, new).collect()}
    assert got["n1"] == (2, [0, 0, 2]) and got["n2"] == (3, [0, 0, 3]) and "n3" not in got
    with pytest.raises(ValueError):
        tree.clone(nodes, "x", overrides={"nope": F.lit(1)})
    alone = tree.clone(nodes, "x", relations=False).collect()
    assert all(r.parent_id is None and r.path == [0] for r in alone) and len({r.chunk_id for r in alone}) == len(alone)


def test_merge_needs_one_media_type(nodes):
    m = nodes.withColumn("metadata", F.create_map(F.lit("k"), F.col("chunk_id")))
    a, b = m.where("chunk_id = 'a'"), m.where("chunk_id = 'b'")
    assert tree.merge_pairs(a, b, "doc_id").first().metadata == {"k": "ab"}
    with pytest.raises(Exception, match="media types"):
        tree.merge_pairs(a, b.withColumn("mimetype", F.lit("image/png")), "doc_id").collect()


def test_toc(spark):
    t = spark.createDataFrame([("d", i, level) for i, level in enumerate([1, 2, 2, 1, 3])], "doc_id string, i int, level int")
    assert [r.parent for r in toc.level_parents(t, "doc_id", "i", "level").orderBy("i").collect()] == [None, 0, 0, None, 3]
    rows = [("d", k, [0, i], c) for i, (k, c) in enumerate([("p0", "para"), ("h0", "header"), ("p1", "para"), ("h1", "header"), ("p2", "para")])]
    n = spark.createDataFrame(rows, "doc_id string, chunk_id string, path array<int>, ctype string")
    got = {(r.chunk_id, r.parent_id, r.ord) for r in toc.group_by_header(n).collect()}
    assert got == {("p0", None, 0), ("h0", None, 1), ("h1", None, 2), ("p1", "h0", 0), ("p2", "h1", 0)}
    said = spark.createDataFrame([("# ID `0`\n## ID `2`\nnoise",)], "a string").select(toc.parse_levels(F.col("a")).alias("x")).first().x
    assert [(x.id, x.level) for x in said] == [(0, 1), (2, 2)]


def test_groups(spark):
    kind = "root_id string, group_ord bigint, chunk_id string"
    one, two = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b")], kind), spark.createDataFrame([("r", 0, "c"), ("s", 0, "d"), (None, 0, "e")], kind)
    both = tree.add_group(one, two)
    assert {(r.root_id, r.group_ord, r.chunk_id) for r in both.collect()} == {("r", 0, "a"), ("r", 1, "b"), ("r", 2, "c"), ("s", 0, "d"), (None, 0, "e")}
    new = spark.createDataFrame([("x", 0), ("y", 1)], "chunk_id string, ord bigint")
    assert {(r.root_id, r.group_ord, r.chunk_id) for r in tree.extend_group(one, new).collect()} == {("r", 0, "a"), ("r", 1, "b"), ("r", 2, "x"), ("r", 3, "y")}
    assert {(r.root_id, r.group_ord) for r in tree.extend_group(one.limit(0), new).collect()} == {(None, 0), (None, 1)}
    with pytest.raises(ValueError):
        tree.extend_group(both, new)
