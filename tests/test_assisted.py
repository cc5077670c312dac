from __future__ import annotations

import pytest

from quillforge.operators import assisted as A
from quillforge.operators import chunkers


def test_lumber_groups():
    splits = ["a b c", "d e f", "g h i", "j"]
    assert chunkers.lumber_groups(splits, 10, lambda s: len(s.split())) == [(0, 2), (2, 4)]
    assert chunkers.lumber_groups(splits, 1, lambda s: len(s.split())) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert chunkers.lumber_groups(splits, 100, lambda s: len(s.split()), lambda at, w: at + 1) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert chunkers.lumber_groups(splits, 100, lambda s: len(s.split()), lambda at, w: None) == [(0, 4)]


def test_lumber_with_a_model(spark):
    t = spark.createDataFrame([(1, ". ".join(f"sentence number {i} has some words in it" for i in range(20))), (2, None), (3, "short")], "doc_id int, text string")
    off = A.lumber(t, None, 40).collect()
    asked = A.lumber(t, lambda: A.Scripted(default='```json\n{"split_index": 1}\n```'), 40).collect()
    unread = A.lumber(t, lambda: A.Scripted(default="what?"), 40).collect()
    assert [r.content for r in off] == [r.content for r in unread] and len(asked) > len([r for r in off if r.doc_id == 1]) and [r.content for r in off if r.doc_id == 3] == ["short"]


def test_propositions_and_groups(spark):
    t = spark.createDataFrame([("c1", "cats purr"), ("c2", "nothing"), ("c3", None)], "chunk_id string, content string")
    got = A.propositions(t, lambda: A.Scripted({"cats": '```json\n["Cats purr.", "Cats exist."]\n```'}, "none")).collect()
    assert [(r.pos, r.content, r.originals) for r in got] == [(0, "Cats purr.", ["c1"]), (1, "Cats exist.", ["c1"])]
    s = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("d", 2, "a again")], "doc_id string, pos int, content string")

    class Groups:
        def complete(self, message, system=None, schema=None, attachments=None):
            if "belong" in message:
                ids = [line.split()[1].rstrip(":") for line in message.split("\n") if line.startswith("Group")]
                return ids[0] if message.endswith("a again") else "No group"
            return "S"

    got = [(r.group_index, r.content, r.originals) for r in A.agentic(s, Groups).orderBy("group_index").collect()]
    assert got == [(0, "a a again", ["0", "2"]), (1, "b", ["1"])]


def test_toc_levels(spark):
    t = spark.createDataFrame([("d", i, f"h{i}") for i in range(3)], "doc_id string, ord int, content string")
    got = A.toc_levels(t, lambda: A.Scripted(default="# ID `0`\n## ID `2`\n# ID `77`")).orderBy("ord").collect()
    assert [(r.ord, r.level) for r in got] == [(0, 1), (2, 2)]


def test_tools_and_models():
    tool = A.as_tool(chunkers.pack_pieces)
    assert tool["name"] == "pack_pieces" and tool["parameters"]["size"] == {"type": "integer", "required": False, "default": 50} and tool["description"]
    with pytest.raises(KeyError):
        A.get_model("nope")
    A.register_model("m", A.Scripted)
    assert A.get_model("m") is A.Scripted and A.get_model() is A.Scripted
    assert A.missing_modules(["json", "surely_not_there"]) == ["surely_not_there"]


def test_chunkers_edges(spark):
    t = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "x")], "doc_id int, text string")
    with pytest.raises(ValueError):
        chunkers.chunk_by_characters(t, 5, 5)
    with pytest.raises(ValueError):
        chunkers.pack_pieces(t, "\n", 5, 9)
    assert {(r.doc_id, r.content) for r in chunkers.chunk_by_characters(t, 50, 0).collect()} == {(2, ""), (3, "one two"), (None, "x")}
    assert {(r.doc_id, r.content) for r in chunkers.pack_pieces(t).collect()} == {(3, "one two"), (None, "x")}
    code = spark.createDataFrame([(1, "def a():\n    x\n\ndef b():\n    y\n")], "doc_id int, text string")
    assert [r.content for r in chunkers.chunk_code(code, 20).collect()] == ["def a():\n    x", "def b():\n    y"]
    assert chunkers.lumber_chunks(t.limit(0)).count() == 0
