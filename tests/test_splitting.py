from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillforge.functions import text
from quillforge.functions.splitting import JSON_MARKS, default_separators, pack, split_keep, split_recursive, split_repacked, word_len


@pytest.mark.parametrize(
    ("pieces", "size", "overlap", "want"),
    [(["a b", "c d", "e f"], 4, 2, ["a b c d", "c d e f"]), (["a b c d e", "f"], 3, 0, ["a b c d e", "f"]), ([], 3, 0, []), ([" ", "a"], 3, 0, ["a"])],
)
def test_pack(pieces, size, overlap, want):
    assert pack(pieces, " ", size, overlap) == want


def test_split_keep():
    assert split_keep("a.b.c", ".", "start") == ["a", ".b", ".c"]
    assert split_keep("a.b.c", ".", "end") == ["a.", "b.", "c"]
    assert split_keep("a.b.c", ".", None) == ["a", "b", "c"]
    assert split_keep("abc", "", None) == ["a", "b", "c"] and split_keep("abc", ".", "end") == ["abc"] and split_keep("", ".", "start") == []


def test_recursive_golden():
    assert split_recursive("one two three four five six", default_separators("one two three four five six"), 3) == ["one two three", "four five six"]
    assert split_recursive("one two three four five six", default_separators(""), 3) == ["one", "two", "thr", "ee f", "our", "fiv", "e si", "x"]


def test_separators():
    assert default_separators("a  b\nc d")[:3] == ["  ", "\n", " "]
    assert default_separators("a  b\n\nc\nd", newlines_first=True)[:3] == ["\n\n", "\n", "  "]
    assert default_separators("abc")[0] == "." and default_separators("abc")[-1] == ""


texts = st.text(st.sampled_from("ab .\n,;"), max_size=120)


@given(texts, st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_pieces_are_bounded_and_in_order(text, size):
    out = split_recursive(text, default_separators(text), size, 0, "start", False, len)
    assert "".join("".join(out).split()) == "".join(text.split())
    assert all(len(p) <= size for p in out)
    again = split_repacked(text, default_separators(text, True), size, "start", False, len)
    assert "".join("".join(again).split()) == "".join(text.split()) and all(len(p) <= size for p in again)


@given(st.lists(st.text("ab ", min_size=1, max_size=6), max_size=20), st.integers(2, 8), st.integers(0, 1))
@settings(max_examples=200, deadline=None)
def test_pack_is_bounded_but_for_single_pieces(pieces, size, overlap):
    for p in pack(pieces, " ", size, overlap):
        assert word_len(p) <= size or p in pieces


def test_json_marks_keep_the_text():
    text = '[{"k": 1}, {"k": [2, 3]}, {"z": "q"}]'
    assert "".join(split_recursive(text, JSON_MARKS, 3, 0, "end", False, len)).replace(" ", "") == text.replace(" ", "")


def test_separators_with_end_signs(spark):
    t = spark.createDataFrame([("a\\Eb\\E.c",)], "t string")
    assert t.select(text.split_keep(F.col("t"), "\\E", None).alias("p")).first().p == ["a", "b", ".c"]
