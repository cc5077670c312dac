from __future__ import annotations

import itertools
import os
import random

import pytest
import sentencepiece

from quillforge.llm import sentencepieces as S
from quillforge.llm.bpe import Merges

pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no tokenizer files")
PARTS = ["th", "the", "er", "é", "aux", "  ", "   ", " ", "    ", "日", "x", "qz", "1", "23", ".", "(", ")", "=", "ing", "▁", "\n", "\t", "😀", "antidisestablishment"]


def texts(seed=3, n=150):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return out + ["ab" * 4000, "a" * 59, "a" * 60, "a" * 61, "a" * 62, "b" * 63, "<s> </s>"]


@pytest.mark.parametrize("limit", [S.DICTIONARY_BYTES, 2000, 0])
def test_is_the_librarys_encoding(docs, limit):
    model, lib = S.read_model(), sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    t = docs(list(enumerate(texts())))
    out = S.encode(t, model, limit, decoded=True)
    assert out.columns == [*t.columns, "piece_ids", "decoded"]
    rows = out.collect()
    assert len(rows) == t.count()
    others = [c for c in t.columns if c != "text"]  # among them those of the names used inside
    assert sorted(str([r[c] for c in others]) for r in rows) == sorted(str([r[c] for c in others]) for r in t.collect())
    for r in rows:
        assert r.piece_ids == lib.encode(r.text)
        assert r.decoded == r.text.replace("▁", " ")


def test_edges(docs):
    model = S.read_model()
    rows = [(1, None), (2, ""), (None, "the one"), (3, "the one"), (3, "the one"), (4, " lead"), (5, "trail ")]
    t = docs(rows).withColumnRenamed("sig", "piece_ids").withColumnRenamed("ids", "decoded")
    got = S.decode(S.encode(t, model), model)
    assert sorted(got.columns) == sorted(t.columns)
    by = sorted(((r.doc_id, r.piece_ids, r.decoded) for r in got.collect()), key=str)
    assert (1, None, None) in by and (2, [], "") in by and sum(x[2] == "the one" for x in by) == 3 and (4, model.encode_unit("▁▁lead"), " lead") in by
    assert all(r.decoded == r.text for r in got.collect())
    assert S.encode(docs([]), model).count() == 0


def unigram() -> S.PieceModel:
    m = S.PieceModel(["<unk>", "a", "b", "ab", "aab", "ba", "▁", "▁a"], [0, -2.0, -2.5, -3.0, -4.5, -4.2, -1.0, -2.9], [1, 2, 3, 4, 5, 6, 7], True, None, 0, True)
    m.usable.sort(key=lambda i: (-m.scores[i], i))
    return m


def test_viterbi_is_the_best_of_all_splits(spark):
    m, rng = unigram(), random.Random(0)
    words = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    got = S.encode(spark.createDataFrame(list(enumerate(words)), "i int, text string"), m).collect()
    index = {m.pieces[i]: i for i in m.usable}
    for r in got:
        unit = "▁" + r.text.replace(" ", "▁")
        best = -1e9
        for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
            parts, part = [], unit[0]
            for c, x in zip(cuts, unit[1:], strict=True):
                if c:
                    parts.append(part)
                    part = ""
                part += x
            parts.append(part)
            if all(p in index for p in parts):
                best = max(best, sum(m.scores[index[p]] for p in parts))
        assert abs(sum(m.scores[i] for i in r.piece_ids) - best) < 1e-9 and "".join(m.pieces[i] for i in r.piece_ids) == unit


def test_merges_against_simulation():
    m = Merges([b"ab", b"bc", b"abc", b"cab", b"abcab", b"a", b"b", b"c", b"aa", b"aaaa"])

    def simulate(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            at = min(((m.index[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in m.index), default=None)
            if at is None:
                return parts
            parts[at[1] : at[1] + 2] = [parts[at[1]] + parts[at[1] + 1]]

    for n in range(1, 8):
        for w in itertools.product(b"abc", repeat=n):
            assert [m.tokens[t] for t in m.encode(bytes(w))] == simulate(bytes(w))


def test_the_dictionary_comes_to_the_driver_in_parts(spark, monkeypatch):
    table = spark.range(60_000, numPartitions=12).selectExpr("xxhash64(id) AS h", "id % 5 + 1 AS n", "transform(sequence(0, cast(id % 3 AS int)), k -> cast(id % 900 + k AS int)) AS ids")
    kind, got = type(table), []
    whole, parts = kind.toArrow, kind.toLocalIterator

    def note(size, x):
        got.append(size)
        return x

    monkeypatch.setattr(kind, "toArrow", lambda self: note((x := whole(self)).nbytes, x))
    monkeypatch.setattr(kind, "toLocalIterator", lambda self, **kw: (note(sum(map(len, r)), r) for r in parts(self, **kw)))
    d, others = S.split_dictionary(table)
    size = d.keys.nbytes + d.first.nbytes + d.ids.nbytes
    assert others is None and len(d.keys) == 60_000 and max(got) < size / 6
    due = {r.h % (1 << 64): r.ids for r in table.collect()}
    assert all(due[int(k)] == d.ids[a:b].tolist() for k, a, b in zip(d.keys, d.first[:-1], d.first[1:], strict=True)) and (d.keys[1:] > d.keys[:-1]).all()
    d, others = S.split_dictionary(table, 12_000 * (12 + 4 * 2))
    assert len(d.keys) == 12_000 and others.count() == 48_000
