from __future__ import annotations

import base64
import os
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from quillforge.llm import token_counts as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.RANKS), reason="no tokenizer files")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PARTS = ["th", "the", "er", "é", "aux", "  ", "   ", " ", "日", "x", "qz", "1", "23", ".", "(", ")", "=", "ing", "\n", "\n\n", "\t", "😀", "'", "'s", "'re", "'r", "'l", "'ll", "'v", "'ve", "'d", "'t's", "''", " ", "　", "e", "l", "²", "<|endoftext|>"]


def library():
    with open(T.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def merges():
    return T.read_ranks()


def test_is_the_librarys_count(merges):
    rng, lib = random.Random(5), library()
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["a" * 3000, "ab " * 2000, " " * 500, "x" * 97, "é" * 48 + "z"]
    got = T.Counter(merges).count(pa.array(texts))
    assert got.tolist() == [len(lib.encode_ordinary(t)) for t in texts]


def test_scan_against_one_by_one():
    rng = np.random.default_rng(0)
    cls = rng.integers(0, len(T.CLASSES), (37, T.CHUNK)).astype(np.uint8)
    scanned = T.prefix_scan(T.chunk_maps(cls))
    for q in range(len(T.STATES)):
        state = q
        for k in range(len(cls)):
            for c in cls[k]:
                state = T.NEXT[c, state]
            assert scanned[k, q] == state


def test_forgetting_changes_nothing(merges, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PARTS) for _ in range(60)) for _ in range(60)]
    want = T.Counter(merges).count(pa.array(texts)).tolist()
    monkeypatch.setattr(T, "MAX_STATES", 5)
    monkeypatch.setattr(T, "MAX_WORDS", 3)
    c = T.Counter(merges)
    assert [n for t in texts for n in c.count(pa.array([t])).tolist()] == want


def test_edges(docs, merges):
    rows = [(1, None), (2, ""), (None, "the one"), (3, "the one"), (3, "the one"), (4, "<|endoftext|>"), (5, "word " * 100_000)]
    got = sorted(((r.doc_id, r.n_tokens) for r in T.count_tokens(docs(rows), merges).collect()), key=str)
    lib = library()
    assert got == sorted(((i, len(lib.encode_ordinary(t or ""))) for i, t in rows), key=str)
    assert T.count_tokens(docs([]), merges).count() == 0
