from __future__ import annotations

import random

import pytest


def words(rng: random.Random, n: int, letters: str = "abcdefghijklmnop") -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n)]


@pytest.fixture
def docs(spark):
    """A documents table of (doc_id, text) rows, with columns whose names operators use inside."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, sig string, h string, n string, ids string, spans string, bucket string, a string, b string, _ID string, __id string, __hash string, _spans string, __spans string, _row string, __row string, __lost string, __found string, __ids string, __gone string"
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, *[f"x{k}" for k in range(len(schema.split(",")) - 5)]) for i, t in rows], schema)

    return make
