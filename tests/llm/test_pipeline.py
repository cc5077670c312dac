from __future__ import annotations

import random

import corpus_pipeline

from .conftest import words
from .test_substring_dedup import all_pairs, many_parts


def write(spark, path, rows, labels, bench):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def test_planted_cases(spark, tmp_path):
    rng = random.Random(0)
    pool = words(rng, 400)
    clean = lambda n=70: " ".join(rng.choice(pool) for _ in range(n))
    texts, labels = [], []
    for i in range(120):
        t = clean()
        if i % 4 == 0:
            t = " ".join(x for w in t.split() for x in ([w, "grolkish"] if rng.random() < 0.1 else [w])) + " snarvy grolkish"
        texts.append(t)
        labels.append((i, 1, int(i % 4 == 0)))
    exact, near, passage, item = clean(), clean(), " ".join(words(rng, 60)), " ".join(words(rng, 14))
    texts += [exact, exact, near, near + " end", f"{clean()} {passage} {clean()}", f"{clean()} {passage} {clean()}", f"{clean()} {item} {clean()}", None, ""]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    write(spark, str(tmp_path), rows, labels, [(0, item)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    by, before = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/out{k}")
        before = spark.read.parquet(f"{tmp_path}/out{k}")
        by[name] = {r.doc_id: r for r in before.collect()}
    assert len([i for i in by["toxicity"] if i < 120 and i % 4 == 0]) <= 1 and len([i for i in by["toxicity"] if i < 120 and i % 4]) == 90
    assert {120, 122} <= set(by["near_dedup"]) and not {121, 123} & set(by["near_dedup"]) and len(by["near_dedup"]) == len(by["toxicity"]) - 2
    assert passage in by["substring_dedup"][124].text and passage not in by["substring_dedup"][125].text and set(by["substring_dedup"]) == set(by["near_dedup"])
    assert item not in by["decontamination"][126].text and set(by["decontamination"]) == set(by["near_dedup"])
    last = by["sentencepiece"]
    assert all(r.decoded == r.text == by["decontamination"][i].text for i, r in last.items())
    assert last[127].piece_ids is None and last[128].piece_ids == []
    clean_ids = [i for i in range(120) if i % 4]
    assert all(last[i].text == texts[i] for i in clean_ids)
    whole = {r.doc_id: r.piece_ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r.piece_ids for i, r in last.items()}


def test_edges(spark, tmp_path, docs):
    """An empty table; repeated ids and rows; rows without id or text; a very long text; columns of inner names; no labels and no benchmark."""
    rng = random.Random(4)
    one, two, long = " ".join(words(rng, 60)), " ".join(words(rng, 60)), " ".join(words(rng, 30_000))
    rows = [(1, one), (1, one), (5, one), (5, two), (None, one), (7, None), (8, ""), (9, long), (10, "!"), (None, None)]
    for name, table in (("some", docs(rows)), ("none", docs([]))):
        at = f"{tmp_path}/{name}"
        table.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
        out = corpus_pipeline.run(spark, at)
        assert out.columns == [*table.columns, "piece_ids", "decoded"]
        got = sorted(((r.doc_id, r.text, r.decoded, r["__id"]) for r in out.collect()), key=str)
        kept = [r for r in rows if r != (5, one)] if name == "some" else []
        before = {r["__id"] for r in table.collect()}
        assert [(i, t) for i, t, _, _ in got] == sorted(kept, key=str) and all(t == d for _, t, d, _ in got) and {x for *_, x in got} == (before if kept else set())


def test_queries_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in found if k.startswith("op") and k[2].isdigit()} and "pipeline" in found


def test_repeats_are_cut_as_by_all_pairs(spark, docs):
    rows = many_parts()
    due = all_pairs(rows)
    left = {r.doc_id: len(r.text.split()) for r in corpus_pipeline.cut_repeats(spark, docs(rows), "").collect()}
    assert left == {i: len(text.split()) - len(due[i][0] if i in due else ()) for i, text in rows}
