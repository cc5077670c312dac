from __future__ import annotations

import random
from itertools import product

import numpy as np
import pyarrow as pa

from quillforge.llm import langid

EN = "the of and that with this from have which there people would about because through"
FR = "les des une que dans pour avec sont mais leur cette comme tout elle nous"


def table(spark):
    rng = random.Random(0)
    rows = [(k, " ".join(rng.choice((EN if k % 2 else FR).split()) for _ in range(40)), "en" if k % 2 else "fr") for k in range(60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_spans_of_mixed_text(spark):
    model = langid.fit(table(spark))
    text = f"{EN} {FR} Привет мир как дела 日本語 and that with this"
    got = langid.spans(spark.createDataFrame([(1, text, 5)], "doc_id bigint, text string, lang int"), model).orderBy("span_no").collect()
    assert [r.lang for r in got][:2] == ["en", "fr"]
    assert "und-Cyrl" in [r.lang for r in got] and got[-1].lang == "en"
    assert text[got[0].start_char : got[0].end_char].split() == EN.split()
    assert sum(r.n_words for r in got) == len(text.split())


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        e = rng.normal(0, 3, (n, 3)).astype(np.float32)
        got = langid.viterbi(e, np.array([0, n]), 1.5)
        worth = lambda p: sum(e[i, s] for i, s in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: E731, B023
        best = max(product(range(3), repeat=n), key=worth)
        assert abs(worth(tuple(got)) - worth(best)) < 1e-4


def test_groups_of_words_change_nothing(spark, monkeypatch):
    model = langid.fit(table(spark))
    texts = [EN, None, "", "12 34", "Привет 12 the of", "日本 x", FR, "12 мир"] * 4
    whole = langid.label_spans(pa.array(texts, pa.string()), model)
    monkeypatch.setattr(langid, "WORDS_AT_ONCE", 7)
    orig = langid.tk.slices
    monkeypatch.setattr(langid.tk, "slices", lambda c, limit=40: orig(c, limit))
    for a, b in zip(whole, langid.label_spans(pa.array(texts, pa.string()), model), strict=True):
        assert np.array_equal(a, b)


def test_edges(spark, docs):
    model = langid.fit(table(spark))
    rows = [(1, None), (2, ""), (3, "!!!"), (None, EN), (4, EN), (4, EN), (5, "12 34"), (6, (EN + " ") * 3000)]
    got = langid.spans(docs(rows), model).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang, r.n_words))
    assert by[1] == by[2] == by[3] == [(None, 0)]
    assert by[4] == [("en", 15), ("en", 15)] and by[None] == [("en", 15)] and by[5] == [("en", 2)] and by[6] == [("en", 45000)]
    assert langid.spans(docs([]), model).count() == 0
    alone = langid.fit(table(spark).limit(0))
    assert [r.lang for r in langid.spans(docs([(1, "the мир")]), alone).orderBy("span_no").collect()] == ["und-Latn", "und-Cyrl"]


def test_accuracy_on_given_table(spark, sf):
    t = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.spans(t, langid.fit(t)).toPandas()
    main = got.sort_values("n_words").groupby("doc_id").lang.last()
    truth = t.select("doc_id", "lang").toPandas().set_index("doc_id").lang
    assert (main == truth.loc[main.index]).mean() > 0.95


def test_scripts_without_spaces(spark):
    model = langid.fit(spark.createDataFrame([(1, EN, "en"), (2, FR, "fr")], "doc_id bigint, text string, lang string"))
    texts = ["東京は日本の首都であり世界でも有数の大都市です。", "北京是中国的首都也是历史悠久的城市。", "กรุงเทพเป็นเมืองหลวงของไทย", EN + "。北京是中国的首都也是历史悠久的城市这里有很多人。"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in langid.spans(rows, model).orderBy("doc_id", "span_no").collect():
        got.setdefault(r.doc_id, []).append(r.lang)
    assert got == {0: ["ja"], 1: ["zh"], 2: ["th"], 3: ["en", "zh"]}


def test_more_labels_than_a_byte_holds():
    e = np.full((6, 300), -50.0, np.float32)
    e[:3, 290] = e[3:, 7] = 0.0
    assert langid.viterbi(e, np.array([0, 6]), 1.0).tolist() == [290] * 3 + [7] * 3


def test_sample_is_the_least_hashes(spark):
    """Of a language that holds nearly all rows as of one with few; no plan here sorts or windows by language."""
    t = spark.range(20_000).selectExpr("CASE WHEN id % 500 = 0 THEN 'few' ELSE 'most' END AS lang", "xxhash64(id) AS u")
    rows: dict[str, list[int]] = {}
    for r in t.collect():
        rows.setdefault(r.lang, []).append(r.u)
    cuts = langid._sample_cuts(t.unionByName(t), 60)
    assert "Window" not in cuts._jdf.queryExecution().toString()
    assert {r.lang: r.cut for r in cuts.collect()} == {"few": max(rows["few"]), "most": sorted(rows["most"])[59]}


def test_ties_go_to_the_first_language(spark):
    t = spark.createDataFrame([(1, EN, "zz"), (2, EN, "aa"), (3, FR, "mm"), (3, FR, "mm")], "doc_id bigint, text string, lang string")
    got = langid.spans(spark.createDataFrame([(1, EN), (2, FR)], "doc_id bigint, text string"), langid.fit(t)).collect()
    assert {r.doc_id: r.lang for r in got} == {1: "aa", 2: "mm"}


def test_scores_by_brute_force(spark):
    """Word scores from dictionaries of trigram counts; scripts from the ranges."""
    model = langid.fit(table(spark))
    slot = lambda g: ((g[0] << 16 | g[1] << 8 | g[2]) * 0x9E3779B1 % (1 << 32)) >> (32 - langid.SLOT_BITS)
    grams = lambda w: [slot(x) for x in zip(*((f"  {w} ".encode())[k:] for k in range(3)), strict=False)]
    count: dict[str, dict[int, int]] = {"en": {}, "fr": {}}
    for r in table(spark).collect():
        for w in r.text.lower().split():
            for g in grams(w):
                count[r.lang][g] = count[r.lang].get(g, 0) + 1
    logp = lambda lang, g: np.log((count[lang].get(g, 0) + langid.SMOOTH) / (sum(count[lang].values()) + langid.SMOOTH * (1 << langid.SLOT_BITS)))
    ws = ["The", "nous", "zebra", "a", "мир", "42", "x1"]
    data, offs = langid.tk.string_buffers(pa.array([" ".join(ws)]))
    _, e, used, known = langid.emissions(model, data, offs)
    columns = [model.states[k] for k in np.flatnonzero(used)]
    assert known.tolist() == [True] * 5 + [False, True] and columns == ["en", "fr", "und-Cyrl"]
    for w, got in zip(ws, e, strict=True):
        if w == "42":
            want = [0.0] * 3
        elif w == "мир":
            want = [langid.FAR, langid.FAR, 0.0]
        else:
            s = [sum(logp(lang, g) for g in grams(w.lower())) for lang in ("en", "fr")]
            want = [s[0] - max(s), s[1] - max(s), langid.FAR]
        want, can = np.array(want), np.array(want) > langid.FAR
        assert np.allclose(want[can], got[can], atol=1e-2) and (got[~can] < langid.FAR / 2).all(), w
