from __future__ import annotations

import random
import re

import numpy as np

from quillforge.llm import decontaminate as D

from .conftest import words


def brute(text, items, width=D.PHRASE_WORDS):
    """Character spans by comparing all runs of words."""
    found = list(re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text or ""))
    w = [m[0].lower() for m in found]
    hit = np.zeros(len(w) + 1, bool)
    joined = set()
    for item in items:
        b = [x.lower() for x in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", item or "")]
        n = min(width, len(b))
        if len(b) < D.MIN_ITEM_WORDS:
            continue
        for k in range(len(b) - n + 1):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[k : k + n]:
                    hit[i : i + n] = True
                    joined.update(range(i, i + n - 1))
    out = []
    for i in np.flatnonzero(hit):
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(found[a].start(), found[b].end()) for a, b in out], hit


def case(seed=0):
    rng = random.Random(seed)
    pool = words(rng, 40)
    items = [" ".join(rng.choice(pool) for _ in range(rng.choice([3, 5, 6, 12, 30]))) for _ in range(12)]
    rows = []
    for i in range(60):
        w = [rng.choice(pool + ["outside", "été"]) for _ in range(rng.randint(0, 80))]
        if i % 2:
            b = rng.choice(items).split()
            k = rng.randrange(len(b))
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() if rng.random() < 0.3 else x for x in b[: k + 8]]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    return rows, items


def bench(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")


def test_against_brute_force(spark, docs):
    rows, items = case()
    got: dict[int, set] = {}
    for r in D.leaks(docs(rows), bench(spark, items)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_char, r.end_char))
    for i, text in rows:
        spans, _ = brute(text, items)
        want = {c for a, b in spans for c in range(a, b)}
        letters = {c for c in want | got.get(i, set()) if text[c].isalnum()}
        assert letters & want == letters & got.get(i, set())


def test_index_against_scan():
    rng = np.random.default_rng(0)
    s = np.concatenate([[0], rng.integers(1, 4, 200), [0], rng.integers(1, 4, 90), [0]])
    index = D.FMIndex(s, 3)
    order = D.suffix_array(s)
    assert sorted(order.tolist()) == list(range(len(s)))
    phrases = rng.integers(1, 4, (40, 4))
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [i for i in range(len(s) - 3) if (s[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_strip_and_edges(spark, docs):
    rng = random.Random(5)
    item = " ".join(words(rng, 12))
    b = bench(spark, [item, "too short", None, ""])
    clean = " ".join(words(rng, 50))
    long = " ".join(words(rng, 50_000))
    rows = [(1, f"before {item.upper()} after"), (1, f"before {item.upper()} after"), (2, clean), (3, None), (4, ""), (None, item), (5, long + " " + item), (6, item.replace(" ", "\n"))]
    t = docs(rows)
    out = D.strip(t, b)
    assert out.columns == t.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert [x for x in got if x[0] == 1] == [(1, "before  after", 13)] * 2
    by = {d: x for d, x, _ in got}
    assert by[2] == clean and by[3] is None and by[4] == "" and by[None] == "" and by[5] == long + " " and by[6] == ""
    assert {r.doc_id for r in D.leaks(t, b).collect()} == {1, 5, 6}
    assert D.leaks(t, b.limit(0)).count() == 0 and D.strip(t, b.limit(0)).count() == len(rows) and D.strip(docs([]), b).count() == 0


def test_several_passes_give_the_same_rows(spark, docs, monkeypatch):
    rows, items = case(7)
    rows += [rows[1], (None, rows[3][1]), (70, None), (71, "")]
    a = [f"a{x}" for x in "bcdefghijklm"]
    items += [" ".join(a), " ".join(a[-4:] + ["bba", "bbb", "bbc", "bbd"])]  # the end of one is the beginning of the next
    rows.append((99, "start " + " ".join(a + ["bba", "bbb", "bbc", "bbd"]) + " end"))
    t = docs(rows)
    leaks = lambda: sorted((r.doc_id, r.start_char, r.end_char, tuple(r.item_ids)) for r in D.leaks(t, bench(spark, items)).collect())
    strip = lambda: sorted(map(str, D.strip(t, bench(spark, items)).collect()))
    whole, cut = leaks(), strip()
    assert any("text='start  end'" in x for x in cut) and len(whole) > 20
    for limit in (300, 40):
        monkeypatch.setattr(D, "MAX_BENCHMARK_BYTES", limit)
        assert D.phrase_passes(bench(spark, items))[0] > 1
        assert leaks() == whole and strip() == cut


def test_scripts_without_spaces_and_typography(spark, docs):
    items = ["北京是中国的首都也是历史悠久的城市", "東京は日本の首都であり世界でも有数の大都市です", "กรุงเทพเป็นเมืองหลวงของไทย", "the quick brown fox jumps over the lazy dog", "ПРИВЕТ МИР КАК ТВОИ ДЕЛА"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = ["前文。" + items[0] + "，后文", "序文、" + items[1] + "。", "ข่าว " + items[2] + " จบ", "x “the\u00a0quick” — brown\u00a0fox… «jumps» over‘the’lazy—dog y", "а привет, мир — как «твои» дела б"]
    got = {r.doc_id: r.item_ids for r in D.leaks(docs(list(enumerate(texts))), bench).collect()}
    assert got == {i: [i] for i in range(5)}
