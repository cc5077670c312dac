from __future__ import annotations

import random

import numpy as np

from quillforge.llm import textkernel as tk
from quillforge.llm import toxicity

from .conftest import words

BAD = ["grolk", "snarvish", "blegger"]


def labelled(spark, n=300):
    rng = random.Random(0)
    pool = words(rng, 300)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rng.choice(pool) for _ in range(60)]
        for _ in range(rng.randint(2, 6) * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id bigint, quality int, toxic int"), pool


def test_held_out_accuracy(spark, docs):
    rows, labels, pool = labelled(spark)
    model = toxicity.fit(docs(rows), labels.where("doc_id < 200"))
    got = {r.doc_id: r.p_grade_1 for r in toxicity.score(docs(rows), model).collect()}
    right = [(got[i] >= toxicity.REJECT_AT) == (i % 4 == 0) for i in range(200, 300)]
    assert np.mean(right) >= 0.97


def test_expected_severity_is_the_sum(spark, docs):
    rows, labels, _ = labelled(spark)
    model = toxicity.fit(docs(rows), labels)
    assert model.theta[0] < model.theta[1] and len(model.words)
    for r in toxicity.score(docs(rows), model).limit(50).collect():
        assert abs(r.severity - r.p_grade_1 - r.p_grade_2) < 1e-12 and r.p_grade_1 >= r.p_grade_2


def test_fit_recovers_ordered_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600, 3))
    z = x @ np.array([2.0, -1.0, 0.0])
    grade = (z > 0.5).astype(int) + (z > 2.0)
    w, theta = toxicity.fit_cumulative(np.tile(np.arange(3), 600), x.ravel(), np.arange(601) * 3, grade, 3, l1=1e-4, steps=400)
    assert theta[0] < theta[1] and w[0] > 3 * abs(w[2]) and w[1] < 0
    guess = (x @ w > theta[0]).astype(int) + (x @ w > theta[1])
    assert (guess == grade).mean() > 0.9


def test_edges(spark, docs):
    rows, labels, pool = labelled(spark)
    bad = " ".join(pool[:30] + BAD * 3)
    t = docs([(1, None), (2, ""), (None, bad), (3, bad), (3, bad), (4, " ".join(pool * 200)), (5, " ".join(pool * 200 + BAD * 50))])
    model = toxicity.fit(docs(rows), labels)
    got = toxicity.score(t, model).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 3, 4, 5]
    by = {r.doc_id: r.p_grade_1 for r in got}
    assert by[1] == by[2] < 0.5 and by[3] > 0.5 and by[4] < 0.5 < by[5]
    assert toxicity.score(docs([]), model).count() == 0
    nothing = toxicity.fit(docs(rows), labels.where("toxic = 0"))
    assert all(r.p_grade_1 < 1e-9 for r in toxicity.score(t, nothing).collect())


def test_keep_clean_keeps_columns_and_rows(spark, docs):
    rows, labels, pool = labelled(spark)
    bad = " ".join(pool[:30] + BAD * 3)
    t = docs(rows + [(None, "fine"), (None, bad), (1000, None), (1001, ""), (1002, "!?"), (1003, bad)])
    kept = toxicity.keep_clean(t, labels)
    assert kept.columns == t.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {None, 1000, 1001, 1002} <= ids and 1003 not in ids and kept.where("doc_id IS NULL").count() == 2 and len([i for i in ids if i is not None and i % 4 == 0 and i < 300]) <= 3
    assert len([i for i in ids if i is not None and i % 4 and i < 300]) == 225


def test_scores_by_brute_force(spark, docs):
    """Scores from a dictionary of words and word beginnings, and the screened features from counts in Python."""
    rows, labels, _ = labelled(spark, 120)
    model = toxicity.fit(docs(rows), labels)
    kinds = {r.doc_id: r.toxic for r in labels.collect()}

    def parts(text):
        out: dict[tuple, int] = {}
        for w in text.lower().split():
            for f in [(w, 0)] + [(w[:k], k) for k in toxicity.PREFIXES if len(w) > k]:
                out[f] = out.get(f, 0) + 1
        return out

    def code(f):
        h = tk.hash_words([f[0]])[0]
        return int(tk.mix(np.array([h + np.uint64(f[1])], np.uint64))[0]) if f[1] else int(h)

    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    df: dict[tuple, list[int]] = {}
    want = {}
    for i, text in rows:
        p = parts(text)
        for f in p:
            df.setdefault(f, [0, 0])[kinds[i]] += 1
        want[i] = sum(np.log1p(n) * weight.get(code(f), 0.0) for f, n in p.items())
    n1 = sum(kinds.values())
    screened = {code(f) for f, (c, t) in df.items() if c + t >= toxicity.MIN_DOCS and abs(np.log((t + 0.5) / (n1 + 1)) - np.log((c + 0.5) / (len(rows) - n1 + 1))) >= toxicity.SCREEN_ODDS}
    assert set(weight) <= screened and weight
    for r in toxicity.score(docs(rows), model).collect():
        p = [1 / (1 + np.exp(-(want[r.doc_id] - t))) for t in model.theta]
        assert abs(r.p_grade_1 - p[0]) < 1e-9 and abs(r.p_grade_2 - p[1]) < 1e-9 and abs(r.severity - sum(p)) < 1e-9


def test_no_step_lowers_the_fitted_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 3))
    grade = (x[:, 0] + rng.normal(0, 1, 400) > 0.5).astype(int) + (x[:, 0] > 1.2)
    w, theta = toxicity.fit_cumulative(np.tile(np.arange(3), 400), x.ravel(), np.arange(401) * 3, grade, 3, l1=1e-3, steps=3000)
    share = np.bincount(grade, minlength=3)

    def loss(w, theta):
        cum = np.concatenate([np.ones((400, 1)), 1 / (1 + np.exp(-(x @ w)[:, None] + theta)), np.zeros((400, 1))], 1)
        p = cum[np.arange(400), grade] - cum[np.arange(400), grade + 1]
        return -(np.log(p) / (3 * share[grade])).sum() + 1e-3 * np.abs(w).sum()

    best = loss(w, theta)
    for _ in range(300):
        assert loss(w + rng.normal(0, 0.02, 3), theta + rng.normal(0, 0.02, 2)) >= best - 1e-6
