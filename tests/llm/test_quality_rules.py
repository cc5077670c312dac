from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from quillforge.llm import quality_rules as Q
from quillforge.llm import textkernel as tk

from .conftest import words


def labelled(spark, docs, n=240):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, 60)
        if i % 3 == 0:
            w = [x + "$#@!" for x in w]
        elif i % 3 == 1 and i % 2:
            w = ["same line again"] * 20
        rows.append((i, "\n".join(w) if i % 2 else " ".join(w)))
        labels.append((i, int(i % 3 == 2 or (i % 3 == 1 and not i % 2)), 0))
    return docs(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), dict((i, q) for i, q, _ in labels)


def test_statistics_by_hand():
    text = "One two two.\nOne two two.\nABC 12!"
    data, offs = tk.string_buffers(pa.array([text, ""]))
    s = {k: v[0] for k, v in Q.text_stats(data, offs).items()}
    assert s["n_words"] == 8 and abs(s["repeated_line_share"] - 1 / 3) < 1e-12 and abs(s["digit_share"] - 2 / len(text)) < 1e-12
    assert abs(s["sign_share"] - 3 / len(text)) < 1e-12 and abs(s["distinct_word_share"] - 4 / 8) < 1e-12 and abs(s["mean_line_words"] - 8 / 3) < 1e-12
    assert all(v[1] == 0 for v in Q.text_stats(data, offs).values())


def test_column_is_the_decision_list(spark, docs):
    t, labels, truth = labelled(spark, docs)
    rules = Q.fit(t, labels.where("doc_id < 180"))
    assert rules
    got = Q.judge(t, rules).collect()
    right = []
    for r in got:
        x = {s: np.array([r[s]]) for s in Q.STATS}
        first = next((k for k, rule in enumerate(rules, 1) if Q.covers(rule, x, 1)[0]), 0)
        assert r.rule_no == first and r.keep == (first == 0) and r.rule == (Q.as_text(rules)[first - 1] if first else "keep")
        if r.doc_id >= 180:
            right.append(r.keep == bool(truth[r.doc_id]))
    assert np.mean(right) > 0.95


def test_grown_condition_has_the_highest_gain():
    rng = np.random.default_rng(0)
    x = {s: rng.random(80) for s in Q.STATS}
    bad = x["digit_share"] > 0.7
    rule = Q.grow(x, bad)
    assert rule[0].stat == "digit_share" and rule[0].above and np.array_equal(Q.covers(rule, x, 80), bad)


def test_edges(spark, docs):
    t, labels, _ = labelled(spark, docs)
    rules = Q.fit(t, labels)
    rows = [(1, None), (2, ""), (None, "a"), (3, "a b"), (3, "a b"), (4, "word " * 100_000)]
    got = Q.judge(docs(rows), rules).collect()
    assert len(got) == 6 and all(r.keep is not None for r in got)
    assert [r.n_words for r in got if r.doc_id in (1, 2)] == [0, 0]
    assert Q.judge(docs([]), rules).count() == 0
    assert Q.fit(t, labels.limit(0)) == [] and Q.fit(t, labels.where("quality = 1")) == []
    assert all(r.keep for r in Q.judge(docs(rows), []).collect())


def naive_list(rows, bad, seed=1):
    """Sequential covering over rows (dicts) in plain Python: the rules as tuples of (statistic, above, cut)."""
    import math

    rng = np.random.default_rng(seed)
    holds = lambda r, c: (r[c[0]] >= c[2]) == c[1]
    covered = lambda rule, ids: [i for i in ids if all(holds(rows[i], c) for c in rule)]
    left, rules = list(range(len(rows))), []
    while sum(bad[i] for i in left) >= Q.MIN_COVER:
        draw = rng.random(len(left)) < 2 / 3
        growing, pruning = [i for i, d in zip(left, draw, strict=True) if d], [i for i, d in zip(left, draw, strict=True) if not d]
        rule, ids = [], growing
        while len(rule) < Q.MAX_CONDITIONS:
            p0 = sum(bad[i] for i in ids)
            n0 = len(ids) - p0
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for s in Q.STATS:
                values = sorted({rows[i][s] for i in ids})
                for a, b in zip(values, values[1:], strict=False):
                    for above in (True, False):
                        c = (s, above, (a + b) / 2)
                        hit = [i for i in ids if holds(rows[i], c)]
                        p = sum(bad[i] for i in hit)
                        if p:
                            gain = p * (math.log2(p / len(hit)) - math.log2(p0 / len(ids)))
                            if gain > best[0] + 1e-12:
                                best = (gain, c)
            if best[1] is None:
                break
            rule.append(best[1])
            ids = covered(rule, ids)
        if not rule:
            break
        chosen = None
        for k in range(1, len(rule) + 1):
            hit = covered(rule[:k], pruning)
            p = sum(bad[i] for i in hit)
            worth = (2 * p - len(hit)) / len(hit) if hit else -1.0
            if chosen is None or worth >= chosen[0]:
                chosen = (worth, rule[:k], p / len(hit) if hit else 0.0, p)
        if chosen[2] < Q.MIN_PRECISION or chosen[3] < 1:
            break
        rules.append(tuple(chosen[1]))
        gone = set(covered(chosen[1], left))
        left = [i for i in left if i not in gone]
    return rules


def test_learner_against_plain_python():
    """Small whole numbers, so equal gains and equal values are common."""
    found = 0
    for seed in range(12):
        rng = random.Random(seed)
        rows = [{s: float(rng.randint(0, 6)) for s in Q.STATS} for _ in range(90)]
        bad = [(r["n_words"] >= 4 and r["digit_share"] < 3) or r["space_share"] >= 6 for r in rows]
        bad = [b != (rng.random() < 0.03) for b in bad]
        got = Q.learn({s: np.array([r[s] for r in rows]) for s in Q.STATS}, np.array(bad))
        assert [tuple((c.stat, c.above, c.cut) for c in rule) for rule in got] == naive_list(rows, bad), seed
        found += len(got)
    assert found > 10
