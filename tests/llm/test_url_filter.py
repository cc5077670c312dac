from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quillforge.llm import url_filter as U


def urls(n=300, seed=0):
    rng = random.Random(seed)
    good, bad = ["news", "science", "garden", "music"], ["casino-win", "free-bets", "cheap-pills"]
    out = []
    for i in range(n):
        host = f"www.{rng.choice(bad)}.example.com/play/bonus" if i % 3 == 0 else f"{rng.choice(good)}.example.org/article/read"
        out.append((i, f"https://{host}/{rng.randint(1, 99999)}"))
    return out


def brute(train, url, label=None, order=U.ORDER, alpha=U.ALPHA):
    """Log-likelihoods under both classes by counting n-grams as strings; with a label, the URL's own counts are taken off."""
    form = lambda u: "\x02" + "".join("0" if c.isdigit() else c.lower() for c in u) + "\x03"
    grams = [Counter(), Counter()]

    def add(c, u, sign):
        x = "\x02" * (order - 1) + form(u)
        for k in range(1, order + 1):
            for i in range(order - 1, len(x)):
                c[x[i - k + 1 : i + 1]] += sign
            c["\x02" * k] += sign

    for u, y in train:
        add(grams[y], u, 1)
    if label is not None:
        add(grams[label], url, -1)
    x = "\x02" * (order - 1) + form(url)
    out = []
    for g in grams:
        total = sum(n for k, n in g.items() if len(k) == 1)
        ll = 0.0
        for i in range(order - 1, len(x)):
            p = 1 / 256
            for k in range(order):
                top = g[x[i - k : i + 1]]
                bottom = g[x[i - k : i]] if k else total
                p = (top + alpha * p) / (max(bottom, top) + alpha)
            ll += math.log(p)
        out.append(ll)
    return out


def test_likelihoods_against_string_counts(spark):
    rows = [(u, int(i % 3 == 0)) for i, u in urls(40)]
    t = spark.createDataFrame(rows, "url string, label int")
    table, others = U.gather(t)
    assert others is None
    ask = ["https://news.example.org/a1", "http://casino-win.example.com/play", "z"]
    got, _ = U.log_likelihoods(pa.array(ask), table)
    for u, g in zip(ask, got, strict=True):
        assert np.allclose(g, brute(rows, u), rtol=1e-9)
    own, _ = U.log_likelihoods(pa.array([r[0] for r in rows[:5]]), table, np.array([r[1] for r in rows[:5]]))
    for (u, y), g in zip(rows[:5], own, strict=True):
        assert np.allclose(g, brute(rows, u, y), rtol=1e-9)


def test_separates_held_out_urls(spark):
    t = spark.createDataFrame(urls(), "page_id bigint, url string")
    got = {r.page_id: r for r in U.score(t).collect()}
    assert np.mean([got[i].rejected == (i % 3 == 0) for i in range(300)]) > 0.97
    assert all(0 <= r.p_reject <= 1 for r in got.values())


def test_edges(spark):
    rows = urls(60) + [(100, None), (101, ""), (None, "https://news.example.org/x"), (102, "HTTP://FREE-BETS.example/" + "a" * 50_000), (103, "é日本"), (1, urls(60)[1][1])]
    t = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id bigint, url string, score string, label int")
    got = U.score(t).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[100].score == by[101].score == 0 and not by[100].rejected and by[102].p_reject is not None and None in by
    assert U.score(t.limit(0)).count() == 0
    assert all(r.p_reject == 0 for r in U.score(t.where("page_id % 3 = 1")).collect())


def test_counts_grow_with_the_table(spark):
    rng = random.Random(1)
    some = lambda n: [("https://a.example/" + "".join(rng.choice("abcdefghijklmnop") for _ in range(30)), 0) for _ in range(n)]
    small, large = (len(U.gather(spark.createDataFrame(some(n), "url string, label int"))[0].keys) for n in (50, 400))
    assert large > 3 * small


def test_all_bad_hosts_of_the_tables_are_labelled(spark):
    bad = ["casino-win", "free-bets", "cheap-pills", "ads-track", "spam-farm", "adult-x"]
    t = spark.createDataFrame([(f"https://m.{h}.example.net/fr/780#top", 1) for h in bad] + [("https://news.example.org/spam-farm", 0)], "url string, due int")
    assert all(r.got == r.due for r in t.select(U.blocked_host(t["url"]).alias("got"), "due").collect())


def test_another_blocklist(spark):
    rows = [(i, u.replace("casino-win", "fake-shop").replace("free-bets", "fake-shop").replace("cheap-pills", "fake-shop")) for i, u in urls(150)]
    got = U.score(spark.createDataFrame(rows, "page_id bigint, url string"), names=("fake-shop",)).collect()
    assert np.mean([r.rejected == (r.page_id % 3 == 0) for r in got]) > 0.97


def test_few_rejected_urls_are_enough(spark):
    """Those whose hash a held-out fifth doesn't take count too, and copies of a URL don't calibrate by themselves."""
    rows = [(i, u) for i, u in urls(150) if i % 3] + [(1000 + i, f"http://free-bets.example.com/play/bonus/{i}") for i in range(60)]
    t = spark.createDataFrame(rows, "page_id bigint, url string")
    few = t.where("page_id < 1000 OR pmod(xxhash64(11, url), 5) <> 0").where("page_id < 1030")
    got = U.score(few.unionByName(few)).collect()
    assert any(r.page_id >= 1000 for r in got) and np.mean([r.rejected == (r.page_id >= 1000) for r in got]) > 0.97


def test_any_bound_of_the_model_gives_the_same_scores(spark):
    rows = urls(90) + [(200, None), (201, ""), (None, "https://news.example.org/x"), (1, urls(90)[1][1])]
    t = spark.createDataFrame(rows, "page_id bigint, url string")
    got = [sorted(map(str, U.score(t, limit=limit).collect())) for limit in (U.MODEL_BYTES, 20_000, 0)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    _, others = U.gather(t.selectExpr("url", "0 AS label").where("url <> ''"), limit=0)
    assert others.count() > 300


def test_decisions_by_brute_force(spark):
    """Scores by counted strings, each URL less all its copies, and a logistic curve fitted by plain gradient steps."""
    rows = urls(45)
    rows += [(100, rows[0][1]), (101, rows[1][1])]
    t = spark.createDataFrame(rows, "page_id bigint, url string")
    labelled = [(u, int("casino" in u or "bets" in u or "pills" in u)) for _, u in rows]
    copies = Counter(u for _, u in rows)

    def scored(u, y, n):
        rest = [x for x in labelled if x[0] != u] + [(u, y)] * (copies[u] - n)
        ll = brute(rest, u)
        return (ll[1] - ll[0]) / (len(u) + 2)

    seen = Counter()
    for u, y in set(labelled):
        seen[(round(scored(u, y, copies[u]), 2), y)] += copies[u]
    x, y, n = (np.array(c, float) for c in zip(*[(*k, c) for k, c in seen.items()], strict=True))
    ones, zeros = (n * y).sum(), (n * (1 - y)).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a = b = 0.0
    for _ in range(200_000):
        e = n * (target - 1 / (1 + np.exp(-(a * x + b))))
        a, b = a + 0.05 * (e * x).sum() / n.sum() * 10, b + 0.05 * e.sum() / n.sum() * 10
    for r in U.score(t).collect():
        u = dict(rows)[r.page_id]
        s = scored(u, dict(labelled)[u], 1)
        assert abs(r.score - s) < 1e-9
        p = 1 / (1 + math.exp(-(a * s + b)))
        assert abs(r.p_reject - p) < 2e-2 and (abs(p - 0.5) < 0.05 or r.rejected == (p >= 0.5))


def test_a_table_of_hosts(spark):
    rows = [(i, u.replace("casino-win", "x1").replace("free-bets", "x2").replace("cheap-pills", "x1")) for i, u in urls(150)]
    hosts = spark.createDataFrame([("WWW.x1.example.com",), ("www.x2.example.com",), ("www.x2.example.com",), (None,)], "host string")
    got = U.score(spark.createDataFrame(rows, "page_id bigint, url string"), blocklist=hosts).collect()
    assert len(got) == 150 and np.mean([r.rejected == (r.page_id % 3 == 0) for r in got]) > 0.97
