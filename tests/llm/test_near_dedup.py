from __future__ import annotations

import random

import numpy as np

from quillforge.llm import near_dedup
from quillforge.llm import textkernel as tk

from .conftest import words


def corpus(seed=0, groups=30, most=6, size=80):
    rng = random.Random(seed)
    rows, truth, n = [], [], 0
    for g in range(groups):
        base = words(rng, size)
        for _ in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(size)] = "changed" + str(rng.random())
            rows.append((n, " ".join(w)))
            truth.append(g)
            n += 1
    return rows, truth


def jaccard(a: str, b: str, k: int = near_dedup.SHINGLE) -> float:
    s = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_against_brute_force(docs):
    rows, truth = corpus()
    got = {r.doc_id: r.kept_doc_id for r in near_dedup.duplicates(docs(rows)).collect()}
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.65]
    assert len(pairs) > 30
    root = lambda i: got.get(i, i)
    assert sum(root(i) == root(j) for i, j in pairs) / len(pairs) >= 0.95
    assert all(truth[i] == truth[j] for i, j in got.items())


def test_edges(docs):
    same = " ".join(words(random.Random(1), 60))
    rows = [(5, same), (3, same.upper()), (9, same), (None, same), (1, None), (2, ""), (4, "!!"), (6, "one"), (7, "one"), (8, "two three"), (9, same)]
    t = docs(rows)
    got = {(r.doc_id, r.kept_doc_id) for r in near_dedup.duplicates(t).collect()}
    assert got == {(5, 3), (9, 3), (7, 6)}
    kept = near_dedup.drop_duplicates(t)
    assert kept.columns == t.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 2, 3, 4, 6, 8, None]
    assert near_dedup.duplicates(docs([])).count() == 0 and near_dedup.drop_duplicates(docs([])).count() == 0


def test_many_copies_and_long_text(docs):
    rng = random.Random(2)
    same, long = words(rng, 50), words(rng, 40_000)
    rows = [(i, " ".join(same) + f" {i}") for i in range(1500)] + [(5000, " ".join(long)), (5001, " ".join(long) + " end")]
    got = {r.doc_id: r.kept_doc_id for r in near_dedup.duplicates(docs(rows)).collect()}
    assert len(got) == 1500 and got[5001] == 5000 and set(got.values()) == {0, 5000}


def test_signatures_and_peeling():
    h = tk.mix(np.arange(40, dtype=np.uint64))
    sig = near_dedup.signatures(h, np.array([0, 40, 40]), 64)
    assert (sig[1] == 0xFFFFFFFF).all() and set(sig[0].tolist()) <= set((h & np.uint64(0xFFFFFFFF)).astype(np.uint32).tolist())
    a, b = near_dedup.link(np.array([4, 2, 9, 7]), np.array([4, 2, 9, 9]), np.array([[1, 1], [1, 2], [1, 1], [1, 2]], np.uint32), 0.9)
    assert list(zip(a, b, strict=True)) == [(4, 9), (2, 7)]


def united(pairs):
    """{node: least node of its component}."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_groups_against_all_pairs_of_all_buckets(spark, docs):
    """The groups against the components of every pair that shares a band and has enough equal bins, at the operator's own threshold."""
    rng = random.Random(21)
    rows = []
    for g in range(25):
        base = words(rng, 60)
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(60)] = "x" + str(rng.random())
            rows.append((len(rows), " ".join(w)))
    data, offs = tk.string_buffers(__import__("pyarrow").array([t for _, t in rows]))
    sig = near_dedup.signatures(*tk.shingles(tk.tokenize(data, offs), near_dedup.SHINGLE))
    bands = sig.reshape(len(rows), -1, near_dedup.ROWS)
    due = [(i, j) for j in range(len(rows)) for i in range(j) if (bands[i] == bands[j]).all(1).any() and (sig[i] == sig[j]).mean() >= near_dedup.THRESHOLD]
    want = united(due)
    got = {r.doc_id: r.kept_doc_id for r in near_dedup.duplicates(docs(rows)).collect()}
    assert got == {i: r for i, r in want.items() if i != r} and len(due) > 100


def test_rest_of_a_bucket_in_blocks(spark):
    """Whatever the size of a block, nodes of one bucket that match are tied, also over chains."""
    rng = np.random.default_rng(5)
    kinds = rng.integers(0, 1 << 32, (40, 16), dtype=np.uint64).astype(np.uint32)
    of = rng.integers(0, 40, 400)
    sig = kinds[of]
    sig[np.arange(400), rng.integers(0, 16, 400)] = rng.integers(0, 1 << 32, 400)
    sigs = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sig)], "node bigint, sig binary")
    members = [(b, i, min(i, 3)) for b in (1, 2) for i in range(400)] + [(3, i, i) for i in range(0, 400, 7)] + [(4, 5, 5)]
    due = united([(i, j) for j in range(400) for i in range(j) if (sig[i] == sig[j]).mean() >= 0.9] + [(3, i) for i in range(4, 400)])
    for same, block in ((False, 16), (False, 100), (False, 4096), (True, 64)):
        rows = spark.createDataFrame([(b, i, x if same else i) for b, i, x in members], "bucket bigint, node bigint, label bigint")
        edges = [(r.a, r.b) for r in near_dedup.match_rest(rows, sigs, 16, 0.9, block).collect()]
        assert all(a < b and (sig[a] == sig[b]).mean() >= 0.9 for a, b in edges)
        got = united(edges + [(3, i) for i in range(4, 400)] if same else edges)
        want = due if same else united([(i, j) for j in range(400) for i in range(j) if (sig[i] == sig[j]).mean() >= 0.9])
        assert all(got.get(i, i) == want.get(i, i) for i in range(400))


def test_node_groups_of_chains(spark):
    """Drifting signatures in crowded buckets: most links aren't to a bucket's centre, and groups are tied in the second look."""
    rng = np.random.default_rng(9)
    sig = []
    for _ in range(12):
        s = rng.integers(0, 1 << 32, 16, dtype=np.uint64).astype(np.uint32)
        s[:2] = 7  # what all share
        for _ in range(12):
            s = s.copy()
            s[rng.integers(2, 16, 4)] = rng.integers(0, 1 << 32, 4)
            sig.append(s)
    sig = np.array(sig)[rng.permutation(len(sig))]
    n = len(sig)
    sigs = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sig)], "node bigint, sig binary")
    due = {i: r for i, r in united([(i, j) for j in range(n) for i in range(j) if (sig[i] == sig[j]).mean() >= 0.7]).items() if i != r}
    assert {r.node: r.root for r in near_dedup.node_groups(sigs, 16, 1, 0.7, 64).collect()} == due and len(due) > 60


def test_rows_that_repeat_an_id_go_by_their_own_text(docs):
    rng = random.Random(13)
    one, two, three = (" ".join(words(rng, 60)) for _ in range(3))
    t = docs([(1, one), (5, one), (5, two), (7, two + " end"), (5, three), (5, three)])
    assert {(r.doc_id, r.kept_doc_id) for r in near_dedup.duplicates(t).collect()} == {(5, 1), (7, 5)}
    assert sorted((r.doc_id, r.text) for r in near_dedup.drop_duplicates(t).collect()) == sorted([(1, one), (5, two), (5, three), (5, three)])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.root for r in near_dedup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_scripts_without_spaces_and_typography(docs):
    rng = random.Random(8)
    rows, due = [], set()
    for k, (a, b) in enumerate([(0x4E00, 0x9000), (0x3042, 0x3094), (0x0E01, 0x0E2E)]):
        t = [chr(rng.randrange(a, b)) for _ in range(300)]
        u = list(t)
        u[150] = chr(a)
        rows += [(10 * k, "".join(t)), (10 * k + 1, "".join(u))]
        due.add((10 * k + 1, 10 * k))
    w = words(rng, 60)
    rows += [(50, " ".join(w)), (51, "\u00a0".join(f"“{x}”…" for x in w)), (60, "ПРИВЕТ МИР КАК ДЕЛА"), (61, "привет мир — как дела")]
    got = {(r.doc_id, r.kept_doc_id) for r in near_dedup.duplicates(docs(rows)).collect()}
    assert got == due | {(51, 50), (61, 60)}
