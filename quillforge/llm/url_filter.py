"""URL filters by a ratio of character language models.

Two variable-order Markov models, of accepted and of rejected URLs, over bytes of the lower-case URL with digits taken as one sign. Counts of all
n-grams of up to ``ORDER`` bytes are gathered from every URL of the table. Each order's estimate is smoothed towards the
next lower one: P(c | ctx) = (N(ctx c) + ALPHA P(c | shorter ctx)) / (N(ctx) + ALPHA), down to uniform bytes. The score is the log-likelihood difference
(rejected - accepted) per byte. All labelled URLs calibrate it, each scored by the models less the counts of all its copies: a logistic curve gives P(reject), and URLs
at ``REJECT_AT`` or more are rejected; the models count all labelled URLs, each URL less its own counts.

Labels: a URL is rejected where a part of its host, between dots or hyphens, is on a list of words that name unwanted kinds of sites (``BLOCKED``, a parameter), or where its host is in a table that is passed
(``blocklist``), and accepted otherwise, so a bad host that neither names trains the accepted model. ``label`` may be any column expression instead.

The most frequent n-grams, up to ``MODEL_BYTES``, are sent to the executors; the others are looked up by a join, from each URL that has one. Both hold the same counts, so the bound changes no result.

Defined results: NULL and empty URLs score 0 and aren't rejected; rows without an id are kept under a NULL id; repeated rows count and
score each; without both labels all probabilities are 0; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import arrow_map, list_array, materialize

ORDER = 5
ALPHA = 4.0
REJECT_AT = 0.5
#: Words in hosts of gambling, adult, drug, advertising, tracking, spam and piracy sites.
BLOCKED = (
    "casino", "casinos", "poker", "bet", "bets", "betting", "slots", "jackpot", "lotto", "roulette", "adult", "porn", "xxx", "sex", "nude", "escort", "escorts", "camgirls", "pills", "viagra", "cialis", "ads", "adserver", "adservice",
    "banner", "banners", "popunder", "tracker", "tracking", "clicktrack", "spam", "spammer", "phish", "phishing", "malware", "warez", "torrent", "torrents", "keygen", "cracks", "serialz",
)
#: Bytes of the n-grams that every worker holds.
MODEL_BYTES = 128 << 20
GRAM_BYTES = 24


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def blocked_host(url: Column, names: tuple[str, ...] = BLOCKED) -> Column:
    """1 where a part of the host, or what stands between two of its dots, is on the list, else 0."""
    parts = F.concat(F.split(host_of(url), r"[.-]"), F.split(host_of(url), r"\."))
    return F.arrays_overlap(parts, F.array(*map(F.lit, names))).cast("int")


def prepare(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): a start byte 2, the URL in lower case with digits as 0, an end byte 3."""
    data, offs = tk.string_buffers(column)
    low = tk.LOWER[data]
    low[(low >= 48) & (low <= 57)] = 48
    n = len(offs) - 1
    new = offs + 2 * np.arange(n + 1)
    out = np.full(int(new[-1]), 2, np.uint8)
    out[np.arange(len(low)) + np.repeat(2 * np.arange(n) + 1, np.diff(offs))] = low
    out[new[1:] - 1] = 3
    return out, new


def ngram_hashes(x: np.ndarray, offs: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For each length 1..order, at each byte, a hash of the n-gram that ends there; an n-gram cut by the URL's start is the shorter one with start bytes."""
    v = x.astype(np.uint64) + np.uint64(1)
    back = np.arange(len(x)) - np.repeat(offs[:-1], np.diff(offs))
    out, h, scale = [], np.zeros(len(x), np.uint64), 1
    for k in range(order):
        p = np.concatenate([np.full(min(k, len(x)), 3, np.uint64), v[: max(0, len(x) - k)]])
        h = h + np.where(back >= k, p, np.uint64(3)) * np.uint64(scale)
        scale = scale * 258 % (1 << 64)
        out.append(tk.mix(h + np.uint64((k + 1) << 56)))
    return out


@dataclass
class Grams:
    """keys: sorted hashes of n-grams; counts: theirs in both classes."""

    keys: np.ndarray
    counts: np.ndarray

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, which are there)."""
        if not len(self.keys):
            return np.zeros((len(h), 2)), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        there = self.keys[at] == h
        return self.counts[at] * there[:, None].astype(float), there


def _grams(t: pa.Table) -> Grams:
    h = np.asarray(t.column("h"), dtype=np.int64).view(np.uint64)
    by = np.argsort(h)
    counts = np.stack([np.asarray(t.column(c), dtype=np.int64)[by] for c in ("n0", "n1")], 1)
    return Grams(h[by], counts.astype(np.min_scalar_type(counts.max()) if len(h) else np.int64))


def gram_table(pages: DataFrame, order: int = ORDER) -> DataFrame:
    """(h, n0, n1): the n-grams of all URLs and how often each class has them. pages: url, label."""

    def run(batch: pa.RecordBatch):
        label = np.asarray(batch.column("label"), dtype=np.int64)
        x, offs = prepare(batch.column("url"))
        of = np.repeat(label, np.diff(offs))
        grams = ngram_hashes(x, offs, order)
        starts = [np.full(len(label), g, np.uint64) for g in context_roots(order)]
        h = np.concatenate(grams + starts)
        c = np.concatenate([of] * order + [label] * order)
        for k in (0, 1):
            u, n = np.unique(h[c == k], return_counts=True)
            yield {"h": u.view(np.int64), "label": np.full(len(u), k), "n": n}

    one = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))
    return arrow_map(pages, run, "h bigint, label int, n bigint").groupBy("h").agg(one(0).alias("n0"), one(1).alias("n1"))


def single_bytes() -> np.ndarray:
    return tk.mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) + np.uint64(1 << 56))


def gather(pages: DataFrame, order: int = ORDER, limit: int = MODEL_BYTES) -> tuple[Grams, DataFrame | None]:
    """The n-grams that go to the executors, all single bytes and starts and the most frequent of the others within ``limit`` bytes, and the table of the rest if there is any."""
    table = materialize(gram_table(pages, order), "grams")
    power = F.floor(F.log2(F.col("n0") + F.col("n1")))
    size = {r["p"]: r["n"] for r in table.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()}
    least, total = None, 0
    for p in sorted(size, reverse=True):
        total += size[p] * GRAM_BYTES
        if total > limit:
            break
        least = p
    if not size or least == min(size):
        return _grams(table.toArrow()), None
    always = np.concatenate([single_bytes(), np.array(context_roots(order), np.uint64)]).view(np.int64).tolist()
    sent = F.col("h").isin(always) if least is None else (power >= least) | F.col("h").isin(always)
    return _grams(table.where(sent).toArrow()), table.where(~sent)


def context_roots(order: int) -> list[np.uint64]:
    """The n-grams of start bytes alone that stand before a URL's first byte; they are contexts, so they are counted."""
    out, h, scale = [], 0, 1
    for k in range(order):
        h = (h + 3 * scale) % (1 << 64)
        scale = scale * 258 % (1 << 64)
        out.append(tk.mix(np.array([(h + ((k + 1) << 56)) % (1 << 64)], np.uint64))[0])
    return out


def log_likelihoods(column, whole: Grams, label: np.ndarray | None = None, order: int = ORDER, alpha: float = ALPHA, copies: np.ndarray | None = None, rest: Grams | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood under both models, bytes scored) of each URL; with labels, each URL's own counts are taken off its class's,
    as often as ``copies`` says (once). N-grams that ``whole`` hasn't are looked up in ``rest``."""
    x, offs = prepare(column)
    size = np.diff(offs)
    if not len(x):
        return np.zeros((len(size), 2)), np.maximum(size, 1)
    row = np.repeat(np.arange(len(size)), size)
    often = np.ones(len(x)) if copies is None else copies[row].astype(float)
    grams = ngram_hashes(x, offs, order)
    roots = context_roots(order)
    begins = np.zeros(len(x), bool)
    begins[offs[:-1][size > 0]] = True

    def look(h: np.ndarray) -> np.ndarray:
        n, there = whole.look(h)
        if rest is not None:
            n[~there] = rest.look(h[~there])[0]
        return n

    def less_own(n: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        n = n.copy()
        if own is not None:
            n[np.arange(len(n)), label[row]] -= own * often
        return np.maximum(n, 0)

    def times(h: np.ndarray, root: np.uint64) -> np.ndarray | None:
        """How often an n-gram stands in its own URL."""
        if label is None:
            return None
        pair = tk.mix(h + row.astype(np.uint64) * tk.MULT)
        _, inverse, n = np.unique(pair, return_inverse=True, return_counts=True)
        return (n[inverse] + (h == root)).astype(float)

    p = np.full((len(x), 2), 1 / 256)
    at_start = whole.look(np.array(roots, np.uint64))[0]
    last = own_last = None
    for k in range(order):
        counts, own = look(grams[k]), times(grams[k], roots[k])
        top = less_own(counts, own)
        if k == 0:
            bottom = np.tile(counts_total(whole), (len(x), 1))
            if label is not None:
                bottom[np.arange(len(x)), label[row]] -= (size[row] + 1) * often
        else:  # the context of an n-gram is the shorter one that ends a byte before
            before = np.empty((len(x), 2))
            before[1:] = last[:-1]
            before[begins] = at_start[k - 1]
            own_before = None
            if own is not None:
                own_before = np.empty(len(x))
                own_before[1:] = own_last[:-1]
                own_before[begins] = 2.0  # as a context and as the n-gram that ends at the start byte
            bottom = less_own(before, own_before)
        p = (top + alpha * p) / (np.maximum(bottom, top) + alpha)
        last, own_last = counts, own
    ll = np.stack([np.bincount(row, np.log(p[:, c]), minlength=len(size)) for c in (0, 1)], 1)
    return ll, np.maximum(size, 1)


def counts_total(whole: Grams) -> np.ndarray:
    """Bytes counted in each class: all single bytes are in the table under length 1."""
    return whole.look(single_bytes())[0].sum(0)


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """a, b of P(y) = sigmoid(a x + b) by Newton's method over n rows of each kind, with a weak ridge and targets drawn in a little."""
    ones, zeros = (n * y).sum(), (n * (1 - y)).sum()
    hi, lo = (ones + 1) / (ones + 2), 1 / (zeros + 2)
    t = np.where(y == 1, hi, lo)
    X = np.stack([x, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -35, 35)))
        step = np.linalg.solve((X * (n * p * (1 - p))[:, None]).T @ X + 1e-6 * np.eye(2), X.T @ (n * (t - p)) - 1e-6 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def with_scores(rows: DataFrame, whole: Grams, others: DataFrame | None, order: int = ORDER) -> DataFrame:
    """rows (page_id, url, label, n) with score, the log-likelihood difference per byte, each URL less its n own copies."""
    sent = rows.sparkSession.sparkContext.broadcast((whole.keys, whole.counts))
    kept = "page_id bigint, url string, label int, n bigint"

    def run(batch: pa.RecordBatch):
        grams = Grams(*sent.value)
        for lo in range(0, batch.num_rows, 4000):
            b = batch.slice(lo, 4000)
            rest = None
            if "met" in b.schema.names:
                met = b.column("met").flatten()
                h, first = np.unique(np.asarray(met.field("h"), dtype=np.int64).view(np.uint64), return_index=True)
                rest = Grams(h, np.stack([np.asarray(met.field(c), dtype=np.int64)[first] for c in ("n0", "n1")], 1))
            ll, size = log_likelihoods(b.column("url"), grams, np.asarray(b.column("label"), dtype=np.int64), order, copies=np.asarray(b.column("n"), dtype=np.int64), rest=rest)
            yield {**{c: b.column(c) for c in ("page_id", "url", "label", "n")}, "score": (ll[:, 1] - ll[:, 0]) / size}

    if others is not None:

        def missing(batch: pa.RecordBatch):
            grams = Grams(*sent.value)
            for lo in range(0, batch.num_rows, 4000):
                b = batch.slice(lo, 4000)
                x, offs = prepare(b.column("url"))
                row = np.repeat(np.arange(b.num_rows), np.diff(offs))
                h = np.concatenate(ngram_hashes(x, offs, order))
                lost = np.flatnonzero(~grams.look(h)[1])
                _, one = np.unique(tk.mix(h[lost] + np.tile(row, order)[lost].astype(np.uint64) * tk.MULT), return_index=True)  # once a URL
                of = np.tile(row, order)[lost[one]]
                by = np.argsort(of, kind="stable")
                yield {**{c: b.column(c) for c in ("page_id", "url", "label", "n")}, "lost": list_array(h[lost[one]][by].view(np.int64), np.searchsorted(of[by], np.arange(b.num_rows + 1)).astype(np.int32))}

        rows = materialize(arrow_map(rows.select("page_id", "url", "label", "n"), missing, kept + ", lost array<bigint>").withColumn("row", F.monotonically_increasing_id()), "urls")
        met = rows.select("row", F.explode("lost").alias("h")).join(others, "h").groupBy("row").agg(F.collect_list(F.struct("h", "n0", "n1")).alias("met"))
        rows = rows.join(met, "row", "left").select("page_id", "url", "label", "n", F.coalesce("met", F.array().cast("array<struct<h: bigint, n0: bigint, n1: bigint>>")).alias("met"))
    return arrow_map(rows, run, kept + ", score double")


def score(pages: DataFrame, label: Column | None = None, order: int = ORDER, reject_at: float = REJECT_AT, names: tuple[str, ...] = BLOCKED, blocklist: DataFrame | None = None, limit: int = MODEL_BYTES) -> DataFrame:
    """(page_id, score, p_reject, rejected) of every page. blocklist: a table of rejected hosts in its column host."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(blocked_host(url, names) if label is None else label.cast("int"), F.lit(0)).alias("label"))
    if blocklist is not None:
        hosts = blocklist.select(F.lower(F.col("host").cast("string")).alias("host"), F.lit(1).alias("listed")).where("host IS NOT NULL").distinct()
        own = own.withColumn("host", host_of(F.col("url"))).join(hosts, "host", "left").select("page_id", "url", F.coalesce("listed", "label").alias("label"))
    some = own.where("url <> ''")
    whole, others = gather(some.select("url", "label"), order, limit)
    once = some.groupBy("url", "label").agg(F.count("*").alias("n")).withColumn("page_id", F.lit(None).cast("long"))
    seen = with_scores(once, whole, others, order).groupBy(F.round("score", 2).alias("x"), "label").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    seen.sort(key=lambda r: (r["x"], r["label"]))
    x, y, n = (np.array([r[c] for r in seen], float) for c in ("x", "label", "n"))
    scored = with_scores(own.withColumn("n", F.lit(1).cast("long")), whole, others, order)
    if len(set(y.tolist())) < 2:
        p = F.lit(0.0)
    else:
        a, b = fit_logistic(x, y, n)
        p = F.when(F.col("url") == "", F.lit(0.0)).otherwise(1 / (1 + F.exp(-(F.col("score") * a + b))))
    zero = F.when(F.col("url") == "", F.lit(0.0)).otherwise(F.col("score"))
    return scored.select("page_id", zero.alias("score"), p.alias("p_reject"), (p >= reject_at).alias("rejected"))
