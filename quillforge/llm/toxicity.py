"""Toxicity by cumulative-link ordinal regression over sparse word features.

Severity grades: 0 for documents labelled clean; labelled toxic ones split at the median number of lexicon words (words
whose log-odds between the two labels exceed ``lexicon_odds``) into 1 and 2. One weight vector serves all thresholds:
P(grade >= j) = sigmoid(w.x - theta_j), theta_1 < theta_2. It is fitted by proximal gradient (FISTA) with an L1 penalty, so few
words carry weight. Features are log(1 + count) of words and of word beginnings of ``PREFIXES`` letters (inflected and compounded insults share
them), held by their full 64-bit hash.
Expected severity = sum over j of P(grade >= j).

Defined results: NULL or empty text has no features and gets the severity of the thresholds alone (a clean one); rows without
an id are dropped; repeated rows are scored each; without labelled rows of both classes every severity is 0. Extra columns
are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import arrow_map, give_back, id_text, list_array, map_batches, materialize

#: Bound on the labelled rows of each class that the model is fitted on, drawn by a hash of the id.
MAX_LABELLED_PER_CLASS = 6000
PREFIXES = (4, 5, 6)
MIN_DOCS = 5
SCREEN_ODDS = 1.5
LEXICON_ODDS = 3.0
REJECT_AT = 0.5


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class OrdinalModel:
    """words: sorted 64-bit hashes with a weight each; theta: rising thresholds."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    theta: np.ndarray = field(default_factory=lambda: np.array([40.0, 41.0]))

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1..K."""
        return sigmoid(score[:, None] - self.theta[None, :])


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word and of each beginning of a longer word."""
    low = tk.lower_bytes(data)
    start, end = tk.run_bounds(tk.IS_WORD[data], offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(start, offs)))
    chars = tk.char_index(data)
    where = np.flatnonzero(np.diff(chars, append=chars[-1] + 1))  # the byte at which each character begins
    docs, hashes = [doc], [tk.span_hashes(low, start, end)]
    length = chars[end] - chars[start]
    for k in PREFIXES:
        long = length > k
        stop = where[chars[start[long]] + k]
        docs.append(doc[long])
        hashes.append(tk.mix(tk.span_hashes(low, start[long], stop) + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(hashes)


def feature_counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct features of each text."""
    doc, h = features(data, offs)
    order = np.lexsort((h, doc))
    d, h = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(d)))


def fit_cumulative(x_col, x_val, indptr, grade, n_features, n_grades=3, l1=1e-3, steps=250) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model: mean negative log-likelihood over balanced classes plus l1 |w|."""
    n = len(grade)
    row = np.repeat(np.arange(n), np.diff(indptr))
    weight = np.bincount(grade, minlength=n_grades).astype(float)
    weight = (n / (np.maximum(weight, 1) * (weight > 0).sum()))[grade] / n
    w, theta = np.zeros(n_features), np.linspace(0.5, 1.5, n_grades - 1)
    norm = np.bincount(row, x_val * x_val, minlength=n)
    rate = 1.0 / (0.25 * (np.quantile(norm, 0.9) + 1) + 1e-9) * 4
    ahead_w, ahead_t, momentum = w, theta, 1.0

    def loss_grad(w, theta):
        z = np.bincount(row, x_val * w[x_col], minlength=n)
        cum = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - theta[None, :]), np.zeros((n, 1))], 1)
        slope = cum * (1 - cum)
        at = np.arange(n)
        p = np.maximum(cum[at, grade] - cum[at, grade + 1], 1e-9)
        dz = -weight * (slope[at, grade] - slope[at, grade + 1]) / p
        gw = np.bincount(x_col, dz[row] * x_val, minlength=n_features)
        gt = np.zeros(n_grades + 1)
        np.add.at(gt, grade, weight * slope[at, grade] / p)
        np.add.at(gt, grade + 1, -weight * slope[at, grade + 1] / p)
        return -(weight * np.log(p)).sum(), gw, gt[1:-1]

    last = np.inf
    for _ in range(steps):
        loss, gw, gt = loss_grad(ahead_w, ahead_t)
        if not np.isfinite(loss) or loss > last * 1.5 + 1e-6:
            rate /= 2
            ahead_w, ahead_t, momentum = w, theta, 1.0
            continue
        last = min(last, loss)
        step = ahead_w - rate * gw
        new_w = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        new_t = np.sort(ahead_t - rate * gt)
        new_t[1:] = np.maximum(new_t[1:], new_t[:-1] + 1e-3)
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead_w = new_w + (momentum - 1) / faster * (new_w - w)
        ahead_t = new_t + (momentum - 1) / faster * (new_t - theta)
        w, theta, momentum = new_w, new_t, faster
    return w, theta


def _screened(rows: DataFrame, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, log-odds of toxic to clean) of the features that ``MIN_DOCS`` texts have and whose odds reach ``SCREEN_ODDS``; counted by the executors, so the driver gets only these."""

    def run(batch: pa.RecordBatch):
        toxic = np.asarray(batch.column("toxic"), dtype=np.int64)
        for lo, hi, data, offs in tk.slices(batch.column("text")):
            d, h, _ = feature_counts(data, offs)
            u, at = np.unique(h, return_inverse=True)
            one = np.bincount(at, toxic[lo:hi][d], minlength=len(u)).astype(np.int64)
            yield {"h": u.view(np.int64), "df1": one, "df": np.bincount(at, minlength=len(u))}

    per = arrow_map(rows, run, "h bigint, df1 bigint, df bigint").groupBy("h").agg(F.sum("df1").alias("df1"), F.sum("df").alias("df")).where(F.col("df") >= MIN_DOCS)
    odds = F.log((F.col("df1") + 0.5) / (n_toxic + 1)) - F.log((F.col("df") - F.col("df1") + 0.5) / (n_clean + 1))
    got = per.select("h", odds.alias("odds")).where(F.abs("odds") >= SCREEN_ODDS).toArrow()
    h = np.asarray(got.column("h"), dtype=np.int64).view(np.uint64)
    by = np.argsort(h)
    return h[by], np.asarray(got.column("odds"), dtype=float)[by]


def fit(docs: DataFrame, labels: DataFrame, max_labelled_per_class: int = MAX_LABELLED_PER_CLASS) -> OrdinalModel:
    """Fit on at most ``max_labelled_per_class`` labelled rows of each class (those with the least hash of their id). Features are counted and screened on the executors; only the screened ones of each text reach the driver."""
    lab = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for c in (0, 1):
        part = lab.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = materialize(id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return OrdinalModel()
    words, odds = _screened(rows, size[1], size[0])
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def counts(batch: pa.RecordBatch):
        words = sent.value
        for lo, hi, data, offs in tk.slices(batch.column("text")):
            d, h, c = feature_counts(data, offs)
            at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
            ok = np.flatnonzero(words[at] == h) if len(words) else np.zeros(0, np.int64)
            first = np.searchsorted(d[ok], np.arange(hi - lo + 1))
            yield {"toxic": batch.column("toxic").slice(lo, hi - lo), "col": list_array(at[ok].astype(np.int32), first), "n": list_array(c[ok].astype(np.int32), first)}

    got = arrow_map(rows, counts, "toxic int, col array<int>, n array<int>").toArrow()
    toxic = np.asarray(got.column("toxic"), dtype=np.int64)
    lists = got.column("col").combine_chunks()
    first, x_col, n = np.asarray(lists.offsets), np.asarray(lists.values, dtype=np.int64), np.asarray(got.column("n").combine_chunks().values, dtype=np.int64)
    row = np.repeat(np.arange(len(toxic)), np.diff(first))
    hits = np.bincount(row, n * (odds[x_col] > LEXICON_ODDS), minlength=len(toxic))
    grade = np.where(toxic == 1, 1 + (hits > np.median(hits[toxic == 1])), 0).astype(np.int64)
    x_val = np.log1p(n)
    w, _ = fit_cumulative(x_col, x_val, first, grade, len(words), l1=1e-4)
    some = w != 0  # the penalty chose the features; a lighter one sets their weights
    left = some[x_col]
    indptr = np.searchsorted(row[left], np.arange(len(toxic) + 1))
    w, theta = fit_cumulative((np.cumsum(some) - 1)[x_col[left]], x_val[left], indptr, grade, int(some.sum()), l1=5e-5)
    del got, lists, row, n, x_col, x_val, left
    give_back()
    return OrdinalModel(words[some], w, np.maximum(theta, [1e-3, 2e-3]))  # without evidence a text is clean


def raw_scores(model: OrdinalModel, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """w.x of each text."""
    if not len(model.words) or not len(data):
        return np.zeros(len(offs) - 1)
    doc, h = features(data, offs)
    at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
    hit = np.flatnonzero(model.words[at] == h)
    key, count = np.unique(doc[hit] * len(model.words) + at[hit], return_counts=True)
    return np.bincount(key // len(model.words), np.log1p(count) * model.weights[key % len(model.words)], minlength=len(offs) - 1)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, p_grade_1, p_grade_2, severity) of every document: P(grade >= 1), P(grade >= 2) and their sum."""

    def run(batch: pa.RecordBatch):
        for lo, hi, data, offs in tk.slices(batch.column("text")):
            p = model.at_least(raw_scores(model, data, offs))
            yield {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "p_grade_1": p[:, 0], "p_grade_2": p[:, 1], "severity": p.sum(1)}

    return arrow_map(id_text(docs), run, "doc_id bigint, p_grade_1 double, p_grade_2 double, severity double")


def toxic_documents(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """The rejected documents, those with P(grade >= 1) >= ``reject_at``, with grade probabilities and expected severity."""
    return score(docs, fit(docs, labels)).where(F.col("p_grade_1") >= reject_at)


def keep_clean(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """docs without the rejected ones, all columns as they were. A row without an id stays, whatever its text; so does one without a word. Rows that are equal stay or go alike. One pass: the
    rows go through Arrow whole, so nothing is joined or shuffled."""
    model, schema, text_at, id_at = fit(docs, labels), docs.schema, docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, hi, data, offs in tk.slices(batch.column(text_at).cast(pa.string())):
                keep[lo:hi] = model.at_least(raw_scores(model, data, offs))[:, 0] < reject_at
            keep |= np.asarray(batch.column(id_at).is_null())
            yield batch.filter(pa.array(keep))

    return map_batches(docs, run, schema)
