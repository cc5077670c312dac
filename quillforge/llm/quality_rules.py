"""Quality rules: decision lists learned by sequential covering.

Statistics of each document's bytes, words and lines are computed in one pass. On labelled rows, rules for low quality are learned one after
another: a rule grows by the threshold condition of the highest FOIL gain until it covers no good document of the growing part, is
pruned from its end while that raises (p - n) / (p + n) on the pruning part, and is kept while its precision there stays above ``MIN_PRECISION``;
the low-quality rows it covers are taken away and the next is learned. The list becomes one ordered Spark conditional expression.

Labelled rows are bounded by ``MAX_LABELLED`` (those with the least hash of their id); statistics and decisions cover all documents.

Defined results: NULL and empty texts have statistics of 0 (n_lines too), which rules may or may not cover; without labelled rows of both
classes the list is empty and all documents are kept; rows without an id are kept under a NULL id; repeated rows are judged each; ties
between conditions go to the first statistic and the lowest threshold; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import arrow_map

MAX_LABELLED = 20_000
MIN_PRECISION = 0.9
MIN_COVER = 3
CUTS = 40
MAX_CONDITIONS = 4
STATS = ("n_words", "mean_word_chars", "sign_share", "digit_share", "upper_share", "repeated_line_share", "mean_line_words", "distinct_word_share", "signs_per_word", "space_share")


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.stat] >= self.cut if self.above else x[self.stat] < self.cut

    def column(self) -> Column:
        return F.col(self.stat) >= self.cut if self.above else F.col(self.stat) < self.cut

    def __str__(self) -> str:
        return f"{self.stat} {'>=' if self.above else '<'} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _class_counts(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask)])
    return (c[offs[1:]] - c[offs[:-1]]).astype(float)


def text_stats(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text of a slice."""
    n = len(offs) - 1
    tok = tk.tokenize(data, offs)
    words = np.diff(tok.first).astype(float)
    chars = _class_counts((data & 0xC0) != 0x80, offs)
    space = _class_counts((data == 32) | ((data >= 9) & (data <= 13)), offs)
    digit = _class_counts((data >= 48) & (data <= 57), offs)
    caps = (data >= 65) & (data <= 90)
    caps[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    small = (data >= 97) & (data <= 122)
    upper = _class_counts(caps, offs)
    lower = _class_counts(small, offs)
    sign = _class_counts(~tk.IS_WORD[data] & (data != 32) & ~((data >= 9) & (data <= 13)), offs)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    letters = np.concatenate([[0], np.cumsum(at[tok.end] - at[tok.start])])
    inside = (letters[tok.first[1:]] - letters[tok.first[:-1]]).astype(float)
    start, end = tk.run_bounds(data != 10, offs)
    line_of = np.searchsorted(offs, start, "right") - 1
    lines = np.bincount(line_of, minlength=n).astype(float)
    key = tk.mix(tk.span_hashes(data, start, end) + line_of.astype(np.uint64) * tk.MULT)
    distinct_lines = np.bincount(line_of[np.unique(key, return_index=True)[1]], minlength=n) if len(key) else np.zeros(n)
    doc = tok.doc
    wkey = tk.mix(tok.hash + doc.astype(np.uint64) * tk.MULT)
    distinct = np.bincount(doc[np.unique(wkey, return_index=True)[1]], minlength=n) if len(wkey) else np.zeros(n)
    over = lambda a, b: a / np.maximum(b, 1)
    return {
        "n_words": words, "mean_word_chars": over(inside, words), "sign_share": over(sign, chars), "digit_share": over(digit, chars), "upper_share": over(upper, upper + lower),
        "repeated_line_share": over(lines - distinct_lines, lines), "mean_line_words": over(words, lines), "distinct_word_share": over(distinct, words), "signs_per_word": over(sign, words), "space_share": over(space, chars),
    }


def stats_table(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of every row."""

    def run(batch: pa.RecordBatch):
        for lo, hi, data, offs in tk.slices(batch.column("text")):
            yield {"doc_id": batch.column("doc_id").slice(lo, hi - lo), **text_stats(data, offs)}

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(own, run, "doc_id bigint, " + ", ".join(f"{s} double" for s in STATS))


def _cuts(x: np.ndarray) -> np.ndarray:
    u = np.unique(x)
    if len(u) < 2:
        return np.zeros(0)
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= CUTS else np.unique(np.quantile(x, np.linspace(0, 1, CUTS + 2)[1:-1]))


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions of the highest FOIL gain, one by one, until no good row is covered."""
    rule: list[Condition] = []
    cover = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = bad[cover].sum(), (~bad[cover]).sum()
        if n0 == 0 or p0 == 0:
            break
        best, chosen = 1e-9, None
        for s in STATS:
            v = x[s][cover]
            b = bad[cover]
            for cut in _cuts(v):
                hit = v >= cut
                for above in (True, False):
                    h = hit if above else ~hit
                    p = (b & h).sum()
                    n = h.sum() - p
                    if not p:
                        continue
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if gain > best:
                        best, chosen = gain, Condition(s, above, float(cut))
        if chosen is None:
            break
        rule.append(chosen)
        cover &= chosen.holds(x)
    return tuple(rule)


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule with the best (p - n) / (p + n), its precision and cover; the longer one on ties."""
    best: tuple[float, Rule, float, int] = (-2.0, rule, 0.0, 0)
    for k in range(1, len(rule) + 1):
        hit = covers(rule[:k], x, len(bad))
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth >= best[0]:
            best = (worth, rule[:k], p / (p + n) if p + n else 0.0, p)
    return best[1], best[2], best[3]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 1) -> list[Rule]:
    """An ordered list of rules for ``bad``. x: statistics by name."""
    rng = np.random.default_rng(seed)
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while bad[left].sum() >= MIN_COVER:
        at = np.flatnonzero(left)
        part = rng.random(len(at)) < 2 / 3
        g, t = at[part], at[~part]
        rule = grow({s: v[g] for s, v in x.items()}, bad[g])
        if not rule:
            break
        rule, precision, cover = prune(rule, {s: v[t] for s, v in x.items()}, bad[t])
        if precision < MIN_PRECISION or cover < 1:
            break
        rules.append(rule)
        left &= ~covers(rule, x, len(bad))
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    lab = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(lab), "doc_id")
    got = stats_table(rows).join(F.broadcast(lab), "doc_id").orderBy("doc_id", *STATS).toArrow()
    if not got.num_rows:
        return []
    bad = np.asarray(got.column("quality"), dtype=np.int64) == 0
    if bad.all() or not bad.any():
        return []
    return learn({s: np.asarray(got.column(s), dtype=float) for s in STATS}, bad)


def as_column(rules: list[Rule]) -> Column:
    """The ordered conditional: the number of the first rule that holds, from 1; 0 where none does."""
    out: Column | None = None
    for k, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column()
        out = F.when(cond, F.lit(k)) if out is None else out.when(cond, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def as_text(rules: list[Rule]) -> list[str]:
    return [" AND ".join(map(str, r)) for r in rules]


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, statistics, rule_no, rule, keep) of every row; rule 0 is the default, which keeps."""
    names = F.array(*[F.lit(t) for t in ["keep", *as_text(rules)]])
    return stats_table(docs).withColumn("rule_no", as_column(rules)).withColumn("rule", F.get(names, F.col("rule_no"))).withColumn("keep", F.col("rule_no") == 0)
