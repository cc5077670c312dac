"""Language ID of mixed-language text.

Each word's script, by the code ranges of its first letter, narrows the languages that it can be of: those trained languages
that write at least ``SCRIPT_SHARE`` of their words in that script, or, for a script of no trained language, a label of the script's
own. Within a script, a word's score under a language is its log-probability under a byte-trigram model; numbers fit any language. Viterbi over a document's
words with a penalty for each switch of language gives every word a label, and equal neighbours form spans.

The trigram model is fitted on at most ``MAX_DOCS_PER_LANGUAGE`` labelled documents of each language (those with the least hash of their id). Any number of languages
may be trained; each takes 1 MiB of the model.

Defined results: NULL or empty texts, and texts without a word, give one row with a NULL language and no words; rows without an id are kept
under a NULL id; repeated rows each give their spans; ties go to the language that is first by name; without any labelled
row all words are labelled by script alone; extra columns are ignored. Spans are characters [start, end) from the first
letter of their first word to the end of their last.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import arrow_map

MAX_DOCS_PER_LANGUAGE = 1500
SLOT_BITS = 18
SMOOTH = 0.05
SWITCH = 12.0
SCRIPT_SHARE = 0.02
FAR = -1e4
#: What a Han character costs as Japanese where no language ja is trained: less than a switch, so text with Kana keeps its kanji, and Han alone is Chinese.
HAN_JA = 0.5
WORDS_AT_ONCE = 1 << 20

#: Script, first code point, one past the last.
RANGES = [
    ("Latn", 0x41, 0x5B), ("Latn", 0x61, 0x7B), ("Latn", 0xAA, 0xAB), ("Latn", 0xBA, 0xBB), ("Latn", 0xC0, 0x2B0), ("Latn", 0x1E00, 0x1F00), ("Grek", 0x370, 0x400), ("Grek", 0x1F00, 0x2000),
    ("Cyrl", 0x400, 0x530), ("Armn", 0x530, 0x590), ("Hebr", 0x590, 0x600), ("Arab", 0x600, 0x780), ("Deva", 0x900, 0x980), ("Beng", 0x980, 0xA00), ("Taml", 0xB80, 0xC00),
    ("Thai", 0xE00, 0xE80), ("Geor", 0x10A0, 0x1100), ("Hang", 0x1100, 0x1200), ("Ethi", 0x1200, 0x1400), ("Kana", 0x3040, 0x3100), ("Hani", 0x3400, 0xA000), ("Hang", 0xAC00, 0xD7B0), ("Hani", 0x20000, 0x32000),
]
SCRIPTS = sorted({s for s, _, _ in RANGES})
_EDGES = np.array(sorted({x for _, a, b in RANGES for x in (a, b)}))
_OF = np.full(len(_EDGES) + 1, -1)
for _s, _a, _b in RANGES:
    _OF[np.searchsorted(_EDGES, _a) + 1 : np.searchsorted(_EDGES, _b) + 1] = SCRIPTS.index(_s)
#: The language of scripts that one language writes; others get the label und-Script.
ONLY = {"Grek": "el", "Armn": "hy", "Hebr": "he", "Thai": "th", "Geor": "ka", "Hang": "ko", "Kana": "ja", "Hani": "zh", "Taml": "ta", "Beng": "bn", "Ethi": "am"}


@dataclass
class LanguageModel:
    """logp: slots x languages; states: labels, trained languages first; allowed: scripts x states."""

    languages: list[str]
    logp: np.ndarray
    states: list[str]
    allowed: np.ndarray


def scripts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The script number of each word's first letter; -1 for numbers and signs."""
    size = len(data)
    digits = start.copy()
    todo = np.flatnonzero((data[digits] >= 48) & (data[digits] <= 57))
    while len(todo):  # to the first byte that is no digit
        digits[todo] += 1
        todo = todo[digits[todo] < end[todo]]
        todo = todo[(data[digits[todo]] >= 48) & (data[digits[todo]] <= 57)]
    inside = digits < end
    at = np.minimum(digits, size - 1)
    b = [data[np.minimum(at + k, size - 1)].astype(np.int64) for k in range(4)]
    cp = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)))
    return np.where(inside, _OF[np.searchsorted(_EDGES, cp, "right")], -1)


def trigram_slots(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, first) of each word's byte trigrams, the word set between spaces."""
    size = end - start + 1
    first = np.concatenate([[0], np.cumsum(size)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], size)
    at = np.repeat(start, size) + k
    n = np.repeat(size - 1, size)
    pad = np.append(low, np.uint8(32)).astype(np.uint32)
    c = np.where(k < n, pad[np.minimum(at, len(low))], 32)
    b = np.where(k >= 1, pad[np.maximum(at - 1, 0)], 32)
    a = np.where(k >= 2, pad[np.maximum(at - 2, 0)], 32)
    code = (a << 16 | b << 8 | c).astype(np.uint32)
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)).astype(np.int64), first


def _sample_cuts(hashed: DataFrame, k: int) -> DataFrame:
    """(lang, cut): the k-th least distinct hash of each language of hashed (lang, u), or its greatest. A row goes to the driver only where its hash is below what about 2 k of its language's rows
    are expected under, so that is bounded whatever the table's size; the number of languages is that of the model."""
    span = float(1 << 63)
    counts = hashed.groupBy("lang").agg(F.count("*").alias("n")).withColumn("below", F.when(F.col("n") > 2 * k + 1000, (2 * k + 1000) / F.col("n") * span * 2 - span).otherwise(span))
    low = hashed.join(F.broadcast(counts), "lang").where(F.col("u").cast("double") <= F.col("below")).select("lang", "u").distinct().toArrow()
    lang, u = np.array(low.column("lang").to_pylist(), dtype=object), np.asarray(low.column("u"), dtype=np.int64)
    names = sorted(set(lang.tolist()))
    cuts = [int(np.sort(u[lang == x])[:k][-1]) for x in names]
    return hashed.sparkSession.createDataFrame(list(zip(names, cuts, strict=True)), "lang string, cut bigint")


def fit(docs: DataFrame, max_docs: int = MAX_DOCS_PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``max_docs`` documents of each language, those with the least hash of their id, found without a sort or a window by language."""
    lab = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    cuts = _sample_cuts(lab.select("lang", F.xxhash64("doc_id").alias("u")), max_docs)
    chosen = lab.join(F.broadcast(cuts), "lang").where(F.xxhash64("doc_id") <= F.col("cut"))
    rows = chosen.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # rows that repeat an id count once

    def counts(batch: pa.RecordBatch):
        langs = np.array(batch.column("lang").to_pylist())
        for lang in np.unique(langs):
            total = np.zeros(1 << SLOT_BITS, np.int64)
            script = np.zeros(len(SCRIPTS), np.int64)
            for _, _, data, offs in tk.slices(batch.column("text").take(pa.array(np.flatnonzero(langs == lang)))):
                start, end = tk.word_bounds(data, offs, runs=True)
                if len(start):
                    total += np.bincount(trigram_slots(tk.lower_bytes(data), start, end)[0], minlength=1 << SLOT_BITS)
                    s = scripts(data, start, end)
                    script += np.bincount(s[s >= 0], minlength=len(SCRIPTS))
            at = np.flatnonzero(total)
            some = np.flatnonzero(script)
            yield {"lang": [str(lang)] * (len(at) + len(some)), "slot": np.concatenate([at, -1 - some]), "n": np.concatenate([total[at], script[some]])}

    got = arrow_map(rows.select("lang", "text"), counts, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array(got.column("lang").to_pylist(), dtype=object)
    slot, n = (np.asarray(got.column(c), dtype=np.int64) for c in ("slot", "n"))
    languages = sorted(set(lang.tolist()))
    logp = np.zeros((1 << SLOT_BITS, len(languages)), np.float32)
    share = np.zeros((len(SCRIPTS), len(languages)))
    for k, one in enumerate(languages):
        own = (lang == one) & (slot >= 0)
        c = np.zeros(1 << SLOT_BITS)
        c[slot[own]] = n[own]
        logp[:, k] = np.log((c + SMOOTH) / (c.sum() + SMOOTH * len(c)))
        own = (lang == one) & (slot < 0)
        share[-1 - slot[own], k] = n[own] / max(1, n[own].sum())
    states = list(languages)
    allowed: list[np.ndarray] = []
    can = share >= SCRIPT_SHARE
    extra = [ONLY.get(s, "und-" + s) for k, s in enumerate(SCRIPTS) if not can[k].any()]
    states += sorted(set(extra) - set(states))
    for k, s in enumerate(SCRIPTS):
        row = np.zeros(len(states), bool)
        if can[k].any():
            row[: len(languages)] = can[k]
        else:
            row[states.index(ONLY.get(s, "und-" + s))] = True
        allowed.append(row)
    return LanguageModel(languages, logp, states, np.array(allowed))


def emissions(model: LanguageModel, data: np.ndarray, offs: np.ndarray) -> tuple[tk.Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """The words, their scores (words x used states), each script's best language at 0, which states are used (those that some word can take, and the first), and which words have a script."""
    start, end = tk.word_bounds(data, offs, runs=True)
    tok = tk.Tokens(start, end, np.zeros(0, np.uint64), np.searchsorted(start, offs))
    s = scripts(data, start, end) if len(start) else np.zeros(0, np.int64)
    known = s >= 0
    used = np.zeros(len(model.states), bool)
    if not len(start):
        return tok, np.zeros((0, 0), np.float32), used, known
    used[0] = True
    for one in np.unique(s[known]):
        used |= model.allowed[one]
    columns = np.flatnonzero(used)
    e = np.zeros((len(start), len(columns)), np.float32)
    trained = columns[columns < len(model.languages)]
    if len(trained):
        slot, first = trigram_slots(tk.lower_bytes(data), start, end)
        e[:, : len(trained)] = np.add.reduceat(model.logp[:, trained][slot], first[:-1], axis=0)
    e[~known] = 0
    part = np.where(model.allowed[s[known]][:, columns], e[known], np.float32(FAR))
    part -= part.max(1, keepdims=True)
    if "ja" in model.states[len(model.languages) :] and used[ja := model.states.index("ja")]:
        han = s[known] == SCRIPTS.index("Hani")
        part[han, np.searchsorted(columns, ja)] = -HAN_JA * ((end - start)[known][han] // 3)
    e[known] = part
    return tok, np.maximum(e, np.float32(FAR)), used, known


def viterbi(e: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best state of each word: all documents step together, the longest first, so that those still running stay in front."""
    n_words = len(e)
    kind = np.min_scalar_type(max(e.shape[1] - 1, 0))
    out = np.zeros(n_words, kind)
    if not n_words:
        return out
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    base, size = first[:-1][order], size[order]
    running = np.searchsorted(-size, -np.arange(size[0]), "left")  # documents with more than t words
    back = np.zeros(e.shape, kind)
    own = np.arange(e.shape[1], dtype=kind)[None, :]
    v = e[base].astype(np.float64)
    for t in range(1, size[0]):
        n = running[t]
        at = base[:n] + t
        w = v[:n]
        best = w.argmax(1)
        top = w[np.arange(n), best][:, None] - switch
        stay = w >= top
        back[at] = np.where(stay, own, best[:, None].astype(kind))
        v[:n] = np.where(stay, w, top) + e[at]
    state = v.argmax(1).astype(kind)
    for t in range(size[0] - 1, -1, -1):
        n = running[t]
        at = base[:n] + t
        out[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return out


def label_spans(column, model: LanguageModel, switch: float = SWITCH) -> tuple[np.ndarray, ...]:
    """(text, start char, end char, state, words) of the spans of each text of a batch; about ``WORDS_AT_ONCE`` words, of whole texts, are held at a time."""
    done: list[tuple[np.ndarray, ...]] = []
    parts: list[tuple[np.ndarray, ...]] = []
    emit: list[np.ndarray] = []
    used: list[np.ndarray] = []
    scripted: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not held:
            return
        doc, begin, stop = (np.concatenate(x) for x in zip(*parts, strict=True))
        columns = np.flatnonzero(np.logical_or.reduce(used))  # no word can take the other states
        e = np.concatenate([_columns(x, u, k, columns) for x, u, k in zip(emit, used, scripted, strict=True)])
        first = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
        label = columns[viterbi(e, first, switch)]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(doc))
        done.append((doc[head], begin[head], stop[tail - 1], label[head].astype(np.int64), tail - head))
        parts.clear(), emit.clear(), used.clear(), scripted.clear()
        held = 0

    for lo, hi, data, offs in tk.slices(column):
        tok, e, states, known = emissions(model, data, offs)
        if not len(e):
            continue
        chars = tk.char_index(data)
        doc = np.repeat(np.arange(hi - lo), np.diff(tok.first))
        zero = chars[offs[:-1]][doc]
        parts.append((doc + lo, chars[tok.start] - zero, chars[tok.end] - zero))
        emit.append(e)
        used.append(states)
        scripted.append(known)
        held += len(e)
        if held >= WORDS_AT_ONCE:
            flush()
    flush()
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 5


def _columns(e: np.ndarray, used: np.ndarray, known: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """e, which has the used states only, over all of ``columns``; words of no script may take any."""
    own = np.flatnonzero(used)
    if len(own) == len(columns):
        return e
    out = np.full((len(e), len(columns)), FAR, np.float32)
    out[~known] = 0
    out[:, np.searchsorted(columns, own)] = e
    return out


def spans(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """(doc_id, span_no, start_char, end_char, lang, n_words), spans of a document numbered from 0."""

    def run(batch: pa.RecordBatch):
        doc, begin, end, label, words = label_spans(batch.column("text"), model, switch)
        none = np.setdiff1d(np.arange(batch.num_rows), doc)
        no = np.arange(len(doc)) - np.searchsorted(doc, doc)
        z = np.zeros(len(none), np.int64)
        names = pa.array([*model.states, None], pa.string())
        yield {
            "doc_id": batch.column("doc_id").take(pa.array(np.concatenate([doc, none]))), "span_no": np.concatenate([no, z]), "start_char": np.concatenate([begin, z]), "end_char": np.concatenate([end, z]),
            "lang": names.take(pa.array(np.concatenate([label, z + len(model.states)]))), "n_words": np.concatenate([words, z]),
        }

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(own, run, "doc_id bigint, span_no bigint, start_char bigint, end_char bigint, lang string, n_words bigint")
