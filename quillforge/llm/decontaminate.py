"""Benchmark decontamination with an FM-index per training shard.

Test phrases are all runs of ``PHRASE_WORDS`` words of each benchmark item (a shorter item of ``MIN_ITEM_WORDS`` words or more is one phrase). A
shard is a batch of documents. Its words are written in the alphabet of the benchmark's words; words outside it cannot be
part of a phrase, so only runs of alphabet words as long as the shortest phrase are indexed, each ended by a separator.
The index is a Burrows-Wheeler transform over a suffix array (prefix doubling), its ranks a wavelet matrix; phrases are
searched backwards all at once, hits located by walking to suffix positions sampled every ``SAMPLE`` words and at the
starts of runs, and hits of a document merged into removal spans.

Benchmarks beyond ``MAX_BENCHMARK_BYTES`` are searched in passes, each over the texts as they were given. The hits of all passes are kept by text, merged once and cut once, so
the number of passes changes no result.

Defined results: NULL or empty texts have no spans; rows without an id are searched under a NULL id by
``strip`` and dropped by ``leaks``; repeated rows each get their spans; an empty benchmark finds nothing; items without
an id or text are ignored; items under ``MIN_ITEM_WORDS`` words are too short to tell a leak and are ignored; extra columns are ignored by ``leaks`` and kept
by ``strip``. Case, punctuation and white space between words don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import arrow_map, id_text, list_array, map_batches, materialize, unused

PHRASE_WORDS = 8
MIN_ITEM_WORDS = 5
SAMPLE = 8
#: Benchmarks beyond this many bytes of text are searched in several passes, so that what is shipped stays bounded.
MAX_BENCHMARK_BYTES = 8 << 20


@dataclass
class Phrases:
    """vocab: sorted word hashes (word i has symbol i + 1); rows: by length, symbols of each distinct phrase; items: of each phrase, flat with offsets."""

    vocab: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=0)


def compile_phrases(item_ids: np.ndarray, texts: pa.Array, words: int = PHRASE_WORDS) -> Phrases:
    """The distinct phrases of the items, by length, with the items that have them."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offs in tk.slices(texts):
        tok = tk.tokenize(data, offs)
        hashes.append(tok.hash)
        counts.append(np.diff(tok.first))
    vocab, sym = np.unique(np.concatenate(hashes), return_inverse=True)
    sym, count = (sym + 1).astype(np.int32), np.concatenate(counts)
    begin = np.cumsum(count) - count
    out = {}
    for n in range(MIN_ITEM_WORDS, words + 1):
        own = np.flatnonzero(count >= words if n == words else count == n)
        size = count[own] - n + 1
        if not size.sum():
            continue
        item = np.repeat(own, size)
        start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[item]
        rows = np.ascontiguousarray(sym[start[:, None] + np.arange(n)])
        _, first, which = np.unique(rows.view(f"V{4 * n}").ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([which, item_ids[item]], 1), axis=0)
        out[n] = (rows[first], pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)))
    return Phrases(vocab, out)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of symbols where 0 separates; each separator ranks by its place, so no comparison crosses one. Prefix doubling."""
    n = len(s)
    sep = s == 0
    rank = np.where(sep, np.cumsum(sep) - 1, s + sep.sum()).astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while True:
        ahead = np.zeros(n, np.int64)
        if k < n:
            ahead[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2 if n else 1)
        key = key + np.where(sep, 0, ahead)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if n == 0 or new.max() == n - 1:
            return order
        rank, k = new, 2 * k


class WaveletMatrix:
    """rank(c, i): how often c occurs before i; vectorised over c and i."""

    def __init__(self, s: np.ndarray, bits: int):
        self.levels: list[tuple[np.ndarray, int]] = []
        for b in range(bits - 1, -1, -1):
            one = ((s >> b) & 1).astype(bool)
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((ones, len(s) - int(ones[-1])))
            s = np.concatenate([s[~one], s[one]])
        self.bits = bits

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros(len(i), np.int64)
        i = i.astype(np.int64)
        for level, (ones, zeros) in enumerate(self.levels):
            one = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            oi, os = ones[i], ones[start]
            i = np.where(one, zeros + oi, i - oi)
            start = np.where(one, zeros + os, start - os)
        return i - start


class FMIndex:
    """Over symbols > 0 with 0 as separator; the first and the last symbol must be 0."""

    def __init__(self, s: np.ndarray, symbols: int, sample: int = SAMPLE):
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(symbols).bit_length()))
        self.less = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols + 1))])
        self.sampled = (sa % sample == 0) | (self.bwt == 0)
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the phrases (rows of symbols), by backward search."""
        n, width = phrases.shape
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.bwt), np.int64)
        live = np.arange(n)
        for k in range(width - 1, -1, -1):
            c = phrases[live, k]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.less[c] + both[: len(c)], self.less[c] + both[len(c) :]
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        dead = np.ones(n, bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes, by steps back to a sampled one."""
        at, steps, out = rows.copy(), 0, np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.sampled[at[todo]]
            done = todo[hit]
            out[done] = self.samples[self.sample_at[at[done]]] + steps
            todo = todo[~hit]
            c = self.bwt[at[todo]]
            at[todo] = self.less[c] + self.wavelet.rank(c, at[todo])
            steps += 1
        return out


Hits = tuple[np.ndarray, ...]


def find_hits(column, phrases: Phrases) -> Hits:
    """(text, first word, last word, start char, end char, item) of each phrase of each item that a shard holds."""
    nothing = (np.zeros(0, np.int64),) * 6
    need = phrases.shortest
    if not need:
        return nothing
    parts: list[tuple[np.ndarray, ...]] = []
    for lo, _, data, offs in tk.slices(column):
        tok = tk.tokenize(data, offs)
        if not len(tok.hash):
            continue
        at = np.minimum(np.searchsorted(phrases.vocab, tok.hash), len(phrases.vocab) - 1)
        known = phrases.vocab[at] == tok.hash
        start, end = tk.run_bounds(known, tok.first)
        long = end - start >= need
        start, end = start[long], end[long]
        if not len(start):
            continue
        size = end - start
        base = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        word = np.arange(size.sum()) + base
        chars = tk.char_index(data)
        doc = np.searchsorted(tok.first, word, "right") - 1
        gap = np.zeros(len(word), bool)
        gap[np.cumsum(size) - 1] = True
        zero = chars[offs[doc]]
        parts.append((at[word] + 1, lo + doc, word - tok.first[doc], chars[tok.start[word]] - zero, chars[tok.end[word]] - zero, gap))
    if not parts:
        return nothing
    sym, doc, word, begin, stop, gap = (np.concatenate(x) for x in zip(*parts, strict=True))
    place = np.arange(len(sym)) + np.concatenate([[0], np.cumsum(gap)[:-1]]) + 1
    s = np.zeros(place[-1] + 2, np.int64)
    s[place] = sym
    back = np.zeros(len(s), np.int64)
    back[place] = np.arange(len(sym))
    index = FMIndex(s, len(phrases.vocab))
    hits: list[Hits] = []
    for n, (rows, items, item_offs) in phrases.by_length.items():
        lo, hi = index.search(rows)
        count = hi - lo
        which = np.repeat(np.arange(len(rows)), count)
        row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[which]
        reps = np.diff(item_offs)[which]
        first = np.repeat(back[index.locate(row)], reps)
        item = items[np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(item_offs[which], reps)]
        hits.append((doc[first], word[first], word[first] + n - 1, begin[first], stop[first + n - 1], item))
    return tuple(np.concatenate(x) for x in zip(*hits, strict=True))


def merge_hits(doc, first, last, begin, end, item) -> Hits:
    """(text, start char, end char, item ids flat, their offsets): hits that overlap or whose words follow each other with one character between, merged; by text and place."""
    if not len(doc):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(1, np.int64),)
    order = np.lexsort((first, doc))
    doc, first, last, begin, end, item = (x[order] for x in (doc, first, last, begin, end, item))
    words, chars = int(last.max()) + 3, int(end.max()) + 3
    reach, stop = np.maximum.accumulate(doc * words + last), np.maximum.accumulate(doc * chars + end)  # one running maximum serves all texts
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] * words + first[1:] > reach[:-1] + 1) | (doc[1:] * chars + begin[1:] > stop[:-1] + 1)
    span, head = np.cumsum(new) - 1, np.flatnonzero(new)
    pairs = np.unique(np.stack([span, item], 1), axis=0)
    return doc[head], begin[head], np.maximum.reduceat(end, head), pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(head) + 1))


def find_leaks(column, phrases: Phrases) -> Hits:
    """The merged spans of a shard: as ``merge_hits``."""
    return merge_hits(*find_hits(column, phrases))


def phrase_passes(benchmark: DataFrame, words: int = PHRASE_WORDS) -> tuple[int, Iterator[Phrases]]:
    """How many parts the benchmark has, each of about ``MAX_BENCHMARK_BYTES`` of whole items or less, and the phrases of each, made as they are asked for."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // MAX_BENCHMARK_BYTES))

    def one(k: int) -> Phrases:
        got = (items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else items).toArrow()
        return compile_phrases(np.asarray(got.column("item_id"), dtype=np.int64), got.column("text").combine_chunks(), words)

    return passes, (one(k) for k in range(passes))


def _spans_by_text(docs: DataFrame, passes: Iterator[Phrases]) -> DataFrame:
    """(h, size, spans): of each distinct text with hits in any pass, known by hash and bytes, the merged spans (start_char, end_char, item_ids). Each pass is written as it is made; hits of
    equal texts become one before they are gathered, so a group holds one text's."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").select("text", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"))
    names = ("first", "last", "b", "e", "item")
    found = None
    for phrases in passes:

        def run(batch: pa.RecordBatch, phrases=phrases):
            d, *rest = find_hits(batch.column("text"), phrases)
            take = pa.array(d)
            yield {"h": batch.column("h").take(take), "size": batch.column("size").take(take), **dict(zip(names, rest, strict=True))}

        part = materialize(arrow_map(texts, run, "h bigint, size int, " + ", ".join(f"{c} bigint" for c in names)).distinct(), "hits")
        found = part if found is None else found.unionByName(part)
    grouped = found.groupBy("h", "size").agg(F.collect_list(F.struct(*names)).alias("hits"))

    def merge(batch: pa.RecordBatch):
        hits = batch.column("hits")
        values, offs = hits.flatten(), np.asarray(hits.offsets).astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offs))
        d, b, e, item, item_offs = merge_hits(doc, *(np.asarray(values.field(k), dtype=np.int64) for k in range(5)))
        spans = pa.StructArray.from_arrays([pa.array(b), pa.array(e), list_array(item, item_offs.astype(np.int32))], ["start_char", "end_char", "item_ids"])
        yield {"h": batch.column("h"), "size": batch.column("size"), "spans": list_array(spans, np.searchsorted(d, np.arange(batch.num_rows + 1)).astype(np.int32))}

    return arrow_map(grouped, merge, "h bigint, size int, spans array<struct<start_char: bigint, end_char: bigint, item_ids: array<bigint>>>")


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = PHRASE_WORDS) -> DataFrame:
    """(doc_id, start_char, end_char, item_ids): the spans [start, end) of documents' characters that hold benchmark phrases. One pass over the benchmark is a map without a shuffle."""
    n, passes = phrase_passes(benchmark, words)
    own = id_text(docs)
    if n > 1:
        spans = _spans_by_text(docs, passes)
        keyed = own.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"))
        return keyed.join(spans, ["h", "size"]).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start_char", "s.end_char", "s.item_ids")
    phrases = next(passes)

    def run(batch: pa.RecordBatch):
        d, b, e, item, offs = find_leaks(batch.column("text"), phrases)
        yield {"doc_id": batch.column("doc_id").take(pa.array(d)), "start_char": b, "end_char": e, "item_ids": list_array(item, offs.astype(np.int32))}

    return arrow_map(own, run, "doc_id bigint, start_char bigint, end_char bigint, item_ids array<bigint>")


def cut_spans(texts: list, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> dict[int, str]:
    """The texts that change, without their spans [begin, end) of characters; spans are in order and don't overlap."""
    out: dict[int, str] = {}
    bounds = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        text, at, kept = texts[doc[i]].as_py() if hasattr(texts[doc[i]], "as_py") else texts[doc[i]], 0, []
        for k in range(i, j):
            kept.append(text[at : begin[k]])
            at = end[k]
        out[int(doc[i])] = "".join([*kept, text[at:]])
    return out


def replace_texts(batch: pa.RecordBatch, text_at: int, chars_at: int | None, new: dict[int, str]) -> pa.RecordBatch:
    """The batch with some texts changed, and their character counts."""
    if not new:
        return batch
    rows = pa.array(sorted(new), pa.int64())
    mask = np.zeros(batch.num_rows, bool)
    mask[rows.to_numpy()] = True
    cols = list(batch.columns)

    def put(k: int, values: list) -> None:
        cols[k] = pc.replace_with_mask(cols[k], pa.array(mask), pa.array(values, cols[k].type))

    ordered = [new[i] for i in sorted(new)]
    put(text_at, ordered)
    if chars_at is not None:
        put(chars_at, [len(x) for x in ordered])
    return pa.RecordBatch.from_arrays(cols, schema=batch.schema)


def chars_column(docs: DataFrame) -> int | None:
    return next((i for i, (c, t) in enumerate(docs.dtypes) if c == "n_chars" and t in ("int", "bigint")), None)


def strip(docs: DataFrame, benchmark: DataFrame, words: int = PHRASE_WORDS) -> DataFrame:
    """docs with the leaked spans cut out of text and n_chars brought up to date; every row stays, other columns as they were. One pass over the benchmark is a map without a shuffle."""
    schema, text_at, chars_at = docs.schema, docs.columns.index("text"), chars_column(docs)
    n, passes = phrase_passes(benchmark, words)
    if n > 1:
        h, size, spans = unused(docs, "h", "size", "spans")
        cuts = _spans_by_text(docs, passes).select(F.col("h").alias(h), F.col("size").alias(size), F.transform("spans", lambda s: F.struct(s["start_char"].alias("b"), s["end_char"].alias("e"))).alias(spans))
        text = docs["text"].cast("string")
        joined = docs.join(cuts, (F.xxhash64(text) == cuts[h]) & (F.octet_length(text) == cuts[size]), "left").drop(h, size)

        def cut(batches):
            for batch in batches:
                marks, plain = batch.columns[-1], pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
                values, lengths = marks.flatten(), np.nan_to_num(np.asarray(pc.list_value_length(marks), dtype=float)).astype(np.int64)
                b, e = (np.asarray(values.field(k), dtype=np.int64) for k in (0, 1))
                yield replace_texts(plain, text_at, chars_at, cut_spans(plain.column(text_at), np.repeat(np.arange(len(lengths)), lengths), b, e))

        return map_batches(joined, cut, schema)
    phrases = next(passes)

    def run(batches):
        for batch in batches:
            d, b, e, _, _ = find_leaks(batch.column(text_at), phrases)
            yield replace_texts(batch, text_at, chars_at, cut_spans(batch.column(text_at), d, b, e))

    return map_batches(docs, run, schema)
