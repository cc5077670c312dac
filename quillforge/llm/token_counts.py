"""Token counts by a compiled finite-state tokenizer.

A byte-level merge tokenizer becomes two deterministic transducers. The first reads character classes and marks where the pattern that
splits a text into words lets a word begin (a mark may concern the character before, so nothing is looked ahead). The
second reads a word's bytes; its states hold, for each ending of what was read that some token begins with, the last token before that ending and how
many tokens fewer stood there. Each transition is annotated with the number of tokens that it adds; reading a word and
adding up gives the word's tokens. States and transitions are made when they are first met and kept; words begin in the start state.

Texts of a batch are read as one stream, an end mark after each, cut into chunks of ``CHUNK`` characters. For each chunk the first transducer's whole map from
start states to end states is made, the maps are composed by a parallel prefix scan (doubling), which gives each
chunk's start state, and all chunks are then read at once. Word counts are kept by word, identified by 64 bits of hash.

Defined results: NULL and empty texts have 0 tokens; texts that hold the strings of special tokens count them as ordinary text; rows without an
id are kept under a NULL id; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import base64
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .bpe import Merges
from .common import arrow_map

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 64
#: Kept states and words, beyond which a worker forgets them and begins anew; results don't depend on it.
MAX_STATES = 300_000
MAX_WORDS = 4_000_000
#: Words of more bytes are read one by one, the others all at once.
LONG_WORD = 96

CLASSES = ["L", "C", "R", "l", "e", "N", "S", "W", "Q", "O", "END", "PAD"]
STATES = ["start", "L", "N", "O", "S1", "W1", "Sm", "Wm", "Q", "Qe", "Ql", "done"]
HERE, BEFORE = 1, 2


def _first_transducer() -> tuple[np.ndarray, np.ndarray]:
    """next and marks, both classes x states: HERE, a word begins at this character; BEFORE, one begins at the character before."""
    nxt = np.zeros((len(CLASSES), len(STATES)), np.uint8)
    out = np.zeros_like(nxt)
    s = STATES.index
    letters = "LCRle"

    def begin(c: str) -> int:
        """The state after a word's first character; an apostrophe may begin a contraction."""
        return s("L") if c in letters else s({"N": "N", "O": "O", "Q": "Q", "S": "S1", "W": "W1"}[c])

    def step(q: str, c: str) -> tuple[int, int]:
        if c == "PAD":
            return s(q), 0
        if c == "END":
            return s("start"), BEFORE if q in ("Qe", "Ql") else 0
        if q in ("start", "done"):
            return begin(c), HERE
        if q == "Q":
            if c in ("C", "R", "l"):
                return s({"C": "done", "R": "Qe", "l": "Ql"}[c]), 0
            return (s("O"), 0) if c in ("O", "Q") else (begin(c), HERE)
        if q in ("Qe", "Ql"):
            if c == q[1]:
                return s("done"), 0
            to, mark = step("L", c)
            return to, mark | BEFORE
        if q in ("S1", "W1", "Sm", "Wm"):
            if c in ("S", "W"):
                return s(c + "m"), 0
            before = BEFORE if q[1] == "m" else 0
            if q[0] == "W":
                return begin(c), before | HERE
            return (s("O") if c == "Q" else begin(c)), before
        same = {"L": letters, "N": "N", "O": "OQ"}[q]
        return (s(q), 0) if c in same else (begin(c), HERE)

    for i, c in enumerate(CLASSES):
        for k, q in enumerate(STATES):
            nxt[i, k], out[i, k] = step(q, c)
    return nxt, out


NEXT, MARK = _first_transducer()
_class_of: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _class_of
    if _class_of is None:
        table = np.full(sys.maxunicode + 1, CLASSES.index("O"), np.uint8)
        for cp in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(cp))[0]
            if kind == "L":
                table[cp] = CLASSES.index("L")
            elif kind == "N":
                table[cp] = CLASSES.index("N")
        for cp in [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
            table[cp] = CLASSES.index("W")
        table[32], table[39] = CLASSES.index("S"), CLASSES.index("Q")
        for c in "stdm":
            table[ord(c)] = CLASSES.index("C")
        table[ord("r")] = table[ord("v")] = CLASSES.index("R")
        table[ord("l")], table[ord("e")] = CLASSES.index("l"), CLASSES.index("e")
        _class_of = table
    return _class_of


def chunk_maps(cls: np.ndarray) -> np.ndarray:
    """(chunks x states): the end state that each chunk leads to from each start state. cls: chunks x CHUNK."""
    flat = NEXT.ravel()
    maps = np.broadcast_to(np.arange(len(STATES), dtype=np.uint8), (len(cls), len(STATES))).copy()
    base = cls.astype(np.uint8) * np.uint8(len(STATES))
    for k in range(cls.shape[1]):
        maps = flat[maps + base[:, k, None]]
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Compositions of all maps up to each one, by doubling."""
    maps = maps.copy()
    gap = 1
    while gap < len(maps):
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap], 1)  # the earlier maps first
        gap *= 2
    return maps


def word_starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes at which words begin, first word of each text)."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    low = data[lead].astype(np.int32)
    cp = low.copy()
    multi = np.flatnonzero(low >= 0xC0)
    if len(multi):
        at = lead[multi]
        b = [data[np.minimum(at + k, len(data) - 1)].astype(np.int32) & 63 for k in range(1, 4)]
        f = low[multi]
        cp[multi] = np.where(f < 0xE0, (f & 31) << 6 | b[0], np.where(f < 0xF0, (f & 15) << 12 | b[0] << 6 | b[1], (f & 7) << 18 | b[0] << 12 | b[1] << 6 | b[2]))
    kinds = _classes()[cp]
    ends = np.searchsorted(lead, offs[1:])  # an end mark stands before each of these characters
    own = np.arange(len(lead)) + np.searchsorted(ends, np.arange(len(lead)), "right")
    total = len(lead) + len(offs) - 1
    cls = np.full(-(-max(total, 1) // CHUNK) * CHUNK, CLASSES.index("PAD"), np.uint8)
    cls[:total] = CLASSES.index("END")
    cls[own] = kinds
    cls = cls.reshape(-1, CHUNK)
    state = np.zeros(len(cls), np.uint8)
    state[1:] = prefix_scan(chunk_maps(cls))[:-1, 0]
    flat, marks = NEXT.ravel(), MARK.ravel()
    out = np.empty_like(cls)
    for k in range(CHUNK):
        at = cls[:, k] * np.uint8(len(STATES)) + state
        out[:, k], state = marks[at], flat[at]
    out = out.ravel()
    begins = (out & HERE).astype(bool)
    begins[:-1] |= (out[1:] & BEFORE).astype(bool)
    start = lead[begins[own]]
    return start, np.searchsorted(start, offs)


class WordTransducer:
    """The second transducer. A state is a tuple of (trie node, token before, tokens fewer) for each live ending; table[state, column of byte] packs
    the next state and 128 + the tokens that the transition adds, -1 where it wasn't made yet."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for t, word in enumerate(merges.tokens):
            if t in merges.dead:
                continue
            node = 0
            for b in word:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = t
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.index = [start], {start: 0}
        self.column = np.full(256, -1, np.int32)
        self.table = np.full((1024, 32), -1, np.int32)

    def make(self, state: int, byte: int) -> int:
        """The packed transition, now in the table."""
        live, found = [], None
        for node, last, fewer in self.states[state]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            t = self.token[to]
            if found is None and t >= 0 and (last < 0 or self.merges.valid(last, t)):
                found = (t, fewer + 1)
            if self.child[to]:
                live.append((to, last, fewer))
        if found is None:
            raise ValueError(f"no token for byte {byte}")
        t, add = found
        key = tuple((n, last, fewer - add) for n, last, fewer in live) + ((0, t, 0),)
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
        col = int(self.column[byte])
        if col < 0:
            col = self.column[byte] = int(self.column.max()) + 1
        rows, cols = self.table.shape
        if to >= rows or col >= cols:
            grown = np.full((2 * rows if to >= rows else rows, 2 * cols if col >= cols else cols), -1, np.int32)
            grown[:rows, :cols] = self.table
            self.table = grown
        self.table[state, col] = packed = to << 8 | (add + 128)
        return packed

    def count_one(self, word: bytes) -> int:
        state, n = 0, 0
        for b in word:
            col = self.column[b]
            p = int(self.table[state, col]) if col >= 0 else -1
            if p < 0:
                p = self.make(state, b)
            state, n = p >> 8, n + (p & 255) - 128
        return n

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start:end]; all words step together, the longest first."""
        if len(self.states) > MAX_STATES:
            self.reset()
        size = end - start
        out = np.zeros(len(start), np.int64)
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = self.count_one(data[start[i] : end[i]].tobytes())
        order = np.argsort(-size, kind="stable")
        order = order[np.searchsorted(-size[order], -LONG_WORD, "left") :]
        at, size = start[order], size[order]
        state, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -k, "left"))
            byte = data[at[:m] + k]
            col = self.column[byte]
            p = np.where(col >= 0, self.table[state[:m], np.maximum(col, 0)], -1)
            new = np.flatnonzero(p < 0)
            if len(new):
                key, inverse = np.unique(state[new] * 256 + byte[new], return_inverse=True)
                p[new] = np.array([self.make(int(x) >> 8, int(x) & 255) for x in key], np.int32)[inverse]
            state[:m] = p >> 8
            n[:m] += (p & 255) - 128
        out[order] = n
        return out


class Counter:
    """Counts tokens of texts; words that were counted are kept."""

    def __init__(self, merges: Merges):
        self.words = WordTransducer(merges)
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, column) -> np.ndarray:
        out = []
        for lo, hi, data, offs in tk.slices(column, 4 << 20):
            if not len(data):
                out.append(np.zeros(hi - lo, np.int64))
                continue
            start, first = word_starts(data, offs)
            end = np.append(start[1:], len(data))
            h, one, inverse = np.unique(tk.span_hashes(data, start, end), return_index=True, return_inverse=True)
            at = np.searchsorted(self.keys, h)
            known = np.zeros(len(h), bool)
            if len(self.keys):
                known = self.keys[np.minimum(at, len(self.keys) - 1)] == h
            new = np.flatnonzero(~known)
            n = np.zeros(len(h), np.int64)
            n[known] = self.counts[at[known]]
            n[new] = self.words.count(data, start[one[new]], end[one[new]])
            if len(self.keys) > MAX_WORDS:
                self.keys, self.counts = h, n
            else:
                self.keys, self.counts = np.insert(self.keys, at[new], h[new]), np.insert(self.counts, at[new], n[new])
            total = np.concatenate([[0], np.cumsum(n[inverse])])
            out.append(total[first[1:]] - total[first[:-1]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def read_ranks(path: str = RANKS) -> Merges:
    """Merges of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    merges = Merges(sorted(ranks, key=ranks.__getitem__))
    if merges.dead:
        raise ValueError("the tokenizer has tokens that no merge makes")
    return merges


_counters: dict[tuple, Counter] = {}


def counter_of(merges: Merges) -> Counter:
    """One counter for each tokenizer of a worker process."""
    key = (len(merges.tokens), hash(tuple(merges.tokens)))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(merges)
    return _counters[key]


def count_tokens(docs: DataFrame, merges: Merges) -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    def run(batch: pa.RecordBatch):
        yield {"doc_id": batch.column("doc_id"), "n_tokens": counter_of(merges).count(batch.column("text"))}

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(own, run, "doc_id bigint, n_tokens bigint")
