"""Vectorised text kernel: Arrow string columns to word tokens and 64-bit hashes, in numpy.

A *word* is a maximal run of letters, digits and their marks by Unicode's classes; everything else (spaces, punctuation, symbols)
separates. In scripts written without spaces (Han, Kana, Thai, Lao, Khmer, Burmese) each letter with its marks is a word. Words compare
with their case folded where the folded letter has as many bytes (not so: sharp s, dotted capital I). NULL texts count as empty. A text is always taken
whole; only the number of texts handled at once is bounded (``SLICE_BYTES``), never the length of one.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
MULT_INV = np.uint64(pow(int(MULT), -1, 1 << 64))

IS_WORD = np.zeros(256, bool)
IS_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
IS_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Scripts without spaces: first code point, one past the last.
ALONE = [(0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3005, 0x3008), (0x3041, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x1B000, 0x1B170), (0x20000, 0x323B0)]
SEPARATOR, LETTER, SINGLE, MARK = range(4)

_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse; those of a longer text than a slice aren't kept."""
    global _POW, _INV
    if len(_POW) >= n:
        return _POW, _INV
    size = max(n, SLICE_BYTES + 1)
    a = np.full(size, MULT, np.uint64)
    a[0] = 1
    b = np.full(size, MULT_INV, np.uint64)
    b[0] = 1
    power, inverse = np.cumprod(a), np.cumprod(b)
    if size == SLICE_BYTES + 1:
        _POW, _INV = power, inverse
    return power, inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Tokens:
    """Words of a slice of texts. start, end: bytes within data; first[i]:first[i+1] are the words of text i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def string_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(col, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, bytes, offsets) over runs of whole texts of about ``limit`` bytes; a longer text is a run."""
    data, offs = string_buffers(col)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


@lru_cache(1)
def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the class, and the folded letter where it is one of as many bytes, else the code point."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    fold = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    of = {"L": LETTER, "N": LETTER, "M": MARK}
    for c in range(128, sys.maxunicode + 1):
        cat = unicodedata.category(x := chr(c))
        kind[c] = LETTER if cat in ("Cn", "Co") else of.get(cat[0], SEPARATOR)
        if cat[0] == "L" and len(y := x.casefold()) == 1 and y != x and len(y.encode()) == len(x.encode()):
            fold[c] = ord(y)
    for a, b in ALONE:
        kind[a:b][kind[a:b] == LETTER] = SINGLE
    kind[[0xAD, 0x200C, 0x200D]] = MARK  # within words: soft hyphen, joiner and non-joiner
    return kind, fold


def _wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bytes, code point) of the characters beyond ASCII."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.uint32)
    size = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
    cp = lead & (np.uint32(0x7F) >> size.astype(np.uint32))
    for k in range(1, 4):
        more = size > k
        cp[more] = (cp[more] << np.uint32(6)) | (data[at[more] + k] & 0x3F)
    return at, size, cp


def lower_bytes(data: np.ndarray) -> np.ndarray:
    low = LOWER[data]
    at, size, cp = _wide(data)
    if not len(at):
        return low
    new = _unicode()[1][cp]
    some = np.flatnonzero(new != cp)
    at, size, new = at[some], size[some], new[some]
    for k in range(1, 4):
        more = size > k
        low[at[more] + size[more] - k] = 0x80 | (new[more] & 0x3F)
        new[more] >>= np.uint32(6)
    low[at] = new | np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[size]
    return low


def word_bounds(data: np.ndarray, offs: np.ndarray, runs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; with ``runs`` neighbours of one script without spaces stay together."""
    inside = IS_WORD[data]
    at, size, cp = _wide(data)
    if not len(at):
        return run_bounds(inside, offs)
    kind = _unicode()[0][cp]
    out = kind == SEPARATOR
    for k in range(4):
        inside[(at + k)[out & (size > k)]] = False
    start, end = run_bounds(inside, offs)
    alone = kind == SINGLE
    if alone.any():
        mark = np.zeros(len(data) + 1, np.int64)
        mark[at[kind == MARK]] = size[kind == MARK]
        mark[offs] = 0  # the next text's
        after = at[alone] + size[alone]
        while (step := mark[after]).any():
            after = after + step
        cut = np.unique(np.concatenate([at[alone], after]))
        if runs:
            c, block = cp[alone], cp[alone] >> np.uint32(7)
            kana = ((c >= 0x3041) & (c < 0x3200)) | ((c >= 0xFF66) & (c < 0xFFA0)) | ((c >= 0x1B000) & (c < 0x1B170))
            block[c >= 0x3000] = np.where(kana, 1, 0)[c >= 0x3000]
            cut = np.setdiff1d(cut, after[:-1][(after[:-1] == at[alone][1:]) & (block[:-1] == block[1:])])
        cut = cut[(cut > 0) & (cut < len(data))]
        cut = cut[inside[cut] & inside[cut - 1] & ~np.isin(cut, offs)]
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end


def run_bounds(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which never reach over a text's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offs[full]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offs[full + 1] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, which are in the order of their starts: differences of a polynomial prefix hash, made free of their place, mixed. Prefixes are made for about
    ``SLICE_BYTES`` at a time, however long a text is."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, base + SLICE_BYTES // 2)))
        top = int(end[i:j].max())
        power, inverse = _powers(top - base + 1)
        acc = np.zeros(top - base + 1, np.uint64)
        acc[1:] = low[base:top]
        acc[1:] += np.uint64(1)
        acc[1:] *= power[: top - base]
        np.cumsum(acc, out=acc)
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (acc[e] - acc[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def tokenize(data: np.ndarray, offs: np.ndarray) -> Tokens:
    start, end = word_bounds(data, offs)
    first = np.searchsorted(start, offs)
    return Tokens(start, end, span_hashes(lower_bytes(data), start, end), first)


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that ``tokenize`` gives these single words."""
    out = np.zeros(len(words), np.uint64)
    for _, hi, data, offs in slices(pa.array(words, pa.string())):
        lo = hi - len(offs) + 1
        out[lo:hi] = span_hashes(lower_bytes(data), offs[:-1], offs[1:])
    return out


def shingles(tok: Tokens, width: int, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all runs of ``width`` words; with ``whole_short`` a shorter text with a word is one shingle."""
    n_tok = np.diff(tok.first)
    count = np.maximum(n_tok - width + 1, 0)
    short = (n_tok > 0) & (count == 0)
    if whole_short:
        count[short] = 1
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(total) - first[doc] + tok.first[doc]
    h = np.zeros(total, np.uint64)
    last = tok.first[doc + 1]
    padded = np.concatenate([tok.hash, np.zeros(width, np.uint64)])
    ok = not short.any()
    for k in range(width):
        w = padded[at + k]
        if not ok:
            w = np.where(at + k < last, w, np.uint64(0))
        h = h * np.uint64(0x100000001B3) * np.uint64(0x9E3779B1) + w
    return mix(h), first


def char_index(data: np.ndarray) -> np.ndarray:
    """Number of characters before each byte, and in all."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
