"""Splitting and packing of one text, as plain Python: what the Arrow operators run for each row.

Lengths are word counts unless another function is given. A chunk list is always emitted whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import accumulate

Length = Callable[[str], int]
#: Signs that end sentences, then clauses, then parts of words.
MARKS = list(".?!*;,()[]“”‘’'\"`:—…/\\–&-")
JSON_MARKS = ["},", "],", "}", "]", ",", " "]


def word_len(text: str) -> int:
    return len(text.split())


LENGTHS: dict[str, Length] = {"word_len": word_len, "len": len}


def length_function(fn: str | Length | None) -> Length:
    """A length function by name, as given, or word_len for None."""
    return LENGTHS[fn] if isinstance(fn, str) else fn or word_len


def default_separators(text: str, newlines_first: bool = False) -> list[str]:
    """Runs of white space of the text, the longest first and by code points among equals (with ``newlines_first``: those of newlines alone ahead of the others), then the marks and ''."""
    runs = set(re.findall(r"\s+", text))
    key = lambda r: (newlines_first and r.strip("\n") != "", -len(r), r)
    return [*sorted(runs, key=key), *MARKS, ""]


def split_keep(text: str, separator: str, keep: str | bool | None, is_regex: bool = False) -> list[str]:
    """Pieces between separators; these stay at the start or the end of a piece, or go. Empty pieces go; '' gives characters."""
    if separator == "":
        return list(text)
    found = list(re.finditer(separator if is_regex else re.escape(separator), text))
    if keep in (False, None):
        cuts = [(a.end() if a else 0, b.start() if b else len(text)) for a, b in zip([None, *found], [*found, None], strict=True)]
    else:
        at = [m.end() if keep == "end" else m.start() for m in found]
        cuts = list(zip([0, *at], [*at, len(text)], strict=True))
    return [text[a:b] for a, b in cuts if a < b]


def pack(pieces: Sequence[str], joiner: str, size: int, overlap: int = 0, length: Length = word_len) -> list[str]:
    """Greedy packing: pieces are gathered while their lengths, and the joiner's, fit in ``size``; each chunk begins with as many of the last one's pieces as
    ``overlap`` allows. A piece that is too long by itself is a chunk as it is; others are stripped, and dropped where empty."""
    gap, sizes = length(joiner), [length(p) for p in pieces]
    upto = [0, *accumulate(sizes)]
    held = lambda a, b: upto[b] - upto[a] + gap * max(0, b - a - 1)
    out: list[str] = []
    begin = 0

    def close(end: int) -> None:
        if end > begin and (text := joiner.join(pieces[begin:end]).strip()):
            out.append(text)

    for i, n in enumerate(sizes):
        if held(begin, i) + n + (gap if i > begin else 0) > size:
            close(i)
            while begin < i and (held(begin, i) > overlap or (held(begin, i) > 0 and held(begin, i) + n + gap > size)):
                begin += 1
            if begin == i and n > size:
                out.append(pieces[i])
                begin = i + 1
    close(len(pieces))
    return out


def _first_separator(text: str, separators: Sequence[str], is_regex: bool) -> tuple[str, Sequence[str]]:
    for k, s in enumerate(separators):
        if s == "":
            return s, []
        if re.search(s if is_regex else re.escape(s), text):
            return s, separators[k + 1 :]
    return separators[-1], []


def split_recursive(text: str, separators: Sequence[str], size: int, overlap: int = 0, keep: str | bool | None = "start", is_regex: bool = False, length: Length = word_len) -> list[str]:
    """Split at the first separator that occurs; pieces below ``size`` are packed, others are split by the later separators."""
    separator, later = _first_separator(text, separators, is_regex)
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        out.extend(pack(run, "" if keep else separator, size, overlap, length))
        run.clear()

    for piece in split_keep(text, separator, keep, is_regex):
        if length(piece) < size:
            run.append(piece)
            continue
        flush()
        out.extend(split_recursive(piece, later, size, overlap, keep, is_regex, length) if later else [piece])
    flush()
    return out


def split_repacked(text: str, separators: Sequence[str], size: int, keep: str | bool | None = None, is_regex: bool = False, length: Length = word_len) -> list[str]:
    """Like ``split_recursive`` without overlap, but what a longer piece splits into is packed again among its neighbours."""
    separator, later = _first_separator(text, separators, is_regex)
    joiner = "" if keep else separator
    pieces: list[str] = []
    for piece in split_keep(text, separator, keep, is_regex):
        if length(piece) < size or not later:
            pieces.append(piece)
        else:
            pieces += split_repacked(piece, later, size, keep, is_regex, length)
    return pack(pieces, joiner, size, 0, length)
