"""Chunkers: documents to size-bounded pieces. All emit every piece, with its place ``pos``; none shuffles."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.splitting import JSON_MARKS, MARKS, Length, default_separators, length_function, pack, split_keep, split_recursive, split_repacked
from .arrow import flat_map


def _pieces(df: DataFrame, id_col: str, text_col: str, cut: Callable[[str], list[str]], length: Length) -> DataFrame:
    own = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = dict(df.dtypes)[id_col]

    def one(row: dict):
        for k, p in enumerate(cut(row["__text"]) if row["__text"] is not None else []):
            yield {id_col: row[id_col], "pos": k, "size": length(p), "content": p}

    return flat_map(own, one, f"{id_col} {kind}, pos bigint, size bigint, content string")


def pack_pieces(df: DataFrame, separator: str = "\n", size: int = 50, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text", length: str | Length | None = None) -> DataFrame:
    """Texts cut at ``separator`` and packed greedily: (id, pos, size, content). NULL and empty texts give nothing."""
    if overlap >= size:
        raise ValueError(f"the overlap {overlap} must be below the size {size}")
    count = length_function(length)
    return _pieces(df, id_col, text_col, lambda t: pack(split_keep(t, separator, None), separator, size, overlap, count), count)


def chunk_by_characters(
    df: DataFrame, size: int = 4000, overlap: int = 200, separators: Sequence[str] | None = None, keep: str | bool | None = "start", is_regex: bool = False, id_col: str = "doc_id", text_col: str = "text", length: str | Length | None = None
) -> DataFrame:
    """Recursive splitting by the first separator that occurs; those of the text itself unless given. A text that isn't split stays as it is, an empty one too; NULL gives nothing."""
    if overlap >= size:
        raise ValueError(f"the overlap {overlap} must be below the size {size}")
    count = length_function(length)

    def cut(text: str) -> list[str]:
        if text == "":
            return [text]
        pieces = split_recursive(text, separators or default_separators(text), size, overlap, keep, is_regex, count)
        return pieces if len(pieces) > 1 else [text]

    return _pieces(df, id_col, text_col, cut, count)


def split_texts(df: DataFrame, size: int = 4000, separators: Sequence[str] | None = None, keep: str | bool | None = "start", id_col: str = "doc_id", text_col: str = "text", length: str | Length | None = None) -> DataFrame:
    """Texts split by the first separator that occurs, longer pieces by the next ones, and all packed again up to ``size``. NULL and empty texts give nothing."""
    count = length_function(length)
    return _pieces(df, id_col, text_col, lambda t: split_repacked(t, separators or default_separators(t, newlines_first=True), size, keep, False, count) if t else [], count)


def separators_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, separators): what ``split_texts`` and the flattener try on each text, in order, joined by |."""
    kind = dict(df.dtypes)[id_col]
    own = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    return flat_map(own, lambda r: [{id_col: r[id_col], "separators": "|".join(default_separators(r["__text"] or "", newlines_first=True))}], f"{id_col} {kind}, separators string")


def chunk_json_strings(df: DataFrame, size: int = 4000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text", length: str | Length | None = None) -> DataFrame:
    """``chunk_by_characters`` at the ends of JSON values."""
    return chunk_by_characters(df, size, overlap, JSON_MARKS, "end", False, id_col, text_col, length)


LUMBER_SEPARATORS = ["\n\n", "\n", "\t", *MARKS, " ", ""]


def lumber_groups(splits: list[str], size: int, length: Length, choose: Callable[[int, list[str]], int | None] | None = None) -> list[tuple[int, int]]:
    """Runs [first, stop) of numbered splits: a window ends where its lengths reach ``size``; ``choose`` (a model) may end it earlier."""
    numbered = [f"ID {i}: {s}" for i, s in enumerate(splits)]
    upto = [0]
    for s in numbered:
        upto.append(upto[-1] + length(s))
    out, at = [], 0
    while at < len(splits):
        stop = min(bisect_left(upto[:-1], upto[min(at, len(splits) - 1)] + size), len(splits))
        if stop <= at + 1:
            stop = at + 1
        elif choose is not None and (said := choose(at, numbered[at:stop])) is not None:
            stop = said if said > at else at + 1
        out.append((at, min(stop, len(splits))))
        at = stop
    return out


def lumber_chunks(
    df: DataFrame, size: int = 256, candidate: int | None = None, separators: Sequence[str] | None = None, joiner: str = " ", make_choose: Callable[[], Callable[[int, list[str]], int | None]] | None = None, id_col: str = "doc_id", text_col: str = "text", length: str | Length | None = None
) -> DataFrame:
    """Small splits grouped by windows of ``size``; where ``make_choose`` makes a model's chooser, on the worker, it sets each window's end. Without one the result is fixed."""
    count = length_function(length)
    small = candidate or max(10, size // 8)
    choosers: list = []

    def cut(text: str) -> list[str]:
        splits = split_repacked(text, separators or LUMBER_SEPARATORS, small, "start", False, count)
        if len(splits) <= 1:
            return [text]
        if make_choose and not choosers:
            choosers.append(make_choose())
        return [joiner.join(splits[a:b]) for a, b in lumber_groups(splits, size, count, choosers[0] if choosers else None)]

    return _pieces(df, id_col, text_col, cut, count)


def chunk_code(df: DataFrame, size: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Source code cut before lines that begin at the left margin after an indented one or a blank line, packed up to ``size`` characters."""
    pattern = r"(?<=\n)(?=\S)"

    def cut(text: str) -> list[str]:
        return pack(split_keep(text, pattern, "start", True), "", size, 0, len)

    return _pieces(df, id_col, text_col, cut, len)
