"""Markdown: headings, sections and blocks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.splitting import Length, length_function
from .arrow import flat_map
from .render import Node


def setext_to_atx(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): lines underlined by = or - become headings of level 1 or 2, outside fenced blocks. A map over texts."""
    kind = dict(df.dtypes)[id_col]

    def one(row: dict):
        if row["__text"] is not None:
            yield {id_col: row[id_col], "text": atx_from_setext(row["__text"])}

    return flat_map(df.select(F.col(id_col), F.col(text_col).alias("__text")), one, f"{id_col} {kind}, text string")


def heading_level(line: Column) -> Column:
    """1 to 6 for an ATX heading, else NULL."""
    n = F.length(F.regexp_extract(line, r"^ {0,3}(#{1,6})(?:[ \t]|$)", 1))
    return F.when(n > 0, n)


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]|$)")


def sections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, level, heading, content): texts cut at ATX headings outside fenced blocks; what stands before the first one belongs to it. Texts with fewer than two headings give nothing. A map over texts."""
    kind = dict(df.dtypes)[id_col]

    def one(row: dict):
        if row["__text"] is None:
            return
        lines, fenced, found = row["__text"].split("\n"), False, []
        for k, line in enumerate(lines):
            if line.lstrip(" ").startswith("```"):
                fenced = not fenced
            elif not fenced and (m := _ATX.match(line)):
                found.append((k, len(m[1])))
        stops = [k for k, _ in found[1:]] + [len(lines)]
        for i, ((k, level), stop) in enumerate(zip(found, stops, strict=True) if len(found) > 1 else []):
            yield {id_col: row[id_col], "section": i, "level": level, "heading": lines[k].strip(" "), "content": "\n".join(lines[k if i else 0 : stop])}

    return flat_map(df.select(F.col(id_col), F.col(text_col).alias("__text")), one, f"{id_col} {kind}, section bigint, level bigint, heading string, content string")


def find_headings(text: str) -> list[tuple[int, int, int]]:
    """(start, end, level) of the ATX and setext headings outside fenced blocks, in order."""
    out, at, fenced, before = [], 0, False, None
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if bare.startswith("```"):
            fenced, before = not fenced, None
        elif not fenced:
            m = re.match(r" {0,3}(#{1,6})(?:[ \t]|$)", line.rstrip("\r\n"))
            if m:
                out.append((at, at + len(line.rstrip("\r\n")), len(m[1])))
                before = None
            elif before and re.fullmatch(r"=+|-+", bare):
                out.append((before[0], at + len(line.rstrip("\r\n")), 1 if bare[0] == "=" else 2))
                before = None
            else:
                before = (at, bare) if bare else None
        at += len(line)
    return out


def combine_small(starts: list[int], levels: list[int], least: int, size: Length, text: str) -> list[int]:
    """Which headings stay: one goes if the section kept before it is below ``least`` and of its level."""
    kept: list[int] = []
    for i in range(len(starts)):
        if not kept or levels[i] != levels[kept[-1]] or size(text[starts[kept[-1]] : starts[i]]) >= least:
            kept.append(i)
    return kept


def collapse_only_children(starts: list[int], levels: list[int], least: int, size: Length, text: str) -> list[int]:
    """Which headings stay: from the end, an only child without children goes if it or its parent's own part is below ``least``; then anew."""
    kept = list(range(len(starts)))
    bounds = [*starts, len(text)]

    def only_child(i: int) -> int | None:
        below, first = [], None
        for j in range(i + 1, len(kept)):
            if levels[kept[j]] <= levels[kept[i]]:
                break
            first = levels[kept[j]] if first is None else first
            if levels[kept[j]] == first:
                below.append(j)
        return below[0] if len(below) == 1 else None

    i = len(kept) - 2
    while i >= 0:
        c = only_child(i)
        if c is not None and not (c + 1 < len(kept) and levels[kept[c + 1]] > levels[kept[c]]):
            stop = bounds[kept[c + 1]] if c + 1 < len(kept) else len(text)
            if min(size(text[starts[kept[i]] : starts[kept[c]]]), size(text[starts[kept[c]] : stop])) < least:
                del kept[c]
                i = len(kept) - 2
                continue
        i -= 1
    return kept


def cut_at_headings(text: str, least: int = -1, size: Length | None = None) -> list[dict]:
    """Sections with level, heading, content, section_text (with all below), parent and previous place; empty for fewer than two headings."""
    found = find_headings(text)
    if len(found) < 2:
        return []
    count = length_function(size)
    while least != -1:
        n = len(found)
        for rule in (collapse_only_children, combine_small):
            if len(found) > 1:
                found = [found[i] for i in rule([f[0] for f in found], [f[2] for f in found], least, count, text)]
        if len(found) == n:
            break
    out: list[dict] = []
    for i, (start, end, level) in enumerate(found):
        up = next((j for j in range(i - 1, -1, -1) if found[j][2] < level), None)
        stop = found[i + 1][0] if i + 1 < len(found) else len(text)
        whole = next((f[0] for f in found[i + 1 :] if f[2] <= level), len(text))
        prev = next((j for j in range(i - 1, -1 if up is None else up, -1) if found[j][2] <= level), None)
        begin = start if i else 0
        out.append({"section": i, "level": level, "heading": text[start:end].strip(), "content": text[begin:stop], "section_text": text[begin:whole], "parent": up, "prev": prev})
    return out


def combine_sections(df: DataFrame, least: int, length: str | Length | None = None, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[str] = ("collapse", "combine")) -> DataFrame:
    """(id, section, level): the headings of each text that stay after one pass of each rule, numbered as they stood: ``combine`` joins small sections of a level, ``collapse`` only children with their parents."""
    kind, count, by = dict(df.dtypes)[id_col], length_function(length), {"collapse": collapse_only_children, "combine": combine_small}

    def one(row: dict):
        text = row["__text"]
        found = find_headings(text) if text is not None else []
        kept = list(range(len(found))) if len(found) > 1 else []
        for rule in rules:
            if len(kept) > 1:
                own = [found[i] for i in kept]
                kept = [kept[i] for i in by[rule]([f[0] for f in own], [f[2] for f in own], least, count, text)]
        for i in kept:
            yield {id_col: row[id_col], "section": i, "level": found[i][2]}

    return flat_map(df.select(F.col(id_col), F.col(text_col).alias("__text")), one, f"{id_col} {kind}, section bigint, level bigint")


def split_by_heading(df: DataFrame, least: int = -1, length: str | Length | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, level, heading, content, section_text, parent, prev): ``cut_at_headings`` of every text; a text with fewer than two headings is one row without a heading."""
    kind = dict(df.dtypes)[id_col]

    def one(row: dict):
        text = row["__text"]
        if text is None:
            return
        for s in cut_at_headings(text, least, length) or [{"section": 0, "level": None, "heading": None, "content": text, "section_text": text, "parent": None, "prev": None}]:
            yield {id_col: row[id_col], **s}

    own = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    return flat_map(own, one, f"{id_col} {kind}, section bigint, level bigint, heading string, content string, section_text string, parent bigint, prev bigint")


_ITEM = re.compile(r"^(\s*)([-+*]|\d+[.)])\s+(.*)$")
_RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")


def atx_from_setext(text: str) -> str:
    """``setext_to_atx`` of one text."""
    out: list[str] = []
    fenced = False
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            fenced = not fenced
        elif not fenced and re.fullmatch(r"=+|-+", bare) and out and out[-1].strip() and not out[-1].strip().startswith("```"):
            out[-1] = ("# " if bare[0] == "=" else "## ") + out[-1]
            continue
        out.append(line)
    return "\n".join(out)


def parse_blocks(text: str, root: Node) -> Node:
    """Markdown blocks below ``root``: headings hold what follows them by level; paragraphs, tables, code, HTML, lists (nested by indent, with markers anew) and rules."""
    lines = atx_from_setext(text).split("\n")
    heads: list[tuple[int, Node]] = [(0, root)]
    i, n = 0, 0

    def node(ctype: str, content: str, mimetype: str = "text/plain", **meta) -> Node:
        nonlocal n
        n += 1
        return Node(f"{root.id}/{n}", ctype, content, None, mimetype, None, meta)

    def put(x: Node) -> None:
        heads[-1][1].add(x)

    while i < len(lines):
        line = lines[i]
        bare = line.strip()
        if not bare:
            i += 1
        elif m := re.match(r" {0,3}(#{1,6})(?:[ \t]|$)", line):
            level = len(m[1])
            while heads[-1][0] >= level:
                heads.pop()
            h = node("header", bare, level=level)
            put(h)
            heads.append((level, h))
            i += 1
        elif bare.startswith("```"):
            stop = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith("```")), len(lines) - 1)
            put(node("code", "\n".join(lines[i : stop + 1]), "text/markdown"))
            i = stop + 1
        elif _RULE.match(line):
            put(node("para", bare))
            i += 1
        elif bare.startswith("|") and i + 1 < len(lines) and re.fullmatch(r"\|?[\s:|-]+\|?", lines[i + 1].strip()):
            stop = next((k for k in range(i, len(lines)) if not lines[k].strip().startswith("|")), len(lines))
            put(node("table", "\n".join(lines[i:stop]).strip(), "text/markdown"))
            i = stop
        elif re.match(r"<[A-Za-z!/]", bare):
            stop = next((k for k in range(i, len(lines)) if not lines[k].strip()), len(lines))
            put(node("code", "\n".join(lines[i:stop]).strip(), "text/html"))
            i = stop
        elif _ITEM.match(line):
            stop = next((k for k in range(i, len(lines)) if not lines[k].strip() or not (_ITEM.match(lines[k]) or lines[k].startswith("  "))), len(lines))
            put(_list(lines[i:stop], node))
            i = stop
        else:
            stop = next((k for k in range(i, len(lines)) if not lines[k].strip() or re.match(r" {0,3}#{1,6}[ \t]|```", lines[k]) or _ITEM.match(lines[k])), len(lines))
            put(node("para", "\n".join(lines[i:stop]).strip()))
            i = stop
    return root


def _list(lines: Sequence[str], node) -> Node:
    top = node("list", "")
    levels: list[tuple[int, Node, list[Node]]] = [(len(_ITEM.match(lines[0])[1]), top, [])]
    for line in lines:
        m = _ITEM.match(line)
        if not m:
            levels[-1][2][-1].children[0].content += "\n" + line.strip()
            continue
        indent = len(m[1])
        while len(levels) > 1 and indent < levels[-1][0]:
            levels.pop()
        if indent > levels[-1][0] and levels[-1][2]:
            inner = node("list", "")
            levels[-1][2][-1].add(inner)
            levels.append((indent, inner, []))
        k = len(levels[-1][2]) + 1
        marker = m[2] if m[2] in "-+*" else f"{k}{m[2][-1]}"
        item = node("list", marker, "text/markdown")
        item.add(node("inline", m[3].strip()))
        levels[-1][1].add(item)
        levels[-1][2].append(item)
    return top
