"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .splitting import MARKS

#: White space as Python sees it; the class (?U)\s lacks the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]"


def word_len(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != "")).cast("bigint")


def char_len(text: Column) -> Column:
    return F.length(text).cast("bigint")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACE + "+", " "))


def quote_regex(s: str) -> str:
    return r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"


def split_keep(text: Column, separator: str, keep: str | None) -> Column:
    """Pieces by a literal separator that stays at the ``start`` or ``end`` of a piece, or goes with None; '' gives characters."""
    q = quote_regex(separator)
    pattern = "" if separator == "" else {"start": f"(?={q})", "end": f"(?<={q})", None: q}[keep]
    return F.filter(F.split(text, pattern), lambda p: p != "")


def default_separators(text: Column, newlines_first: bool = False) -> Column:
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({SPACE}+)")))
    group = lambda r: F.when(F.lit(newlines_first) & ~r.rlike("^\n+$"), 1).otherwise(0)
    ordered = F.transform(F.array_sort(F.transform(runs, lambda r: F.struct(group(r).alias("g"), (-F.length(r)).alias("n"), r.alias("r")))), lambda x: x["r"])
    return F.concat(ordered, F.array(*map(F.lit, [*MARKS, ""])))


def fenced_json(text: Column) -> Column:
    """The body of the first fenced block, if it is JSON; else NULL."""
    body = F.regexp_extract(text, r"(?s)```[^\n]*\n(.*?)\n```", 1)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def preview(text: Column) -> Column:
    """Texts over 80 characters: the first 50, and how many words follow."""
    more = word_len(F.substring(text, 51, 1 << 30))
    return F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 50), F.lit("... ("), more, F.lit(" more words)"))).otherwise(text)


ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def roman(n: Column) -> Column:
    """Upper-case Roman numerals of positive integers."""
    values = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN])
    start = F.struct(n.cast("int").alias("left"), F.lit("").alias("text"))
    step = lambda a, x: F.struct((a["left"] % x["v"]).alias("left"), F.concat(a["text"], F.repeat(x["s"], F.floor(a["left"] / x["v"]).cast("int"))).alias("text"))
    return F.aggregate(values, start, step, lambda a: a["text"])


def alpha(n: Column) -> Column:
    """A, B .. Z, AA: numbers to the base of 26 without a zero."""
    start = F.struct(n.cast("int").alias("left"), F.lit("").alias("text"))
    letter = lambda k: F.char(F.lit(65) + k)
    step = lambda a, _: F.when(a["left"] <= 0, a).otherwise(F.struct(F.floor((a["left"] - 1) / 26).cast("int").alias("left"), F.concat(letter((a["left"] - 1) % 26), a["text"]).alias("text")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda a: a["text"])


def list_marker(n: Column, style: str, delimiter: str) -> Column:
    """Markers of ordered lists: style Decimal, LowerRoman, UpperRoman, LowerAlpha or UpperAlpha; delimiter Period, OneParen or TwoParens."""
    body = {"LowerRoman": F.lower(roman(n)), "UpperRoman": roman(n), "LowerAlpha": F.lower(alpha(n)), "UpperAlpha": alpha(n)}.get(style, n.cast("string"))
    left, right = {"OneParen": ("", ") "), "TwoParens": ("(", ") ")}.get(delimiter, ("", ". "))
    return F.concat(F.lit(left), body, F.lit(right))


def csv_field(value: Column) -> Column:
    """A field quoted where it holds a comma, a quote or a line end; backslashes are doubled."""
    s = F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.when(s.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_row(*values: Column) -> Column:
    return F.concat_ws(",", *map(csv_field, values))


def number_cell(value: Column) -> Column:
    """A number as text, without decimals where it is whole."""
    d = value.cast("double")
    return F.when(d.isNull(), F.lit("")).when(d == F.floor(d), F.floor(d).cast("bigint").cast("string")).otherwise(d.cast("string"))


def emphasis(text: Column, bold: Column, italic: Column) -> Column:
    """Markdown emphasis of a span; asterisks of the text are escaped; blank text stays as it is."""
    body = F.regexp_replace(text, r"\*", r"\\\\*")
    mark = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    return F.when(strip(text) == "", text).otherwise(F.concat(mark, body, mark))


def history_label(name: str, **params: object) -> Column:
    return F.lit(f"{name}({', '.join(f'{k}={v}' for k, v in params.items())})")
