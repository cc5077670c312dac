"""Tables of contents: nodes below the header before them, headers below the one before with a smaller level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_by_header(nodes: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, parent_id, ord): the leaves of each document, headers and what stands before any header below the root (NULL), others below the last header before them; root, div and page go.
    What comes before the first header is first."""
    kept = nodes.where(~F.col("ctype").isin("root", "div", "page"))
    before = Window.partitionBy("doc_id").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("ctype") == "header", F.col("chunk_id")), True).over(before)
    placed = kept.select("doc_id", "chunk_id", "path", F.when(F.col("ctype") == "header", F.lit(None)).otherwise(header).alias("parent_id"))
    place = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("path")) - 1
    return placed.select("doc_id", "chunk_id", "parent_id", place.cast("bigint").alias("ord"))


def level_parents(rows: DataFrame, group: str, order: str, level: str, most: int = 6, id_col: str | None = None) -> DataFrame:
    """rows with ``parent``: the nearest earlier row of the group with a smaller level, by ``id_col`` or the order itself. One window for each level: no self-join."""
    ids = F.col(id_col or order)
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at: list[Column] = [F.last(F.when(F.col(level) == k, F.struct(F.col(order).alias("o"), ids.alias("i"))), True).over(before) for k in range(1, most)]
    seen = rows.withColumns({f"__l{k}": c for k, c in enumerate(at, 1)})
    best = F.array_max(F.filter(F.array(*[F.when(F.col(level) > k, F.col(f"__l{k}")) for k in range(1, most)]), lambda x: x.isNotNull()))
    return seen.withColumn("parent", best["i"]).drop(*[f"__l{k}" for k in range(1, most)])


def format_toc(headers: DataFrame, group: str, order: str, level: str, title: str) -> DataFrame:
    """(group, toc): a line of # and title for each header with a level, in order."""
    line = F.concat(F.repeat(F.lit("#"), F.col(level).cast("int")), F.lit(" "), F.col(title))
    cells = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return headers.where(F.col(level).isNotNull()).groupBy(group).agg(F.array_join(F.transform(cells, lambda x: x["line"]), "\n").alias("toc"))


def parse_levels(answer: Column) -> Column:
    """Of a model's answer, lines of # signs and ID `n`: array of (id, level)."""
    lines = F.filter(F.split(answer, "\n"), lambda x: x.rlike("ID `[0-9]+`"))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "ID `([0-9]+)`", 1).cast("int").alias("id"), F.regexp_count(x, F.lit("#")).cast("int").alias("level")))
