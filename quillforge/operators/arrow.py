"""Arrow batches to Python rows and back: for what has no Spark expression."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Row = dict


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)


def flat_map(df: DataFrame, fn: Callable[[Row], Iterable[Row]], schema: str, rows_at_once: int = 2000) -> DataFrame:
    """Rows of ``schema`` from each row of df, batch by batch, without a shuffle."""
    target = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_at_once):
                out = [r for row in batch.slice(lo, rows_at_once).to_pylist() for r in fn(row)]
                yield pa.RecordBatch.from_pylist(out, schema=target)

    return df.mapInArrow(run, schema)


def per_group(df: DataFrame, keys: list[str], fn: Callable[[list[Row]], Iterable[Row]], schema: str) -> DataFrame:
    """Rows of ``schema`` from all rows of a group, a document as a rule, in no certain order. Groups are gathered by Spark and go to Python many at a time, as small ones cost more apart."""
    rows = df.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("__rows"))
    return flat_map(rows.select("__rows"), lambda r: fn(r["__rows"]), schema)
