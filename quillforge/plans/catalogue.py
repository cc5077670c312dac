"""All registered queries of the document engine, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import layout_plans, text_plans, tree_plans

PLANS = [text_plans, tree_plans, layout_plans]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in PLANS for k, f in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for p in PLANS for k, s in p.ORACLES.items()}
