from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from quillforge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    cell = lambda v: "~" if v is None or v is pd.NA or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    df = df[sorted(df.columns)].map(cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_duckdb(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    assert len(got.columns) and not got.columns.duplicated().any()
    if name in catalogue.ORACLES:
        pd.testing.assert_frame_equal(plain(got), plain(duck.execute(catalogue.ORACLES[name]).df()), check_dtype=False)


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_html_blocks_with_other_references(spark, duck, tmp_path):
    """References that the SQL doesn't read, and those cut off in the middle, stay as they are written."""
    heads = ["a &amp;&amp", "b &quot;c&quot; &#38; &copy;", "d &lt;e&gt; &ampf; &amp;lt; g&nbsp;h", "&", "&amp;quot; &notin; &eacute &amp"]
    rows = [(k, f"u{k}", f'<html><body><ul><li><a href="/?a=1&copy=2">{h}</a></li></ul><h1>{h}</h1><p>x &quot;</p></body></html>') for k, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.QUERIES["html_blocks"](spark, str(tmp_path)).toPandas()
    want = duckdb.connect().execute(catalogue.ORACLES["html_blocks"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).df()
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)
