"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TASK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(df: DataFrame, key: str, of: DataFrame | None = None) -> DataFrame:
    """df, or with ``of`` as many tasks as that table asks for, shuffled by a key: a task for each ``TASK_BYTES`` of the files at least, so what a task holds doesn't grow with the table."""
    spark = df.sparkSession
    n = int(str((of or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // TASK_BYTES
    return df.repartition(n, key) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)
