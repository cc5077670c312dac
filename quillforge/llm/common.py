"""What the operators share: scratch tables, column selection and Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors reach; where it is unset (tests on one machine), a temporary one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str = "t", drop: bool = False) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read it: lineage is cut and the work is never repeated. With ``drop``, its shuffle files go as soon as it is written; the collection
    of garbage that ``release`` starts finds them one step too late."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillforge/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true" if drop else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Let the executors drop the shuffle files of steps that have been written, which Spark does only once the driver has collected its own garbage, and remove
    materialized tables that no later step reads."""
    for df in done:
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names, made from the given ones, that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := "_" + name) in taken:
            pass
        taken.add(name)
        out.append(name)
    return out


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under its own names; rows without an id are dropped."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")


def give_back() -> None:
    """Return this process's freed memory to the system: idle Python workers live on for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow, after each task of which the worker gives its freed memory back."""

    def task(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | None], schema: str) -> DataFrame:
    """mapInArrow where fn yields dicts of columns for each batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for cols in fn(batch):
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip((cols[f.name] for f in target), target, strict=True)]
                arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, target, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return map_batches(df, run, schema)


def list_array(values, first) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))
