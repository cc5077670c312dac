"""Files that arrive, parsed once: a stream over a folder; what was seen is known by the hash of its bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import ParserRegistry, mime_column, parse_files

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """New files of a folder as a stream, each content once a batch and once in all batches as long as the state is kept."""
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(path)
    return raw.select(F.sha2("content", 256).alias("doc_id"), "path", mime_column(F.col("path"), F.col("content")).alias("mimetype"), "content").dropDuplicates(["doc_id"])


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str, registry: ParserRegistry | None = None, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Parse what arrives and append node rows to ``target`` (Parquet), a folder for each batch, so a batch that is done again overwrites its own rows; ends when all files are done."""

    def write(batch: DataFrame, number: int) -> None:
        nodes = parse_files(batch, registry)
        nodes.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if on_batch:
            on_batch(nodes, number)

    return file_stream(spark, path).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
