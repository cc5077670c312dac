"""Chunks kept as Parquet: nodes in one table, binary content in another, so scans of nodes never touch it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ChunkStore:
    """A folder with ``nodes``, ``blobs`` and ``gone``, written in rounds; the newest round of an id counts, and what is deleted in a round is gone up to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame | None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        return self.spark.read.parquet(f"{self.path}/{name}") if there else None

    def save(self, nodes: DataFrame, round_no: int = 0) -> None:
        """Write nodes; ``content_bytes``, where there is such a column, goes to blobs."""
        if "content_bytes" in nodes.columns:
            self._append("blobs", nodes.where("content_bytes IS NOT NULL").select("chunk_id", "content_bytes", F.lit(round_no).alias("round")))
        self._append("nodes", nodes.drop("content_bytes").withColumn("round", F.lit(round_no)))

    def save_group(self, group: DataFrame, nodes: DataFrame, round_no: int = 0) -> None:
        """Write the nodes that are members of a group (root_id, group_ord, chunk_id), and those below them."""
        tops = nodes.join(group.select("chunk_id"), "chunk_id", "left_semi")
        self.save(nodes.join(_below(nodes, tops), "chunk_id", "left_semi"), round_no)

    def delete(self, ids: DataFrame, cascade: bool = False, round_no: int = 0) -> None:
        """Forget the nodes of ids (chunk_id) as they are up to this round, with ``cascade`` all below them too; a later round may save them again. Ids that aren't there are ignored."""
        kept = self.nodes()
        tops = kept.join(ids.select("chunk_id"), "chunk_id", "left_semi")
        self._append("gone", (_below(kept, tops) if cascade else tops.select("chunk_id")).withColumn("round", F.lit(round_no)))

    def _newest(self, raw: DataFrame) -> DataFrame:
        newest = raw.groupBy(F.col("chunk_id").alias("__id")).agg(F.max("round").alias("__r"))
        out = raw.join(newest, (F.col("chunk_id") == F.col("__id")) & (F.col("round") == F.col("__r"))).drop("__id", "__r")
        gone = self._read("gone")
        if gone is not None:
            last = gone.groupBy(F.col("chunk_id").alias("__id")).agg(F.max("round").alias("__r"))
            out = out.join(last, (F.col("chunk_id") == F.col("__id")) & (F.col("round") <= F.col("__r")), "left_anti")
        return out.drop("round")

    def nodes(self) -> DataFrame:
        raw = self._read("nodes")
        if raw is None:
            raise ValueError("nothing is saved in this store")
        return self._newest(raw)

    def get(self, chunk_id: str) -> DataFrame:
        return self.nodes().where(F.col("chunk_id") == chunk_id)

    def contains(self, chunk_id: str) -> bool:
        return not self.get(chunk_id).isEmpty()

    def content(self, nodes: DataFrame) -> DataFrame:
        """nodes with their binary content, that of the newest round."""
        blobs = self._read("blobs")
        if blobs is None:
            return nodes.withColumn("content_bytes", F.lit(None).cast("binary"))
        return nodes.join(self._newest(blobs).select("chunk_id", "content_bytes"), "chunk_id", "left")

    def without(self, ids: DataFrame, cascade: bool = False) -> DataFrame:
        """The nodes less those of ids (chunk_id), with ``cascade`` less all below them too; the store stays as it is."""
        kept = self.nodes()
        gone = ids.select("chunk_id")
        if cascade:
            gone = _below(kept, kept.join(gone, "chunk_id", "left_semi"))
        return kept.join(gone, "chunk_id", "left_anti")


class MemoryStore(ChunkStore):
    """A store of plans: what is saved is read from its own DataFrames again, for as long as the session lives."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, "")
        self.tables: dict[str, DataFrame] = {}

    def _append(self, name: str, df: DataFrame) -> None:
        old = self.tables.get(name)
        self.tables[name] = df if old is None else old.unionByName(df, allowMissingColumns=True)

    def _read(self, name: str) -> DataFrame | None:
        return self.tables.get(name)


def _below(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """(chunk_id): tops and all nodes below them, by their paths."""
    t = tops.select(F.col("doc_id").alias("__d"), F.col("path").alias("__p"))
    return nodes.join(t, (F.col("doc_id") == F.col("__d")) & (F.slice("path", 1, F.size("__p")) == F.col("__p"))).select("chunk_id").distinct()


def linked(nodes: DataFrame, link: str, store: ChunkStore | None) -> DataFrame:
    """(chunk_id, and the columns of the node that its column ``link`` names, with the prefix to_). Without a store links can't be followed, which raises."""
    if store is None:
        raise ValueError("links can only be followed with a store")
    to = store.nodes()
    to = to.select(*[F.col(c).alias("to_" + c) for c in to.columns])
    return nodes.select("chunk_id", F.col(link).alias("__l")).join(to, F.col("__l") == F.col("to_chunk_id"), "left").drop("__l")


def as_dicts(nodes: DataFrame) -> DataFrame:
    """(chunk_id, json): each node as JSON."""
    return nodes.select("chunk_id", F.to_json(F.struct(*[F.col(c) for c in nodes.columns if c != "content_bytes"])).alias("json"))


def page_contents(nodes: DataFrame) -> DataFrame:
    """(chunk_id, page_content, metadata): text nodes in the shape that retrieval libraries take; metadata is a map of strings."""
    meta = F.map_filter(F.create_map(*[x for c in ("doc_id", "parent_id", "ctype", "mimetype") for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
    return nodes.where("content IS NOT NULL").select("chunk_id", F.col("content").alias("page_content"), meta.alias("metadata"))


def text_nodes(nodes: DataFrame) -> DataFrame:
    """(id_, kind, text, image): text nodes and pictures (base64)."""
    image = F.col("mimetype").startswith("image/")
    return nodes.select(F.col("chunk_id").alias("id_"), F.when(image, "image").otherwise("text").alias("kind"), F.when(~image, F.col("content")).alias("text"), F.when(image, F.regexp_replace(F.base64("content_bytes"), "[\r\n]", "")).alias("image"))
