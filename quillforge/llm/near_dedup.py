"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

Each document's word shingles are hashed once and fall into ``BINS`` bins by their high bits; a bin keeps its least hash.
An empty bin copies the bin that a 2-universal hash of (bin, attempt) names, at the first attempt that meets a filled one
(optimal densification). Texts with the same words in order are one node, so copies never meet in a bucket. Bands of rows key buckets; a bucket of n
nodes gives n - 1 edges, from its least node. Edges are verified by the share of equal bins and form components. A bucket that still holds nodes of several components is looked at again: in blocks of
about ``BLOCK`` nodes, each two blocks in a task of their own, nodes of different components are compared, and one edge ties those that match. So no link is lost: the groups are those of all pairs
that share a bucket and match. This second look is quadratic in the texts of one bucket that differ too much from each other; no bucket is capped. The row with the least id of a component stays.

No task holds a bucket, a group of copies or a hub: counts and minima are partial aggregates that are joined back, and a block is bounded.

Defined results: NULL or empty texts, and texts without a word, are nobody's copy; rows without an id are dropped by
``duplicates`` and stay in ``drop_duplicates``; rows that repeat an id are judged each by its own text: a row goes where another id is its component's least, so
a document may lose one text and keep another; rows that are equal stay or go alike; extra columns are ignored, and kept by ``drop_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import arrow_map, id_text, materialize, unused

SHINGLE = 3
BINS = 128
ROWS = 4
THRESHOLD = 0.5
BLOCK = 4096


def _densify_plan(bins: int) -> np.ndarray:
    """donors[a, b]: the bin that empty bin b asks at attempt a."""
    rng = np.random.default_rng(20170814)
    return rng.integers(0, bins, size=(64 * 8, bins))


def signatures(h: np.ndarray, first: np.ndarray, bins: int = BINS) -> np.ndarray:
    """uint32 signatures (texts x bins) of the shingle hashes of each text; all ones where a text has none."""
    n = len(first) - 1
    empty = np.uint32(0xFFFFFFFF)
    sig = np.full(n * bins, empty, np.uint32)
    doc = np.repeat(np.arange(n), np.diff(first))
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    slot = doc * bins + (h >> shift).astype(np.int64)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    np.minimum(low, np.uint32(0xFFFFFFFE), out=low)
    np.minimum.at(sig, slot, low)
    sig = sig.reshape(n, bins)
    filled = sig != empty
    todo = np.flatnonzero(filled.any(1) & ~filled.all(1))
    plan = _densify_plan(bins)
    if len(todo):
        r, b = np.nonzero(~filled[todo])
        r = todo[r]
        for attempt in range(len(plan)):
            donor = plan[attempt][b]
            ok = filled[r, donor]
            sig[r[ok], b[ok]] = sig[r[ok], donor[ok]]
            r, b = r[~ok], b[~ok]
            if not len(r):
                break
        else:  # beyond all attempts: the next filled bin
            for i, j in zip(r, b, strict=True):
                f = np.flatnonzero(filled[i])
                sig[i, j] = sig[i, f[np.searchsorted(f, j) % len(f)]]
    return sig


def signature_table(docs: DataFrame, shingle: int = SHINGLE, bins: int = BINS) -> DataFrame:
    """(doc_id, text_hash, whole, sig): hashes of the text and of all its words in order, and the packed signature, of each row with a word."""

    def run(batch: pa.RecordBatch):
        for lo, hi, data, offs in tk.slices(batch.column("text")):
            tok = tk.tokenize(data, offs)
            h, first = tk.shingles(tok, shingle)
            sig = signatures(h, first, bins)
            place = np.arange(len(tok.hash), dtype=np.uint64) - tok.first[tok.doc].astype(np.uint64)
            acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(tok.hash + place * tk.MULT))])
            whole = tk.mix(acc[tok.first[1:]] - acc[tok.first[:-1]])
            some = np.flatnonzero(np.diff(tok.first) > 0)
            packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.arange(len(some) + 1) * bins * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sig[some]))])
            yield {"doc_id": batch.column("doc_id").slice(lo, hi - lo).take(pa.array(some)), "text_hash": batch.column("text_hash").slice(lo, hi - lo).take(pa.array(some)), "whole": whole[some].view(np.int64), "sig": packed}

    return arrow_map(id_text(docs).withColumn("text_hash", F.xxhash64("text")), run, "doc_id bigint, text_hash bigint, whole bigint, sig binary")


def _unpack(col, bins: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros((0, bins), np.uint32)
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.uint32).reshape(len(col), bins)


def band_table(sigs: DataFrame, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """(bucket, node): one row for each band of each node."""
    bands = bins // rows

    def run(batch: pa.RecordBatch):
        sig = _unpack(batch.column("sig"), bins).astype(np.uint64).reshape(-1, bands, rows)
        h = np.broadcast_to(np.arange(bands, dtype=np.uint64) * tk.MULT, sig.shape[:2]).copy()
        for r in range(rows):
            h = tk.mix(h + sig[:, :, r])
        yield {"bucket": h.ravel().view(np.int64), "node": np.repeat(np.asarray(batch.column("node")), bands)}

    return arrow_map(sigs.select("node", "sig"), run, "bucket bigint, node bigint")


def _verify(edges: DataFrame, sigs: DataFrame, bins: int, threshold: float) -> DataFrame:
    """edges (a, b) with the share of equal bins, where that reaches the threshold."""
    left = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))

    def run(batch: pa.RecordBatch):
        share = (_unpack(batch.column("sig_a"), bins) == _unpack(batch.column("sig_b"), bins)).mean(1)
        ok = pa.array(np.flatnonzero(share >= threshold))
        yield {"a": batch.column("a").take(ok), "b": batch.column("b").take(ok), "similarity": pa.array(share).take(ok)}

    return arrow_map(edges.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b"), run, "a bigint, b bigint, similarity double")


def link(ids: np.ndarray, label: np.ndarray, sig: np.ndarray, threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that tie together all groups (equal labels) with members that match: each node is compared with the nodes of other groups, which become one with its own where they match. With
    ``side``, only nodes of different sides are compared."""
    label, a, b = label.copy(), [], []
    for i in range(len(ids)):
        other = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if side is not None:
            other = other[side[other] != side[i]]
        if not len(other):
            continue
        ok = other[(sig[other] == sig[i]).mean(1) >= threshold]
        met, at = np.unique(label[ok], return_index=True)
        a += [ids[i]] * len(met)
        b += ids[ok[at]].tolist()
        label[np.isin(label, met)] = label[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def match_rest(members: DataFrame, sigs: DataFrame, bins: int = BINS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that tie together the groups with matching nodes in each bucket of members (bucket, node, label). Every block of a bucket meets every block of it, each two in a task of their own."""
    per = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("y"), F.min("label").alias("l"), F.max("label").alias("m"))
    per = per.where("l <> m").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / block).alias("m"))  # of buckets with the same members one is enough
    parts = members.join(per, "bucket").withColumn("k", F.pmod(F.xxhash64("node", F.lit(7)), "m")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    parts = parts.select("bucket", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "node", "label").join(sigs.select("node", "sig"), "node")

    def run(group: pa.Table) -> pa.Table:
        ids, label, k = (np.asarray(group.column(c).combine_chunks()) for c in ("node", "label", "k"))
        side = None if group.column("i")[0] == group.column("j")[0] else k
        a, b = link(ids, label, _unpack(group.column("sig"), bins), threshold, side)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return parts.groupBy("bucket", "i", "j").applyInArrow(run, "a bigint, b bigint")


def node_groups(sigs: DataFrame, bins: int = BINS, rows: int = ROWS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(node, root): the components of all pairs of sigs (node, sig) that share a bucket and match; nodes without a match are left out."""
    bands = band_table(sigs, bins, rows)
    centres = bands.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z")
    stars = materialize(bands.join(centres, "bucket").where("a <> node").withColumnRenamed("node", "b"), "stars")
    pairs = stars.select("a", "b").distinct()
    good = materialize(_verify(pairs, sigs, bins, threshold).select("a", "b"), "star_edges")
    comp = materialize(components(good), "groups")
    root = lambda c: comp.select(F.col("node").alias(c), F.col("root").alias("root_" + c))
    label = lambda c: F.coalesce("root_" + c, c)
    # pairs of a centre and a node that don't match are open where nothing else ties them
    free = pairs.join(good, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left").where(label("a") != label("b")).select("a", "b")
    buckets = stars.join(free, ["a", "b"], "left_semi").select("bucket").distinct()
    open_stars = stars.join(buckets, "bucket", "left_semi")
    members = open_stars.select("bucket", F.col("b").alias("node")).unionByName(open_stars.select("bucket", F.col("a").alias("node")).distinct())
    members = materialize(members.join(comp, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("label")), "open")
    more = materialize(match_rest(members, sigs, bins, threshold, block), "ties")
    if more.isEmpty():
        return comp
    # only the groups that are tied change: their roots, and nodes that were single, form components of their own; neither stand in comp as nodes
    ends = more.join(root("a"), "a", "left").join(root("b"), "b", "left").select(label("a").alias("a"), label("b").alias("b"))
    new = materialize(components(ends), "tied_roots")
    moved = comp.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(new)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of edges (a, b); rounds of large-star and small-star, each cut by a written
    table, until nothing changes. The least neighbour of a hub comes from a partial aggregate that is joined back."""
    e = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "cc")
    least = lambda x: x.join(x.groupBy("u").agg(F.min("v").alias("m")), "u")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = materialize(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), "cc")
        small = least(low)
        e = materialize(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def copies(docs: DataFrame, shingle: int = SHINGLE, bins: int = BINS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, kept_doc_id): the rows that go, each with the least id of its component."""
    own = materialize(signature_table(docs, shingle, bins), "signatures")
    texts = materialize(own.groupBy(F.col("whole").alias("node")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("sig").alias("sig")), "texts")
    comp = materialize(node_groups(texts.select("node", "sig"), bins, rows, threshold), "components")
    tied = materialize(texts.select("node", "first", "last").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node")), "tied")
    near = tied.join(comp.select("root").distinct(), "root", "left_semi")
    kept = near.join(near.groupBy("root").agg(F.min("first").alias("kept_doc_id")), "root").select("node", "last", "first", "kept_doc_id")
    alone = tied.where("first < last").join(comp.select("root").distinct(), "root", "left_anti").select("node", "last", "first", F.col("first").alias("kept_doc_id"))
    some = kept.unionByName(alone).where("last > kept_doc_id").select(F.col("node").alias("whole"), "kept_doc_id")
    return own.select("doc_id", "text_hash", "whole").join(some, "whole").where("doc_id <> kept_doc_id").select("doc_id", "text_hash", "kept_doc_id")


def duplicates(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, kept_doc_id): each document with a text that goes, and the one of its group that stays."""
    return copies(docs, **kw).select("doc_id", "kept_doc_id").distinct()


def drop_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """docs without the rows that ``copies`` names; all columns stay as they were."""
    i, h = unused(docs, "id", "hash")
    gone = copies(docs, **kw).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone[i]) & (F.xxhash64(docs["text"].cast("string")) == gone[h]), "left_anti")
