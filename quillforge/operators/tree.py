"""Chunk trees as node tables, and their algebra in Spark's own operators.

A node table has ``doc_id, chunk_id, parent_id, ord, path, ctype, mimetype, content, text, metadata``; ``path`` is the array of places from
the root (Dewey), so ordering by (doc_id, path) is preorder. Links to neighbours are derived, never stored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import with_checkpoints

NODE = "doc_id string, chunk_id string, parent_id string, ord int, path array<int>, ctype string, mimetype string, content string, text string, metadata string"
CTYPES = ("inline", "para", "formula", "list", "table", "tablerow", "header", "figure", "code", "div", "page", "root")

def _siblings() -> WindowSpec:
    return Window.partitionBy("doc_id", "parent_id").orderBy("ord", "chunk_id")


def chunk_id(doc_id: Column, path: Column) -> Column:
    """An id that a retried task makes again."""
    return F.sha2(F.concat(doc_id.cast("string"), F.lit("/"), F.array_join(path.cast("array<string>"), ".")), 256)


def depth(path: Column) -> Column:
    return (F.size(path) - 1).cast("bigint")


def with_paths(nodes: DataFrame) -> DataFrame:
    """``path`` of nodes that have only parent_id and ord: level by level from the roots, each level written to the checkpoint folder. Nodes that no root leads to are dropped."""
    plain = nodes.drop("path")
    numbered = plain.withColumn("__n", F.row_number().over(_siblings()) - 1)
    level = numbered.where("parent_id IS NULL").withColumn("path", F.array(F.col("__n").cast("int")))
    out = level
    rest = numbered.where("parent_id IS NOT NULL")
    with_checkpoints(nodes.sparkSession)
    while True:
        up = level.select(F.col("doc_id").alias("__d"), F.col("chunk_id").alias("__p"), F.col("path").alias("__path"))
        level = rest.join(up, (F.col("doc_id") == F.col("__d")) & (F.col("parent_id") == F.col("__p"))).withColumn("path", F.concat("__path", F.array(F.col("__n").cast("int")))).drop("__d", "__p", "__path").checkpoint()
        if level.isEmpty():
            return out.drop("__n")
        out = out.unionByName(level)


def walk(nodes: DataFrame) -> DataFrame:
    """Preorder: every node with its depth and its number in its document's walk."""
    order = Window.partitionBy("doc_id").orderBy("path")
    return nodes.withColumn("depth", depth(F.col("path"))).withColumn("step", F.row_number().over(order).cast("bigint"))


def walk_from(nodes: DataFrame, starts: DataFrame, include_siblings: bool = True) -> DataFrame:
    """Preorder from given (doc_id, start path): the subtree and, with ``include_siblings``, those of the start's later siblings."""
    s = starts.select(F.col("doc_id").alias("__d"), F.col("path").alias("__s"))
    k = F.size("__s")
    same = F.slice("path", 1, k) == F.col("__s")
    if include_siblings:
        later = (F.slice("path", 1, k - 1) == F.slice("__s", 1, k - 1)) & (F.get("path", k - 1) >= F.get("__s", k - 1))
        same = F.when(k > 0, later)
    return nodes.join(s, F.col("doc_id") == F.col("__d")).where((F.size("path") >= k) & same).withColumn("depth", (F.size("path") - k).cast("bigint")).drop("__d", "__s")


def with_links(nodes: DataFrame) -> DataFrame:
    """next_id, prev_id, child_id: the neighbours and the first child."""
    near = nodes.withColumn("next_id", F.lead("chunk_id").over(_siblings())).withColumn("prev_id", F.lag("chunk_id").over(_siblings()))
    first = nodes.where("parent_id IS NOT NULL").groupBy(F.col("doc_id").alias("__d"), F.col("parent_id").alias("__p")).agg(F.min_by("chunk_id", F.struct("ord", "chunk_id")).alias("child_id"))
    return near.join(first, (F.col("doc_id") == F.col("__d")) & (F.col("chunk_id") == F.col("__p")), "left").drop("__d", "__p")


def nav(nodes: DataFrame, next: int = 0, prev: int = 0, parent: int = 0, child: int = 0) -> DataFrame:
    """(doc_id, chunk_id, target_id): the node so many steps away; the first positive argument counts, NULL where there is none."""
    own = nodes.select("doc_id", "chunk_id", "parent_id", "ord", "path")
    if next > 0 or prev > 0:
        target = F.lead("chunk_id", next).over(_siblings()) if next > 0 else F.lag("chunk_id", prev).over(_siblings())
        return own.select("doc_id", "chunk_id", target.alias("target_id"))
    if parent <= 0 and child <= 0:
        return own.select("doc_id", "chunk_id", F.lit(None).cast("string").alias("target_id"))
    want = F.when(F.size("path") > parent, F.slice("path", 1, F.size("path") - parent)) if parent > 0 else F.concat("path", F.array_repeat(F.lit(0), child))
    to = own.select(F.col("doc_id").alias("__d"), F.col("path").alias("__path"), F.col("chunk_id").alias("target_id"))
    left = own.withColumn("__want", want)
    return left.join(to, (F.col("doc_id") == F.col("__d")) & (F.col("__want") == F.col("__path")), "left").select("doc_id", "chunk_id", "target_id")


def ends(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent_id, first_id, last_id, n): the outer siblings below each parent."""
    at = F.struct("ord", "chunk_id")
    return nodes.groupBy("doc_id", "parent_id").agg(F.min_by("chunk_id", at).alias("first_id"), F.max_by("chunk_id", at).alias("last_id"), F.count("*").alias("n"))


def find_all(nodes: DataFrame, ctype: str | None = None) -> DataFrame:
    """The nodes of a type in preorder; none for None."""
    return nodes.where(F.col("ctype") == ctype if ctype is not None else F.lit(False)).withColumn("step", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")).cast("bigint"))


def find_with_siblings(nodes: DataFrame, ctype: str) -> DataFrame:
    """The nodes of a type and all that have the same parent as one of them, in preorder."""
    up = nodes.where(F.col("ctype") == ctype).select(F.col("doc_id").alias("__d"), F.col("parent_id").alias("__p")).distinct()
    hit = nodes.join(up, (F.col("doc_id") == F.col("__d")) & F.col("parent_id").eqNullSafe(F.col("__p")), "left_semi")
    return hit.withColumn("step", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")).cast("bigint"))


def find_first(nodes: DataFrame, id_prefix: str | None = None, ctype: str | None = None) -> DataFrame:
    """(doc_id, chunk_id): each document's first node whose id begins so, or that is of the type."""
    hit = F.lit(False)
    if id_prefix:
        hit = hit | F.startswith(F.col("chunk_id"), F.lit(id_prefix))
    if ctype:
        hit = hit | (F.col("ctype") == ctype)
    return nodes.where(hit).groupBy("doc_id").agg(F.min_by("chunk_id", "path").alias("chunk_id"))


def outline(nodes: DataFrame, ctypes: list[str] | None = None) -> DataFrame:
    """(doc_id, path, line): an indented line for each node, of given types or all."""
    kept = nodes.where(F.col("ctype").isin(ctypes)) if ctypes else nodes
    return kept.select("doc_id", "path", F.concat(F.repeat(F.lit("    "), F.size("path") - 1), F.col("ctype"), F.lit(": "), F.coalesce(F.left("content", F.lit(30)), F.lit(""))).alias("line"))


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, n_nodes, n_chars, ids): of each node and all below it, ids in preorder. Every node counts once for each node above it, so the shuffle is nodes times depth."""
    up = nodes.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("__top"), "path", "chunk_id", F.length("content").alias("__len"))
    per = up.groupBy("doc_id", "__top").agg(
        F.count("*").alias("n_nodes"), F.coalesce(F.sum("__len"), F.lit(0)).cast("bigint").alias("n_chars"), F.transform(F.array_sort(F.collect_list(F.struct("path", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids")
    )
    own = nodes.select(F.col("doc_id").alias("__d"), F.col("path").alias("__p"), "chunk_id")
    return per.join(own, (F.col("doc_id") == F.col("__d")) & (F.col("__top") == F.col("__p"))).select("doc_id", "chunk_id", "n_nodes", "n_chars", "ids")


def add_children(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """children (doc_id, parent_id, ord, and the other columns) below their parents, after the children there. Those without a parent in the table are dropped."""
    last = nodes.where("parent_id IS NOT NULL").groupBy(F.col("doc_id").alias("__d"), F.col("parent_id").alias("__p")).agg(F.max("ord").alias("__last"))
    up = nodes.select(F.col("doc_id").alias("__d2"), F.col("chunk_id").alias("__p2"), F.col("path").alias("__path"))
    new = children.join(up, (F.col("doc_id") == F.col("__d2")) & (F.col("parent_id") == F.col("__p2"))).join(last, (F.col("doc_id") == F.col("__d")) & (F.col("parent_id") == F.col("__p")), "left")
    place = (F.coalesce("__last", F.lit(-1)) + F.row_number().over(_siblings())).cast("int")
    new = new.withColumn("ord", place).withColumn("path", F.concat("__path", F.array("ord"))).drop("__d", "__p", "__d2", "__p2", "__path", "__last")
    return nodes.unionByName(new, allowMissingColumns=True)


def merge_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two nodes a key made one: content and text are joined, metadata (maps) too with values of the same key joined, right's children moved behind left's is ``add_children``. Differing media types raise."""
    r = right.select(F.col(key).alias("__k"), *[F.col(c).alias("__" + c) for c in ("mimetype", "content", "text", "metadata")])
    both = left.join(r, F.col(key) == F.col("__k"))
    same = F.when(F.col("mimetype") == F.col("__mimetype"), F.col("mimetype")).otherwise(F.raise_error(F.lit("nodes of different media types can't be merged")))
    cat = lambda a, b: F.when(F.col(a).isNull() & F.col(b).isNull(), None).otherwise(F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    meta = F.map_zip_with(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.coalesce("__metadata", F.create_map().cast("map<string,string>")), lambda k, a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    keep = [c for c in left.columns if c not in ("mimetype", "content", "text", "metadata")]
    return both.select(*keep, same.alias("mimetype"), cat("content", "__content").alias("content"), cat("text", "__text").alias("text"), meta.alias("metadata"))


def add_group(group: DataFrame, other: DataFrame) -> DataFrame:
    """The members of two groups (root_id, group_ord, chunk_id): under each root the other's follow the group's own, numbered on; a root may be NULL."""
    both = group.select("root_id", F.lit(0).alias("__g"), "group_ord", "chunk_id").unionByName(other.select("root_id", F.lit(1).alias("__g"), "group_ord", "chunk_id"))
    place = F.row_number().over(Window.partitionBy("root_id").orderBy("__g", "group_ord")) - 1
    return both.select("root_id", place.cast("bigint").alias("group_ord"), "chunk_id")


def extend_group(group: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, ord) behind the members of a group with one root, or of an empty one, whose root is NULL. A group with several roots raises: say which with ``add_group``."""
    roots = group.select("root_id").distinct().limit(2).collect()
    if len(roots) > 1:
        raise ValueError("the group has several roots; use add_group")
    kind = dict(group.dtypes)["root_id"]
    return add_group(group, chunks.select(F.lit(roots[0][0] if roots else None).cast(kind).alias("root_id"), F.col("ord").alias("group_ord"), "chunk_id"))


def clone(nodes: DataFrame, tag: str, relations: bool = True, overrides: Mapping[str, Column] | None = None) -> DataFrame:
    """Copies with new ids made from the old ones and ``tag``; without ``relations`` they stand alone. Unknown columns raise."""
    unknown = set(overrides or {}) - set(nodes.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    new = lambda c: F.when(F.col(c).isNotNull(), F.sha2(F.concat(F.col(c), F.lit("#" + tag)), 256))
    out = nodes.withColumn("chunk_id", new("chunk_id")).withColumn("parent_id", new("parent_id") if relations else F.lit(None).cast("string"))
    if not relations and "path" in nodes.columns:
        out = out.withColumn("path", F.array(F.lit(0)))
    return out.withColumns(dict(overrides or {}))


def is_plain_text(mimetype: Column, content: Column, ctype: Column) -> Column:
    """Leaf text that chunkers take: plain text with content, no wrapper."""
    return (mimetype == "text/plain") & (F.coalesce(content, F.lit("")) != "") & ~ctype.isin("root", "div", "page")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """The table of conversations as trees of two levels: a root for each, its turns below; user turns are headers."""
    conv = F.col("conv_id").cast("string")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    turns = conversations.where("conv_id IS NOT NULL").withColumn("ord", rank.cast("int")).select(
        conv.alias("doc_id"), F.concat(conv, F.lit("/"), F.col("ord").cast("string")).alias("chunk_id"), conv.alias("parent_id"), "ord", F.array(F.lit(0), F.col("ord")).alias("path"),
        F.when(F.col("role") == "user", "header").otherwise("para").alias("ctype"), F.lit("text/plain").alias("mimetype"), F.col("text").alias("content"), F.lit(None).cast("string").alias("text"), F.to_json(F.struct("role")).alias("metadata"),
    )
    roots = conversations.where("conv_id IS NOT NULL").select("conv_id").distinct().select(
        conv.alias("doc_id"), conv.alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("ord"), F.array(F.lit(0)).alias("path"), F.lit("root").alias("ctype"), F.lit("text/plain").alias("mimetype"),
        F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("metadata"),
    )
    return roots.unionByName(turns)


def market_nodes(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """Regions, nations and customers as trees of three levels."""
    null = F.lit(None).cast("string")
    doc = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    rest = [F.lit("text/plain").alias("mimetype"), F.col("content"), null.alias("text"), null.alias("metadata")]
    r = region.select(doc.alias("doc_id"), doc.alias("chunk_id"), null.alias("parent_id"), F.lit(0).alias("ord"), F.array(F.lit(0)).alias("path"), F.lit("header").alias("ctype"), F.col("r_name").alias("content")).select("doc_id", "chunk_id", "parent_id", "ord", "path", "ctype", *rest)
    up = F.broadcast(region.select("r_regionkey"))  # both are dimensions of fixed size
    n = nation.join(up, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("ord", (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).cast("int"))
    n = n.select("n_nationkey", doc.alias("doc_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("chunk_id"), doc.alias("parent_id"), "ord", F.array(F.lit(0), F.col("ord")).alias("path"), F.lit("header").alias("ctype"), F.col("n_name").alias("content"))
    c = customer.join(F.broadcast(n.select("n_nationkey", "doc_id", F.col("chunk_id").alias("parent_id"), F.col("path").alias("up"))), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumn("ord", (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("int"))
    c = c.select("doc_id", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("chunk_id"), "parent_id", "ord", F.concat("up", F.array("ord")).alias("path"), F.lit("para").alias("ctype"), F.col("c_name").alias("content"))
    keep = ["doc_id", "chunk_id", "parent_id", "ord", "path", "ctype"]
    return r.unionByName(n.select(*keep, *rest)).unionByName(c.select(*keep, *rest))
