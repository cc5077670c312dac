"""Files to root rows: listing, media types, ids and the order in which parsers are tried."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OOXML = "application/vnd.openxmlformats-officedocument."
UNKNOWN = "application/octet-stream"
DIRECTORY = "inode/directory"
#: File ends to media types.
BY_EXTENSION = {
    ".txt": "text/plain", ".text": "text/plain", ".log": "text/plain", ".html": "text/html", ".htm": "text/html", ".md": "text/markdown", ".markdown": "text/markdown", ".rst": "text/x-rst", ".org": "text/org",
    ".tex": "text/x-tex", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".tif": "image/tiff", ".tiff": "image/tiff", ".pdf": "application/pdf", ".docx": OOXML + "wordprocessingml.document",
    ".pptx": OOXML + "presentationml.presentation", ".xlsx": OOXML + "spreadsheetml.sheet", ".rtf": "application/rtf", ".odt": "application/vnd.oasis.opendocument.text", ".csv": "text/csv", ".json": "application/json",
    ".toml": "application/toml", ".yaml": "application/yaml", ".yml": "application/yaml", ".wav": "audio/wav", ".mp3": "audio/mpeg", ".mp4": "video/mp4", ".epub": "application/epub+zip", ".ipynb": "application/x-ipynb+json",
}
#: First bytes to media types, where the file's end says nothing.
MAGIC = [(b"%PDF-", "application/pdf"), (b"\x89PNG", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"{\\rtf", "application/rtf"), (b"ID3", "audio/mpeg"), (b"RIFF", "audio/wav"), (b"<!DOCTYPE html", "text/html"), (b"<html", "text/html")]


def is_hidden(path: Column) -> Column:
    """Has the path, relative to what was asked for, a part that begins with a dot?"""
    return F.exists(F.split(path, "/"), lambda p: F.startswith(p, F.lit(".")) & ~p.isin(".", ".."))


def mime_column(path: Column, content: Column | None = None) -> Column:
    """The media type by the end of the name, else by the first bytes, else unknown."""
    end = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.try_element_at(F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv]), end)
    if content is not None:
        magic = None
        for head, mime in MAGIC:
            hit = F.startswith(content, F.lit(bytearray(head)))
            magic = F.when(hit, mime) if magic is None else magic.when(hit, mime)
        out = F.coalesce(out, magic)
    return F.coalesce(out, F.lit(UNKNOWN))


def _unlisted(name: str) -> bool:
    """Does Spark's listing leave out files and folders of this name?"""
    return (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")) and not name.startswith(("_metadata", "_common_metadata"))


def _unlisted_files(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, modificationTime, length, content) of the files below ``path`` that Spark's listing leaves out; the executors read them."""
    from datetime import UTC, datetime

    from pyarrow import fs

    from ..operators.arrow import flat_map

    scheme = path.split(":", 1)[0] if ":" in path else "file"
    system, base = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    if system.get_file_info(base).type != fs.FileType.Directory:
        return None
    rows = []
    for info in system.get_file_info(fs.FileSelector(base, recursive=True)):
        below = info.path[len(base.rstrip("/")) + 1 :]
        if info.type == fs.FileType.File and any(map(_unlisted, below.split("/"))):
            rows.append((f"{scheme}:{info.path}" if scheme == "file" else f"{scheme}://{info.path}", info.path, info.mtime or datetime.fromtimestamp(0, UTC), info.size))
    if not rows:
        return None
    where = path if "://" in path else "file://" + path.removeprefix("file:")

    def read(row: dict):
        system, _ = fs.FileSystem.from_uri(where)
        with system.open_input_stream(row["at"]) as f:
            yield {"path": row["path"], "modificationTime": row["modificationTime"], "length": row["length"], "content": f.read()}

    listed = spark.createDataFrame(rows, "path string, at string, modificationTime timestamp, length bigint")
    return flat_map(listed, read, "path string, modificationTime timestamp, length bigint, content binary", 16)


def scan(spark: SparkSession, path: str, skip_hidden: bool = True) -> DataFrame:
    """(doc_id, path, mimetype, content, origin) of every file below ``path``: doc_id is the hash of the bytes, so equal files share it; origin tells them apart. Spark lists and reads the files; those that its
    listing leaves out (names that begin with _, and hidden ones where ``skip_hidden`` is off) are listed apart and read by the executors. Content is read only where a query asks for it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(path)
    more = _unlisted_files(spark, path)
    if more is not None:
        files = files.unionByName(more)
    base = F.lit(path.rstrip("/").split(":", 1)[-1].lstrip("/"))
    relative = F.regexp_replace(F.col("path"), F.concat(F.lit("^.*?\\Q"), base, F.lit("\\E/?")), "")
    kept = files.where(~is_hidden(relative)) if skip_hidden else files
    return kept.select(
        F.sha2("content", 256).alias("doc_id"), "path", mime_column(F.col("path"), F.col("content")).alias("mimetype"), "content",
        F.struct(F.col("path").alias("location"), F.lit("file").alias("protocol"), F.to_json(F.struct("length", "modificationTime")).alias("metadata")).alias("origin"),
    )


def directory_edges(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, parent, name, depth): files and all folders above them as a tree; .git folders are left out."""
    kept = paths.where(~F.col(path_col).rlike(r"(^|/)\.git(/|$)")).select(F.split(path_col, "/").alias("parts"))
    up = kept.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.slice("parts", 1, k))).alias("p")).where("element_at(p, -1) <> ''").distinct()
    return up.select(F.array_join("p", "/").alias("path"), F.when(F.size("p") > 1, F.array_join(F.slice("p", 1, F.size("p") - 1), "/")).alias("parent"), F.element_at("p", -1).alias("name"), F.size("p").cast("bigint").alias("depth"))


def decode_text(content: Column) -> Column:
    """UTF-8 with replacement signs for what isn't, line ends as \\n."""
    return F.regexp_replace(F.call_function("make_valid_utf8", content.cast("string")), "\r\n?", "\n")


Parser = Callable[[bytes, str], object]


class ParserRegistry:
    """Parsers by media type, each a function of (bytes, path) that returns a root Node. The order of trial: callbacks and then extras of ``temporary``, the outer one's first, registered callbacks,
    registered extras, and the built-in ones."""

    def __init__(self, builtin: dict[str, list[Parser]] | None = None):
        from . import formats

        self.builtin = formats.BUILTIN if builtin is None else builtin
        self.extras: dict[str, list[Parser]] = {}
        self.callbacks: list[Callable[[str, str], Parser | None]] = []
        self.passing: list[tuple[dict[str, list[Parser]], list[Callable[[str, str], Parser | None]]]] = []

    def register(self, extras: dict[str, list[Parser]] | None = None, callbacks: list[Callable[[str, str], Parser | None]] | None = None) -> None:
        for mime, parsers in (extras or {}).items():
            self.extras.setdefault(mime, []).extend(parsers)
        self.callbacks += callbacks or []

    @contextmanager
    def temporary(self, extras: dict[str, list[Parser]] | None = None, callbacks: list[Callable[[str, str], Parser | None]] | None = None) -> Iterator[ParserRegistry]:
        """Registered for a while, ahead of the others; undone also where the body raises."""
        held = self.passing
        self.passing = [*held, (extras or {}, callbacks or [])]
        try:
            yield self
        finally:
            self.passing = held

    def resolve(self, path: str, mime: str, strict: bool = False) -> list[Parser]:
        asked = lambda callbacks: [p for c in callbacks if (p := c(path, mime))]
        found = [p for _, callbacks in self.passing for p in asked(callbacks)] + [p for extras, _ in self.passing for p in extras.get(mime, [])]
        found += asked(self.callbacks) + self.extras.get(mime, []) + self.builtin.get(mime, [])
        if not found and strict:
            raise ValueError(f"no parser for {mime}")
        return found


def parse_files(files: DataFrame, registry: ParserRegistry | None = None, rows_at_once: int = 64) -> DataFrame:
    """Node rows (tree.NODE, with ``path`` and ``error``) of scanned files: parsers are tried in order, each on a fresh root; where all fail or there is none, the root stands alone and ``error`` says why."""
    from ..operators.arrow import flat_map
    from .formats import node_rows, root_node

    reg = registry or ParserRegistry()

    def one(row: dict):
        errors = []
        for parser in reg.resolve(row["path"], row["mimetype"]):
            try:
                root = parser(row["content"] or b"", row["path"])
                root.id = row["doc_id"]
                yield from node_rows(root, row["doc_id"], row["path"], None)
                return
            except Exception as e:  # the next parser is tried; the error is kept in the row
                errors.append(f"{type(e).__name__}: {e}")
        root = root_node(row["doc_id"], row["mimetype"])
        yield from node_rows(root, row["doc_id"], row["path"], "; ".join(errors) or "no parser")

    schema = "doc_id string, location string, chunk_id string, parent_id string, ord int, path array<int>, ctype string, mimetype string, content string, content_bytes binary, text string, metadata string, error string"
    return flat_map(files.select("doc_id", "path", "mimetype", "content"), one, schema, rows_at_once)
