"""Session helpers: shipping the package to the executors' Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch, instead of Spark's own 64 MiB: what an executor and its Python workers hold of a table at once.
BATCH_BYTES = 4 << 20
_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
_BATCH, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def _packed() -> bytes:
    root = Path(__file__).resolve().parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: they needn't have it installed. The archive lies in the folder that spark.checkpoint.dir
    names; where that is unset, as in tests on one machine, in a temporary one. Arrow batches become smaller unless the session sets their bytes."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, "64m") in ("64m", f"{_DEFAULT_BATCH}b"):
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    if sc.applicationId in _shipped:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        path = f"{shared.rstrip('/')}/quillforge/ship-{uuid.uuid4().hex}/quillforge_pkg.zip"
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        stream = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
        try:
            stream.write(bytearray(_packed()))
        finally:
            stream.close()
    elif not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    else:
        path = os.path.join(tempfile.mkdtemp(prefix="quillforge-ship-"), "quillforge_pkg.zip")
        Path(path).write_bytes(_packed())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def join_in_place(spark: SparkSession, on: bool) -> None:
    """Whether joins by document and more take tables that are already shuffled by document as they are. Page layout gains by it; where few documents hold all rows, as in trees, joins are spread by all of their keys, as by default. No result depends on it."""
    spark.conf.set(_CO_PARTITION, "false" if on else "true")


def with_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: in the folder that spark.checkpoint.dir names; where that is unset, on one machine only, in a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="quillforge-"))
