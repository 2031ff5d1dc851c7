"""Shared plumbing of the corpus operators: shared storage, shipping, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Texts are handed to the numpy kernels in slices of about so many bytes, which bounds
#: a Python worker's memory; a single longer text makes a slice of its own.
SLICE_BYTES = 1 << 21
#: Bytes of an Arrow batch between Spark and a Python worker, unless the session sets its own.
ARROW_BYTES = 8 << 20
#: Spark's setting to delete a query's shuffle files when the query ends.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_SETTING, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_OWN_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`.

    Only a local session may do without that setting; it then gets a folder of its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="widegrain-")
        _OWN_DIRS[app] = f"{base.rstrip('/')}/widegrain-{app}"
    return _OWN_DIRS[app]


def save(df: DataFrame, keep: list[str] | None = None, folder: str = "") -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts its lineage.

    A lost executor then costs a reread, not a recomputation. The shuffle files that the
    write needed are deleted when it is done. With `folder`, a name made by `scratch`, the
    table lies there and goes with it.
    """
    spark = df.sparkSession
    path = "/".join([shared_dir(spark), *([folder] if folder else []), uuid.uuid4().hex])
    before = spark.conf.get(CLEANUP_SETTING, None)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        (df.select(*keep) if keep else df).write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_SETTING)
        else:
            spark.conf.set(CLEANUP_SETTING, before)
    return spark.read.schema((df.select(*keep) if keep else df).schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def release(spark: SparkSession) -> None:
    """Delete what `save` has written in this application."""
    path = _OWN_DIRS.pop(spark.sparkContext.applicationId, None)
    if path:
        _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder name for `save`, whose tables are deleted at the end of the block.

    What is read after it must have been saved elsewhere.
    """
    name = f"scratch-{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        _delete(spark, f"{shared_dir(spark)}/{name}")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="widegrain-ship-"), "widegrain.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    if df.sparkSession.conf.get(ARROW_SETTING) == ARROW_DEFAULT:
        df.sparkSession.conf.set(ARROW_SETTING, str(ARROW_BYTES))
    return df.mapInArrow(fn, schema)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about `limit` bytes at most."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def ragged_arange(lengths: np.ndarray) -> np.ndarray:
    """0..len-1 for each length, joined."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths)


def text_key(text: str = "text", seed: int = 0):
    """A 64-bit hash of a text; with another seed, another one."""
    return F.xxhash64(F.col(text), F.lit(seed))
