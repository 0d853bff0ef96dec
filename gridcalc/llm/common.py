"""Helpers that the corpus operators share: the shared folder, cut lineage, file access, Arrow batches."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of text that a Python worker takes up at once, a longer text alone.
SLICE_ROWS, SLICE_BYTES = 1000, 2_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset (tests), an own one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(shared_root, "own", None)
        if root is None:
            root = shared_root.own = "file://" + tempfile.mkdtemp(prefix="gridcalc-")
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_root(spark)}/gridcalc/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    file_system.mkdirs(jvm_path.getParent())
    file_system.deleteOnExit(jvm_path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes paths of :func:`fresh_path` that no later step reads."""
    for path in paths:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it again, so that a lost executor costs no recomputation."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridcalc_path = path
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of a bounded size, whatever the session's settings; the column at ``at`` holds texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(ends, (int(ends[a - 1]) if a else 0) + SLICE_BYTES, "right"))
            b = min(max(b, a + 1), a + SLICE_ROWS)
            yield batch.slice(a, b - a)
            a = b


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else "file://" + uri)


def put_file(uri: str, parts: Callable[[object], None]) -> None:
    """Writes a file by way of a name of its own and a rename: a repeated task replaces whole files only."""
    file_system, path = open_fs(uri)
    file_system.create_dir(posixpath.dirname(path), recursive=True)
    partial = f"{path}.{uuid.uuid4().hex}.part"
    with file_system.open_output_stream(partial, compression=None) as out:
        parts(out)
    file_system.move(partial, path)


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def gathered(offsets: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions in a flat store of the runs that ``codes`` name, one run after the other."""
    n = lengths[codes]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(offsets[codes] - (ends - n), n)


def rows_of(batches: Iterator[pa.RecordBatch], schema: pa.Schema, f: Callable[[pa.RecordBatch], list]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) if not isinstance(x, pa.Array) else x for x, t in zip(f(batch), schema.types, strict=True)], schema=schema)


def kept(df: DataFrame, start: Callable[[], Callable[[list[bytes]], np.ndarray]], text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text a test keeps, all columns as they are; ``start`` makes a task's test of a batch of texts."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = start()
        for batch in text_slices(batches, at):
            yield batch.filter(pa.array(test(bytes_of(batch.column(at))), pa.bool_()))

    return df.mapInArrow(run, df.schema)
