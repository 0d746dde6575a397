"""Shared helpers: written intermediate tables and Arrow passes over text."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import rivulet
from rivulet.session import checkpoint_dir

#: Text bytes that one numpy step works on; bounds a Python worker's memory.
SLICE_BYTES = 1 << 18


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder, with its scheme."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, and lost executors lose nothing."""
    return staged_at(df, name)[0]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = work_dir(spark, name)
    for made in _scratch:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside are deleted at the end: write what is made of them before that."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.pop()
        for path in made:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(taken, *names: str) -> list[str]:
    """Column names that do not clash with ``taken`` (Spark ignores case)."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        low.add(n.lower())
        out.append(n)
    return out


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    arr = arr.cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    body = arr.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0]:off[-1]] if body is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of ``batch`` with about ``limit`` text bytes each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_text(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField],
             fn: Callable[[pa.Array], list[pa.Array]], limit: int = SLICE_BYTES) -> DataFrame:
    """``keep`` columns of ``df`` with the columns that ``fn`` makes of each row's whole text.

    ``fn`` gets a text array of about ``limit`` bytes at most and returns one Arrow array per field.
    """
    own, = fresh(keep, "text_in")
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(own))
    out = T.StructType([*src.schema.fields[:-1], *fields])
    n = len(keep)

    def run(batches):
        for b in batches:
            for part in text_slices(b, n, limit):
                made = fn(part.column(n))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=out.names)

    return map_arrow(src, run, out, fn.__module__)


_MEMORIES: dict[str, Callable[[], None]] = {}


def remembers(module: str, forget: Callable[[], None]) -> None:
    """Name what a worker process of ``module``'s operator keeps from task to task, and how to drop it."""
    _MEMORIES[module] = forget


def enter(module: str) -> None:
    """A worker begins a task of ``module``: what other operators' tasks have left in the process goes."""
    for name, forget in _MEMORIES.items():
        if name != module:
            forget()


#: Rows of an Arrow batch: Spark's default of 10,000 whole texts is tens of megabytes in the JVM and again in the worker.
ROWS_KEY, ROWS_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"

_SHIPPED: set[str] = set()


def map_arrow(df: DataFrame, run: Callable, schema, module: str | None = None) -> DataFrame:
    """``df.mapInArrow`` with this package sent to the executors, once per application."""
    module = module or run.__module__

    def entered(batches):
        enter(module)
        return run(batches)

    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(rivulet.__file__)))
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "rivulet_pkg"), "zip", root, "rivulet"))
        _SHIPPED.add(sc.applicationId)
    if df.sparkSession.conf.get(ROWS_KEY) == ROWS_DEFAULT:  # a setting of the user's own stays
        df.sparkSession.conf.set(ROWS_KEY, BATCH_ROWS)
    return df.mapInArrow(entered, schema)


def longs(values) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, dtype=np.int64))


def binaries(body: bytes, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary array over ``body`` cut at ``offsets``."""
    off = np.ascontiguousarray(offsets, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(body)])


def labelled(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(``id``, ``label``) of all labelled ids.

    Null ids and labels are left out; an id with several labels counts by its smallest.
    """
    return (labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label).cast("int")).alias("label")))
