"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or where it is unset (a local session) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        key = spark.sparkContext.applicationId
        if key not in _OWN_DIRS:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            _OWN_DIRS[key] = tempfile.mkdtemp(prefix="clipsift-")
        found = _OWN_DIRS[key]
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again, which ends its lineage there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/clipsift/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._clipsift_path = path
    atexit.register(_remove, spark, path)
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Remove tables of ``cut`` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_clipsift_path", None):
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended before us; the folder is the cluster's to clean
        return


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the split into folds that the contracts fix."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The two columns an operator works on, named so that no other column of the input can clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)


def slices(batch: pa.RecordBatch, column: str | int = "text", limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Split a batch so that a column's texts come to about ``limit`` bytes a slice (a longer single text makes a slice of its own)."""
    col = batch.column(batch.schema.get_field_index(column) if isinstance(column, str) else column)
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def where_text(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text (null: empty) is judged true. ``judge()`` is made once a task."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = judge()
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(decide([t or "" for t in part.column(at).to_pylist()])))

    return docs.mapInArrow(run, docs.schema)


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, x) of the rows whose vector is neither null nor holds a null or non-finite entry.

    ``x`` is ``floor(scale * entry)`` of each entry as a double, as little-endian 64-bit numbers in one binary value, so that equal
    vectors are equal keys; numbers beyond a long's range become its ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]  # null entries become nan
            at -= at[0]
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.clip(np.floor(scale * np.nan_to_num(values)), -(2.0**63), 2.0**63 - 1024).astype("<i8")
            binary = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(x)])
            fine = pa.compute.and_(pa.array(bad[at[1:]] == bad[at[:-1]]), lists.is_valid())
            yield pa.RecordBatch.from_arrays([batch.column(0), binary], names=["vec_id", "x"]).filter(fine)

    v = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return v.mapInArrow(run, "vec_id long, x binary")


def stacked(column: pa.Array) -> np.ndarray:
    """Binary values of ``whole_vectors`` that are equally long, as a matrix of 64-bit numbers."""
    if not len(column):
        return np.zeros((0, 0), np.int64)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<i8", (at[-1] - at[0]) // 8, at[0]).reshape(len(column), -1)
