"""What the operators share: the input tables, bounded Arrow batches, folds and word splitting."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.storage import materialise, new_path, remove, shared_folder, stored

__all__ = ["column", "documents", "fold_of", "freeing", "input_table", "labels", "map_batches", "materialise", "new_path", "remove", "row_hash", "shared_folder", "slices", "stored", "texts_of", "words_of"]

#: A word is a run of characters other than space and U+0009 to U+000D.
SPACE_RUN = r"[ \t-\r]+"
#: Most rows and bytes that a function is given at a time; a row of more bytes comes alone. Spark bounds what arrives (64 MB).
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20


def input_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return input_table(spark, sf_dir, "documents")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return input_table(spark, sf_dir, "labels")


def column(name: str) -> Column:
    """A column by its own name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, T.MapType | T.VariantType)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns but those whose type Spark does not hash (maps and variants)."""
    return F.xxhash64(*[column(f.name) for f in df.schema if _hashable(f.dataType)])


def words_of(text: Column | str) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE_RUN, -1), "")


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo `folds`."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def _row_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a column, roughly."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(kind):
        return 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), 8)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of at most `rows` rows and `size` bytes."""
    for batch in batches:
        ends = np.cumsum(sum(_row_bytes(c) for c in batch.columns)) if batch.num_columns else np.zeros(len(batch))
        at = 0
        while at < len(batch):
            done = ends[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + size, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def map_batches(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    rows: int = BATCH_ROWS,
    size: int = BATCH_BYTES,
) -> DataFrame:
    """mapInArrow with bounded batches, so that very long texts fit in a worker; no setting of the session is touched."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(slices(batches, rows, size))

    return df.mapInArrow(bounded, schema)


def freeing(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`fn`, after whose end a worker gives back to the system what it has freed; workers wait for later tasks beside the JVM."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return freed


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
