"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from jobloom.sources.shared import staged as staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is what ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task works on at a time.
CHUNK_BYTES = 4 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with columns of these names, which an operator needs for itself, under other names,
    and what gives them back their own."""
    taken, moved = {c.lower() for c in df.columns} | {n.lower() for n in names}, {}
    for column in df.columns:
        if column.lower() in {n.lower() for n in names}:
            new = column
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            moved[column] = new
    return df.withColumnsRenamed(moved), lambda found: found.withColumnsRenamed({v: k for k, v in moved.items()})


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """The schema with a last column; one of that name before is replaced."""
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts come to about `limit` bytes (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(start), int(end - start))


def appended(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], [*names, name])


def lists(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
