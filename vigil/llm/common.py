"""Shared helpers of the training-data operators.

Words are runs of ``[^\\x20\\x09-\\x0D]``; on UTF-8 bytes that is exactly
``bytes.split()``, and ``bytes.lower()`` lower-cases A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.graph import bucketed
from vigil.operators.graph import remove as forget
from vigil.operators.graph import shared_folder
from vigil.operators.graph import written as materialise

__all__ = ["as_bytes", "bucketed", "fold", "forget", "free_name", "materialise", "shared_folder", "slices", "table"]

#: Text bytes that one slice of a batch holds at most (one longer text is a slice of its own).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, n: int) -> Column:
    """crc32 of the value's decimal text, mod n; a null id gets 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch of about so many bytes of text, with the texts (None for null)."""
    texts = batch.column(batch.schema.get_field_index(column))
    start, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield batch.slice(start, i + 1 - start), texts.slice(start, i + 1 - start).to_pylist()
            start, held = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start), texts.slice(start).to_pylist()


def as_bytes(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """slices() with the texts as UTF-8 bytes."""
    i = batch.schema.get_field_index(column)
    cast = batch.column(i).cast(pa.binary())
    yield from slices(batch.set_column(i, pa.field(column, pa.binary()), cast), column, most)
