"""Shared helpers: the text record (area, document), row-wise Arrow steps, the guarded broadcast."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

import embergrid


@cache
def _shipped(application: str) -> str:
    """Path of a zip of the library's source, made once per application on the driver."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(embergrid.__file__)))
    return shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="embergrid-"), "embergrid_source"), "zip", root, "embergrid")


def ship(spark: SparkSession) -> None:
    """Send the library to the executors, for tasks that run its functions. Done once per session."""
    if spark.sparkContext.applicationId not in _SENT:
        spark.sparkContext.addPyFile(_shipped(spark.sparkContext.applicationId))
        _SENT.add(spark.sparkContext.applicationId)


_SENT: set[str] = set()


def arrow_step(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, release: Callable[[], None] | None = None,
) -> DataFrame:
    """``df.mapInArrow`` with the library at hand on the executors.

    Workers are used again by later stages: at its end a task calls ``release`` and returns what Arrow holds unused.
    """
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if release is not None:
                release()
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def by_row(
    df: DataFrame, column: str, produced: str, compute: Callable[[list], list[list]], keep: list[str], release: Callable[[], None] | None = None,
) -> DataFrame:
    """Append columns computed from one text column, batch by batch.

    ``compute`` gets the texts of a batch and gives one list per produced column. ``keep`` names the columns
    carried along; nothing else crosses to Python.
    """
    made = T._parse_datatype_string(produced)
    schema = T.StructType([df.schema[c] for c in keep] + list(made))
    source = df.select(*keep, F.col(column).alias("__text"))
    arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):  # bounded memory
            new = compute(batch.column(batch.num_columns - 1).to_pylist())
            columns = batch.columns[:-1] + [pa.array(v, t) for v, t in zip(new, arrow.types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=keep + arrow.names)

    return arrow_step(source, run, schema, release)


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
}
