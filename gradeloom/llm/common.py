"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


_SHIPPED: set[str] = set()
#: What empties the tables that operators keep in a Python worker from task to task.
_KEPT: list[Callable[[], bool]] = []


def kept_in_worker(clear: Callable[[], bool]) -> None:
    """Have ``clear`` called when an operator asks for a worker's memory; it tells whether anything was held."""
    _KEPT.append(clear)


def empty_worker() -> None:
    """Give back what other operators kept in this worker, which Spark uses again for the next stage."""
    if any([clear() for clear in _KEPT]):
        gc.collect()
    pa.default_memory_pool().release_unused()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete the shuffle files of a query as it ends, not when the driver's garbage is collected.

    For queries whose frames run once; one that runs again would shuffle again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``rows`` rows, so that only one piece at a time is Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, by Spark's own file server.

    The archive is served from the driver's disk and removed when the driver ends.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="gradeloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(
        os.path.join(folder, "gradeloom"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def whole_text(column: str = "text") -> Column:
    """The text as a string; a null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that tell rows of different id or text apart; equal rows share them."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit("")))))


def in_batches(
    df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], Iterator[dict] | dict]
) -> DataFrame:
    """Apply ``function`` to every Arrow batch; it returns (or yields) columns as lists or arrays."""
    spark_schema = _parsed(df.sparkSession, schema)
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in spark_schema.fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(batch)
            for columns in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(apply, spark_schema)


def _parsed(spark: SparkSession, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
