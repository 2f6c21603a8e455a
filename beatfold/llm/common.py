"""What the operators of this subpackage share: column picking, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import gc
import itertools
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatfold.sources.shared import shared_dir

_names = itertools.count()

_slot: list = [None, None]


def kept(key, make):
    """What a Python worker keeps between tasks, made where it has none under this key. One thing at a time: workers are used
    again by other operators, and what the former one kept goes first."""
    if _slot[0] != key:
        _slot[:] = None, None
        gc.collect()
        pa.default_memory_pool().release_unused()
        _slot[:] = key, make()
    return _slot[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact spelling, so extra columns (also ones that differ in case only) cannot clash."""
    cols = df.columns
    plain = df.toDF(*[f"_p{i}" for i in range(len(cols))])
    return plain.select(*[F.col(f"_p{cols.index(n)}").alias(n) for n in names])



def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{next(_names)}-{uuid.uuid4().hex[:12]}"


_scratch: ContextVar[list | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables that were written within it. What is still needed must be written with `stays`."""
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """df, written as Parquet into the shared folder and read back: lineage ends there and every executor can read it."""
    path = new_path(df.sparkSession, name)
    if not stays and _scratch.get() is not None:
        _scratch.get().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, whatever the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column's bytes in each stay near `most` (a longer value comes alone)."""
    for b in batches:
        values = b.column(b.schema.get_field_index(column))
        if values.nbytes <= most:
            if b.num_rows:
                yield b
            continue
        at = size = 0
        for i, n in enumerate(values.to_pylist()):
            n = len(n or "")
            if size and size + n > most:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        yield b.slice(at)


def gathered(batches: Iterable[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches put together up to about so many bytes, where what is found for one word serves all."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.concat_batches(held)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
