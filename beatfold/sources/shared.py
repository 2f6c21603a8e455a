"""Cutting lineage, and order over many rows without a task that holds them all."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE_ROWS = 500_000


def shared_dir(spark) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets one of its own."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


_scratch: ContextVar[list | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables that were settled within it: for what is computed and written before it ends."""
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table in the shared folder; neither lineage nor plan reaches back beyond it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    if _scratch.get() is not None:
        _scratch.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: Column, parts: int | None = None) -> DataFrame:
    """df with `part`: rows are dealt by range of the order, so parts follow one another; settled, so that they stay as they are.
    The number of parts grows with the rows."""
    if parts is None:
        df = settled(df)
        parts = max(1, -(-df.count() // RANGE_ROWS))
    return settled(df.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()))


def numbered(df: DataFrame, name: str, keys: list[str], *order: str, parts: int | None = None) -> DataFrame:
    """df with a number from 0 in each group of `keys`, in order; rows are numbered by ranges, whatever the size of a group."""
    by = [*keys, *order]
    df = settled(df)
    parts = parts or max(1, -(-df.count() // RANGE_ROWS))
    rows = settled(df.repartitionByRange(parts, *map(F.asc, by)).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
    sizes = sizes.select(*keys, "_part", before.alias("_before"))  # a row for each group and range
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)).cast("long") - 1
    return rows.withColumn("_own", own).join(sizes, [*keys, "_part"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")
