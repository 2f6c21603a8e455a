"""Readers and writers of rhythm tables."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatfold.functions.scalars import positive, profile_columns
from beatfold.sources import npy

BEATS = "patient_id STRING, rr_data DOUBLE, rr_time DOUBLE"
WINDOWS = "patient_id STRING, prec_window INT, start_time DOUBLE, end_time DOUBLE, proba DOUBLE, pred BOOLEAN"
#: Fixed value: the header of a rhythm annotation file; the last line names the columns.
ANNOTATION_HEADER = ("---", "type: rhythms annotation", "source file: rhythms.txt", "", "---", "", "Beginning\tEnd\t\tClass")


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_windows(spark: SparkSession, path: str, positive_only: bool = False, label: str = "pred", schema: str | None = None) -> DataFrame:
    """Window predictions of a cohort (CSV with a header, or Parquet)."""
    df = _read(spark, path, schema)
    return positive(df, label) if positive_only else df


def read_beats(spark: SparkSession, path: str, schema: str = BEATS) -> DataFrame:
    return _read(spark, path, schema)


def read_recording_metadata(spark: SparkSession, path: str, schema: str = "data_id STRING, holter_start_time STRING") -> DataFrame:
    return _read(spark, path, schema)


def read_burden_profiles(spark: SparkSession, path: str, id_col: str = "patient_id") -> DataFrame:
    """(id, profile[, cluster, mean_burden]) of a wide table."""
    df = _read(spark, path)
    extra = [c for c in ("cluster", "mean_burden") if c in df.columns]
    return df.select(F.col(id_col), F.array(*[F.col(f"`{c}`").cast("double") for c in profile_columns(df.columns, id_col)]).alias("profile"), *extra)


def read_chronophenotypes(spark: SparkSession, path: str, id_col: str = "patient_id") -> tuple[DataFrame, int]:
    """The profiles and the number of clusters; raises if there is no cluster column."""
    df = read_burden_profiles(spark, path, id_col)
    if "cluster" not in df.columns:
        raise ValueError(f"{path} has no column `cluster`")
    return df, df.select("cluster").distinct().count()


def read_npy_windows(spark: SparkSession, path: str, size: int = 6000, range_bytes: int = npy.RANGE_BYTES) -> DataFrame:
    """(prec_window, succ_window, global_label, record, samples) of stacked window matrices in .npy files, read by ranges of rows: a
    large file is read by many tasks. Files of a store that Arrow cannot open are decoded whole, a task each."""
    try:
        npy.opened(path)
    except (pa.ArrowInvalid, OSError):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("content")
        return files.mapInArrow(lambda batches: _whole(batches, size), npy.SCHEMA)
    spark.dataSource.register(npy.NpyWindows)
    return spark.read.format("npy_windows").option("size", size).option("range_bytes", range_bytes).load(path)


def _whole(batches, size: int):
    for b in batches:
        for content in b.column(0).to_pylist():
            m = np.load(io.BytesIO(content), allow_pickle=False)
            yield from (npy.windows(m[at : at + 256], size) for at in range(0, len(m), 256))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", True).format(fmt).save(path)


def write_rhythm_annotations(events: DataFrame, path: str, patient: str = "patient_id") -> None:
    """One text for each recording, in a folder of its own: the header, then start, end and class of each event."""
    line = F.format_string("%.5f\t%.5f\t%s", F.col("start_sec"), F.col("end_sec"), F.col("rhythm"))
    packed = F.array_sort(F.collect_list(F.struct("start_sec", line.alias("line"))))
    text = F.concat_ws("\n", F.array(*[F.lit(x) for x in ANNOTATION_HEADER]), F.transform(packed, lambda x: x["line"]))
    rows = events.groupBy(patient).agg(text.alias("value"))  # a recording's own events
    rows.repartition(patient).write.mode("overwrite").partitionBy(patient).text(path)


def read_rhythm_annotations(spark: SparkSession, path: str, patient: str = "patient_id") -> DataFrame:
    """(patient, start_sec, end_sec, rhythm); fields are separated by white space, `;` or `,`."""
    rows = spark.read.text(path).select(F.col(patient), F.split(F.trim("value"), r"[\s;,]+").alias("f"))
    start, end = F.expr("try_cast(f[0] AS DOUBLE)"), F.expr("try_cast(try_element_at(f, 2) AS DOUBLE)")
    return rows.select(patient, start.alias("start_sec"), end.alias("end_sec"), F.try_element_at("f", F.lit(3)).alias("rhythm")).filter("start_sec IS NOT NULL AND end_sec IS NOT NULL")


def save_model(model: DataFrame, path: str, n_neighbors: int) -> None:
    """A nearest-neighbour model: its training rows and a row of parameters."""
    model.write.mode("overwrite").parquet(f"{path}/train")
    n = model.select("label").distinct().count()
    model.sparkSession.createDataFrame([(n_neighbors, n)], "n_neighbors int, n_clusters int").write.mode("overwrite").parquet(f"{path}/parameters")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(training rows, n_neighbors, n_clusters)"""
    p = spark.read.parquet(f"{path}/parameters").first()
    return spark.read.parquet(f"{path}/train"), p.n_neighbors, p.n_clusters
