"""Rhythm events: positive windows merged into episodes, their statistics, and joins around recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatfold.functions.scalars import clock_seconds, over, positive, record_id


def merge_events(df: DataFrame, label: str = "pred", max_gap: float = 10.0, patient: str = "patient_id", rhythm: str = "AFIB") -> DataFrame:
    """(patient, event_id, start_sec, end_sec, rhythm): positive windows; a new event begins over max_gap seconds after the row before ended."""
    w = Window.partitionBy(patient).orderBy("start_time", "end_time")
    rows = positive(df, label).select(patient, "start_time", "end_time")
    new = F.when(F.col("start_time") - F.lag("end_time").over(w) > max_gap, 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("event_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(patient, "event_id").agg(F.min("start_time").alias("start_sec"), F.max("end_time").alias("end_sec"))
    return found.withColumn("rhythm", F.lit(rhythm))


def event_statistics(events: DataFrame, recordings: DataFrame, length: str = "rec_length", patient: str = "patient_id") -> DataFrame:
    """(patient, n_events, max_event_sec, min_event_sec, af_burden) of every recording; zeros without events. af_burden: share of the length."""
    d = F.col("end_sec") - F.col("start_sec")
    own = events.groupBy(patient).agg(F.count("*").alias("n"), F.max(d).alias("hi"), F.min(d).alias("lo"), F.sum(d).alias("all"))
    rows = recordings.select(patient, length).join(own, patient, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(patient, F.coalesce("n", F.lit(0)).alias("n_events"), zero(F.col("hi")).alias("max_event_sec"), zero(F.col("lo")).alias("min_event_sec"), zero(over(F.col("all"), F.col(length))).alias("af_burden"))


def attach_recording_start(df: DataFrame, meta: DataFrame, patient: str = "patient_id", data_id: str = "data_id", clock: str = "holter_start_time") -> DataFrame:
    """df of recordings with metadata, with start_recording (seconds since midnight). Ids are compared zero-filled; metadata is one row for each recording."""
    starts = meta.select(record_id(F.col(data_id)).alias("_id"), clock_seconds(F.col(clock)).alias("start_recording"))
    return df.withColumn("_id", record_id(F.col(patient))).join(starts, "_id").drop("_id")


def absolute_window_time(df: DataFrame) -> DataFrame:
    """df with window_start: seconds since midnight of the recording's first day; without metadata the window's own time."""
    start = F.col("start_recording") + F.col("start_time") if "start_recording" in df.columns else F.col("start_time")
    return df.withColumn("window_start", start)


def attach_truth(pred: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("patient_id", "prec_window")) -> DataFrame:
    """Predictions with the true label of their window; null where there is none."""
    return pred.join(truth.select(*keys, "true_label"), list(keys), "left")


def unmatched(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count("*").alias("n_rows"), F.count_if(F.col("true_label").isNull()).alias("n_unmatched"))


def window_times_for_predictions(pred: DataFrame, times: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Predictions with the start and end of their window, where these come as a table of their own."""
    return pred.join(times.select(patient, "prec_window", "start_time", "end_time"), [patient, "prec_window"])


def select_patients(df: DataFrame, patients: DataFrame, patient: str = "patient_id") -> DataFrame:
    return df.join(patients.select(patient).distinct(), patient, "left_semi")


def shape_predictions(windows: DataFrame, threshold: float = 0.5, patient: str = "patient_id") -> DataFrame:
    """(patient, prec_window[, start_time, end_time], proba, pred BOOLEAN) of scored windows."""
    times = [c for c in ("start_time", "end_time") if c in windows.columns]
    return windows.select(patient, "prec_window", *times, "proba", (F.col("proba") > threshold).alias("pred"))
