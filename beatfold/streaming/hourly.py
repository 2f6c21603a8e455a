"""Hourly burden over a stream of window predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatfold.functions.scalars import over


def hourly_burden(stream: DataFrame, time: str = "window_time", label: str = "pred", patient: str = "patient_id", late: str = "2 hours") -> DataFrame:
    """(patient, hour, positive, total, burden) of each patient and hour; windows later than `late` are left out."""
    hits = F.coalesce(F.col(label).cast("int"), F.lit(0))
    rows = stream.withWatermark(time, late).groupBy(patient, F.window(time, "1 hour").alias("w"))
    sums = rows.agg(F.sum(hits).alias("positive"), F.count("*").alias("total"))
    return sums.select(patient, F.col("w.start").alias("hour"), "positive", "total", over(F.col("positive"), F.col("total")).alias("burden"))
