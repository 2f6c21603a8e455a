"""Burden: how much of the time, by hour of day and in all, is positive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatfold.functions.scalars import hour_bin, over


def hourly_counts(df: DataFrame, patient: str = "patient_id", time: str = "start_time", n_bins: int = 24) -> DataFrame:
    """(patient, time_bin, n) windows of each patient and hour; rows without a patient or time are dropped."""
    binned = df.select(patient, hour_bin(F.col(time), n_bins).alias("time_bin"))
    return binned.dropna().groupBy(patient, "time_bin").agg(F.count("*").alias("n"))


def population_hourly(df: DataFrame, time: str = "start_time", n_bins: int = 24) -> DataFrame:
    """(time_bin, n) windows of each hour."""
    return df.select(hour_bin(F.col(time), n_bins).alias("time_bin")).dropna().groupBy("time_bin").agg(F.count("*").alias("n"))


def burden_fractions(df: DataFrame, label: str = "pred", patient: str = "patient_id", time: str = "start_time", n_bins: int = 24) -> DataFrame:
    """(patient, time_bin, positive, total, burden): share of positive windows in each hour that has windows; one shuffle."""
    binned = df.select(patient, hour_bin(F.col(time), n_bins).alias("time_bin"), F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("p")).dropna()
    counts = binned.groupBy(patient, "time_bin").agg(F.sum("p").alias("positive"), F.count("*").alias("total"))
    return counts.withColumn("burden", over(F.col("positive"), F.col("total")))


def burden_of_two(all_windows: DataFrame, positives: DataFrame, patient: str = "patient_id", time: str = "start_time", n_bins: int = 24) -> DataFrame:
    """The same from two tables, of which the second need not be part of the first; an hour with positives alone has no burden (null)."""
    part = lambda df, a, p: df.select(patient, hour_bin(F.col(time), n_bins).alias("time_bin"), F.lit(a).alias("a"), F.lit(p).alias("p"))
    both = part(all_windows, 1, 0).unionByName(part(positives, 0, 1)).dropna()
    counts = both.groupBy(patient, "time_bin").agg(F.sum("p").alias("positive"), F.sum("a").alias("total"))
    return counts.withColumn("burden", over(F.col("positive"), F.col("total")))


def filled(fractions: DataFrame, bins: str = "observed", patient: str = "patient_id", n_bins: int = 24) -> DataFrame:
    """(patient, time_bin, burden) for every bin: a missing hour takes the patient's median over the hours that are there.

    bins: "observed" (hours that occur in the cohort) or "all". The grid of bins has n_bins rows at most.
    """
    spark = fractions.sparkSession
    known = fractions.select(patient, "time_bin", "burden")
    if bins == "observed":
        every = known.agg(F.array_sort(F.collect_set("time_bin")).alias("every"))
    else:
        every = spark.range(1).select(F.sequence(F.lit(0), F.lit(n_bins - 1)).alias("every"))
    own = known.groupBy(patient).agg(F.median("burden").alias("mid"), F.map_from_entries(F.collect_list(F.struct("time_bin", "burden"))).alias("known"))
    grid = own.crossJoin(F.broadcast(every)).select(patient, "mid", "known", F.explode("every").alias("time_bin"))  # one row of n_bins numbers
    return grid.select(patient, "time_bin", F.coalesce(F.try_element_at("known", F.col("time_bin")), "mid").alias("burden"))


def burden_wide(profile: DataFrame, patient: str = "patient_id", n_bins: int = 24) -> DataFrame:
    """(patient, h00, h01, ..., mean_burden) of filled profiles; the columns are given, so no extra job looks for them."""
    cols = [F.max(F.when(F.col("time_bin") == b, F.col("burden"))).alias(f"h{b:02d}") for b in range(n_bins)]
    return profile.groupBy(patient).agg(*cols, F.avg("burden").alias("mean_burden"))


def mean_burden(profile: DataFrame, patient: str = "patient_id") -> DataFrame:
    return profile.groupBy(patient).agg(F.avg("burden").alias("mean_burden"))


def cohort_summary(df: DataFrame, label: str = "pred", patient: str = "patient_id") -> DataFrame:
    """Rows, patients, positive rows, patients with a positive row, and the share of positive rows in percent."""
    hit = F.col(label).cast("boolean")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(patient).alias("n_patients"),
        F.count_if(hit).alias("n_positive"),
        F.countDistinct(F.when(hit, F.col(patient))).alias("n_positive_patients"),
    ).withColumn("positive_pct", over(F.col("n_positive") * 100, F.col("n_rows")))


def af_burden(df: DataFrame, label: str, pred: str, duration: str = "dur_sec", patient: str = "patient_id") -> DataFrame:
    """(patient, true_burden, pred_burden): share of time in percent; null for a patient without any time."""
    d = F.col(duration).cast("double")
    sums = df.groupBy(patient).agg(F.sum(d).alias("t"), F.sum(d * F.col(label).cast("int")).alias("y"), F.sum(d * F.col(pred).cast("int")).alias("p"))
    return sums.select(patient, over(F.col("y") * 100, F.col("t")).alias("true_burden"), over(F.col("p") * 100, F.col("t")).alias("pred_burden"))
