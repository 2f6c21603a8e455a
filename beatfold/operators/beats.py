"""Beats, ECG signals and how they are cut into windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AFIB, NORMAL = "(AFIB", "(N"
MISSING = ("", "None")


def _by(patient: str, *order: str):
    return Window.partitionBy(patient).orderBy(*order)


def validate_beats(df: DataFrame, rr: str = "rr_data", time: str = "rr_time", most: float = 100.0) -> DataFrame:
    """df with reason: null for a sound beat, else why it is not (null_rr, non_numeric_rr, rr_too_long, non_numeric_time)."""
    x, t = F.col(rr).cast("string"), F.col(time).cast("string")
    num = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    reason = F.when(x.isNull(), "null_rr").when(num(rr).isNull(), "non_numeric_rr").when(num(rr) > most, "rr_too_long").when(t.isNull() | num(time).isNull(), "non_numeric_time")
    return df.withColumn("reason", reason)


def validation_report(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def rr_from_peaks(peaks: DataFrame, fs: float | None = None, patient: str = "patient_id", sample: str = "sample") -> DataFrame:
    """(patient, seq, rr_data, rr_time): the distance to the peak before, at the time of the later peak. Needs two peaks."""
    rate = F.col("fs").cast("double") if fs is None else F.lit(float(fs))
    w = _by(patient, sample)
    rows = peaks.select(patient, F.col(sample), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.lag(sample).over(w).alias("before"), rate.alias("fs"))
    return rows.filter("before IS NOT NULL").select(patient, "seq", ((F.col(sample) - F.col("before")) / F.col("fs")).alias("rr_data"), (F.col(sample) / F.col("fs")).alias("rr_time"))


def fill_rhythm(df: DataFrame, patient: str = "patient_id", order: str = "seq", rhythm: str = "rhythm", missing: tuple[str, ...] = MISSING) -> DataFrame:
    """df whose missing rhythms take the last known one before; a leading gap the first known; a record without any is normal."""
    known = F.when(~F.col(rhythm).isin(*missing), F.col(rhythm))
    w = _by(patient, order)
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(rhythm, F.coalesce(before, first, F.lit(NORMAL)))


def numbered(df: DataFrame, win: int = 60, patient: str = "patient_id", order: str = "seq") -> DataFrame:
    """df with prec_window: number from 0 of the block of `win` rows."""
    return df.withColumn("prec_window", F.floor((F.row_number().over(_by(patient, order)) - 1) / win).cast("int"))


def rr_windows(beats: DataFrame, win: int = 60, patient: str = "patient_id", order: str = "seq") -> DataFrame:
    """(patient, prec_window, rr array, start_time, end_time, dur_sec, n_beats) of full blocks of `win` beats; the rest is dropped.

    Window and grouping share the patient's shuffle.
    """
    rr = F.transform(F.array_sort(F.collect_list(F.struct(order, "rr_data"))), lambda x: x["rr_data"])
    grouped = numbered(beats, win, patient, order).groupBy(patient, "prec_window")
    full = grouped.agg(rr.alias("rr"), F.min("rr_time").alias("start_time"), F.max("rr_time").alias("end_time"), F.count("*").alias("n_beats"))
    total = F.aggregate("rr", F.lit(0.0), lambda a, x: a + x)
    return full.filter(F.col("n_beats") == win).withColumn("dur_sec", total)


def rr_window_labels(beats: DataFrame, win: int = 60, threshold: float = 0.5, patient: str = "patient_id", order: str = "seq") -> DataFrame:
    """(patient, prec_window, true_label): 1 where at least `threshold` of a full block's beats are atrial fibrillation."""
    rows = numbered(fill_rhythm(beats, patient, order), win, patient, order)
    n = rows.groupBy(patient, "prec_window").agg(F.count_if(F.col("rhythm") == AFIB).alias("af"), F.count("*").alias("n")).filter(F.col("n") == win)
    return n.select(patient, "prec_window", (F.col("af") >= win * threshold).cast("int").alias("true_label"))


def drop_short_records(df: DataFrame, least: int, patient: str = "patient_id") -> DataFrame:
    """Rows of records with at least `least` rows."""
    n = F.count("*").over(Window.partitionBy(patient))
    return df.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def select_signal(records: DataFrame, rate: float, lead: int = 1) -> DataFrame:
    """Records sampled at `rate`, with samples: one lead (counted from 1) of their leads."""
    return records.filter(F.col("fs") == rate).withColumn("samples", F.try_element_at("leads", F.lit(lead))).drop("leads")


def recording_duration(chunks: DataFrame, rate: float, patient: str = "patient_id") -> DataFrame:
    """(patient, n_samples, duration): all chunks' samples over the rate, in seconds."""
    n = chunks.groupBy(patient).agg(F.sum(F.size("samples")).cast("long").alias("n_samples"))
    return n.withColumn("duration", F.col("n_samples") / F.lit(float(rate)))


def ecg_windows(signals: DataFrame, size: int = 6000, samples: str = "samples", *keep: str) -> DataFrame:
    """(keep..., prec_window, samples): full pieces of `size` samples; the rest is dropped. No shuffle."""
    n = F.floor(F.size(samples) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(samples, i * size + 1, F.lit(size)))
    return signals.filter(F.size(samples) >= size).select(*keep, F.posexplode(parts).alias("prec_window", "samples"))


def window_times(recordings: DataFrame, width: float = 30.0, duration: str = "duration", *keep: str) -> DataFrame:
    """(keep..., prec_window, start_time, end_time): windows of `width` seconds; a shorter recording has one window, which ends with it."""
    n = F.greatest(F.lit(1), F.floor(F.col(duration) / width)).cast("int")
    rows = recordings.select(*keep, duration, F.explode(F.sequence(F.lit(0), n - 1)).alias("prec_window"))
    start = F.col("prec_window") * F.lit(float(width))
    return rows.select(*keep, "prec_window", start.alias("start_time"), F.least(start + width, F.col(duration)).alias("end_time"))


def beats_in_windows(beats: DataFrame, width: int, patient: str = "patient_id", time: str = "sample") -> DataFrame:
    """beats with prec_window: the window of fixed width with start < time <= end; beats at 0 or before are in none."""
    return beats.filter(F.col(time) > 0).withColumn("prec_window", (F.ceil(F.col(time) / width) - 1).cast("int"))


def beats_in_spans(beats: DataFrame, spans: DataFrame, bucket: float, patient: str = "patient_id", time: str = "rr_time") -> DataFrame:
    """beats joined to spans (patient, start_time, end_time) with start < time <= end, by an equal join on buckets of time."""
    spread = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_time") / bucket), F.floor(F.col("end_time") / bucket))))
    keyed = beats.withColumn("_b", F.floor(F.col(time) / bucket))
    return keyed.join(spread, [patient, "_b"]).filter((F.col("start_time") < F.col(time)) & (F.col(time) <= F.col("end_time"))).drop("_b")


def ecg_window_labels(beats: DataFrame, windows: DataFrame, width: int, patient: str = "patient_id") -> DataFrame:
    """(patient, prec_window, true_label): 1 where more than half of the window's beats are atrial fibrillation; 0 without beats."""
    hits = beats_in_windows(fill_rhythm(beats, patient), width, patient)
    n = hits.groupBy(patient, "prec_window").agg(F.count_if(F.col("rhythm") == AFIB).alias("af"), F.count("*").alias("n"))
    rows = windows.select(patient, "prec_window").join(n, [patient, "prec_window"], "left")
    return rows.select(patient, "prec_window", F.coalesce((F.col("af") * 2 > F.col("n")).cast("int"), F.lit(0)).alias("true_label"))


def rhythm_window_bounds(peaks: DataFrame, win: int = 60, patient: str = "patient_id", time: str = "rr_time") -> DataFrame:
    """(patient, prec_window, start_time, end_time) of blocks of `win` beats by the middles between peaks.

    Peaks t0..tn; m(0) = max(0, t0 - 1), m(i) the middle of t(i-1) and t(i), m(n+1) = tn + 1. Block w runs from m(w win) to m((w + 1) win + 1).
    """
    w = _by(patient, time)
    rows = peaks.select(patient, F.col(time).alias("t"), (F.row_number().over(w) - 1).alias("i"), F.lag(time).over(w).alias("p"), F.count("*").over(Window.partitionBy(patient)).alias("n"))
    mid = F.when(F.col("i") == 0, F.greatest(F.lit(0.0), F.col("t") - 1)).otherwise((F.col("t") + F.col("p")) / 2)
    rows = rows.select(patient, "i", "n", mid.alias("m"), (F.col("t") + 1).alias("last"))
    starts = rows.filter(F.col("i") % win == 0).select(patient, (F.col("i") / win).cast("int").alias("prec_window"), F.col("m").alias("start_time"), "n")
    ends = rows.filter((F.col("i") % win == 1) & (F.col("i") > 1)).select(patient, ((F.col("i") - 1) / win - 1).cast("int").alias("prec_window"), F.col("m").alias("e"))
    final = rows.filter(F.col("i") == F.col("n") - 1).select(patient, "last")
    joined = starts.filter((F.col("prec_window") + 1) * win <= F.col("n") - 1).join(ends, [patient, "prec_window"], "left").join(final, patient)
    return joined.select(patient, "prec_window", "start_time", F.coalesce("e", "last").alias("end_time"))


def preceding_window_count(bounds: DataFrame, excluded: DataFrame, patient: str = "patient_id") -> DataFrame:
    """(patient, prec_window, preceding): how many windows so far, this one included, touch no excluded portion (patient, a, b).

    A window is masked if its start or its end is in (a, b], or it holds the portion. Portions are few and joined by patient.
    """
    s, e = F.col("start_time"), F.col("end_time")
    hit = ((s > F.col("a")) & (s <= F.col("b"))) | ((e > F.col("a")) & (e <= F.col("b"))) | ((s <= F.col("a")) & (e > F.col("b")))
    masked = bounds.join(excluded, patient).filter(hit).select(patient, "prec_window").distinct().withColumn("masked", F.lit(1))
    rows = bounds.join(masked, [patient, "prec_window"], "left").withColumn("keep", F.when(F.col("masked").isNull(), 1).otherwise(0))
    so_far = F.sum("keep").over(_by(patient, "prec_window").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(patient, "prec_window", so_far.cast("long").alias("preceding"))


def consecutive_runs(df: DataFrame, step: float | None = None, tol: float = 1e-3, patient: str = "patient_id", time: str = "start_time") -> DataFrame:
    """df with prec and succ: length of the run of evenly spaced windows that ends, and that starts, at each. step: given, or the median difference."""
    w = _by(patient, time)
    rows = df.withColumn("_d", F.col(time) - F.lag(time).over(w))
    usual = F.lit(float(step)) if step is not None else F.median("_d").over(Window.partitionBy(patient))
    cut = F.when((usual > 0) & (F.abs(F.col("_d") - usual) > tol), 1).otherwise(0)
    rows = rows.withColumn("_c", cut).withColumn("_r", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(patient, "_r")
    rows = rows.withColumn("prec", F.row_number().over(run.orderBy(time)).cast("long")).withColumn("succ", F.count("*").over(run) - F.col("prec") + 1)
    return rows.drop("_d", "_c", "_r")


def window_positions(df: DataFrame, patient: str = "patient_id", order: str = "start_time", ties: str | None = None) -> DataFrame:
    """df with prec (windows before) and succ (windows after); windows of one time follow `ties`."""
    prec = (F.row_number().over(Window.partitionBy(patient).orderBy(order, *([ties] if ties else []))) - 1).cast("long")
    return df.withColumn("prec", prec).withColumn("succ", F.count("*").over(Window.partitionBy(patient)) - 1 - F.col("prec"))


def window_context(df: DataFrame, value: Column, before: int = 9, patient: str = "patient_id", order: str = "prec_window") -> DataFrame:
    """df with context: the value of the `before` windows ahead and this one; nulls where a record has not begun."""
    seen = F.collect_list(F.struct(value.alias("v"))).over(_by(patient, order).rowsBetween(-before, 0))
    df = df.withColumn("_s", seen)
    pad = F.array_repeat(F.lit(None).cast(df.schema["_s"].dataType.elementType), F.lit(before + 1) - F.size("_s"))
    return df.withColumn("context", F.transform(F.concat(pad, "_s"), lambda x: x["v"])).drop("_s")
