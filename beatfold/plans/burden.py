"""Queries of burden, recordings and events over the derived window table."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatfold.functions import scalars as S
from beatfold.operators import burden as B
from beatfold.operators import events as E
from beatfold.sources import views as V
from beatfold.sources.views import duck

W, M = "v_windows", "v_meta"
GAP = 21600  # windows of the derived table are hours apart


def _r(c: str, n: int = 6):
    return F.round(F.col(c), n).alias(c)


def _profile(s, d):
    return B.filled(B.burden_fractions(V.windows(s, d), "is_af"))


def burden_wide(s, d):
    wide = B.burden_wide(_profile(s, d))
    return wide.select("patient_id", *[_r(c) for c in wide.columns[1:]])


def hourly_matrix(s, d):
    return S.to_long(B.burden_wide(_profile(s, d))).select("patient_id", "time_bin", _r("burden"))


def profile_arrays(s, d):
    """Profiles as arrays and back again."""
    arrays = S.to_array(_profile(s, d))
    return S.from_array(arrays).select("patient_id", F.col("time_bin").cast("int").alias("time_bin"), _r("burden"))


def _clock(s, d):
    m = V.meta(s, d)
    clock = F.concat(F.lpad(F.col("start_hour").cast("string"), 2, "0"), F.lit(":"), F.lpad(F.col("start_minute").cast("string"), 2, "0"), F.lit(":00"))
    return m.select("data_id", clock.alias("holter_start_time"))


def _absolute(s, d):
    return E.absolute_window_time(E.attach_recording_start(V.windows(s, d), _clock(s, d)))


def shifted_burden(s, d):
    rows = B.burden_fractions(_absolute(s, d), "is_af", time="window_start")
    return rows.select("patient_id", "time_bin", "positive", "total", _r("burden"))


def record_ids(s, d):
    return V.windows(s, d).select(S.record_id(F.col("patient_id")).alias("rec_id")).groupBy("rec_id").agg(F.count("*").alias("n"))


def encode_ids(s, d):
    rows = S.encoded_ids(V.windows(s, d).select(F.col("patient_id").cast("string").alias("patient_id")))
    return rows.groupBy("patient_id", "id_code").agg(F.count("*").alias("n"))


def burden_from_two(s, d):
    w = V.windows(s, d)
    rows = B.burden_of_two(w, w.filter("is_af = 1"))
    return rows.select("patient_id", "time_bin", "positive", "total", _r("burden"))


def select_patients(s, d):
    w = V.windows(s, d)
    return E.select_patients(w, w.filter("proba > 0.9")).select("patient_id", "event_id")


def event_statistics(s, d):
    w = V.windows(s, d)
    recordings = w.groupBy("patient_id").agg((F.max("end_time") - F.min("start_time")).alias("rec_length"))
    rows = E.event_statistics(E.merge_events(w, "is_af", GAP), recordings)
    return rows.select("patient_id", "n_events", "max_event_sec", "min_event_sec", _r("af_burden", 9))


def window_times_join(s, d):
    w = V.windows(s, d)
    return E.window_times_for_predictions(w.select("patient_id", "prec_window", "proba"), w).select("patient_id", "prec_window", "start_time", "end_time", "proba")


def first_windows(s, d):
    """The first rows of an ordered table."""
    return V.windows(s, d).orderBy("patient_id", "prec_window").limit(50).select("patient_id", "prec_window", "proba")


def top_windows(s, d):
    """The three most certain windows of each patient."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("patient_id").orderBy(F.desc("proba"), "prec_window")
    rows = V.windows(s, d).withColumn("place", F.row_number().over(w)).filter("place <= 3")
    return rows.select("patient_id", "place", "prec_window", "proba")


def all_windows(s, d):
    """Two tables of windows put together, and what is distinct in them."""
    w = V.windows(s, d).select("patient_id", "prec_window", "pred")
    both = w.filter("pred = 1").unionByName(w.filter("pred = 0"))
    return both.groupBy("patient_id").agg(F.count("*").alias("n_rows"), F.countDistinct("prec_window").alias("n_windows"))


def clock_formats(s, d):
    forms = F.when(F.col("start_hour") % 3 == 0, F.col("holter_start_time")).when(F.col("start_hour") % 3 == 1, F.concat(F.lit("2024-03-05 "), "holter_start_time")).otherwise("unknown")
    rows = V.meta(s, d).join(_clock(s, d), "data_id")
    return rows.select("data_id", S.clock_seconds(forms).alias("start_recording"))


QUERIES = {
    "burden_wide": burden_wide,
    "burden_long": lambda s, d: _profile(s, d).select("patient_id", "time_bin", _r("burden")),
    "burden_all_bins": lambda s, d: B.filled(B.burden_fractions(V.windows(s, d), "is_af"), "all").select("patient_id", "time_bin", _r("burden")),
    "burden_fractions": lambda s, d: B.burden_fractions(V.windows(s, d), "is_af").select("patient_id", "time_bin", "positive", "total", _r("burden")),
    "burden_from_two": burden_from_two,
    "hourly_matrix": hourly_matrix,
    "profile_arrays": profile_arrays,
    "hourly_counts": lambda s, d: B.hourly_counts(V.windows(s, d)),
    "population_hourly": lambda s, d: B.population_hourly(V.windows(s, d)),
    "mean_burden": lambda s, d: B.mean_burden(_profile(s, d)).select("patient_id", _r("mean_burden")),
    "cohort_summary": lambda s, d: B.cohort_summary(V.windows(s, d), "is_af").select("n_rows", "n_patients", "n_positive", "n_positive_patients", _r("positive_pct")),
    "positive_windows": lambda s, d: S.positive(V.windows(s, d)).select("patient_id", "prec_window"),
    "recording_clock_join": lambda s, d: E.attach_recording_start(V.windows(s, d), _clock(s, d)).select("patient_id", "prec_window", "start_recording"),
    "clock_formats": clock_formats,
    "absolute_time": lambda s, d: _absolute(s, d).select("patient_id", "prec_window", "window_start", S.hour_bin(F.col("window_start")).alias("time_bin")),
    "shifted_burden": shifted_burden,
    "record_ids": record_ids,
    "encode_ids": encode_ids,
    "select_patients": select_patients,
    "merge_events": lambda s, d: E.merge_events(V.windows(s, d), "is_af", GAP),
    "event_statistics": event_statistics,
    "window_times_join": window_times_join,
    "shape_predictions": lambda s, d: E.shape_predictions(V.windows(s, d), 0.25),
    "first_windows": first_windows,
    "top_windows": top_windows,
    "all_windows": all_windows,
}

_BIN = "CAST(((CAST(trunc(start_time / 3600) AS BIGINT) % 24) + 24) % 24 AS INTEGER)"
_FRACTIONS = f"f AS (SELECT patient_id, {_BIN} AS time_bin, CAST(sum(is_af) AS BIGINT) AS positive, count(*) AS total, CAST(sum(is_af) AS DOUBLE) / count(*) AS burden FROM v_windows GROUP BY ALL)"
_FILLED = f"{_FRACTIONS}, m AS (SELECT patient_id, median(burden) AS mid FROM f GROUP BY 1), g AS (SELECT patient_id, mid, time_bin FROM m CROSS JOIN (SELECT DISTINCT time_bin FROM f)), p AS (SELECT patient_id, time_bin, coalesce(burden, mid) AS burden FROM g LEFT JOIN f USING (patient_id, time_bin))"
_HOURS = ", ".join(f"round(max(CASE WHEN time_bin = {b} THEN burden END), 6) AS h{b:02d}" for b in range(24))
_CLOCK = "c AS (SELECT CASE WHEN length(data_id) < 3 THEN lpad(data_id, 3, '0') ELSE data_id END AS id, CAST(start_hour * 3600 + start_minute * 60 AS DOUBLE) AS start_recording FROM v_meta)"
_ID = "CASE WHEN length(CAST(patient_id AS STRING)) < 3 THEN lpad(CAST(patient_id AS STRING), 3, '0') ELSE CAST(patient_id AS STRING) END"
_EVENTS = f"""q AS (SELECT *, CASE WHEN start_time - lag(end_time) OVER (PARTITION BY patient_id ORDER BY start_time, end_time) > {GAP} THEN 1 ELSE 0 END AS n FROM v_windows WHERE is_af = 1),
  i AS (SELECT *, CAST(sum(n) OVER (PARTITION BY patient_id ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_id2 FROM q),
  e AS (SELECT patient_id, event_id2 AS event_id, min(start_time) AS start_sec, max(end_time) AS end_sec, 'AFIB' AS rhythm FROM i GROUP BY ALL)"""

ORACLES = {
    "burden_wide": duck(f"WITH {_FILLED} SELECT patient_id, {_HOURS}, round(avg(burden), 6) AS mean_burden FROM p GROUP BY patient_id", W),
    "burden_long": duck(f"WITH {_FILLED} SELECT patient_id, time_bin, round(burden, 6) AS burden FROM p", W),
    "burden_all_bins": duck(
        f"WITH {_FRACTIONS}, m AS (SELECT patient_id, median(burden) AS mid FROM f GROUP BY 1), g AS (SELECT patient_id, mid, CAST(b AS INTEGER) AS time_bin FROM m CROSS JOIN range(24) t(b)) SELECT patient_id, time_bin, round(coalesce(burden, mid), 6) AS burden FROM g LEFT JOIN f USING (patient_id, time_bin)",
        W,
    ),
    "burden_fractions": duck(f"WITH {_FRACTIONS} SELECT patient_id, time_bin, positive, total, round(burden, 6) AS burden FROM f", W),
    "burden_from_two": duck(
        f"WITH a AS (SELECT patient_id, {_BIN} AS time_bin, count(*) AS t FROM v_windows GROUP BY ALL), b AS (SELECT patient_id, {_BIN} AS time_bin, count(*) AS p FROM v_windows WHERE is_af = 1 GROUP BY ALL) SELECT patient_id, time_bin, coalesce(p, 0) AS positive, coalesce(t, 0) AS total, round(CAST(coalesce(p, 0) AS DOUBLE) / nullif(t, 0), 6) AS burden FROM a FULL JOIN b USING (patient_id, time_bin)",
        W,
    ),
    "hourly_matrix": duck(f"WITH {_FILLED} SELECT patient_id, time_bin, round(burden, 6) AS burden FROM p", W),
    "profile_arrays": duck(f"WITH {_FILLED} SELECT patient_id, time_bin, round(burden, 6) AS burden FROM p", W),
    "hourly_counts": duck(f"SELECT patient_id, {_BIN} AS time_bin, count(*) AS n FROM v_windows GROUP BY ALL", W),
    "population_hourly": duck(f"SELECT {_BIN} AS time_bin, count(*) AS n FROM v_windows GROUP BY ALL", W),
    "mean_burden": duck(f"WITH {_FILLED} SELECT patient_id, round(avg(burden), 6) AS mean_burden FROM p GROUP BY 1", W),
    "cohort_summary": duck("SELECT count(*) AS n_rows, count(DISTINCT patient_id) AS n_patients, count(*) FILTER (is_af = 1) AS n_positive, count(DISTINCT patient_id) FILTER (is_af = 1) AS n_positive_patients, round(100.0 * count(*) FILTER (is_af = 1) / CAST(count(*) AS DOUBLE), 6) AS positive_pct FROM v_windows", W),
    "positive_windows": duck("SELECT patient_id, prec_window FROM v_windows WHERE pred = 1", W),
    "recording_clock_join": duck(f"WITH {_CLOCK} SELECT patient_id, prec_window, start_recording FROM v_windows JOIN c ON {_ID} = c.id", W, M),
    "clock_formats": duck("SELECT data_id, CASE WHEN start_hour % 3 < 2 THEN CAST(start_hour * 3600 + start_minute * 60 AS DOUBLE) END AS start_recording FROM v_meta", M),
    "absolute_time": duck(f"WITH {_CLOCK} SELECT patient_id, prec_window, start_recording + start_time AS window_start, CAST(CAST(trunc((start_recording + start_time) / 3600) AS BIGINT) % 24 AS INTEGER) AS time_bin FROM v_windows JOIN c ON {_ID} = c.id", W, M),
    "shifted_burden": duck(f"WITH {_CLOCK} SELECT patient_id, CAST(CAST(trunc((start_recording + start_time) / 3600) AS BIGINT) % 24 AS INTEGER) AS time_bin, CAST(sum(is_af) AS BIGINT) AS positive, count(*) AS total, round(CAST(sum(is_af) AS DOUBLE) / count(*), 6) AS burden FROM v_windows JOIN c ON {_ID} = c.id GROUP BY ALL", W, M),
    "record_ids": duck(f"SELECT {_ID} AS rec_id, count(*) AS n FROM v_windows GROUP BY ALL", W),
    "encode_ids": duck("WITH i AS (SELECT CAST(patient_id AS STRING) AS patient_id, count(*) AS n FROM v_windows GROUP BY ALL) SELECT patient_id, row_number() OVER (ORDER BY patient_id) - 1 AS id_code, n FROM i", W),
    "select_patients": duck("SELECT patient_id, event_id FROM v_windows WHERE patient_id IN (SELECT patient_id FROM v_windows WHERE proba > 0.9)", W),
    "merge_events": duck(f"WITH {_EVENTS} SELECT * FROM e", W),
    "event_statistics": duck(
        f"WITH {_EVENTS}, r AS (SELECT patient_id, max(end_time) - min(start_time) AS len FROM v_windows GROUP BY 1), s AS (SELECT patient_id, count(*) AS n, max(end_sec - start_sec) AS hi, min(end_sec - start_sec) AS lo, sum(end_sec - start_sec) AS t FROM e GROUP BY 1) SELECT patient_id, coalesce(n, 0) AS n_events, coalesce(hi, 0) AS max_event_sec, coalesce(lo, 0) AS min_event_sec, round(coalesce(t / nullif(len, 0), 0), 9) AS af_burden FROM r LEFT JOIN s USING (patient_id)",
        W,
    ),
    "window_times_join": duck("SELECT patient_id, prec_window, start_time, end_time, proba FROM v_windows", W),
    "shape_predictions": duck("SELECT patient_id, prec_window, start_time, end_time, proba, proba > 0.25 AS pred FROM v_windows", W),
    "first_windows": duck("SELECT patient_id, prec_window, proba FROM v_windows ORDER BY patient_id, prec_window LIMIT 50", W),
    "top_windows": duck("SELECT patient_id, CAST(place AS INTEGER) AS place, prec_window, proba FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY proba DESC, prec_window) AS place FROM v_windows) WHERE place <= 3", W),
    "all_windows": duck("WITH u AS (SELECT patient_id, prec_window FROM v_windows WHERE pred = 1 UNION ALL SELECT patient_id, prec_window FROM v_windows WHERE pred = 0) SELECT patient_id, count(*) AS n_rows, count(DISTINCT prec_window) AS n_windows FROM u GROUP BY 1", W),
}
