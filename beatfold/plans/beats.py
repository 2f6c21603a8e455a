"""Queries of beats, rhythm labels and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatfold.operators import beats as T
from beatfold.operators import scoring
from beatfold.sources import views as V
from beatfold.sources.views import duck

Bt, W, P = "v_beats", "v_windows", "v_profiles"
TICKS = 6000  # 30 s at 200 Hz
EXCLUDED = ((0.0, 30.0), (900.0, 1000.0))


def beat_validation(s, d):
    return T.validation_report(T.validate_beats(V.beats(s, d), most=1.3))


def rr_windows(s, d):
    w = T.rr_windows(V.beats(s, d))
    return w.select("patient_id", "prec_window", "start_time", "end_time", "n_beats", F.round("dur_sec", 6).alias("dur_sec"), F.element_at("rr", 1).alias("first_rr"), F.element_at("rr", 60).alias("last_rr"))


def _recordings(s, d):
    return V.beats(s, d).groupBy("patient_id").agg(F.max("rr_time").alias("duration"))


def _ecg_grid(s, d):
    return T.window_times(_recordings(s, d), 30.0, "duration", "patient_id")


def beats_in_spans(s, d):
    b = V.beats(s, d)
    spans = T.rr_windows(b).select("patient_id", "prec_window", "start_time", "end_time")
    return T.beats_in_spans(b.select("patient_id", "seq", "rr_time"), spans, 60.0).groupBy("patient_id", "prec_window").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def ecg_windows(s, d):
    w = T.ecg_windows(V.profiles(s, d), 24, "profile", "vec_id")
    return w.select("vec_id", "prec_window", F.element_at("samples", 1).alias("first_v"), F.element_at("samples", 24).alias("last_v"))


def preceding_count(s, d):
    b = V.beats(s, d)
    patients = b.select("patient_id").distinct()
    excluded = patients.withColumn("e", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("b")) for a, z in EXCLUDED]))).select("patient_id", "e.a", "e.b")
    return T.preceding_window_count(T.rhythm_window_bounds(b), excluded)


def consecutive_runs(s, d):
    w = V.windows(s, d).withColumn("start_time", F.floor(F.col("start_time") / 21600))
    return T.consecutive_runs(w.dropDuplicates(["patient_id", "start_time"]), 1.0).select("patient_id", "start_time", "prec", "succ")


def run_median(s, d):
    w = V.windows(s, d).withColumn("start_time", F.floor(F.col("start_time") / 21600))
    return T.consecutive_runs(w.dropDuplicates(["patient_id", "start_time"])).select("patient_id", "start_time", "prec", "succ")


def context_size(s, d):
    c = T.window_context(V.windows(s, d), F.col("proba"))
    known = F.filter("context", lambda x: x.isNotNull())
    return c.select("patient_id", "prec_window", F.size("context").alias("size"), F.size(known).alias("known"), F.round(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def score_windows(s, d):
    """Windows of beats, scored by the spread of their intervals."""
    scored = scoring.score_windows(T.rr_windows(V.beats(s, d)), lambda x, prec: x.std(axis=1), threshold=0.28)
    return scored.select("patient_id", "prec_window", F.round("proba", 6).alias("proba"), "pred")


def score_sequences(s, d):
    """Windows with nine preceding ones, scored by the mean interval over all that are there."""
    c = T.window_context(T.rr_windows(V.beats(s, d)), F.col("rr")).select("patient_id", "prec_window", "context")
    scored = scoring.score_sequences(c, lambda x, prec: x.sum(axis=(1, 2)) / (x > 0).sum(axis=(1, 2)), threshold=0.9)
    return scored.select("patient_id", "prec_window", F.round("proba", 6).alias("proba"))


QUERIES = {
    "beat_validation": beat_validation,
    "rr_from_peaks": lambda s, d: T.rr_from_peaks(V.beats(s, d), 200.0),
    "fill_rhythm": lambda s, d: T.fill_rhythm(V.beats(s, d)).select("patient_id", "seq", "rhythm"),
    "rr_windows": rr_windows,
    "rr_window_labels": lambda s, d: T.rr_window_labels(V.beats(s, d)),
    "drop_short": lambda s, d: T.drop_short_records(V.beats(s, d), 600).groupBy("patient_id").agg(F.count("*").alias("n")),
    "window_times": _ecg_grid,
    "beats_in_windows": lambda s, d: T.beats_in_windows(V.beats(s, d), TICKS).groupBy("patient_id", "prec_window").agg(F.count("*").alias("n"), F.sum("ticks").alias("ticks")),
    "beats_in_spans": beats_in_spans,
    "ecg_window_labels": lambda s, d: T.ecg_window_labels(V.beats(s, d), _ecg_grid(s, d), TICKS),
    "ecg_windows": ecg_windows,
    "recording_duration": lambda s, d: T.recording_duration(V.profiles(s, d).select(F.col("label").alias("patient_id"), F.col("profile").alias("samples")), 200.0),
    "select_signal": lambda s, d: T.select_signal(V.profiles(s, d).select("vec_id", F.when(F.col("vec_id") % 3 == 0, 100.0).otherwise(200.0).alias("fs"), F.array(F.slice("profile", 1, 32), F.slice("profile", 33, 32)).alias("leads")), 200.0, 2).select("vec_id", F.size("samples").alias("n"), F.element_at("samples", 1).alias("first_v")),
    "window_bounds": lambda s, d: T.rhythm_window_bounds(V.beats(s, d)),
    "preceding_count": preceding_count,
    "consecutive_runs": consecutive_runs,
    "consecutive_runs_median": run_median,
    "window_positions": lambda s, d: T.window_positions(V.windows(s, d), ties="prec_window").select("patient_id", "prec_window", "prec", "succ"),
    "window_context": context_size,
    "score_windows": score_windows,
    "score_sequences": score_sequences,
}

_FILL = """f AS (SELECT patient_id, seq, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY seq ROWS UNBOUNDED PRECEDING), first_value(k IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '(N') AS rhythm, sample
  FROM (SELECT *, CASE WHEN rhythm NOT IN ('', 'None') THEN rhythm END AS k FROM v_beats))"""
_BLOCK = "CAST((row_number() OVER (PARTITION BY patient_id ORDER BY seq) - 1) // 60 AS INTEGER)"
_RRW = f"""n AS (SELECT *, {_BLOCK} AS prec_window FROM v_beats),
  w AS (SELECT patient_id, prec_window, list(rr_data ORDER BY seq) AS rr, min(rr_time) AS start_time, max(rr_time) AS end_time, count(*) AS n_beats, sum(rr_data) AS dur_sec FROM n GROUP BY ALL HAVING count(*) = 60)"""
_GRID = "r AS (SELECT patient_id, max(rr_time) AS duration FROM v_beats GROUP BY 1), t AS (SELECT patient_id, duration, CAST(unnest(range(0, CAST(greatest(1, floor(duration / 30)) AS BIGINT))) AS INTEGER) AS prec_window FROM r)"
_MIDDLES = """k AS (SELECT patient_id, rr_time AS t, row_number() OVER (PARTITION BY patient_id ORDER BY rr_time) - 1 AS i, lag(rr_time) OVER (PARTITION BY patient_id ORDER BY rr_time) AS p, count(*) OVER (PARTITION BY patient_id) AS n FROM v_beats),
  m AS (SELECT patient_id, i, n, CASE WHEN i = 0 THEN greatest(0.0, t - 1) ELSE (t + p) / 2 END AS m FROM k UNION ALL SELECT patient_id, n, n, t + 1 FROM k WHERE i = n - 1)"""
_BOUNDS = _MIDDLES + """,
  b AS (SELECT s.patient_id, CAST(s.i // 60 AS INTEGER) AS prec_window, s.m AS start_time, e.m AS end_time FROM m s JOIN m e ON s.patient_id = e.patient_id AND e.i = s.i + 61 WHERE s.i % 60 = 0)"""
_RUNS = """d AS (SELECT DISTINCT patient_id, CAST(floor(start_time / 21600) AS BIGINT) AS start_time FROM v_windows),
  g AS (SELECT *, start_time - lag(start_time) OVER (PARTITION BY patient_id ORDER BY start_time) AS x FROM d),
  u AS (SELECT *, {step} AS step FROM g),
  c AS (SELECT *, sum(CASE WHEN step > 0 AND abs(x - step) > 0.001 THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id ORDER BY start_time ROWS UNBOUNDED PRECEDING) AS r FROM u)
  SELECT patient_id, start_time, row_number() OVER (PARTITION BY patient_id, r ORDER BY start_time) AS prec, row_number() OVER (PARTITION BY patient_id, r ORDER BY start_time DESC) AS succ FROM c"""

ORACLES = {
    "beat_validation": duck("SELECT CASE WHEN rr_data IS NULL THEN 'null_rr' WHEN rr_data > 1.3 THEN 'rr_too_long' WHEN rr_time IS NULL THEN 'non_numeric_time' ELSE 'ok' END AS reason, count(*) AS n FROM v_beats GROUP BY 1", Bt),
    "rr_from_peaks": duck("SELECT * FROM (SELECT patient_id, row_number() OVER w - 1 AS seq, (sample - lag(sample) OVER w) / CAST(200 AS DOUBLE) AS rr_data, sample / CAST(200 AS DOUBLE) AS rr_time FROM v_beats WINDOW w AS (PARTITION BY patient_id ORDER BY sample)) WHERE rr_data IS NOT NULL", Bt),
    "fill_rhythm": duck(f"WITH {_FILL} SELECT patient_id, seq, rhythm FROM f", Bt),
    "rr_windows": duck(f"WITH {_RRW} SELECT patient_id, prec_window, start_time, end_time, n_beats, round(dur_sec, 6) AS dur_sec, rr[1] AS first_rr, rr[60] AS last_rr FROM w", Bt),
    "rr_window_labels": duck(f"WITH {_FILL}, n AS (SELECT *, {_BLOCK} AS prec_window FROM f) SELECT patient_id, prec_window, CAST(count(*) FILTER (rhythm = '(AFIB') >= 30 AS INTEGER) AS true_label FROM n GROUP BY ALL HAVING count(*) = 60", Bt),
    "drop_short": duck("SELECT patient_id, count(*) AS n FROM v_beats GROUP BY 1 HAVING count(*) >= 600", Bt),
    "window_times": duck(f"WITH {_GRID} SELECT patient_id, prec_window, prec_window * CAST(30 AS DOUBLE) AS start_time, least(prec_window * CAST(30 AS DOUBLE) + 30, duration) AS end_time FROM t", Bt),
    "beats_in_windows": duck("SELECT patient_id, CAST(ceil(sample / CAST(6000 AS DOUBLE)) - 1 AS INTEGER) AS prec_window, count(*) AS n, CAST(sum(ticks) AS BIGINT) AS ticks FROM v_beats WHERE sample > 0 GROUP BY ALL", Bt),
    "beats_in_spans": duck(f"WITH {_RRW} SELECT b.patient_id, prec_window, count(*) AS n, min(seq) AS first_seq FROM v_beats b JOIN w ON b.patient_id = w.patient_id AND start_time < rr_time AND rr_time <= end_time GROUP BY ALL", Bt),
    "ecg_window_labels": duck(f"WITH {_FILL}, {_GRID}, c AS (SELECT patient_id, CAST(ceil(sample / CAST(6000 AS DOUBLE)) - 1 AS INTEGER) AS prec_window, count(*) AS n, count(*) FILTER (rhythm = '(AFIB') AS af FROM f GROUP BY ALL) SELECT patient_id, prec_window, coalesce(CAST(af * 2 > n AS INTEGER), 0) AS true_label FROM t LEFT JOIN c USING (patient_id, prec_window)", Bt),
    "ecg_windows": duck("SELECT vec_id, CAST(i AS INTEGER) AS prec_window, profile[i * 24 + 1] AS first_v, profile[i * 24 + 24] AS last_v FROM (SELECT vec_id, profile, unnest(range(0, len(profile) // 24)) AS i FROM v_profiles)", P),
    "recording_duration": duck("SELECT label AS patient_id, CAST(sum(len(profile)) AS BIGINT) AS n_samples, CAST(sum(len(profile)) AS DOUBLE) / 200 AS duration FROM v_profiles GROUP BY 1", P),
    "select_signal": duck("SELECT vec_id, CAST(32 AS INTEGER) AS n, profile[33] AS first_v FROM v_profiles WHERE vec_id % 3 <> 0", P),
    "window_bounds": duck(f"WITH {_MIDDLES}, b AS (SELECT patient_id, i, m AS start_time, lead(m, 61) OVER (PARTITION BY patient_id ORDER BY i) AS end_time FROM m) SELECT patient_id, CAST(i // 60 AS INTEGER) AS prec_window, start_time, end_time FROM b WHERE i % 60 = 0 AND end_time IS NOT NULL", Bt),
    "preceding_count": duck(f"WITH {_BOUNDS}, x(a, z) AS (VALUES {', '.join(f'(CAST({a} AS DOUBLE), CAST({z} AS DOUBLE))' for a, z in EXCLUDED)}), k2 AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM x WHERE (start_time > a AND start_time <= z) OR (end_time > a AND end_time <= z) OR (start_time <= a AND end_time > z)) THEN 0 ELSE 1 END AS keep FROM b) SELECT patient_id, prec_window, CAST(sum(keep) OVER (PARTITION BY patient_id ORDER BY prec_window ROWS UNBOUNDED PRECEDING) AS BIGINT) AS preceding FROM k2", Bt),
    "consecutive_runs": duck(f"WITH {_RUNS.format(step='1')}", W),
    "consecutive_runs_median": duck(f"WITH {_RUNS.format(step='median(x) OVER (PARTITION BY patient_id)')}", W),
    "window_positions": duck("SELECT patient_id, prec_window, row_number() OVER (PARTITION BY patient_id ORDER BY start_time) - 1 AS prec, row_number() OVER (PARTITION BY patient_id ORDER BY start_time DESC) - 1 AS succ FROM v_windows", W),
    "window_context": duck("SELECT patient_id, prec_window, CAST(10 AS INTEGER) AS size, CAST(count(*) OVER w AS INTEGER) AS known, round(sum(proba) OVER w, 6) AS total FROM v_windows WINDOW w AS (PARTITION BY patient_id ORDER BY prec_window ROWS 9 PRECEDING)", W),
    "score_windows": duck(f"WITH {_RRW}, p AS (SELECT patient_id, prec_window, sqrt(list_aggregate(list_transform(rr, lambda x: (x - list_avg(rr)) * (x - list_avg(rr))), 'avg')) AS v FROM w) SELECT patient_id, prec_window, round(v, 6) AS proba, v > 0.28 AS pred FROM p", Bt),
    "score_sequences": duck(f"WITH {_RRW} SELECT patient_id, prec_window, round(sum(dur_sec) OVER x / (60 * count(*) OVER x), 6) AS proba FROM w WINDOW x AS (PARTITION BY patient_id ORDER BY prec_window ROWS 9 PRECEDING)", Bt),
}
