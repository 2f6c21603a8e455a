"""Queries of detector evaluation over the derived window table."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatfold.functions import scalars as S
from beatfold.operators import burden as B
from beatfold.operators import evaluation as E
from beatfold.operators import events as J
from beatfold.sources import views as V
from beatfold.sources.views import duck

W = "v_windows"


def _r(df, *cols, n=9):
    return df.select(*[F.round(c, n).alias(c) if c in cols else c for c in df.columns])


def _cum(s, d, **kw):
    return E.cumulative(E.by_score(V.windows(s, d), "true_label", "proba"), **kw)


def attach_truth(s, d):
    w = V.windows(s, d)
    return J.attach_truth(w.select("patient_id", "prec_window", "proba"), w).withColumn("true_label", F.col("true_label").cast("double"))


def metrics(s, d):
    return _r(E.classification_metrics(E.confusion(V.windows(s, d), "true_label", "pred"), 2.0), "accuracy", "se", "sp", "ppv", "npv", "f_beta")


def evaluate(s, d):
    return _r(E.evaluate(V.windows(s, d), 0.25), "accuracy", "se", "sp", "ppv", "npv", "f_beta", "auroc", "aucpr")


def evaluate_reversed(s, d):
    return _r(E.evaluate(V.windows(s, d), None, -1), "accuracy", "se", "sp", "ppv", "npv", "f_beta", "auroc", "aucpr")


def threshold_labels(s, d):
    w = V.windows(s, d)
    return w.select("patient_id", "prec_window", S.over_threshold(F.col("proba"), 0.4).alias("pred"), S.oriented(F.col("proba"), -1).alias("score"))


def _burdens(s, d):
    return B.af_burden(V.windows(s, d), "true_label", "pred")


def patient_fbeta_curve(s, d):
    labels = V.windows(s, d).groupBy("patient_id").agg((F.sum("is_af") * 5 > F.count("*") * 2).cast("int").alias("label"))
    return _r(E.patient_burden_fbeta_curve(_burdens(s, d), labels, 1.0), "threshold", "prec", "recall", "f_beta", n=6)


QUERIES = {
    "attach_truth": attach_truth,
    "unmatched_truth": lambda s, d: J.unmatched(attach_truth(s, d)),
    "threshold_labels": threshold_labels,
    "confusion": lambda s, d: E.confusion(V.windows(s, d), "true_label", "pred"),
    "metrics": metrics,
    "roc": lambda s, d: _r(E.roc_curve(_cum(s, d)), "threshold", "fpr", "tpr"),
    "roc_ranged": lambda s, d: _r(E.roc_curve(_cum(s, d, parts=8)), "threshold", "fpr", "tpr"),
    "auroc": lambda s, d: _r(E.auroc(_cum(s, d)), "auroc"),
    "pr": lambda s, d: _r(E.pr_curve(_cum(s, d)), "threshold", "prec", "recall"),
    "aucpr": lambda s, d: _r(E.aucpr(_cum(s, d)), "aucpr"),
    "best_fbeta": lambda s, d: _r(E.best_threshold_fbeta(E.pr_curve(_cum(s, d)), 1.0), "threshold", "f_beta"),
    "best_se_sp": lambda s, d: _r(E.best_threshold_se_sp(E.roc_curve(_cum(s, d))), "threshold", "se", "sp"),
    "evaluate": evaluate,
    "evaluate_reversed": evaluate_reversed,
    "af_burden": lambda s, d: _r(_burdens(s, d), "true_burden", "pred_burden", n=6),
    "burden_error": lambda s, d: _r(E.mean_abs_burden_error(_burdens(s, d)), "mean_abs_error", n=6),
    "burden_error_curve": lambda s, d: _r(E.burden_error_by_threshold(V.windows(s, d)), "threshold", "mean_abs_error", n=6),
    "best_burden_threshold": lambda s, d: _r(E.best_threshold_burden(E.burden_error_by_threshold(V.windows(s, d))), "threshold", "mean_abs_error", n=6),
    "patient_fbeta_curve": patient_fbeta_curve,
}

_EPS = "CAST(2.220446049250313e-16 AS DOUBLE)"


def _confusion(y="true_label", p="pred", src="v_windows"):
    return f"x AS (SELECT CAST(count(*) FILTER ({y} = 0 AND {p} = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER ({y} = 0 AND {p} = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER ({y} = 1 AND {p} = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER ({y} = 1 AND {p} = 1) AS DOUBLE) AS tp FROM {src})"


def _metrics(beta):
    b = beta * beta
    return f"""y AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fn, 0), {_EPS}) AS se, tn / nullif(tn + fp, 0) AS sp, coalesce(tp / nullif(tp + fp, 0), {_EPS}) AS ppv, tn / nullif(tn + fn, 0) AS npv FROM x),
  z AS (SELECT round(accuracy, 9) AS accuracy, round(se, 9) AS se, round(sp, 9) AS sp, round(ppv, 9) AS ppv, round(npv, 9) AS npv, round(coalesce({1 + b} * ppv * se / nullif({b} * ppv + se, 0), {_EPS}), 9) AS f_beta FROM y)"""


def _cumulative(src="v_windows", y="true_label", score="proba"):
    return f"""s AS (SELECT {score} AS score, CAST(sum({y}) AS BIGINT) AS pos, CAST(sum(1 - {y}) AS BIGINT) AS neg FROM {src} GROUP BY 1),
  c AS (SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS DOUBLE) AS fp, (SELECT CAST(sum(pos) AS DOUBLE) FROM s) AS p, (SELECT CAST(sum(neg) AS DOUBLE) FROM s) AS n FROM s)"""


_ROC = """k AS (SELECT *, greatest(abs(lag(tp) OVER w + lead(tp) OVER w - 2 * tp), abs(lag(fp) OVER w + lead(fp) OVER w - 2 * fp)) AS d FROM c WINDOW w AS (ORDER BY score DESC)),
  roc AS (SELECT score AS threshold, fp / nullif(n, 0) AS fpr, tp / nullif(p, 0) AS tpr FROM k WHERE d IS NULL OR d <> 0 UNION ALL SELECT max(score) + 1, 0.0, 0.0 FROM c)"""
_PR = "pr AS (SELECT score AS threshold, tp / (tp + fp) AS prec, tp / p AS recall FROM c UNION ALL SELECT NULL, 1.0, 0.0)"
_AUROC = "a AS (SELECT round(sum((fp - coalesce(f0, 0)) * (tp + coalesce(t0, 0)) / 2) / (max(p) * max(n)), 9) AS auroc FROM (SELECT *, lag(fp) OVER w AS f0, lag(tp) OVER w AS t0 FROM c WINDOW w AS (ORDER BY score DESC)))"
_AUCPR = "q AS (SELECT round(sum((recall - r0) * (prec + p0) / 2), 9) AS aucpr FROM (SELECT *, lag(recall) OVER w AS r0, lag(prec) OVER w AS p0 FROM pr WINDOW w AS (ORDER BY threshold DESC NULLS FIRST)))"
_BURDENS = "b AS (SELECT patient_id, 100 * sum(dur_sec * true_label) / nullif(sum(dur_sec), 0) AS true_burden, 100 * sum(dur_sec * pred) / nullif(sum(dur_sec), 0) AS pred_burden FROM v_windows GROUP BY 1)"
_ERRORS = """e AS (SELECT i, CAST(i AS INTEGER) AS ii, avg(err) AS mean_abs_error FROM (
  SELECT t.i, patient_id, abs(sum(CASE WHEN proba > t.i * CAST(0.01 AS DOUBLE) THEN dur_sec ELSE 0 END) - sum(dur_sec * true_label)) * 100 / sum(dur_sec) AS err FROM v_windows CROSS JOIN range(101) t(i) GROUP BY ALL HAVING sum(dur_sec) > 0) GROUP BY ALL)"""
_TRUTH = "SELECT w.patient_id, w.prec_window, w.proba, CAST(t.true_label AS DOUBLE) AS true_label FROM v_windows w LEFT JOIN v_windows t ON w.patient_id = t.patient_id AND w.prec_window = t.prec_window"
_ROC_OUT = duck(f"WITH {_cumulative()}, {_ROC} SELECT round(threshold, 9) AS threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM roc", W)
_F1 = f"coalesce(2 * prec * recall / nullif(prec + recall, 0), {_EPS})"

ORACLES = {
    "attach_truth": duck(_TRUTH, W),
    "unmatched_truth": duck(f"SELECT count(*) AS n_rows, count(*) FILTER (true_label IS NULL) AS n_unmatched FROM ({_TRUTH})", W),
    "threshold_labels": duck("SELECT patient_id, prec_window, CAST(proba > 0.4 AS INTEGER) AS pred, -proba AS score FROM v_windows", W),
    "confusion": duck(f"WITH {_confusion()} SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM x", W),
    "metrics": duck(f"WITH {_confusion()}, {_metrics(2)} SELECT * FROM z", W),
    "roc": _ROC_OUT,
    "roc_ranged": _ROC_OUT,
    "auroc": duck(f"WITH {_cumulative()}, {_AUROC} SELECT * FROM a", W),
    "pr": duck(f"WITH {_cumulative()}, {_PR} SELECT round(threshold, 9) AS threshold, round(prec, 9) AS prec, round(recall, 9) AS recall FROM pr", W),
    "aucpr": duck(f"WITH {_cumulative()}, {_PR}, {_AUCPR} SELECT * FROM q", W),
    "best_fbeta": duck(f"WITH {_cumulative()}, {_PR} SELECT round(threshold, 9) AS threshold, round({_F1}, 9) AS f_beta FROM pr WHERE threshold IS NOT NULL ORDER BY round({_F1}, 12) DESC, threshold LIMIT 1", W),
    "best_se_sp": duck(f"WITH {_cumulative()}, {_ROC} SELECT round(threshold, 9) AS threshold, round(tpr, 9) AS se, round(1 - fpr, 9) AS sp FROM roc ORDER BY round(abs(tpr - (1 - fpr)), 12), threshold DESC LIMIT 1", W),
    "evaluate": duck(f"WITH v2 AS (SELECT true_label, proba, CAST(proba > 0.25 AS INTEGER) AS p FROM v_windows), {_confusion('true_label', 'p', 'v2')}, {_metrics(1)}, {_cumulative()}, {_AUROC}, {_PR}, {_AUCPR} SELECT * FROM z, a, q", W),
    "evaluate_reversed": duck(f"WITH {_confusion()}, {_metrics(1)}, {_cumulative(score='-proba')}, {_AUROC}, {_PR}, {_AUCPR} SELECT * FROM z, a, q", W),
    "af_burden": duck(f"WITH {_BURDENS} SELECT patient_id, round(true_burden, 6) AS true_burden, round(pred_burden, 6) AS pred_burden FROM b", W),
    "burden_error": duck(f"WITH {_BURDENS} SELECT round(avg(coalesce(abs(pred_burden - true_burden), 0)), 6) AS mean_abs_error FROM b", W),
    "burden_error_curve": duck(f"WITH {_ERRORS} SELECT ii AS i, round(i / CAST(100 AS DOUBLE), 6) AS threshold, round(mean_abs_error, 6) AS mean_abs_error FROM e", W),
    "best_burden_threshold": duck(f"WITH {_ERRORS} SELECT round(i / CAST(100 AS DOUBLE), 6) AS threshold, round(mean_abs_error, 6) AS mean_abs_error FROM e ORDER BY round(e.mean_abs_error, 9), i LIMIT 1", W),
    "patient_fbeta_curve": duck(
        f"WITH {_BURDENS}, l AS (SELECT patient_id, CAST(sum(is_af) * 5 > count(*) * 2 AS INTEGER) AS label FROM v_windows GROUP BY 1), bl AS (SELECT label, pred_burden / 100 AS pred_share FROM b JOIN l USING (patient_id)), {_cumulative('bl', 'label', 'pred_share')}, {_PR} SELECT round(threshold, 6) AS threshold, round(prec, 6) AS prec, round(recall, 6) AS recall, round({_F1}, 6) AS f_beta FROM pr WHERE threshold IS NOT NULL",
        W,
    ),
}
