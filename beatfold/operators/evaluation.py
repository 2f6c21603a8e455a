"""Evaluation of a detector: confusion, curves by score, thresholds, burden errors.

Curves: rows are first counted by score. Distinct scores are dealt by range into parts of bounded size; each part sums up its own,
and the totals of the parts before are added, so that no single task holds all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatfold.functions.scalars import EPSILON, over, over_threshold, oriented
from beatfold.sources.shared import ranged


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    y, p = F.col(label).cast("boolean"), F.col(pred).cast("boolean")
    return df.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = float(beta) ** 2
    return over(precision * recall * (1 + b), precision * b + recall)


def classification_metrics(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """accuracy, f_beta, se, sp, ppv, npv of confusion counts. Undefined se, ppv and f_beta are epsilon, undefined sp and npv null."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    eps = lambda c: F.coalesce(c, F.lit(EPSILON))
    rows = counts.select(over(tp + tn, tp + tn + fp + fn).alias("accuracy"), eps(over(tp, tp + fn)).alias("se"), over(tn, tn + fp).alias("sp"), eps(over(tp, tp + fp)).alias("ppv"), over(tn, tn + fn).alias("npv"))
    return rows.withColumn("f_beta", eps(f_beta(F.col("ppv"), F.col("se"), beta)))


def by_score(df: DataFrame, label: str = "label", score: str = "score", *keys: str) -> DataFrame:
    y = F.col(label).cast("int")
    return df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def cumulative(counts: DataFrame, parts: int | None = None) -> DataFrame:
    """(score, tp, fp, pos, neg, next_pos, next_neg, p, n): true and false positives at each distinct score and above, those at it and
    at the next lower one (null at the lowest), and all positives and negatives."""
    rows = ranged(counts.select("score", "pos", "neg"), F.desc("score"), parts)
    first = F.max_by(F.struct("pos", "neg"), "score").alias("first")
    held = sorted(rows.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), first).collect(), key=lambda r: r.part)  # a row for each part
    carry, p, n = [], 0, 0
    for i, r in enumerate(held):
        after = held[i + 1].first if i + 1 < len(held) else (None, None)
        carry.append((r.part, p, n, *after))
        p, n = p + r.pos, n + r.neg
    carry = F.broadcast(rows.sparkSession.createDataFrame(carry, "part int, above_pos long, above_neg long, after_pos long, after_neg long"))
    own = Window.partitionBy("part").orderBy(F.desc("score"))
    rows = rows.join(carry, "part").select(
        "score",
        (F.sum("pos").over(own) + F.col("above_pos")).alias("tp"),
        (F.sum("neg").over(own) + F.col("above_neg")).alias("fp"),
        "pos",
        "neg",
        F.coalesce(F.lead("pos").over(own), "after_pos").alias("next_pos"),
        F.coalesce(F.lead("neg").over(own), "after_neg").alias("next_neg"),
    )
    return rows.withColumn("p", F.lit(p).cast("long")).withColumn("n", F.lit(n).cast("long"))


def roc_curve(cum: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) without inner points on a straight line, and (0, 0) at one above the highest score."""
    highest = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    kept = cum.filter(highest | F.col("next_pos").isNull() | bend)
    first = cum.agg((F.max("score") + 1).alias("threshold")).filter("threshold IS NOT NULL").select("threshold", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return kept.select(F.col("score").alias("threshold"), over(F.col("fp"), F.col("n")).alias("fpr"), over(F.col("tp"), F.col("p")).alias("tpr")).union(first)


def auroc(cum: DataFrame) -> DataFrame:
    area = (F.col("neg") * (2 * F.col("tp") - F.col("pos"))).cast("double") / 2
    return cum.select(area.alias("a"), "p", "n").agg(over(F.sum("a"), F.max("p").cast("double") * F.max("n")).alias("auroc"))


def _precision_recall(tp: Column, fp: Column) -> tuple[Column, Column]:
    return F.coalesce(over(tp, tp + fp), F.lit(0.0)), F.coalesce(over(tp, F.col("p")), F.lit(1.0))


def pr_curve(cum: DataFrame) -> DataFrame:
    """(threshold, prec, recall), and the end point (null, 1, 0). Recall is 1 without positives."""
    prec, recall = _precision_recall(F.col("tp"), F.col("fp"))
    rows = cum.select(F.col("score").alias("threshold"), prec.alias("prec"), recall.alias("recall"))
    end = cum.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("prec"), F.lit(0.0).alias("recall"))
    return rows.union(end)


def aucpr(cum: DataFrame) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, from its end point on."""
    prec, recall = _precision_recall(F.col("tp"), F.col("fp"))
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    higher = tp + fp > 0
    before = [F.when(higher, c).otherwise(end) for c, end in zip(_precision_recall(tp, fp), (1.0, 0.0), strict=True)]
    return cum.select(((recall - before[1]) * (prec + before[0]) / 2).alias("a")).agg(F.sum("a").alias("aucpr"))


def fbeta_curve(curve: DataFrame, beta: float = 1.0) -> DataFrame:
    rows = curve.filter("threshold IS NOT NULL")
    return rows.withColumn("f_beta", F.coalesce(f_beta(F.col("prec"), F.col("recall"), beta), F.lit(EPSILON)))


def best_threshold_fbeta(curve: DataFrame, beta: float = 1.0) -> DataFrame:
    """(threshold, f_beta) of the highest F-beta; the lowest threshold on ties."""
    return fbeta_curve(curve, beta).orderBy(F.desc(F.round("f_beta", 12)), F.asc("threshold")).limit(1).select("threshold", "f_beta")


def best_threshold_se_sp(roc: DataFrame) -> DataFrame:
    """(threshold, se, sp) where sensitivity and specificity are nearest; the highest threshold on ties."""
    gap = F.abs(F.col("tpr") - (1 - F.col("fpr")))
    return roc.withColumn("g", F.round(gap, 12)).orderBy(F.asc("g"), F.desc("threshold")).limit(1).select("threshold", F.col("tpr").alias("se"), (1 - F.col("fpr")).alias("sp"))


def mean_abs_burden_error(burdens: DataFrame) -> DataFrame:
    """Mean over patients of the distance between true and predicted burden; patients without time add 0 and count."""
    gap = F.coalesce(F.abs(F.col("pred_burden") - F.col("true_burden")), F.lit(0.0))
    return burdens.agg(F.avg(gap).alias("mean_abs_error"))


def burden_error_by_threshold(df: DataFrame, label: str = "true_label", proba: str = "proba", duration: str = "dur_sec", patient: str = "patient_id", steps: int = 100) -> DataFrame:
    """(i, threshold, mean_abs_error) of thresholds i / steps: each row falls in the bucket of thresholds it exceeds, and buckets are summed up backwards."""
    d = F.col(duration).cast("double")
    step = F.lit(1.0) / steps
    guess = F.ceil(F.col(proba) / step)  # number of thresholds 0..guess-1 that it exceeds, corrected for rounding
    exact = F.when(F.col(proba) > guess * step, guess + 1).when(F.col(proba) > (guess - 1) * step, guess).otherwise(guess - 1)
    rows = df.select(patient, F.greatest(F.least(exact, F.lit(steps + 1)), F.lit(0)).cast("int").alias("b"), d.alias("d"), (d * F.col(label).cast("int")).alias("y"))
    sums = rows.groupBy(patient, "b").agg(F.sum("d").alias("d"), F.sum("y").alias("y"))
    own = sums.groupBy(patient).agg(F.sum("d").alias("t"), F.sum("y").alias("y"), F.collect_list(F.struct("b", "d")).alias("bs")).filter("t > 0")  # steps + 2 buckets at most
    grid = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    above = F.aggregate("bs", F.lit(0.0), lambda a, x: a + F.when(x["b"] > F.col("i"), x["d"]).otherwise(0.0))
    err = F.abs(above - F.col("y")) * 100 / F.col("t")
    return grid.select("i", err.alias("e")).groupBy("i").agg(F.avg("e").alias("mean_abs_error")).select("i", (F.col("i") / steps).alias("threshold"), "mean_abs_error")


def best_threshold_burden(errors: DataFrame) -> DataFrame:
    """(threshold, mean_abs_error) of the least error; the lowest threshold on ties."""
    return errors.orderBy(F.round("mean_abs_error", 9), "i").limit(1).select("threshold", "mean_abs_error")


def patient_burden_fbeta_curve(burdens: DataFrame, labels: DataFrame, beta: float = 1.0, patient: str = "patient_id") -> DataFrame:
    """(threshold, prec, recall, f_beta): the predicted share of time as the score of a label for each patient (patient, label)."""
    rows = burdens.join(labels, patient).select("label", (F.col("pred_burden") / 100).alias("score"))
    return fbeta_curve(pr_curve(cumulative(by_score(rows))), beta)


def evaluate(df: DataFrame, threshold: float | None = 0.5, sign: int = 1, beta: float = 1.0, label: str = "true_label", proba: str = "proba", own: str = "pred") -> DataFrame:
    """One row: accuracy, f_beta, se, sp, ppv, npv, auroc and aucpr of scored rows."""
    rows = df.select(F.col(label).alias("label"), over_threshold(F.col(proba), threshold, F.col(own) if own in df.columns else None).alias("pred"), oriented(F.col(proba), sign).alias("score"))
    cum = cumulative(by_score(rows))
    return classification_metrics(confusion(rows), beta).crossJoin(auroc(cum)).crossJoin(aucpr(cum))  # single rows
