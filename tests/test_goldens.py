"""Hand-worked values of the rhythm operators."""

import numpy as np
import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from beatfold.functions import scalars as S
from beatfold.operators import beats as T
from beatfold.operators import burden as B
from beatfold.operators import cluster_metrics as M
from beatfold.operators import evaluation as E
from beatfold.operators import events as J
from beatfold.operators import knn as K
from beatfold.operators import stability as Y


def rhythm(spark, labels):
    return spark.createDataFrame([("a", i, x) for i, x in enumerate(labels)], "patient_id string, seq long, rhythm string")


@pytest.mark.parametrize(
    "given, want",
    [
        (["(AFIB", "", "", "", "", "", "(N", "", "", "", "(SBR", ""], ["(AFIB"] * 6 + ["(N"] * 4 + ["(SBR"] * 2),
        (["", "None", "(N"], ["(N"] * 3),
        (["", "", ""], ["(N"] * 3),
    ],
)
def test_fill_rhythm(spark, given, want):
    assert [r.rhythm for r in T.fill_rhythm(rhythm(spark, given)).orderBy("seq").collect()] == want


def test_half_af_beats(spark):
    b = rhythm(spark, ["(AFIB", "(AFIB", "(N", "(N"]).withColumn("sample", F.col("seq") + 1)
    assert rows(T.rr_window_labels(b, 4)) == [("a", 0, 1)]
    grid = spark.createDataFrame([("a", 0), ("a", 1)], "patient_id string, prec_window int")
    assert rows(T.ecg_window_labels(b, grid, 4)) == [("a", 0, 0), ("a", 1, 0)]


def test_window_times(spark):
    r = spark.createDataFrame([("a", 100.0), ("b", 20.0)], "patient_id string, duration double")
    assert rows(T.window_times(r, 30.0, "duration", "patient_id"), "patient_id", "start_time", "end_time") == [("a", 0, 30), ("a", 30, 60), ("a", 60, 90), ("b", 0, 20)]


def test_beat_on_a_border_belongs_to_the_window_before(spark):
    b = spark.createDataFrame([("a", x) for x in (0, 1, 10, 11)], "patient_id string, sample long")
    assert rows(T.beats_in_windows(b, 10), "sample", "prec_window") == [(1, 0), (10, 0), (11, 1)]
    spans = spark.createDataFrame([("a", 0.0, 10.0), ("a", 5.0, 11.0)], "patient_id string, start_time double, end_time double")
    assert rows(T.beats_in_spans(b, spans, 3.0, time="sample"), "start_time", "sample") == [(0, 1), (0, 10), (5, 10), (5, 11)]


def test_consecutive_runs(spark):
    w = spark.createDataFrame([("a", float(x)) for x in (0, 30, 60, 120, 150)], "patient_id string, start_time double")
    assert rows(T.consecutive_runs(w), "start_time", "prec", "succ") == [(0, 1, 3), (30, 2, 2), (60, 3, 1), (120, 1, 2), (150, 2, 1)]


def test_events_and_statistics(spark):
    w = spark.createDataFrame([("a", float(s), float(e), True) for s, e in ((0, 50), (58, 100), (111, 150), (150, 160), (170, 180))] + [("b", 0.0, 30.0, False)], "patient_id string, start_time double, end_time double, pred boolean")
    events = J.merge_events(w)
    assert rows(events, "start_sec", "end_sec") == [(0, 100), (111, 180)]
    rec = spark.createDataFrame([("a", 1000.0), ("b", 1000.0)], "patient_id string, rec_length double")
    assert rows(J.event_statistics(events, rec)) == [("a", 2, 100, 69, 0.169), ("b", 0, 0, 0, 0)]


def test_ids_and_bins(spark):
    d = spark.createDataFrame([("7", 90000.0), ("1234", -1800.0), ("8.0", 0.0)], "i string, t double")
    assert rows(d.select(S.record_id(F.col("i")), S.hour_bin(F.col("t")))) == [("007", 1), ("008", 0), ("1234", 0)]


def test_clock(spark):
    d = spark.createDataFrame([("2024-01-02 03:04:05",), ("23:59:59",), ("noon",), (None,)], "c string")
    assert [r[0] for r in d.select(S.clock_seconds(F.col("c"))).collect()] == [11045.0, 86399.0, None, None]


def cohort(spark):
    def hour(p, h, pos, n):
        return [(p, h * 3600.0 + i, i < pos) for i in range(n)]

    data = hour("A", 0, 1, 2) + hour("A", 1, 0, 1) + hour("A", 5, 4, 4) + hour("B", 0, 0, 1) + hour("C", 0, 1, 4) + hour("C", 5, 1, 1) + hour("C", 23, 2, 2)
    return spark.createDataFrame(data + [(None, 1.0, True), ("A", None, True)], "patient_id string, start_time double, pred boolean")


def test_burden(spark):
    f = B.burden_fractions(cohort(spark))
    got = B.filled(f)
    assert rows(got.filter("patient_id = 'A'"), "time_bin", "burden") == [(0, 0.5), (1, 0), (5, 1), (23, 0.5)]
    assert rows(B.mean_burden(got)) == [("A", 0.5), ("B", 0), ("C", 0.8125)]
    assert dict(rows(B.mean_burden(B.filled(f, "all"))))["C"] == 0.96875
    wide = B.burden_wide(got)
    assert rows(S.to_long(wide).filter("burden IS NOT NULL")) == rows(got.select("patient_id", "time_bin", "burden"))


def scored(spark):
    return spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.3, 1), (0.1, 0)], "score double, label int")


def test_curves(spark):
    cum = E.cumulative(E.by_score(scored(spark)))
    assert E.auroc(cum).first()[0] == pytest.approx(13 / 18)
    assert E.aucpr(cum).first()[0] == pytest.approx(0.794444, abs=1e-6)
    assert tuple(E.best_threshold_fbeta(E.pr_curve(cum)).first()) == pytest.approx((0.3, 0.75))
    assert E.best_threshold_se_sp(E.roc_curve(cum)).first().threshold == 0.8
    two = E.cumulative(E.by_score(scored(spark)), parts=3)
    assert rows(cum) == rows(two)
    flipped = E.cumulative(E.by_score(scored(spark).withColumn("score", -F.col("score"))))
    assert E.auroc(flipped).first()[0] == pytest.approx(1 - 13 / 18)


def test_confusion_and_metrics(spark):
    c = E.confusion(scored(spark).withColumn("pred", F.col("score") > 0.5))
    assert tuple(c.first()) == (2, 1, 1, 2)
    assert all(v == pytest.approx(2 / 3) for v in E.classification_metrics(c).first())
    none = E.confusion(spark.createDataFrame([(0, 0)], "label int, pred int"))
    m = E.classification_metrics(none).first()
    assert (m.se, m.ppv, m.f_beta, m.sp, m.npv) == (S.EPSILON, S.EPSILON, S.EPSILON, 1.0, 1.0)


def test_burden_threshold(spark):
    d = spark.createDataFrame([("a", 10.0, 0.2, 0), ("a", 10.0, 0.8, 1)], "patient_id string, dur_sec double, proba double, true_label int")
    assert tuple(E.best_threshold_burden(E.burden_error_by_threshold(d)).first()) == (0.2, 0)


def line(spark, values):
    return spark.createDataFrame([(i, [float(v)], c) for i, (v, c) in enumerate(values)], "point long, profile array<double>, cluster int")


def test_cluster_metrics(spark):
    d = line(spark, [(0, 0), (1, 0), (10, 1), (12, 1)])
    s = M.silhouette_samples(d)
    assert [r[1] for r in rows(s, "point", "silhouette")] == pytest.approx([0.909091, 0.9, 0.789474, 0.826087], abs=1e-6)
    assert M.silhouette(s).first()[0] == pytest.approx(0.856163, abs=1e-6)
    assert M.davies_bouldin(d).first()[0] == pytest.approx(0.142857, abs=1e-6)
    assert M.calinski_harabasz(d).first()[0] == pytest.approx(88.2)
    parts = M.distance_sums(d, blocks=3)
    assert sorted((r.point, r.other, round(r.s, 9), r.n) for r in parts.collect()) == sorted((r.point, r.other, round(r.s, 9), r.n) for r in M.distance_sums(d).collect())


def test_agreement(spark):
    d = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 1, 1], strict=True)), "a int, b int")
    t = M.contingency(d, "a", "b")
    assert M.adjusted_rand(t).first()[0] == pytest.approx(0.324324, abs=1e-6)
    assert [r[1] for r in rows(M.best_jaccard(t))] == pytest.approx([2 / 3, 0.75])
    assert M.adjusted_rand(M.contingency(d, "a", "a")).first()[0] == 1.0


def test_quotas(spark):
    d = spark.createDataFrame([(f"{c}-{i}", c) for c, n in ((0, 10), (1, 1), (2, 3)) for i in range(n)], "patient_id string, cluster int")
    s = Y.stratified_subsamples(d, 3)
    assert rows(s.groupBy("rep", "cluster").count()) == [(r, c, n) for r in range(3) for c, n in ((0, 7), (1, 1), (2, 2))]
    assert rows(s) == rows(Y.stratified_subsamples(d.repartition(3), 3))


def test_knn(spark):
    train = spark.createDataFrame([(i, c, [float(v)]) for i, (v, c) in enumerate([(0, 0), (1, 0), (2, 1), (3, 1), (10, 2)])], "train_id long, label int, profile array<double>")
    ask = spark.createDataFrame([(1, [1.4])], "query_id long, profile array<double>")
    near = K.knn_neighbors(ask, train, 3)
    assert tuple(K.knn_with_confidence(near, 3).first()) == (1, 0, pytest.approx(2 / 3))
    assert tuple(K.knn_with_confidence(K.knn_neighbors(ask, train, 2), 2).first()) == (1, 0, 0.5)
    assert rows(K.knn_proba(near, train, 3), "label", "proba") == [(0, pytest.approx(2 / 3)), (1, pytest.approx(1 / 3)), (2, 0.0)]
    with pytest.raises(ValueError):
        K.knn_neighbors(ask, train, 9)


def test_unknown_phenotypes_have_numbers(spark):
    d = spark.createDataFrame([(0,), (7,)], "c int")
    assert rows(d.select(S.phenotype_name(F.col("c"), {0: "Morning"}))) == [("Cluster 7",), ("Morning",)]


def test_merge_with_endless_gap_gives_one_event(spark):
    r = np.random.default_rng(3)
    w = spark.createDataFrame([("a", float(s), float(s + 30), True) for s in r.integers(0, 10**6, 50)], "patient_id string, start_time double, end_time double, pred boolean")
    assert J.merge_events(w, max_gap=float("inf")).count() == 1
