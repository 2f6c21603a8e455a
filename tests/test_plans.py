"""Every registered query runs, has its columns in common with its SQL twin, and plans stay as meant."""

import pytest

from beatfold.operators import burden as B
from beatfold.plans import registry
from beatfold.sources import views as V

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["burden_wide", "rr_windows", "merge_events", "auroc", "silhouette", "knn_confidence", "roc_ranged", "aucpr", "evaluate", "patient_fbeta_curve", "encode_ids", "attach_truth", "burden_from_two", "burden_all_bins", "beats_in_spans", "all_windows", "knn_proba", "training_summary", "subsample_quota", "balanced_quota", "window_bounds", "preceding_count", "silhouette_samples", "cluster_quality", "knn_neighbors"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "lineitem", "embeddings", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DATA)
    want = con.sql(registry.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    value = lambda v: round(float(v), 6) if isinstance(v, float) else v
    a = sorted(tuple(map(value, r)) for r in got.select(*cols).collect())
    b = sorted(tuple(map(value, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").fetchall())
    assert a == b and a


def test_all_oracles_belong_to_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_burden_reads_only_its_columns(spark):
    p = plan(B.burden_fractions(spark.read.parquet(f"{DATA}/events.parquet").selectExpr("user_id AS patient_id", "value AS start_time", "event_id AS pred")))
    assert "event_type" not in p and "Python" not in p


def test_windows_share_the_patients_shuffle(spark):
    from beatfold.operators import beats as T

    b = V.beats(spark, DATA).select("patient_id", "seq", "rr_data", "rr_time")
    assert plan(T.rr_windows(b)).count("Exchange hashpartitioning") == 1


def test_no_task_holds_all_scores_or_ids(spark):
    from beatfold.functions import scalars as S
    from beatfold.operators import evaluation as E

    cum = E.cumulative(E.by_score(V.windows(spark, DATA), "true_label", "proba"), parts=4)
    ids = S.encoded_ids(V.windows(spark, DATA).select("patient_id"))
    for df in (E.roc_curve(cum).filter("tpr > 0"), E.pr_curve(cum), ids):
        assert "SinglePartition" not in plan(df).split("Scan ExistingRDD[part")[0] or "max(score" in plan(df)
    # single rows at the end of an aggregate are the only ones that meet in one task
    assert plan(E.auroc(cum)).count("SinglePartition") == plan(E.aucpr(cum)).count("SinglePartition") == 1
