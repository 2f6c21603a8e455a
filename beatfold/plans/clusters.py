"""Queries of clusters, their quality and stability, and of nearest-neighbour prediction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from beatfold.functions import scalars as S
from beatfold.operators import burden as B
from beatfold.operators import cluster_metrics as M
from beatfold.operators import clustering as C
from beatfold.operators import knn as K
from beatfold.operators import stability as Y
from beatfold.plans.burden import _FILLED
from beatfold.sources import views as V
from beatfold.sources.views import duck

P, W = "v_profiles", "v_windows"
NAMES = {0: "Morning", 1: "Evening", 2: "Nocturnal"}
K_NEAR = 5


def _r(df, *cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else c for c in df.columns])


def _points(s, d):
    return V.profiles(s, d).select(F.col("vec_id").alias("point"), F.col("label").alias("cluster"), "profile")


def _patients(s, d):
    return S.to_array(B.filled(B.burden_fractions(V.windows(s, d), "is_af")))


def _two(s, d):
    return V.profiles(s, d).select("label", (F.col("vec_id") % 10).cast("int").alias("other"), (F.col("vec_id") % 3).cast("int").alias("rep"))


def _model(s, d):
    return V.profiles(s, d).select(F.col("vec_id").alias("train_id"), "label", "profile")


def _near(s, d):
    model = _model(s, d)
    return K.knn_neighbors(V.profiles(s, d).filter("vec_id % 100 = 0"), model, K_NEAR, "vec_id", leave_own=True), model


def silhouette_band(s, d):
    q = M.cluster_quality(_points(s, d))
    return q.select(S.silhouette_band(F.col("silhouette")).alias("silhouette_band"), S.davies_bouldin_band(F.col("davies_bouldin")).alias("db_band"), "n_clusters", "n_samples")


def subsample_quota(s, d):
    rows = Y.stratified_subsamples(_points(s, d), patient="point")
    return rows.groupBy("rep", "cluster").agg(F.count("*").alias("n"), F.countDistinct("point").alias("n_distinct"))


def balanced_quota(s, d):
    return C.balanced_sample(_points(s, d), patient="point").groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("point").alias("n_distinct"))


def temporal_distribution(s, d):
    long = S.from_array(_patients(s, d)).withColumn("cluster", (F.col("patient_id") % 4).cast("int"))
    return _r(C.temporal_distribution(long), "mean_burden").withColumn("time_bin", F.col("time_bin").cast("int"))


def knn_proba(s, d):
    near, model = _near(s, d)
    return _r(K.knn_proba(near, model, K_NEAR), "proba")


def prediction_summary(s, d):
    pred = K.knn_with_confidence(_near(s, d)[0], K_NEAR)
    return _r(K.prediction_summary(pred, NAMES), "mean_confidence")


def agglomerative(s, d):
    return C.agglomerative(_patients(s, d), 5)


def linkage(s, d):
    pts, _ = C.points(_patients(s, d))
    return _r(C.linkage_table(pts, "average"), "height")


def search_k(s, d):
    return _r(C.search_k(_patients(s, d), [*range(2, 9)]), "silhouette", "davies_bouldin", "calinski_harabasz")


def _rotated(x, k=4):
    """A clusterer of the user's: profiles by the k-th of the day in which they are highest. It labels each by itself."""
    part = np.array_split(x, k, axis=1)
    return np.argmax([p.mean(1) for p in part], axis=0)


def search_k_custom(s, d):
    return _r(C.search_k(_patients(s, d), [2, 3, 4], _rotated, by_row=True), "silhouette", "davies_bouldin", "calinski_harabasz")


def stability_custom(s, d):
    p = _patients(s, d)
    base = C.labelled_rows(p, _rotated)
    aris, _ = Y.replicate_scores(Y.recluster(Y.stratified_subsamples(base), p, 4, fit_predict=_rotated, by_row=True))
    return _r(Y.ari_summary(aris), "ari_mean", "ari_std", "ari_min", "ari_max")


def stability(s, d):
    p = _patients(s, d)
    base = C.agglomerative(p, 4).select("patient_id", "cluster")
    aris, _ = Y.replicate_scores(Y.recluster(Y.stratified_subsamples(base), p, 4))
    return _r(Y.ari_summary(aris), "ari_mean", "ari_std", "ari_min", "ari_max")


def stability_by_cluster(s, d):
    p = _patients(s, d)
    base = C.agglomerative(p, 4).select("patient_id", "cluster")
    _, jac = Y.replicate_scores(Y.recluster(Y.stratified_subsamples(base), p, 4))
    return _r(Y.jaccard_summary(jac, base), "jaccard_mean", "jaccard_std")


def custom_clusterer(s, d):
    """A clusterer of the user's: by which third of the day holds most burden."""

    def by_part(x):
        w = x.shape[1] // 3
        return (x[:, : 3 * w].reshape(len(x), 3, w).sum(2)).argmax(1)

    return C.labelled_rows(_patients(s, d), by_part)


def cut_at_height(s, d):
    return C.cluster_sizes(C.cut_at_height(_patients(s, d), 1.0)).groupBy("n").agg(F.count("*").alias("n_clusters"))


QUERIES = {
    "cut_at_height": cut_at_height,
    "cluster_sizes": lambda s, d: C.cluster_sizes(_points(s, d)),
    "cluster_assignments": lambda s, d: C.assignments(_points(s, d), "point"),
    "silhouette_samples": lambda s, d: _r(M.silhouette_samples(_points(s, d)), "silhouette"),
    "silhouette": lambda s, d: _r(M.silhouette(M.silhouette_samples(_points(s, d))), "silhouette"),
    "davies_bouldin": lambda s, d: _r(M.davies_bouldin(_points(s, d)), "davies_bouldin"),
    "calinski_harabasz": lambda s, d: _r(M.calinski_harabasz(_points(s, d)), "calinski_harabasz"),
    "cluster_quality": lambda s, d: _r(M.cluster_quality(_points(s, d)), "silhouette", "davies_bouldin", "calinski_harabasz"),
    "interpret_metrics": silhouette_band,
    "contingency": lambda s, d: M.contingency(_two(s, d), "label", "other"),
    "adjusted_rand": lambda s, d: _r(M.adjusted_rand(M.contingency(_two(s, d), "label", "other")), "ari", n=9),
    "adjusted_rand_by_rep": lambda s, d: _r(M.adjusted_rand(M.contingency(_two(s, d), "label", "other", "rep"), "rep"), "ari", n=9),
    "best_jaccard": lambda s, d: _r(M.best_jaccard(M.contingency(_two(s, d), "label", "other", "rep"), "rep"), "jaccard", n=9),
    "ari_summary": lambda s, d: _r(Y.ari_summary(M.adjusted_rand(M.contingency(_two(s, d), "label", "other", "rep"), "rep")), "ari_mean", "ari_std", "ari_min", "ari_max", n=9),
    "jaccard_summary": lambda s, d: _r(Y.jaccard_summary(M.best_jaccard(M.contingency(_two(s, d), "label", "other", "rep"), "rep").withColumnRenamed("a", "cluster"), _points(s, d)), "jaccard_mean", "jaccard_std", n=9),
    "subsample_quota": subsample_quota,
    "balanced_quota": balanced_quota,
    "cluster_profiles": lambda s, d: _r(C.cluster_profiles(_points(s, d)), "mean", "std"),
    "temporal_distribution": temporal_distribution,
    "order_by_cluster": lambda s, d: C.order_by_cluster(_points(s, d), patient="point").select("cluster", "point"),
    "knn_neighbors": lambda s, d: _r(_near(s, d)[0], "distance"),
    "knn_predict": lambda s, d: K.knn_predict(K.knn_among(_model(s, d), K_NEAR), K_NEAR),
    "knn_proba": knn_proba,
    "knn_confidence": lambda s, d: _r(K.knn_with_confidence(_near(s, d)[0], K_NEAR), "confidence"),
    "prediction_summary": prediction_summary,
    "training_summary": lambda s, d: K.training_summary(_near(s, d)[1], NAMES),
    "phenotype_counts": lambda s, d: K.phenotype_counts(K.knn_predict(_near(s, d)[0], K_NEAR)),
    "agglomerative": agglomerative,
    "linkage": linkage,
    "top_merges": lambda s, d: C.top_merges(linkage(s, d), 10),
    "search_k": search_k,
    "stability": stability,
    "stability_by_cluster": stability_by_cluster,
    "custom_clusterer": custom_clusterer,
    "search_k_custom": search_k_custom,
    "stability_custom": stability_custom,
}

_DIST = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_SIL = f"""d AS (SELECT a.vec_id AS point, a.label AS own, b.label AS other, sum({_DIST.format(a="a.profile", b="b.profile")}) AS s, count(*) AS n FROM v_profiles a CROSS JOIN v_profiles b GROUP BY ALL),
  g AS (SELECT point, own, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY ALL),
  sil AS (SELECT point, own AS cluster, CASE WHEN a IS NULL THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END AS silhouette FROM g)"""
_LONG = """l AS (SELECT vec_id, label, unnest(range(0, len(profile))) AS dim, unnest(profile) AS v FROM v_profiles),
  m AS (SELECT label, dim, avg(v) AS m FROM l GROUP BY ALL),
  o AS (SELECT vec_id, l.label, sum((v - m) * (v - m)) AS d2 FROM l JOIN m ON l.label = m.label AND l.dim = m.dim GROUP BY ALL)"""
_DB = """sp AS (SELECT label, avg(sqrt(d2)) AS s FROM o GROUP BY 1),
  gp AS (SELECT x.label AS i, y.label AS j, sqrt(sum((x.m - y.m) * (x.m - y.m))) AS d FROM m x JOIN m y ON x.dim = y.dim AND x.label <> y.label GROUP BY ALL),
  db AS (SELECT avg(r) AS davies_bouldin FROM (SELECT i, max(coalesce((p.s + q.s) / nullif(d, 0), 0)) AS r FROM gp JOIN sp p ON p.label = i JOIN sp q ON q.label = j GROUP BY i))"""
_CH = """k AS (SELECT label, count(*) AS k FROM v_profiles GROUP BY 1), gm AS (SELECT dim, avg(v) AS g FROM l GROUP BY 1),
  bt AS (SELECT sum(k * (m.m - g) * (m.m - g)) AS b, count(DISTINCT m.label) AS q FROM m JOIN gm USING (dim) JOIN k ON k.label = m.label),
  ch AS (SELECT coalesce(b * (n - q) / nullif(w * (q - 1), 0), 1.0) AS calinski_harabasz FROM bt, (SELECT sum(d2) AS w, count(*) AS n FROM o))"""
_QUALITY = f"{_SIL}, {_LONG}, {_DB}, {_CH}, qq AS (SELECT (SELECT avg(silhouette) FROM sil) AS silhouette, (SELECT davies_bouldin FROM db) AS davies_bouldin, (SELECT calinski_harabasz FROM ch) AS calinski_harabasz, (SELECT count(DISTINCT label) FROM v_profiles) AS n_clusters, (SELECT count(*) FROM v_profiles) AS n_samples)"
_TABLE = "t AS (SELECT CAST(vec_id % 3 AS INTEGER) AS rep, label AS a, CAST(vec_id % 10 AS INTEGER) AS b, count(*) AS n FROM v_profiles GROUP BY ALL)"
_ARI = """ra AS (SELECT rep, sum(m * (m - 1) / 2.0) AS a FROM (SELECT rep, a, CAST(sum(n) AS DOUBLE) AS m FROM t GROUP BY ALL) GROUP BY 1), rb AS (SELECT rep, sum(m * (m - 1) / 2.0) AS b FROM (SELECT rep, b, CAST(sum(n) AS DOUBLE) AS m FROM t GROUP BY ALL) GROUP BY 1),
  ij AS (SELECT rep, CAST(sum(n * (n - 1) / 2.0) AS DOUBLE) AS ij, CAST(sum(n) AS DOUBLE) AS n FROM t GROUP BY 1),
  ari AS (SELECT rep, coalesce((ij - a * b / (n * (n - 1) / 2.0)) / nullif((a + b) / 2 - a * b / (n * (n - 1) / 2.0), 0), 1.0) AS ari FROM ij JOIN ra USING (rep) JOIN rb USING (rep))"""
_JAC = "j AS (SELECT rep, a, max(CAST(n AS DOUBLE) / (na + nb - n)) AS jaccard FROM t JOIN (SELECT rep, a, sum(n) AS na FROM t GROUP BY ALL) USING (rep, a) JOIN (SELECT rep, b, sum(n) AS nb FROM t GROUP BY ALL) USING (rep, b) GROUP BY ALL)"
_NEAR = f"""nn AS (SELECT * FROM (SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST.format(a="q.profile", b="t.profile")}, t.vec_id) AS INTEGER) AS rank, t.vec_id AS train_id, t.label, {_DIST.format(a="q.profile", b="t.profile")} AS distance FROM v_profiles q JOIN v_profiles t ON q.vec_id % 100 = 0 AND t.vec_id <> q.vec_id) WHERE rank <= {K_NEAR}),
  vt AS (SELECT query_id, label, count(*) AS votes FROM nn GROUP BY ALL),
  kp AS (SELECT query_id, label AS chronophenotype, votes / CAST({K_NEAR} AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS r FROM vt) WHERE r = 1)"""
_NEAR_EVERY = _NEAR.replace("q.vec_id % 100 = 0 AND ", "")
_NAME = "CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMES.items()) + " ELSE 'Cluster ' || CAST({c} AS STRING) END"


ORACLES = {
    "cluster_sizes": duck("SELECT label AS cluster, count(*) AS n FROM v_profiles GROUP BY 1", P),
    "cluster_assignments": duck("SELECT vec_id AS patient_id, label AS cluster FROM v_profiles", P),
    "silhouette_samples": duck(f"WITH {_SIL} SELECT point, cluster, round(silhouette, 6) AS silhouette FROM sil", P),
    "silhouette": duck(f"WITH {_SIL} SELECT round(avg(silhouette), 6) AS silhouette FROM sil", P),
    "davies_bouldin": duck(f"WITH {_LONG}, {_DB} SELECT round(davies_bouldin, 6) AS davies_bouldin FROM db", P),
    "calinski_harabasz": duck(f"WITH {_LONG}, {_CH} SELECT round(calinski_harabasz, 6) AS calinski_harabasz FROM ch", P),
    "cluster_quality": duck(f"WITH {_QUALITY} SELECT round(silhouette, 6) AS silhouette, round(davies_bouldin, 6) AS davies_bouldin, round(calinski_harabasz, 6) AS calinski_harabasz, n_clusters, n_samples FROM qq", P),
    "interpret_metrics": duck(f"WITH {_QUALITY} SELECT CASE WHEN silhouette > 0.7 THEN 'strong' WHEN silhouette > 0.5 THEN 'reasonable' WHEN silhouette > 0.25 THEN 'weak' ELSE 'none' END AS silhouette_band, CASE WHEN davies_bouldin < 0.5 THEN 'excellent' WHEN davies_bouldin < 1 THEN 'good' WHEN davies_bouldin < 2 THEN 'moderate' ELSE 'poor' END AS db_band, n_clusters, n_samples FROM qq", P),
    "contingency": duck("SELECT label AS a, CAST(vec_id % 10 AS INTEGER) AS b, count(*) AS n FROM v_profiles GROUP BY ALL", P),
    "adjusted_rand": duck(f"WITH {_TABLE.replace('CAST(vec_id % 3 AS INTEGER)', '0')}, {_ARI} SELECT round(ari, 9) AS ari FROM ari", P),
    "adjusted_rand_by_rep": duck(f"WITH {_TABLE}, {_ARI} SELECT rep, round(ari, 9) AS ari FROM ari", P),
    "best_jaccard": duck(f"WITH {_TABLE}, {_JAC} SELECT rep, a, round(jaccard, 9) AS jaccard FROM j", P),
    "ari_summary": duck(f"WITH {_TABLE}, {_ARI} SELECT round(avg(ari), 9) AS ari_mean, round(stddev_pop(ari), 9) AS ari_std, round(min(ari), 9) AS ari_min, round(max(ari), 9) AS ari_max FROM ari", P),
    "jaccard_summary": duck(f"WITH {_TABLE}, {_JAC} SELECT a AS cluster, round(avg(jaccard), 9) AS jaccard_mean, round(stddev_pop(jaccard), 9) AS jaccard_std, max(size) AS size FROM j JOIN (SELECT label, count(*) AS size FROM v_profiles GROUP BY 1) s ON s.label = a GROUP BY 1", P),
    "subsample_quota": duck("SELECT CAST(r AS INTEGER) AS rep, label AS cluster, greatest(1, CAST(floor(n * CAST(0.7 AS DOUBLE) + 1e-9) AS BIGINT)) AS n, greatest(1, CAST(floor(n * CAST(0.7 AS DOUBLE) + 1e-9) AS BIGINT)) AS n_distinct FROM (SELECT label, count(*) AS n FROM v_profiles GROUP BY 1) CROSS JOIN range(100) x(r)", P),
    "balanced_quota": duck("SELECT label AS cluster, least(count(*), 500) AS n, least(count(*), 500) AS n_distinct FROM v_profiles GROUP BY 1", P),
    "cluster_profiles": duck(f"WITH {_LONG} SELECT label AS cluster, CAST(dim AS INTEGER) AS time_bin, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS n FROM l GROUP BY ALL", P),
    "temporal_distribution": duck(f"WITH {_FILLED}, c AS (SELECT *, CAST(patient_id % 4 AS INTEGER) AS cluster FROM p) SELECT cluster, time_bin, round(avg(burden), 6) AS mean_burden, max(np) AS n_patients FROM c JOIN (SELECT cluster, count(DISTINCT patient_id) AS np FROM c GROUP BY 1) USING (cluster) GROUP BY ALL", W),
    "order_by_cluster": duck("SELECT label AS cluster, vec_id AS point FROM v_profiles ORDER BY 1, 2", P),
    "knn_neighbors": duck(f"WITH {_NEAR} SELECT query_id, rank, train_id, label, round(distance, 6) AS distance FROM nn", P),
    "knn_predict": duck(f"WITH {_NEAR_EVERY} SELECT query_id, chronophenotype FROM kp", P),
    "knn_proba": duck(f"WITH {_NEAR} SELECT q.query_id, l.label, round(coalesce(votes, 0) / CAST({K_NEAR} AS DOUBLE), 6) AS proba FROM (SELECT DISTINCT query_id FROM nn) q CROSS JOIN (SELECT DISTINCT label FROM v_profiles) l LEFT JOIN vt ON vt.query_id = q.query_id AND vt.label = l.label", P),
    "knn_confidence": duck(f"WITH {_NEAR} SELECT query_id, chronophenotype, round(confidence, 6) AS confidence FROM kp", P),
    "prediction_summary": duck(f"WITH {_NEAR} SELECT chronophenotype, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, {_NAME.format(c='chronophenotype')} AS name FROM kp GROUP BY 1", P),
    "training_summary": duck(f"SELECT label, count(*) AS n_rows, count(DISTINCT vec_id) AS n_subjects, {_NAME.format(c='label')} AS name FROM v_profiles GROUP BY 1", P),
    "phenotype_counts": duck(f"WITH {_NEAR} SELECT chronophenotype, count(*) AS n FROM kp GROUP BY 1 ORDER BY 1", P),
}
