"""Phenotype discovery: merge trees, cuts, the choice of k, and samples of clusters.

Equal profiles are one weighted point. Up to CAP points a tree is built from all distances in one task; beyond, it is built exactly in
rounds of Spark jobs (see merge_tree). A caller may ask for `approximate` results instead: then k-means first gathers the points into
`cap` micro-clusters, and the results say so.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatfold.functions import linkage as tree
from beatfold.operators import merge_tree
from beatfold.operators.cluster_metrics import quality_by_k
from beatfold.sources.shared import numbered, settled

CAP = 8000
SEED, SHARES = 42, 64


def points(profiles: DataFrame, patient: str = "patient_id", profile: str = "profile", cap: int = CAP, approximate: bool = False) -> tuple[DataFrame, DataFrame]:
    """((point, x, weight), (patient, point)): what the tree is built on, and which point stands for each patient. approximate: of more
    than `cap` points, micro-clusters; `gathered` tells of these tables whether they are."""
    profiles = settled(profiles.select(F.col(patient).alias("patient"), F.col(profile).alias("x"), F.pmod(F.xxhash64(patient), F.lit(SHARES)).alias("share")))
    some = profiles.groupBy("x", "share").agg(F.min("patient").alias("first"), F.count("*").alias("n"))  # a common profile is counted in shares
    same = settled(some.groupBy("x").agg(F.min("first").alias("point"), F.sum("n").alias("weight")))
    heads = some.select("x", "share").join(same.select("x", "point"), "x")
    member = profiles.join(heads, ["x", "share"]).select(F.col("patient").alias(patient), "point")
    if not approximate or same.count() <= cap:
        return same.select("point", "x", "weight"), member
    vectors = same.withColumn("features", array_to_vector("x"))
    model = KMeans(k=cap, seed=SEED, maxIter=10, weightCol="weight", predictionCol="micro").fit(vectors)
    near = model.transform(vectors).withColumn("x", vector_to_array("features"))
    dims = F.posexplode("x").alias("dim", "v")
    rows = near.select("micro", "weight", "point", dims)
    mean = rows.groupBy("micro", "dim").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v"))
    mean = mean.groupBy("micro").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda e: e["v"]).alias("x"))
    head = near.groupBy("micro").agg(F.min("point").alias("head"), F.sum("weight").alias("weight"))
    micro = settled(mean.join(head, "micro").select(F.col("head").alias("point"), "x", "weight", F.lit(True).alias("gathered")))
    named = near.select("point", "micro").join(head.select("micro", "head"), "micro").select("point", "head")
    return micro, member.join(named, "point").select(patient, F.col("head").alias("point"))


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values("point", kind="stable").reset_index(drop=True)


def gathered(pts: DataFrame) -> bool:
    """Are the points micro-clusters, so that what is built on them is approximate?"""
    return "gathered" in pts.columns


def _numbered(pts: DataFrame) -> DataFrame:
    """The points as merge_tree takes them: p is their place in order of their names."""
    return settled(numbered(pts.select("point", "x", F.col("weight").cast("double").alias("w"), F.lit(0).alias("g")), "p", ["g"], "point"))


def linkage_table(pts: DataFrame, method: str = "complete", metric: str = "euclidean", cap: int = CAP) -> DataFrame:
    """(merge_idx, left, right, height, size) of the points' merge tree; points are numbered in order of their name."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        t = tree.linkage(np.stack(pdf.x), method, metric, pdf.weight.to_numpy())
        return pd.DataFrame({"merge_idx": np.arange(len(t)), "left": t[:, 0].astype(int), "right": t[:, 1].astype(int), "height": t[:, 2], "size": t[:, 3].astype(int)})

    if pts.count() <= cap:
        return pts.select("point", "x", "weight").groupBy().applyInPandas(run, "merge_idx long, left long, right long, height double, size long")
    p = _numbered(pts)
    return merge_tree.linkage_rows(merge_tree.merges(p, method, metric), p).drop("g")


def cut_labels(pts: DataFrame, ks: list[int], method: str = "complete", metric: str = "euclidean", height: float | None = None, cap: int = CAP) -> DataFrame:
    """(point, k, cluster): one tree, cut for every k (k = 0: cut at `height`). Clusters are numbered by size, then first point."""
    kind = pts.schema["point"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        t = tree.linkage(np.stack(pdf.x), method, metric, pdf.weight.to_numpy())
        parts = [(k, tree.cut(t, len(pdf), k)) for k in ks] + ([(0, tree.cut(t, len(pdf), height=height))] if height is not None else [])
        return pd.concat([pd.DataFrame({"point": pdf.point, "k": k, "cluster": c}) for k, c in parts])

    if pts.count() <= cap:
        return pts.select("point", "x", "weight").groupBy().applyInPandas(run, f"point {kind}, k int, cluster int")
    p = _numbered(pts)
    table = settled(merge_tree.linkage_rows(merge_tree.merges(p, method, metric), p))
    return merge_tree.cut(table, p, ks, height).join(p.select("p", "point"), "p").select("point", "k", "cluster")


def agglomerative(profiles: DataFrame, k: int = 5, method: str = "complete", metric: str = "euclidean", patient: str = "patient_id", cap: int = CAP, approximate: bool = False) -> DataFrame:
    """(patient, cluster, approximate) of k clusters."""
    return labels_for(profiles, [k], method, metric, patient, cap, approximate).select(patient, "cluster", "approximate")


def labels_for(profiles: DataFrame, ks: list[int], method: str = "complete", metric: str = "euclidean", patient: str = "patient_id", cap: int = CAP, approximate: bool = False) -> DataFrame:
    """(patient, k, cluster, approximate) for every k, from one tree."""
    pts, member = points(profiles, patient, cap=cap, approximate=approximate)
    labels = cut_labels(pts, ks, method, metric, cap=cap)
    return member.join(labels, "point").select(patient, "k", "cluster", F.lit(gathered(pts)).alias("approximate"))


def search_k(profiles: DataFrame, ks: list[int], fit_predict: Callable[[np.ndarray, int], np.ndarray] | None = None, method: str = "complete", metric: str = "euclidean", patient: str = "patient_id", cap: int = CAP, by_row: bool = False) -> DataFrame:
    """(k, silhouette, davies_bouldin, calinski_harabasz) for every k: of one merge tree's cuts, or of the labels that a clusterer of
    the user's gives to the matrix of distinct profiles (in order of their first patients; at most `cap` of them) and each k. by_row: the clusterer labels each profile by itself, so that
    it may see any number of them in parts."""
    if fit_predict is None:
        labels = labels_for(profiles, ks, method, metric, patient, cap).drop("approximate")
    else:
        labels = None
        for k in ks:
            own = lambda x, k=k: fit_predict(x, k)
            one = labelled_rows(profiles, own, patient) if by_row else clustered_by(profiles, own, patient, cap)
            one = one.select(patient, F.lit(k).alias("k"), "cluster")
            labels = one if labels is None else labels.unionByName(one)
    return quality_by_k(labels.join(profiles.select(patient, "profile"), patient), patient)


def clustered_by(profiles: DataFrame, fit_predict: Callable[[np.ndarray], np.ndarray], patient: str = "patient_id", cap: int = CAP, approximate: bool = False) -> DataFrame:
    """(patient, cluster, approximate) by any function from a matrix to labels, which sees all points: more than `cap` are refused with
    an error, unless the caller asks for micro-clusters."""
    pts, member = points(profiles, patient, cap=cap, approximate=approximate)
    if (n := pts.count()) > cap:
        raise ValueError(f"a function of the user's takes at most {cap} distinct profiles at once, not {n}: ask for approximate=True, or raise cap")
    kind = pts.schema["point"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        return pd.DataFrame({"point": pdf.point, "cluster": np.asarray(fit_predict(np.stack(pdf.x))).astype(int)})

    labels = pts.select("point", "x").groupBy().applyInPandas(run, f"point {kind}, cluster int")
    return member.join(labels, "point").select(patient, "cluster", F.lit(gathered(pts)).alias("approximate"))


def labelled_rows(profiles: DataFrame, label: Callable[[np.ndarray], np.ndarray], patient: str = "patient_id") -> DataFrame:
    """(patient, cluster) by a function that labels each profile by itself: any number of patients, batch by batch."""
    kind = profiles.schema[patient].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({patient: pdf[patient], "cluster": np.asarray(label(np.stack(pdf.profile))).astype(int)})

    return profiles.select(patient, "profile").mapInPandas(run, f"{patient} {kind}, cluster int")


def cut_at_height(profiles: DataFrame, height: float, method: str = "complete", metric: str = "euclidean", patient: str = "patient_id", cap: int = CAP, approximate: bool = False) -> DataFrame:
    """(patient, cluster, approximate): what the tree has joined up to `height`."""
    pts, member = points(profiles, patient, cap=cap, approximate=approximate)
    return member.join(cut_labels(pts, [], method, metric, height, cap), "point").select(patient, "cluster", F.lit(gathered(pts)).alias("approximate"))


def top_merges(table: DataFrame, p: int = 30) -> DataFrame:
    """The last p merges, highest first."""
    return table.orderBy(F.desc("height"), F.desc("merge_idx")).limit(p)


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n"))


def assignments(df: DataFrame, patient: str = "patient_id", cluster: str = "cluster") -> DataFrame:
    return df.select(F.col(patient).alias("patient_id"), F.col(cluster).alias("cluster"))


def balanced_sample(df: DataFrame, most: int = 500, cluster: str = "cluster", patient: str = "patient_id", seed: int = SEED) -> DataFrame:
    """At most `most` rows of each cluster, chosen by hash. Rows far over the quota are left out before ranking."""
    n = df.groupBy(cluster).agg(F.count("*").alias("_n"))
    h = F.pmod(F.xxhash64(patient, F.lit(seed)), F.lit(1 << 32))
    rows = df.join(F.broadcast(n), cluster).withColumn("_h", h)  # a row for each cluster
    rows = rows.filter((F.col("_n") <= 4 * most) | (F.col("_h") < F.lit(float(1 << 32)) * (2.0 * most + 100) / F.col("_n")))
    w = Window.partitionBy(cluster).orderBy("_h", patient)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_n", "_h", "_r")


def cluster_profiles(df: DataFrame, cluster: str = "cluster", profile: str = "profile") -> DataFrame:
    """(cluster, time_bin, mean, std, n): population standard deviation."""
    long = df.select(cluster, F.posexplode(profile).alias("time_bin", "v"))
    return long.groupBy(cluster, "time_bin").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("n"))


def temporal_distribution(long: DataFrame, cluster: str = "cluster", patient: str = "patient_id") -> DataFrame:
    """(cluster, time_bin, mean_burden, n_patients): of long profiles with clusters; patients are counted over the whole cluster."""
    n = long.groupBy(cluster).agg(F.countDistinct(patient).alias("n_patients"))
    return long.groupBy(cluster, "time_bin").agg(F.avg("burden").alias("mean_burden")).join(n, cluster)


def order_by_cluster(df: DataFrame, cluster: str = "cluster", patient: str = "patient_id") -> DataFrame:
    return df.orderBy(cluster, patient)
