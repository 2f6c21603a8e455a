"""Quality of clusters: silhouette, Davies-Bouldin, Calinski-Harabasz, and agreement of two partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatfold.functions.linkage import between, distances
from beatfold.functions.scalars import over
from beatfold.operators.blocks import matrix, met, packed
from beatfold.sources.shared import settled

BLOCK, MOST_HELD = 512, 4_000_000


def distance_sums(df: DataFrame, point: str = "point", cluster: str = "cluster", profile: str = "profile", blocks: int | None = None) -> DataFrame:
    """(point, own, other, s, n): sum of Euclidean distances of each point to each cluster, and that cluster's size."""
    rows = df.select(F.col(point).alias("p"), F.array(F.col(cluster).cast("int")).alias("c"), F.col(profile).alias("x"))
    return _sums(rows, blocks).drop("which")


class _Held:
    """Of one block: its labels as columns of 0 and 1, and for each clustering and cluster met so far the sums of its points' distances
    and how many points were met."""

    def __init__(self, rows: pa.Array):
        self.names, self.x, self.c = rows.field("p"), matrix(rows.field("x")), matrix(rows.field("c"))
        self.labels = [(which, name) for which in range(self.c.shape[1]) for name in np.unique(self.c[:, which]).tolist()]
        self.member = np.stack([self.c[:, which] == name for which, name in self.labels], axis=1).astype(float)
        self.sums: dict[tuple[int, int], list] = {}

    def add(self, other: _Held, d: np.ndarray) -> None:
        s, n = d @ other.member, other.member.sum(0)
        for k, label in enumerate(other.labels):
            held = self.sums.setdefault(label, [0.0, 0])
            held[0], held[1] = held[0] + s[:, k], held[1] + int(n[k])

    def batches(self):
        m = len(self.names)
        for (which, other), (s, n) in self.sums.items():
            yield pa.RecordBatch.from_arrays([self.names, *map(pa.array, (np.full(m, which, np.int32), self.c[:, which].astype(np.int32), np.full(m, other, np.int32), s, np.full(m, n, np.int64)))], ["point", "which", "own", "other", "s", "n"])
        self.sums = {}


def _summed(pairs):
    """The sums of a task's blocks."""
    held: dict = {}
    for _, i, j, a, b in pairs:
        held |= {i: a, j: b}
        if i == j:
            a.add(a, distances(a.x))
        else:
            d = between(a.x, b.x)
            a.add(b, d)
            b.add(a, d.T)
        if sum(len(h.names) * len(h.sums) for h in (a, b)) > MOST_HELD // len(held):
            yield from (batch for h in held.values() for batch in h.batches())
    for h in held.values():
        yield from h.batches()


def _sums(rows: DataFrame, blocks: int | None = None) -> DataFrame:
    """(point, which, own, other, s, n) of rows (p, c, x); c: a label in each of several clusterings, `which` is its place.

    Points are dealt into blocks, and tasks meet blocks in a grid: each pair of blocks is a numpy product, for both sides and all
    clusterings, and a task sums up what its blocks meet. Pairs of points are never rows; a row is copied and summed up as often as
    the grid has lines.
    """
    blocks = blocks or max(1, -(-rows.count() // BLOCK))
    kind = rows.schema["p"].dataType.simpleString()
    dealt = packed(rows.withColumn("g", F.lit(0)), F.pmod(F.xxhash64("p"), F.lit(blocks)), "p", "c", "x")
    parts = met(dealt, _Held, _summed, f"point {kind}, which int, own int, other int, s double, n long", blocks)
    return parts.groupBy("point", "which", "own", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _samples(sums: DataFrame, *keys: str) -> DataFrame:
    mine = F.col("own") == F.col("other")
    rows = sums.groupBy(*keys, "point", "own").agg(
        F.max(F.when(mine, over(F.col("s"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, over(F.col("s"), F.col("n")))).alias("b"),
    )
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(over(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return rows.select(*keys, "point", F.col("own").alias("cluster"), s.alias("silhouette"))


def silhouette_samples(df: DataFrame, point: str = "point", cluster: str = "cluster", profile: str = "profile") -> DataFrame:
    """(point, cluster, silhouette), exact: 0 for a cluster's only point."""
    return _samples(distance_sums(df, point, cluster, profile))


def silhouette(samples: DataFrame) -> DataFrame:
    return samples.agg(F.avg("silhouette").alias("silhouette"))


def _long(df: DataFrame, point: str, cluster: str, profile: str) -> DataFrame:
    return df.select(F.col(point).alias("p"), F.col(cluster).alias("c"), F.posexplode(profile).alias("dim", "v"))


def _centred(df: DataFrame, point: str, cluster: str, profile: str) -> tuple[DataFrame, DataFrame]:
    """(c, dim, m) centroids, and (p, c, d2) squared distance of each point to its own. Centroids: clusters x dimensions rows."""
    long = _long(df, point, cluster, profile)
    centre = long.groupBy("c", "dim").agg(F.avg("v").alias("m"))
    own = long.join(centre, ["c", "dim"]).groupBy("p", "c").agg(F.sum((F.col("v") - F.col("m")) ** 2).alias("d2"))
    return centre, own


def davies_bouldin(df: DataFrame, point: str = "point", cluster: str = "cluster", profile: str = "profile") -> DataFrame:
    centre, own = _centred(df, point, cluster, profile)
    spread = own.groupBy("c").agg(F.avg(F.sqrt("d2")).alias("s"))
    other = centre.select(F.col("c").alias("c2"), "dim", F.col("m").alias("m2"))
    gap = centre.join(other, "dim").filter("c <> c2").groupBy("c", "c2").agg(F.sqrt(F.sum((F.col("m") - F.col("m2")) ** 2)).alias("d"))
    rows = gap.join(spread, "c").join(spread.select(F.col("c").alias("c2"), F.col("s").alias("s2")), "c2")
    worst = rows.groupBy("c").agg(F.max(F.coalesce(over(F.col("s") + F.col("s2"), F.col("d")), F.lit(0.0))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, point: str = "point", cluster: str = "cluster", profile: str = "profile") -> DataFrame:
    """1.0 if the clusters have no spread."""
    centre, own = _centred(df, point, cluster, profile)
    within = own.agg(F.sum("d2").alias("w"), F.count("*").alias("n"))
    size = df.groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("k"))
    mean = _long(df, point, cluster, profile).groupBy("dim").agg(F.avg("v").alias("g"))
    between = centre.join(mean, "dim").join(size, "c").agg(F.sum(F.col("k") * (F.col("m") - F.col("g")) ** 2).alias("b"), F.countDistinct("c").alias("q"))
    ratio = over(F.col("b") * (F.col("n") - F.col("q")), F.col("w") * (F.col("q") - 1))
    return between.crossJoin(within).select(F.coalesce(ratio, F.lit(1.0)).alias("calinski_harabasz"))  # single rows


def cluster_quality(df: DataFrame, point: str = "point", cluster: str = "cluster", profile: str = "profile") -> DataFrame:
    """One row: silhouette, davies_bouldin, calinski_harabasz, n_clusters, n_samples. Needs 2 to n - 1 clusters."""
    counts = df.agg(F.countDistinct(cluster).alias("n_clusters"), F.count("*").alias("n_samples"))
    one = silhouette(silhouette_samples(df, point, cluster, profile))
    return one.crossJoin(davies_bouldin(df, point, cluster, profile)).crossJoin(calinski_harabasz(df, point, cluster, profile)).crossJoin(counts)


def quality_by_k(df: DataFrame, point: str = "point", profile: str = "profile") -> DataFrame:
    """(k, silhouette, davies_bouldin, calinski_harabasz) of rows (point, profile, k, cluster) of a short list of k. Distances are
    taken once for all k; the other measures are linear in the rows."""
    df = settled(df)  # computed once for every k and measure
    ks = sorted(r.k for r in df.select("k").distinct().collect())
    labels = F.transform(F.array_sort(F.collect_list(F.struct("k", "cluster"))), lambda x: x["cluster"].cast("int"))
    rows = df.groupBy(F.col(point).alias("p")).agg(labels.alias("c"), F.first(profile).alias("x"))
    scores = _samples(_sums(rows), "which").groupBy("which").agg(F.avg("silhouette").alias("silhouette"))
    out = None
    for i, k in enumerate(ks):
        one = df.filter(F.col("k") == k)
        more = davies_bouldin(one, point, "cluster", profile).crossJoin(calinski_harabasz(one, point, "cluster", profile)).select(F.lit(i).alias("which"), F.lit(k).alias("k"), "*")  # single rows
        out = more if out is None else out.unionByName(more)
    return out.join(F.broadcast(scores), "which").select("k", "silhouette", "davies_bouldin", "calinski_harabasz")  # a row for each k


def contingency(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """(keys..., a, b, n)"""
    return df.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def adjusted_rand(table: DataFrame, *keys: str) -> DataFrame:
    """(keys..., ari) of contingency counts; 1 where no pair disagrees."""
    pairs = lambda c: c * (c - 1) / 2.0
    key = [F.lit(0).alias("_k")] if not keys else [F.col(k) for k in keys]
    names = list(keys) or ["_k"]
    t = table.select(*key, "a", "b", "n")
    both = t.groupBy(*names).agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    side = lambda c: t.groupBy(*names, c).agg(F.sum("n").alias("m")).groupBy(*names).agg(F.sum(pairs(F.col("m"))).alias(c))
    rows = both.join(side("a"), names).join(side("b"), names)
    expected = over(F.col("a") * F.col("b"), pairs(F.col("n")))
    top = (F.col("a") + F.col("b")) / 2 - expected
    return rows.select(*keys, F.coalesce(over(F.col("ij") - expected, top), F.lit(1.0)).alias("ari"))


def best_jaccard(table: DataFrame, *keys: str) -> DataFrame:
    """(keys..., a, jaccard): of each cluster a, the best overlap with any cluster b."""
    a = table.groupBy(*keys, "a").agg(F.sum("n").alias("na"))
    b = table.groupBy(*keys, "b").agg(F.sum("n").alias("nb"))
    rows = table.join(a, [*keys, "a"]).join(b, [*keys, "b"])
    return rows.groupBy(*keys, "a").agg(F.max(over(F.col("n"), F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))
