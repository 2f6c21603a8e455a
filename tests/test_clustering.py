"""Merge trees against a naive implementation, cuts and clusterers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatfold.functions import linkage as L
from beatfold.operators import clustering as C
from beatfold.operators import stability as Y
from beatfold.plans import registry


def naive(x, method, metric):
    d0 = L.distances(x, metric)
    groups, merges = [[i] for i in range(len(x))], []

    def far(a, b):
        d = d0[np.ix_(a, b)]
        if method == "ward":
            ma, mb = x[a].mean(0), x[b].mean(0)
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * ((ma - mb) ** 2).sum())
        return {"single": d.min, "complete": d.max, "average": d.mean}[method]()

    while len(groups) > 1:
        h, i, j = min((far(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        merges.append((h, frozenset(groups[i] + groups[j])))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    return merges


@pytest.mark.parametrize("metric", L.METRICS)
@pytest.mark.parametrize("method", L.LINKAGES)
def test_tree_against_naive(method, metric):
    if method == "ward" and metric != "euclidean":
        with pytest.raises(ValueError):
            L.linkage(np.eye(3), method, metric)
        return
    x = np.random.default_rng(5).normal(size=(24, 4))
    t = L.linkage(x, method, metric)
    members = {i: frozenset([i]) for i in range(24)}
    got = []
    for k, (a, b, h, n) in enumerate(t):
        members[24 + k] = members[int(a)] | members[int(b)]
        assert len(members[24 + k]) == n
        got.append((h, members[24 + k]))
    want = naive(x, method, metric)
    assert [h for h, _ in got] == pytest.approx([h for h, _ in want])
    assert {m for _, m in got} == {m for _, m in want}


@pytest.mark.parametrize("method, heights, two", [("single", [1, 2, 4, 5], [0, 0, 0, 0, 1]), ("complete", [1, 3, 5, 12], [0, 0, 0, 1, 1]), ("average", [1, 2.5, 5, 8.166667], [0, 0, 0, 1, 1]), ("ward", [1, 2.886751, 5, 12.651746], [0, 0, 0, 1, 1])])
def test_line(method, heights, two):
    t = L.linkage(np.array([[0.0], [1], [3], [7], [12]]), method)
    assert t[:, 2] == pytest.approx(heights, abs=1e-5)
    assert list(L.cut(t, 5, 2)) == two
    assert list(L.cut(t, 5, height=heights[0])) == [0, 0, 1, 2, 3]


def profiles(spark, n=40):
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(n, 3)) + 10 * (np.arange(n) % 3)[:, None], 6)
    return spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(x)], "patient_id string, profile array<double>")


def parts(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.cluster, set()).add(r.patient_id)
    return sorted(map(sorted, found.values()))


def parts_by_rep(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.rep, {}).setdefault(r.new, set()).add(r.patient_id)
    return {rep: sorted(map(sorted, c.values())) for rep, c in found.items()}


def test_exact_equals_collapsed_and_scaled_finds_the_same_groups(spark):
    p = profiles(spark)
    exact = C.agglomerative(p, 3)
    assert not exact.first().approximate
    assert parts(exact) == parts(C.agglomerative(p.union(p.limit(0)), 3, cap=40))
    whole = C.agglomerative(p, 3, cap=12)  # beyond cap: in rounds of Spark jobs
    assert not whole.first().approximate and parts(whole) == parts(exact)
    with pytest.raises(ValueError, match="approximate"):
        C.clustered_by(p, lambda x: np.zeros(len(x)), cap=12)
    scaled = C.agglomerative(p, 3, cap=12, approximate=True)
    assert scaled.first().approximate and parts(scaled) == parts(exact)


def test_equal_profiles_share_a_cluster(spark):
    d = spark.createDataFrame([(f"p{i}", [0.0, 0.0] if i < 5 else [float(i), 1.0]) for i in range(8)], "patient_id string, profile array<double>")
    c = {r.patient_id: r.cluster for r in C.agglomerative(d, 3).collect()}
    assert len({c[f"p{i}"] for i in range(5)}) == 1


def test_custom_clusterer_and_stability(spark):
    p = profiles(spark, 30)
    own = C.clustered_by(p, lambda x: (x[:, 0] > 5).astype(int))
    assert {r.cluster for r in own.collect()} == {0, 1}
    base = C.agglomerative(p, 3).select("patient_id", "cluster")
    aris, jac = Y.replicate_scores(Y.recluster(Y.stratified_subsamples(base, 4), p, 3))
    assert [r.ari for r in aris.collect()] == [1.0] * 4
    samples = Y.stratified_subsamples(base, 4)
    tasks, rounds = (parts_by_rep(Y.recluster(samples, p, 3, "average", cap=c)) for c in (100, 9))
    assert tasks == rounds and len(tasks) == 4
    own = Y.recluster(samples, p, 3, fit_predict=lambda x: (x[:, 0] > 5).astype(int)).collect()
    assert {(int(r.patient_id[1:]) % 3 > 0, r.new) for r in own} == {(False, 0), (True, 1)}
    with pytest.raises(ValueError, match="raise cap"):
        Y.recluster(samples, p, 3, cap=9, fit_predict=lambda x: np.zeros(len(x)))
    assert all(r.jaccard == 1.0 for r in jac.collect())


def test_custom_clusterer_sees_every_patient(spark, monkeypatch):
    monkeypatch.setattr(C, "points", None)  # no micro-clusters
    own = registry.QUERIES["custom_clusterer"](spark, "/root/testdata/sf0.001")
    assert own.count() == registry.QUERIES["burden_wide"](spark, "/root/testdata/sf0.001").count()
    got = C.labelled_rows(profiles(spark, 30), lambda x: (x[:, 0] > 5).astype(int)).collect()
    assert {(int(r.patient_id[1:]) % 3 > 0, r.cluster) for r in got} == {(False, 0), (True, 1)} and len(got) == 30


def test_registered_stability_and_search_are_whole(spark, monkeypatch):
    samples, ks = [], []
    monkeypatch.setattr(Y, "recluster", lambda s, p, k: samples.append(s) or s.withColumn("new", s.cluster))
    labels_for = C.labels_for
    monkeypatch.setattr(C, "labels_for", lambda p, k, *more: ks.append(k) or labels_for(p, k, *more))
    for name in ("stability", "stability_by_cluster", "search_k"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [s.select("rep").distinct().count() for s in samples] == [100, 100] and ks[-1] == [2, 3, 4, 5, 6, 7, 8]


def test_clusterer_of_the_users_in_search(spark):
    p = profiles(spark, 30)
    own = lambda x, k: (x[:, 0] > 5).astype(int) + (k > 2) * (x[:, 0] > 15)
    tree = {r.k: r for r in C.search_k(p, [2, 3]).collect()}
    got = {r.k: r for r in C.search_k(p, [2, 3], own).collect()}
    assert got[3].silhouette == pytest.approx(tree[3].silhouette) and got[2].silhouette > 0.5


def test_subsamples_take_the_least_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(Y, "BIN_ROWS", 7)
    d = spark.createDataFrame([(f"p{i}", 0 if i < 400 else i % 3) for i in range(500)] + [("one", 9)], "patient_id string, cluster int")
    got = {}
    for r in Y.stratified_subsamples(d, 3).collect():
        got.setdefault((r.rep, r.cluster), set()).add(r.patient_id)
    hashed = d.withColumn("rep", F.explode(F.array(*map(F.lit, range(3))))).withColumn("h", F.xxhash64("patient_id", "rep", F.lit(Y.SEED))).collect()
    for (rep, c), members in got.items():
        every = sorted((r.h, r.patient_id) for r in hashed if (r.rep, r.cluster) == (rep, c))
        assert members == {p for _, p in every[: max(1, int(0.7 * len(every) + 1e-9))]}
    assert len(got) == 12


def test_last_merges(spark):
    d = spark.createDataFrame([(f"p{i}", [x]) for i, x in enumerate([0.0, 1.0, 3.0, 7.0, 12.0])], "patient_id string, profile array<double>")
    pts, _ = C.points(d)
    for cap in (100, 2):
        table = C.linkage_table(pts, "average", cap=cap)
        assert [r.merge_idx for r in C.top_merges(table, 2).collect()] == [3, 2]
        found = sorted((r.height, r.size) for r in table.collect())
        assert [h for h, _ in found] == pytest.approx([1, 2.5, 5, 49 / 6]) and [n for _, n in found] == [2, 3, 2, 5]


def test_balanced_sample(spark):
    d = spark.createDataFrame([(f"p{i}", i % 10 // 9) for i in range(500)], "patient_id string, cluster int")
    assert sorted((r.cluster, r["count"]) for r in C.balanced_sample(d, 20).groupBy("cluster").count().collect()) == [(0, 20), (1, 20)]


def test_cut_at_height(spark):
    d = spark.createDataFrame([(f"p{i}", [x]) for i, x in enumerate([0.0, 1.0, 3.0, 7.0, 12.0, 0.0])], "patient_id string, profile array<double>")
    assert parts(C.cut_at_height(d, 1.0)) == [["p0", "p1", "p5"], ["p2"], ["p3"], ["p4"]]


def test_quality_of_all_k_in_one_pass(spark):
    from pyspark.sql import functions as F

    from beatfold.operators import cluster_metrics as M

    p = profiles(spark, 30)
    found = C.labels_for(p, [2, 3, 4]).join(p, "patient_id")
    for r in M.quality_by_k(found, "patient_id").collect():
        one = M.cluster_quality(found.filter(F.col("k") == r.k), "patient_id").first()
        assert (r.silhouette, r.davies_bouldin, r.calinski_harabasz) == pytest.approx((one.silhouette, one.davies_bouldin, one.calinski_harabasz))


def test_neighbours_meet_few_cells(spark, monkeypatch):
    from pyspark.sql import functions as F

    from beatfold.operators import knn as K

    monkeypatch.setattr(K, "BLOCK", 50)
    r = np.random.default_rng(8)
    centre = 30 * r.normal(size=(12, 3))
    x = np.vstack([centre[np.arange(900) % 12] + r.normal(size=(900, 3)), np.zeros((300, 3))])  # a quarter of the rows alike
    model = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "train_id long, label int, profile array<double>")
    asked = model.filter("train_id % 40 = 0").withColumnRenamed("train_id", "query_id")
    for own in (False, True):
        got = sorted((q, n, t, round(d, 9)) for q, n, t, _, d in map(tuple, K.knn_neighbors(asked, model, 4, leave_own=own).collect()))
        want = []
        for q in range(0, 1200, 40):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            near = [i for i in np.lexsort((np.arange(1200), d)) if not own or i != q][:4]
            want += [(q, n + 1, int(i), round(float(d[i]), 9)) for n, i in enumerate(near)]
        assert got == want
    pivots, rows, cells = K._celled(model, 1200)
    met = K.asked_blocks(asked.select(F.col("query_id").alias("q"), F.col("profile").alias("x"), F.lit(3.0).alias("least")), pivots, cells, 4, True)
    assert met.count() < 0.5 * len(cells) * asked.count()  # a second round of few cells


def test_asked_cells_come_in_bounded_batches(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    from beatfold.operators import knn as K

    class Rows:  # what _to_pivots needs of a DataFrame; keeps the function that Spark would run
        columns = ["q", "x"]
        schema = {"q": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}

        def mapInArrow(self, run, schema):
            return run

    r = np.random.default_rng(2)
    x, pivots = r.normal(size=(3000, 64)), r.normal(size=(256, 64))
    cells = [SimpleNamespace(cell=i, n=1, radius=1.0) for i in range(256)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(x.tolist())], ["q", "x"])
    got = [*K.asked_blocks(Rows(), pivots, cells, 200)([batch])]
    assert max(b.nbytes for b in got) < 6 << 20
    pairs = sorted((q, c) for b in got for q, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
    near = np.argsort(((x[:, None, :4] - pivots[None, :, :4]) ** 2).sum(2) + ((x[:, None, 4:] - pivots[None, :, 4:]) ** 2).sum(2), axis=1)[:, :200]
    assert pairs == sorted((q, int(c)) for q in range(3000) for c in near[q])


def test_sums_of_distances_do_not_depend_on_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from beatfold.operators import cluster_metrics as M

    p = profiles(spark, 60).select(F.col("patient_id").alias("point"), "profile", (F.substring("patient_id", 2, 3).cast("int") % 4).alias("cluster"))
    value = lambda **kw: sorted((r.point, r.own, r.other, round(r.s, 6), r.n) for r in M.distance_sums(p, **kw).collect())
    one = value(blocks=1)
    monkeypatch.setattr(M, "MOST_HELD", 50)
    assert value(blocks=7) == one and len(one) == 240


def test_row_clusterers_take_any_number_of_profiles(spark):
    """more distinct profiles than `cap` were refused."""
    p = profiles(spark, 20)
    label = lambda x, k=2: (x[:, 0] > 5).astype(int)
    rounded = lambda df: [tuple(round(v, 9) for v in r) for r in df.collect()]
    assert rounded(C.search_k(p, [2], label, cap=5, by_row=True)) == rounded(C.search_k(p, [2], label))
    samples = Y.stratified_subsamples(C.labelled_rows(p, label), 3)
    got, want = (sorted(map(tuple, Y.recluster(samples, p, 2, fit_predict=label, **kw).collect())) for kw in ({"cap": 5, "by_row": True}, {}))
    assert got == want and len(got) > 20


def test_sums_of_distances_do_not_depend_on_the_grid(spark, monkeypatch):
    """F12 to F15: a task held all pairs' blocks that it met; now a cell of the grid is bounded."""
    from pyspark.sql import functions as F

    from beatfold.operators import blocks as B
    from beatfold.operators import cluster_metrics as M

    p = profiles(spark, 60).select(F.col("patient_id").alias("point"), "profile", (F.substring("patient_id", 2, 3).cast("int") % 4).alias("cluster"))
    value = lambda: sorted((r.point, r.own, r.other, round(r.s, 6), r.n) for r in M.distance_sums(p, blocks=9).collect())
    wide = value()
    monkeypatch.setattr(B, "CELL", 1)
    assert value() == wide and len(wide) == 240


def test_distances_are_exact_for_equal_points_and_alike_from_both_sides():
    """F1 to F5, F7, F8, F15: squares by a matrix product."""
    from beatfold.functions import linkage as L

    x = np.random.default_rng(1).random((300, 24)) + 1000.0
    x[7], x[8] = x[250], x[250] + 1e-7
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for got in (L.between(x, x), L.distances(x), np.sqrt(L.distances(x, squared=True))):
        assert np.allclose(got, want, rtol=1e-8, atol=0) and got[7, 250] == 0
    d = L.distances(np.random.default_rng(2).random((1500, 24)))
    assert (d == d.T).all()


def test_windows_of_one_time_have_an_order(spark):
    """F10"""
    from beatfold.operators import beats as T

    df = spark.createDataFrame([(1, i, float(i // 3)) for i in range(30)][::-1], "patient_id int, prec_window int, start_time double").repartition(4)
    got = T.window_positions(df, ties="prec_window").collect()
    assert all((r.prec, r.succ) == (r.prec_window, 29 - r.prec_window) for r in got)


def test_knn_predict_answers_for_every_row(spark):
    """only ids divisible by 100 were asked."""
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    got = sorted(map(tuple, registry.QUERIES["knn_predict"](spark, data).collect()))
    assert got == sorted(con.sql(f"SELECT query_id, chronophenotype FROM ({registry.ORACLES['knn_predict']})").fetchall())
    assert len(got) == con.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]


def test_nearest_others_of_every_row(spark, monkeypatch):
    """blocks of rows that meet in a grid, with ties, against all distances."""
    from beatfold.operators import knn as K

    monkeypatch.setattr(K, "MEETING", 16)
    x = np.random.default_rng(8).integers(0, 3, (120, 3)).astype(float) * 100
    model = spark.createDataFrame([(i, i % 4, [float(v) for v in r]) for i, r in enumerate(x)], "train_id long, label int, profile array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = [(i, r, j, j % 4, d[i, j]) for i in range(120) for r, j in enumerate([j for j in np.lexsort((np.arange(120), d[i])) if j != i][:7], 1)]
    assert sorted(map(tuple, K.knn_among(model, 7).collect())) == want


def test_replicates_of_few_distinct_profiles_stay_in_a_task(spark, monkeypatch):
    """many members of few distinct profiles went through rounds of jobs."""
    p = profiles(spark, 12).withColumn("copy", F.explode(F.array(*map(F.lit, range(5))))).select(F.concat_ws("-", "patient_id", "copy").alias("patient_id"), "profile")
    samples = Y.stratified_subsamples(C.agglomerative(p, 3).select("patient_id", "cluster"), 2)
    want = sorted(map(tuple, Y.recluster(samples, p, 3).collect()))
    monkeypatch.setattr(Y.merge_tree, "merges", None)
    assert sorted(map(tuple, Y.recluster(samples, p, 3, cap=15).collect())) == want
