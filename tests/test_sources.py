"""Readers and writers, and the streaming form."""

import numpy as np
import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from beatfold.operators import scoring
from beatfold.sources import io
from beatfold.streaming.hourly import hourly_burden


def test_csv_and_parquet(spark, tmp_path):
    d = spark.createDataFrame([("a", 0, 0.0, 30.0, 0.9, True), ("b", 1, 30.0, 60.0, 0.1, False)], io.WINDOWS)
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / f"w.{fmt}")
        io.write_table(d, path, fmt)
        assert rows(io.read_windows(spark, path, schema=io.WINDOWS)) == rows(d)
        assert rows(io.read_windows(spark, path, True, schema=io.WINDOWS), "patient_id") == [("a",)]


def test_profiles(spark, tmp_path):
    wide = spark.createDataFrame([("a", 0.5, 1.0, 2), ("b", 0.0, 0.25, 0)], "patient_id string, `0` double, `1` double, cluster int")
    io.write_table(wide, str(tmp_path / "c"), "csv")
    got, n = io.read_chronophenotypes(spark, str(tmp_path / "c"))
    assert n == 2 and rows(got, "patient_id", "profile") == [("a", [0.5, 1.0]), ("b", [0.0, 0.25])]
    io.write_table(wide.drop("cluster"), str(tmp_path / "d"), "csv")
    with pytest.raises(ValueError):
        io.read_chronophenotypes(spark, str(tmp_path / "d"))


def test_annotations(spark, tmp_path):
    e = spark.createDataFrame([("a", 0.0, 100.25, "AFIB"), ("a", 111.0, 180.0, "AFIB"), ("b", 5.0, 6.0, "AFIB")], "patient_id string, start_sec double, end_sec double, rhythm string")
    io.write_rhythm_annotations(e, str(tmp_path / "t"))
    assert rows(io.read_rhythm_annotations(spark, str(tmp_path / "t"))) == rows(e)
    text = next((tmp_path / "t/patient_id=a").glob("*.txt")).read_text().splitlines()
    assert text[:7] == ["---", "type: rhythms annotation", "source file: rhythms.txt", "", "---", "", "Beginning\tEnd\t\tClass"]
    assert len(io.ANNOTATION_HEADER) == 7 and text[6].startswith("Beginning") and text[7] == "0.00000\t100.25000\tAFIB"


def test_npy(spark, tmp_path):
    m = np.arange(3 * 12, dtype=np.float32).reshape(3, 12)
    m[:, 8:] = [[0, 2, 1, 7], [1, 1, 1, 7], [2, 0, 0, 7]]
    np.save(tmp_path / "x.npy", m)
    got = io.read_npy_windows(spark, str(tmp_path), 8).orderBy("prec_window").collect()
    assert [(r.prec_window, r.succ_window, r.global_label, r.record) for r in got] == [(0, 2, 1, 7), (1, 1, 1, 7), (2, 0, 0, 7)]
    assert got[1].samples == m[1, :8].tolist()


def test_npy_by_ranges_of_rows(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(3)
    want = []
    for name, n, kind in (("a", 700, np.float32), ("b", 1, np.float64), ("c", 0, np.float32)):
        m = np.hstack([r.normal(size=(n, 8)), np.arange(n)[:, None], n - 1 - np.arange(n)[:, None], np.ones((n, 1)), np.full((n, 1), len(want))]).astype(kind)
        np.save(tmp_path / f"{name}.npy", m)
        want += [(*map(int, x[8:]), *x[:8].astype(np.float32).tolist()) for x in m]
    (tmp_path / "other.txt").write_text("not a matrix")
    found = lambda df: sorted((x.prec_window, x.succ_window, x.global_label, x.record, *x.samples) for x in df.collect())
    df = io.read_npy_windows(spark, str(tmp_path), 8, range_bytes=100 * 12 * 4)
    assert df.rdd.getNumPartitions() == 8 and found(df) == sorted(want)  # one file is the work of seven tasks
    assert found(io.read_npy_windows(spark, f"file://{tmp_path}/a.npy", 8)) == sorted(want[:700])
    monkeypatch.setattr(io.npy, "opened", lambda path: (_ for _ in ()).throw(OSError("a store of Spark's alone")))
    assert found(io.read_npy_windows(spark, str(tmp_path), 8)) == sorted(want)
    np.save(tmp_path / "d.npy", np.asfortranarray(np.ones((3, 12))))
    monkeypatch.undo()
    with pytest.raises(Exception, match="row by row"):
        io.read_npy_windows(spark, str(tmp_path / "d.npy"), 8).count()


def test_model(spark, tmp_path):
    m = spark.createDataFrame([(1, 0, [0.0]), (2, 1, [1.0])], "train_id long, label int, profile array<double>")
    io.save_model(m, str(tmp_path / "m"), 5)
    got, k, n = io.load_model(spark, str(tmp_path / "m"))
    assert (rows(got), k, n) == (rows(m), 5, 2)


def test_scorers(spark):
    d = spark.createDataFrame([("a", i, [float(i), 1.0]) for i in range(5)], "patient_id string, prec_window int, rr array<double>")
    got = scoring.score_windows(d, lambda x, prec: x[:, 0] / 4 + 0 * prec, threshold=0.5, batch=2)
    assert rows(got, "prec_window", "proba", "pred") == [(i, i / 4, i / 4 > 0.5) for i in range(5)]


def test_stream(spark, tmp_path):
    d = spark.createDataFrame([("a", "2024-01-01 00:10:00", True), ("a", "2024-01-01 00:20:00", False), ("a", "2024-01-01 09:00:00", True)], "patient_id string, t string, pred boolean")
    d.select("patient_id", F.to_timestamp("t").alias("window_time"), "pred").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("patient_id string, window_time timestamp, pred boolean").parquet(str(tmp_path / "in"))
    q = hourly_burden(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("hourly"), "burden") == [(0.5,), (1.0,)]


def test_beats_and_metadata(spark, tmp_path):
    (tmp_path / "beats.csv").write_text("patient_id,rr_data,rr_time\n007,0.8,0.8\n007,0.9,1.7\n")
    assert rows(io.read_beats(spark, str(tmp_path / "beats.csv"))) == [("007", 0.8, 0.8), ("007", 0.9, 1.7)]
    (tmp_path / "meta.csv").write_text("data_id,holter_start_time\n012,08:30:00\n")
    meta = io.read_recording_metadata(spark, str(tmp_path / "meta.csv"))
    assert rows(meta) == [("012", "08:30:00")]
    meta.write.parquet(str(tmp_path / "meta.parquet"))
    assert rows(io.read_recording_metadata(spark, str(tmp_path / "meta.parquet"))) == [("012", "08:30:00")]


def test_truth_that_is_missing(spark):
    from beatfold.operators import events as J

    p = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.6)], "patient_id string, prec_window int, proba double")
    t = spark.createDataFrame([("a", 1, 1)], "patient_id string, prec_window int, true_label int")
    assert tuple(J.unmatched(J.attach_truth(p, t)).first()) == (2, 1)


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace as N

    from beatfold.sources.shared import shared_dir

    away = N(sparkContext=N(getConf=lambda: {}, master="spark://host:7077"), conf=N(get=lambda *a: None))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(away)
    assert shared_dir(spark).startswith("file:")


def test_settled_tables_and_numbers(spark):
    from pathlib import Path

    from beatfold.sources import shared

    d = spark.createDataFrame([(g, i // 2) for g in (0, 1) for i in range(40)], "g int, v int")
    with shared.scratch(spark):
        kept = shared.settled(d)
        where = Path(kept.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
        assert where.exists() and rows(kept) == rows(d)
        got = shared.numbered(d, "n", ["g"], "v", parts=5).collect()
    assert not where.exists() and not shared._scratch.get()
    assert sorted((r.g, r.n) for r in got) == [(g, n) for g in (0, 1) for n in range(40)] and all(r.v == r.n // 2 for r in got)
