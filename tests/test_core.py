import numpy as np
import pytest
from pyspark.sql import functions as F

from maskforge.functions.portable import uniform, uniform_py
from maskforge.operators import cluster, evaluate, features, metrics, report, score
from maskforge.plans import protocols
from maskforge.sources import files, sheets
from maskforge.streaming import summary, to_memory, windowed


def measured(spark, rows):
    return metrics.metrics(spark.createDataFrame(rows, "y int, p int"), []).first()


def test_metrics_by_hand(spark):
    m = measured(spark, [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0)])
    assert m["accuracy"] == pytest.approx(3 / 5)
    assert m["recall_macro"] == pytest.approx((2 / 3 + 1 / 2) / 2)
    assert m["precision_macro"] == pytest.approx((2 / 3 + 1 / 2) / 2)
    assert m["auc_macro"] == pytest.approx((1 / 2 + 1 - 1 / 3) / 2)


def test_metrics_of_odd_classes(spark):
    m = measured(spark, [(0, 0), (1, 0), (1, 2)])
    assert m["precision_macro"] == pytest.approx((1 / 2 + 1 + 0) / 3)  # class 1 is never predicted, class 2 never true
    assert m["recall_macro"] == pytest.approx((1 + 0 + 0) / 3)
    assert measured(spark, [(1, 1), (1, 1)])["auc_macro"] is None


def test_local_metrics_agree(spark):

    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 4, 200), rng.integers(0, 5, 200)
    m = measured(spark, [(int(a), int(b)) for a, b in zip(y, p, strict=True)])
    for name, value in protocols.hard_metrics(y, p).items():
        assert m[name] == pytest.approx(value)


def test_portable_uniform(spark):
    rows = spark.range(50).select("id", uniform("s", "x", F.col("id")).alias("u")).collect()
    assert all(r["u"] == uniform_py("s", "x", r["id"]) for r in rows)


def test_scaling(spark):
    rows = spark.createDataFrame([(1, [1.0, 5.0, float("nan")], 0), (2, [3.0, 5.0, None], 1)], "row_id long, features array<double>, label int")
    assert [r["features"] for r in features.scaled(rows).orderBy("row_id").collect()] == [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0]]


def test_grid_of_blocks_agrees_with_broadcast(spark, monkeypatch):
    split = features.with_split(features.planted(spark, 60), 1)
    masks = features.candidate_masks(spark, 4, 12)
    one = sorted(evaluate.predict(split, masks).collect())
    monkeypatch.setattr(evaluate, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(evaluate, "BLOCK_BYTES", 2000)
    assert sorted(evaluate.predict(split, masks).collect()) == one


def test_split_does_not_depend_on_partitions(spark):
    rows = features.planted(spark, 80)
    a, b = (sorted((r["row_id"], r["is_valid"]) for r in features.with_split(rows.repartition(n), 3).collect()) for n in (1, 7))
    assert a == b


def test_assignment(spark):
    pairs = spark.createDataFrame([(0, "a")] * 5 + [(0, "b")] * 6 + [(1, "b")] * 9 + [(1, "a")] * 1, "cluster int, label string")
    assert cluster.assignment(pairs) == [(0, "a"), (1, "b")]


def test_dbscan_noise_and_blobs(spark):
    points = [(i, [0.01 * i, 0.0], 0) for i in range(8)] + [(10 + i, [5 + 0.01 * i, 0.0], 1) for i in range(8)] + [(99, [50.0, 50.0], 2)]
    rows = spark.createDataFrame(points, "row_id long, features array<double>, label int")
    got = {r["row_id"]: r["cluster"] for r in cluster.dbscan(rows, 0.05, 3).collect()}
    assert {got[i] for i in range(8)} == {0} and {got[10 + i] for i in range(8)} == {10} and got[99] == -1


def test_files(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x,y,name\n1,2.5,v\n3,4.5,u\n")
    (tmp_path / "a.csv").write_text("1,2,3\n")
    assert files.datasets(spark, str(tmp_path)) == ["a", "b"]
    assert files.datasets(spark, str(tmp_path), ["b", "c"]) == ["b"]
    rows = files.labelled(files.read_csv(spark, str(tmp_path / "b.csv"))).orderBy("label").collect()
    assert [(r["features"], r["label"]) for r in rows] == [([3.0, 4.5], 0), ([1.0, 2.5], 1)]
    records = report.records(spark)
    files.write_reports({"runs": records, "summary": report.run_summary(records, ["dataset"])}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "runs")).count() == records.count()


def test_missing_files_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n")
    assert files.datasets(spark, str(tmp_path), ["a", "b"]) == ["a"]
    with pytest.raises(FileNotFoundError):
        files.datasets(spark, str(tmp_path), ["a", "b"], missing="raise")


def test_sheets(spark, tmp_path):
    rows = [(1, 2.5, "a <&> b", [1, 2], True), (2, None, None, [], False), (3, float("nan"), " x", None, None)]
    df = spark.createDataFrame(rows, "n int, v double, name string, items array<int>, ok boolean").coalesce(1)
    assert sheets.write_sheet(df, str(tmp_path / "a.xlsx")) == 3
    got = sheets.read_sheet(spark, str(tmp_path / "a.xlsx"))
    assert got.dtypes == [("n", "double"), ("v", "double"), ("name", "string"), ("items", "string"), ("ok", "boolean")]
    assert [tuple(r) for r in got.collect()] == [(1.0, 2.5, "a <&> b", "1;2", True), (2.0, None, None, "", False), (3.0, None, " x", None, None)]
    both = sheets.read_sheets(spark, {"0.1": str(tmp_path / "a.xlsx"), "0.2": str(tmp_path / "a.xlsx")}, "rate")
    assert {(r["rate"], r["count"]) for r in both.groupBy("rate").count().collect()} == {("0.1", 3), ("0.2", 3)}
    sheets.write_sheet(df.limit(0), str(tmp_path / "b.xlsx"))
    assert sheets.read_sheet(spark, str(tmp_path / "b.xlsx")).count() == 0


@pytest.mark.parametrize("distance", ["euclidean", "cosine"])
def test_replicated_kmeans(spark, distance):
    rng = np.random.default_rng(0)
    middle = np.array([[9.0, 0, 0], [0, 9, 0], [0, 0, 9]])
    points = [(i, (middle[i % 3] + rng.normal(0, 0.2, 3)).tolist()) for i in range(60)]
    got = {r["row_id"]: r["cluster"] for r in cluster.replicated_kmeans(spark.createDataFrame(points, "row_id long, features array<double>"), 3, replicates=5, distance=distance).collect()}
    assert len({(i % 3, c) for i, c in got.items()}) == 3 and len(set(got.values())) == 3


def test_kmeans_refills_empty_clusters(spark):
    # equal rows as starts leave clusters empty; those take the farthest rows
    points = [(i, [0.0]) for i in range(40)] + [(50, [5.0]), (51, [9.0])]
    rows = spark.createDataFrame(points, "row_id long, features array<double>")
    got = {r["row_id"]: r["cluster"] for r in cluster.replicated_kmeans(rows, 3, replicates=1).collect()}
    assert len(set(got.values())) == 3 and len({got[0], got[50], got[51]}) == 3
    with pytest.raises(ValueError):
        cluster.replicated_kmeans(rows, 43)


def test_graph_scores(spark):
    rows = features.planted(spark, 40)
    every = score.infinite_scores(rows)
    d = len(every)
    got = score.graph_scores(rows, [(0, [1] * d), (1, [0] * d), (2, [1] + [0] * (d - 1))])
    assert got[0][1] == pytest.approx(-np.mean([e for _, e in every])) and got[1][1] == 0 and np.isfinite(got[2][1])


def test_stream_gives_the_table_s_summary(spark, tmp_path):
    records = report.records(spark).select("dataset", "method", "acc", "time")
    records.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(records.schema).parquet(str(tmp_path / "in"))
    to_memory(summary(stream, ["dataset", "method"]), "kept", str(tmp_path / "c")).awaitTermination()
    assert sorted(spark.table("kept").select("dataset", "method", "runs").collect()) == sorted(summary(records, ["dataset", "method"]).select("dataset", "method", "runs").collect())


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    to_memory(windowed(stream, "ts", "1 day", "1 day", ["event_type"]), "days", str(tmp_path / "c")).awaitTermination()
    assert spark.table("days").count() == windowed(events, "ts", "1 day", "1 day", ["event_type"]).count()


def test_command_line(spark, tmp_path):
    from maskforge.__main__ import main

    rows = [(float(i % 7), float(i % 2), float(i * i % 5), "b" if i % 2 else "a") for i in range(40)]
    spark.createDataFrame(rows, "x double, y double, z double, kind string").coalesce(1).write.option("header", True).csv(str(tmp_path / "in" / "toy.csv"))
    small = ["--runs", "1", "--population", "4", "--iterations", "3", "--interval-iterations", "2"]
    main(["ablation", str(tmp_path / "in"), str(tmp_path / "ablation"), "--modes", "full", "baseline", "--interval-num", "2", *small], spark)
    main(["sensitivity", str(tmp_path / "in"), str(tmp_path / "sweep"), "--phi", "0.9,0.99", "--ql-lr", "0.2", "--ql-gamma", "0.0", "--interval-num", "2", *small], spark)
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / name))
    assert sorted(r["mode"] for r in read("ablation").collect()) == ["baseline", "full"] and read("ablation_summary").count() == 2
    assert read("sweep").count() == 7 and {"runs", "accuracy_mean", "nf_std"} <= set(read("sweep_summary").columns)
    with pytest.raises(SystemExit):
        main(["ablation", str(tmp_path / "none"), str(tmp_path / "out")], spark)


def test_bins_do_not_depend_on_how_values_are_cut(spark, monkeypatch):
    from random import SystemRandom

    drawn = F.udf(lambda n: sorted(SystemRandom().random() for _ in range(63)), "array<double>")  # others each time, as of sketches merged in another order
    values = score.long(features.planted(spark, 400).select("row_id", "features", "label"))
    expected = sorted(tuple(r) for r in score.binned(values, 10).select("feature", "row_id", "bin").collect())
    monkeypatch.setattr(score.F, "percentile_approx", lambda value, *_: drawn(F.count(value)))
    assert sorted(tuple(r) for r in score.binned(values, 10).select("feature", "row_id", "bin").collect()) == expected
