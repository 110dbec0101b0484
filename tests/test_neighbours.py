"""Neighbours in memory against brute force, bounded memory, and work dealt to many tasks."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskforge.operators import cluster, evaluate, metrics, neighbours, score
from maskforge.operators.features import candidate_masks, plain_folds, planted, shuffled_split, with_split
from maskforge.plans import protocols
from maskforge.plans.search import LocalScorer, Options, SparkScorer, Task, base, scorer_for, search


def in_full(a, b, root):
    d = np.square(a[:, None] - b[None]).sum(2)
    return np.round(np.sqrt(d) if root else d, 9)


@pytest.mark.parametrize("root", [False, True])
@pytest.mark.parametrize(("d", "places", "shift"), [(1, 2, 0), (5, 1, 0), (40, 9, 0), (12, 9, 1000)])
def test_nearest_and_counted_as_brute_force(d, places, shift, root):
    draw = np.random.default_rng(d)
    b = np.round(draw.random((1500, d)), places) + shift
    b[700:900] = b[3]  # copies: ties go to the smaller place
    a = np.concatenate([b[::30], draw.random((40, d)) + shift])
    whole = in_full(a, b, root)
    got, place = neighbours.nearest_rows(a, neighbours.Rows(b), 4, root)
    expected = np.argsort(whole, axis=1, kind="stable")[:, :4]
    assert (place == expected).all()
    assert np.allclose(got, np.take_along_axis(whole, expected, 1), atol=1e-8, rtol=0)
    if root:
        eps = float(np.median(whole))
        assert (neighbours.counted(a, neighbours.Rows(b), eps) == (whole <= eps).sum(1)).all()


def test_odd_rows():
    b = np.array([[0.0], [1e200], [3.0]])
    assert neighbours.nearest_rows(np.array([[2.0]]), neighbours.Rows(b), 5)[1].tolist() == [[2, 0, 1]]
    assert neighbours.nearest_rows(np.empty((0, 1)), neighbours.Rows(b), 2)[1].shape == (0, 2)
    d, place = neighbours.nearest_rows(b[:1], neighbours.Rows(np.zeros((4, 1))), 3)
    assert neighbours.without_self(np.array([3]), d, place, 2)[1].tolist() == [[0, 1]]


def test_nearest_holds_no_matrix_of_all_pairs():
    draw = np.random.default_rng(0)
    asked, train = draw.random((3000, 8)), draw.random((20_000, 8))
    tracemalloc.start()
    evaluate.nearest(asked, train, np.arange(20_000), np.ones(8, bool), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # the matrix alone has 480 MB


def test_predictions_are_dealt_to_many_tasks(spark, monkeypatch):
    split = with_split(planted(spark, 2000), 1).coalesce(1)
    masks = candidate_masks(spark, 4, 12)
    whole = sorted(evaluate.predict(split, masks).collect())
    monkeypatch.setattr(neighbours, "TASK_PAIRS", 1 << 18)
    dealt = evaluate.predict(split, masks)
    assert dealt.rdd.getNumPartitions() > 4
    assert sorted(dealt.collect()) == whole


def test_splits_of_a_table_collected_once_agree_with_the_grid(spark, monkeypatch):
    rows, masks = planted(spark, 200), candidate_masks(spark, 3, 12)
    names = rows.select("row_id", "label")
    folds, shuffles = plain_folds(names, 4).where(F.col("row_id") >= 0), [shuffled_split(names, s) for s in (1, 2)]
    shared = [sorted(evaluate.predict_splits(rows, s, masks, 1).collect()) for s in (folds, shuffles)]
    assert len(shared[0]) == 2 * 200
    monkeypatch.setattr(evaluate, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(evaluate, "BLOCK_BYTES", 4000)
    assert [sorted(evaluate.predict_splits(rows, s, masks, 1).collect()) for s in (folds, shuffles)] == shared


def blobs(spark):
    return planted(spark, 300).unionByName(planted(spark, 20).withColumn("row_id", F.col("row_id") + 1000))  # some copies


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("made", [
    lambda p: cluster.density(p, 0.9, 5),
    lambda p: cluster.dbscan(p, 0.75, 6),
    lambda p: cluster.neighbour_graph(p, 3),
    lambda p: cluster.silhouette(p),
    lambda p: score.relieff(p, 3),
    lambda p: score.relieff(p, 3, samples=50),
], ids=["density", "dbscan", "graph", "silhouette", "relieff", "relieff_of_samples"])
def test_pairs_in_tasks_agree_with_blocks(spark, monkeypatch, made):
    monkeypatch.setattr(neighbours, "TASK_PAIRS", 1 << 15)
    shared = rows_of(made(blobs(spark)))
    monkeypatch.setattr(evaluate, "BROADCAST_BYTES", 0)
    assert rows_of(made(blobs(spark))) == shared


def test_pairs_are_dealt_and_not_written(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TASK_PAIRS", 1 << 18)
    monkeypatch.setattr(cluster, "pairs_within", None)  # of which there are as many as the square of a cluster
    points = planted(spark, 1500)
    assert cluster.density(points, 2.0, 5).rdd.getNumPartitions() > 2
    assert cluster.density(points, 9.0, 5).agg(F.min("degree"), F.max("degree")).first() == (1500, 1500)
    assert cluster.dbscan(points, 9.0, 5).distinct().count() == 1500
    assert score._summed_gaps(points, None, {0: 0.5, 1: 0.5}, np.ones(12), 5).rdd.getNumPartitions() > 2


def test_chain_of_core_rows_is_one_cluster(spark):
    line = spark.range(700).select(F.pmod(F.col("id") * 389, F.lit(700)).alias("row_id"), F.array(F.col("id").cast("double")).alias("features"))
    assert cluster.dbscan(line, 1.0, 2).select("cluster").distinct().collect() == [(0,)]
    assert cluster.dbscan(line, 0.5, 2).select("cluster").distinct().collect() == [(-1,)]


def test_searches_of_many_rows_go_by_jobs(spark, monkeypatch):
    options = Options(n=4, rounds=2, seed=1)
    split = with_split(planted(spark), 1)
    local = scorer_for(split)
    by_hold_out = rows_of(protocols.hold_out(spark, {"planted": planted(spark)}, ["PSO"], 1, options).select("nf", "fitness", "accuracy", "mask"))
    monkeypatch.setattr(base, "LOCAL_ROWS", 239)
    monkeypatch.setattr(protocols, "_local", None)
    by_jobs = scorer_for(split)
    assert isinstance(local, LocalScorer) and isinstance(by_jobs, SparkScorer)
    assert search("PSO", Task(local), options) == search("PSO", Task(by_jobs), options)
    assert rows_of(protocols.hold_out(spark, {"planted": planted(spark)}, ["PSO"], 1, options).select("nf", "fitness", "accuracy", "mask")) == by_hold_out


def counting(spark, rows):
    """The rows again, and how often they were worked out."""
    asked = spark.sparkContext.accumulator(0)

    def run(batches):
        asked.add(1)
        yield from batches

    return rows.coalesce(1).mapInArrow(run, rows.schema), asked


def test_predictions_are_made_once(spark):
    predictions, asked = counting(spark, spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, None)], "cand_id long, y long, p long"))
    assert sorted(tuple(r) for r in metrics.per_class(predictions, ["cand_id"]).collect()) == [(1, 0, 1, 0, 1), (1, 1, 0, 1, 1)]
    assert asked.value == 1


def test_tables_are_worked_out_once(spark):
    masks = candidate_masks(spark, 2, 12)
    rows, asked = counting(spark, with_split(planted(spark), 1).select("row_id", "features", "label", "is_valid"))
    evaluate.predict(rows, masks).collect()
    assert asked.value == 1
    rows, asked = counting(spark, planted(spark).select("row_id", "features", "label"))
    evaluate.predict_splits(rows, plain_folds(planted(spark), 3).select("row_id", "fold"), masks).collect()
    assert asked.value == 1


@pytest.mark.parametrize(("d", "places", "shift"), [(6, 1, 0), (24, 9, 0), (12, 9, 1000), (9, 0, 0)])
def test_nested_columns_as_each_by_itself(monkeypatch, d, places, shift):
    monkeypatch.setattr(neighbours, "SAMPLED", 4)
    draw = np.random.default_rng(d)
    b = np.round(draw.random((6500, d)), places) + shift
    b[700:900] = b[3]  # copies: ties go to the smaller place
    b[:, 2] = shift
    a = np.concatenate([b[::30], draw.random((400, d)) + shift])
    sizes = [*range(1, d - 2), d - 2, d]  # one twice, one left out
    for size, (got, place) in zip(sizes, neighbours.nearest_nested(a, neighbours.Nest(b), sizes, 4), strict=True):
        whole = in_full(a[:, :size], b[:, :size], False)
        expected = np.argsort(whole, axis=1, kind="stable")[:, :4]
        assert (place == expected).all()
        assert np.allclose(got, np.take_along_axis(whole, expected, 1), atol=1e-8, rtol=0)


def test_nested_columns_of_odd_rows():
    b = np.array([[0.0, 1.0], [1e200, 2.0], [3.0, 0.0]])
    found = neighbours.nearest_nested(np.array([[2.0, 1.0]]), neighbours.Nest(b), [1, 2], 5)
    assert [place.tolist() for _, place in found] == [[[2, 0, 1]], [[2, 0, 1]]]
    assert [place.shape for _, place in neighbours.nearest_nested(np.empty((0, 2)), neighbours.Nest(b), [1, 2], 2)] == [(0, 2)] * 2


def test_masks_that_grow_are_scored_together(spark, monkeypatch):
    split = with_split(planted(spark, 2000), 1)
    order = [5, 2, 8, 0, 11, 3, 10, 1, 4, 6, 7, 9]
    masks = evaluate.prefix_candidates(order, 12) + [(20 + i, m) for i, (_, m) in enumerate(evaluate.prefix_candidates(order[::-1], 12, [3, 3, 5]))]
    assert [len(c) for c in evaluate.chains([np.array(m, bool) for _, m in masks])] == [12, 3]
    masks = spark.createDataFrame(masks, "cand_id int, mask array<int>")
    each = sorted(evaluate.predict(split, masks).collect())
    monkeypatch.setattr(evaluate, "nearest_rows", None)  # not used
    monkeypatch.setattr(evaluate, "NESTED_ROWS", 100)
    assert sorted(evaluate.predict(split, masks).collect()) == each
    monkeypatch.setattr(evaluate, "BROADCAST_BYTES", 0)
    assert sorted(evaluate.predict(split, masks).collect()) == each


def test_nested_columns_take_fewer_looks_than_numbers(monkeypatch):
    draw = np.random.default_rng(1)
    a, b = draw.random((300, 40)), draw.random((20_000, 40))
    alone, between = [], []
    whole, some = neighbours.nearest_rows, neighbours._between
    monkeypatch.setattr(neighbours, "nearest_rows", lambda *x: alone.append(1) or whole(*x))
    monkeypatch.setattr(neighbours, "_between", lambda *x: between.append(some(*x)) or between[-1])
    neighbours.nearest_nested(a, neighbours.Nest(b), list(range(1, 41)), 3)
    assert len(alone) + sum(x is not None for x in between) <= 25


def test_labels_counted_in_memory_as_by_jobs(spark, monkeypatch):
    rows = planted(spark, 300).withColumn("features", F.transform("features", lambda v, i: F.when(i % 2 == 0, F.round(v, 1)).otherwise(v)))  # ties
    order = lambda r: sorted((x["feature"], round(x["mi"], 9), round(x["su"], 9)) for x in r.collect())
    whole = order(score.label_information(rows))
    monkeypatch.setattr(score, "binned", None)  # not used
    assert order(score.label_information(rows, gather=True)) == whole
    lacking = F.transform("features", lambda v, i: F.when((F.col("row_id") > 5) | (i > 0), v))
    for odd in (rows.withColumn("features", lacking), rows.withColumn("features", F.slice("features", 1, (F.col("row_id") % 2 + 3).cast("int"))), rows.where("row_id < 0"), rows.withColumn("label", F.lit(None).cast("int"))):
        assert score.label_counts(odd) is None
    monkeypatch.setattr(evaluate, "BROADCAST_BYTES", 0)
    assert score.label_counts(rows) is None
