"""Experiment protocols: repeated hold-out, cross-validation, sweeps and ablations.

An experiment is a relation of tasks (data set, method, run, options). Tasks of
data sets that fit ``LOCAL_BYTES`` and ``LOCAL_ROWS`` run side by side on the executors, a search in
each; those of a larger data set run one after the other, each scoring its
masks with distributed jobs. Runs are reproducible: a task's draws come from
its own seed. Every test score is taken on rows that the search has not used to train.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskforge.operators.evaluate import nearest, predict, voted
from maskforge.operators.features import fold_count, scaled, with_folds, with_split
from maskforge.operators.metrics import metrics
from maskforge.plans.search import LocalScorer, Options, SparkScorer, Task, base, search

LOCAL_BYTES = 64 << 20
MEASURES = ["accuracy", "f1_macro", "auc_macro", "recall_macro", "precision_macro"]
RECORD = "dataset string, method string, run int, config string, nf int, time double, fitness double, accuracy double, f1_macro double, auc_macro double, recall_macro double, precision_macro double, mask array<int>, curve array<double>"
ABLATION_MODES = ["baseline", "dim_only", "random_policy", "full"]


def hard_metrics(y: np.ndarray, p: np.ndarray) -> dict[str, float | None]:
    """The metrics of ``operators.metrics`` over two arrays."""
    labels, true = np.union1d(y, p), np.unique(y)
    tp = {c: int(((y == c) & (p == c)).sum()) for c in labels}
    pos, said = {c: int((y == c).sum()) for c in labels}, {c: int((p == c).sum()) for c in labels}
    used = true[-1:] if len(true) == 2 else true
    auc = None if len(true) < 2 else float(np.mean([(tp[c] / pos[c] + 1 - (said[c] - tp[c]) / (len(y) - pos[c])) / 2 for c in used]))
    return {
        "accuracy": float((y == p).mean()),
        "f1_macro": float(np.mean([2 * tp[c] / (pos[c] + said[c]) for c in labels])),
        "auc_macro": auc,
        "recall_macro": float(np.mean([tp[c] / pos[c] if pos[c] else 0.0 for c in labels])),
        "precision_macro": float(np.mean([tp[c] / said[c] if said[c] else 1.0 for c in labels])),
    }


def records(spark: SparkSession, datasets: dict[str, DataFrame], methods: list[str], runs: int, configs: list[Options] | None = None, share: float = 0.3, folds: int = 0) -> DataFrame:
    """One record for each data set, method, configuration and run.

    Without folds, run r searches on the stratified split of seed r; with folds, run r
    holds out fold r, and data sets whose smallest class has under two rows are left out.
    """
    parts = []
    for name, features in datasets.items():
        table = scaled(features)
        n, d = table.agg(F.count("*"), F.max(F.size("features"))).first()
        turns = min(folds, fold_count(table, folds)) if folds else runs
        if not n or folds and turns < 2:
            continue
        todo = list(itertools.product(methods, range(turns), configs or [Options()]))
        if n <= base.LOCAL_ROWS and n * (d + 2) * 8 <= LOCAL_BYTES:
            parts.append(_local(spark, name, table, todo, share, turns if folds else 0))
        else:
            parts.append(spark.createDataFrame([_record(name, m, r, o, *_run(_split(table, r, share, turns if folds else 0), m, r, o)) for m, r, o in todo], RECORD))
    out = parts[0] if parts else spark.createDataFrame([], RECORD)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _split(table: DataFrame, run: int, share: float, folds: int) -> DataFrame:
    return with_folds(table, folds).withColumn("is_valid", F.col("fold") == run).drop("fold") if folds else with_split(table, run, share)


def _config(o: Options) -> str:
    return ";".join(f"{k}={v}" for k, v in vars(o).items())


def _record(dataset: str, name: str, run: int, o: Options, found, seconds: float, measured: dict) -> tuple:
    return (dataset, name, run, _config(o), found.n_selected, seconds, found.fitness, *[measured[m] for m in MEASURES], found.mask, found.curve)


def _run(split: DataFrame, name: str, run: int, o: Options):
    began = time.time()
    found = search(name, Task(SparkScorer(split)), o.replace(seed=o.seed + run))
    mask = found.mask if any(found.mask) else [1] * len(found.mask)
    one = split.sparkSession.createDataFrame([(0, mask)], "cand_id int, mask array<int>")
    return found, time.time() - began, metrics(predict(split, one, o.k), ["cand_id"]).first().asDict()


def _local(spark: SparkSession, dataset: str, table: DataFrame, todo: Iterable[tuple[str, int, Options]], share: float, folds: int) -> DataFrame:
    todo = list(todo)
    splits, shown = {}, None
    for run in sorted({r for _, r, _ in todo}):
        rows = sorted(_split(table, run, share, folds).select("row_id", "features", "label", "is_valid").collect())
        shown = shown or (np.array([r[1] for r in rows], float), np.array([r[2] for r in rows]), np.array([r[0] for r in rows]))
        splits[run] = np.array([r[3] for r in rows])
    shared = spark.sparkContext.broadcast((shown, splits, todo))  # the table once, and the flags of each run

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (x, y, ids), splits, todo = shared.value
        for frame in frames:
            out = []
            for i in frame["id"]:
                name, run, o = todo[int(i)]
                valid = splits[run]
                began = time.time()
                found = search(name, Task(LocalScorer(x, y, valid, ids)), o.replace(seed=o.seed + run))
                mask = np.array(found.mask, bool) if any(found.mask) else np.ones(len(found.mask), bool)
                train = np.flatnonzero(~valid)
                _, place = nearest(x[valid], x[train], train, mask, o.k)
                out.append(_record(dataset, name, run, o, found, time.time() - began, hard_metrics(y[valid], voted(y[train][place]))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])

    slots = min(len(todo), max(1, spark.sparkContext.defaultParallelism * 4))
    return spark.range(0, len(todo), 1, slots).mapInPandas(work, RECORD)


def hold_out(spark: SparkSession, datasets: dict[str, DataFrame], methods: list[str], runs: int = 5, options: Options | None = None) -> DataFrame:
    return records(spark, datasets, methods, runs, [options or Options()])


def cross_validation(spark: SparkSession, datasets: dict[str, DataFrame], methods: list[str], folds: int = 5, options: Options | None = None) -> DataFrame:
    return records(spark, datasets, methods, folds, [options or Options()], folds=folds)


def sensitivity(spark: SparkSession, datasets: dict[str, DataFrame], grid: dict[str, list], runs: int = 5, options: Options | None = None, method: str = "interval_elite_swarm", one_at_a_time: bool = True, share: float = 0.3) -> DataFrame:
    """Records of a parameter grid; each parameter in turn around the first values, or all combinations."""
    options = options or Options()
    first = {k: v[0] for k, v in grid.items()}
    points = [first | {k: v} for k, values in grid.items() for v in values] if one_at_a_time else [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    return records(spark, datasets, [method], runs, [options.replace(**p) for p in points], share)


def ablation(spark: SparkSession, datasets: dict[str, DataFrame], runs: int = 5, options: Options | None = None, modes: list[str] | None = None, method: str = "interval_elite_swarm", share: float = 0.3) -> DataFrame:
    return records(spark, datasets, [method], runs, [(options or Options()).replace(mode=m) for m in modes or ABLATION_MODES], share)

