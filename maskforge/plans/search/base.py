"""What all search methods share: options, scoring with a memory, and the record of the best."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskforge.functions.portable import uniform, uniform_py
from maskforge.operators.cluster import mask_error
from maskforge.operators.evaluate import FITNESS, Prepared, fold_fitness, nearest, predict, voted
from maskforge.operators.features import with_folds
from maskforge.operators.metrics import confusion

#: Seed of the folds of both scorers, and of the order of the rows that are learned one by one; how many those are at most.
FOLD_SEED, LEARN_SEED, LEARN_ROWS = 42, 7, 5_000


@dataclass(frozen=True)
class Options:
    """n: candidates; rounds: iterations; phi: weight of the error; folds: 0 for the fixed split.

    classifier: ``knn``, or a kind of ``operators.classifiers``; func 4 needs no labels
    (indices of ``clusters`` k-means clusters). Both are scored by jobs, not in a task.
    """

    n: int = 20
    rounds: int = 50
    seed: int = 0
    k: int = 3
    phi: float = 0.99
    func: int = 0
    folds: int = 0
    threshold: float = 0.5
    intervals: int | None = None
    interval_rounds: int = 20
    learning_rate: float = 0.2
    discount: float = 0.0
    mode: str = "full"
    local_steps: int = 5
    classifier: str = "knn"
    clusters: int = 2

    def replace(self, **changes) -> Options:
        return dataclasses.replace(self, **changes)


@dataclass
class Found:
    """The best mask, its cost, the best cost after each round, and the number of masks that were scored."""

    mask: list[int]
    fitness: float
    curve: list[float]
    scored: int
    extra: dict = field(default_factory=dict)

    @property
    def n_selected(self) -> int:
        return sum(self.mask)


class LocalScorer:
    """Cost of masks over a table that fits one task; for many independent runs side by side.

    ids: row ids in ascending order (default: places); folds are dealt by their portable hash, as over a DataFrame.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, ids: np.ndarray | None = None):
        self.x, self.y, self.valid = np.asarray(x, float), np.asarray(y), np.asarray(valid, bool)
        self.d = self.x.shape[1]
        self.ids = np.arange(len(self.y)) if ids is None else ids

    def rows(self) -> int:
        return int((~self.valid).sum())

    def sampled(self, share: float, seed: int) -> LocalScorer:
        """With the training rows whose portable hash is under the share, and all validation rows."""
        keep = self.valid | np.array([uniform_py("level", seed, i) < share for i in self.ids.tolist()])
        return LocalScorer(self.x[keep], self.y[keep], self.valid[keep], self.ids[keep])

    def errors(self, masks: np.ndarray, options: Options) -> np.ndarray:
        if options.classifier != "knn" or options.func == 4:
            raise ValueError("this classifier or fitness is scored by jobs; use SparkScorer")
        if options.folds:
            place = np.zeros(len(self.y), int)
            draw = np.array([uniform_py(FOLD_SEED, i) for i in self.ids.tolist()])
            for name in np.unique(self.y):
                rows = np.flatnonzero(self.y == name)
                place[rows[np.lexsort((self.ids[rows], draw[rows]))]] = np.arange(len(rows)) % options.folds
            parts = [place == f for f in range(options.folds)]
        else:
            parts = [self.valid]
        return np.mean([[self._error(m.astype(bool), part, options) for m in masks] for part in parts], axis=0)

    def _error(self, mask: np.ndarray, valid: np.ndarray, options: Options) -> float:
        train = np.flatnonzero(~valid)
        _, place = nearest(self.x[valid], self.x[train], train, mask, options.k)
        return hard_error(self.y[valid], voted(self.y[train][place]), options.func)


def hard_error(y: np.ndarray, p: np.ndarray, func: int, n: np.ndarray | None = None) -> float:
    """Error of predictions by the number of the fitness function; ``n`` counts how often each (y, p) stands."""
    weight, other, more = FITNESS[func]
    n = np.ones(len(y)) if n is None else n.astype(float)
    share = lambda hit, within: n[hit & within].sum() / n[within].sum()
    everywhere = np.ones(len(y), bool)
    accuracy = share(y == p, everywhere)
    if other is None:
        return float(weight * (1 - accuracy))
    labels = np.union1d(y, p) if other == "f1_macro" else np.unique(y)
    if other == "f1_macro":
        value = np.mean([2 * n[(y == c) & (p == c)].sum() / (n[y == c].sum() + n[p == c].sum()) for c in labels])
    else:
        used = labels[-1:] if len(labels) == 2 else labels
        value = 0.5 if len(labels) < 2 else np.mean([(share(p == c, y == c) + 1 - share(p == c, y != c)) / 2 for c in used])
    return float(weight * (1 - accuracy) + more * (1 - value))


class SparkScorer:
    """Cost of masks over a DataFrame with row_id, features, label and is_valid: one job for a batch of masks.

    The job ends in the counts of (mask, label, prediction), from which the driver works out the errors.
    """

    def __init__(self, split: DataFrame):
        self.split = split.persist()
        self.d = self.split.select(F.max(F.size("features"))).first()[0]
        self.prepared = None

    def rows(self) -> int:
        return self.split.where(~F.col("is_valid")).count()

    def sampled(self, share: float, seed: int) -> SparkScorer:
        return SparkScorer(self.split.where(F.col("is_valid") | (uniform("level", seed, F.col("row_id")) < share)))

    def errors(self, masks: np.ndarray, options: Options) -> np.ndarray:
        rows = [(i, [int(b) for b in m]) for i, m in enumerate(masks)]
        candidates = self.split.sparkSession.createDataFrame(rows, "cand_id int, mask array<int>")
        if options.func == 4:
            return np.array([mask_error(self.split, m, options.clusters) for _, m in rows])
        if options.classifier != "knn":
            return np.array([self._classified(m, options) for _, m in rows])
        if options.folds:
            got = fold_fitness(self.split.drop("is_valid"), candidates, options.folds, options.k, options.phi, options.func)
            by = {r["cand_id"]: r["error"] for r in got.select("cand_id", "error").collect()}
            return np.array([by[i] for i in range(len(rows))])
        self.prepared = self.prepared or Prepared(self.split)
        cells: dict[int, list] = {i: [] for i in range(len(rows))}
        for r in confusion(predict(self.prepared, candidates, options.k), ["cand_id"]).collect():
            cells[r["cand_id"]].append((r["y"], r["p"], r["n"]))
        out = []
        for found in cells.values():
            y, p, n = np.array(sorted(found)).T
            out.append(hard_error(y, p, options.func, n))
        return np.array(out)


    def _classified(self, mask: list[int], options: Options) -> float:
        from maskforge.operators.classifiers import predictions

        parts = [self.split]
        if options.folds:
            dealt = with_folds(self.split.drop("is_valid"), options.folds, FOLD_SEED)
            parts = [dealt.withColumn("is_valid", F.col("fold") == f).drop("fold") for f in range(options.folds)]
        errors = []
        for part in parts:
            cells = confusion(predictions(part, options.classifier, mask, options.seed), []).collect()  # as many as classes, squared
            y, p, n = np.array(sorted((r["y"], r["p"], r["n"]) for r in cells)).T
            errors.append(hard_error(y, p, options.func, n))
        return float(np.mean(errors))


#: Tables of more rows are scored by jobs: one process would look at the square of the rows for each mask.
LOCAL_ROWS = 10_000


def scorer_for(split: DataFrame, limit: int = 64 << 20) -> LocalScorer | SparkScorer:
    """Scores where the table is: in this process if it has at most ``limit`` bytes and ``LOCAL_ROWS`` rows, else by jobs."""
    n, d = split.agg(F.count("*"), F.max(F.size("features"))).first()
    if n > LOCAL_ROWS or n * ((d or 0) + 3) * 8 > limit:
        return SparkScorer(split)
    rows = sorted(split.select("row_id", "features", "label", "is_valid").collect())
    return LocalScorer(np.array([r[1] for r in rows], float), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[0] for r in rows]))


class Task:
    """A table to search: scores masks, remembers them, and keeps the best and the curve."""

    def __init__(self, scorer: LocalScorer | SparkScorer):
        self.scorer, self.d = scorer, scorer.d
        self.prepared(Options())

    def prepared(self, options: Options) -> Task:
        self.options, self.rng = options, np.random.default_rng(options.seed)
        self.seen: dict[bytes, float] = {}
        self.best, self.cost, self.curve, self.scored = np.ones(self.d, bool), np.inf, [], 0
        return self

    def on_sample(self, share: float, seed: int) -> Task:
        """The same task over a sample of the training rows; it draws from this task's generator."""
        part = Task(self.scorer.sampled(share, seed)).prepared(self.options)
        part.rng = self.rng
        return part

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Features and labels of at most ``LEARN_ROWS`` training rows, those of least portable hash, for methods that learn row by row; the same at any size."""
        if isinstance(self.scorer, LocalScorer):
            ids = self.scorer.ids.tolist()
            some = np.array(sorted(np.flatnonzero(~self.scorer.valid).tolist(), key=lambda i: (uniform_py(LEARN_SEED, ids[i]), ids[i]))[:LEARN_ROWS])
            return self.scorer.x[some], self.scorer.y[some]
        order = uniform(LEARN_SEED, F.col("row_id")), F.col("row_id")
        rows = self.scorer.split.where(~F.col("is_valid")).orderBy(*order).limit(LEARN_ROWS).select("features", "label").collect()
        return np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])

    def score(self, masks: np.ndarray) -> np.ndarray:
        """phi * error + (1 - phi) * share of features; masks seen before aren't scored again, empty ones cost 1."""
        masks = np.atleast_2d(np.asarray(masks)).astype(bool)
        keys = [m.tobytes() for m in masks]
        new = list({k: i for i, k in enumerate(keys) if k not in self.seen and masks[i].any()}.values())
        if new:
            phi = min(1.0, max(0.0, self.options.phi))
            error = self.scorer.errors(masks[new], self.options)
            for i, e in zip(new, error, strict=True):
                self.seen[keys[i]] = float(phi * e + (1 - phi) * masks[i].sum() / self.d)
            self.scored += len(new)
        out = np.array([self.seen.get(k, 1.0) for k in keys])
        for i in np.argsort(out, kind="stable")[:1]:
            if (out[i], masks[i].sum()) < (self.cost, self.best.sum()) and masks[i].any():
                self.best, self.cost = masks[i].copy(), float(out[i])
        return out

    def score_positions(self, x: np.ndarray) -> np.ndarray:
        return self.score(np.atleast_2d(x) > self.options.threshold)

    def note(self) -> None:
        self.curve.append(min(1.0, self.cost))

    def found(self, **extra) -> Found:
        return Found(self.best.astype(int).tolist(), min(1.0, self.cost), list(self.curve), self.scored, extra)


def resampled(curve: list[float], n: int) -> list[float]:
    """The curve at n evenly spaced places, rounded half to even."""
    if not curve:
        return [1.0] * n
    return [curve[int(np.round(i * (len(curve) - 1) / max(n - 1, 1)))] for i in range(n)]


def positions(task: Task, n: int | None = None) -> np.ndarray:
    return task.rng.random((n or task.options.n, task.d))


def roulette(rng: np.random.Generator, weight: np.ndarray) -> int:
    total = weight.cumsum()
    return int(min(np.searchsorted(total, rng.random() * total[-1], side="right"), len(weight) - 1))


def sigmoid(v: np.ndarray, slope: float = 1.0) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * v, -60, 60)))


def correlated(x: np.ndarray) -> np.ndarray:
    """Absolute correlations of the columns; 0 with a constant one, 1 with itself."""
    z = x - x.mean(0)
    size = np.sqrt(np.square(z).sum(0))
    r = np.abs((z / np.where(size == 0, 1.0, size)).T @ (z / np.where(size == 0, 1.0, size)))
    np.fill_diagonal(r, 1.0)
    return r
