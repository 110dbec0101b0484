"""Scores of features from all rows of a table, for methods that are guided by them: in this process over a local table, else by jobs that end in as many numbers as features, or squared."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskforge.operators import score
from maskforge.plans.search.base import SparkScorer, Task, correlated


def bins_of(values: np.ndarray, bins: int = 10) -> np.ndarray:
    rank = np.argsort(np.argsort(values, axis=0, kind="stable"), axis=0, kind="stable")
    return rank * bins // len(values)


def entropy(codes: np.ndarray) -> float:
    p = np.unique(codes, return_counts=True)[1] / len(codes)
    return float(-(p * np.log2(p)).sum())


def uncertainty(a: np.ndarray, b: np.ndarray) -> float:
    """2 I / (Ha + Hb) of two discrete columns, 0 if neither varies."""
    ha, hb = entropy(a), entropy(b)
    both = entropy(a.astype(np.int64) * (int(b.max()) + 1) + b)
    return 2 * max(0.0, ha + hb - both) / (ha + hb) if ha + hb else 0.0


def codes_of(y: np.ndarray) -> np.ndarray:
    return np.unique(y, return_inverse=True)[1]


def uncertainties(task: Task) -> np.ndarray:
    """Symmetrical uncertainty of each feature with the label, over all rows."""
    if isinstance(task.scorer, SparkScorer):
        return _column(score.label_information(task.scorer.split).select("feature", "su"), task.d)
    binned, labels = bins_of(task.scorer.x), codes_of(task.scorer.y)
    return np.array([uncertainty(binned[:, f], labels) for f in range(task.d)])


def _column(found: DataFrame, d: int) -> np.ndarray:
    """A number for each feature, from rows of feature and value."""
    out = np.zeros(d)
    for f, v in found.collect():
        out[f] = v or 0.0
    return out


def _square(pairs: DataFrame, d: int, own: float) -> np.ndarray:
    """A number for each two features, from rows of f, g and value."""
    out = np.full((d, d), own)
    for f, g, v in pairs.collect():
        out[f, g] = out[g, f] = v or 0.0
    return out


def pair_uncertainties(task: Task) -> np.ndarray:
    if isinstance(task.scorer, SparkScorer):
        return _square(score.pair_information(task.scorer.split).select("f", "g", "su"), task.d, 1.0)
    binned = bins_of(task.scorer.x)
    return np.array([[1.0 if f == g else uncertainty(binned[:, f], binned[:, g]) for g in range(task.d)] for f in range(task.d)])


def redundancy_ratio(task: Task) -> np.ndarray:
    """Binned information with the label over the mean with the other features."""
    if isinstance(task.scorer, SparkScorer):
        return _column(score.mrmr(task.scorer.split).select("feature", "miq"), task.d)
    b, labels = bins_of(task.scorer.x), codes_of(task.scorer.y)
    h = [entropy(b[:, f]) for f in range(task.d)]
    mutual = lambda f, codes, hc: max(0.0, h[f] + hc - entropy(b[:, f].astype(np.int64) * 1_000_003 + codes))
    hy = entropy(labels)
    return np.array([mutual(f, labels, hy) / (np.mean([mutual(f, b[:, g], h[g]) for g in range(task.d) if g != f] or [0.0]) + 1e-6) for f in range(task.d)])


def correlations(task: Task) -> np.ndarray:
    """Absolute correlations; 0 with a constant feature, 1 with itself."""
    if isinstance(task.scorer, SparkScorer):
        return np.abs(_square(score.correlations(task.scorer.split), task.d, 1.0))
    return correlated(task.scorer.x)


def moments(task: Task) -> tuple[np.ndarray, np.ndarray]:
    """Fisher score of the last label against the others, and sample deviation, of each feature."""
    if isinstance(task.scorer, SparkScorer):
        split = task.scorer.split
        last = split.agg(F.max("label")).first()[0]
        return _column(score.fisher(split, last), task.d), _column(score.deviations(split), task.d)
    x, y = task.scorer.x, task.scorer.y
    one = y == np.unique(y)[-1]
    var = x[one].var(0, ddof=1) + x[~one].var(0, ddof=1) if one.sum() > 1 and (~one).sum() > 1 else np.zeros(task.d)
    gap = np.square(x[one].mean(0) - x[~one].mean(0)) if one.any() and (~one).any() else np.zeros(task.d)
    return gap / np.where(var == 0, 10000.0, var), x.std(0, ddof=1)


def unit(v: np.ndarray) -> np.ndarray:
    return (v - v.min()) / np.ptp(v) if np.ptp(v) else np.zeros_like(v)


def relevance(task: Task) -> np.ndarray:
    return unit(uncertainties(task))


def relief(x: np.ndarray, y: np.ndarray, neighbours: int = 5) -> np.ndarray:
    """Misses, weighted by class prior, less hits, over value ranges, averaged over all rows."""
    span = np.where(np.ptp(x, axis=0) == 0, 1.0, np.ptp(x, axis=0))
    names, counts = np.unique(y, return_counts=True)
    prior = dict(zip(names.tolist(), (counts / len(y)).tolist(), strict=True))
    total = np.zeros(x.shape[1])
    for i in range(len(x)):
        d = np.round(np.square(x - x[i]).sum(1), 9)
        own = y[i].item() if hasattr(y[i], "item") else y[i]
        for name, p in prior.items():
            near = np.flatnonzero((y == name) & (np.arange(len(x)) != i))
            near = near[np.argsort(d[near], kind="stable")[:neighbours]]
            if len(near):
                gap = (np.abs(x[near] - x[i]) / span).mean(0)
                total += -gap if name == own else p / (1 - prior[own]) * gap
    return total / len(x)


def relief_weights(task: Task) -> np.ndarray:
    if isinstance(task.scorer, SparkScorer):
        return unit(_column(score.relieff(task.scorer.split), task.d))
    return unit(relief(task.scorer.x, task.scorer.y))


def adaptive(task: Task, least: float = 0.5) -> np.ndarray:
    """Features whose scaled uncertainty and relief lie far enough from 0, or the best tenth."""
    far = np.hypot(relevance(task), relief_weights(task))
    chosen = np.flatnonzero(far >= least)
    return chosen if len(chosen) else np.sort(np.argsort(far, kind="stable")[-max(1, task.d // 10) :])
