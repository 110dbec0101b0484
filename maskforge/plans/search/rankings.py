"""Methods that rank features first and score the ranking's prefixes."""

from __future__ import annotations

import numpy as np

from maskforge.plans.search import method
from maskforge.plans.search.base import Found, Options, Task, resampled
from maskforge.plans.search.values import codes_of, moments, redundancy_ratio, unit


def prefixes(task: Task, ranking: np.ndarray, longest: int) -> Found:
    """Scores the first 1 .. longest features of a ranking as one batch; of equal costs the shortest is best."""
    masks = np.zeros((longest, task.d), bool)
    for n in range(longest):
        masks[n, ranking[: n + 1]] = True
    cost = task.score(masks)
    task.curve = resampled(np.minimum.accumulate(cost[::-1]).tolist(), task.options.rounds)
    return task.found(ranking=[int(f) for f in ranking])


@method("inf")
def infinite(task: Task, o: Options) -> Found:
    """Energy of all paths over the graph of class separation and spread."""
    gap, std = moments(task)
    graph = 0.5 * unit(np.outer(gap, gap)) + 0.5 * unit(np.maximum(std[:, None], std[None]))
    energy = np.linalg.inv(np.eye(task.d) - 0.9 / (np.abs(np.linalg.eigvals(graph)).max() or 1.0) * graph).sum(1)
    return prefixes(task, np.argsort(-energy, kind="stable"), min(o.rounds, task.d))


@method("mrmra")
def least_redundant(task: Task, o: Options) -> Found:
    """Binned information with the label over the mean with the other features."""
    return prefixes(task, np.argsort(-np.round(redundancy_ratio(task), 9), kind="stable"), min(o.rounds, task.d))


def learned_weights(task: Task, inside: np.ndarray, passes: int = 3) -> np.ndarray:
    """Linear action values of each class, learned sample by sample with rewards for right classes; features' summed sizes."""
    x, y = task.sample()
    labels = codes_of(y)
    w = np.zeros((labels.max() + 1, task.d))
    for _ in range(passes):
        for i in task.rng.permutation(len(x)):
            row = x[i] * inside
            value = w @ row
            action = int(task.rng.integers(len(w))) if task.rng.random() < 0.2 else int(value.argmax())
            w[action] += 0.05 * ((1.0 if action == labels[i] else -1.0) - value[action]) * row
    return np.abs(w).sum(0) * inside


@method("qlfs")
def learned_ranking(task: Task, o: Options) -> Found:
    weight = learned_weights(task, np.ones(task.d))
    return prefixes(task, np.argsort(-weight, kind="stable"), max(1, int(0.4 * task.d)))


@method("QLFS")
def learned_elimination(task: Task, o: Options) -> Found:
    """As above, with the weakest tenth left out and the rest learned again, until one is left."""
    inside, gone = np.ones(task.d), []
    while inside.sum() > 1:
        on = np.flatnonzero(inside)
        weakest = on[np.argsort(learned_weights(task, inside, 1)[on], kind="stable")[: max(1, len(on) // 10)]]
        gone += weakest.tolist()
        inside[weakest] = 0
    ranking = np.array([*np.flatnonzero(inside), *gone[::-1]])
    return prefixes(task, ranking, max(1, int(0.4 * task.d)))
