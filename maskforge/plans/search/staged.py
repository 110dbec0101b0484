"""Methods that search on samples of rows, on groups of like features, or by turning bits."""

from __future__ import annotations

import math

import numpy as np

from maskforge.plans.search import method
from maskforge.plans.search.base import Found, Options, Task
from maskforge.plans.search.swarms import crossed, rivals, survive
from maskforge.plans.search.values import correlations, uncertainties

#: Share of the training rows at the first level, and the least number of them.
FIRST_SHARE, LEAST_ROWS = 1 / 16, 32


def chc(task: Task, x: np.ndarray, rounds: int, note) -> tuple[np.ndarray, np.ndarray]:
    """Half-uniform crossover of unlike parents, elitist survival, and a restart from the best when parents are all alike."""
    n = len(x)
    cost, limit = task.score(x), task.d / 4
    for _ in range(rounds):
        order, children = task.rng.permutation(n), []
        for i, j in zip(order[::2], order[1::2], strict=False):
            unlike = np.flatnonzero(x[i] ^ x[j])
            if len(unlike) / 2 > limit:
                swap = task.rng.choice(unlike, len(unlike) // 2, replace=False)
                a, b = x[i].copy(), x[j].copy()
                a[swap], b[swap] = x[j][swap], x[i][swap]
                children += [a, b]
        if children:
            x, cost = survive(x, cost, np.array(children), task.score(np.array(children)), n)
        else:
            limit -= 1
        if limit < 0:
            x = task.best ^ (task.rng.random(x.shape) < 0.35)
            x[0] = task.best
            cost, limit = task.score(x), task.d / 4
        note()
    return x, cost


@method("SAGA")
def surrogate_levels(task: Task, o: Options) -> Found:
    """CHC on a sample of the training rows, doubled at each level while the population halves, then on all of them.

    A level ends when its best mask doesn't lower the best cost over the whole table;
    the next starts from that best mask and masks of as many features. Levels on
    samples take at most half of the rounds.
    """
    share, n = max(FIRST_SHARE, LEAST_ROWS / max(1, task.scorer.rows())), max(4, o.n)
    x, used, level, extra = task.rng.random((n, task.d)) < 0.5, 0, 0, 0
    step = max(1, o.rounds // 10)
    while share < 1 and used + step <= o.rounds // 2:
        part = task.on_sample(share, level)
        while used + step <= o.rounds // 2:
            x, cost = chc(part, x, step, task.note)
            used += step
            before = task.cost
            task.score(x[cost.argmin()])
            if task.cost >= before:
                break
        extra += part.scored
        share, level, n = 2 * share, level + 1, max(4, n // 2)
        x = around(task, n)
    x = around(task, max(4, o.n)) if level else x
    chc(task, x, o.rounds - used, task.note)
    return task.found(levels=level, scored_on_samples=extra)


def around(task: Task, n: int) -> np.ndarray:
    """The best mask, and masks of about as many features."""
    x = task.rng.random((n, task.d)) < task.best.mean()
    x[0] = task.best
    return x


@method("srbfo")
def binary_bacteria(task: Task, o: Options) -> Found:
    """Bacteria better than the mean turn all bits, the others a few; only what is better stays.

    Every fifth round the better half doubles, every third a quarter is dispersed.
    """
    x = task.rng.random((o.n, task.d)) > 0.5
    cost = task.score(x)
    few = max(1, task.d // max(1, o.rounds))
    for t in range(1, o.rounds + 1):
        trial = x.copy()
        good = cost < cost.mean()
        trial[good] ^= True
        for i in np.flatnonzero(~good):
            trial[i, task.rng.integers(0, task.d, few)] ^= True
        now = task.score(trial)
        better = now < cost
        x[better], cost[better] = trial[better], now[better]
        if t % 5 == 0:
            half = np.argsort(cost, kind="stable")[: (o.n + 1) // 2]
            x, cost = np.concatenate((x[half], x[half]))[: o.n], np.concatenate((cost[half], cost[half]))[: o.n]
        if t % 3 == 0:
            lost = np.flatnonzero(task.rng.random(o.n) < 0.25)
            if len(lost):
                x[lost] = task.rng.random((len(lost), task.d)) > 0.5
                cost[lost] = task.score(x[lost])
        task.note()
    return task.found()


def like_groups(own: np.ndarray, like: np.ndarray, alike: float = 0.8) -> list[np.ndarray]:
    """Relevant features in groups: each joins the first group whose most relevant feature it is correlated with.

    A feature is relevant from a tenth of the largest relevance on, or that of the
    d / log d-th feature if that is less.
    """
    order = np.argsort(-own, kind="stable")
    d = len(own)
    place = min(d - 1, int(d / max(1.0, math.log(d))))
    groups: list[list[int]] = []
    for f in order[own[order] >= min(0.1 * own.max(), own[order[place]])]:
        home = next((g for g in groups if like[f, g[0]] >= alike), None)
        if home is None:
            groups.append([int(f)])
        else:
            home.append(int(f))
    return [np.array(g) for g in groups]


@method("FCNDE")
def grouped_niching(task: Task, o: Options) -> Found:
    """Differential evolution in niches over one number per group of like features, which names one of them or none."""
    groups = like_groups(uncertainties(task), correlations(task))
    room = np.array([len(g) for g in groups])

    def masks_of(x):
        named = np.minimum((x * (room + 1)).astype(int), room)
        masks = np.zeros((len(x), task.d), bool)
        for j, group in enumerate(groups):
            on = named[:, j] > 0
            masks[np.flatnonzero(on), group[named[on, j] - 1]] = True
        return masks

    x = task.rng.random((max(6, o.n), len(groups)))
    cost = task.score(masks_of(x))
    for _ in range(o.rounds):
        far = np.square(x[:, None] - x[None]).sum(2)
        niche = np.argsort(far, axis=1, kind="stable")[:, :5]
        lead = np.take_along_axis(niche, cost[niche].argmin(1)[:, None], 1)[:, 0]
        a, b = rivals(task.rng, len(x), 2)
        trial = crossed(task.rng, x, np.clip(x + 0.5 * (x[lead] - x) + 0.5 * (x[a] - x[b]), 0, 1), 0.5)
        same = np.flatnonzero((masks_of(trial) == masks_of(x)).all(1))
        trial[same, task.rng.integers(0, len(groups), len(same))] = task.rng.random(len(same))
        every, costs = np.concatenate((x, trial)), np.concatenate((cost, task.score(masks_of(trial))))
        keep = unlike_first(masks_of(every), costs, len(x))
        x, cost = every[keep], costs[keep]
        task.note()
    return task.found(groups=[g.tolist() for g in groups])


def unlike_first(masks: np.ndarray, cost: np.ndarray, n: int) -> np.ndarray:
    """n places by cost, then size, with repeated masks after all others."""
    seen, first, again = set(), [], []
    for i in np.lexsort((masks.sum(1), cost)):
        key = masks[i].tobytes()
        (again if key in seen else first).append(int(i))
        seen.add(key)
    return np.array((first + again)[:n])
