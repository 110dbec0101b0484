"""Searches with one solution, with restricted subspaces, and the bee swarm."""

from __future__ import annotations

import math

import numpy as np

from maskforge.plans.search import method
from maskforge.plans.search.base import Found, Options, Task, positions, resampled, roulette
from maskforge.plans.search.swarms import Bests, exemplars, fly
from maskforge.plans.search.learned import GRAPH_ROWS, factor_weights, forest_importance
from maskforge.plans.search.values import adaptive, codes_of, entropy, pair_uncertainties, uncertainties, unit

#: Features that a forest leaves to ``spfsr``.
HOT = 75


class Single:
    """One solution that loses features in numbers that fall from 0.3 to 0.001 of all, or gains one if none would be left."""

    def __init__(self, task: Task):
        self.task, self.x = task, task.rng.random(task.d) > 0.5
        self.x[task.rng.integers(task.d)] = True
        self.cost = task.score(self.x)[0]

    def step(self, at: float) -> bool:
        task, new = self.task, self.x.copy()
        on = np.flatnonzero(new)
        new[task.rng.choice(on, math.ceil(((0.3 - 0.001) * (1 - at) + 0.001) * task.d))] = False
        if not new.any():
            new = self.x.copy()
            off = np.flatnonzero(~new)
            if len(off):
                new[task.rng.choice(off)] = True
        cost = task.score(new)[0]
        better = cost < self.cost
        if better:
            self.x, self.cost = new, cost
        task.note()
        return better


@method("SFE")
@method("sfeG1", folds=5)
def simple_elimination(task: Task, o: Options) -> Found:
    one, total = Single(task), o.n * o.rounds
    for i in range(total):
        one.step(i / total)
    task.curve = resampled(task.curve, o.rounds)
    return task.found()


@method("SFEPSO", "sfepsoG2")
@method("sfepsoG1", folds=5)
def elimination_then_swarm(task: Task, o: Options) -> Found:
    """Elimination until it stalls for a fifth of the budget, then a swarm over the features that are left."""
    one, total, stall, i = Single(task), o.n * o.rounds, 0, 0
    while i < total and stall < max(1, total // 5):
        stall = 0 if one.step(i / total) else stall + 1
        i += 1
    left = np.flatnonzero(one.x)
    if i < total and len(left) > 1:
        inside = np.zeros(task.d, bool)
        inside[left] = True
        fly(task, o.replace(rounds=max(1, (total - i) // o.n)), lambda x, t, bests: (x > 0.5) & inside)
    task.curve = resampled(task.curve, o.rounds)
    return task.found()


@method("elhG1", folds=5)
@method("elhG2", func=1)
def hierarchy(task: Task, o: Options) -> Found:
    """Each candidate loses features, in numbers that decay along a sigmoid, or copies some that the best has and it lacks."""
    x = task.rng.random((o.n, task.d)) > 0.5
    cost = task.score(x)
    for t in range(o.rounds):
        best = x[np.lexsort((x.sum(1), cost))[0]].copy()
        share = 0.3 / (1 + np.exp(10 * (t / o.rounds - 0.5)))
        trial = x.copy()
        for row in trial:
            missing, on = np.flatnonzero(best & ~row), np.flatnonzero(row)
            if task.rng.random() < 0.5 and len(missing):
                row[task.rng.choice(missing, math.ceil(0.5 * len(missing)), replace=False)] = True
            elif len(on) > 1:
                row[task.rng.choice(on, min(len(on) - 1, math.ceil(share * len(on))), replace=False)] = False
        now = task.score(trial)
        better = (now < cost) | (now == cost) & (trial.sum(1) < x.sum(1))
        x[better], cost[better] = trial[better], now[better]
        task.note()
    return task.found()


@method("spfsr")
def stochastic_gradient(task: Task, o: Options) -> Found:
    """Simultaneous perturbation with averaged gradients, Barzilai-Borwein gains, clipped changes and a stall limit.

    It works on the ``HOT`` features that a forest finds most important, and starts from their importances.
    """
    rows, y = task.sample()
    importance = forest_importance(task.rng, rows, codes_of(y))
    active = np.sort(np.argsort(-importance, kind="stable")[:HOT])
    w, before, gradient_before, stall = 0.4 + 0.2 * unit(importance[active]), None, None, 0

    def masks_of(points):
        masks = np.zeros((len(np.atleast_2d(points)), task.d), bool)
        masks[:, active] = np.atleast_2d(points) >= 0.5
        return masks

    task.score(masks_of(w))
    for _ in range(o.rounds):
        turns = task.rng.choice([-1.0, 1.0], (4, len(active)))
        both = np.concatenate((w + 0.05 * turns, w - 0.05 * turns))
        cost = task.score(masks_of(both))
        gradient = ((cost[:4] - cost[4:])[:, None] / (0.1 * turns)).mean(0)
        gain = 0.5
        if before is not None:
            dw, dg = w - before, gradient - gradient_before
            gain = float(np.clip(abs((dw * dw).sum() / (dw * dg).sum()), 0.01, 2)) if (dw * dg).sum() else 0.5
        before, gradient_before = w, gradient
        w = np.clip(w - np.clip(gain * gradient, -0.2, 0.2), 0, 1)
        last = task.cost
        task.score(masks_of(w))
        stall = 0 if task.cost < last else stall + 1
        task.note()
        if stall >= 35:
            break
    task.curve = resampled(task.curve, o.rounds)
    return task.found(weights=w.tolist(), active=active.tolist())


@method("lapsodr")
def leader_adaptive(task: Task, o: Options) -> Found:
    """Learns from exemplars or a leader by stagnation; elites lose features that another makes redundant and gain relevant ones."""
    o = o.replace(phi=min(o.phi, 0.9))
    task.options = o
    own, both = uncertainties(task), pair_uncertainties(task)

    x = positions(task)
    bests, stall = Bests(x, np.full(o.n, np.inf)), np.zeros(o.n, int)
    for t in range(o.rounds):
        now = task.score_positions(x)
        stall = np.where(now < bests.cost, 0, stall + 1)
        bests.take(x, now)
        elite = np.argsort(bests.cost, kind="stable")[: max(1, int(o.n * (0.5 - 0.4 * t / o.rounds)))]
        for i in elite[:2]:
            mask = bests.x[i] > o.threshold
            for f in sorted(np.flatnonzero(mask), key=lambda f: -own[f]):
                if mask[f]:
                    for g in np.flatnonzero(mask):
                        if g != f and own[g] <= own[f] and both[f, g] >= own[g]:
                            mask[g] = False
            if not mask.any():
                mask[own.argmax()] = True
            if task.score(mask)[0] < bests.cost[i]:
                bests.x[i], bests.cost[i] = np.where(mask, 0.75, 0.25), task.score(mask)[0]
        task.note()
        lead = bests.x[task.rng.choice(elite, o.n)]
        guide = np.where((stall > 5)[:, None], lead, exemplars(task, bests))
        x = np.clip(x + task.rng.random(x.shape) * 1.5 * (guide - x), 0, 1)
    return task.found()


def chaotic(task: Task, n: int) -> np.ndarray:
    """n positions of a logistic map that starts at random."""
    out = np.empty((n, task.d))
    now = task.rng.random(task.d) * 0.9 + 0.05
    for i in range(n):
        now = out[i] = 4 * now * (1 - now)
    return out


def bits_within(x: np.ndarray, inside: np.ndarray, threshold: float) -> np.ndarray:
    """Masks of positions over some features, with the first of these where a mask would be empty."""
    bits = (x > threshold) & inside
    bits[~bits.any(1), np.flatnonzero(inside)[0]] = True
    return bits


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mutual information of two masks' bits over the root of their entropies; 0 if one doesn't vary."""
    p, q = a.astype(int), b.astype(int)
    ha, hb = entropy(p), entropy(q)
    return (ha + hb - entropy(2 * p + q)) / math.sqrt(ha * hb) if ha and hb else 0.0


def mated(task: Task, x: np.ndarray, inside: np.ndarray, o: Options) -> np.ndarray:
    """The better half of the positions, each replaced by the better of two children of uniform crossover with its least similar mate among the others, if that is no worse; no mate is taken twice."""
    masks_of = lambda p: bits_within(p, inside, o.threshold)
    cost = task.score(masks_of(x))
    order = np.argsort(cost, kind="stable")
    best, others = x[order[: o.n]].copy(), x[order[o.n :]]
    own, free = masks_of(best), masks_of(others)
    left, children = list(range(len(others))), []
    for i in range(len(best)):
        j = left.pop(int(np.argmin([likeness(own[i][inside], free[j][inside]) for j in left])))
        take = task.rng.random(task.d) < 0.5
        children += [np.where(take, best[i], others[j]), np.where(take, others[j], best[i])]
    children = np.array(children).reshape(len(best), 2, task.d)
    costs = task.score(masks_of(children.reshape(-1, task.d))).reshape(-1, 2)
    better, place = costs.min(1) <= cost[order[: o.n]], costs.argmin(1)
    best[better] = children[better, place[better]]
    return best


@method("rlpsoasm", threshold=0.6)
def strategy_learning(task: Task, o: Options) -> Found:
    """A swarm over well-scored features whose candidates choose between three ways to learn, by softmax of learned values.

    It starts from the better half of random and chaotic positions, each of which takes the
    best of itself and its children with its least similar mate of the other half.
    """
    inside = np.zeros(task.d, bool)
    inside[adaptive(task)] = True
    x = mated(task, np.concatenate((positions(task), chaotic(task, o.n))), inside, o)
    bests, q, state = Bests(x, np.full(o.n, np.inf)), np.zeros((2, 3)), 0
    for _ in range(o.rounds):
        before = task.cost
        bests.take(x, task.score(bits_within(x, inside, o.threshold)))
        task.note()
        chance = np.exp(q[state] - q[state].max())
        action = roulette(task.rng, chance)
        guide = [bests.lead[None], exemplars(task, bests), (bests.x + bests.lead) / 2][action]
        x = np.clip(x + task.rng.random(x.shape) * 1.5 * (guide - x) + 0.05 * task.rng.normal(size=x.shape), 0, 1)
        new = int(task.cost < before)
        q[state, action] += 0.1 * (new + 0.9 * q[new].max() - q[state, action])
        state = new
    return task.found(values=q.tolist())


@method("godcpso")
def regularised_sizes(task: Task, o: Options) -> Found:
    """Features ranked by a factorisation on neighbour graphs, whose weights a swarm tunes; sizes of the ranking are scored."""
    x, y = task.sample()
    weight = factor_weights(task.rng, x[:GRAPH_ROWS], codes_of(y[:GRAPH_ROWS]), o.n, o.rounds)
    order, d = np.argsort(-weight, kind="stable"), task.d
    sizes = sorted({min(d, max(1, s)) for s in [*(math.ceil(d * r) for r in (0.1, 0.2, 0.3, 0.5)), int(math.sqrt(d)), int(0.25 * d), int(0.4 * d)]})
    for s in sizes:
        mask = np.zeros(d, bool)
        mask[order[:s]] = True
        task.score(mask)
        task.note()
    task.curve = resampled(task.curve, o.rounds)
    return task.found(sizes=sizes, ranking=order.tolist())


def search_area(best: np.ndarray, flip: int, n: int) -> list[np.ndarray]:
    """Masks with every flip-th bit turned, then with blocks of d / flip bits turned."""
    out, d = [], len(best)
    for h in range(min(flip, d)):
        made = best.copy()
        made[h::flip] ^= True
        out.append(made)
    width = max(1, d // flip)
    for h in range(0, d, width):
        made = best.copy()
        made[h : h + width] ^= True
        out.append(made)
    return out[:n]


@method("bso")
def bees(task: Task, o: Options, flip: int = 5, chances: int = 3) -> Found:
    """Bees search around a reference that is drawn from the good, or from the far ones when chances run out; steps follow learned values of flips."""
    values: dict[tuple[int, int], float] = {}
    reference = task.rng.random(task.d) < (0.2 if task.rng.random() < 0.5 else 0.8)
    reference[0] |= not reference.any()
    tabu, left, epsilon, uses = [reference], chances, 0.1, np.zeros(task.d, int)
    for _ in range(o.rounds):
        bees = np.array(search_area(reference, flip, o.n))
        cost = task.score(bees)
        for _ in range(o.local_steps):
            turns = [int(task.rng.integers(task.d)) if task.rng.random() < epsilon else max(range(task.d), key=lambda f: values.get((int(b.sum()), f), 0.0)) for b in bees]
            trial = bees.copy()
            trial[np.arange(len(bees)), turns] ^= True
            now = task.score(trial)
            for i, f in enumerate(turns):
                gain = cost[i] - now[i] if now[i] != cost[i] else (1 - now[i]) / 2 * np.sign(bees[i].sum() - trial[i].sum())
                key, size = (int(bees[i].sum()), f), int(trial[i].sum())
                ahead = max((v for (s, _), v in values.items() if s == size), default=0.0)
                values[key] = values.get(key, 0.0) + 0.1 * (gain + 0.9 * ahead - values.get(key, 0.0))
                if now[i] <= cost[i]:
                    bees[i], cost[i] = trial[i], now[i]
            epsilon = max(0.01, epsilon - 1e-4)
        uses += bees.sum(0)
        task.note()
        best = bees[cost.argmin()]
        left = chances if cost.min() < task.cost + 1e-12 else left - 1
        far = np.array([min(int((b ^ t).sum()) for t in tabu) for b in bees])
        far[far <= 1] = 0
        reference = (best if left > 0 and far[cost.argmin()] else bees[far.argmax()] if far.any() else task.rng.random(task.d) > 0.5).copy()
        left = left if left > 0 else chances
        tabu.append(reference)
    top = np.argsort(-uses, kind="stable")[: round(0.1 * task.d) + 1]
    return task.found(most_used=top.tolist())
