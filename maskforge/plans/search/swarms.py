"""Population methods: a start, and a move that makes the next positions."""

from __future__ import annotations

import math

import numpy as np

from maskforge.plans.search import method
from maskforge.plans.search.base import Found, Options, Task, positions, resampled, roulette, sigmoid
from maskforge.plans.search.learned import gate_importance
from maskforge.plans.search.values import codes_of, correlations, relevance, relief_weights


@method("all")
def everything(task: Task, o: Options) -> Found:
    task.score(np.ones((1, task.d)))
    task.curve = [task.cost] * o.rounds
    return task.found()


class Bests:
    """Best position of each candidate and of all."""

    def __init__(self, x: np.ndarray, cost: np.ndarray):
        self.x, self.cost = x.copy(), cost.copy()

    def take(self, x: np.ndarray, cost: np.ndarray) -> None:
        better = cost < self.cost
        self.x[better], self.cost[better] = x[better], cost[better]

    @property
    def lead(self) -> np.ndarray:
        return self.x[self.cost.argmin()]


def fly(task: Task, o: Options, bits=None, w: float = 0.9, c: float = 2.0, limit: float = 0.5, x: np.ndarray | None = None) -> Found:
    """Particle swarm; ``bits(x, t, bests)`` makes masks of positions."""
    bits = bits or (lambda x, t, bests: x > o.threshold)
    x = positions(task) if x is None else x
    v = np.zeros_like(x)
    bests = Bests(x, np.full(len(x), np.inf))
    for t in range(o.rounds):
        bests.take(x, task.score(bits(x, t, bests)))
        task.note()
        r1, r2 = task.rng.random(x.shape), task.rng.random(x.shape)
        v = np.clip(w * v + c * r1 * (bests.x - x) + c * r2 * (bests.lead - x), -limit, limit)
        x = np.clip(x + v, 0, 1)
    return task.found()


@method("PSO", "psoG2")
@method("psoG1", folds=5)
def pso(task: Task, o: Options) -> Found:
    return fly(task, o)


@method("relate_pso")
def related(task: Task, o: Options) -> Found:
    """Thresholds of each feature fall with its relevance, and rise from 1 to 6 % over the rounds."""
    relative = relevance(task)
    return fly(task, o, lambda x, t, bests: x > np.clip((0.6 - 0.2 * relative) * (1 + 0.01 + 0.05 * t / o.rounds), 0.1, 0.9))


@method("relate_pso2")
def related_elite(task: Task, o: Options) -> Found:
    """As above, and lower where the better half of the bests select the feature."""
    relative = relevance(task)

    def bits(x, t, bests):
        half = np.argsort(bests.cost, kind="stable")[: max(1, len(x) // 2)]
        often = (bests.x[half] > o.threshold).mean(0)
        return x > np.clip((0.65 - 0.2 * relative - 0.1 * often) * (1 + 0.01 + 0.05 * t / o.rounds), 0.1, 0.9)

    return fly(task, o, bits)


@method("BBPSO", "bbpso1", "bbpsoG2")
@method("bbpsoG1", folds=5)
def bare_bones(task: Task, o: Options) -> Found:
    x = positions(task)
    bests = Bests(x, np.full(len(x), np.inf))
    for _ in range(o.rounds):
        bests.take(x, task.score_positions(x))
        task.note()
        x = task.rng.normal((bests.x + bests.lead) / 2, np.abs(bests.x - bests.lead))
    return task.found()


@method("HPSOLS")
def with_local_search(task: Task, o: Options) -> Found:
    """Swarm over sigmoid bits whose masks are brought to a drawn size: dissimilar features first in, similar ones first out."""
    like = (correlations(task).sum(0) - 1) / max(1, task.d - 1)
    sizes = np.arange(1, task.d + 1)
    size = 1 + roulette(task.rng, (task.d - sizes + 1).astype(float))

    def bits(x, t, bests):
        masks = x > o.threshold
        for m in masks:
            order = np.argsort(like + 0.1 * task.rng.random(task.d))
            on = [f for f in order if m[f]]
            off = [f for f in order if not m[f]]
            m[on[size:]] = False
            m[off[: max(0, size - len(on))]] = True
        return masks

    return fly(task, o, bits)


@method("PSOPG_SOPF")
def parsimonious(task: Task, o: Options) -> Found:
    """Bests go to smaller subsets at equal cost; then single flips of the best until none helps."""
    x = 2 * positions(task) - 1
    v = np.zeros_like(x)
    masks = x > 0
    best, cost = masks.copy(), np.full(len(x), np.inf)
    for _ in range(o.rounds):
        now = task.score(masks)
        size, kept = masks.sum(1), best.sum(1)
        better = (now < cost) & (size <= kept) | (now < 0.95 * cost) | (now == cost) & (size < kept)
        best[better], cost[better] = masks[better], now[better]
        lead = best[np.lexsort((best.sum(1), cost))[0]]
        task.note()
        v = np.clip(0.7 * v + 1.5 * task.rng.random(x.shape) * (best.astype(float) - masks) + 1.5 * task.rng.random(x.shape) * (lead.astype(float) - masks), -6, 6)
        masks = task.rng.random(x.shape) < sigmoid(v)
    polish(task)
    task.curve = resampled(task.curve, o.rounds)
    return task.found()


def polish(task: Task, limit: int = 10) -> None:
    """Single-bit flips of the best mask, all as one batch, until none helps."""
    for _ in range(limit):
        before = task.cost
        task.score(task.best ^ np.eye(task.d, dtype=bool))
        if task.cost >= before:
            return
        task.note()


@method("CUSSPSO", "cuspso")
def correlation_guided(task: Task, o: Options) -> Found:
    """Two clones of each particle with bits flipped by weight; the clone nearest to a good known mask is scored."""
    weight = relief_weights(task)
    x = positions(task)
    bests = Bests(x, np.full(len(x), np.inf))
    for t in range(o.rounds):
        bests.take(x, task.score_positions(x))
        task.note()
        moved = np.clip(x + 0.5 * task.rng.random(x.shape) * (bests.lead - x) + 0.5 * task.rng.random(x.shape) * (bests.x - x), 0, 1)
        chance = 0.3 * np.sin(np.pi * weight) * (1 - t / o.rounds) + 0.02
        clones = np.stack([np.where(task.rng.random(x.shape) < chance, 1 - moved, moved) for _ in range(2)])
        far = np.abs((clones > 0.5)[:, :, None] ^ (bests.x > 0.5)[None, None]).sum(3)
        guess = np.where(np.isfinite(bests.cost), bests.cost, 1.0)[far.argmin(2)]
        x = np.where((guess[0] <= guess[1])[:, None], clones[0], clones[1])
    return task.found()


@method("igpso")
def importance_guided(task: Task, o: Options) -> Found:
    """Bits turn with a chance that grows with the distance to both bests and falls with the importance that a gated network learns."""
    x, y = task.sample()
    weight = gate_importance(task.rng, x, codes_of(y))
    x = task.rng.random((o.n, task.d)) < weight
    best, cost = x.copy(), np.full(o.n, np.inf)
    for _ in range(o.rounds):
        x[~x.any(1), weight.argmax()] = True
        now = task.score(x)
        best[now < cost], cost[now < cost] = x[now < cost], now[now < cost]
        task.note()
        chance = (1 - weight) * 0.1 * task.rng.random(x.shape) + 0.5 * weight * (best ^ x) + 0.5 * weight * (best[cost.argmin()] ^ x)
        x = x ^ (task.rng.random(x.shape) < chance)
    return task.found()


def learn_chances(n: int) -> np.ndarray:
    """Learning probability by rank: 0.05 of the first to 0.5 of the last."""
    r = np.arange(n)
    return 0.05 + 0.45 * np.expm1(10 * r / max(1, n - 1)) / np.expm1(10)


def exemplars(task: Task, bests: Bests) -> np.ndarray:
    """Per feature, another candidate's best: the better of two drawn, or the own."""
    n, d = bests.x.shape
    rank = np.argsort(np.argsort(bests.cost, kind="stable"), kind="stable")
    pair = task.rng.integers(0, n, (2, n, d))
    other = np.where(bests.cost[pair[0]] <= bests.cost[pair[1]], pair[0], pair[1])
    use = task.rng.random((n, d)) < learn_chances(n)[rank][:, None]
    return np.take_along_axis(bests.x, np.where(use, other, np.arange(n)[:, None]), 0)


@method("VLPSO")
@method("vlpso1", n=100)
def variable_length(task: Task, o: Options) -> Found:
    """Particles see the first features of a ranking, in divisions of different lengths; after stalls the best division's length caps the others'."""
    order = np.argsort(-relevance(task), kind="stable")
    n, d = max(o.n, 10), task.d
    divisions = min(10, n)
    group = np.arange(n) * divisions // n
    length = np.maximum(1, d * (group + 1) // divisions)
    x, v, stall, same = positions(task, n), np.zeros((n, d)), np.zeros(n, int), 0
    bests = Bests(x, np.full(n, np.inf))
    guide = x.copy()
    for t in range(o.rounds):
        inside = np.arange(d) < length[:, None]
        masks = np.zeros((n, d), bool)
        masks[:, order] = (x > 0.6) & inside
        now = task.score(masks)
        stall = np.where(now < bests.cost, 0, stall + 1)
        before = task.curve[-1] if task.curve else np.inf
        bests.take(x, now)
        task.note()
        same = same + 1 if task.curve[-1] >= before else 0
        if (stall > 7).any() or t == 0:
            guide = np.where(((stall > 7) | (t == 0))[:, None], exemplars(task, bests), guide)
            stall[stall > 7] = 0
        if same >= 9:
            mean = np.array([bests.cost[group == g].mean() for g in range(divisions)])
            top = max(1, int(length[group == mean.argmin()].max()))
            length = np.maximum(1, top * (group + 1) // divisions)
            same = 0
        w = 0.9 - 0.5 * t / o.rounds
        v = np.clip(w * v + 1.49445 * task.rng.random((n, d)) * (guide - x), -0.6, 0.6)
        x = np.clip(x + v, 0, 1)
    return task.found(ranking=order.tolist())


@method("ga")
def genetic(task: Task, o: Options) -> Found:
    x = task.rng.random((o.n, task.d)) > 0.5
    cost = task.score(x)
    for _ in range(o.rounds):
        children = []
        for _ in range(o.n // 2):
            a, b = x[roulette(task.rng, 1 / (1 + cost))], x[roulette(task.rng, 1 / (1 + cost))]
            if task.rng.random() < 0.8 and task.d > 1:
                cut = task.rng.integers(1, task.d)
                a, b = np.concatenate((a[:cut], b[cut:])), np.concatenate((b[:cut], a[cut:]))
            children += [a ^ (task.rng.random(task.d) < 0.01), b ^ (task.rng.random(task.d) < 0.01)]
        x, cost = survive(x, cost, np.array(children), task.score(np.array(children)), o.n)
        task.note()
    return task.found()


def survive(x: np.ndarray, cost: np.ndarray, y: np.ndarray, more: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    every, costs = np.concatenate((x, y)), np.concatenate((cost, more))
    keep = np.argsort(costs, kind="stable")[:n]
    return every[keep], costs[keep]


@method("ecga")
def entropy_controlled(task: Task, o: Options) -> Found:
    """A genetic search that, when its costs bunch into few grades, shares the best candidates' commonest features."""
    x = task.rng.random((o.n, task.d)) > 0.5
    cost = task.score(x)
    for _ in range(o.rounds):
        span = np.ptp(cost)
        grade = np.minimum(4, np.log2(1 + 31 * (cost - cost.min()) / (span or 1.0)).astype(int))
        p = np.bincount(grade, minlength=5) / len(cost)
        if -(p[p > 0] * np.log(p[p > 0])).sum() / math.log(5) < 0.3:
            elite = x[np.argsort(cost, kind="stable")[: max(2, o.n // 5)]].mean(0)
            children = task.rng.random(x.shape) < 0.8 * elite + 0.1
        else:
            a, b = (x[[roulette(task.rng, 1 / (1e-9 + cost)) for _ in range(o.n)]] for _ in range(2))
            children = np.where(task.rng.random(x.shape) < 0.5, a, b) ^ (task.rng.random(x.shape) < 0.02)
        x, cost = survive(x, cost, children, task.score(children), o.n)
        task.note()
    return task.found()


def rivals(rng: np.random.Generator, n: int, k: int) -> np.ndarray:
    return np.array([rng.choice([j for j in range(n) if j != i], k, replace=False) for i in range(n)]).T


def crossed(rng: np.random.Generator, x: np.ndarray, mutant: np.ndarray, rate: float) -> np.ndarray:
    take = rng.random(x.shape) < rate
    take[np.arange(len(x)), rng.integers(0, x.shape[1], len(x))] = True
    return np.where(take, mutant, x)


@method("de")
def differential(task: Task, o: Options) -> Found:
    x = positions(task, max(4, o.n))
    cost = task.score_positions(x)
    for _ in range(o.rounds):
        a, b, c = rivals(task.rng, len(x), 3)
        trial = crossed(task.rng, x, np.clip(x[a] + 0.5 * (x[b] - x[c]), 0, 1), 0.9)
        now = task.score_positions(trial)
        better = now <= cost
        x[better], cost[better] = trial[better], now[better]
        task.note()
    return task.found()


@method("NDEDA", threshold=0.6)
def niching(task: Task, o: Options) -> Found:
    """Mutants come from the best of each candidate's Hamming niche, and swap features if their mask is there already; equal masks go, and near ties go to the smaller subset."""
    x = positions(task, max(6, o.n))
    cost = task.score_positions(x)
    for _ in range(o.rounds):
        masks = x > o.threshold
        far = (masks[:, None] ^ masks[None]).sum(2)
        niche = np.argsort(far, axis=1, kind="stable")[:, :5]
        lead = np.take_along_axis(niche, cost[niche].argmin(1)[:, None], 1)[:, 0]
        a, b = rivals(task.rng, len(x), 2)
        trial = crossed(task.rng, x, np.clip(x + 0.5 * (x[lead] - x) + 0.5 * (x[a] - x[b]), 0, 1), 0.5)
        trial = unlike(task.rng, trial, masks, o.threshold)
        every, costs = np.concatenate((x, trial)), np.concatenate((cost, task.score_positions(trial)))
        x, cost = distinct_best(every, costs, o.threshold, len(x))
        task.note()
    return task.found()


def unlike(rng: np.random.Generator, trial: np.ndarray, masks: np.ndarray, threshold: float, tries: int = 2) -> np.ndarray:
    """``trial`` in which candidates whose mask stands in ``masks``, or earlier in ``trial``, swap as many chosen features for others, up to ``tries`` times.

    At most half of the chosen features go. Masks without a chosen feature, or with all, stay.
    """
    out, seen = trial.copy(), {m.tobytes() for m in masks}
    for x in out:
        for _ in range(tries):
            on, off = np.flatnonzero(x > threshold), np.flatnonzero(x <= threshold)
            if (x > threshold).tobytes() not in seen or not len(on) or not len(off):
                break
            n = rng.integers(1, max(1, min(len(on) // 2, len(off))) + 1)
            x[rng.choice(on, n, replace=False)] = rng.uniform(0, threshold, n)
            x[rng.choice(off, n, replace=False)] = rng.uniform(np.nextafter(threshold, 1), 1, n)
        seen.add((x > threshold).tobytes())
    return out


def distinct_best(x: np.ndarray, cost: np.ndarray, threshold: float, n: int, step: float = 0.005) -> tuple[np.ndarray, np.ndarray]:
    """n candidates by cost in steps, then size; of equal masks the surest; the rest by cost if too few differ."""
    masks = x > threshold
    sure = np.abs(x - threshold).sum(1)
    first: dict[bytes, int] = {}
    for i in np.argsort(-sure, kind="stable"):
        first.setdefault(masks[i].tobytes(), int(i))
    unique = np.array(sorted(first.values()))
    order = unique[np.lexsort((cost[unique], masks[unique].sum(1), np.floor(cost[unique] / step)))]
    rest = np.setdiff1d(np.argsort(cost, kind="stable"), order)
    keep = np.concatenate((order, rest))[:n]
    return x[keep], cost[keep]


@method("NMDE", threshold=0.6)
def multiobjective(task: Task, o: Options) -> Found:
    """Error and size as two objectives: fronts first, then crowding among masks."""
    x = positions(task, max(6, o.n))
    for _ in range(o.rounds):
        a, b, c = rivals(task.rng, len(x), 3)
        trial = crossed(task.rng, x, np.clip(x[a] + 0.5 * (x[b] - x[c]), 0, 1), 0.5)
        every = np.concatenate((x, trial))
        masks = every > o.threshold
        cost = task.score(masks)
        share = np.where(masks.any(1), masks.mean(1), 1.0)
        error = np.where(masks.any(1), (cost - (1 - o.phi) * share) / max(o.phi, 1e-9), 1.0)
        x = every[select_fronts(np.stack([error, share], 1), masks, len(x))]
        task.note()
    return task.found()


def dominates(a: np.ndarray) -> np.ndarray:
    return (a[:, None] <= a[None]).all(2) & (a[:, None] < a[None]).any(2)


def select_fronts(objectives: np.ndarray, masks: np.ndarray, n: int) -> np.ndarray:
    over, left, keep = dominates(objectives), np.ones(len(masks), bool), []
    while len(keep) < n:
        front = np.flatnonzero(left & ~(over & left[:, None]).any(0))
        if len(keep) + len(front) > n:
            far = (masks[front][:, None] ^ masks[front][None]).sum(2).astype(float)
            np.fill_diagonal(far, np.inf)
            near = np.sort(far, 1)[:, :8]
            room = np.where(np.isfinite(near), near, 0).mean(1)
            front = front[np.argsort(-room, kind="stable")[: n - len(keep)]]
        keep += front.tolist()
        left[front] = False
    return np.array(keep)


class Pack:
    """The three best positions so far."""

    def __init__(self, d: int):
        self.x, self.cost = np.zeros((3, d)), np.full(3, np.inf)

    def take(self, x: np.ndarray, cost: np.ndarray) -> None:
        for row, c in zip(x, cost, strict=True):
            place = int(np.searchsorted(self.cost, c, side="right"))
            if place < 3:
                self.x = np.insert(self.x, place, row, 0)[:3]
                self.cost = np.insert(self.cost, place, c)[:3]


@method("gwo")
def grey_wolves(task: Task, o: Options) -> Found:
    """Additive pulls to the three leaders, at a rate of 0.9."""
    x, pack = positions(task), Pack(task.d)
    for _ in range(o.rounds):
        pack.take(x, task.score_positions(x))
        task.note()
        r = task.rng.random((3, *x.shape))
        x = np.clip(x + (1.8 * r[0] - 0.9) * (pack.x[0] - x) + 2 * r[1] * (pack.x[1] - x) + 2 * r[2] * (pack.x[2] - x), 0, 1)
    return task.found()


def wolves_with_mutation(task: Task, o: Options, many: bool) -> Found:
    """Encircling moves through |tanh|, then mutations of the leader: features out, then features in.

    many: all drawn bits of a phase turn at once, as one mask, and a bit is set where
    the draw reaches the chance; otherwise each drawn bit is a mask of its own, and a
    bit is set where the draw stays under it.
    """
    x = (task.rng.random((o.n, task.d)) > 0.5).astype(float)
    pack, chance = Pack(task.d), 0.5 if task.d < 100 else 0.3 if task.d < 1000 else 0.05
    for t in range(o.rounds):
        pack.take(x, task.score(x > 0.5))
        a = 2 - 2 * t / o.rounds
        pull = [p - (2 * a * task.rng.random(x.shape) - a) * np.abs(2 * task.rng.random(x.shape) * p - x) for p in pack.x]
        under = task.rng.random(x.shape) < np.abs(np.tanh(np.mean(pull, 0)))
        x = (~under if many else under).astype(float)
        lead = pack.x[0] > 0.5
        for out in (True, False):
            flips = np.flatnonzero((lead == out) & (task.rng.random(task.d) < chance))
            if len(flips):
                trial = np.repeat(lead[None], 1 if many else len(flips), 0)
                trial[0 if many else np.arange(len(flips)), flips] = not out
                now = task.score(trial)
                if now.min() < pack.cost[0]:
                    lead = trial[now.argmin()]
                    pack.take(lead[None].astype(float), now[[now.argmin()]])
        task.note()
    return task.found()


@method("tmgwo")
def two_phase_wolves(task: Task, o: Options) -> Found:
    return wolves_with_mutation(task, o, many=False)


@method("fast_tmgwo")
def fast_two_phase_wolves(task: Task, o: Options) -> Found:
    return wolves_with_mutation(task, o, many=True)


def salps(task: Task, o: Options, lead=None, follow=None, start: np.ndarray | None = None, after=None) -> Found:
    """Salp chain: a leader around the food, each follower between itself and the one before it."""
    x, food, cost = positions(task) if start is None else start, np.zeros(task.d), np.inf
    for t in range(o.rounds):
        now = task.score_positions(x)
        if now.min() < cost:
            food, cost = x[now.argmin()].copy(), now.min()
        if after:
            food, cost = after(food, cost)
        task.note()
        c1 = 2 * np.exp(-((4 * (t + 1) / o.rounds) ** 2))
        x = x.copy()
        step = (lead(t) if lead else c1) * task.rng.random(task.d)
        x[0] = np.clip(np.where(task.rng.random(task.d) >= 0.5, food + step, food - step), 0, 1)
        for i in range(1, len(x)):
            share = follow() if follow else 0.5
            x[i] = np.clip(share * (x[i] + x[i - 1]), 0, 1)
    return task.found()


@method("ssa")
def salp_swarm(task: Task, o: Options) -> Found:
    return salps(task, o)


@method("essa", "fast_essa", "reward_essa")
def enhanced_salps(task: Task, o: Options) -> Found:
    lead = lambda t: 2 * np.exp(-((task.rng.uniform(0, 50, task.d) * (t + 1) / o.rounds) ** 2))
    return salps(task, o, lead, lambda: task.rng.random())


@method("issa")
def improved_salps(task: Task, o: Options) -> Found:
    """Starts from the better of points and their opposites; the food turns a few features, a step at a time."""
    x = positions(task)
    both = np.concatenate((x, 1 - x))
    x = both[np.argsort(task.score_positions(both), kind="stable")[: o.n]]

    def after(food, cost):
        for _ in range(o.local_steps):
            trial = food.copy()
            some = task.rng.choice(task.d, min(3, task.d), replace=False)
            trial[some] = np.clip(np.where(food[some] > o.threshold, food[some] - o.threshold, food[some] + o.threshold), 0, 1)
            now = task.score_positions(trial)[0]
            if now < cost:
                food, cost = trial, now
        return food, cost

    return salps(task, o, start=x, after=after)


@method("tvbssa")
def time_varying_salps(task: Task, o: Options) -> Found:
    """More leaders as rounds pass; a bit is 0 with the sigmoid of the position."""
    x, food, cost = 2 * positions(task) - 1, np.zeros(task.d), np.inf
    for t in range(o.rounds):
        now = task.score(task.rng.random(x.shape) >= sigmoid(x))
        if now.min() < cost:
            food, cost = x[now.argmin()].copy(), now.min()
        task.note()
        leaders = math.ceil(o.n * (t + 1) / (o.rounds + 1))
        c1 = 2 * np.exp(-((4 * (t + 1) / o.rounds) ** 2))
        step = c1 * (2 * task.rng.random((leaders, task.d)) - 1)
        x = x.copy()
        x[:leaders] = np.clip(food + step * np.where(task.rng.random(step.shape) >= 0.5, 1, -1), -1, 1)
        for i in range(leaders, len(x)):
            x[i] = (x[i] + x[i - 1]) / 2
    return task.found()


@method("obwoa", "Fobwoa")
def whales(task: Task, o: Options) -> Found:
    """Encircling, random search and spirals; opposite points compete for survival each round."""
    x = positions(task)
    both = np.concatenate((x, 1 - x))
    cost = task.score_positions(both)
    x, cost = survive(both[: o.n], cost[: o.n], both[o.n :], cost[o.n :], o.n)
    for t in range(o.rounds):
        task.note()
        a, lead = 2 - 2 * t / o.rounds, x[cost.argmin()]
        big = (2 * a * task.rng.random(o.n) - a)[:, None]
        c = 2 * task.rng.random((o.n, 1))
        target = np.where(np.abs(big) < 1, lead, x[task.rng.integers(0, o.n, o.n)])
        turn = task.rng.uniform(-1, 1, (o.n, 1))
        spiral = np.abs(lead - x) * np.exp(turn) * np.cos(2 * np.pi * turn) + lead
        x = np.clip(np.where(task.rng.random((o.n, 1)) < 0.5, target - big * np.abs(c * target - x), spiral), 0, 1)
        both = np.concatenate((x, 1 - x))
        every = task.score_positions(both)
        x, cost = survive(both[: o.n], every[: o.n], both[o.n :], every[o.n :], o.n)
    return task.found()


#: Swims between two reproductions of ``bfo``, and reproductions of a round.
SWIMS, BIRTHS = 5, 2


@method("bfo")
def bacteria(task: Task, o: Options) -> Found:
    """Swims while it gets better, after some swims the better half doubles, and at the end of a round a quarter is dispersed at random."""
    x = positions(task)
    cost = task.score_positions(x)
    for _ in range(o.rounds):
        for _ in range(BIRTHS):
            for _ in range(SWIMS):
                way = task.rng.normal(size=x.shape)
                way /= np.linalg.norm(way, axis=1, keepdims=True)
                trial = np.clip(x + 0.3 * way, 0, 1)
                now = task.score_positions(trial)
                better = now < cost
                x[better], cost[better] = trial[better], now[better]
            half = np.argsort(cost, kind="stable")[: (len(x) + 1) // 2]
            x, cost = np.concatenate((x[half], x[half]))[: o.n], np.concatenate((cost[half], cost[half]))[: o.n]
        lost = np.flatnonzero(task.rng.random(len(x)) < 0.25)
        lost = lost[lost > 0]
        if len(lost):
            x[lost] = task.rng.random((len(lost), task.d))
            cost[lost] = task.score_positions(x[lost])
        task.note()
    return task.found()


@method("bco")
def bit_steps(task: Task, o: Options) -> Found:
    """Each candidate turns one random bit and keeps what isn't worse."""
    x = task.rng.random((o.n, task.d)) > 0.5
    cost = task.score(x)
    for _ in range(o.rounds):
        trial = x.copy()
        trial[np.arange(o.n), task.rng.integers(0, task.d, o.n)] ^= True
        now = task.score(trial)
        better = now <= cost
        x[better], cost[better] = trial[better], now[better]
        task.note()
    return task.found()


@method("mgfpa")
def flowers(task: Task, o: Options) -> Found:
    """Levy flights to the best with chance 0.8, else steps between two others."""
    beta = 1.5
    spread = (math.gamma(1 + beta) * math.sin(math.pi * beta / 2) / (math.gamma((1 + beta) / 2) * beta * 2 ** ((beta - 1) / 2))) ** (1 / beta)
    x = positions(task)
    cost = task.score_positions(x)
    for _ in range(o.rounds):
        levy = 0.01 * task.rng.normal(0, spread, x.shape) / np.abs(task.rng.normal(size=x.shape)) ** (1 / beta)
        a, b = rivals(task.rng, o.n, 2)
        near = x + task.rng.random((o.n, 1)) * (x[a] - x[b])
        trial = np.clip(np.where(task.rng.random((o.n, 1)) < 0.8, x + levy * (x[cost.argmin()] - x) * 10, near), 0, 1)
        now = task.score_positions(trial)
        better = now <= cost
        x[better], cost[better] = trial[better], now[better]
        task.note()
    return task.found()


@method("isca")
def sine_cosine(task: Task, o: Options) -> Found:
    """Sine or cosine steps around the best; two elites take the place of the worst."""
    x = positions(task)
    elite, cost = x[:2].copy(), np.full(2, np.inf)
    for t in range(o.rounds):
        now = task.score_positions(x)
        elite, cost = survive(elite, cost, x, now, 2)
        worst = np.argsort(-now, kind="stable")[:2]
        x = x.copy()
        x[worst] = elite[: len(worst)]
        task.note()
        r1, turn, r3 = 2 - 2 * t / o.rounds, task.rng.uniform(0, 2 * np.pi, x.shape), 2 * task.rng.random(x.shape)
        wave = np.where(task.rng.random(x.shape) < 0.5, np.sin(turn), np.cos(turn))
        x = np.clip(x + r1 * wave * np.abs(r3 * elite[0] - x), 0, 1)
    return task.found()
