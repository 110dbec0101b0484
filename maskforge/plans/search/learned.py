"""Weights of features from small models: a forest, a gated network, a factorisation on neighbour graphs.

All learn from ``task.sample``, so at most ``LEARN_ROWS`` labelled rows at any
size of the table, and draw from the task's generator.
"""

from __future__ import annotations

import numpy as np

#: Rows of the neighbour graph of ``factor_weights``, whose size is the square of them.
GRAPH_ROWS = 1_000


def _best_cut(x: np.ndarray, onehot: np.ndarray, features: np.ndarray) -> tuple[float, int, float]:
    """Largest drop of Gini impurity, its feature and the value up to which rows go left."""
    best = (0.0, -1, 0.0)
    total = onehot.sum(0)
    n = len(x)
    whole = 1 - np.square(total / n).sum()
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        values = x[order, f]
        left = onehot[order].cumsum(0)[:-1]
        size = np.arange(1, n)
        impurity = size - np.square(left).sum(1) / size + (n - size) - np.square(total - left).sum(1) / (n - size)
        drop = np.where(values[1:] > values[:-1], whole - impurity / n, -1.0)
        if len(drop) and drop.max() > best[0] + 1e-12:
            best = (float(drop.max()), int(f), float(values[drop.argmax()]))
    return best


def forest_importance(rng: np.random.Generator, x: np.ndarray, labels: np.ndarray, trees: int = 20, depth: int = 8) -> np.ndarray:
    """Mean drop of impurity by each feature over trees of bootstrap rows, sqrt(d) features a node; sums to 1, or all 0."""
    n, d = x.shape
    onehot = np.eye(labels.max() + 1)[labels]
    out = np.zeros(d)
    for _ in range(trees):
        open_nodes = [(rng.integers(0, n, n), 0)]
        while open_nodes:
            rows, level = open_nodes.pop()
            if level >= depth or len(rows) < 2:
                continue
            drop, f, cut = _best_cut(x[rows], onehot[rows], rng.choice(d, max(1, int(np.sqrt(d))), replace=False))
            if f >= 0:
                out[f] += drop * len(rows) / n
                low = x[rows, f] <= cut
                open_nodes += [(rows[low], level + 1), (rows[~low], level + 1)]
    return out / out.sum() if out.sum() else out


class Gated:
    """A network of one hidden layer whose inputs are multiplied by sigmoid gates."""

    def __init__(self, rng: np.random.Generator, d: int, classes: int, hidden: int = 32):
        self.rng = rng
        self.p = {"gate": np.zeros(d), "w": rng.normal(0, np.sqrt(2 / d), (d, hidden)), "b": np.zeros(hidden), "v": rng.normal(0, np.sqrt(2 / hidden), (hidden, classes)), "c": np.zeros(classes)}

    @property
    def gates(self) -> np.ndarray:
        return 1 / (1 + np.exp(-self.p["gate"]))

    def learn(self, x: np.ndarray, onehot: np.ndarray, only_gates: bool, epochs: int = 30, batch: int = 64, rate: float = 0.05, least: float = 0.005) -> None:
        speed = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            step = least + (rate - least) * (1 + np.cos(np.pi * epoch / epochs)) / 2
            for rows in np.array_split(self.rng.permutation(len(x)), max(1, -(-len(x) // batch))):
                for name, slope in self._slopes(x[rows], onehot[rows]).items():
                    if name == "gate" or not only_gates:
                        speed[name] = 0.9 * speed[name] + slope + 1e-5 * self.p[name]
                        self.p[name] = self.p[name] - step * speed[name]

    def _slopes(self, x: np.ndarray, onehot: np.ndarray) -> dict[str, np.ndarray]:
        p, g = self.p, self.gates
        inner = x * g @ p["w"] + p["b"]
        hidden = np.maximum(inner, 0)
        out = hidden @ p["v"] + p["c"]
        chance = np.exp(out - out.max(1, keepdims=True))
        wrong = (chance / chance.sum(1, keepdims=True) - onehot) / len(x)
        back = wrong @ p["v"].T * (inner > 0)
        return {"gate": (back @ p["w"].T * x).sum(0) * g * (1 - g), "w": (x * g).T @ back, "b": back.sum(0), "v": hidden.T @ wrong, "c": wrong.sum(0)}


def gate_importance(rng: np.random.Generator, x: np.ndarray, labels: np.ndarray, networks: int = 8) -> np.ndarray:
    """Mean over networks of the gates learned from 70 % of the rows, less those learned, with the rest of the network fixed, from the others under wrong labels; scaled to 0.1 to 0.9.

    Columns are centred first. All 0.5 where nothing tells features apart, and with one class.
    """
    n, d = x.shape
    classes = int(labels.max()) + 1
    if classes < 2 or n < 2:
        return np.full(d, 0.5)
    x, cut, gap = x - x.mean(0), min(n - 1, max(1, int(0.7 * n))), np.zeros(d)
    for _ in range(networks):
        right, other = np.split(rng.permutation(n), [cut])
        wrong = (labels[other] + rng.integers(1, classes, len(other))) % classes
        net = Gated(rng, d, classes)
        net.learn(x[right], np.eye(classes)[labels[right]], only_gates=False)
        gap += net.gates
        net.p["gate"] = np.zeros(d)
        net.learn(x[other], np.eye(classes)[wrong], only_gates=True)
        gap -= net.gates
    return 0.1 + 0.8 * (gap - gap.min()) / np.ptp(gap) if np.ptp(gap) > 1e-12 else np.full(d, 0.5)


def neighbour_laplacian(points: np.ndarray, k: int = 5) -> np.ndarray:
    """Degrees less adjacency of the graph that joins each point with its k nearest, either way."""
    n = len(points)
    size = np.square(points).sum(1)
    far = size[:, None] + size[None] - 2 * points @ points.T
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, axis=1, kind="stable")[:, : min(k, n - 1)]
    joined = np.zeros((n, n))
    np.put_along_axis(joined, near, 1.0, 1)
    joined = np.maximum(joined, joined.T)
    return np.diag(joined.sum(1)) - joined


class Factors:
    """Non-negative weights of features that predict orthogonal cluster indicators, smooth over neighbour graphs of rows and of features.

    ``step`` makes new factors for the four weights (indicator graph, sparsity, row
    graph, feature graph); sizes of the rows of w rank features.
    """

    def __init__(self, rng: np.random.Generator, x: np.ndarray, classes: int):
        self.x = x
        self.rows, self.features = neighbour_laplacian(x), neighbour_laplacian(x.T) if x.shape[1] > 1 else np.zeros((1, 1))
        self.gram, self.smooth = x.T @ x, x.T @ self.rows @ x
        self.top = 2 * self.rows.diagonal().max()  # no eigenvalue is above twice the largest degree
        self.start = np.ones((x.shape[1], classes)), np.linalg.qr(rng.random((len(x), classes)))[0]

    def step(self, state: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray]]:
        w, e = state
        graph, sparse, row, feature = weights
        size = np.sqrt(np.square(w).sum(1) + 1e-12)
        pull = self.gram @ w + sparse * w / (2 * size)[:, None] + row * self.smooth @ w + feature * self.features @ w
        w = w * np.maximum(self.x.T @ e, 0) / np.maximum(pull, 1e-12)
        made = self.x @ w
        u, _, v = np.linalg.svd(graph * (self.top * e - self.rows @ e) + made + 1e-9 * e, full_matrices=False)
        e = u @ v
        cost = np.square(made - e).sum() + sparse * np.sqrt(np.square(w).sum(1)).sum() + row * (w * (self.smooth @ w)).sum() + feature * (w * (self.features @ w)).sum()
        return float(cost), (w, e)


def factor_weights(rng: np.random.Generator, x: np.ndarray, labels: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """Sizes of the rows of w, for the weights that a swarm of n finds in some rounds; 1 for all features of a single row."""
    if len(x) < 3:
        return np.ones(x.shape[1])
    classes = min(max(2, int(labels.max()) + 1), x.shape[1], len(x))
    factors = Factors(rng, x, classes)
    place = rng.random((n, 4))
    speed = np.zeros_like(place)
    best, cost = place.copy(), np.full(n, np.inf)
    state, least, lead = factors.start, np.inf, place[0]
    for t in range(rounds):
        made = [factors.step(state, p) for p in place]
        now = np.array([c if np.isfinite(c) else np.inf for c, _ in made])
        best[now < cost], cost[now < cost] = place[now < cost], now[now < cost]
        if now.min() < least:
            least, state, lead = now.min(), made[now.argmin()][1], place[now.argmin()]
        inertia = 0.9 - 0.8 * (t + 1) / rounds
        speed = np.clip(inertia * speed + 2 * rng.random((n, 1)) * (best - place) + 2 * rng.random((n, 1)) * (lead - place), -0.2, 0.2)
        place = np.clip(place + speed, 1e-3, 1)
    return np.sqrt(np.square(state[0]).sum(1))
