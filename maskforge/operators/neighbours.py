"""Exact neighbours among rows in memory, and the dealing of such work to tasks.

Products in single precision, whose error is bounded, leave out the rows that are surely
too far; the distances of the rest are worked out in full, rounded, and compared. Memory
is bounded by tiles: no matrix of all pairs is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distances are compared after rounding to so many places, then by place.
PLACES = 9
#: Rows of a tile, and of a group within it whose least product is kept, in two levels.
TILE, FINE, COARSE = 512, 8, 64
#: Rows that are asked at once, and pairs whose distance is worked out in full at once.
ASKED, PAIRS, SLICE = 512, 1 << 20, 1 << 15
#: Nested columns: rows kept to bound the next distances, numbers of columns looked ahead,
#: one of how many rows is counted before, and rows that may be left for each asked one.
POOL, AHEAD, SAMPLED, EACH = 64, 12, 64, 256
#: Pairs of rows that a task looks at, or somewhat more.
TASK_PAIRS = 1 << 28
#: Values beyond this are compared in full only.
LARGE = 1e15


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of equal length as a matrix."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(values):
        return np.empty((0, 0))
    if not values.null_count and pa.types.is_list(values.type):
        flat = values.flatten()
        if not flat.null_count and len(flat) % len(values) == 0 and (np.diff(values.offsets.to_numpy()) == len(flat) // len(values)).all():
            return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)
    return np.array(values.to_pylist(), dtype=float)


class Rows:
    """Rows to look among, made ready: centred in single precision, with their squared lengths, filled up to whole groups."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x, dtype=float)
        self.n, self.d = self.x.shape
        self.most = float(np.abs(self.x).max(initial=0.0))
        self.usable = self.n > 0 and self.most < LARGE
        if self.usable:
            self.centre = self.x.mean(0)
            z = self.x - self.centre
            length = np.square(z).sum(1)
            self.wide = np.zeros((-(-self.n // COARSE) * COARSE, self.d + 1), np.float32)
            self.wide[: self.n, 1:] = -2 * z
            self.wide[:, 0] = 3e38  # what only fills up is far from all
            self.wide[: self.n, 0] = length
            self.reach = float(np.sqrt(length.max()))

    def ready(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns for the products, squared lengths, error) of asked rows: a product is squared distance less the row's squared length, give or take the error."""
        z = asked - self.centre
        length = np.square(z).sum(1)
        columns = np.ones((self.d + 1, len(asked)), np.float32)
        columns[1:] = z.T
        size, most = np.sqrt(length), max(self.most, float(np.abs(asked).max(initial=0.0)))
        terms = 2 * size * self.reach + self.reach**2
        error = (self.d + 10) * 2.0**-23 * terms + 1e-15 * most * (self.d + 1) * (size + self.reach) + 4e-9 * (1 + size + self.reach)
        return columns, length, error


class Nest(Rows):
    """Rows to look among by their first columns, as many as are asked for, in one memory."""

    def __init__(self, x: np.ndarray):
        super().__init__(x)
        if self.usable:
            lengths = np.cumsum(np.square(self.x - self.centre), axis=1)
            self.reaches = np.sqrt(lengths.max(0))
            self.lengths = np.ascontiguousarray(lengths.T, np.float32)
            self.halved = np.ascontiguousarray(self.wide[:, 1:].T) / 2  # the centred columns, less than nothing

    def first(self, d: int) -> Rows:
        """The rows by their first d columns; it holds until the next is asked for."""
        rows = copy(self)
        rows.x, rows.d = self.x[:, :d], d
        if self.usable:
            rows.centre, rows.wide, rows.reach = self.centre[:d], self.wide[:, : d + 1], float(self.reaches[d - 1])
            rows.wide[: self.n, 0] = self.lengths[d - 1]
        return rows


def usable(asked: np.ndarray, rows: Rows) -> bool:
    return rows.usable and float(np.abs(asked).max(initial=0.0)) < LARGE


def squared(a: np.ndarray, who: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Squared distances of rows a[who] and b[place]."""
    out = np.empty(len(who))
    for i in range(0, len(who), SLICE):
        gap = a[who[i : i + SLICE]] - b[place[i : i + SLICE]]
        out[i : i + SLICE] = np.square(gap, out=gap).sum(1)
    return out


def _rounded(d: np.ndarray, root: bool) -> np.ndarray:
    return np.round(np.sqrt(d) if root else d, PLACES)


def nearest_rows(asked: np.ndarray, rows: Rows, k: int, root: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(rounded squared distance, or with ``root`` distance; place) of the k nearest rows of each asked one, ties by place."""
    k = min(k, rows.n)
    parts = [_nearest(asked[i : i + ASKED], rows, k, root) for i in range(0, len(asked), ASKED)]
    if not parts:
        return np.empty((0, k)), np.empty((0, k), dtype=np.int64)
    return np.concatenate([d for d, _ in parts]), np.concatenate([p for _, p in parts])


def _nearest(asked: np.ndarray, rows: Rows, k: int, root: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(asked)
    if not k or k * COARSE > rows.n or not usable(asked, rows):
        return _nearest_in_full(asked, rows, k, root)
    if rows.d == 1:
        return _nearest_on_a_line(asked, rows, k, root)
    columns, length, error = rows.ready(asked)
    least = np.empty((len(rows.wide) // FINE, n), np.float32)
    for i in range(0, len(rows.wide), TILE):
        tile = rows.wide[i : i + TILE] @ columns
        np.min(tile.reshape(-1, FINE, n), axis=1, out=least[i // FINE : (i + len(tile)) // FINE])
    coarse = np.ascontiguousarray(least.reshape(-1, COARSE // FINE, n).min(1).T)
    # k groups have a row within the k-th least, so the k nearest are within it and the errors
    limit = np.partition(coarse, k - 1, axis=1)[:, k - 1].astype(float) + 2 * error
    bound = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
    who, group = np.nonzero(coarse <= bound[:, None])
    fine = (group[:, None] * (COARSE // FINE) + np.arange(COARSE // FINE)).ravel()
    who = np.repeat(who, COARSE // FINE)
    near = least[fine, who] <= bound[who]
    who, fine = who[near], fine[near]
    if len(who) * FINE > PAIRS and n > 1:
        halves = [_nearest(x, rows, k, root) for x in (asked[: n // 2], asked[n // 2 :])]
        return np.concatenate([d for d, _ in halves]), np.concatenate([p for _, p in halves])
    place = (fine[:, None] * FINE + np.arange(FINE)).ravel()
    who = np.repeat(who, FINE)
    who, place = who[place < rows.n], place[place < rows.n]
    d = squared(asked, who, rows.x, place)
    near = d - length[who] <= limit[who]
    return _least(who[near], place[near], _rounded(d[near], root), n, k)


def _least(who: np.ndarray, place: np.ndarray, d: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least distances, ties by place, of each of n rows."""
    order = np.lexsort((place, d, who))
    chosen = order[np.searchsorted(who[order], np.arange(n))[:, None] + np.arange(k)]
    return d[chosen], place[chosen]


def _nearest_on_a_line(asked: np.ndarray, rows: Rows, k: int, root: bool) -> tuple[np.ndarray, np.ndarray]:
    """As ``_nearest`` by one column, whose order gives the rows that are near."""
    order = np.argsort(rows.x[:, 0], kind="stable")
    line, own = rows.x[order, 0], asked[:, 0]
    beside = np.searchsorted(line, own)[:, None] + np.arange(-k, k)
    gap = np.abs(line[np.clip(beside, 0, rows.n - 1)] - own[:, None])
    gap[(beside < 0) | (beside >= rows.n)] = np.inf
    reach = np.partition(gap, k - 1, axis=1)[:, k - 1]
    reach = np.maximum(np.sqrt(reach * reach + 4e-9), reach + 4e-9) * (1 + 1e-12) + 1e-15 * (rows.most + np.abs(own))
    start, stop = np.searchsorted(line, own - reach), np.searchsorted(line, own + reach, "right")
    each, n = stop - start, len(asked)
    if each.sum() > PAIRS and n > 1:
        halves = [_nearest_on_a_line(x, rows, k, root) for x in (asked[: n // 2], asked[n // 2 :])]
        return np.concatenate([d for d, _ in halves]), np.concatenate([p for _, p in halves])
    who = np.repeat(np.arange(n), each)
    place = order[np.arange(len(who)) + np.repeat(start - (np.cumsum(each) - each), each)]
    return _least(who, place, _rounded(squared(asked, who, rows.x, place), root), n, k)


def _nearest_in_full(asked: np.ndarray, rows: Rows, k: int, root: bool) -> tuple[np.ndarray, np.ndarray]:
    out_d, out_p = np.empty((len(asked), k)), np.empty((len(asked), k), dtype=np.int64)
    step = max(1, PAIRS // max(1, rows.n))
    for i in range(0, len(asked), step):
        some = asked[i : i + step]
        d = np.zeros((len(some), rows.n))
        for f in range(rows.d):
            d += np.square(some[:, f, None] - rows.x[None, :, f])
        d = _rounded(d, root)
        place = np.argsort(d, axis=1, kind="stable")[:, :k]
        out_d[i : i + step], out_p[i : i + step] = np.take_along_axis(d, place, 1), place
    return out_d, out_p


def nearest_nested(asked: np.ndarray, nest: Nest, sizes: list[int], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """What ``nearest_rows`` gives by the first columns, for each of the ascending numbers of them.

    Distances grow with the columns: what is near by more of them is no further by fewer. So the
    products by some columns, with a bound for the nearest by a few more, leave few rows for all
    the numbers in between.
    """
    k = min(k, nest.n)
    parts = [_nested(asked[i : i + ASKED], nest, sizes, k) for i in range(0, len(asked), ASKED)]
    if not parts:
        return [(np.empty((0, k)), np.empty((0, k), dtype=np.int64)) for _ in sizes]
    return [(np.concatenate([d for d, _ in of]), np.concatenate([p for _, p in of])) for of in zip(*parts, strict=True)]


def _nested(asked: np.ndarray, nest: Nest, sizes: list[int], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    found: list[tuple[np.ndarray, np.ndarray]] = []
    pool, n = None, len(asked)
    while len(found) < len(sizes):
        ahead = sizes[len(found) : len(found) + AHEAD]
        rows = nest.first(ahead[0])
        got = _between(asked, nest, rows, ahead, *pool, k) if pool is not None and usable(asked, nest) else None
        if got is None:
            _, place = nearest_rows(asked[:, : rows.d], rows, max(k, POOL) if len(found) + 1 < len(sizes) else k)
            d = grown(asked, np.repeat(np.arange(n), place.shape[1]), nest.x, place.ravel(), 0.0, 0, ahead[:1]).reshape(place.shape)
            found.append((np.round(d[:, :k], PLACES), place[:, :k]))
            pool = place, d, ahead[0]
        else:
            some, pool = got
            found += some
    return found


def _between(
    asked: np.ndarray, nest: Nest, rows: Rows, ahead: list[int], near: np.ndarray, far: np.ndarray, known: int, k: int
) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray, int]] | None:
    """(what is nearest by the first numbers of columns ahead; places, distances and their number of columns for the next call); None if too many rows are left.

    near, far: different places for each asked row, at least k, and their squared distances by
    the ``known`` first columns, infinite for what only fills up.
    """
    n = len(asked)
    further = grown(asked, np.repeat(np.arange(n), near.shape[1]), nest.x, near.ravel(), far.ravel(), known, ahead).reshape(*near.shape, -1)
    most = np.partition(further, k - 1, axis=1)[:, k - 1]  # the k nearest are no further
    z = asked[:, : ahead[-1]] - nest.centre[: ahead[-1]]
    columns = np.concatenate([np.ones((1, n), np.float32), z.T.astype(np.float32)])
    size, reach = np.sqrt(np.square(z).sum(1)), float(nest.reaches[ahead[-1] - 1])
    error = (ahead[-1] + 20) * 2.0**-23 * (size + reach) ** 2 + 1e-15 * max(nest.most, float(np.abs(asked).max())) * (ahead[-1] + 1) * (size + reach) + 4e-9 * (1 + size + reach)
    own = np.square(z[:, : rows.d]).sum(1)
    bound = np.nextafter((most - own[:, None] + error[:, None]).astype(np.float32), np.float32(np.inf))
    wide, first = rows.wide, columns[: rows.d + 1]
    sample = wide[::SAMPLED] @ first
    end = 0
    while end < len(ahead) and np.count_nonzero(sample <= bound[:, end]) * SAMPLED <= EACH * n:
        end += 1
    if not end:
        return None
    tile, flags, high = np.empty((TILE, n), np.float32), np.empty((TILE, n), bool), bound[:, end - 1]
    hit, product, total = [], [], 0
    for i in range(0, len(wide), TILE):
        part = wide[i : i + TILE]
        np.matmul(part, first, out=tile[: len(part)])
        np.less_equal(tile[: len(part)], high, out=flags[: len(part)])
        at = np.flatnonzero(flags[: len(part)])
        hit.append(at + i * n)
        product.append(tile.ravel()[at])
        total += len(at)
        if total > PAIRS:
            return None
    place, who = np.divmod(np.concatenate(hit), n)
    order = np.argsort(who.astype(np.int16), kind="stable")  # places ascend for each
    who, place, d = who[order], place[order], np.concatenate(product)[order]
    left = d <= bound[who, 0]
    for i in range(1, end):  # what is too far by some number of columns may be near by another
        for f in range(ahead[i - 1], ahead[i]):
            d += np.square(columns[f + 1][who] + nest.halved[f][place])
        left |= d <= bound[who, i]
    near, far = np.zeros((n, max(k, POOL)), np.int64), np.full((n, max(k, POOL)), np.inf)
    for some, at, filled in _by_row(who, n):
        apart = np.where(filled, d[at], np.float32(np.inf))
        best = np.argpartition(apart, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if apart.shape[1] > near.shape[1] else np.arange(apart.shape[1])[None].repeat(len(some), 0)
        near[some, : best.shape[1]] = np.take_along_axis(place[at], best, 1)
        far[some, : best.shape[1]] = np.take_along_axis(apart, best, 1) + (own + error)[some, None]  # at most so far
    who, place = who[left], place[left]
    whole = np.round(grown(asked, who, nest.x, place, 0.0, 0, ahead[:end]), PLACES)
    found = [(np.empty((n, k)), np.empty((n, k), np.int64)) for _ in range(end)]
    for some, at, filled in _by_row(who, n):
        places, row = place[at], np.arange(len(some))
        for i, (out_d, out_p) in enumerate(found):
            apart = np.where(filled, whole[at, i], np.inf)
            for j in range(k):
                c = apart.argmin(1)
                out_d[some, j], out_p[some, j] = apart[row, c], places[row, c]
                apart[row, c] = np.inf
    return found, (near, far, ahead[end - 1])


def _by_row(who: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(some of n rows that have about as many pairs, matrix of their pairs' indices, whether each is one) of pairs in order of their row."""
    each = np.bincount(who, minlength=n)
    begin, ranked = np.cumsum(each) - each, np.argsort(each, kind="stable")
    for s in range(0, n, 64):
        some = ranked[s : s + 64]
        across = np.arange(each[some[-1]])
        filled = across < each[some][:, None]
        yield some, np.where(filled, begin[some][:, None] + across, 0), filled


def grown(a: np.ndarray, who: np.ndarray, b: np.ndarray, place: np.ndarray, d: np.ndarray | float, known: int, sizes: list[int]) -> np.ndarray:
    """Squared distances of rows a[who] and b[place] by the first columns, for each number of them, from those by the ``known`` first ones."""
    out, ends = np.empty((len(who), len(sizes))), np.array(sizes) - known
    a, b = a[:, known : sizes[-1]], b[:, known : sizes[-1]]
    d = np.broadcast_to(d, len(who))
    for i in range(0, len(who), SLICE // 8):
        some = slice(i, i + SLICE // 8)
        gap = np.empty((len(who[some]), sizes[-1] - known + 1))
        gap[:, 0] = d[some]
        gap[:, 1:] = np.square(a[who[some]] - b[place[some]])
        out[some] = np.cumsum(gap, axis=1, out=gap)[:, ends]
    return out


def hits(asked: np.ndarray, rows: Rows, eps: float, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, matrix of places by asked rows: at most eps apart after rounding) of each tile between start and stop."""
    stop = rows.n if stop is None else stop
    fine = usable(asked, rows)
    if fine:
        columns, length, error = rows.ready(asked)
        high = np.nextafter((eps * eps - length + error * (1 + eps)).astype(np.float32), np.float32(np.inf))
        low = np.nextafter((eps * eps - length - error * (1 + eps)).astype(np.float32), np.float32(-np.inf))
    step = TILE if fine else max(1, PAIRS // max(1, len(asked)))
    for i in range(start, stop, step):
        j = min(stop, i + step)
        if fine:
            tile = rows.wide[i:j] @ columns
            found = tile <= low
            place, who = np.divmod(np.flatnonzero((tile <= high) != found), len(asked))
        else:
            found = np.zeros((j - i, len(asked)), bool)
            place, who = (x.ravel() for x in np.indices(found.shape))
        for at in range(0, len(who), PAIRS):
            p, w = place[at : at + PAIRS], who[at : at + PAIRS]
            found[p, w] = _rounded(squared(asked, w, rows.x, p + i), True) <= eps
        yield i, found


def counted(asked: np.ndarray, rows: Rows, eps: float) -> np.ndarray:
    """Number of rows at most eps from each asked one."""
    n = np.zeros(len(asked), np.int64)
    for at in range(0, len(asked), ASKED):
        for _, found in hits(asked[at : at + ASKED], rows, eps):
            bits = found.view(np.uint8)
            for i in range(0, len(bits), 255):
                n[at : at + ASKED] += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return n


def without_self(own: np.ndarray, d: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest but the row itself, of the k + 1 nearest."""
    is_self = place == own[:, None]
    if d.shape[1] <= k:  # all rows are there
        is_self[~is_self.any(1), -1] = True
    else:  # copies of lesser id may have kept the row itself out
        is_self[~is_self.any(1), k] = True
    return d[~is_self].reshape(len(d), -1), place[~is_self].reshape(len(d), -1)


def collected(rows: DataFrame, *more: str | Column) -> tuple[np.ndarray, ...]:
    """(ids in ascending order, features, further columns) of a table that fits the driver."""
    got = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("features").cast("array<double>").alias("features"), *more).toArrow()
    ids = got["row_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(got["features"])[order], *[got.column(i).to_numpy()[order] for i in range(2, 2 + len(more))]


def size_of(rows: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a feature table in memory."""
    n, width = rows.agg(F.count("*"), F.max(F.size("features"))).first()
    return n, n * ((width or 0) + 2) * 8


def gathered(rows: DataFrame, most: int, *more: str | Column) -> tuple[int, int, tuple[np.ndarray, ...] | None]:
    """(rows, bytes, what ``collected`` gives of a table of at most ``most`` bytes); the rows are worked out once."""
    own = rows.storageLevel == StorageLevel.NONE
    if own:
        rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, size = size_of(rows)
        return n, size, collected(rows, *more) if 0 < size <= most else None
    finally:
        if own:
            rows.unpersist()


def dealt(spark: SparkSession, units: list[tuple], pairs: int, work: Callable[[tuple], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Rows that ``work`` makes of each unit; as many tasks as ``pairs`` of rows to look at ask for."""
    tasks = max(1, min(len(units), pairs // TASK_PAIRS + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                made = work(units[i])
                if made is not None and made.num_rows:
                    yield made

    return spark.range(0, len(units), 1, tasks).mapInArrow(run, schema)


def chunks(n: int, among: int) -> list[tuple[int, int]]:
    """Parts of n asked rows, each about one task's pairs with as many other rows."""
    step = max(ASKED, TASK_PAIRS // max(1, among) // ASKED * ASKED)
    return [(i, min(n, i + step)) for i in range(0, n, step)]


_last: dict[str, tuple] = {}


def kept(kind: str, key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives for the key, made once in a worker while the key stays the same."""
    if kind not in _last or _last[kind][0] != key:
        _last.pop(kind, None)
        _last[kind] = (key, make())
    return _last[kind][1]
