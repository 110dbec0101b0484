"""Filter scores of features, from the unpivoted table (row_id, label, feature, value).

Counts and moments are grouped sums; ranks are made in parts of a feature's range, cut at
its approximate quantiles, and are exact. The matrices
over pairs of features have as many rows as features, squared, not as data rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskforge.operators import evaluate
from maskforge.operators.evaluate import BLOCK_BYTES
from maskforge.operators.features import PARTS, placed, unpivoted
from maskforge.operators.neighbours import Rows, chunks, collected, dealt, kept, matrix, nearest_rows, without_self


def long(features: DataFrame) -> DataFrame:
    return unpivoted(features, "row_id", "label")


def binned(values: DataFrame, bins: int) -> DataFrame:
    """Adds bin: equal-frequency bins by rank, floor(rank * bins / n), ties in row order."""
    cuts = values.groupBy("feature").agg(F.count("*").alias("n"), F.percentile_approx("value", [p / PARTS for p in range(1, PARTS)], 4 * PARTS).alias("cuts"))  # one row per feature
    # collected: worked out again, approximate cuts may be others, and parts then disagree with their counts
    cuts = values.sparkSession.createDataFrame(cuts.collect(), cuts.schema)
    parted, step = values.join(F.broadcast(cuts), "feature").withColumn("part", F.lit(0)), PARTS // 2
    while step:  # binary search for the number of cuts under the value
        parted = parted.withColumn("part", F.col("part") + F.when(F.col("value") > F.get("cuts", F.col("part") + (step - 1)), step).otherwise(0))
        step //= 2
    return placed(parted.drop("cuts"), "feature", "part", "value", "row_id").withColumn("bin", F.floor((F.col("k") - 1) * bins / F.col("n")).cast("int")).drop("k", "n", "part")


def entropy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Entropy in bits of the counts under each key."""
    c = F.col(n)
    sums = counts.groupBy(*keys).agg(F.sum(c).alias("_n"), F.sum(c * F.log2(c)).alias("_s"))
    return sums.select(*keys, (F.log2("_n") - F.col("_s") / F.col("_n")).alias("h"))


def information(joint: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, hx, hy, mi of two discrete columns from their joint counts n."""
    hx = entropy(joint.groupBy(*keys, x).agg(F.sum("n").alias("n")), keys).withColumnRenamed("h", "hx")
    hy = entropy(joint.groupBy(*keys, y).agg(F.sum("n").alias("n")), keys).withColumnRenamed("h", "hy")
    both = entropy(joint, keys).withColumnRenamed("h", "hxy")
    return hx.join(hy, keys).join(both, keys).withColumn("mi", F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy")))


def uncertainty() -> Column:
    total = F.col("hx") + F.col("hy")
    return F.when(total > 0, 2 * F.col("mi") / total).otherwise(0.0)


def label_counts(features: DataFrame, bins: int = 10) -> DataFrame | None:
    """feature, bin, label, n (as many rows as there are of these), counted in memory; None if the table is over ``BROADCAST_BYTES``, or rows lack values or differ in length."""
    width, lacks = F.size("features"), F.exists("features", lambda v: v.isNull() | F.isnan(v.cast("double")))
    odd = F.col("features").isNull() | F.col("label").isNull() | F.col("row_id").isNull() | lacks
    n, least, most, some_odd = features.agg(F.count("*"), F.min(width), F.max(width), F.max(odd.cast("int"))).first()
    if not n or some_odd or least != most or not most or n * (most + 2) * 8 > evaluate.BROADCAST_BYTES:
        return None
    bin_of, counts, step = np.arange(n) * bins // n, [], max(1, BLOCK_BYTES // (8 * n))
    for start in range(0, most, step):  # some features at once spare the driver's memory
        _, x, y = collected(features.select("row_id", F.slice("features", start + 1, step).alias("features"), "label"), "label")
        labels, code = np.unique(y, return_inverse=True)
        for values in x.T:  # ids ascend, so ties are in row order
            order = np.argsort(values, kind="stable")
            counts.append(np.bincount(bin_of * len(labels) + code[order], minlength=bins * len(labels)).reshape(bins, -1))
    counts = np.array(counts)
    f, b, c = np.nonzero(counts)
    table = pa.table({"feature": f.astype(np.int32), "bin": b.astype(np.int32), "label": labels[c], "n": counts[f, b, c]})
    return features.sparkSession.createDataFrame(table).coalesce(1)


def label_information(features: DataFrame, bins: int = 10, gather: bool = False) -> DataFrame:
    """feature, mi and su (symmetrical uncertainty) with the label; with ``gather`` a table that may be sent to every task is counted in memory."""
    joint = label_counts(features, bins) if gather else None
    if joint is None:
        joint = binned(long(features), bins).groupBy("feature", "bin", "label").agg(F.count("*").alias("n"))
    return information(joint, ["feature"], "bin", "label").select("feature", "mi", uncertainty().alias("su"))


def pair_information(features: DataFrame, bins: int = 10) -> DataFrame:
    """f, g (f < g), mi and su of each pair of features."""
    b = binned(long(features), bins)
    row = b.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("feature", "bin"))).alias("x"))  # as long as there are features
    left = row.select("x", F.posexplode("x").alias("at", "a"))
    pairs = left.select("a", F.explode(F.slice("x", F.col("at") + 2, F.size("x"))).alias("b"))
    joint = pairs.groupBy(F.col("a.feature").alias("f"), F.col("b.feature").alias("g"), F.col("a.bin").alias("x"), F.col("b.bin").alias("y")).agg(F.count("*").alias("n"))
    return information(joint, ["f", "g"], "x", "y").select("f", "g", "mi", uncertainty().alias("su"))


def both_ways(pairs: DataFrame, *values: str) -> DataFrame:
    return pairs.select("f", "g", *values).unionByName(pairs.select(F.col("g").alias("f"), F.col("f").alias("g"), *values))


def mrmr(features: DataFrame, bins: int = 10) -> DataFrame:
    """feature, miq = relevance / (mean redundancy + 1e-6), mid = relevance - mean redundancy."""
    redundancy = both_ways(pair_information(features, bins), "mi").groupBy(F.col("f").alias("feature")).agg(F.avg("mi").alias("red"))
    both = label_information(features, bins).join(redundancy, "feature")
    return both.select("feature", (F.col("mi") / (F.col("red") + 1e-6)).alias("miq"), (F.col("mi") - F.col("red")).alias("mid"))


def cfs_merit(features: DataFrame, masks: DataFrame, bins: int = 10) -> DataFrame:
    """cand_id and merit k r_cf / sqrt(k + k (k - 1) r_ff) of each mask, from symmetrical uncertainties."""
    chosen = masks.select("cand_id", F.posexplode("mask").alias("feature", "bit")).where("bit = 1").drop("bit")
    relevance = chosen.join(label_information(features, bins).select("feature", "su"), "feature").groupBy("cand_id").agg(F.count("*").alias("k"), F.avg("su").alias("cf"))
    pairs = pair_information(features, bins)
    inner = chosen.withColumnRenamed("feature", "f").join(pairs, "f").join(chosen.withColumnRenamed("feature", "g"), ["cand_id", "g"]).groupBy("cand_id").agg(F.avg("su").alias("ff"))
    both = relevance.join(inner, "cand_id", "left")
    k, ff = F.col("k"), F.coalesce("ff", F.lit(0.0))
    return both.select("cand_id", (k * F.col("cf") / F.sqrt(k + k * (k - 1) * ff)).alias("merit"))


def fisher(features: DataFrame, positive: int = 1) -> DataFrame:
    """feature, score: product-of-means gap over the two classes' variances (10000 where they are 0); the class ``positive`` against the rest."""
    is_one = F.col("label") == positive
    g = long(features).groupBy("feature").agg(*[f(F.when(c, F.col("value"))).alias(n) for c, s in ((is_one, "p"), (~is_one, "n")) for f, n in ((F.avg, f"mu_{s}"), (F.var_samp, f"var_{s}"))])
    spread = F.col("var_p") + F.col("var_n")
    gap = F.col("mu_p") - F.col("mu_n")
    return g.select("feature", (gap * gap / F.when(spread == 0, 10000.0).otherwise(spread)).alias("score"))


def deviations(features: DataFrame) -> DataFrame:
    """feature and the sample deviation of its values."""
    return unpivoted(features).groupBy("feature").agg(F.stddev_samp("value").alias("std"))


def correlations(features: DataFrame, ranks: bool = False) -> DataFrame:
    """f, g (f < g) and r: Pearson, or with ``ranks`` Spearman with average ranks; 0 where undefined."""
    if ranks:
        # ranks of distinct values: no window holds more than a feature's distinct values
        counts = long(features).groupBy("feature", "value").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("feature").orderBy("value"))
        places = counts.select("feature", F.col("value"), (upto - (F.col("n") - 1) / 2).alias("place"))
        values = long(features).join(places, ["feature", "value"]).select("row_id", "feature", F.col("place").alias("value"))
        row = values.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("x"))
    else:
        row = features.select(F.transform("features", lambda v, i: F.struct(i.alias("feature"), v.alias("value"))).alias("x"))
    left = row.select("x", F.posexplode("x").alias("at", "a"))
    pairs = left.select("a", F.explode(F.slice("x", F.col("at") + 2, F.size("x"))).alias("b"))
    x, y = F.col("a.value"), F.col("b.value")
    sums = pairs.groupBy(F.col("a.feature").alias("f"), F.col("b.feature").alias("g")).agg(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"))  # null of a constant feature
    return sums.withColumn("r", F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)))


def mean_abs_correlation(features: DataFrame) -> DataFrame:
    """feature, mean |r| to the others, and similar: the upper half of the order by it."""
    m = both_ways(correlations(features), "r").groupBy(F.col("f").alias("feature")).agg(F.avg(F.abs("r")).alias("mean_abs"))
    n = m.agg(F.count("*").alias("d"))
    order = Window.orderBy(F.round("mean_abs", 9), "feature")  # one row per feature
    ranked = m.withColumn("k", F.row_number().over(order)).crossJoin(F.broadcast(n))
    return ranked.select("feature", "mean_abs", (F.col("k") > F.floor(F.col("d") / 2)).cast("int").alias("similar"))


def relieff(features: DataFrame, neighbours: int = 5, samples: int | None = None) -> DataFrame:
    """feature, weight: misses, weighted by class prior, less hits, over value ranges, averaged over all rows or ``samples`` of least id hash.

    While the table fits ``BROADCAST_BYTES`` each task finds the nearest rows of some rows and adds up their
    gaps. Beyond that rows are dealt into a grid of blocks; of each block and class the nearest rows of each row
    come out with their gaps, and the nearest of all blocks are merged by a grouped minimum.
    """
    n, width = features.agg(F.count("*"), F.max(F.size("features"))).first()
    blocks = max(1, -(-n * ((width or 0) + 2) * 8 // BLOCK_BYTES))
    prior = {r[0]: r[1] / n for r in features.groupBy("label").count().collect()}  # one row per class
    low_high = unpivoted(features).groupBy("feature").agg((F.max("value") - F.min("value")).alias("span")).collect()  # one row per feature
    span = [1.0] * (width or 0)
    for r in low_high:
        span[r["feature"]] = r["span"] or 1.0
    rows = features.select("row_id", F.col("features").cast("array<double>").alias("features"), "label")
    asked = rows if samples is None else rows.orderBy(F.md5(F.col("row_id").cast("string").cast("binary")), "row_id").limit(samples)
    if n and n * ((width or 0) + 2) * 8 <= evaluate.BROADCAST_BYTES:
        gaps = _summed_gaps(rows, None if samples is None else asked, prior, np.array(span), neighbours)
        return gaps.groupBy("feature").agg((F.sum("gap") / min(n, samples or n)).alias("weight"))
    own = F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = asked.select("row_id", "features", "label", own.alias("v"), every.alias("t"))
    right = rows.select(F.col("row_id").alias("id"), F.col("features").alias("x"), F.col("label").alias("c"), every.alias("rv"), own.alias("rt"))
    schema = "row_id long, label int, c int, d double, id long, gap array<double>"

    def near(asked: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and known.num_rows:
            known = known.sort_by("id")
            ids, x, y = known["id"].to_numpy(), matrix(known["x"]), known["c"].to_numpy()
            for row, values, label in zip(asked["row_id"].to_pylist(), matrix(asked["features"]), asked["label"].to_pylist(), strict=True):
                d = np.round(np.square(x - values).sum(1), 9)
                for name in prior:
                    place = np.flatnonzero((y == name) & (ids != row))
                    place = place[np.argsort(d[place], kind="stable")[:neighbours]]
                    out += [(row, label, name, d[p], ids[p], np.abs(x[p] - values) / span) for p in place.tolist()]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
        return pa.table({c.split()[0]: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(schema.split(", "), kinds, strict=True))})

    found = left.groupBy("v", "t").cogroup(right.groupBy("rv", "rt")).applyInArrow(near, schema)
    best = found.groupBy("row_id", "label", "c").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "gap"))), 1, neighbours).alias("near"))  # few rows of each block
    share = F.create_map(*[F.lit(v) for kv in prior.items() for v in kv]) if prior else F.create_map()
    weight = F.when(F.col("label") == F.col("c"), -1.0).otherwise(share[F.col("c")] / (1 - share[F.col("label")])) / F.size("near")
    gaps = best.select(weight.alias("w"), F.explode("near").alias("x")).select("w", F.posexplode("x.gap").alias("feature", "gap"))
    return gaps.groupBy("feature").agg((F.sum(F.col("w") * F.col("gap")) / min(n, samples or n)).alias("weight"))


def _summed_gaps(rows: DataFrame, asked: DataFrame | None, prior: dict[int, float], span: np.ndarray, neighbours: int) -> DataFrame:
    """feature, gap: weighed gaps of some of the asked rows (default: all) to their nearest of each class, added up."""
    spark, token = rows.sparkSession, uuid.uuid4().hex
    ids, x, y = collected(rows, "label")
    some = np.arange(len(ids)) if asked is None else np.flatnonzero(np.isin(ids, [r[0] for r in asked.select("row_id").collect()]))
    shared = spark.sparkContext.broadcast((x, y, some))

    def work(unit: tuple[int, int]) -> pa.RecordBatch:
        x, y, some = shared.value
        own = some[unit[0] : unit[1]]
        total = np.zeros(x.shape[1])
        classes = kept("classes", token, lambda: [(name, p := np.flatnonzero(y == name), Rows(x[p])) for name in prior])
        for name, places, known in classes:
            for same in (True, False):
                mine = own[(y[own] == name) == same]
                d, near = nearest_rows(x[mine], known, neighbours + same)
                if same:
                    _, near = without_self(np.searchsorted(places, mine), d, near, neighbours)
                if not near.size:
                    continue
                weight = np.full(len(mine), -1.0) if same else prior[name] / (1 - np.array([prior[c] for c in y[mine].tolist()]))
                for i in range(0, len(mine), 1024):
                    m = mine[i : i + 1024]
                    gap = np.abs(x[places[near[i : i + 1024]]] - x[m][:, None]).mean(1)
                    total += weight[i : i + 1024] @ gap / span
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["feature", "gap"])

    return dealt(spark, chunks(len(some), len(ids)), len(some) * len(ids), work, "feature int, gap double")


def unit(column: str) -> Column:
    whole = Window.partitionBy()
    low, high = F.min(column).over(whole), F.max(column).over(whole)
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.0)


def adaptive(features: DataFrame, threshold: float = 0.5, bins: int = 10, neighbours: int = 5, samples: int | None = None) -> DataFrame:
    """feature, su, weight, dist, selected: distance of the scaled scores from the origin; the top tenth if none reaches the threshold."""
    both = label_information(features, bins).select("feature", "su").join(relieff(features, neighbours, samples), "feature")
    both = both.withColumn("a", unit("su")).withColumn("b", unit("weight")).withColumn("dist", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")))
    whole = Window.partitionBy()
    order = Window.orderBy(F.desc(F.round("dist", 9)), F.desc("feature"))
    top = F.row_number().over(order) <= F.greatest(F.lit(1), F.floor(0.1 * F.count("*").over(whole)))
    chosen = F.when(F.max("dist").over(whole) >= threshold, F.col("dist") >= threshold).otherwise(top)
    return both.select("feature", "su", "weight", "dist", chosen.cast("int").alias("selected"))


def nmi_binary(masks: DataFrame) -> DataFrame:
    """a, b (a < b), nmi: mutual information of two masks' bits over the root of their entropies."""
    bits = masks.select("cand_id", F.posexplode("mask").alias("f", "bit"))
    pairs = bits.alias("x").join(bits.alias("y"), (F.col("x.f") == F.col("y.f")) & (F.col("x.cand_id") < F.col("y.cand_id")))
    joint = pairs.groupBy(F.col("x.cand_id").alias("a"), F.col("y.cand_id").alias("b"), F.col("x.bit").alias("p"), F.col("y.bit").alias("q")).agg(F.count("*").alias("n"))
    got = information(joint, ["a", "b"], "p", "q")
    return got.select("a", "b", F.when((F.col("hx") > 0) & (F.col("hy") > 0), F.col("mi") / F.sqrt(F.col("hx") * F.col("hy"))).otherwise(0.0).alias("nmi"))


def infinite_scores(features: DataFrame, alpha: float = 0.5, supervised: bool = True) -> list[tuple[int, float]]:
    """(feature, energy) of the graph of all paths over features, largest first.

    The moments and correlations are grouped sums; only d and d * d numbers come to the driver.
    """
    moments = _moments(features)
    relation = None
    if not supervised:
        relation = np.eye(len(moments))
        for r in correlations(features, ranks=True).collect():
            relation[r["f"], r["g"]] = relation[r["g"], r["f"]] = r["r"]
    return sorted(enumerate(_energies(moments, relation, alpha).tolist()), key=lambda e: (-e[1], e[0]))


def graph_scores(features: DataFrame, masks: list[tuple[int, list[int]]], alpha: float = 0.5) -> list[tuple[int, float]]:
    """(cand_id, minus the mean energy of the chosen features in the graph of these alone), 0 for an empty mask; the table is read once."""
    moments, out = _moments(features), []
    for name, mask in masks:
        chosen = np.flatnonzero(mask)
        out.append((name, -float(_energies(moments[chosen], None, alpha).mean()) if len(chosen) else 0.0))
    return out


def _moments(features: DataFrame) -> np.ndarray:
    """Deviation, means of label 1 and the others, and their variances, a row for each feature."""
    value, one = F.col("value"), F.col("label") == 1
    moments = {r[0]: r for r in long(features).groupBy("feature").agg(F.stddev_samp("value"), F.avg(F.when(one, value)), F.avg(F.when(~one, value)), F.var_samp(F.when(one, value)), F.var_samp(F.when(~one, value))).collect()}
    return np.array([[float(v or 0.0) for v in moments[f][1:]] for f in sorted(moments)])


def _energies(table: np.ndarray, relation: np.ndarray | None, alpha: float) -> np.ndarray:
    """Energy of all paths through each feature; without a relation, that of class separation."""
    unit_matrix = lambda m: (m - m.min()) / (np.ptp(m) or 1.0)
    if relation is None:
        spread = table[:, 3] + table[:, 4]
        gap = np.square(table[:, 1] - table[:, 2]) / np.where(spread == 0, 10000.0, spread)
        relation = unit_matrix(np.outer(gap, gap))
    graph = alpha * relation + (1 - alpha) * unit_matrix(np.maximum(table[:, 0][:, None], table[:, 0][None, :]))
    radius = np.abs(np.linalg.eigvals(graph)).max() or 1.0
    return (np.linalg.inv(np.eye(len(table)) - 0.9 / radius * graph) - np.eye(len(table))).sum(1)
