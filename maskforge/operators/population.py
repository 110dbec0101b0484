"""Operators on relations of candidates: duplicates, fronts, crowding, groups, sampling.

A population has cand_id and mask, or cand_id and the objectives err and ratio.
Its size is set by the search, tens to thousands; pairs of candidates are joined
only here, never pairs of data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskforge.functions.arrays import clipped, hamming, mask_key, total, velocity
from maskforge.functions.portable import uniform


def deduplicated(population: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Of equal masks the one whose position is farthest from the threshold, then the least id."""
    sure = total(F.transform("position", lambda v: F.abs(v - threshold))) if "position" in population.columns else F.lit(0.0)
    order = Window.partitionBy("mask_key").orderBy(F.desc(sure), "cand_id")
    return population.withColumn("mask_key", mask_key(F.col("mask"))).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def hamming_pairs(population: DataFrame) -> DataFrame:
    """a, b (a < b) and the number of bits in which their masks differ."""
    left = population.select(F.col("cand_id").alias("a"), F.col("mask").alias("x"))
    right = population.select(F.col("cand_id").alias("b"), F.col("mask").alias("y"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", hamming(F.col("x"), F.col("y")).alias("distance"))


def first_front(objectives: DataFrame) -> DataFrame:
    """Candidates that no other dominates: one at least as good in both objectives and better in one."""
    other = objectives.select(F.col("err").alias("e"), F.col("ratio").alias("r"))
    dominated = (F.col("e") <= F.col("err")) & (F.col("r") <= F.col("ratio")) & ((F.col("e") < F.col("err")) | (F.col("r") < F.col("ratio")))
    return objectives.join(other, dominated, "left_anti")


def fronts(objectives: DataFrame, limit: int = 1000) -> DataFrame:
    """Adds front, from 1, by taking first fronts away; one job for each front."""
    rows = objectives.sparkSession.createDataFrame(objectives.collect(), objectives.schema)  # a population, bounded by the search
    out, n = None, 0
    while n < limit and not rows.isEmpty():
        n += 1
        best = first_front(rows)
        front = best.withColumn("front", F.lit(n))
        out = front if out is None else out.unionByName(front)
        rows = objectives.sparkSession.createDataFrame(rows.join(best.select("cand_id"), "cand_id", "left_anti").select(*objectives.columns).collect(), objectives.schema)
    return out if out is not None else objectives.withColumn("front", F.lit(0)).where("false")


def objective_crowding(objectives: DataFrame) -> DataFrame:
    """cand_id, crowding: the gaps to both neighbours along each objective over its range, 1 at the lower end and 0 at the upper."""
    out = F.lit(0.0)
    rows = objectives
    for name in ("err", "ratio"):
        order = Window.orderBy(F.col(name), "cand_id")
        whole = Window.partitionBy()
        span = F.max(name).over(whole) - F.min(name).over(whole)
        before, after = F.lag(name).over(order), F.lead(name).over(order)
        gap = F.when(span == 0, 0.0).when(before.isNull(), 1.0).when(after.isNull(), 0.0).otherwise((after - before) / (2 * span))
        rows = rows.withColumn(f"_{name}", gap)
        out = out + F.col(f"_{name}")
    return rows.select("cand_id", out.alias("crowding"))


def solution_crowding(population: DataFrame, neighbours: int = 8) -> DataFrame:
    """cand_id, crowding: mean share of different bits to the nearest others, over its largest value."""
    pairs = hamming_pairs(population)
    both = pairs.select(F.col("a").alias("cand_id"), "distance").unionByName(pairs.select(F.col("b").alias("cand_id"), "distance"))
    near = both.groupBy("cand_id").agg(F.slice(F.array_sort(F.collect_list("distance")), 1, neighbours).alias("d"))
    mean = near.select("cand_id", (total(F.transform("d", lambda v: v.cast("double"))) / F.size("d")).alias("m"))
    top = F.max("m").over(Window.partitionBy())
    return mean.select("cand_id", F.when(top > 0, F.col("m") / top).otherwise(0.0).alias("crowding"))


def combined_crowding(crowding: DataFrame) -> DataFrame:
    """cand_id and the larger of two crowdings (a, b) if either is above its mean, else the smaller."""
    whole = Window.partitionBy()
    above = (F.col("a") > F.avg("a").over(whole)) | (F.col("b") > F.avg("b").over(whole))
    return crowding.select("cand_id", F.when(above, F.greatest("a", "b")).otherwise(F.least("a", "b")).alias("crowding"))


def multimodal_groups(scored: DataFrame, tolerance: float) -> DataFrame:
    """Candidates within the tolerance of the least error among those of their size."""
    best = F.min("err").over(Window.partitionBy("n_selected"))
    return scored.withColumn("best", best).where(F.col("err") <= F.col("best") + tolerance)


def usage(population: DataFrame) -> DataFrame:
    """feature, uses and share of the candidates that select it."""
    return population.select(F.posexplode("mask").alias("feature", "bit")).groupBy("feature").agg(F.sum("bit").cast("long").alias("uses"), F.avg("bit").alias("share"))


def top_features(population: DataFrame, share: float = 0.1) -> DataFrame:
    """The most used features: round(share * d) + 1 of them, ties to the smaller number."""
    used = usage(population)
    n = population.select(F.size("mask").alias("d")).first()[0]
    return used.orderBy(F.desc("uses"), "feature").limit(round(share * n) + 1)


def survivors(parents: DataFrame, children: DataFrame, n: int) -> DataFrame:
    """The n fittest of both, ties to the smaller id."""
    return parents.unionByName(children).orderBy("fitness", "cand_id").limit(n)


def sampled(rows: DataFrame, n: int, seed: int = 0, key: str = "cand_id") -> DataFrame:
    """n rows without replacement, by portable hash."""
    return rows.withColumn("u", uniform(seed, F.col(key))).orderBy("u", key).limit(n).drop("u")


def weighted_pick(rows: DataFrame, seed: int, draws: int, weight: str = "weight") -> DataFrame:
    """draw and cand_id: draws with replacement in proportion to the weights (roulette), by running sums."""
    order = Window.orderBy("cand_id")
    whole = Window.partitionBy()
    spans = rows.withColumn("upto", F.sum(weight).over(order) / F.sum(weight).over(whole)).withColumn("from", F.coalesce(F.lag("upto").over(order), F.lit(0.0)))
    asked = rows.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"), uniform(seed, F.col("id")).alias("u"))
    return asked.join(F.broadcast(spans), (F.col("u") >= F.col("from")) & (F.col("u") < F.col("upto"))).select("draw", "cand_id")


def single_flips(masks: DataFrame) -> DataFrame:
    """cand_id, flipped, mask: every mask with one bit turned, as one relation of candidates."""
    turned = F.transform("mask", lambda b, i: F.when(i == F.col("flipped"), 1 - b).otherwise(b))
    return masks.select("cand_id", "mask", F.explode(F.sequence(F.lit(0), F.size("mask") - 1)).alias("flipped")).select("cand_id", "flipped", turned.alias("mask"))


def rating_entropy(scored: DataFrame, grades: int = 5) -> DataFrame:
    """One row: entropy, to the base of the number of grades, of the fitness values' geometric grades between best and worst."""
    whole = Window.partitionBy()
    low, high = F.min("fitness").over(whole), F.max("fitness").over(whole)
    share = F.when(high > low, (F.col("fitness") - low) / (high - low)).otherwise(0.0)
    grade = F.least(F.lit(grades - 1), F.floor(F.log2(1 + share * (2**grades - 1))))
    counts = scored.withColumn("grade", grade).groupBy("grade").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(whole)
    return counts.withColumn("t", -p * F.log(p) / F.log(F.lit(float(grades)))).agg(F.sum("t").alias("entropy"))


def draws(seed: str, values: str = "x") -> Column:
    """A portable uniform number for each element of an array column, by the candidate's id and the place."""
    return F.transform(values, lambda _, i: uniform(seed, F.col("cand_id"), i))


def swarm_step(population: DataFrame, w: float = 0.9, c: float = 2.0, limit: float = 0.5) -> DataFrame:
    """cand_id, v, x of the next positions; rows have cand_id, x, v, best and lead, and each candidate draws two numbers."""
    pull = lambda name: c * uniform(name, F.col("cand_id"))
    moved = population.withColumn("v", velocity(F.col("v"), F.col("x"), F.col("best"), F.col("lead"), w, pull("r1"), pull("r2"), limit))
    return moved.select("cand_id", "v", clipped(F.zip_with("x", "v", lambda a, b: a + b)).alias("x"))


def ring(population: DataFrame, n: int, *ahead: int) -> DataFrame:
    """``population`` with x1, x2, ...: positions of the candidates so many places further on, round the ids 0 to n - 1."""
    out = population
    for k, step in enumerate(ahead, 1):
        other = population.select(F.pmod(F.col("cand_id") - step, F.lit(n)).alias("cand_id"), F.col("x").alias(f"x{k}"))
        out = out.join(other, "cand_id")
    return out


def difference_step(population: DataFrame, n: int, scale: float = 0.5, rate: float = 0.9) -> DataFrame:
    """cand_id, x: elements of x1 + scale (x2 - x3) of the next three candidates where the draw is under the rate, else the own."""
    rows = ring(population, n, 1, 2, 3).withColumn("gap", F.zip_with("x2", "x3", lambda a, b: scale * (a - b)))
    mutant = clipped(F.zip_with("x1", "gap", lambda a, g: a + g))
    rows = rows.withColumn("mutant", mutant).withColumn("u", draws("cross"))
    return rows.select("cand_id", F.transform("x", lambda v, i: F.when(F.get("u", i) < rate, F.get("mutant", i)).otherwise(v)).alias("x"))


def wolf_step(population: DataFrame, leaders: DataFrame) -> DataFrame:
    """cand_id, x: positions pulled by the three leaders (one row of arrays p1, p2, p3), by the candidate's draws."""
    u = lambda k: uniform(f"wolf{k}", F.col("cand_id"))
    pull = lambda i, v: (1.8 * u(1) - 0.9) * (F.get("p1", i) - v) + 2 * u(2) * (F.get("p2", i) - v) + 2 * u(3) * (F.get("p3", i) - v)
    both = population.crossJoin(F.broadcast(leaders))  # leaders are one row
    return both.select("cand_id", clipped(F.transform("x", lambda v, i: v + pull(i, v))).alias("x"))


def crossover_step(population: DataFrame, n: int, mutation: float = 0.01) -> DataFrame:
    """cand_id, mask: the own bits up to a drawn cut and the next candidate's after it, with rare turned bits."""
    rows = ring(population.withColumnRenamed("mask", "x"), n, 1)
    cut = 1 + F.floor(uniform("cut", F.col("cand_id")) * (F.size("x") - 1))
    child = F.transform("x", lambda b, i: F.when(i < cut, b).otherwise(F.get("x1", i)))
    rows = rows.withColumn("child", child).withColumn("u", draws("turn"))
    return rows.select("cand_id", F.transform("child", lambda b, i: F.when(F.get("u", i) < mutation, 1 - b).otherwise(b)).alias("mask"))


def nearest_old(new: DataFrame, old: DataFrame) -> DataFrame:
    """cand_id, old_id, distance: of each new candidate the old one of least Hamming distance, the least id of equals."""
    pairs = new.select("cand_id", F.col("mask").alias("a")).crossJoin(old.select(F.col("cand_id").alias("old_id"), F.col("mask").alias("b")))  # candidates, not data rows
    far = pairs.select("cand_id", "old_id", hamming(F.col("a"), F.col("b")).alias("distance"))
    return far.groupBy("cand_id").agg(F.min(F.struct("distance", "old_id")).alias("n")).select("cand_id", "n.old_id", "n.distance")


def shared_crowding(crowding: DataFrame, group: str) -> DataFrame:
    """``crowding`` with one score per group: the largest of its members."""
    return crowding.withColumn("crowding", F.max("crowding").over(Window.partitionBy(group)))


def repaired(masks: DataFrame, frequency: DataFrame, size: int) -> DataFrame:
    """cand_id, mask of exactly ``size`` features: the most frequent of the missing come in, the least frequent of the chosen go out; ties to the smaller number.

    frequency: one row per feature (feature, uses).
    """
    bits = masks.select("cand_id", F.posexplode("mask").alias("feature", "bit")).join(F.broadcast(frequency), "feature")
    order = Window.partitionBy("cand_id").orderBy(F.desc("bit"), F.desc("uses"), "feature")
    ranked = bits.withColumn("bit", (F.row_number().over(order) <= size).cast("int"))
    return ranked.groupBy("cand_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "bit"))), lambda b: b["bit"]).alias("mask"))


def least_similar_mates(elite: DataFrame, others: DataFrame, nmi: DataFrame) -> DataFrame:
    """cand_id, mate, nmi: each elite candidate's mate among the others by least normalised mutual information (a, b, nmi), the least id of equals."""
    both = nmi.select("a", "b", "nmi").unionByName(nmi.select(F.col("b").alias("a"), F.col("a").alias("b"), "nmi"))
    pairs = both.join(elite.select(F.col("cand_id").alias("a")), "a").join(others.select(F.col("cand_id").alias("b")), "b")
    return pairs.groupBy(F.col("a").alias("cand_id")).agg(F.min(F.struct("nmi", F.col("b").alias("mate"))).alias("m")).select("cand_id", "m.mate", "m.nmi")


def swapped_duplicates(masks: DataFrame, seed: str = "swap") -> DataFrame:
    """cand_id, mask: later copies of a mask have one chosen feature, drawn, exchanged for one that isn't; others stay."""
    first = Window.partitionBy("key").orderBy("cand_id")
    rows = masks.withColumn("key", mask_key(F.col("mask"))).withColumn("nth", F.row_number().over(first))
    place = lambda bit: F.filter(F.transform("mask", lambda b, i: F.when(b == bit, i)), lambda i: i.isNotNull())
    drawn = lambda items, name: F.get(items, F.floor(uniform(seed, name, F.col("cand_id")) * F.size(items)).cast("int"))
    rows = rows.withColumn("out", drawn(place(1), "out")).withColumn("in", drawn(place(0), "in"))
    turned = F.transform("mask", lambda b, i: F.when((F.col("nth") > 1) & F.col("out").isNotNull() & F.col("in").isNotNull() & ((i == F.col("out")) | (i == F.col("in"))), 1 - b).otherwise(b))
    return rows.select("cand_id", turned.alias("mask"))


def distance_to_ideal(objectives: DataFrame) -> DataFrame:
    """cand_id, distance of (err, ratio), each scaled to 0..1, from the origin."""
    whole = Window.partitionBy()
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(whole), F.max(c).over(whole) - F.min(c).over(whole)), F.lit(0.0))
    return objectives.select("cand_id", scaled("err").alias("a"), scaled("ratio").alias("b")).select("cand_id", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("distance"))


def kth_smallest(scored: DataFrame, k: int, value: str = "err") -> DataFrame:
    """One row: the k-th smallest value, from 0."""
    order = Window.orderBy(value, "cand_id")  # candidates, not data rows
    return scored.withColumn("k", F.row_number().over(order)).where(F.col("k") == k + 1).select(F.col(value).alias("value"))


def best_of_intervals(scored: DataFrame, bounds: list[int], value: str = "err") -> DataFrame:
    """interval, best, cand_id: the least value among candidates whose size lies in (bounds[i], bounds[i + 1]], the least id of equals."""
    upper = F.array(*map(F.lit, bounds[1:]))
    inside = scored.withColumn("interval", F.size(F.filter(upper, lambda b: b < F.col("n_selected")))).where(F.col("n_selected") > bounds[0])
    return inside.groupBy("interval").agg(F.min(F.struct(F.col(value).alias("best"), "cand_id")).alias("m")).select("interval", "m.best", "m.cand_id")


def division_means(scored: DataFrame, divisions: int, n: int, value: str = "err") -> DataFrame:
    """division, mean of the values of consecutive candidates."""
    return scored.groupBy(F.floor(F.col("cand_id") * divisions / n).cast("int").alias("division")).agg(F.avg(value).alias("mean"))
