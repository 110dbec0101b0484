"""Labelled feature tables: scaling, splits, folds and the fixtures of the queries.

A feature table has row_id, features (array of double) and label (int).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskforge.functions.portable import uniform

HUGE = 1.7976931348623157e308
#: More than an order's lines can be numbered: (order, line) as one number.
LINES = 1 << 32


def cleaned(v: Column) -> Column:
    """NaN and null to 0, infinities to the largest numbers."""
    v = F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(-HUGE), F.least(F.lit(HUGE), v))


def unpivoted(features: DataFrame, *keep: str) -> DataFrame:
    """One row per value: the kept columns, feature (from 0) and value."""
    return features.select(*keep, F.posexplode("features").alias("feature", "value"))


def ranges(features: DataFrame) -> DataFrame:
    """One row with the arrays lo and hi: least and largest value of each feature."""
    each = unpivoted(features).groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    placed = each.agg(F.array_sort(F.collect_list(F.struct("feature", "lo", "hi"))).alias("r"))  # as many rows as features
    return placed.select(F.transform("r", lambda x: x["lo"]).alias("lo"), F.transform("r", lambda x: x["hi"]).alias("hi"))


def scaled(features: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Features scaled to 0..1 by the ranges of ``fit_on`` (default: all rows); constant ones become 0."""
    clean = features.withColumn("features", F.transform("features", cleaned))
    basis = clean if fit_on is None else fit_on.withColumn("features", F.transform("features", cleaned))
    both = clean.crossJoin(F.broadcast(ranges(basis)))  # the ranges are one row
    share = F.transform("features", lambda v, i: F.when(F.get("hi", i) > F.get("lo", i), (v - F.get("lo", i)) / (F.get("hi", i) - F.get("lo", i))).otherwise(0.0))
    return both.withColumn("features", share).drop("lo", "hi")


def imputed(features: DataFrame) -> DataFrame:
    """Nulls and NaN to the exact median of the feature."""
    known = unpivoted(features).where(F.col("value").isNotNull() & ~F.isnan("value"))
    middle = known.groupBy("feature").agg(F.median("value").alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("feature", "m"))).alias("m"))
    fill = F.transform("features", lambda v, i: F.when(v.isNull() | F.isnan(v), F.try_element_at("m", i)).otherwise(v))
    return features.crossJoin(F.broadcast(middle)).withColumn("features", fill).drop("m")


def imputed_modes(features: DataFrame) -> DataFrame:
    """Nulls and NaN to the most frequent value of the feature, the smallest of equals."""
    known = unpivoted(features).where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("feature", "value").agg(F.count("*").alias("n"))
    modes = known.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("feature", "m"))).alias("m"))
    fill = F.transform("features", lambda v, i: F.when(v.isNull() | F.isnan(v), F.try_element_at("m", i)).otherwise(v))
    return features.crossJoin(F.broadcast(modes)).withColumn("features", fill).drop("m")  # one row of as many modes as features


def normalised(features: DataFrame) -> DataFrame:
    """Each row's features over their Euclidean length; rows of zeros stay."""
    size = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, v: s + v * v))
    return features.withColumn("_size", size).withColumn("features", F.transform("features", lambda v: F.when(F.col("_size") > 0, v / F.col("_size")).otherwise(v))).drop("_size")


def standardised(features: DataFrame) -> DataFrame:
    """Features less their mean, over their population deviation; constant ones become 0."""
    each = unpivoted(features).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("dev"))
    one = each.agg(F.array_sort(F.collect_list(F.struct("feature", "mean", "dev"))).alias("z"))
    z = F.transform("features", lambda v, i: F.when(F.get("z", i)["dev"] > 0, (v - F.get("z", i)["mean"]) / F.get("z", i)["dev"]).otherwise(0.0))
    return features.crossJoin(F.broadcast(one)).withColumn("features", z).drop("z")


def class_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("label").agg(F.count("*").alias("n"))


#: Parts of a class, by hash, that are ranked by themselves.
PARTS = 64


def placed(rows: DataFrame, group: str, part: str, *order: str) -> DataFrame:
    """Adds k, the rank from 1 within the group by (part, order): ranks in each part, after as many rows as the parts before it have."""
    counts = rows.groupBy(group, part).agg(F.count("*").alias("n"))  # one row per group and part
    before = F.sum("n").over(Window.partitionBy(group).orderBy(part)) - F.col("n")
    offsets = counts.select(group, part, before.alias("before"))
    rank = F.row_number().over(Window.partitionBy(group, part).orderBy(*order)) + F.col("before")
    return rows.join(offsets, [group, part]).withColumn("k", rank).drop("before")


def _ranked(features: DataFrame, seed: int) -> DataFrame:
    drawn = features.withColumn("u", uniform(seed, F.col("row_id"))).withColumn("part", F.floor(F.col("u") * PARTS))
    return placed(drawn, "label", "part", "u", "row_id").drop("part")


def with_split(features: DataFrame, seed: int = 0, share: float = 0.3) -> DataFrame:
    """Adds is_valid: of each class, the share of rows of least hash, rounded half up."""
    sizes = class_counts(features)
    ranked = _ranked(features, seed).join(sizes, "label")
    return ranked.withColumn("is_valid", F.col("k") <= F.floor(F.col("n") * share + 0.5)).drop("u", "k", "n")


def with_folds(features: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """Adds fold: rows of each class dealt in hash order."""
    return _ranked(features, seed).withColumn("fold", F.pmod(F.col("k") - 1, F.lit(folds)).cast("int")).drop("u", "k")


def shuffled_split(features: DataFrame, seed: int, share: float = 0.1) -> DataFrame:
    """Adds is_valid: of all rows, whatever their class, the share of least hash, rounded up."""
    n = features.agg(F.count("*").alias("n"))
    ranked = _ranked(features.withColumn("_class", F.col("label")).withColumn("label", F.lit(0)), seed)
    return ranked.crossJoin(F.broadcast(n)).withColumn("is_valid", F.col("k") <= F.ceil(F.round(F.col("n") * share, 9))).withColumn("label", F.col("_class")).drop("_class", "u", "k", "n")


def plain_folds(features: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """Adds fold: consecutive rows in hash order, whatever their class; the first n % folds folds have one more."""
    n = features.agg(F.count("*").alias("n"))
    ranked = _ranked(features.withColumn("_class", F.col("label")).withColumn("label", F.lit(0)), seed).crossJoin(F.broadcast(n))
    place, size, more = F.col("k") - 1, F.floor(F.col("n") / folds), F.pmod(F.col("n"), F.lit(folds))
    after = more + F.floor((place - more * (size + 1)) / F.greatest(size, F.lit(1)))
    fold = F.when(place < more * (size + 1), F.floor(place / (size + 1))).otherwise(after)
    return ranked.withColumn("fold", fold.cast("int")).withColumn("label", F.col("_class")).drop("_class", "u", "k", "n")


def fold_count(features: DataFrame, wanted: int) -> int:
    """The wanted folds, at most the size of the smallest class; under 2 there is no cross-validation."""
    return min(wanted, class_counts(features).agg(F.min("n")).first()[0] or 0)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows and all dimensions of the embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns of line items against the return flag."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    values = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return rows.select((F.col("l_orderkey") * LINES + F.col("l_linenumber")).alias("row_id"), values.alias("features"), label.alias("label"))


def planted(spark: SparkSession, n: int = 240, d: int = 12, seed: int = 5) -> DataFrame:
    """Rows whose label follows features 2, 5 and 8; feature d-2 is constant and d-1 repeats feature 0."""
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda f: f).alias("f"))
    value = lambda f: F.when(f == d - 2, F.lit(0.5)).otherwise(uniform(seed, F.col("row_id"), F.when(f == d - 1, F.lit(0)).otherwise(f)))
    rows = rows.withColumn("features", F.transform("f", value)).drop("f")
    signal = F.get("features", F.lit(2)) + F.get("features", F.lit(5)) + F.get("features", F.lit(8))
    return rows.withColumn("label", (signal > 1.5).cast("int"))


def candidate_masks(spark: SparkSession, n: int, d: int) -> DataFrame:
    """cand_id and mask by a fixed rule; candidate 0 selects all, 1 nothing, and the last repeats candidate 2."""
    c = F.when(F.col("id") == n - 1, F.lit(2)).otherwise(F.col("id"))
    bit = lambda f: F.when(c == 0, 1).when(c == 1, 0).otherwise(((f * (c + 3) + c * c + f * f) % 7 < 3).cast("int")).cast("int")
    return spark.range(n).select(F.col("id").cast("int").alias("cand_id"), F.transform(F.sequence(F.lit(0), F.lit(d - 1)), bit).alias("mask"))


#: The same fixtures for SQL oracles.
def embeddings_sql(d: int = 64) -> str:
    return f"raw as (select vec_id as row_id, label, f, embedding[f + 1]::double as value from embeddings, range({d}) t(f))"


SCALED_SQL = "ranges as (select f, min(value) as lo, max(value) as hi from raw group by f), long as (select row_id, label, f, case when hi > lo then (value - lo) / (hi - lo) else 0 end as value from raw join ranges using (f))"
LINEITEMS_SQL = "raw as (select l_orderkey * 4294967296 + l_linenumber as row_id, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as label, unnest([0, 1, 2, 3]) as f, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as value from lineitem)"


def masks_sql(n: int, d: int) -> str:
    c = f"(case when c = {n - 1} then 2 else c end)"
    return f"masks as (select c as cand_id, f, case when {c} = 0 then 1 when {c} = 1 then 0 else ((f * ({c} + 3) + {c} * {c} + f * f) % 7 < 3)::int end as bit from range({n}) a(c), range({d}) b(f))"
