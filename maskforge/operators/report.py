"""Experiment records: parameter grids, summaries, pivots, curves and table comparison.

A run record has dataset, method, run, nf, time, acc, f1, auc, recall,
precision and curve (array). Curves rank runs by their last value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskforge.functions.arrays import resampled
from maskforge.functions.portable import uniform

MEASURES = ["acc", "f1", "auc", "recall", "precision"]


def records(spark: SparkSession, runs: int = 5, length: int = 12) -> DataFrame:
    """A fixture of two data sets and three methods; one group has a single run."""
    u = lambda *p: uniform("run", *p, F.col("dataset"), F.col("method"), F.col("run"))
    rows = spark.range(2 * 3 * runs).select((F.col("id") % 2).cast("int").alias("d"), ((F.col("id") / 2).cast("int") % 3).alias("m"), (F.col("id") / 6).cast("int").alias("run"))
    rows = rows.where("not (d = 1 and m = 2 and run > 0)").select(F.concat(F.lit("data"), F.col("d")).alias("dataset"), F.concat(F.lit("method"), F.col("m")).alias("method"), "run")
    curve = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: F.round(u("c") / (1 + t) + 0.1, 6))
    return rows.select("*", F.floor(1 + 30 * u("nf")).alias("nf"), F.round(u("time"), 6).alias("time"), *[F.round(u(m), 6).alias(m) for m in MEASURES], curve.alias("curve"))


def records_sql(runs: int = 5, length: int = 12) -> str:
    from maskforge.functions.portable import uniform_sql

    u = lambda p: uniform_sql("'run'", p, "dataset", "method", "run")
    measures = ", ".join(f"round({u(repr(m))}, 6) as {m}" for m in MEASURES)
    return f"""ids as (select 'data' || (id % 2) as dataset, 'method' || ((id // 2) % 3) as method, (id // 6)::int as run from range({6 * runs}) t(id)),
runs as (select *, floor(1 + 30 * {u("'nf'")})::bigint as nf, round({u("'time'")}, 6) as time, {measures},
  list_transform(range({length}), lambda t: round({u("'c'")} / (1 + t) + 0.1, 6)) as curve
  from ids where not (dataset = 'data1' and method = 'method2' and run > 0))"""


def final(curve: str = "curve"):
    return F.element_at(curve, -1)


def run_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: nf mean and population deviation, accuracy best, mean, deviation and least, means of the other measures and of the time."""
    r = lambda c, name: F.round(c, 6).alias(name)
    return runs.groupBy(*keys).agg(
        r(F.avg("nf"), "nf_mean"), r(F.stddev_pop("nf"), "nf_std"), r(F.max("acc"), "acc_best"), r(F.avg("acc"), "acc_mean"), r(F.stddev_pop("acc"), "acc_std"), r(F.min("acc"), "acc_min"),
        *[r(F.avg(m), f"{m}_mean") for m in MEASURES[1:]], r(F.avg("time"), "time_mean"),
    )


def sweep_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: mean and sample deviation (null of one run) of every measure, nf and time."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), *[F.round(f(m), 6).alias(f"{m}_{n}") for m in ["nf", "time", *MEASURES] for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def rolled_up(runs: DataFrame) -> DataFrame:
    """Mean accuracy and number of runs per data set and method, with subtotals (nulls)."""
    return runs.rollup("dataset", "method").agg(F.count("*").alias("runs"), F.round(F.avg("acc"), 6).alias("acc_mean"))


def curve_means(runs: DataFrame) -> DataFrame:
    """dataset, method, t, mean and population deviation of the curves at each step."""
    return runs.select("dataset", "method", F.posexplode("curve").alias("t", "v")).groupBy("dataset", "method", "t").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


def best_runs(runs: DataFrame) -> DataFrame:
    """The run of least final fitness of each data set and method, the first of equals."""
    best = runs.groupBy("dataset", "method").agg(F.min_by(F.struct("run", final().alias("final"), "nf", "acc"), F.struct(final(), "run")).alias("b"))
    return best.select("dataset", "method", "b.*")


def pivoted(runs: DataFrame, value: str = "acc", methods: list[str] | None = None) -> DataFrame:
    return runs.groupBy("dataset", "run").pivot("method", methods).agg(F.max(value))


def resampled_curves(runs: DataFrame, n: int) -> DataFrame:
    """dataset, method, run, t, v: curves read at n places, as rows for plotting."""
    return runs.select("dataset", "method", "run", F.posexplode(resampled(F.col("curve"), n)).alias("t", "v"))


def bars(runs: DataFrame, value: str, scale: float = 1.0) -> DataFrame:
    """Plot data of one measure: dataset, method, mean value times the scale."""
    return runs.groupBy("dataset", "method").agg(F.round(scale * F.avg(value), 6).alias("value"))


def generalisation_gap(runs: DataFrame, valid: str = "acc_valid", test: str = "acc_test") -> DataFrame:
    return runs.groupBy("dataset", "method").agg(F.round(F.avg(test) - F.avg(valid), 6).alias("gap"))


def grid(spark: SparkSession, options: dict[str, list[float]], one_at_a_time: bool = False) -> DataFrame:
    """config and a column per option: all combinations, or for each option its values with the others at their first; varying names that option."""
    names = list(options)
    if not one_at_a_time:
        rows = spark.range(1).select()
        for name in names:
            rows = rows.crossJoin(spark.createDataFrame([(float(v),) for v in options[name]], f"{name} double"))  # literals of a configuration
        return rows
    first = {n: float(v[0]) for n, v in options.items()}
    made = [(name, *[float(v) if n == name else first[n] for n in names]) for name in names for v in options[name]]
    return spark.createDataFrame(made, ", ".join(["varying string", *[f"{n} double" for n in names]]))


def tasks(datasets: DataFrame, configs: DataFrame, runs: int) -> DataFrame:
    """One row per data set, configuration and run."""
    return datasets.crossJoin(configs).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def numbers(text: str) -> list[float]:
    """The numbers of a comma-separated option."""
    return [float(x) for x in text.split(",") if x.strip()]


def profile(df: DataFrame) -> DataFrame:
    """column, n, nulls, distinct, and for numbers least, largest, mean and sample deviation."""
    numeric = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}
    aggregates = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        v = x.cast("double") if c in numeric else F.lit(None).cast("double")
        aggregates.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(x.isNull()).alias("nulls"), F.min(v).alias("least"), F.max(v).alias("largest"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std")))
    return df.agg(F.array(*aggregates).alias("p")).select(F.explode("p").alias("x")).select("x.*")


def duplicates(df: DataFrame) -> DataFrame:
    """One row: rows and how many repeat an earlier one."""
    n = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"))


def difference(a: DataFrame, b: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """column, n_different, largest absolute difference of the numeric columns of rows with one key; rows of one side only count as different."""
    names = [c for c, t in a.dtypes if c != key and c in b.columns and t in ("int", "bigint", "double", "float")]
    both = a.select(key, *[F.col(c).cast("double").alias(f"a_{c}") for c in names]).join(b.select(key, *[F.col(c).cast("double").alias(f"b_{c}") for c in names]), key, "full")
    parts = []
    for c in names:
        gap = F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
        parts.append(F.struct(F.lit(c).alias("column"), F.count_if(F.coalesce(gap > tolerance, ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")))).alias("n_different"), F.round(F.max(gap), 6).alias("largest")))
    return both.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("x")).select("x.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def running_best(curve_rows: DataFrame) -> DataFrame:
    """Best value so far along each curve: rows of keys, t and v."""
    order = Window.partitionBy("dataset", "method", "run").orderBy("t")
    return curve_rows.withColumn("best", F.min("v").over(order))
