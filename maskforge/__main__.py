"""Command line of two studies: ``python -m maskforge sensitivity|ablation FOLDER OUTPUT``.

FOLDER holds delimited files with a header, whose last column is the label;
OUTPUT gets one row per run, and OUTPUT_summary one per configuration.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maskforge.operators.report import numbers
from maskforge.plans import protocols
from maskforge.plans.search import Options
from maskforge.session import checkpointed
from maskforge.sources import files

#: Swept options by flag, with the values of a sweep where none are given.
SWEPT = {
    "iterations": ("rounds", "200,400,600", int),
    "interval-num": ("intervals", "10,15,20", int),
    "interval-iterations": ("interval_rounds", "20,30,40", int),
    "ql-lr": ("learning_rate", "0.1,0.2,0.4", float),
    "ql-gamma": ("discount", "0.0,0.3,0.6", float),
    "phi": ("phi", "0.95,0.98,0.99", float),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="maskforge", description="Studies of the interval-guided search")
    kinds = out.add_subparsers(dest="study", required=True)
    sweep, ablate = kinds.add_parser("sensitivity", help="one row per value and run"), kinds.add_parser("ablation", help="one row per mode and run")
    for p in (sweep, ablate):
        p.add_argument("folder")
        p.add_argument("output")
        p.add_argument("--datasets", nargs="*", help="names without .csv; all files by default")
        p.add_argument("--runs", type=int, default=5)
        p.add_argument("--population", type=int, default=20)
        p.add_argument("--knn-k", type=int, default=3)
        p.add_argument("--func", type=int, default=0)
        p.add_argument("--test-size", type=float, default=0.3)
    for flag, (_, values, _) in SWEPT.items():
        sweep.add_argument(f"--{flag}", default=values, help="values with commas between")
    sweep.add_argument("--strategy", choices=["grid", "one-vs-rest"], default="one-vs-rest")
    for flag, value in {"iterations": 500, "interval-num": 20, "interval-iterations": 20, "ql-lr": 0.2, "ql-gamma": 0.5, "phi": 0.99}.items():
        ablate.add_argument(f"--{flag}", type=type(value), default=value)
    ablate.add_argument("--modes", nargs="*", choices=protocols.ABLATION_MODES)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Runs a study; no data set in the folder is an error."""
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("maskforge").getOrCreate()
    checkpointed(spark)
    names = files.datasets(spark, args.folder, args.datasets)
    if not names:
        raise SystemExit(f"no data set in {args.folder}")
    tables = {n: files.labelled(files.read_csv(spark, f"{args.folder.rstrip('/')}/{n}.csv")) for n in names}
    given = {option: getattr(args, flag.replace("-", "_")) for flag, (option, _, _) in SWEPT.items()}
    options = Options(n=args.population, k=args.knn_k, func=args.func)
    if args.study == "sensitivity":
        kinds = {option: kind for option, _, kind in SWEPT.values()}
        grid = {option: [kinds[option](v) for v in numbers(text)] for option, text in given.items()}
        found = protocols.sensitivity(spark, tables, grid, args.runs, options, one_at_a_time=args.strategy == "one-vs-rest", share=args.test_size)
        by = "config"
    else:
        found = protocols.ablation(spark, tables, args.runs, options.replace(**given), args.modes, share=args.test_size)
        found, by = found.withColumn("mode", F.regexp_extract("config", "mode=([a-z_]+)", 1)), "mode"
    files.write_report(found, args.output, mode="overwrite")
    written = files.read_csv(spark, args.output)  # each run once, though its times differ from run to run
    summary = written.groupBy("dataset", by).agg(F.count("*").alias("runs"), *[f(m).alias(f"{m}_{n}") for m in ("nf", "time", "accuracy", "f1_macro") for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    files.write_report(summary, f"{args.output.rstrip('/')}_summary", mode="overwrite")


if __name__ == "__main__":
    main()
