"""Readers and writers of labelled tables, results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, header: bool = True, schema: str | T.StructType | None = None) -> DataFrame:
    """A delimited table; its last column is the label. Without a schema, types are inferred."""
    reader = spark.read.option("header", header)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def labelled(df: DataFrame, label: str | None = None) -> DataFrame:
    """row_id, features, label: by default all columns but the last are features. String labels become ranks."""
    label = label or df.columns[-1]
    features = [c for c in df.columns if c != label and c != "row_id"]
    key = F.col("row_id") if "row_id" in df.columns else F.monotonically_increasing_id()
    rows = df.select(key.alias("row_id"), F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("features"), F.col(f"`{label}`").alias("raw_label"))
    names = df.select(F.col(f"`{label}`").alias("raw_label")).distinct()
    from pyspark.sql import Window

    ranks = names.withColumn("label", F.dense_rank().over(Window.orderBy("raw_label")) - 1)  # one row per class
    return rows.join(F.broadcast(ranks) if ranks.count() <= 100_000 else ranks, "raw_label").select("row_id", "features", "label")


def datasets(spark: SparkSession, folder: str, names: list[str] | None = None, missing: str = "skip") -> list[str]:
    """Names of the delimited files of a folder in order, or those of the list that exist; with ``missing="raise"`` all of the list must."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if files.exists(path):
        found = sorted(s.getPath().getName()[:-4] for s in files.listStatus(path) if s.getPath().getName().endswith(".csv"))
    if missing == "raise" and (absent := [n for n in names or [] if n not in set(found)]):
        raise FileNotFoundError(f"{folder} has no {', '.join(absent)}")
    return [n for n in names if n in set(found)] if names else found


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_report(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "append", sep: str = ",") -> None:
    """Appends rows as delimited files with a header, columns in the given order; arrays are joined with ``;``."""
    order = order or df.columns
    kinds = dict(df.dtypes)
    df.select(*[F.array_join(c, ";").alias(c) if kinds[c].startswith("array") else F.col(c) for c in order]).write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """One folder per report."""
    for name, df in reports.items():
        write_report(df, f"{folder.rstrip('/')}/{name}")
