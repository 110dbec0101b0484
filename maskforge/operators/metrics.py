"""Classification metrics over prediction rows, grouped by any keys.

Rows have a true label ``y`` and a predicted label ``p``. Everything comes from
the counts of (keys, y, p), so a table of any size is reduced once, map-side,
before the few rows of each key's confusion matrix are combined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, keys: list[str]) -> DataFrame:
    return predictions.groupBy(*keys, "y", "p").agg(F.count("*").alias("n"))


def per_class(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, tp, fp, fn of every label that is true or predicted somewhere under the keys."""
    cells = confusion(predictions, keys)
    hit = F.col("y") == F.col("p")
    zero, n = F.lit(0).cast("long"), F.col("n")
    side = lambda label, tp, fp, fn: F.struct(F.col(label).alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    right, true, said = side("y", n, zero, zero), side("y", zero, zero, n), side("p", zero, n, zero)
    # rows of one table: in a union of two the predictions are made twice
    sides = F.when(hit, F.array(right)).when(~hit, F.array(true, said)).otherwise(F.array(true))
    return cells.select(*keys, F.inline(sides)).groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """n, accuracy (= micro recall, precision and F1), macro recall, precision and F1, and hard-label ROC AUC.

    A class without true rows has recall 0, one that is never predicted precision 1.
    AUC takes the true labels as columns, of two only the larger; it is null where
    the true labels are all the same.
    """
    c = per_class(predictions, keys).withColumn("pos", F.col("tp") + F.col("fn"))
    ratio = lambda a, b, otherwise: F.when(b > 0, a / b).otherwise(F.lit(float(otherwise)))
    tp, fp, fn, pos = (F.col(x) for x in ("tp", "fp", "fn", "pos"))
    sums = c.groupBy(*keys).agg(
        F.sum("pos").alias("n"),
        F.sum("tp").alias("tp"),
        F.avg(ratio(tp, pos, 0)).alias("recall_macro"),
        F.avg(ratio(tp, tp + fp, 1)).alias("precision_macro"),
        F.avg(2 * tp / (2 * tp + fp + fn)).alias("f1_macro"),
        F.collect_list(F.when(pos > 0, F.struct("label", "tp", "fp", "pos"))).alias("columns"),
    )
    columns = F.array_sort("columns")
    used = F.when(F.size(columns) == 2, F.slice(columns, 2, 1)).otherwise(columns)
    sums = sums.withColumn("columns", used).withColumn("defined", F.exists("columns", lambda x: x["pos"] < F.col("n")))
    tpr = lambda x: x["tp"] / x["pos"]
    fpr = lambda x: x["fp"] / (F.col("n") - x["pos"])
    add = lambda of: F.aggregate("columns", F.lit(0.0), lambda s, x: s + of(x).cast("double"))
    macro = F.when(F.col("defined"), add(lambda x: (tpr(x) + 1 - fpr(x)) / 2) / F.size("columns"))
    positives, false = add(lambda x: x["pos"]), add(lambda x: x["fp"])
    micro = F.when(F.col("defined"), (add(lambda x: x["tp"]) / positives + 1 - false / (F.col("n") * F.size("columns") - positives)) / 2)
    return sums.select(*keys, "n", (F.col("tp") / F.col("n")).alias("accuracy"), "recall_macro", "precision_macro", "f1_macro", macro.alias("auc_macro"), micro.alias("auc_micro"))


def metrics_sql(keys: list[str], predictions: str = "predictions") -> str:
    """CTEs ending in ``metrics`` over a CTE of predictions."""
    k = ", ".join(keys)
    kc = f"{k}, " if k else ""
    by = f"group by {k}" if k else ""
    on = f"using ({k})" if k else "on true"
    return f"""
cells as (select {kc}y, p, count(*) as n from {predictions} group by {kc}y, p),
sides as (select {kc}y as label, case when y = p then n else 0 end as tp, 0 as fp, case when y = p then 0 else n end as fn from cells
  union all select {kc}p, 0, n, 0 from cells where y <> p),
classes as (select {kc}label, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tp + fn) as pos from sides group by {kc}label),
totals as (select {kc}sum(pos) as n, sum(tp) as tp_all, avg(case when pos > 0 then tp / pos else 0 end) as recall_macro,
  avg(case when tp + fp > 0 then tp / (tp + fp) else 1 end) as precision_macro, avg(2 * tp / (2 * tp + fp + fn)) as f1_macro,
  count(*) filter (pos > 0) as labels, max(label) filter (pos > 0) as top from classes {by}),
roc as (select {kc}avg((tp / pos + 1 - fp / nullif(n - pos, 0)) / 2) as auc_macro,
  (sum(tp) / sum(pos) + 1 - sum(fp) / nullif(count(*) * max(n) - sum(pos), 0)) / 2 as auc_micro
  from classes join totals {on} where pos > 0 and (labels <> 2 or label = top) {by}),
metrics as (select {kc}n::bigint as n, tp_all / n as accuracy, recall_macro, precision_macro, f1_macro, auc_macro, auc_micro from totals join roc {on})"""
