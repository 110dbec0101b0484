"""All queries by name, and the SQL that gives the same rows.

Floats are rounded to six places on both sides, as the order of sums differs.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskforge.functions.arrays import binarised, mask_indices, mask_key, n_selected, opposite, resampled, total, transfer
from maskforge.functions.portable import uniform_sql
from maskforge.operators import cluster, evaluate, metrics, population, report, score
from maskforge.operators import features as feat
from maskforge.plans import protocols
from maskforge.plans.search import Options, SparkScorer, Task, interval, scorer_for, search
from maskforge.streaming import summary, windowed

D, N_MASKS = 64, 12
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def split_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.with_split(feat.scaled(feat.embeddings(spark, sf_dir)), seed=0)


def masks_of(spark: SparkSession) -> DataFrame:
    return feat.candidate_masks(spark, N_MASKS, D)


EMB = f"with {feat.embeddings_sql(D)}, {feat.SCALED_SQL}"
LINE = f"with {feat.LINEITEMS_SQL}, {feat.SCALED_SQL}"
U0 = uniform_sql("0", "row_id")
SPLIT = f"""rows as (select distinct row_id, label from raw), sizes as (select label, count(*) as n from rows group by label),
split as (select row_id, label, row_number() over (partition by label order by {U0}, row_id) <= floor(n * 0.3 + 0.5) as is_valid from rows join sizes using (label)),
valid as (select l.* from long l join split s using (row_id) where is_valid), train as (select l.* from long l join split s using (row_id) where not is_valid)"""
KNN = f"{EMB}, {SPLIT}, {feat.masks_sql(N_MASKS, D)}, {evaluate.KNN_SQL}"
MEASURED = f"{KNN}, {metrics.metrics_sql(['cand_id'])}"


def fitness_sql(error: str) -> str:
    return f"""{MEASURED}, sized as (select cand_id, sum(bit)::int as n_selected from masks group by cand_id),
costs as (select cand_id, n_selected, coalesce({error}, 1.0) as error from sized left join metrics using (cand_id))
select cand_id::bigint as cand_id, n_selected, round(error, 6) as error, round(case when n_selected = 0 then 1.0 else 0.99 * error + 0.01 * n_selected / {D} end, 6) as fitness from costs"""


# tables, splits and profiles


@query("minmax_scale_stats", f"{LINE} select f as feature, round(min(value), 6) as lo, round(max(value), 6) as hi, round(avg(value), 6) as mean from long group by f")
def minmax_scale_stats(spark, sf_dir):
    values = feat.unpivoted(feat.scaled(feat.lineitems(spark, sf_dir)))
    return values.groupBy("feature").agg(r6(F.min("value"), "lo"), r6(F.max("value"), "hi"), r6(F.avg("value"), "mean"))


@query("class_counts", f"{LINE} select label, count(*) // 4 as n from raw group by label")
def class_counts(spark, sf_dir):
    return feat.class_counts(feat.lineitems(spark, sf_dir))


@query("stratified_split", f"{EMB}, {SPLIT} select row_id, label, is_valid from split")
def stratified_split(spark, sf_dir):
    return feat.with_split(feat.embeddings(spark, sf_dir), 0).select("row_id", "label", "is_valid")


@query("fold_assignment", f"{EMB} select row_id, label, ((row_number() over (partition by label order by {uniform_sql('42', 'row_id')}, row_id) - 1) % 5)::int as fold from (select distinct row_id, label from raw)")
def fold_assignment(spark, sf_dir):
    return feat.with_folds(feat.embeddings(spark, sf_dir), 5, 42).select("row_id", "label", "fold")


@query("standardised_stats", f"{LINE}, z as (select f, avg(value) as m, stddev_pop(value) as s from raw group by f) select f as feature, round(sum(abs((value - m) / s)), 3) as total from raw join z using (f) group by f")
def standardised_stats(spark, sf_dir):
    return feat.unpivoted(feat.standardised(feat.lineitems(spark, sf_dir))).groupBy("feature").agg(F.round(F.sum(F.abs("value")), 3).alias("total"))


@query("imputed_medians", "with m as (select median(case when l_quantity > 25 then l_quantity end) as q from lineitem) select round(sum(coalesce(case when l_quantity > 25 then l_quantity end, q)), 3) as total from lineitem, m")
def imputed_medians(spark, sf_dir):
    holes = feat.lineitems(spark, sf_dir).withColumn("features", F.transform("features", lambda v, i: F.when((i > 0) | (v > 25), v)))
    return feat.imputed(holes).agg(F.round(F.sum(F.get("features", F.lit(0))), 3).alias("total"))


@query("null_duplicate_profile", "with n as (select count(*) as n from orders group by o_custkey, o_orderstatus, o_orderpriority) select sum(n)::bigint as rows, sum(n - 1)::bigint as duplicates from n")
def null_duplicate_profile(spark, sf_dir):
    return report.duplicates(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderstatus", "o_orderpriority"))


def _profile_sql() -> str:
    one = lambda c, number: f"select '{c}' as \"column\", count(*) as n, count(*) filter ({c} is null) as nulls, " + (f"min({c})::double as least, max({c})::double as largest, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std" if number else "null::double as least, null::double as largest, null::double as mean, null::double as std") + " from part"
    return " union all ".join([one("p_size", True), one("p_retailprice", True), one("p_brand", False)])


@query("describe_numeric", _profile_sql())
def describe_numeric(spark, sf_dir):
    return report.profile(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", "p_retailprice", "p_brand"))


@query("dataset_diff", """select 'o_totalprice' as "column", count(*) filter (o_orderkey % 7 = 0) as n_different, round(max(case when o_orderkey % 7 = 0 then 0.5 else 0 end), 6) as largest from orders
union all select 'o_custkey', 0, 0.0""")
def dataset_diff(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_custkey")
    b = a.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice")))
    return report.difference(a, b, "o_orderkey")


@query("value_counts", "select o_orderpriority, count(*) as n from orders group by o_orderpriority")
def value_counts(spark, sf_dir):
    return report.value_counts(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority")


# scoring of masks


@query("mask_knn_predictions", f"{KNN} select cand_id::bigint as cand_id, row_id, y::bigint as y, p::bigint as p from predictions")
def mask_knn_predictions(spark, sf_dir):
    return evaluate.predict(split_of(spark, sf_dir), masks_of(spark))


@query("mask_knn_fitness", fitness_sql("1 - accuracy"))
def mask_knn_fitness(spark, sf_dir):
    return rounded(evaluate.fitness(split_of(spark, sf_dir), masks_of(spark)))


@query("fitness_acc_auc", fitness_sql("0.6 * (1 - accuracy) + 0.4 * (1 - coalesce(auc_macro, 0.5))"))
def fitness_acc_auc(spark, sf_dir):
    return rounded(evaluate.fitness(split_of(spark, sf_dir), masks_of(spark), func=1))


@query("fitness_acc_f1", fitness_sql("0.7 * (1 - accuracy) + 0.3 * (1 - f1_macro)"))
def fitness_acc_f1(spark, sf_dir):
    return rounded(evaluate.fitness(split_of(spark, sf_dir), masks_of(spark), func=2))


def _fold_sql(folds: int = 3) -> str:
    fold = f"(row_number() over (partition by label order by {uniform_sql('42', 'row_id')}, row_id) - 1) % {folds}"
    return f"""{EMB}, rows as (select distinct row_id, label from raw), folds as (select row_id, {fold} as fold from rows), {feat.masks_sql(5, D)},
pairs as (select a.fold, m.cand_id, v.row_id, v.label as y, t.row_id as id, t.label, round(sum((v.value - t.value) * (v.value - t.value)), 9) as d
  from masks m join long v on v.f = m.f join folds a on a.row_id = v.row_id join long t on t.f = m.f join folds b on b.row_id = t.row_id where m.bit = 1 and a.fold <> b.fold group by all),
near as (select * from (select *, row_number() over (partition by cand_id, row_id order by d, id) as r from pairs) where r <= 3),
votes as (select fold, cand_id, row_id, y, label, count(*) as n from near group by all),
predictions as (select * from (select *, row_number() over (partition by cand_id, row_id order by n desc, label) as r from votes) where r = 1),
errors as (select cand_id, avg(e) as error from (select cand_id, fold, avg((y <> label)::int) as e from predictions group by cand_id, fold) group by cand_id),
sized as (select cand_id, sum(bit)::int as n_selected from masks group by cand_id)
select cand_id::bigint as cand_id, n_selected, round(coalesce(error, 1.0), 6) as error, round(case when n_selected = 0 then 1.0 else 0.99 * error + 0.01 * n_selected / {D} end, 6) as fitness from sized left join errors using (cand_id)"""


@query("kfold_fitness", _fold_sql())
def kfold_fitness(spark, sf_dir):
    return rounded(evaluate.fold_fitness(feat.scaled(feat.embeddings(spark, sf_dir)), feat.candidate_masks(spark, 5, D), folds=3))


def _resampled_sql(valid: str, numbers: str, pooled: bool, columns: str, seed: str | None = None) -> str:
    """One nearest neighbour over several splits of all rows; ``valid`` says of a row's place (k from 1, of n) whether split s holds it out."""
    mean = "sum(hit) / sum(n)" if pooled else "avg(hit / n)"
    return f"""{EMB}, {feat.masks_sql(3, D)}, sized as (select cand_id, sum(bit)::int as n_selected from masks group by cand_id),
all_rows as (select distinct row_id, label from raw), splits as (select unnest({numbers}) as s),
held as (select s, row_id, label, {valid} as is_valid from (select s, row_id, label, row_number() over (partition by s order by u, row_id) as k, count(*) over (partition by s) as n from (select s, row_id, label, {uniform_sql(seed or ('42' if pooled else 's'), 'row_id')} as u from all_rows, splits))),
pairs as (select m.cand_id, v.row_id as a, t.row_id as b, round(sum((v.value - t.value) * (v.value - t.value)), 9) as d from masks m join long v on v.f = m.f join long t on t.f = m.f where m.bit = 1 group by all),
best as (select p.cand_id, h.s, p.a, h.label as y, min((p.d, p.b)) as near from pairs p join held h on h.row_id = p.a and h.is_valid join held g on g.row_id = p.b and g.s = h.s and not g.is_valid group by all),
part as (select cand_id, s, sum((y = label)::int) as hit, count(*) as n from best join all_rows on row_id = near[2] group by all),
found as (select cand_id, n_selected, coalesce(accuracy, 0) as accuracy from sized left join (select cand_id, {mean} as accuracy from part group by cand_id) using (cand_id))
select cand_id::bigint as cand_id, n_selected, {columns} from found"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What splits are dealt by: no features."""
    return feat.embeddings(spark, sf_dir).select("row_id", "label")


def few_masks(spark: SparkSession) -> DataFrame:
    return feat.candidate_masks(spark, 3, D)


@query("shuffle_split_accuracy", _resampled_sql("k <= ceil(round(n * 0.1, 9))", "range(10)", False, "round(accuracy, 6) as accuracy"))
def shuffle_split_accuracy(spark, sf_dir):
    rows = feat.scaled(feat.embeddings(spark, sf_dir))
    return rounded(evaluate.resampled_accuracy(rows, [feat.shuffled_split(_named(spark, sf_dir), s) for s in range(10)], few_masks(spark))).drop("d")


@query("ninety_ten_accuracy", _resampled_sql("k <= ceil(round(n * 0.1, 9))", "[0]", False, f"round(accuracy, 6) as accuracy, round(case when n_selected > 0 then 0.88 * accuracy - 0.12 * n_selected / {D} else 0 end, 6) as score"))
def ninety_ten_accuracy(spark, sf_dir):
    rows = feat.scaled(feat.embeddings(spark, sf_dir))
    return rounded(evaluate.weighed(evaluate.resampled_accuracy(rows, [feat.shuffled_split(_named(spark, sf_dir), 0)], few_masks(spark)))).drop("d")


PLAIN_FOLD = "case when k - 1 < (n % 10) * (n // 10 + 1) then (k - 1) // (n // 10 + 1) else n % 10 + (k - 1 - (n % 10) * (n // 10 + 1)) // greatest(n // 10, 1) end = s"


@query("plain_fold_cost", _resampled_sql(PLAIN_FOLD, "range(10)", True, f"round(1 - accuracy, 6) as error, round(0.9 * (1 - accuracy) + 0.1 * n_selected / {D}, 6) as fitness"))
def plain_fold_cost(spark, sf_dir):
    """One nearest neighbour over ten unstratified folds, and 0.9 of its error with 0.1 of the share of features."""
    rows = feat.scaled(feat.embeddings(spark, sf_dir))
    found = evaluate.resampled_accuracy(rows, feat.plain_folds(_named(spark, sf_dir), 10), few_masks(spark), pooled=True)
    error = 1 - F.col("accuracy")
    return found.select("cand_id", "n_selected", r6(error, "error"), r6(0.9 * error + 0.1 * F.col("n_selected") / F.col("d"), "fitness"))


@query("weighed_fold_score", _resampled_sql(PLAIN_FOLD, "range(10)", False, f"round(accuracy, 6) as accuracy, round(case when n_selected > 0 then 0.88 * accuracy - 0.12 * n_selected / {D} else 0 end, 6) as score", "42"))
def weighed_fold_score(spark, sf_dir):
    """Mean accuracy over ten unstratified folds, weighed against the share of features."""
    rows = feat.scaled(feat.embeddings(spark, sf_dir))
    return rounded(evaluate.weighed(evaluate.resampled_accuracy(rows, feat.plain_folds(_named(spark, sf_dir), 10), few_masks(spark)))).drop("d")


def _hot_sql() -> str:
    masks = feat.masks_sql(N_MASKS, D)
    inner = masks.removeprefix("masks as (").removesuffix(")")
    costs = fitness_sql("1 - accuracy").replace(masks, f"masks as (select cand_id, f, case when f % 3 = 0 then 0 else bit end as bit from ({inner}))")
    return f"select cand_id, n_selected, round(1 - fitness, 6) as score from ({costs})"


@query("hot_start_score", _hot_sql())
def hot_start_score(spark, sf_dir):
    """1 - fitness of masks over the features that a start left."""
    masks = evaluate.restricted(masks_of(spark), [f for f in range(D) if f % 3])
    return rounded(evaluate.gain(evaluate.fitness(split_of(spark, sf_dir), masks)))


@query("unseen_masks", f"with {feat.masks_sql(N_MASKS, D)}, k as (select cand_id, string_agg(bit, '' order by f) as mask_key from masks group by cand_id) select mask_key, min(cand_id)::int as cand_id from k where mask_key not in (select mask_key from k where cand_id < 4) group by mask_key")
def unseen_masks(spark, sf_dir):
    masks = masks_of(spark)
    seen = masks.where("cand_id < 4").select(mask_key(F.col("mask")).alias("mask_key"))
    return evaluate.unseen(masks, seen).select("mask_key", "cand_id")


# classification metrics


@query("confusion_matrix", f"{KNN} select cand_id::bigint as cand_id, y::bigint as y, p::bigint as p, count(*) as n from predictions group by all")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(mask_knn_predictions(spark, sf_dir), ["cand_id"])


ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in ("accuracy", "recall_macro", "precision_macro", "f1_macro", "auc_macro", "auc_micro"))


@query("metrics_macro_micro", f"{MEASURED} select cand_id::bigint as cand_id, n, {ROUNDED} from metrics")
def metrics_macro_micro(spark, sf_dir):
    return rounded(metrics.metrics(mask_knn_predictions(spark, sf_dir), ["cand_id"]))


PREDICTED = "predictions as (select lang, quality as y, case when n_chars > 1500 then 1 when n_chars > 200 then 0 else 2 end as p from documents join labels using (doc_id) where lang is not null)"


def _text_predictions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("lang is not null")
    return docs.select("lang", F.col("quality").alias("y"), F.when(F.col("n_chars") > 1500, 1).when(F.col("n_chars") > 200, 0).otherwise(2).alias("p"))


@query("roc_auc_hard", f"with {PREDICTED}, {metrics.metrics_sql(['lang'])} select lang, n, {ROUNDED} from metrics")
def roc_auc_hard(spark, sf_dir):
    return rounded(metrics.metrics(_text_predictions(spark, sf_dir), ["lang"]))


@query("balanced_accuracy", f"with {PREDICTED}, {metrics.metrics_sql(['lang'])} select lang, round(recall_macro, 6) as balanced_accuracy from metrics")
def balanced_accuracy(spark, sf_dir):
    return metrics.metrics(_text_predictions(spark, sf_dir), ["lang"]).select("lang", r6("recall_macro", "balanced_accuracy"))


# feature scores

BINS = "bins as (select *, floor((row_number() over (partition by f order by value, row_id) - 1) * 10 / count(*) over (partition by f))::int as bin from raw)"
H = lambda t, keys, c="n": f"select {keys}, log2(sum({c})) - sum({c} * log2({c})) / sum({c}) as h from {t} group by {keys}"
LABEL_INFO = f"""{BINS}, joint as (select f, bin, label, count(*) as n from bins group by all),
hx as ({H('(select f, bin, sum(n) as n from joint group by f, bin)', 'f')}), hy as ({H('(select f, label, sum(n) as n from joint group by f, label)', 'f')}), hxy as ({H('joint', 'f')}),
label_info as (select f, greatest(0, hx.h + hy.h - hxy.h) as mi, case when hx.h + hy.h > 0 then 2 * greatest(0, hx.h + hy.h - hxy.h) / (hx.h + hy.h) else 0 end as su from hx join hy using (f) join hxy using (f))"""
PAIR_INFO = f"""pairs as (select a.f, b.f as g, a.bin as x, b.bin as y, count(*) as n from bins a join bins b on a.row_id = b.row_id and a.f < b.f group by all),
px as ({H('(select f, g, x, sum(n) as n from pairs group by f, g, x)', 'f, g')}), py as ({H('(select f, g, y, sum(n) as n from pairs group by f, g, y)', 'f, g')}), pxy as ({H('pairs', 'f, g')}),
pair_info as (select f, g, greatest(0, px.h + py.h - pxy.h) as mi, case when px.h + py.h > 0 then 2 * greatest(0, px.h + py.h - pxy.h) / (px.h + py.h) else 0 end as su from px join py using (f, g) join pxy using (f, g))"""


@query("equal_freq_bins", f"{LINE}, {BINS} select f as feature, bin, count(*) as n, min(value) as least, max(value) as largest from bins group by f, bin")
def equal_freq_bins(spark, sf_dir):
    b = score.binned(score.long(feat.lineitems(spark, sf_dir)), 10)
    return b.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("largest"))


@query("symmetrical_uncertainty", f"{EMB}, {LABEL_INFO} select f as feature, round(su, 6) as su from label_info")
def symmetrical_uncertainty(spark, sf_dir):
    return rounded(score.label_information(feat.embeddings(spark, sf_dir)).select("feature", "su"))


@query("mutual_info_binned", f"{LINE}, {LABEL_INFO} select f as feature, round(mi, 6) as mi from label_info")
def mutual_info_binned(spark, sf_dir):
    return rounded(score.label_information(feat.lineitems(spark, sf_dir)).select("feature", "mi"))


@query("pairwise_su", f"{EMB}, {BINS}, {PAIR_INFO} select f, g, round(su, 6) as su from pair_info")
def pairwise_su(spark, sf_dir):
    return rounded(score.pair_information(feat.embeddings(spark, sf_dir)).select("f", "g", "su"))


@query("mrmr_scores", f"{EMB}, {LABEL_INFO}, {PAIR_INFO}, red as (select f, avg(mi) as red from (select f, mi from pair_info union all select g, mi from pair_info) group by f) select f as feature, round(mi / (red + 1e-6), 5) as miq, round(mi - red, 6) as mid from label_info join red using (f)")
def mrmr_scores(spark, sf_dir):
    return score.mrmr(feat.embeddings(spark, sf_dir)).select("feature", F.round("miq", 5).alias("miq"), r6("mid"))


@query("cfs_merit", f"{EMB}, {LABEL_INFO}, {PAIR_INFO}, {feat.masks_sql(N_MASKS, D)}, chosen as (select cand_id, f from masks where bit = 1), cf as (select cand_id, count(*) as k, avg(su) as cf from chosen join label_info using (f) group by cand_id), ff as (select a.cand_id, avg(su) as ff from pair_info p join chosen a on a.f = p.f join chosen b on b.f = p.g and a.cand_id = b.cand_id group by a.cand_id) select cand_id, round(k * cf / sqrt(k + k * (k - 1) * coalesce(ff, 0)), 6) as merit from cf left join ff using (cand_id)")
def cfs_merit(spark, sf_dir):
    return rounded(score.cfs_merit(feat.embeddings(spark, sf_dir), masks_of(spark)))


RELIEF = f"""spans as (select f, case when max(value) > min(value) then max(value) - min(value) else 1 end as span from raw group by f),
prior as (select label, count(*) / sum(count(*)) over () as p from (select distinct row_id, label from raw) group by label),
dist as (select a.row_id, a.label as own, b.row_id as id, b.label, round(sum((a.value - b.value) * (a.value - b.value)), 9) as d from raw a join raw b on a.f = b.f and a.row_id <> b.row_id group by all),
near as (select * from (select *, row_number() over (partition by row_id, label order by d, id) as r from dist) where r <= 5),
gaps as (select n.row_id, n.own, n.label, a.f, avg(abs(a.value - b.value) / span) as gap from near n join raw a on a.row_id = n.row_id join raw b on b.row_id = n.id and b.f = a.f join spans s on s.f = a.f group by all),
relief as (select f, sum(case when own = g.label then -gap else p.p / (1 - q.p) * gap end) / (select count(distinct row_id) from raw) as weight from gaps g join prior p on p.label = g.label join prior q on q.label = g.own group by f)"""


@query("relieff_full", f"with {feat.embeddings_sql(D)}, {RELIEF} select f as feature, round(weight, 6) as weight from relief")
def relieff_full(spark, sf_dir):
    return rounded(score.relieff(feat.embeddings(spark, sf_dir)))


@query("asm_selection", f"with {feat.embeddings_sql(D)}, {RELIEF}, {LABEL_INFO}, u as (select f, (su - min(su) over ()) / (max(su) over () - min(su) over ()) as a, (weight - min(weight) over ()) / (max(weight) over () - min(weight) over ()) as b from label_info join relief using (f)) select f as feature, round(sqrt(a * a + b * b), 5) as dist, (sqrt(a * a + b * b) >= 0.5)::int as selected from u")
def asm_selection(spark, sf_dir):
    return score.adaptive(feat.embeddings(spark, sf_dir)).select("feature", F.round("dist", 5).alias("dist"), "selected")


@query("fisher_scores", f"{LINE}, g as (select f, avg(value) filter (label = 1) as p, avg(value) filter (label <> 1) as q, var_samp(value) filter (label = 1) + var_samp(value) filter (label <> 1) as v from raw group by f) select f as feature, round((p - q) * (p - q) / case when v = 0 then 10000 else v end, 6) as score from g")
def fisher_scores(spark, sf_dir):
    return rounded(score.fisher(feat.lineitems(spark, sf_dir)))


CORR = "corr as (select a.f, b.f as g, corr(a.value, b.value) as r from raw a join raw b on a.row_id = b.row_id and a.f < b.f group by all)"
MEAN_ABS = "mean_abs as (select f, avg(abs(r)) as m from (select f, r from corr union all select g, r from corr) group by f)"


@query("pearson_mean_abs", f"{EMB}, {CORR}, {MEAN_ABS} select f as feature, round(m, 6) as mean_abs from mean_abs")
def pearson_mean_abs(spark, sf_dir):
    return rounded(score.mean_abs_correlation(feat.embeddings(spark, sf_dir)).select("feature", "mean_abs"))


@query("similar_dissimilar_split", f"{EMB}, {CORR}, {MEAN_ABS} select f as feature, (row_number() over (order by round(m, 9), f) > {D // 2})::int as similar from mean_abs")
def similar_dissimilar_split(spark, sf_dir):
    return score.mean_abs_correlation(feat.embeddings(spark, sf_dir)).select("feature", "similar")


@query("spearman_matrix", f"{EMB}, ranked as (select row_id, f, rank() over (partition by f order by value) + (count(*) over (partition by f, value) - 1) / 2 as value from raw) select a.f, b.f as g, round(corr(a.value, b.value), 6) as r from ranked a join ranked b on a.row_id = b.row_id and a.f < b.f group by all")
def spearman_matrix(spark, sf_dir):
    return rounded(score.correlations(feat.embeddings(spark, sf_dir), ranks=True))


@query("infinite_ranking")
def infinite_ranking(spark, sf_dir):
    return spark.createDataFrame([(f, round(e, 6)) for f, e in score.infinite_scores(feat.embeddings(spark, sf_dir))], "feature int, energy double")


@query("graph_score")
def graph_score(spark, sf_dir):
    masks = sorted((r["cand_id"], r["mask"]) for r in masks_of(spark).collect())
    return rounded(spark.createDataFrame(score.graph_scores(feat.embeddings(spark, sf_dir), masks), "cand_id int, score double"))


@query("prefix_sweep_best", f"{EMB}, {SPLIT}, {LABEL_INFO.replace('joint', 'lj')}, ranked as (select f, row_number() over (order by round(su, 9) desc, f) as k from label_info), masks as (select n as cand_id, f, (k <= n)::int as bit from ranked, range(1, {D + 1}) t(n)), {evaluate.KNN_SQL.replace('pairs', 'kp')}, {metrics.metrics_sql(['cand_id'])}, best as (select cand_id, round(0.99 * (1 - accuracy) + 0.01 * cand_id / {D}, 6) as fitness from metrics) select cand_id::int as n_selected, fitness from best order by fitness, cand_id limit 1")
def prefix_sweep_best(spark, sf_dir):
    with ThreadPoolExecutor() as pool:  # the ranking is made beside the split table
        table = pool.submit(evaluate.Prepared, split_of(spark, sf_dir))
        order = score.label_information(feat.embeddings(spark, sf_dir), gather=True).orderBy(F.desc(F.round("su", 9)), "feature").select("feature").collect()  # one row per feature
    masks = spark.createDataFrame(evaluate.prefix_candidates([r[0] for r in order], D), "cand_id int, mask array<int>")
    return evaluate.fitness(table.result(), masks).select("n_selected", r6("fitness")).orderBy("fitness", "n_selected").limit(1)


# graphs and clusters

SOME = f"with {feat.embeddings_sql(D)}, {feat.SCALED_SQL}"
EPS = 1.6
DIST = "dist as (select a.row_id as a, b.row_id as b, round(sqrt(sum((a.value - b.value) * (a.value - b.value))), 9) as d from long a join long b on a.f = b.f and a.row_id <> b.row_id group by all)"


def _points(spark, sf_dir):
    return feat.scaled(feat.embeddings(spark, sf_dir))


@query("knn_affinity_graph", f"{SOME}, {DIST}, near as (select a, b from (select *, row_number() over (partition by a order by d, b) as r from dist) where r <= 5) select distinct a as src, b as dst, 1.0::double as w from (select a, b from near union all select b, a from near)")
def knn_affinity_graph(spark, sf_dir):
    return cluster.neighbour_graph(_points(spark, sf_dir))


@query("eps_graph_degree", f"{SOME}, {DIST}, n as (select a as row_id, count(*) as n from dist where d <= {EPS} group by a), ids as (select distinct row_id from long) select row_id, coalesce(n, 0) + 1 as degree, (coalesce(n, 0) + 1 >= 5)::int as core from ids left join n using (row_id)")
def eps_graph_degree(spark, sf_dir):
    return cluster.density(_points(spark, sf_dir), EPS, 5)


@query("dbscan_clusters", f"""{SOME}, {DIST}, n as (select a as row_id from dist where d <= {EPS} group by a having count(*) >= 4), edge as (select a, b from dist where d <= {EPS} and a in (from n) and b in (from n)),
reach as (with recursive r(a, b) as (select row_id, row_id from n union select r.a, e.b from r join edge e on r.b = e.a) select a as row_id, min(b) as cluster from r group by a),
ids as (select distinct row_id from long), border as (select a as row_id, arg_min(cluster, (d, b)) as border from dist join reach on reach.row_id = b where d <= {EPS} group by a)
select row_id, coalesce(cluster, border, -1) as cluster from ids left join reach using (row_id) left join border using (row_id)""")
def dbscan_clusters(spark, sf_dir):
    from maskforge.session import checkpointed

    checkpointed(spark)
    return cluster.dbscan(_points(spark, sf_dir), EPS, 5)


def _kmeans_sql(k: int, rounds: int, replicates: int) -> str:
    """Rounds of all replicates, one after another."""
    parts = [f"""st as (select r, row_id, row_number() over (partition by r order by row_id) - 1 as k from (select r, row_id, row_number() over (partition by r order by {uniform_sql("'start0'", 'r', 'row_id')}, row_id) as p from (select distinct row_id from long), range({replicates}) t(r)) where p <= {k})""", "c0 as (select r, k, f, value as c from st join long using (row_id))"]
    for i in range(rounds + 1):
        parts.append(f"a{i} as (select r, row_id, min((d, k)) as m from (select r, row_id, k, round(sqrt(sum((value - c) * (value - c))), 9) as d from long join c{i} using (f) group by all) group by all)")
        if i < rounds:
            parts.append(f"c{i + 1} as (select r, m[2] as k, f, avg(value) as c from a{i} join long using (row_id) group by all)")
    best = f"(select r from (select r, sum(m[1]) as total from a{rounds} group by r) order by round(total, 9), r limit 1)"
    return f"{SOME}, {', '.join(parts)} select row_id, m[2]::int as cluster from a{rounds} where r = {best}"


@query("kmeans_clusters", _kmeans_sql(4, 3, 2))
def kmeans_clusters(spark, sf_dir):
    return cluster.replicated_kmeans(_points(spark, sf_dir), 4, rounds=3, replicates=2)


@query("smoothed_information", """with j as (select o_custkey % 7 as c, o_orderkey % 5 as x, count(*) as n from orders group by all), joint as (select c, x, sum(n) as n from (from j union all select distinct c, c, 1 from j) group by all), t as (select sum(n) as s from joint),
h as (select (select -sum(n / s * log2(n / s)) from joint, t) as hxy, (select -sum(p * log2(p)) from (select sum(n) / any_value(s) as p from joint, t group by c)) as hx, (select -sum(p * log2(p)) from (select sum(n) / any_value(s) as p from joint, t group by x)) as hy)
select round((hx + hy - hxy) / greatest(hx, hy), 6) as information from h""")
def smoothed_information(spark, sf_dir):
    pairs = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 7).alias("cluster"), (F.col("o_orderkey") % 5).alias("label"))
    return rounded(cluster.smoothed_information(pairs))


@query("silhouette_by_label", f"{SOME}, {DIST}, named as (select distinct row_id, label from long), m as (select a, x.label as own, y.label, avg(d) as m from dist join named x on x.row_id = a join named y on y.row_id = b group by all), e as (select a, max(m) filter (own = label) as i, min(m) filter (own <> label) as o from m group by a) select round(avg(case when i is null or o is null then 0 else (o - i) / greatest(i, o) end), 6) as silhouette from e")
def silhouette_by_label(spark, sf_dir):
    return rounded(cluster.silhouette(_points(spark, sf_dir)))


@query("calinski_harabasz", f"{EMB}, m as (select f, avg(value) as m from raw group by f), c as (select f, label, count(*) as n, avg(value) as c from raw group by f, label), b as (select sum(n * (c - m) * (c - m)) as b, count(distinct label) as k from c join m using (f)), w as (select sum((value - c) * (value - c)) as w, count(distinct row_id) as n from raw join c using (f, label)) select round(b * (n - k) / (w * (k - 1)), 6) as ch from b, w")
def calinski_harabasz(spark, sf_dir):
    return rounded(cluster.calinski_harabasz(feat.embeddings(spark, sf_dir)))


@query("davies_bouldin", f"{EMB}, c as (select f, label, avg(value) as c from raw group by f, label), s as (select label, avg(d) as s from (select row_id, label, sqrt(sum((value - c) * (value - c))) as d from raw join c using (f, label) group by row_id, label) group by label), m as (select a.label as x, b.label as y, sqrt(sum((a.c - b.c) * (a.c - b.c))) as d from c a join c b on a.f = b.f and a.label <> b.label group by all), w as (select x, max((p.s + q.s) / d) as r from m join s p on p.label = x join s q on q.label = y group by x) select round(avg(r), 6) as db from w")
def davies_bouldin(spark, sf_dir):
    return rounded(cluster.davies_bouldin(feat.embeddings(spark, sf_dir)))


CLUSTERED = "pairs as (select o_orderpriority as label, o_custkey % 7 as cluster from orders)"


def _clustered(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("label"), (F.col("o_custkey") % 7).alias("cluster"))


@query("majority_label_map", f"with {CLUSTERED}, n as (select cluster, label, count(*) as n from pairs group by all) select cluster, label from (select *, row_number() over (partition by cluster order by n desc, label) as r from n) where r = 1")
def majority_label_map(spark, sf_dir):
    return cluster.majority_labels(_clustered(spark, sf_dir))


@query("hungarian_map", f"""with recursive {CLUSTERED}, n as (select cluster, label, count(*) as n from pairs group by all), labels as (select label, row_number() over (order by label) as k from (select distinct label from pairs)),
ways(k, used, total) as (select 0, []::bigint[], 0::bigint union all select w.k + 1, list_append(w.used, n.cluster), w.total + n.n from ways w join labels l on l.k = w.k + 1 join n on n.label = l.label where not list_contains(w.used, n.cluster))
select max(total)::bigint as agreed from ways where k = (select max(k) from labels)""")
def hungarian_map(spark, sf_dir):
    pairs = _clustered(spark, sf_dir)
    chosen = spark.createDataFrame([(int(c), x) for c, x in cluster.assignment(pairs)], "cluster long, label string")
    return pairs.join(F.broadcast(chosen), ["cluster", "label"]).agg(F.count("*").alias("agreed"))


# populations

MASKS = f"with {feat.masks_sql(N_MASKS, D)}, keyed as (select cand_id, string_agg(bit, '' order by f) as mask_key, sum(bit) as n from masks group by cand_id)"
OBJECTIVES = f"{MASKS}, objectives as (select cand_id::int as cand_id, round({uniform_sql(repr('err'), 'mask_key')}, 1) as err, n / {D} as ratio from keyed)"


def objectives_of(spark: SparkSession) -> DataFrame:
    from maskforge.functions.portable import uniform

    key = mask_key(F.col("mask"))
    return masks_of(spark).select("cand_id", F.round(uniform("err", key), 1).alias("err"), (n_selected(F.col("mask")) / D).alias("ratio"))


@query("mask_dedupe", f"{MASKS} select mask_key, min(cand_id)::int as cand_id from keyed group by mask_key")
def mask_dedupe(spark, sf_dir):
    return population.deduplicated(masks_of(spark)).select("mask_key", "cand_id")


@query("mask_hamming_pairs", f"{MASKS} select a.cand_id::int as a, b.cand_id::int as b, sum((a.bit <> b.bit)::int)::int as distance from masks a join masks b on a.f = b.f and a.cand_id < b.cand_id group by all")
def mask_hamming_pairs(spark, sf_dir):
    return population.hamming_pairs(masks_of(spark))


BETTER = "(o.err <= x.err and o.ratio <= x.ratio and (o.err < x.err or o.ratio < x.ratio))"


@query("pareto_first_front", f"{OBJECTIVES} select cand_id, err, ratio from objectives x where not exists (select 1 from objectives o where {BETTER})")
def pareto_first_front(spark, sf_dir):
    return population.first_front(objectives_of(spark))


@query("pareto_fronts", f"{OBJECTIVES}, chain as (with recursive c(cand_id, depth) as (select cand_id, 1 from objectives union select x.cand_id, c.depth + 1 from c join objectives o using (cand_id) join objectives x on {BETTER}) select * from c) select cand_id, max(depth)::int as front from chain group by cand_id")
def pareto_fronts(spark, sf_dir):
    return population.fronts(objectives_of(spark)).select("cand_id", "front")


@query("crowding_distance", f"{OBJECTIVES}, g as (select cand_id, " + ", ".join(f"case when max({c}) over () = min({c}) over () then 0 when lag({c}) over (order by {c}, cand_id) is null then 1 when lead({c}) over (order by {c}, cand_id) is null then 0 else (lead({c}) over (order by {c}, cand_id) - lag({c}) over (order by {c}, cand_id)) / (2 * (max({c}) over () - min({c}) over ())) end as g_{c}" for c in ("err", "ratio")) + " from objectives) select cand_id, round(g_err + g_ratio, 6) as crowding from g")
def crowding_distance(spark, sf_dir):
    return rounded(population.objective_crowding(objectives_of(spark)))


@query("solution_crowding", f"{MASKS}, h as (select a.cand_id, b.cand_id as other, sum((a.bit <> b.bit)::int) as d from masks a join masks b on a.f = b.f and a.cand_id <> b.cand_id group by all), m as (select cand_id, avg(d) as m from (select *, row_number() over (partition by cand_id order by d, other) as r from h) where r <= 8 group by cand_id) select cand_id::int as cand_id, round(m / max(m) over (), 6) as crowding from m")
def solution_crowding(spark, sf_dir):
    return rounded(population.solution_crowding(masks_of(spark)))


@query("multimodal_groups", f"{OBJECTIVES} select cand_id, err from (select cand_id, err, min(err) over (partition by ratio) as best from objectives) where err <= best + 0.1")
def multimodal_groups(spark, sf_dir):
    scored = objectives_of(spark).withColumn("n_selected", F.round(F.col("ratio") * D).cast("int"))
    return population.multimodal_groups(scored, 0.1).select("cand_id", "err")


@query("feature_usage_freq", f"{MASKS} select f::int as feature, sum(bit)::bigint as uses, round(avg(bit), 6) as share from masks group by f")
def feature_usage_freq(spark, sf_dir):
    return rounded(population.usage(masks_of(spark)))


@query("top_decile_features", f"{MASKS}, u as (select f::int as feature, sum(bit)::bigint as uses from masks group by f) select feature, uses from u order by uses desc, feature limit {round(0.1 * D) + 1}")
def top_decile_features(spark, sf_dir):
    return population.top_features(masks_of(spark)).select("feature", "uses")


@query("nmi_mask_pairs", f"{MASKS}, joint as (select a.cand_id as a, b.cand_id as b, a.bit as p, b.bit as q, count(*) as n from masks a join masks b on a.f = b.f and a.cand_id < b.cand_id group by all), hx as ({H('(select a, b, p, sum(n) as n from joint group by a, b, p)', 'a, b')}), hy as ({H('(select a, b, q, sum(n) as n from joint group by a, b, q)', 'a, b')}), hxy as ({H('joint', 'a, b')}) select a::int as a, b::int as b, round(case when hx.h > 0 and hy.h > 0 then greatest(0, hx.h + hy.h - hxy.h) / sqrt(hx.h * hy.h) else 0 end, 6) as nmi from hx join hy using (a, b) join hxy using (a, b)")
def nmi_mask_pairs(spark, sf_dir):
    return rounded(score.nmi_binary(masks_of(spark)))


@query("single_bit_flips", f"{MASKS} select cand_id::int as cand_id, x as flipped, sum(case when f = x then 1 - bit else bit end)::int as n_selected from masks, range({D}) t(x) group by all")
def single_bit_flips(spark, sf_dir):
    return population.single_flips(masks_of(spark)).select("cand_id", F.col("flipped").cast("long").alias("flipped"), n_selected(F.col("mask")).alias("n_selected"))


# positions and moves

POS = f"positions as (select c as cand_id, f, {uniform_sql("'pos'", 'c', 'f')} as x, {uniform_sql("'best'", 'c', 'f')} as best, {uniform_sql("'vel'", 'c', 'f')} - 0.5 as v from range({N_MASKS}) a(c), range({D}) b(f))"
MOVED = "select cand_id::int as cand_id, round(sum(x), 6) as total, sum((x > 0.5)::int)::int as n_selected from moved group by cand_id"


def positions_of(spark: SparkSession) -> DataFrame:
    from maskforge.functions.portable import uniform

    each = lambda name: F.transform(F.sequence(F.lit(0), F.lit(D - 1)), lambda f: uniform(name, F.col("cand_id"), f))
    rows = spark.range(N_MASKS).select(F.col("id").cast("int").alias("cand_id"))
    return rows.select("cand_id", each("pos").alias("x"), each("best").alias("best"), F.transform(each("vel"), lambda v: v - 0.5).alias("v"))


def _moved(rows: DataFrame) -> DataFrame:
    return rows.select("cand_id", F.round(total(F.col("x")), 6).alias("total"), n_selected(binarised(F.col("x"))).alias("n_selected"))


@query("binarised_positions", f"with {POS} select cand_id::int as cand_id, string_agg((x > 0.6)::int::varchar, '' order by f) as bits, sum((x >= (f % 7 + 1) / 10)::int)::int as above_own from positions group by cand_id")
def binarised_positions(spark, sf_dir):
    own = F.transform(F.sequence(F.lit(0), F.lit(D - 1)), lambda f: (f % 7 + 1) / 10)
    return positions_of(spark).select("cand_id", mask_key(binarised(F.col("x"), 0.6)).alias("bits"), n_selected(binarised(F.col("x"), own, strict=False)).alias("above_own"))


@query("mask_feature_lists", f"{MASKS} select cand_id::int as cand_id, coalesce(string_agg(f::varchar, ',' order by f) filter (bit = 1), '') as features from masks group by cand_id")
def mask_feature_lists(spark, sf_dir):
    return masks_of(spark).select("cand_id", F.array_join(mask_indices(F.col("mask")).cast("array<string>"), ",").alias("features"))


@query("transfer_probabilities", f"with {POS} select cand_id::int as cand_id, round(sum(1 / (1 + exp(-v))), 6) as sigmoid, round(sum(1 / (1 + exp(-2 * v))), 6) as sigmoid2, round(sum(abs(tanh(v))), 6) as tanh from positions group by cand_id")
def transfer_probabilities(spark, sf_dir):
    chance = lambda kind: F.round(total(F.transform("v", lambda v: transfer(v, kind))), 6).alias(kind)
    return positions_of(spark).select("cand_id", chance("sigmoid"), chance("sigmoid2"), chance("tanh"))


@query("opposite_positions", f"with {POS}, moved as (select cand_id, f, 1 - x as x from positions) {MOVED}")
def opposite_positions(spark, sf_dir):
    return _moved(positions_of(spark).withColumn("x", opposite(F.col("x"))))


@query("swarm_move", f"""with {POS}, led as (select p.*, l.best as lead, {uniform_sql("'r1'", 'p.cand_id')} as r1, {uniform_sql("'r2'", 'p.cand_id')} as r2 from positions p join positions l on l.f = p.f and l.cand_id = 0),
flown as (select cand_id, f, x, greatest(-0.5, least(0.5, 0.9 * v + 2 * r1 * (best - x) + 2 * r2 * (lead - x))) as v from led), moved as (select cand_id, f, greatest(0, least(1, x + v)) as x from flown) {MOVED}""")
def swarm_move(spark, sf_dir):
    rows = positions_of(spark)
    lead = rows.where("cand_id = 0").select(F.col("best").alias("lead"))
    return _moved(population.swarm_step(rows.crossJoin(F.broadcast(lead))))  # one leader


@query("difference_move", f"""with {POS}, moved as (select p.cand_id, p.f, case when {uniform_sql("'cross'", 'p.cand_id', 'p.f')} < 0.9 then greatest(0, least(1, a.x + 0.5 * (b.x - c.x))) else p.x end as x
from positions p join positions a on a.f = p.f and a.cand_id = (p.cand_id + 1) % {N_MASKS} join positions b on b.f = p.f and b.cand_id = (p.cand_id + 2) % {N_MASKS} join positions c on c.f = p.f and c.cand_id = (p.cand_id + 3) % {N_MASKS}) {MOVED}""")
def difference_move(spark, sf_dir):
    return _moved(population.difference_step(positions_of(spark).select("cand_id", "x"), N_MASKS))


@query("wolf_move", f"""with {POS}, moved as (select p.cand_id, p.f, greatest(0, least(1, p.x + (1.8 * {uniform_sql("'wolf1'", 'p.cand_id')} - 0.9) * (a.x - p.x) + 2 * {uniform_sql("'wolf2'", 'p.cand_id')} * (b.x - p.x) + 2 * {uniform_sql("'wolf3'", 'p.cand_id')} * (c.x - p.x))) as x
from positions p join positions a on a.f = p.f and a.cand_id = 0 join positions b on b.f = p.f and b.cand_id = 1 join positions c on c.f = p.f and c.cand_id = 2) {MOVED}""")
def wolf_move(spark, sf_dir):
    rows = positions_of(spark).select("cand_id", "x")
    leaders = rows.where("cand_id < 3").agg(*[F.max(F.when(F.col("cand_id") == k, F.col("x"))).alias(f"p{k + 1}") for k in range(3)])
    return _moved(population.wolf_step(rows, leaders))


@query("crossover_move", f"""{MASKS}, child as (select a.cand_id, a.f, case when a.f < 1 + floor({uniform_sql("'cut'", 'a.cand_id')} * {D - 1}) then a.bit else b.bit end as bit from masks a join masks b on a.f = b.f and b.cand_id = (a.cand_id + 1) % {N_MASKS}),
turned as (select cand_id, f, case when {uniform_sql("'turn'", 'cand_id', 'f')} < 0.01 then 1 - bit else bit end as bit from child) select cand_id::int as cand_id, string_agg(bit::varchar, '' order by f) as mask_key from turned group by cand_id""")
def crossover_move(spark, sf_dir):
    return population.crossover_step(masks_of(spark), N_MASKS).select("cand_id", mask_key(F.col("mask")).alias("mask_key"))


HAMMING = "h as (select a.cand_id, b.cand_id as other, sum((a.bit <> b.bit)::int) as d from masks a join masks b on a.f = b.f group by all)"


@query("nearest_old_candidates", f"{MASKS}, {HAMMING} select cand_id::int as cand_id, other::int as old_id, d::int as distance from (select *, row_number() over (partition by cand_id order by d, other) as r from h where cand_id >= 6 and other < 6) where r = 1")
def nearest_old_candidates(spark, sf_dir):
    masks = masks_of(spark)
    return population.nearest_old(masks.where("cand_id >= 6"), masks.where("cand_id < 6"))


@query("least_similar_mates", f"{MASKS}, joint as (select a.cand_id as a, b.cand_id as b, a.bit as p, b.bit as q, count(*) as n from masks a join masks b on a.f = b.f and a.cand_id < b.cand_id group by all), hx as ({H('(select a, b, p, sum(n) as n from joint group by a, b, p)', 'a, b')}), hy as ({H('(select a, b, q, sum(n) as n from joint group by a, b, q)', 'a, b')}), hxy as ({H('joint', 'a, b')}), nmi as (select a, b, round(case when hx.h > 0 and hy.h > 0 then greatest(0, hx.h + hy.h - hxy.h) / sqrt(hx.h * hy.h) else 0 end, 6) as nmi from hx join hy using (a, b) join hxy using (a, b)), both_ways as (select a, b, nmi from nmi union all select b, a, nmi from nmi) select a::int as cand_id, b::int as mate, nmi from (select *, row_number() over (partition by a order by nmi, b) as r from both_ways where a between 2 and 5 and b between 6 and 10) where r = 1")
def least_similar_mates(spark, sf_dir):
    masks = masks_of(spark)
    return population.least_similar_mates(masks.where("cand_id between 2 and 5"), masks.where("cand_id between 6 and 10"), rounded(score.nmi_binary(masks)))


@query("swapped_duplicates", f"""{MASKS}, nth as (select cand_id, row_number() over (partition by mask_key order by cand_id) as nth from keyed), lists as (select cand_id, list(f order by f) filter (bit = 1) as ones, list(f order by f) filter (bit = 0) as zeros from masks group by cand_id),
drawn as (select cand_id, nth, ones[1 + floor({uniform_sql("'swap'", "'out'", 'cand_id')} * len(ones))::int] as o, zeros[1 + floor({uniform_sql("'swap'", "'in'", 'cand_id')} * len(zeros))::int] as i from nth join lists using (cand_id))
select cand_id::int as cand_id, string_agg((case when nth > 1 and o is not null and i is not null and f in (o, i) then 1 - bit else bit end)::varchar, '' order by f) as mask_key from masks join drawn using (cand_id) group by cand_id""")
def swapped_duplicates(spark, sf_dir):
    return population.swapped_duplicates(masks_of(spark)).select("cand_id", mask_key(F.col("mask")).alias("mask_key"))


@query("repaired_sizes", f"{MASKS}, u as (select f, sum(bit) as uses from masks group by f), r as (select cand_id, f, (row_number() over (partition by cand_id order by bit desc, uses desc, f) <= 10)::int as bit from masks join u using (f)) select cand_id::int as cand_id, string_agg(bit::varchar, '' order by f) as mask_key from r group by cand_id")
def repaired_sizes(spark, sf_dir):
    masks = masks_of(spark)
    return population.repaired(masks, population.usage(masks).select("feature", "uses"), 10).select("cand_id", mask_key(F.col("mask")).alias("mask_key"))


@query("distance_to_ideal", f"{OBJECTIVES}, s as (select cand_id, (err - min(err) over ()) / (max(err) over () - min(err) over ()) as a, (ratio - min(ratio) over ()) / (max(ratio) over () - min(ratio) over ()) as b from objectives) select cand_id, round(sqrt(a * a + b * b), 6) as distance from s")
def distance_to_ideal(spark, sf_dir):
    return rounded(population.distance_to_ideal(objectives_of(spark)))


@query("shared_crowding", f"{OBJECTIVES} select cand_id, max(ratio) over (partition by err) as crowding from objectives")
def shared_crowding(spark, sf_dir):
    return population.shared_crowding(objectives_of(spark).withColumnRenamed("ratio", "crowding"), "err").select("cand_id", "crowding")


@query("combined_crowding", f"{OBJECTIVES} select cand_id, case when err > avg(err) over () or ratio > avg(ratio) over () then greatest(err, ratio) else least(err, ratio) end as crowding from objectives")
def combined_crowding(spark, sf_dir):
    return population.combined_crowding(objectives_of(spark).select("cand_id", F.col("err").alias("a"), F.col("ratio").alias("b")))


@query("elitist_survivors", f"{OBJECTIVES} select cand_id, err as fitness from objectives order by err, cand_id limit 5")
def elitist_survivors(spark, sf_dir):
    rows = objectives_of(spark).select("cand_id", F.col("err").alias("fitness"))
    return population.survivors(rows.where("cand_id < 6"), rows.where("cand_id >= 6"), 5)


@query("seeded_sample", f"{OBJECTIVES} select cand_id from objectives order by {uniform_sql('3', 'cand_id')}, cand_id limit 4")
def seeded_sample(spark, sf_dir):
    return population.sampled(objectives_of(spark).select("cand_id"), 4, 3)


@query("roulette_picks", f"{OBJECTIVES}, w as (select cand_id, sum(err) over (order by cand_id) / sum(err) over () as upto, (sum(err) over (order by cand_id) - err) / sum(err) over () as below from objectives), d as (select i::int as draw, {uniform_sql('5', 'i')} as u from range(20) t(i)) select draw, min(cand_id)::int as cand_id from d join w on u < upto group by draw")
def roulette_picks(spark, sf_dir):
    return population.weighted_pick(objectives_of(spark), 5, 20, "err")


@query("rating_entropy", f"{OBJECTIVES}, g as (select least(4, floor(log2(1 + 31 * (err - min(err) over ()) / (max(err) over () - min(err) over ())))) as grade from objectives), p as (select count(*) / sum(count(*)) over () as p from g group by grade) select round(sum(-p * ln(p)) / ln(5), 6) as entropy from p")
def rating_entropy(spark, sf_dir):
    return rounded(population.rating_entropy(objectives_of(spark).withColumnRenamed("err", "fitness")))


@query("kth_smallest_cost", f"{OBJECTIVES} select err as value from objectives order by err, cand_id limit 1 offset 3")
def kth_smallest_cost(spark, sf_dir):
    return population.kth_smallest(objectives_of(spark), 3)


BOUNDS = [0, 10, 20, 30, D]


@query("best_of_intervals", f"{OBJECTIVES}, s as (select o.*, k.n, case when k.n <= 10 then 0 when k.n <= 20 then 1 when k.n <= 30 then 2 else 3 end as interval_no from objectives o join keyed k using (cand_id) where k.n > 0) select interval_no as interval, err as best, cand_id from (select *, row_number() over (partition by interval_no order by err, cand_id) as r from s) where r = 1")
def best_of_intervals(spark, sf_dir):
    scored = objectives_of(spark).withColumn("n_selected", F.round(F.col("ratio") * D).cast("int"))
    return population.best_of_intervals(scored, BOUNDS)


@query("division_means", f"{OBJECTIVES} select (cand_id * 4 // {N_MASKS})::int as division, round(avg(err), 6) as mean from objectives group by 1")
def division_means(spark, sf_dir):
    return rounded(population.division_means(objectives_of(spark), 4, N_MASKS))


@query("mask_relation_fitness", fitness_sql("1 - accuracy").replace("select cand_id, n_selected, round(error, 6)", "select cand_id::bigint as cand_id, n_selected, round(error, 6)") + " where cand_id in (select min(cand_id) from (select cand_id, string_agg(bit, '' order by f) as k from masks group by cand_id) group by k)")
def mask_relation_fitness(spark, sf_dir):
    """Each distinct mask of a relation once."""
    return rounded(evaluate.fitness(split_of(spark, sf_dir), population.deduplicated(masks_of(spark)).select("cand_id", "mask")))


# interval-guided search


def _bounds_sql() -> str:
    """Every bound: the scheme's place, at least the width after the one before, whole numbers; the running rule is a largest sum."""
    return """with n as (select unnest([64, 2000, 12600]) as d), l as (select d, greatest(2, least(d, round_even(4 * log10(d + 50) + 4, 0)))::int as n from n),
u as (select d, n, s, i, d * case s when 0 then i / n when 2 then (exp(i / n) - 1) / (exp(1) - 1) else pow(i / n, 2) end as v, greatest(1, least(5, round_even(0.5 * d / n, 0)))::int as w from l, (select unnest([0, 2, 3]) as s), range(40) t(i) where i <= n),
b as (select *, max(v - i * w) over (partition by d, s order by i) + i * w as bound from u)
select d::int as d, s::int as scheme, i::int as i, case when i = n then d else floor(round(bound, 6)) end::int as bound from b"""


@query("interval_partition", _bounds_sql())
def interval_partition(spark, sf_dir):
    rows = []
    for d in (64, 2000, 12600):
        n = interval.interval_count(d)
        for scheme in (0, 2, 3):
            rows += [(d, scheme, i, int(b)) for i, b in enumerate(interval.partition(0, d, n, scheme, interval.least_width(d, n)))]
    return spark.createDataFrame(rows, "d int, scheme int, i int, bound int")


@query("length_state", f"""with costs as (select t, i, round({uniform_sql("'cost'", 't', 'i')}, 6) as c from range(40) a(t), range(5) b(i)), sized as (select t, case when t % 8 = 7 then 20 else 100 end as width_of from range(40) a(t)),
ranked as (select t, i, row_number() over (partition by t order by c, i) as r from costs), p as (select t, max(i) filter (r = 1) as top, max(i) filter (r = 4) as w1, max(i) filter (r = 5) as w2 from ranked group by t),
e as (select *, (w1 >= top)::int + (w2 >= top)::int as n_right, case when w1 >= top then w1 else w2 end as first_right from p join sized using (t))
select t::int as t, case when width_of / 5 <= 5 then 3 when n_right = 2 then 0 when n_right = 0 then 1 else 2 end as state,
 case when width_of / 5 <= 5 then width_of when n_right = 0 then width_of else (case when n_right = 2 then (w1 + top) // 2 else (first_right + top) // 2 end) * 20 end::int as range_end from e""")
def length_state(spark, sf_dir):
    from maskforge.functions.portable import uniform_py

    rows = []
    for t in range(40):
        width = 20 if t % 8 == 7 else 100
        cost = np.array([round(uniform_py("cost", t, i), 6) for i in range(5)])
        state, _, end = interval.length_state(cost, np.arange(0, 101, 20), 0, width, 5)
        rows.append((t, state, end))
    return spark.createDataFrame(rows, "t int, state int, range_end int")


@query("length_reward", "select t as step, round(0.5 * ((64 - abs((t + t + 8) / 2 - 20)) / 64) + 0.3 * ((64 - abs((t + 1 + t + 9) - (t + t + 8)) / 2) / 64) + 0.2 * case when t % 2 = 1 then (64 - abs(22 - 20)) / 64 else 0 end, 6) as reward from range(20) r(t)")
def length_reward(spark, sf_dir):
    rows = [(t, interval.length_reward(64, {"from": t + 1, "to": t + 9, "size": 22, "cost": 0.5}, {"from": t, "to": t + 8, "size": 20, "cost": 0.4 if t % 2 else 0.5})) for t in range(20)]
    return rounded(spark.createDataFrame(rows, "step long, reward double"))


# reports

RUNS = f"with {report.records_sql()}"
SUMMARY = "round(avg(nf), 6) as nf_mean, round(stddev_pop(nf), 6) as nf_std, max(acc) as acc_best, round(avg(acc), 6) as acc_mean, round(stddev_pop(acc), 6) as acc_std, min(acc) as acc_min, " + ", ".join(f"round(avg({m}), 6) as {m}_mean" for m in report.MEASURES[1:]) + ", round(avg(time), 6) as time_mean"


@query("run_summary_pop_std", f"{RUNS} select dataset, method, {SUMMARY} from runs group by dataset, method")
def run_summary_pop_std(spark, sf_dir):
    return report.run_summary(report.records(spark), ["dataset", "method"])


@query("sweep_summary_samp_std", f"{RUNS} select dataset, method, count(*) as runs, " + ", ".join(f"round(avg({m}), 6) as {m}_mean, round(stddev_samp({m}), 6) as {m}_std" for m in ["nf", "time", *report.MEASURES]) + " from runs group by dataset, method")
def sweep_summary_samp_std(spark, sf_dir):
    return report.sweep_summary(report.records(spark), ["dataset", "method"])


@query("report_rollup", f"{RUNS} select dataset, method, count(*) as runs, round(avg(acc), 6) as acc_mean from runs group by rollup (dataset, method)")
def report_rollup(spark, sf_dir):
    return report.rolled_up(report.records(spark))


@query("runs_pivot", f"{RUNS} select dataset, run, " + ", ".join(f"max(acc) filter (method = 'method{k}') as method{k}" for k in range(3)) + " from runs group by dataset, run")
def runs_pivot(spark, sf_dir):
    return report.pivoted(report.records(spark), "acc", ["method0", "method1", "method2"])


@query("curve_mean", f"{RUNS}, v as (select dataset, method, t - 1 as t, v from (select dataset, method, unnest(curve) as v, generate_subscripts(curve, 1) as t from runs)) select dataset, method, t::int as t, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from v group by all")
def curve_mean(spark, sf_dir):
    return report.curve_means(report.records(spark))


@query("curve_resample", f"{RUNS} select dataset, method, run, t::int as t, curve[1 + round_even(t * 11 / 4.0, 0)::int] as v from runs, range(5) r(t)")
def curve_resample(spark, sf_dir):
    return report.resampled_curves(report.records(spark), 5)


@query("best_run", f"{RUNS} select dataset, method, run, curve[-1] as final, nf, acc from (select *, row_number() over (partition by dataset, method order by curve[-1], run) as r from runs) where r = 1")
def best_run(spark, sf_dir):
    return report.best_runs(report.records(spark))


@query("plot_bars", f"{RUNS} select dataset, method, round(100 * avg(acc), 6) as value from runs group by dataset, method")
def plot_bars(spark, sf_dir):
    return report.bars(report.records(spark), "acc", 100)


GRID = {"phi": [0.9, 0.99], "lr": [0.1, 0.2, 0.3], "rounds": [300, 400]}


@query("generalisation_gap", f"{RUNS} select dataset, method, round(avg(f1) - avg(acc), 6) as gap from runs group by dataset, method")
def generalisation_gap(spark, sf_dir):
    return report.generalisation_gap(report.records(spark), "acc", "f1")


@query("running_best", f"{RUNS}, v as (select dataset, method, run, unnest(curve) as v, generate_subscripts(curve, 1) - 1 as t from runs) select dataset, method, run, t::int as t, min(v) over (partition by dataset, method, run order by t) as best from v")
def running_best(spark, sf_dir):
    rows = report.records(spark).select("dataset", "method", "run", F.posexplode("curve").alias("t", "v"))
    return report.running_best(rows).select("dataset", "method", "run", "t", "best")


@query("task_product", "select d.dataset, p.phi::double as phi, r::int as run from (select unnest(['data0', 'data1']) as dataset) d, (select unnest([0.9, 0.95, 0.99]) as phi) p, range(3) t(r)")
def task_product(spark, sf_dir):
    datasets = spark.createDataFrame([("data0",), ("data1",)], "dataset string")
    configs = spark.createDataFrame([(x,) for x in report.numbers("0.9, 0.95,0.99")], "phi double")
    return report.tasks(datasets, configs, 3)


@query("imputed_modes", "with m as (select l_quantity as q from lineitem where l_quantity > 25 group by 1 order by count(*) desc, 1 limit 1) select round(sum(case when l_quantity > 25 then l_quantity else q end), 3) as total from lineitem, m")
def imputed_modes(spark, sf_dir):
    holes = feat.lineitems(spark, sf_dir).withColumn("features", F.transform("features", lambda v, i: F.when((i > 0) | (v > 25), v)))
    return feat.imputed_modes(holes).agg(F.round(F.sum(F.get("features", F.lit(0))), 3).alias("total"))


@query("normalised_rows", f"{EMB}, s as (select row_id, sqrt(sum(value * value)) as n from raw group by row_id) select f as feature, round(sum(value / n), 6) as total from raw join s using (row_id) group by f")
def normalised_rows(spark, sf_dir):
    return feat.unpivoted(feat.normalised(feat.embeddings(spark, sf_dir))).groupBy("feature").agg(r6(F.sum("value"), "total"))


@query("param_grid_cartesian", "select phi::double as phi, lr::double as lr, rounds::double as rounds from (select unnest([0.9, 0.99]) as phi), (select unnest([0.1, 0.2, 0.3]) as lr), (select unnest([300, 400]) as rounds)")
def param_grid_cartesian(spark, sf_dir):
    return report.grid(spark, GRID)


@query("param_grid_one_vs_rest", "select 'phi' as varying, p::double as phi, 0.1::double as lr, 300::double as rounds from (select unnest([0.9, 0.99]) as p) union all select 'lr', 0.9::double, l::double, 300::double from (select unnest([0.1, 0.2, 0.3]) as l) union all select 'rounds', 0.9::double, 0.1::double, r::double from (select unnest([300, 400]) as r)")
def param_grid_one_vs_rest(spark, sf_dir):
    return report.grid(spark, GRID, one_at_a_time=True)


@query("stream_summary", f"{RUNS} select dataset, count(*) as runs, round(avg(acc), 6) as acc_mean, round(avg(time), 6) as time_mean from runs group by dataset")
def stream_summary(spark, sf_dir):
    return rounded(summary(report.records(spark), ["dataset"]))


@query("event_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return windowed(events, "ts", "1 hour", "1 day", ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# searches and experiments, which SQL can't express


def _search(name: str, scorer=scorer_for, few: bool = False, **options) -> Query:
    """A search over the planted table, whose features are known; ``few`` for scorers that train a model for each mask."""
    n, rounds = (2, 2) if few else (6, 4)

    def run(spark, sf_dir):
        found = search(name, Task(scorer(feat.with_split(feat.planted(spark), 1))), Options(n=n, rounds=rounds, interval_rounds=2, seed=1, **options))
        return spark.createDataFrame([(name, found.mask, round(found.fitness, 9), found.curve, found.scored)], "method string, mask array<int>, fitness double, curve array<double>, scored int")

    return run


for _name, _method, _options in [
    ("search_pso", "PSO", {"scorer": SparkScorer}), ("search_tree", "SFE", {"scorer": SparkScorer, "classifier": "dt", "few": True}), ("search_unlabelled", "SFE", {"scorer": SparkScorer, "func": 4, "few": True}), ("search_bbpso", "BBPSO", {}), ("search_ga", "ga", {}), ("search_de", "de", {}), ("search_sfe", "SFE", {}), ("search_gwo", "gwo", {}), ("search_ssa", "ssa", {}), ("search_woa", "obwoa", {}), ("search_bso", "bso", {}),
    *[(f"search_interval_q_{m}", "interval_elite_swarm", {"mode": m}) for m in protocols.ABLATION_MODES],
]:
    QUERIES[_name] = _search(_method, **_options)


@query("search_embeddings")
def search_embeddings(spark, sf_dir):
    """A swarm and an interval-guided swarm over all rows and dimensions of the embeddings, by the scorer that fits their size."""
    split = feat.with_split(feat.scaled(feat.embeddings(spark, sf_dir)), 1)
    rows = []
    for name in ("PSO", "interval_elite_swarm"):
        found = search(name, Task(scorer_for(split)), Options(n=6, rounds=4, interval_rounds=2, seed=1))
        rows.append((name, found.mask, round(found.fitness, 9), found.curve, found.scored))
    return spark.createDataFrame(rows, "method string, mask array<int>, fitness double, curve array<double>, scored int")


@query("search_all_methods")
def search_all_methods(spark, sf_dir):
    """Every method, one task each, on the planted table: chosen features and cost."""
    from maskforge.plans.search import METHODS

    got = protocols.hold_out(spark, {"planted": feat.planted(spark)}, sorted(METHODS), 1, Options(n=8, rounds=6, interval_rounds=2))
    return got.select("dataset", "method", "run", "nf", r6("fitness"), r6("accuracy"), "mask", "curve")


@query("protocol_hold_out")
def protocol_hold_out(spark, sf_dir):
    got = protocols.hold_out(spark, {"planted": feat.planted(spark), "embeddings": feat.embeddings(spark, sf_dir)}, ["PSO", "interval_elite_swarm"], 2, Options(n=6, rounds=4, interval_rounds=2))
    return got.select("dataset", "method", "run", "nf", r6("accuracy"), r6("f1_macro"), "curve")


@query("protocol_cross_validation")
def protocol_cross_validation(spark, sf_dir):
    got = protocols.cross_validation(spark, {"planted": feat.planted(spark)}, ["PSO"], 3, Options(n=6, rounds=4))
    return got.groupBy("dataset", "method").agg(F.count("*").alias("folds"), r6(F.avg("accuracy"), "acc_mean"), r6(F.stddev_pop("accuracy"), "acc_std"))


@query("protocol_sensitivity")
def protocol_sensitivity(spark, sf_dir):
    got = protocols.sensitivity(spark, {"planted": feat.planted(spark)}, {"phi": [0.99, 0.9], "learning_rate": [0.2, 0.4]}, 2, Options(n=6, rounds=4, interval_rounds=2))
    return got.groupBy("config").agg(F.count("*").alias("runs"), r6(F.avg("accuracy"), "acc_mean"))


@query("protocol_ablation")
def protocol_ablation(spark, sf_dir):
    got = protocols.ablation(spark, {"planted": feat.planted(spark)}, 2, Options(n=6, rounds=4, interval_rounds=2))
    return got.select(F.regexp_extract("config", "mode=([a-z_]+)", 1).alias("mode"), "run", "nf", r6("accuracy"))


def _classified(kind: str) -> Query:
    def run(spark, sf_dir):
        from maskforge.operators.classifiers import predictions

        return rounded(metrics.metrics(predictions(feat.with_split(feat.planted(spark), 1), kind), []))

    return run


for _kind in ("rf", "dt", "lr", "linear_svc", "rbf_svm", "mlp"):
    QUERIES[f"clf_{_kind}"] = _classified(_kind)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["oracle_sql", "queries", "resampled"]
