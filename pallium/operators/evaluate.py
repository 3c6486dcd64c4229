"""Precision, recall and F1 of predictions against labels, and the gate against a stored baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["page", "element", "category", "via"]
#: Fixed value: drop of F1 that the gate still accepts.
TOLERANCE = 0.0005


def labels(raw: DataFrame) -> DataFrame:
    """Rows (page, element, category, via, confidence) of label files (page, expect: map of element to 'category/via[/confidence]')."""
    rows = raw.select("page", F.explode("expect").alias("element", "marks")).select("page", "element", F.explode("marks").alias("m"))
    part = F.split("m", "/")
    return rows.select("page", "element", part[0].alias("category"), part[1].alias("via"), F.get(part, 2).alias("confidence"))


def last_of_key(rows: DataFrame, seq: str) -> DataFrame:
    """One row for each key: the last by `seq`."""
    others = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(KEY).agg(F.max_by(F.struct(*others), seq).alias("_r")).select(*KEY, "_r.*")


def scored(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(KEY, outcome, confidence, expected): tp, fp or fn for every key on either side."""
    p = predictions.select(*KEY, F.col("confidence").alias("confidence"), F.lit(True).alias("_p")).dropDuplicates(KEY)
    t = truth.select(*KEY, F.col("confidence").alias("expected"), F.lit(True).alias("_t")).dropDuplicates(KEY)
    outcome = F.when(F.col("_p").isNull(), "fn").when(F.col("_t").isNull(), "fp").otherwise("tp")
    return p.join(t, KEY, "full_outer").withColumn("outcome", outcome).drop("_p", "_t")


def confidence_warnings(outcomes: DataFrame) -> DataFrame:
    """True positives whose evidence is another kind than the label states."""
    return outcomes.filter("outcome = 'tp' and expected is not null and expected <> confidence")


def precision(tp: Column, fp: Column) -> Column:
    return F.round(F.when(tp + fp == 0, 1.0).otherwise(tp / (tp + fp)), 4)


def recall(tp: Column, fn: Column) -> Column:
    return F.round(F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn)), 4)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p = F.when(tp + fp == 0, 1.0).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn))
    return F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 4)


def metrics(outcomes: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of each group; precision is 1 without predictions, recall 1 without truth."""
    counts = {k: F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fp", "fn")}
    grouped = outcomes.groupBy(*by).agg(*counts.values())
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return grouped.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)})


def by_category_and_overall(outcomes: DataFrame) -> DataFrame:
    """One pass over both grouping sets; the overall row has category 'overall'."""
    counts = [F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fp", "fn")]
    grouped = outcomes.groupingSets([[F.col("category")], []], "category").agg(*counts, F.grouping_id().alias("_g"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    named = grouped.withColumn("category", F.when(F.col("_g") == 1, "overall").otherwise(F.col("category"))).drop("_g")
    return named.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)})


def report(metric_rows: DataFrame) -> DataFrame:
    """Metrics as shown: precision is n/a without predictions."""
    shown = F.when(F.col("tp") + F.col("fp") == 0, "n/a").otherwise(F.format_number(F.col("precision") * 100, 1))
    return metric_rows.withColumn("precision_shown", shown)


def gate(current: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(category, status, d_f1, d_fp, d_fn): new, missing, worse, better or same against the baseline."""
    c = current.select("category", *(F.col(x).alias(f"c_{x}") for x in ("fp", "fn", "f1")))
    b = baseline.select("category", *(F.col(x).alias(f"b_{x}") for x in ("fp", "fn", "f1")))
    drop = F.round(F.col("c_f1") - F.col("b_f1"), 4)
    worse = (drop < -tolerance) | (F.col("c_fp") > F.col("b_fp")) | (F.col("c_fn") > F.col("b_fn"))
    status = F.when(F.col("b_f1").isNull(), "new").when(F.col("c_f1").isNull(), "missing").when(worse, "worse").when(drop > tolerance, "better").otherwise("same")
    joined = c.join(b, "category", "full_outer")
    return joined.select("category", status.alias("status"), drop.alias("d_f1"), (F.col("c_fp") - F.col("b_fp")).alias("d_fp"), (F.col("c_fn") - F.col("b_fn")).alias("d_fn"))


def unlabelled(pages: DataFrame, truth: DataFrame) -> DataFrame:
    return pages.join(truth.select("page").distinct(), "page", "left_anti")


def merged_counts(a: Column, b: Column) -> Column:
    """Two maps of counts added."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).count()
