"""Predicted break classes against planted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(ref, planted, predicted); of several predictions for a reference the last (by ``ordinal``) counts."""
    last = predicted.groupBy("ref").agg(F.max_by("break_type", "ordinal").alias("predicted"))
    return truth.select("ref", F.col("break_type").alias("planted")).join(last, "ref", "full_outer")


def by_class(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per class: planted, tp, fp, fn, and precision and recall per mille (precision 0 without predictions, recall null without plants)."""
    o = outcomes(truth, predicted)
    long = o.select(F.explode(F.array_distinct(F.array_compact(F.array("planted", "predicted")))).alias("break_type"), "planted", "predicted")
    is_planted, is_predicted = F.col("planted").eqNullSafe(F.col("break_type")), F.col("predicted").eqNullSafe(F.col("break_type"))
    counted = long.groupBy("break_type").agg(
        F.count_if(is_planted).alias("planted_n"), F.count_if(is_planted & is_predicted).alias("tp"), F.count_if(~is_planted & is_predicted).alias("fp"), F.count_if(is_planted & ~is_predicted).alias("fn")
    )
    share = lambda whole: F.call_function("div", F.col("tp") * 1000, whole)
    return counted.select(
        "*",
        F.when(F.col("tp") + F.col("fp") > 0, share(F.col("tp") + F.col("fp"))).otherwise(0).cast("bigint").alias("precision_pm"),
        F.when(F.col("planted_n") > 0, share(F.col("planted_n"))).cast("bigint").alias("recall_pm"),
    )


def overall(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: planted, correctly classified, accuracy per mille, and predictions left unexplained."""
    o = outcomes(truth, predicted)
    right = F.count_if(F.col("planted") == F.col("predicted"))
    out = o.agg(F.count("planted").alias("planted_n"), right.alias("correct"), F.count_if(F.col("predicted") == "amount_unknown").alias("unexplained"))
    return out.withColumn("accuracy_pm", F.when(F.col("planted_n") > 0, F.call_function("div", F.col("correct") * 1000, F.col("planted_n"))))
