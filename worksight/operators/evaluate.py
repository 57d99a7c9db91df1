"""Evaluation of detection against ground truth and documented patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flags(works: DataFrame, signals: DataFrame, truth: DataFrame) -> DataFrame:
    """dataset_id, id, flagged, injected, anomaly_type, hit: a work is flagged by any triggered signal but data quality; hit: by
    the detector that its injected anomaly is meant for."""
    on = signals.filter(F.col("triggered") & (F.col("signal_type") != "DATA_QUALITY"))
    kinds = on.groupBy("dataset_id", F.col("project_id").alias("id")).agg(F.collect_set("signal_type").alias("kinds"))
    t = truth.select(F.col("record_id").alias("id"), "injected", "anomaly_type", "expected_detector")
    out = works.select("dataset_id", "id").join(kinds, ["dataset_id", "id"], "left").join(t, "id", "left")
    return out.select(
        "dataset_id", "id", F.col("kinds").isNotNull().alias("flagged"), F.coalesce("injected", F.lit(False)).alias("injected"), "anomaly_type",
        F.coalesce(F.array_contains("kinds", F.col("expected_detector")), F.lit(False)).alias("hit"),
    )


def _with_metrics(df: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 4)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = df.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("fpr", ratio(fp, fp + tn))
    return out.withColumn("f1", F.when((tp + fp > 0) & (tp + fn > 0), F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))))


_COUNTS = {"tp": "injected and flagged", "fp": "not injected and flagged", "tn": "not injected and not flagged", "fn": "injected and not flagged"}


def confusion(found: DataFrame, *by: str) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1, fpr (null on zero denominators), for all rows or for each value of `by`."""
    return _with_metrics(found.groupBy(*by).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in _COUNTS.items()]))


def by_scenario(found: DataFrame, scenario: str = "dataset_id") -> DataFrame:
    """Each scenario's matrix and the pooled one (scenario null)."""
    return _with_metrics(found.rollup(scenario).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in _COUNTS.items()]))


def by_type(found: DataFrame) -> DataFrame:
    """Each anomaly type against all clean rows, and how many its own detector found."""
    clean = found.filter("not injected").agg(F.count_if("flagged").alias("fp"), F.count_if(~F.col("flagged")).alias("tn"))
    per = found.filter("injected").groupBy("anomaly_type").agg(F.count_if("flagged").alias("tp"), F.count_if(~F.col("flagged")).alias("fn"), F.count_if("hit").alias("detector_hits"))
    return _with_metrics(per.join(F.broadcast(clean)))  # clean: one row


def errors(found: DataFrame, kind: str) -> DataFrame:
    """The false positives (`fp`) or false negatives (`fn`)."""
    return found.filter(_COUNTS[kind]).select("dataset_id", "id", "anomaly_type")


def patterns(documented: DataFrame, works: DataFrame, signals: DataFrame) -> DataFrame:
    """pattern_id, result: FLAGGED if the expected signal fired on any of the pattern's works, PARTIAL if another did, else MISSED;
    NOT_VALIDATABLE for patterns without works."""
    each = documented.select("pattern_id", "expected_signal", F.explode_outer("work_ids").alias("work_id"))
    own = works.select("dataset_id", "id", "work_id")
    on = signals.filter(F.col("triggered") & (F.col("signal_type") != "DATA_QUALITY")).select("dataset_id", F.col("project_id").alias("id"), "signal_type")
    seen = each.join(own, "work_id", "left").join(on, ["dataset_id", "id"], "left")
    per = seen.groupBy("pattern_id").agg(F.count("work_id").alias("n"), F.bool_or(F.col("signal_type") == F.col("expected_signal")).alias("hit"), F.count("signal_type").alias("any"))
    result = F.when(F.col("n") == 0, "NOT_VALIDATABLE").when(F.coalesce("hit", F.lit(False)), "FLAGGED").when(F.col("any") > 0, "PARTIAL").otherwise("MISSED")
    return per.select("pattern_id", result.alias("result"))


def enters_queue(priorities: DataFrame) -> DataFrame:
    return priorities.withColumn("enters_queue", F.coalesce(F.col("level").isin("MEDIUM", "HIGH", "CRITICAL"), F.lit(False)))
