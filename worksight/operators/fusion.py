"""Evidence fusion: one priority for each work from its signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEVERITY_FACTOR, SIGNAL_WEIGHT, WEAK_DUPLICATE_FACTOR


def _pick(table: dict[str, float], c: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, c), F.lit(1.0))


def priority_label(score: Column) -> Column:
    return F.when(score < 2.0, "LOW").when(score < 4.5, "MEDIUM").when(score < 7.0, "HIGH").otherwise("CRITICAL")


def contribution() -> Column:
    """What a triggered signal adds: weight x severity, less for a duplicate that its context doesn't support."""
    weak = (F.col("signal_type") == "DUPLICATE") & F.col("contextual_confidence").isin("low", "unavailable")
    value = _pick(SIGNAL_WEIGHT, F.col("signal_type")) * _pick(SEVERITY_FACTOR, F.col("severity")) * F.when(weak, WEAK_DUPLICATE_FACTOR).otherwise(1.0)
    return F.round(value, 2).cast("decimal(10,2)")


def fuse(signals: DataFrame) -> DataFrame:
    """dataset_id, project_id, score, level, signal_count, convergence_bonus, engines, reasons of each work with a signal row.

    A sum over signals with partial aggregation; only triggered ones count, and two (three) engines that agree add 1.5 (3)."""
    on = F.col("triggered")
    value = F.when(on, contribution()).otherwise(F.lit(0).cast("decimal(10,2)"))
    engine = F.when(on & F.col("source_type").isin("RULE", "ML", "NLP"), F.col("source_type"))
    per = signals.groupBy("dataset_id", "project_id").agg(
        F.sum(value).alias("_sum"), F.count_if(on).alias("signal_count"), F.sort_array(F.collect_set(engine)).alias("engines"),
        F.transform(F.array_sort(F.collect_list(F.when(on, F.struct((-contribution()).alias("n"), "title")))), lambda x: x["title"]).alias("reasons"),
    )
    bonus = F.when(F.size("engines") >= 3, 3.0).when(F.size("engines") >= 2, 1.5).otherwise(0.0).cast("decimal(4,2)")
    per = per.withColumn("convergence_bonus", bonus).withColumn("score", (F.col("_sum") + F.col("convergence_bonus")).cast("decimal(12,2)"))
    return per.withColumn("level", priority_label(F.col("score"))).select("dataset_id", "project_id", "score", "level", "signal_count", "convergence_bonus", "engines", "reasons")
