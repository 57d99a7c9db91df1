"""The detection run: every stage over the works of all datasets, and its summary."""

from __future__ import annotations

import logging
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, duplicates, forest, fusion
from ..tables import stash

log = logging.getLogger(__name__)
#: The columns of works that a run reads.
COLUMNS = (
    "dataset_id", "source_row_number", "id", "work_id", "mp_name", "constituency", "state", "district", "location_text", "latitude", "longitude", "category", "description", "estimated_cost", "sanctioned_cost",
    "expenditure", "financial_progress", "physical_progress", "sanction_date", "start_date", "completion_date", "status", "implementing_agency", "expected_duration_days",
)


def rule_signals(works: DataFrame, today: str, metrics: DataFrame | None = None, peers: DataFrame | None = None) -> DataFrame:
    """All deterministic signals but duplicates."""
    metrics = detect.work_metrics(works, today) if metrics is None else metrics
    peers = detect.peer_stats(works) if peers is None else peers
    parts = [
        detect.quality_signals(works), detect.cost_anomaly(works, peers), detect.progress_gap(works), detect.delay(works, metrics), detect.compliance_signals(works),
        detect.agency_concentration(works),
    ]
    return reduce(DataFrame.unionByName, parts)


def deterministic_signals(works: DataFrame, today: str, pairs: DataFrame | None = None, metrics: DataFrame | None = None, peers: DataFrame | None = None) -> DataFrame:
    pairs = duplicates.duplicate_pairs(works) if pairs is None else pairs
    return rule_signals(works, today, metrics, peers).unionByName(duplicates.duplicate_signals(pairs))


def counted(df: DataFrame, measure: str, key: str | None = None) -> DataFrame:
    """dataset_id, measure, key, n: rows of a stage, for each value of key if there is one."""
    by = ["dataset_id", *([F.col(key).alias("key")] if key else [])]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return out.select("dataset_id", F.lit(measure).alias("measure"), F.col("key") if key else F.lit("all").alias("key"), "n")


def run_detection(works: DataFrame, today: str, with_forest: bool = True) -> dict[str, DataFrame]:
    """metrics, peers, pairs, scores, others (signals but duplicates), signals, priorities, summary: a run is a pure function of the works and the date. The columns of
    works that its stages read are written once, as works may be a long plan, and so is what more than one stage reads; signals of duplicates, two a pair with
    their texts, are made of the pairs wherever they are read."""
    works = stash(works.select(*[c for c in works.columns if c in COLUMNS]), "detection-works")
    metrics, peers = stash(detect.work_metrics(works, today), "detection-metrics"), stash(detect.peer_stats(works), "detection-peers")
    pairs = duplicates.duplicate_pairs(works)
    others = rule_signals(works, today, metrics, peers)
    out = {"metrics": metrics, "peers": peers, "pairs": pairs}
    if with_forest:
        out["scores"] = stash(forest.iforest_scores(forest.impute(forest.features(works, metrics, peers, duplicates.duplicate_score(pairs)))), "detection-scores")
        others = others.unionByName(forest.ml_signals(out["scores"]))
    out["others"] = others = stash(others, "detection-signals")
    out["signals"] = signals = others.unionByName(duplicates.duplicate_signals(pairs))
    out["priorities"] = fusion.fuse(signals)
    stages = [
        counted(signals.filter("signal_type = 'DATA_QUALITY'"), "quality_issues"), counted(metrics, "metrics"), counted(detect.peer_groups(works), "peer_groups"), counted(pairs, "duplicate_pairs"),
        counted(signals, "signals", "signal_type"), counted(out["priorities"], "priorities", "level"),
    ]
    if with_forest:
        stages.append(counted(out["scores"], "scores"))
    out["summary"] = reduce(DataFrame.unionByName, stages).withColumn("model_version", F.lit("iforest-v1")).withColumn("ruleset_version", F.lit("rules-v1"))
    return out


def run_record(works: DataFrame, today: str, run=run_detection) -> DataFrame:
    """A row for each dataset of a run: dataset_id, status (COMPLETED or FAILED), error (2000 characters of it at most), summary (a
    map from measure:key to count; null if it failed). A failure is recorded, not raised."""
    datasets = works.select("dataset_id").distinct()
    try:
        summary = stash(run(works, today)["summary"], "detection-summary")
    except (PySparkException, Py4JError) as failure:  # what stops a Spark job is the run's record; an error of the program is not
        log.exception("the detection run failed")
        return datasets.select("dataset_id", F.lit("FAILED").alias("status"), F.lit(str(failure)[:2000]).alias("error"), F.lit(None).cast("map<string,bigint>").alias("summary"))
    entries = F.sort_array(F.collect_list(F.struct(F.concat_ws(":", "measure", "key").alias("k"), "n")))
    per = summary.groupBy("dataset_id").agg(F.map_from_entries(entries).alias("summary"))
    return datasets.join(per, "dataset_id", "left").select("dataset_id", F.lit("COMPLETED").alias("status"), F.lit(None).cast("string").alias("error"), "summary")
