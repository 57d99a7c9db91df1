"""One shape for all signals: what was observed against what reference, with evidence rows and a recommended action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "rules-v1"
ACTIONS = {
    "COMPLIANCE": "Check the work against the cited guideline and confirm category and agency with the district authority.",
    "FIN_PHYS_GAP": "Verify execution on site and reconcile payments with certified progress.",
    "COST_ANOMALY": "Compare the estimate with the work order and with peer works of the district and category.",
    "DELAY": "Verify the site's status and review papers on extension or completion.",
    "DUPLICATE": "Verify the asset's place and whether both works exist.",
    "ML_ANOMALY": "Review the unusual features against source records.",
    "AGENCY_CONCENTRATION": "Review the agency's whole portfolio in the district.",
    "DATA_QUALITY": "Correct the source record and validate the dataset again.",
}
COLUMNS = ("dataset_id", "project_id", "signal_type", "severity", "triggered", "title", "explanation", "source_type", "source_version", "contextual_confidence", "observed", "reference", "difference", "recommended_action", "evidence")


def as_map(values: dict[str, Column | str]) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def evidence(field: str | Column, value: Column, label: str, reference: Column | None, calculation: Column | None, **provenance) -> Column:
    text = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("string")
    return F.struct(
        text(field).alias("field_name"), text(value).alias("field_value"), F.lit(label).alias("reference_label"), text(reference).alias("reference_value"),
        text(calculation).alias("calculation"), as_map(provenance).alias("provenance"),
    )


def make_signals(
    df: DataFrame, kind: str, severity: Column, title: Column, source: str, observed: dict, reference: dict, difference: dict, rows: list[Column], confidence: Column | None = None, version: str = VERSION,
    explanation: Column | None = None,
) -> DataFrame:
    """A triggered signal for each row of df (dataset_id, id). severity null: no signal. explanation: a sentence with the figures behind the title."""
    return df.withColumn("_severity", severity).filter("_severity is not null").select(
        "dataset_id", F.col("id").alias("project_id"), F.lit(kind).alias("signal_type"), F.col("_severity").alias("severity"), F.lit(True).alias("triggered"), title.alias("title"),
        (explanation if explanation is not None else title).alias("explanation"),
        F.lit(source).alias("source_type"), F.lit(version).alias("source_version"), (confidence if confidence is not None else F.lit(None).cast("string")).alias("contextual_confidence"),
        as_map(observed).alias("observed"), as_map(reference).alias("reference"), as_map(difference).alias("difference"), F.lit(ACTIONS[kind]).alias("recommended_action"), F.array(*rows).alias("evidence"),
    )


def signal_id(signals: DataFrame) -> DataFrame:
    return signals.withColumn("signal_id", F.sha2(F.concat_ws("|", "dataset_id", "project_id", "signal_type", "title", F.to_json("difference")), 256))


def evidence_rows(signals: DataFrame) -> DataFrame:
    """The evidence as a flat table, numbered inside its signal."""
    return signal_id(signals).select("dataset_id", "project_id", "signal_id", "signal_type", F.posexplode("evidence").alias("place", "e")).select("dataset_id", "project_id", "signal_id", "signal_type", "place", "e.*")
