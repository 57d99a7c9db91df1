"""The registered queries of the works jobs, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bench_views as views
from .bench_views import BOTH, REPEATING, TODAY, WORKS
from .operators import audit, cases, detect, duplicates, evaluate, forest, fusion, imports, reporting, signals
from .plans import detection, importing
from .schemas import ANOMALY_HIGH, ANOMALY_TRIGGER, CASE_TRANSITIONS
from .sources import exports
from .tables import kept, shared_dir, stash, until_exit


class Repeating(str):
    """A folder of tables whose works are read under texts that repeat."""


def works(spark: SparkSession, d: str) -> DataFrame:
    return views.works(spark, d, REPEATING if isinstance(d, Repeating) else WORKS)


def _under(d: str, text: str) -> str:
    return Repeating(d) if text == REPEATING else d


def _joint(repeating: DataFrame, plain: DataFrame) -> DataFrame:
    return repeating.withColumn("dataset_id", F.concat(F.lit("R"), "dataset_id")).unionByName(plain)


def register(spark: SparkSession, d: str, text: str = WORKS) -> DataFrame:
    """The works of d under a text of the register; BOTH has those under either, in datasets of their own."""
    return _joint(works(spark, Repeating(d)), works(spark, d)) if text == BOTH else works(spark, _under(d, text))


def _run(spark, d, text: str = WORKS) -> dict[str, DataFrame]:
    """pairs, scores and signals of the detection run over the tables of d: run once an application for a text of the register, read by all its
    reports. Datasets know nothing of each other, so the run over BOTH is that over either, side by side."""
    if text == BOTH:
        repeating, plain = _run(spark, d, REPEATING), _run(spark, d)
        return {k: _joint(repeating[k], plain[k]) for k in plain}

    def make() -> dict[str, DataFrame]:
        run = detection.run_detection(register(spark, d, text), TODAY)
        return {k: run[k] for k in ("pairs", "scores", "others")}

    found = kept(spark, ("detection", d, text), [f"{d}/{t}.parquet" for t in views.TABLES] if d else [], make)
    return found | {"signals": found["others"].unionByName(duplicates.duplicate_signals(found["pairs"]))}


def _signals(spark, d, text: str = WORKS) -> DataFrame:
    """All signals of the detection run, duplicates and outliers included."""
    return _run(spark, d, text)["signals"]


def _brief(found: DataFrame) -> DataFrame:
    return found.select("dataset_id", "project_id", "signal_type", "severity")


def _dated(spark, d, text: str = WORKS) -> DataFrame:
    own = register(spark, d, text).select("dataset_id", F.col("id").alias("project_id"), F.col("sanction_date").cast("timestamp").alias("created_at"))
    return _signals(spark, d, text).join(own, ["dataset_id", "project_id"])


def _summary(spark, d, s: DataFrame | None = None, text: str = WORKS) -> DataFrame:
    w, s = register(spark, d, text), _signals(spark, d, text) if s is None else s
    return reporting.work_summary(w, fusion.fuse(s), s, views.view(spark, d, views.CASES))


def _raw(spark, d) -> DataFrame:
    return imports.normalize_work(views.raw_works(spark, d))


#: Headers of the written exports that are not just the column's name in words.
_HEADERS = {"mp_name": " Hon'ble Members of Parliament ", "description": "Work Name", "sanctioned_amount": "Sanctioned Amount (₹)", "state": "STATE_NAME", "latitude": "Lat", "expenditure": "Expenditure (₹)"}

_LATER = {"mp_name": "MP Name", "description": "Work Description", "sanctioned_amount": "Sanctioned Cost", "latitude": "latitude", "state": "State", "work_id": "WorkID"}


def _exports(spark, d) -> str:
    """A folder of the raw works as CSV exports: FILES files, each in source order. The second half of them has its columns in another order, and
    some under other names."""
    raw = views.raw_works(spark, d).withColumn("part", F.pmod("source_row_number", F.lit(views.FILES)))
    names = [c for c in raw.columns if c not in ("dataset_id", "source_row_number", "part")]
    path = f"{shared_dir(spark)}/exports-{uuid.uuid4().hex}"
    own = raw.repartition("part").sortWithinPartitions("part", "source_row_number")
    for later in (False, True):
        cells = [F.col(c).alias((_LATER if later else _HEADERS).get(c, c.replace("_", " ").title())) for c in (reversed(names) if later else names)]
        half = own.filter((F.col("part") >= views.FILES // 2) == later).select("part", *cells, F.lit("as received").alias("Remarks"))
        half.write.mode("append").partitionBy("part").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return until_exit(spark, path)


def _imported(spark, d) -> dict[str, DataFrame]:
    """The import run over exports of the raw works, made once an application; `part` is the number in a file's path."""
    def make() -> dict[str, DataFrame]:
        path = _exports(spark, d)
        out = f"{shared_dir(spark)}/imported-{uuid.uuid4().hex}"
        run = importing.run_import(spark, path, out)
        until_exit(spark, out)
        part = F.regexp_extract("file_path", "part=([0-9]+)", 1).alias("part")
        parts = run["datasets"].select("dataset_id", part)
        found = {k: stash(df.join(F.broadcast(parts), "dataset_id"), f"imported-{k}") for k, df in run.items() if k not in ("datasets", "rejected")}  # FILES rows
        known = run["datasets"].filter(part.cast("int") < 8)
        fresh = exports.new_files(exports.files(spark, path), known).select(part)
        return found | {"datasets": stash(run["datasets"].select("*", part), "imported-datasets"), "new": stash(fresh, "imported-new")}

    return kept(spark, ("import", d), [f"{d}/{t}.parquet" for t in views.TABLES], make)


def _digests(spark, d) -> DataFrame:
    return works(spark, d).groupBy(F.col("state").alias("role")).agg(F.count(F.lit(1)).alias("last_seen_seq"), F.max("sanction_date").cast("timestamp").alias("cutoff"))


def _datasets(spark, d) -> DataFrame:
    """Datasets of works, which have been imported when their last work was sanctioned, and of allocations."""
    own = works(spark, d).groupBy("dataset_id").agg(F.max("sanction_date").cast("timestamp").alias("ingested_at"), F.min("sanction_date").cast("timestamp").alias("created_at"))
    others = views.view(spark, d, views.RAW_ALLOCATION).select("dataset_id").distinct().withColumn("ingested_at", F.lit("2030-01-01").cast("timestamp")).withColumn("created_at", F.col("ingested_at"))
    return own.withColumn("dataset_type", F.lit("WORK_LEVEL")).unionByName(others.withColumn("dataset_type", F.lit("MP_ALLOCATION")))


def _pairs(spark, d, text: str = WORKS) -> DataFrame:
    return duplicates.duplicate_pairs(register(spark, d, text))


def _features(spark, d, text: str = WORKS) -> DataFrame:
    w = register(spark, d, text)
    return forest.impute(forest.features(w, detect.work_metrics(w, TODAY), detect.peer_stats(w), duplicates.duplicate_score(_run(spark, d, text)["pairs"])))


def _found(spark, d, text: str = WORKS) -> DataFrame:
    return evaluate.flags(register(spark, d, text), _signals(spark, d, text), views.view(spark, d, views.TRUTH))


def _chain(spark, d) -> DataFrame:
    own = views.view(spark, d, views.CASE_EVENTS).filter("case_id is not null")
    from pyspark.sql.window import Window

    return own.select(
        F.col("case_id").alias("chain_id"), F.row_number().over(Window.partitionBy("case_id").orderBy("seq")).cast("long").alias("seq"), F.col("to_status").alias("action"), F.lit("officer").alias("actor_id"),
        F.lit('"case"\x1f').alias("entity_type"), F.col("case_id").alias("entity_id"), F.format_string('{"n": %d, "a": {"y": 1.50, "x": "\\u000B"}}', "seq").alias("payload"), F.col("seq").cast("string").alias("created_at"),
    )


def _broken(spark, d) -> DataFrame:
    """The built chains, of which some have a changed first hash, a gap after the first event or a changed action in the third."""
    own = audit.build_chain(_chain(spark, d))
    ends = F.col("chain_id").endswith
    own = own.withColumn("entry_hash", F.when(ends("7") & (F.col("seq") == 1), F.lit("0")).otherwise(F.col("entry_hash")))
    own = own.withColumn("action", F.when(ends("3") & (F.col("seq") == 3), F.lit("NONE")).otherwise(F.col("action")))
    return own.filter(~(ends("5") & (F.col("seq") == 2)))


def _texts(spark, d) -> DataFrame:
    """The signals of the three rules that compare figures, each with an id."""
    w = works(spark, d)
    found = detect.cost_anomaly(w, detect.peer_stats(w)).unionByName(detect.progress_gap(w)).unionByName(detect.delay(w, detect.work_metrics(w, TODAY)))
    return found.withColumn("signal_id", F.concat_ws("-", "project_id", "signal_type"))


def _manifest(spark, d) -> DataFrame:
    """Manifests of all cases, with these signals dated by the sanction of their works."""
    dated = works(spark, d).select("dataset_id", F.col("id").alias("project_id"), F.col("sanction_date").cast("timestamp").alias("created_at"))
    found = stash(_texts(spark, d).join(views.view(spark, d, views.CASES).select("project_id").distinct(), "project_id", "left_semi").join(dated, ["dataset_id", "project_id"]), "manifest-signals")
    rows = found.select("signal_id", F.posexplode("evidence").alias("place", "e")).select(F.concat_ws("-", "signal_id", "place").alias("evidence_id"), "signal_id", "place", "e.*")
    return audit.manifest(audit.manifest_items(views.view(spark, d, views.CASES), found, rows, views.view(spark, d, views.REPORT_EVENTS), views.view(spark, d, views.REPORT_NOTES)))


def _quality(spark, d) -> DataFrame:
    raw = _raw(spark, d)
    found = detect.quality_signals(works(spark, d))
    out = imports.quality_totals(raw, imports.validate_works(raw), found)
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return out.select("dataset_id", "quality_status", "total_rows", "valid_rows", "warning_rows", "error_rows", "issue_count", "detection_issue_count", flat("missing_field_counts"), flat("invalid_field_counts"), flat("duplicate_counts"))


def _patterns(spark) -> DataFrame:
    rows = [("P1", "FIN_PHYS_GAP", ["W-3", "W-9"]), ("P2", "COST_ANOMALY", ["W-4"]), ("P3", "COMPLIANCE", ["W-41"]), ("P4", "DELAY", []), ("P5", "AGENCY_CONCENTRATION", ["W-none"])]
    return spark.createDataFrame(rows, "pattern_id string, expected_signal string, work_ids array<string>")


def _trends(spark, d) -> DataFrame:
    agg = imports.normalize_aggregate(views.view(spark, d, views.RAW_AGGREGATE)).groupBy("dataset_id", "house").agg(*[F.sum(c).alias(c) for c in ("works_recommended", "works_sanctioned", "works_completed")])
    sets = agg.select("dataset_id").distinct().withColumn("ingested_at", F.when(F.col("dataset_id") == "AG0", F.lit("2024-01-01")).otherwise(F.lit("2024-02-01")).cast("timestamp"))
    return reporting.trends(agg, sets)


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) if t.startswith(("decimal", "date", "timestamp")) else F.col(c) for c, t in df.dtypes])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "work_metrics": lambda s, d: detect.work_metrics(works(s, d), TODAY),
        "peer_groups": lambda s, d: detect.peer_groups(works(s, d)),
        "peer_stats": lambda s, d: detect.peer_stats(works(s, d)),
        "cost_anomaly": lambda s, d: _brief(detect.cost_anomaly(works(s, d), detect.peer_stats(works(s, d)))),
        "progress_gap": lambda s, d: _brief(detect.progress_gap(works(s, d))),
        "delay_signals": lambda s, d: _brief(detect.delay(works(s, d), detect.work_metrics(works(s, d), TODAY))),
        "compliance_findings": lambda s, d: detect.compliance_findings(works(s, d)).select("dataset_id", "id", "kind", "code", "term", "severity"),
        "agency_share": lambda s, d: detect.agency_share(works(s, d)).select("dataset_id", "district", "agency", "agency_total", "agency_works", "district_works", F.round("share_pct", 4).alias("share_pct")),
        "agency_concentration": lambda s, d: _brief(detect.agency_concentration(works(s, d))),
        "quality_issues": lambda s, d: detect.quality_issues(works(s, d)).select("dataset_id", "id", "rule", "field", "severity"),
        "quality_status": lambda s, d: detect.quality_status(works(s, d), detect.quality_issues(works(s, d))),
        "normalize_works": lambda s, d: _raw(s, d).select("dataset_id", "source_row_number", "work_id", "state", "district", "sanctioned_amount", "monetary_unit",
            "physical_progress", "financial_progress", "sanction_date", "completion_date", "expected_duration_days"),
        "validate_works": lambda s, d: imports.validate_works(_raw(s, d)).select("dataset_id", "row_number", "field", "rule", "severity"),
        "valid_works": lambda s, d: imports.to_work(imports.split_valid(_raw(s, d), imports.validate_works(_raw(s, d)))).select("dataset_id", "source_row_number", "work_id", "estimated_cost", "physical_progress", "status"),
        "import_grade": lambda s, d: imports.grade(_raw(s, d), imports.validate_works(_raw(s, d))),
        "issue_summary": lambda s, d: imports.issue_summary(imports.validate_works(_raw(s, d))),
        "import_summary": lambda s, d: imports.import_summary(_raw(s, d), imports.validate_works(_raw(s, d))).select("dataset_id", "total_rows", "error_rows",
            "warning_rows", "kept_rows", "grade", F.array_join("reasons", "; ").alias("reasons")),
        "field_summary": lambda s, d: imports.field_summary(imports.validate_works(_raw(s, d))),
        "quality_report": lambda s, d: imports.quality_report(imports.validate_works(_raw(s, d)), "DS0").select("row_number", "field", "rule", "severity"),
        "records_page": lambda s, d: imports.records(_raw(s, d).select("dataset_id", "source_row_number", "work_id", "state", "district", "sanctioned_amount", "payee"), "DS1", 50, 100),
        "payments": lambda s, d: imports.payments(_raw(s, d)).select(*imports.KEYS, "work_id", "payment_ref", "amount", "unit", "paid_on", "payee", "stage"),
        "legacy_rows": lambda s, d: imports.ingest_rows(views.over_works(s, d, views.LEGACY_WORKS))[0].select(*imports.KEYS, "work_id", "estimated_cost",
            "sanctioned_cost", "financial_progress", "latitude", "sanction_date", "implementing_agency"),
        "legacy_missing": lambda s, d: imports.ingest_rows(views.over_works(s, d, views.LEGACY_WORKS))[1].select("field", F.col("count").alias("n")),
        "import_run": lambda s, d: _imported(s, d)["summary"].select("part", "total_rows", "error_rows", "warning_rows", "kept_rows", "grade", F.array_join("reasons", "; ").alias("reasons"), "notes"),
        "import_works": lambda s, d: _imported(s, d)["records"].select("part", "source_row_number", "work_id", "mp_name", "state", "sanctioned_cost", "latitude", "sanction_date", "status"),
        "import_payments": lambda s, d: _imported(s, d)["payments"].select("part", "source_row_number", "payment_ref", "amount", "unit"),
        "import_issues": lambda s, d: _imported(s, d)["issues"].select("part", "row_number", "field", "rule", "severity"),
        "import_datasets": lambda s, d: _imported(s, d)["datasets"].select("part", "source_type", "version", "dataset_type", "schema_id",
            F.size("detected_columns").alias("n_detected"), F.array_join("unmapped_columns", ",").alias("unmapped")),
        "import_new_files": lambda s, d: _imported(s, d)["new"],
        "digest_ack": lambda s, d: _text(reporting.ack_digest(_digests(s, d), "ASIA", "2030-01-01", 7)),
        "current_dataset": lambda s, d: _text(reporting.current_dataset(_datasets(s, d))),
        "validate_allocation": lambda s, d: imports.validate_allocation(imports.normalize_allocation(views.view(s, d, views.RAW_ALLOCATION))).select("dataset_id", "row_number", "field", "rule", "severity"),
        "validate_aggregate": lambda s, d: imports.validate_aggregate(imports.normalize_aggregate(views.view(s, d, views.RAW_AGGREGATE))).select("dataset_id", "row_number", "field", "rule", "severity"),
        "duplicate_pairs": lambda s, d: _pairs(s, d, REPEATING).select("dataset_id", "a_id", "b_id", "text_similarity", "location_distance_m", "category_match", "time_overlap", "vendor_match", "contextual_confidence", "combined_score"),
        "duplicate_score": lambda s, d: duplicates.duplicate_score(_run(s, d, REPEATING)["pairs"]),
        "duplicate_signals": lambda s, d: _signals(s, d, REPEATING).filter("signal_type = 'DUPLICATE'").select("dataset_id", "project_id", F.element_at("observed",
            "other_id").alias("other_id"), "severity", "contextual_confidence", F.size("evidence").alias("evidence_rows")),
        "ml_features": lambda s, d: _features(s, d).select("dataset_id", "id", *[F.round(c, 3).alias(c) for c in forest.FEATURES]),
        "iforest_scores": lambda s, d: forest.iforest_scores(_features(s, d, BOTH)),
        "ml_signals": lambda s, d: _brief(forest.ml_signals(_run(s, d)["scores"])),
        "signal_counts": lambda s, d: _signals(s, d, REPEATING).groupBy("dataset_id", "signal_type", "severity").agg(F.count(F.lit(1)).alias("n")),
        "evidence_rows": lambda s, d: signals.evidence_rows(_signals(s, d)).groupBy("signal_type").agg(F.count(F.lit(1)).alias("evidence_rows")),
        "priorities": lambda s, d: fusion.fuse(_signals(s, d, BOTH)).select("dataset_id", "project_id", "score", "level", "signal_count", "convergence_bonus", F.array_join("engines", ",").alias("engines")),
        "queue_entry": lambda s, d: evaluate.enters_queue(fusion.fuse(_signals(s, d))).select("dataset_id", "project_id", "level", "enters_queue"),
        "detection_run": lambda s, d: detection.run_record(works(s, d), TODAY).select("dataset_id", "status", "error", F.explode("summary").alias("measure", "n")),
        "queue_top": lambda s, d: reporting.queue(_summary(s, d, text=BOTH))[0].select("work_id", "id", "district", "level", "score", "signal_count", "case_status"),
        "queue_search": lambda s, d: reporting.queue(_summary(s, d), sort="cost", size=50, search="temple", level="critical")[0].select("id", "level", "sanctioned_cost"),
        "dashboard": lambda s, d: (lambda found: reporting.dashboard(_summary(s, d, found), found))(_signals(s, d)),
        "district_rollup": lambda s, d: reporting.district_rollup(_summary(s, d, text=BOTH)),
        "work_timeline": lambda s, d: reporting.work_timeline(works(s, d)),
        "work_detail": lambda s, d: (lambda w: reporting.work_detail(w, _signals(s, d, BOTH), detect.work_metrics(w, TODAY), detect.peer_stats(w), _run(s,
            d, BOTH)["pairs"]).select("dataset_id", "id", "delay_days", "peer_count", F.coalesce(F.size("signals"), F.lit(0)).alias("n_signals"), F.array_join(F.transform("signals",
            lambda x: x["signal_type"]), ",").alias("signals"), F.array_join("related", ",").alias("related"), F.col("why_flagged").isNotNull().alias("flagged")))(register(s, d, BOTH)),
        "case_per_work": lambda s, d: reporting.case_per_work(views.view(s, d, views.CASES)),
        "stakeholder_summary": lambda s, d: reporting.stakeholder_summary(register(s, d, BOTH), _signals(s, d, BOTH), views.view(s, d, views.CASES), "DISTRICT_AUTHORITY", "NATION_1"),
        "headlines": lambda s, d: reporting.headlines(works(s, d), _signals(s, d), "MP 7").select("work_id", "signal_type", "severity"),
        "district_attention": lambda s, d: reporting.district_attention(works(s, d), _signals(s, d)),
        "precision_summary": lambda s, d: reporting.precision_summary(register(s, d, BOTH), _signals(s, d, BOTH), views.view(s, d, views.CASES)),
        "alert_digest": lambda s, d: _text(reporting.alert_digest(_dated(s, d, BOTH), views.view(s, d, views.CASES), "MINISTRY", "2001-01-01")),
        "trends": lambda s, d: _text(_trends(s, d)),
        "open_cases": lambda s, d: cases.open_cases(register(s, d, BOTH), views.view(s, d, views.CASES), fusion.fuse(_signals(s, d, BOTH))),
        "case_replay": lambda s, d: cases.replay_cases(views.view(s, d, views.CASE_EVENTS))[1],
        "case_state": lambda s, d: cases.case_state(views.view(s, d, views.CASE_EVENTS)).withColumn("closed_at", F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss")),
        "verify_chain": lambda s, d: audit.verify_chain(_broken(s, d)),
        "build_chain": lambda s, d: audit.verify_chain(audit.build_chain(_chain(s, d))),
        "case_manifest": _manifest,
        "signal_texts": lambda s, d: _texts(s, d).select("dataset_id", "project_id", "signal_type", "title", "explanation",
            F.explode("evidence").alias("e")).select("dataset_id", "project_id", "signal_type", "title", "explanation", "e.field_name", "e.field_value", "e.reference_value", "e.calculation"),
        "quality_totals": _quality,
        "confusion": lambda s, d: evaluate.by_scenario(_found(s, d, BOTH)),
        "confusion_by_type": lambda s, d: evaluate.by_type(_found(s, d, BOTH)),
        "false_positives": lambda s, d: evaluate.errors(_found(s, d, BOTH), "fp"),
        "false_negatives": lambda s, d: evaluate.errors(_found(s, d), "fn"),
        "pattern_check": lambda s, d: evaluate.patterns(_patterns(s), works(s, d), _signals(s, d)),
    }


_METRICS = f"""
metrics AS (
  SELECT dataset_id, id AS project_id, (financial_progress - physical_progress)::DECIMAL(6,2) AS financial_physical_gap,
    CASE WHEN sanctioned_cost <> 0 THEN round(expenditure::DOUBLE / sanctioned_cost::DOUBLE, 4)::DECIMAL(10,4) END AS expenditure_ratio,
    (coalesce(completion_date, DATE '{TODAY}') - sanction_date)::INT AS elapsed_days, expected_duration_days,
    CASE WHEN expected_duration_days IS NOT NULL AND sanction_date IS NOT NULL THEN greatest(0, (coalesce(completion_date, DATE '{TODAY}') - sanction_date)::INT - expected_duration_days) END AS delay_days
  FROM works)"""
_PEERS = """
pw AS (SELECT dataset_id, district, coalesce(category, 'Uncategorised') AS cat, id, sanctioned_cost AS cost FROM works WHERE sanctioned_cost IS NOT NULL),
others AS (
  SELECT a.dataset_id, a.id, a.cost, count(*) AS n, list_sort(list(b.cost)) AS v, sum(CASE WHEN b.cost <= a.cost THEN 1 ELSE 0 END) AS le
  FROM pw a JOIN pw b ON a.dataset_id = b.dataset_id AND a.district = b.district AND a.cat = b.cat AND a.id <> b.id GROUP BY ALL HAVING count(*) >= 5),
med AS (
  SELECT *, (v[((n - 1) // 2) + 1]::DECIMAL(18,4) + v[(n // 2) + 1]::DECIMAL(18,4)) AS twice, v[round_even(0.75 * (n - 1), 0)::INT + 1] AS p75 FROM others),
peers AS (
  SELECT dataset_id, id AS project_id, n AS peer_count, (twice::DECIMAL(18,4) * 0.5)::DECIMAL(14,2) AS peer_median_cost, p75 AS peer_p75_cost,
    round(le / n * 100, 1)::DECIMAL(5,2) AS peer_percentile, round((cost::DOUBLE - twice::DOUBLE / 2) / (twice::DOUBLE / 2) * 100, 1)::DECIMAL(10,2) AS cost_deviation_pct
  FROM med)"""
_RULES = """
cost_s AS (SELECT dataset_id, project_id, 'COST_ANOMALY' AS signal_type, CASE WHEN cost_deviation_pct >= 60 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM peers WHERE cost_deviation_pct >= 40),
gap_s AS (SELECT dataset_id, id AS project_id, 'FIN_PHYS_GAP' AS signal_type, CASE WHEN financial_progress - physical_progress >= 40 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM works WHERE financial_progress - physical_progress >= 25),
delay_s AS (SELECT dataset_id, project_id, 'DELAY' AS signal_type, CASE WHEN delay_days >= 180 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM metrics WHERE delay_days >= 90)"""
_STAMP = "CASE WHEN created_at = date_trunc('second', created_at) THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') END"
_TEXTS = """
lakh AS (SELECT p.*, sanctioned_cost AS cost, '₹' || printf('%.1f', sanctioned_cost::DOUBLE / 100000) || 'L' AS own, '₹' || printf('%.1f', peer_median_cost::DOUBLE / 100000) || 'L'
  AS mid, '₹' || printf('%.1f', peer_p75_cost::DOUBLE / 100000) || 'L' AS p75,
    printf('%+.0f', cost_deviation_pct::DOUBLE) AS dev FROM peers p JOIN works w ON w.dataset_id = p.dataset_id AND w.id = p.project_id),
signal_text AS MATERIALIZED (
  SELECT s.dataset_id, s.project_id, s.signal_type, s.severity, 'Cost ' || own || ' is ' || dev || '% vs peer median' AS title,
    'The sanctioned cost of ' || own || ' is ' || dev || '% off ' || mid || ', the median of ' || peer_count || ' other works of its district and category; three quarters of them cost ' || p75 || ' at most.' AS explanation,
    '{"sanctioned_cost": "' || cost || '"}' AS observed, '{"peer_median": "' || peer_median_cost || '", "peer_p75": "' || peer_p75_cost || '"}' AS reference, '{"deviation_pct": "' || cost_deviation_pct || '"}' AS difference,
    'sanctioned_cost' AS field_name, own AS field_value, mid AS reference_value,
    '(' || printf('%.0f', cost::DOUBLE) || ' - ' || printf('%.0f', peer_median_cost::DOUBLE) || ') / ' || printf('%.0f', peer_median_cost::DOUBLE) || ' x 100 = ' || printf('%+.1f', cost_deviation_pct::DOUBLE) || '%' AS calculation
  FROM cost_s s JOIN lakh USING (dataset_id, project_id)
  UNION ALL SELECT s.dataset_id, s.project_id, s.signal_type, s.severity, 'Financial vs physical gap ' || printf('%+.0f', gap::DOUBLE) || ' pp',
    printf('%.0f', f::DOUBLE) || '% of the money is spent and ' || printf('%.0f', p::DOUBLE) || '% of the work is done, ' || printf('%+.0f', gap::DOUBLE) || ' points apart.',
    '{"financial_pct": "' || f || '", "physical_pct": "' || p || '"}', '{"expected": "financial = physical progress"}', '{"gap_pp": "' || gap || '"}',
    'progress (financial / physical)', printf('%.0f', f::DOUBLE) || '% / ' || printf('%.0f', p::DOUBLE) || '%', 'financial = physical', printf('%+.0f', gap::DOUBLE) || ' pp'
  FROM gap_s s JOIN (SELECT dataset_id, id AS project_id, financial_progress AS f, physical_progress AS p, (financial_progress - physical_progress)::DECIMAL(6,2) AS gap FROM works) USING (dataset_id, project_id)
  UNION ALL SELECT s.dataset_id, s.project_id, s.signal_type, s.severity, 'Delay of ' || delay_days || ' days',
    elapsed_days || ' days have passed since the sanction of a work that was to take ' || expected_duration_days || ', ' || delay_days || ' days more.',
    '{"elapsed_days": "' || elapsed_days || '"}', '{"expected_days": "' || expected_duration_days || '"}', '{"delay_days": "' || delay_days || '"}',
    'duration (elapsed / expected)', elapsed_days || 'd / ' || expected_duration_days || 'd', expected_duration_days || 'd', elapsed_days || ' - ' || expected_duration_days || ' = +' || delay_days || 'd'
  FROM delay_s s JOIN metrics USING (dataset_id, project_id))"""
_COMPLIANCE = """
texts AS (
  SELECT dataset_id, id, 'CATEGORY' AS kind, trim(array_to_string(regexp_extract_all(lower(description), '[a-z ]+'), ' ')) AS t FROM works
  UNION ALL SELECT dataset_id, id, 'AGENCY', trim(array_to_string(regexp_extract_all(lower(implementing_agency), '[a-z ]+'), ' ')) FROM works WHERE implementing_agency IS NOT NULL),
terms AS (SELECT * FROM (VALUES
  ('CATEGORY', 1, 'RELIGIOUS_STRUCTURE', 'temple', 'CRITICAL'), ('CATEGORY', 2, 'RELIGIOUS_STRUCTURE', 'shrine', 'CRITICAL'), ('CATEGORY', 3, 'REPAIR_UNPERMITTED', 'repair work', 'MEDIUM'),
  ('CATEGORY', 4, 'OFFICE_BUILDING', 'office building', 'HIGH'), ('AGENCY', 1, 'UNAPPROVED_TRUST', 'trust', 'MEDIUM')) AS x(kind, k, code, term, severity)),
compliance AS (
  SELECT dataset_id, id, kind, arg_min(code, k) AS code, arg_min(term, k) AS term, arg_min(severity, k) AS severity
  FROM texts JOIN terms USING (kind) WHERE regexp_matches(t, '\\b' || term || '\\b') GROUP BY ALL)"""
_AGENCY = """
av AS MATERIALIZED (SELECT dataset_id, district, id, sanctioned_cost AS c, trim(coalesce(implementing_agency, '')) AS agency FROM works WHERE sanctioned_cost > 0),
ag AS (SELECT dataset_id, district, agency, sum(c) AS agency_total, count(*) AS agency_works FROM av WHERE agency <> '' GROUP BY ALL),
di AS (SELECT dataset_id, district, sum(c) AS district_total, count(*) AS district_works FROM av GROUP BY ALL),
shares AS (SELECT ag.*, district_total, district_works, agency_total::DOUBLE / district_total::DOUBLE * 100 AS share_pct FROM ag JOIN di USING (dataset_id, district)),
agency_s AS (
  SELECT av.dataset_id, id AS project_id, 'AGENCY_CONCENTRATION' AS signal_type, CASE WHEN share_pct >= 60 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
  FROM av JOIN shares USING (dataset_id, district, agency) WHERE share_pct >= 40 AND district_works >= 4 AND agency_works >= 2)"""
_QUALITY = """
again AS (SELECT dataset_id, id FROM (SELECT dataset_id, id, row_number() OVER (PARTITION BY dataset_id, work_id ORDER BY source_row_number, id) AS n FROM works) WHERE n > 1),
quality AS (
  SELECT dataset_id, id, 'completion_before_sanction' AS rule, 'completion_date' AS field, 'HIGH' AS severity FROM works WHERE completion_date < sanction_date
  UNION ALL SELECT dataset_id, id, 'expenditure_above_sanctioned', 'expenditure', 'HIGH' FROM works WHERE expenditure > sanctioned_cost
  UNION ALL SELECT dataset_id, id, 'progress_above_100', 'financial_progress', 'MEDIUM' FROM works WHERE financial_progress > 100
  UNION ALL SELECT dataset_id, id, 'progress_above_100', 'physical_progress', 'MEDIUM' FROM works WHERE physical_progress > 100
  UNION ALL SELECT dataset_id, id, 'missing_mandatory', 'mp_name', 'LOW' FROM works WHERE mp_name IS NULL
  UNION ALL SELECT dataset_id, id, 'missing_mandatory', 'category', 'LOW' FROM works WHERE category IS NULL
  UNION ALL SELECT dataset_id, id, 'missing_mandatory', 'expenditure', 'LOW' FROM works WHERE expenditure IS NULL
  UNION ALL SELECT dataset_id, id, 'missing_mandatory', 'location_text', 'LOW' FROM works WHERE location_text IS NULL
  UNION ALL SELECT dataset_id, id, 'missing_mandatory', 'latitude', 'LOW' FROM works WHERE latitude IS NULL
  UNION ALL SELECT dataset_id, id, 'missing_mandatory', 'expected_duration_days', 'LOW' FROM works WHERE expected_duration_days IS NULL
  UNION ALL SELECT dataset_id, id, 'duplicate_work_id', 'work_id', 'HIGH' FROM again
  UNION ALL SELECT dataset_id, id, 'invalid_numeric', 'sanctioned_cost', 'MEDIUM' FROM works WHERE sanctioned_cost < 0)"""
_FEATURES = """
f AS (
  SELECT w.dataset_id, w.id, CASE WHEN peer_median_cost <> 0 THEN round(sanctioned_cost::DOUBLE / peer_median_cost::DOUBLE, 6) END AS cost_ratio, financial_physical_gap::DOUBLE AS gap, delay_days::DOUBLE AS delay,
    expenditure_ratio::DOUBLE AS expenditure_ratio, s::DOUBLE AS duplicate_score FROM works w LEFT JOIN metrics m ON m.dataset_id = w.dataset_id AND m.project_id = w.id
    LEFT JOIN peers p ON p.dataset_id = w.dataset_id AND p.project_id = w.id LEFT JOIN dup d ON d.dataset_id = w.dataset_id AND d.project_id = w.id),
imputed AS (SELECT dataset_id, id, """ + ", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY dataset_id), 0) AS {c}" for c in forest.FEATURES) + " FROM f)"


def _forest() -> str:
    """Isolation forests level by level: sampled rows go down with the drawn cuts (rN), nodes are what their rows make them (nN),
    then all rows go down the finished trees (pN)."""
    drawn = lambda key: f"(('0x' || substr(md5('{forest.SEED}:' || tree || ':' || node || ':{key}'), 1, 13))::BIGINT / {float(1 << 52)}::DOUBLE)"
    rest = lambda n: f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1 ELSE 0 END"
    each = range(1, len(forest.FEATURES) + 1)
    parts = [f"""
pool AS MATERIALIZED (SELECT dataset_id, id, [{", ".join(forest.FEATURES)}] AS v, count(*) OVER (PARTITION BY dataset_id) AS n, row_number() OVER (PARTITION BY dataset_id ORDER BY md5(id), id) - 1 AS at FROM imputed),
r0 AS MATERIALIZED (
  SELECT d.dataset_id, tree, 1::BIGINT AS node, v FROM (SELECT DISTINCT dataset_id, n FROM pool WHERE n >= {forest.MIN_ROWS}) d, range({forest.TREES}) t(tree), range({forest.SAMPLE}) k(k), pool p
  WHERE k < d.n AND p.dataset_id = d.dataset_id AND p.at = (tree * {forest.SAMPLE} + k) % d.n)"""]  # fmt: skip
    levels = 8  # the depth for SAMPLE rows
    for k in range(levels):
        parts.append(f"""
n{k} AS MATERIALIZED (
  SELECT *, lo[feature] + {drawn("c")} * (hi[feature] - lo[feature]) AS cut FROM (
    SELECT *, CASE WHEN c > 1 AND len(vary) > 0 THEN vary[1 + floor({drawn("f")} * len(vary))::INT] END AS feature FROM (
      SELECT *, list_filter({list(each)}, lambda i: hi[i] > lo[i]) AS vary FROM (
        SELECT dataset_id, tree, node, count(*) AS c, [{", ".join(f"min(v[{i}])" for i in each)}] AS lo, [{", ".join(f"max(v[{i}])" for i in each)}] AS hi FROM r{k} GROUP BY ALL)))),
r{k + 1} AS MATERIALIZED (SELECT r.dataset_id, r.tree, 2 * r.node + CASE WHEN v[feature] < cut THEN 0 ELSE 1 END AS node, v FROM r{k} r JOIN n{k} USING (dataset_id, tree, node) WHERE feature IS NOT NULL)""")
    nodes = [f"SELECT dataset_id, tree, node, feature, cut, {k} + {rest('c')} AS leaf FROM n{k}" for k in range(levels)]
    nodes.append(f"SELECT dataset_id, tree, node, NULL, NULL, {levels} + {rest('c')} FROM (SELECT dataset_id, tree, node, count(*) AS c FROM r{levels} GROUP BY ALL)")
    parts.append("\nnodes AS MATERIALIZED (" + "\n  UNION ALL ".join(nodes) + ")")
    parts.append(f"\np0 AS (SELECT dataset_id, id, v, tree, 1::BIGINT AS node FROM pool, range({forest.TREES}) t(tree))")
    for k in range(levels):
        parts.append(f"\np{k + 1} AS (SELECT p.dataset_id, p.id, p.v, p.tree, CASE WHEN feature IS NULL THEN p.node ELSE 2 * p.node + CASE WHEN v[feature] < cut THEN 0 "
            f"ELSE 1 END END AS node FROM p{k} p JOIN nodes USING (dataset_id, tree, node))")
    parts.append(f"""
outliers AS MATERIALIZED (
  SELECT dataset_id, id AS project_id, round({-forest.OFFSET} - pow(2, -d / {forest.TREES} / ({rest("least(n, " + str(forest.SAMPLE) + ")")})), 4) AS ml_anomaly_score
  FROM (SELECT p.dataset_id, p.id, sum(leaf) AS d FROM p{levels} p JOIN nodes USING (dataset_id, tree, node) GROUP BY ALL) JOIN pool USING (dataset_id, id)),
ml_s AS (SELECT dataset_id, project_id, 'ML_ANOMALY' AS signal_type, CASE WHEN ml_anomaly_score <= {ANOMALY_HIGH} THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM outliers WHERE ml_anomaly_score < {ANOMALY_TRIGGER})""")
    return ",".join(parts)


_SIGNALS = """
dup_s AS MATERIALIZED (
  SELECT dataset_id, unnest([a_id, b_id]) AS project_id, unnest([b_id, a_id]) AS other_id, 'DUPLICATE' AS signal_type, CASE band WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN 'MEDIUM' ELSE 'LOW' END AS severity, band FROM pairs),
signals AS MATERIALIZED (
  SELECT *, 'RULE' AS src, NULL AS band FROM cost_s UNION ALL SELECT *, 'RULE', NULL FROM gap_s UNION ALL SELECT *, 'RULE', NULL FROM delay_s UNION ALL SELECT *, 'RULE', NULL FROM agency_s
  UNION ALL SELECT dataset_id, id, 'COMPLIANCE', severity, 'RULE', NULL FROM compliance UNION ALL SELECT dataset_id, id, 'DATA_QUALITY', severity, 'DATA_QUALITY', NULL FROM quality
  UNION ALL SELECT dataset_id, project_id, signal_type, severity, 'NLP', band FROM dup_s UNION ALL SELECT *, 'ML', NULL FROM ml_s),
prio AS (
  SELECT dataset_id, project_id, sum(round(
      CASE signal_type WHEN 'FIN_PHYS_GAP' THEN 3.0 WHEN 'COST_ANOMALY' THEN 3.0 WHEN 'COMPLIANCE' THEN 3.5 WHEN 'DUPLICATE' THEN 2.5 WHEN 'DELAY' THEN 2.0 WHEN 'AGENCY_CONCENTRATION' THEN 1.5 WHEN 'ML_ANOMALY' THEN 1.5 ELSE 1.0 END
      * CASE severity WHEN 'LOW' THEN 0.5 WHEN 'MEDIUM' THEN 1.0 WHEN 'HIGH' THEN 1.5 ELSE 2.0 END * CASE WHEN band IN ('low', 'unavailable') THEN 0.6 ELSE 1.0 END, 2))::DECIMAL(12,2) AS own, count(*) AS signal_count,
    list_sort(list(DISTINCT src) FILTER (src <> 'DATA_QUALITY')) AS engines FROM signals GROUP BY ALL),
bonus AS (SELECT *, CASE WHEN len(engines) >= 3 THEN 3 WHEN len(engines) = 2 THEN 1.5 ELSE 0 END::DECIMAL(4,2) AS convergence_bonus FROM prio),
scored_works AS (SELECT *, (own + convergence_bonus)::DECIMAL(12,2) AS score FROM bonus),
priorities AS MATERIALIZED (SELECT *, CASE WHEN score < 2 THEN 'LOW' WHEN score < 4.5 THEN 'MEDIUM' WHEN score < 7 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM scored_works)"""
_CASE1 = """first_case AS (SELECT project_id, arg_min(status, (opened_at, case_id)) AS case_status FROM cases GROUP BY project_id)"""
_SUMMARY = """
summary AS (
  SELECT w.dataset_id, w.id, work_id, w.district, description, implementing_agency, sanctioned_cost, score, level, signal_count, case_status
  FROM works w LEFT JOIN priorities p ON p.dataset_id = w.dataset_id AND p.project_id = w.id LEFT JOIN first_case c ON c.project_id = w.id)"""
_RAW = """
norm AS (
  SELECT dataset_id, source_row_number, CASE WHEN lower(trim(work_id)) IN ('n/a', '-', 'nil') THEN NULL ELSE trim(work_id) END AS work_id, trim(state) AS state,
    CASE WHEN trim(district) = '-' THEN NULL ELSE trim(district) END AS district, trim(description) AS description, estimated_cost::DECIMAL(20,4) AS estimated_cost,
    CASE WHEN sanctioned_amount = 'nil' THEN NULL ELSE replace(replace(sanctioned_amount, '₹ ', ''), ' Lakh', '')::DECIMAL(20,4) END AS sanctioned_amount,
    CASE WHEN sanctioned_amount LIKE '%Lakh' THEN 'LAKH' ELSE 'RUPEE' END AS monetary_unit, expenditure::DECIMAL(20,4) AS expenditure,
    replace(physical_progress, '%', '')::DECIMAL(20,4) AS physical_progress, replace(financial_progress, ' %', '')::DECIMAL(20,4) AS financial_progress,
    coalesce(try_strptime(sanction_date, '%Y-%m-%d'), try_strptime(sanction_date, '%d/%m/%Y'))::DATE AS sanction_date, completion_date::DATE AS completion_date,
    expected_duration_days::BIGINT AS expected_duration_days, latitude::DECIMAL(12,7) AS latitude, longitude::DECIMAL(12,7) AS longitude, status FROM raw_works),
issues AS (
  SELECT dataset_id, source_row_number AS row_number, 'work_id' AS field, 'missing_work_id' AS rule, 'ERROR' AS severity FROM norm WHERE work_id IS NULL
  UNION ALL SELECT dataset_id, source_row_number, 'district', 'missing_district', 'ERROR' FROM norm WHERE district IS NULL
  UNION ALL SELECT dataset_id, source_row_number, 'sanctioned_amount', 'negative_amount', 'ERROR' FROM norm WHERE sanctioned_amount < 0
  UNION ALL SELECT dataset_id, source_row_number, 'sanctioned_amount', 'missing_sanctioned_amount', 'ERROR' FROM norm WHERE sanctioned_amount IS NULL
  UNION ALL SELECT dataset_id, source_row_number, 'sanctioned_amount', 'invalid_numeric', 'ERROR' FROM norm WHERE sanctioned_amount <= 0
  UNION ALL SELECT dataset_id, source_row_number, 'expenditure', 'expenditure_above_sanctioned', 'WARNING' FROM norm WHERE sanctioned_amount > 0 AND expenditure > sanctioned_amount
  UNION ALL SELECT dataset_id, source_row_number, 'physical_progress', 'progress_out_of_range', 'ERROR' FROM norm WHERE physical_progress NOT BETWEEN 0 AND 100
  UNION ALL SELECT dataset_id, source_row_number, 'financial_progress', 'progress_out_of_range', 'ERROR' FROM norm WHERE financial_progress NOT BETWEEN 0 AND 100
  UNION ALL SELECT dataset_id, source_row_number, 'completion_date', 'invalid_date_order', 'WARNING' FROM norm WHERE completion_date < sanction_date
  UNION ALL SELECT dataset_id, source_row_number, 'latitude', 'invalid_coordinates', 'WARNING' FROM norm WHERE latitude NOT BETWEEN -90 AND 90
  UNION ALL SELECT dataset_id, source_row_number, 'work_id', 'duplicate_work_id', 'ERROR' FROM (
    SELECT *, min(source_row_number) OVER (PARTITION BY dataset_id, work_id) AS f FROM norm WHERE work_id IS NOT NULL) WHERE source_row_number > f)"""
_FILES = f"""
exports AS (
  SELECT * REPLACE ((source_row_number % {views.FILES})::VARCHAR AS dataset_id, row_number() OVER (PARTITION BY source_row_number % {views.FILES} ORDER BY source_row_number) AS source_row_number) FROM raw_works)"""
_IMPORTED = _RAW.replace("FROM raw_works", "FROM exports")
_VALID = "NOT EXISTS (SELECT 1 FROM issues i WHERE i.severity = 'ERROR' AND i.dataset_id = n.dataset_id AND i.row_number = n.source_row_number)"
_PAID = """
paid AS (
  SELECT dataset_id, source_row_number, trim(payment_ref) AS payment_ref, replace(payment_amount, ' Lakh', '')::DECIMAL(14,2) AS amount, CASE WHEN payment_amount LIKE '%Lakh' THEN 'LAKH' ELSE 'RUPEE' END AS unit,
    paid_on::DATE AS paid_on, payee, regexp_replace(payment_stage, ' +', ' ', 'g') AS stage FROM {rows} WHERE payment_amount <> 'pending')"""
_LEGACY = """
legacy AS (
  SELECT dataset_id, source_row_number, nullif(trim(workid), '') AS work_id, district, replace(estimated_cost, '₹ ', '')::DECIMAL(30,4) AS estimated_cost,
    CASE WHEN sanctioned_cost = 'nil' THEN NULL WHEN sanctioned_cost LIKE '% L' THEN replace(sanctioned_cost, ' L', '')::DECIMAL(20,4) * 100000
      WHEN sanctioned_cost LIKE '%cr' THEN replace(replace(sanctioned_cost, '₹', ''), 'cr', '')::DECIMAL(20,4) * 10000000 ELSE sanctioned_cost::DECIMAL(20,4) END::DECIMAL(30,4) AS sanctioned_cost,
    financial_progress::DECIMAL(30,4) AS financial_progress, physical_progress::DECIMAL(30,4) AS physical_progress, latitude_dd::DECIMAL(20,4)::DECIMAL(30,4) AS latitude, sanction_date::DATE AS sanction_date FROM legacy_works)"""
_SUMMED = """t AS (SELECT dataset_id, count(*) AS total_rows FROM norm GROUP BY ALL),
b AS (SELECT dataset_id, count(DISTINCT row_number) FILTER (severity = 'ERROR') AS error_rows, count(DISTINCT row_number) FILTER (severity = 'WARNING') AS warning_rows FROM issues GROUP BY ALL),
c AS (SELECT dataset_id, rule, severity, count(*) AS n, count(*) || CASE WHEN count(*) = 1 THEN ' record with ' ELSE ' records with ' END || replace(rule, '_', ' ') AS reason FROM issues GROUP BY dataset_id, rule, severity),
r AS (SELECT dataset_id, string_agg(reason, '; ' ORDER BY n DESC, rule, reason) AS reasons FROM c GROUP BY ALL),
summed AS (
  SELECT t.dataset_id, total_rows, coalesce(error_rows, 0) AS error_rows, coalesce(warning_rows, 0) AS warning_rows, total_rows - coalesce(error_rows, 0) AS kept_rows,
    CASE WHEN error_rows IS NULL OR error_rows = 0 AND warning_rows = 0 THEN 'GOOD' WHEN error_rows / total_rows <= 0.02 AND warning_rows / total_rows <= 0.15 THEN 'ACCEPTABLE'
      WHEN error_rows / total_rows <= 0.1 THEN 'DEGRADED' ELSE 'FAILED' END AS grade,
    coalesce(reasons, '') AS reasons FROM t LEFT JOIN b USING (dataset_id) LEFT JOIN r USING (dataset_id))"""
_TOKENS = """
tok AS (
  SELECT dataset_id, id, list_filter(string_split_regex(regexp_replace(lower(description), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2 AND w NOT IN
    ('construction', 'of', 'providing', 'at', 'the', 'and', 'in', 'to', 'renovation', 'upgradation', 'facility', 'work', 'works', 'building')) AS w FROM works),
tf AS (
  SELECT dataset_id, id, term, count(*) AS tf FROM (SELECT dataset_id, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tok) GROUP BY ALL),
dn AS (SELECT dataset_id, count(*) AS n FROM works GROUP BY ALL), df AS (SELECT dataset_id, term, count(*) AS df FROM tf GROUP BY ALL),
raw_w AS (SELECT dataset_id, id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (dataset_id, term) JOIN dn USING (dataset_id)),
vec AS (SELECT dataset_id, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY dataset_id, id)) AS w FROM raw_w),
pos AS (SELECT dataset_id, id, latitude::DOUBLE AS lat, longitude::DOUBLE AS lon FROM works),
near AS (
  SELECT a.dataset_id, a.id AS a_id, b.id AS b_id, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS m
  FROM pos a JOIN pos b ON a.dataset_id = b.dataset_id AND b.lat BETWEEN a.lat - 0.02 AND a.lat + 0.02 AND a.id < b.id AND abs(a.lon - b.lon) < 0.05),
lost AS (SELECT dataset_id, id FROM pos WHERE lat IS NULL),
cos_lost AS (
  SELECT dataset_id, least(x.id, y.id) AS a_id, greatest(x.id, y.id) AS b_id, sum(x.w * y.w) AS t
  FROM (SELECT vec.* FROM vec JOIN lost USING (dataset_id, id)) x JOIN vec y USING (dataset_id, term) WHERE x.id <> y.id GROUP BY dataset_id, x.id, y.id HAVING sum(x.w * y.w) >= 0.25),
cos_near AS (SELECT n.dataset_id, a_id, b_id, sum(x.w * y.w) AS t FROM near n JOIN vec x ON x.dataset_id = n.dataset_id AND x.id = a_id JOIN vec y ON y.dataset_id = n.dataset_id
  AND y.id = b_id AND y.term = x.term WHERE m <= 2000 GROUP BY n.dataset_id, a_id, b_id HAVING sum(x.w * y.w) >= 0.25),
cand AS (SELECT dataset_id, a_id, b_id, max(t) AS t FROM (SELECT * FROM cos_lost UNION ALL SELECT * FROM cos_near) GROUP BY ALL),
vend AS (
  SELECT dataset_id, id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce(implementing_agency, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN
    ('sri', 'smt', 'private', 'limited', 'ltd', 'pvt', 'and', 'the', 'co', 'company', 'enterprises', 'contractors', 'constructions', 'builders', 'works', 'agency', 'division', 'department', 'engineering'))) AS v FROM works),
facts AS (
  SELECT c.*, m, 1 - abs(a.sanctioned_cost::DOUBLE - b.sanctioned_cost::DOUBLE) / greatest(a.sanctioned_cost::DOUBLE, b.sanctioned_cost::DOUBLE) AS cs, coalesce(a.category = b.category, false) AS cm,
    coalesce(coalesce(a.start_date, a.sanction_date) <= coalesce(b.completion_date, DATE '9999-12-31') AND coalesce(b.start_date, b.sanction_date) <= coalesce(a.completion_date, DATE '9999-12-31'), false) AS ov,
    CASE WHEN len(va.v) > 0 AND len(vb.v) > 0 THEN len(list_intersect(va.v, vb.v)) / least(len(va.v), len(vb.v)) >= 0.5 END AS vm
  FROM cand c JOIN works a ON a.dataset_id = c.dataset_id AND a.id = a_id JOIN works b ON b.dataset_id = c.dataset_id AND b.id = b_id LEFT JOIN near n ON n.dataset_id = c.dataset_id AND n.a_id = c.a_id AND n.b_id = c.b_id
    JOIN vend va ON va.dataset_id = c.dataset_id AND va.id = c.a_id JOIN vend vb ON vb.dataset_id = c.dataset_id AND vb.id = c.b_id),
scored AS (
  SELECT *, round(least(1.0, CASE WHEN m IS NOT NULL THEN base + greatest(0, 1 - least(m, 2000) / 2000) * 0.25 ELSE base / 0.75 END), 4) AS score
  FROM (SELECT *, 0.4 * t + 0.2 * cs + CASE WHEN cm THEN 0.1 ELSE 0 END + CASE WHEN ov THEN 0.05 ELSE 0 END AS base FROM facts)),
pairs AS (
  SELECT *, CASE WHEN m IS NULL AND vm IS NULL THEN 'unavailable' WHEN m > 50 OR NOT vm THEN 'low' WHEN m <= 50 AND vm THEN 'high' ELSE 'medium' END AS band FROM scored WHERE score >= 0.6),
dup AS (SELECT dataset_id, project_id, max(score) AS s FROM (SELECT dataset_id, a_id AS project_id, score FROM pairs UNION ALL SELECT dataset_id, b_id, score FROM pairs) GROUP BY ALL)"""
_CHAIN = """c AS (
  SELECT chain_id, n, sha256('{"action":"' || action || '","actor_id":"officer","created_at":"' || own || '","entity_id":"' ||
    chain_id || '","entity_type":"\\"case\\"\\u001f","payload":{"a":{"x":"\\u000b","y":1.5},"n":' || own || '},"prev_hash":"' || repeat('0', 64) || '","seq":1}') AS hash FROM e WHERE n = 1
  UNION ALL SELECT e.chain_id, e.n, sha256('{"action":"' || action || '","actor_id":"officer","created_at":"' || own || '","entity_id":"' ||
    e.chain_id || '","entity_type":"\\"case\\"\\u001f","payload":{"a":{"x":"\\u000b","y":1.5},"n":' || own || '},"prev_hash":"' || hash || '","seq":' || e.n || '}')
  FROM c JOIN e ON e.chain_id = c.chain_id AND e.n = c.n + 1)"""
_FOUND = """
truth AS ({truth}),
kinds AS (SELECT dataset_id, project_id AS id, list(DISTINCT signal_type) AS kinds FROM signals WHERE signal_type <> 'DATA_QUALITY' GROUP BY ALL),
found AS (
  SELECT w.dataset_id, w.id, kinds IS NOT NULL AS flagged, coalesce(injected, false) AS injected, anomaly_type, coalesce(list_contains(kinds, expected_detector), false) AS hit
  FROM works w LEFT JOIN kinds USING (dataset_id, id) LEFT JOIN truth t ON t.record_id = w.id)"""
_RATES = """round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(fp / nullif(fp + tn, 0), 4) AS fpr,
  CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0) END AS f1"""


#: With more datasets DuckDB joins texts with texts before it looks at places. For BOTH the terms of near works are a table, from which it goes on.
_MET = (
    "cos_near AS (SELECT n.dataset_id, a_id, b_id, sum(x.w * y.w) AS t FROM near n JOIN vec x ON x.dataset_id = n.dataset_id AND x.id = a_id JOIN vec y ON y.dataset_id = n.dataset_id\n"
        "  AND y.id = b_id AND y.term = x.term WHERE m <= 2000 GROUP BY n.dataset_id, a_id, b_id",
    "met AS MATERIALIZED (SELECT n.dataset_id, a_id, b_id, x.term, x.w FROM near n JOIN vec x ON x.dataset_id = n.dataset_id AND x.id = a_id WHERE m <= 2000),\n"
        "cos_near AS (SELECT x.dataset_id, a_id, b_id, sum(x.w * y.w) AS t FROM met x JOIN vec y ON y.dataset_id = x.dataset_id AND y.id = b_id AND y.term = x.term GROUP BY x.dataset_id, a_id, b_id",
)


def _with(*parts: str, text: str = WORKS) -> str:
    """WITH works AS (...), and the parts."""
    views_ = {"raw_works": views.RAW_WORKS, "legacy_works": views.LEGACY_WORKS, "cases": views.CASES, "events_": views.CASE_EVENTS}
    heads = [f"works AS MATERIALIZED ({views.sql(text)})"]
    heads += [f"{n} AS ({views.sql(t).replace('FROM (' + views.sql(views.WORKS) + ') w', 'FROM works w')})" for n, t in views_.items() if any(n in p for p in parts)]
    own = [p.replace(*_MET).replace("\nvec AS (", "\nvec AS MATERIALIZED (").replace("\nnear AS (", "\nnear AS MATERIALIZED (") if text == BOTH else p for p in parts[:-1]]
    return "WITH " + ",\n".join([*heads, *[p.strip() for p in own]]) + "\n" + parts[-1]


def oracle_sql() -> dict[str, str]:
    outliers = _forest()
    rules = (_METRICS, _PEERS, _RULES, _COMPLIANCE, _AGENCY, _QUALITY, _TOKENS, _FEATURES, outliers, _SIGNALS)
    brief = "SELECT dataset_id, project_id, signal_type, severity FROM "
    rank = "CASE level WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 9 END"
    srank = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
    found = _FOUND.format(truth=views.sql(views.TRUTH))
    counts = "count(*) FILTER (injected AND flagged) AS tp, count(*) FILTER (NOT injected AND flagged) AS fp, count(*) FILTER (NOT injected AND NOT flagged) AS tn, count(*) FILTER (injected AND NOT flagged) AS fn"
    return {
        "work_metrics": _with(_METRICS, "SELECT * FROM metrics"),
        "peer_groups": _with("SELECT dataset_id, district, coalesce(category, 'Uncategorised') AS peer_category, count(*) AS members FROM works WHERE sanctioned_cost IS NOT NULL GROUP BY ALL HAVING count(*) >= 6"),
        "peer_stats": _with(_PEERS, "SELECT * FROM peers"),
        "cost_anomaly": _with(_METRICS, _PEERS, _RULES, brief + "cost_s"),
        "progress_gap": _with(_METRICS, _PEERS, _RULES, brief + "gap_s"),
        "delay_signals": _with(_METRICS, _PEERS, _RULES, brief + "delay_s"),
        "compliance_findings": _with(_COMPLIANCE, "SELECT dataset_id, id, kind, code, term, severity FROM compliance"),
        "agency_share": _with(_AGENCY, "SELECT dataset_id, district, agency, agency_total, agency_works, district_works, round(share_pct, 4) AS share_pct FROM shares"),
        "agency_concentration": _with(_AGENCY, brief + "agency_s"),
        "quality_issues": _with(_QUALITY, "SELECT * FROM quality"),
        "quality_status": _with(_QUALITY, """t AS (SELECT dataset_id, count(*) AS total_rows FROM works GROUP BY ALL), q AS (SELECT dataset_id, count(DISTINCT id) AS rows_with_issues, count(*) AS total_issues FROM quality GROUP BY ALL)""",
            "SELECT dataset_id, total_rows, coalesce(rows_with_issues, 0) AS rows_with_issues, coalesce(total_issues, 0) AS total_issues, "
                "CASE WHEN coalesce(total_issues, 0) = 0 THEN 'VALID' WHEN total_issues < greatest(3, total_rows * 0.2) THEN 'VALID_WITH_WARNINGS' "
                "ELSE 'INVALID' END AS quality_status FROM t LEFT JOIN q USING (dataset_id)"),
        "normalize_works": _with(_RAW, "SELECT dataset_id, source_row_number, work_id, state, district, sanctioned_amount, monetary_unit, physical_progress, "
            "financial_progress, sanction_date, completion_date, expected_duration_days FROM norm, (SELECT 1 FROM raw_works LIMIT 1)"),
        "validate_works": _with(_RAW, "SELECT * FROM issues -- raw_works"),
        "valid_works": _with(_RAW, "SELECT dataset_id, source_row_number, work_id, coalesce(estimated_cost, sanctioned_amount)::DECIMAL(14,2) AS estimated_cost, "
            "coalesce(physical_progress, 0)::DECIMAL(5,2) AS physical_progress, coalesce(status, 'Unknown') AS status FROM norm n WHERE NOT EXISTS (SELECT 1 FROM issues i "
            "WHERE i.severity = 'ERROR' AND i.dataset_id = n.dataset_id AND i.row_number = n.source_row_number) -- raw_works"),
        "import_grade": _with(_RAW,
            """t AS (SELECT dataset_id, count(*) AS total_rows FROM norm GROUP BY ALL), b AS (SELECT dataset_id, count(DISTINCT row_number) FILTER (severity = 'ERROR') AS error_rows, count(DISTINCT row_number) FILTER (severity = 'WARNING') AS warning_rows FROM issues GROUP BY ALL)""",
            "SELECT dataset_id, total_rows, error_rows, warning_rows, CASE WHEN error_rows = 0 AND warning_rows = 0 THEN 'GOOD' WHEN error_rows / total_rows <= "
                "0.02 AND warning_rows / total_rows <= 0.15 THEN 'ACCEPTABLE' WHEN error_rows / total_rows <= 0.1 THEN 'DEGRADED' ELSE 'FAILED' END AS grade FROM t "
                "JOIN b USING (dataset_id) -- raw_works"),
        "issue_summary": _with(_RAW, "SELECT dataset_id, rule, severity, count(*) AS issues, count(DISTINCT row_number) AS rows, count(*) || "
            "CASE WHEN count(*) = 1 THEN ' record with ' ELSE ' records with ' END || replace(rule, '_', ' ') AS reason FROM issues GROUP BY dataset_id, rule, severity -- raw_works"),
        "import_summary": _with(_RAW, _SUMMED, "SELECT * FROM summed -- raw_works"),
        "payments": _with(_RAW, _PAID.format(rows="raw_works"), "SELECT dataset_id, source_row_number, work_id, payment_ref, amount, unit, paid_on, payee, stage FROM paid JOIN norm USING (dataset_id, source_row_number)"),
        "legacy_rows": _with(_LEGACY, "SELECT dataset_id, source_row_number, work_id, estimated_cost, sanctioned_cost, financial_progress, latitude, sanction_date, "
            "NULL::VARCHAR AS implementing_agency FROM legacy WHERE work_id IS NOT NULL AND district IS NOT NULL AND sanctioned_cost IS NOT NULL AND physical_progress IS NOT NULL"),
        "legacy_missing": _with(_LEGACY, "SELECT field, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field FROM legacy "
            f"WHERE {c} IS NULL" for c in ("work_id", "district", "estimated_cost", "sanctioned_cost", "financial_progress", "physical_progress")) + ") GROUP BY field"),
        "import_run": _with(_FILES, _IMPORTED, _SUMMED, "SELECT dataset_id AS part, * EXCLUDE (dataset_id), 0::BIGINT AS notes FROM summed"),
        "import_works": _with(_FILES, _IMPORTED, f"SELECT dataset_id AS part, source_row_number, work_id, mp_name, n.state, sanctioned_amount::DECIMAL(14,2) AS "
            f"sanctioned_cost, n.latitude::DECIMAL(10,7) AS latitude, n.sanction_date, coalesce(n.status, 'Unknown') AS status FROM norm n "
            f"JOIN (SELECT dataset_id, source_row_number, mp_name FROM exports) USING (dataset_id, source_row_number) WHERE {_VALID}"),
        "import_payments": _with(_FILES, _IMPORTED, _PAID.format(rows="exports"), f"SELECT dataset_id AS part, source_row_number, payment_ref, amount, unit FROM paid n WHERE {_VALID}"),
        "import_issues": _with(_FILES, _IMPORTED, "SELECT dataset_id AS part, * EXCLUDE (dataset_id) FROM issues"),
        "import_datasets": _with(_FILES, "SELECT DISTINCT dataset_id AS part, 'OFFICIAL_FILE_UPLOAD' AS source_type, 'import-001' AS version, 'WORK_LEVEL' AS "
            "dataset_type, 'work_level_v1' AS schema_id, 28::INT AS n_detected, 'Remarks' AS unmapped FROM exports"),
        "import_new_files": _with(_FILES, "SELECT DISTINCT dataset_id AS part FROM exports WHERE dataset_id::INT >= 8"),
        "digest_ack": _with("SELECT state AS role, CASE WHEN state = 'ASIA' THEN 7 ELSE count(*) END AS last_seen_seq, CASE WHEN state = 'ASIA' THEN '2030-01-01 "
            "00:00:00' ELSE strftime(max(sanction_date), '%Y-%m-%d %H:%M:%S') END AS cutoff FROM works GROUP BY state"),
        "current_dataset": _with("SELECT dataset_id, strftime(max(sanction_date), '%Y-%m-%d %H:%M:%S') AS ingested_at, strftime(min(sanction_date), '%Y-%m-%d "
            "%H:%M:%S') AS created_at, 'WORK_LEVEL' AS dataset_type FROM works GROUP BY dataset_id ORDER BY ingested_at DESC, created_at DESC, dataset_id LIMIT 1"),
        "field_summary": _with(_RAW, "SELECT dataset_id, field, count(*) FILTER (rule LIKE 'missing\\_%' ESCAPE '\\') AS missing, count(*) FILTER (regexp_matches(rule, "
            "'^(invalid|negative|progress|implausible)_')) AS invalid, count(*) FILTER (rule LIKE 'duplicate\\_%' ESCAPE '\\') AS duplicates FROM issues GROUP BY dataset_id, field "
            "-- raw_works"),
        "quality_report": _with(_RAW, "SELECT row_number, field, rule, severity FROM issues WHERE dataset_id = 'DS0' ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN "
            "'WARNING' THEN 1 ELSE 2 END, row_number, rule, field LIMIT 200 -- raw_works"),
        "quality_totals": _with(_RAW, _QUALITY, """q AS (SELECT dataset_id, count(*) AS n FROM quality GROUP BY ALL),
            fields AS (SELECT dataset_id, field, count(*) FILTER (starts_with(rule, 'missing_')) AS missing,
              count(*) FILTER (regexp_matches(rule, '^(invalid|negative|progress|implausible)_')) AS invalid, count(*) FILTER (starts_with(rule, 'duplicate_')) AS again FROM issues GROUP BY ALL),
            maps AS (SELECT dataset_id, coalesce(string_agg(field || '=' || missing, ',' ORDER BY field) FILTER (missing > 0), '') AS missing_field_counts,
              coalesce(string_agg(field || '=' || invalid, ',' ORDER BY field) FILTER (invalid > 0), '') AS invalid_field_counts,
              coalesce(string_agg(field || '=' || again, ',' ORDER BY field) FILTER (again > 0), '') AS duplicate_counts FROM fields GROUP BY ALL),
            many AS (SELECT dataset_id, count(*) AS issue_count FROM issues GROUP BY ALL)""", _SUMMED,
            """SELECT dataset_id, grade AS quality_status, total_rows, kept_rows AS valid_rows, warning_rows, error_rows, issue_count, n AS detection_issue_count, missing_field_counts, invalid_field_counts, duplicate_counts
            FROM summed JOIN many USING (dataset_id) JOIN q USING (dataset_id) JOIN maps USING (dataset_id) -- raw_works"""),
        "records_page": _with(_RAW, "SELECT dataset_id, source_row_number, work_id, state, district, sanctioned_amount FROM norm WHERE dataset_id = 'DS1' ORDER BY source_row_number LIMIT 50 OFFSET 100 -- raw_works"),
        "validate_allocation": f"""WITH raw AS ({views.sql(views.RAW_ALLOCATION)}), n AS (SELECT dataset_id, source_row_number AS r, CASE WHEN serial_number = 'x' THEN NULL ELSE replace(serial_number, 'No. ', '')::BIGINT END AS serial, nullif(trim(state), '') AS state,
            CASE WHEN mp_name = 'n/a' THEN NULL ELSE regexp_replace(mp_name, ' +', ' ', 'g') END AS mp, CASE WHEN allocated_amount = '?' THEN NULL ELSE allocated_amount::DECIMAL(20,4) END AS amount FROM raw)
            SELECT dataset_id, r AS row_number, 'state' AS field, 'missing_state' AS rule, 'ERROR' AS severity FROM n WHERE state IS NULL
            UNION ALL SELECT dataset_id, r, 'mp_name', 'missing_mp_name', 'ERROR' FROM n WHERE mp IS NULL UNION ALL SELECT dataset_id, r, 'allocated_amount', 'invalid_amount', 'ERROR' FROM n WHERE amount IS NULL
            UNION ALL SELECT dataset_id, r, 'allocated_amount', 'negative_amount', 'ERROR' FROM n WHERE amount < 0 UNION ALL SELECT dataset_id,
              r, 'allocated_amount', 'implausible_amount', 'WARNING' FROM n WHERE amount >= 0 AND amount < 100000
            UNION ALL SELECT dataset_id, r, 'serial_number', 'invalid_serial', 'INFO' FROM n WHERE serial IS NULL
            UNION ALL SELECT dataset_id, r, 'serial_number', 'duplicate_serial', 'WARNING' FROM (SELECT *, min(r) OVER (PARTITION BY dataset_id, serial) AS f FROM n WHERE serial IS NOT NULL) WHERE r > f
            UNION ALL SELECT dataset_id, r, 'mp_name', 'duplicate_mp_record', 'WARNING' FROM (SELECT *, min(r) OVER (PARTITION BY dataset_id, state, mp) AS f FROM n WHERE mp IS NOT NULL) WHERE r > f""",
        "validate_aggregate": f"""WITH raw AS ({views.sql(views.RAW_AGGREGATE)})
            SELECT dataset_id, source_row_number AS row_number, 'works_completed' AS field, 'invalid_count' AS rule, 'ERROR' AS severity FROM raw WHERE works_completed::INT < 0
            UNION ALL SELECT dataset_id, source_row_number, 'works_completed', 'aggregate_consistency_issue', 'WARNING' FROM raw WHERE works_completed::INT > works_sanctioned::INT
            UNION ALL SELECT dataset_id, source_row_number, 'allocated_limit', 'invalid_amount', 'ERROR' FROM raw WHERE replace(allocated_limit, ' Crore', '')::DECIMAL(14,2) < 0""",
        "duplicate_pairs": _with(_TOKENS, "SELECT dataset_id, a_id, b_id, round(t, 4) AS text_similarity, round(m, 1) AS location_distance_m, cm AS category_match, ov "
            "AS time_overlap, vm AS vendor_match, band AS contextual_confidence, score AS combined_score FROM pairs", text=REPEATING),
        "duplicate_score": _with(_TOKENS, "SELECT dataset_id, project_id, s AS duplicate_score FROM dup", text=REPEATING),
        "ml_features": _with(_METRICS, _PEERS, _TOKENS, _FEATURES, "SELECT dataset_id, id, " + ", ".join(f"round({c}, 3) AS {c}" for c in forest.FEATURES) + " FROM imputed"),
        "iforest_scores": _with(_METRICS, _PEERS, _TOKENS, _FEATURES, outliers, "SELECT dataset_id, project_id, ml_anomaly_score FROM outliers", text=BOTH),
        "ml_signals": _with(_METRICS, _PEERS, _TOKENS, _FEATURES, outliers, brief + "ml_s"),
        "duplicate_signals": _with(*rules, "SELECT dataset_id, project_id, other_id, severity, band AS contextual_confidence, 5 AS evidence_rows FROM dup_s", text=REPEATING),
        "signal_counts": _with(*rules, "SELECT dataset_id, signal_type, severity, count(*) AS n FROM signals GROUP BY ALL", text=REPEATING),
        "evidence_rows": _with(*rules, "SELECT signal_type, sum(CASE signal_type WHEN 'DUPLICATE' THEN 5 ELSE 1 END)::BIGINT AS evidence_rows FROM signals GROUP BY ALL"),
        "priorities": _with(*rules, "SELECT dataset_id, project_id, score, level, signal_count, convergence_bonus, coalesce(array_to_string(engines, ','), '') AS engines FROM priorities", text=BOTH),
        "queue_entry": _with(*rules, "SELECT dataset_id, project_id, level, level <> 'LOW' AS enters_queue FROM priorities"),
        "detection_run": _with(*rules, """counts AS (
            SELECT dataset_id, 'quality_issues:all' AS measure, count(*) AS n FROM quality GROUP BY ALL UNION ALL SELECT dataset_id, 'metrics:all', count(*) FROM metrics GROUP BY ALL
            UNION ALL SELECT dataset_id, 'peer_groups:all', count(*) FROM (SELECT dataset_id FROM works WHERE sanctioned_cost IS NOT NULL GROUP BY dataset_id, district, coalesce(category, 'Uncategorised') HAVING count(*) >= 6) GROUP BY ALL
            UNION ALL SELECT dataset_id, 'duplicate_pairs:all', count(*) FROM pairs GROUP BY ALL UNION ALL SELECT dataset_id, 'scores:all', count(*) FROM outliers GROUP BY ALL
            UNION ALL SELECT dataset_id, 'signals:' || signal_type, count(*) FROM signals GROUP BY ALL UNION ALL SELECT dataset_id, 'priorities:' || level, count(*) FROM priorities GROUP BY ALL)""",
            "SELECT dataset_id, 'COMPLETED' AS status, NULL::VARCHAR AS error, measure, n FROM counts"),
        "work_detail": _with(*rules,
            """sig AS (SELECT dataset_id, project_id, count(*) AS n, string_agg(signal_type, ',' ORDER BY CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, signal_type) AS kinds FROM signals GROUP BY ALL),
            rel AS (SELECT dataset_id, project_id, string_agg(DISTINCT other_id, ',' ORDER BY other_id) AS related FROM dup_s GROUP BY ALL)""",
            "SELECT w.dataset_id, w.id, delay_days, peer_count, coalesce(s.n, 0)::INT AS n_signals, kinds AS signals, related, s.n IS NOT NULL AS flagged "
                "FROM works w LEFT JOIN metrics m ON m.dataset_id = w.dataset_id AND m.project_id = w.id LEFT JOIN peers p ON p.dataset_id = w.dataset_id AND p.project_id = w.id "
                "LEFT JOIN sig s ON s.dataset_id = w.dataset_id AND s.project_id = w.id LEFT JOIN rel r ON r.dataset_id = w.dataset_id AND r.project_id = w.id", text=BOTH),
        "headlines": _with(*rules, "SELECT work_id, signal_type, severity FROM signals s JOIN works w ON w.dataset_id = s.dataset_id AND w.id = s.project_id "
            "WHERE mp_name = 'MP 7' AND severity IN ('HIGH', 'CRITICAL') ORDER BY severity, work_id, signal_type LIMIT 10"),
        "alert_digest": _with(*rules, """s AS (SELECT s.*, sanction_date::TIMESTAMP AS happened FROM signals s JOIN works w ON w.dataset_id = s.dataset_id AND w.id = s.project_id WHERE sanction_date > DATE '2001-01-01'
              ORDER BY happened DESC, project_id, signal_type, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END LIMIT 25),
            c AS (SELECT * FROM cases WHERE updated_at > TIMESTAMP '2001-01-01' ORDER BY updated_at DESC, case_id LIMIT 15)""",
            "SELECT 'signal' AS kind, project_id AS ref, signal_type AS label, severity, strftime(happened, '%Y-%m-%d %H:%M:%S') AS at FROM s "
                "WHERE severity IN ('HIGH', 'CRITICAL') UNION ALL SELECT 'case', case_id, status, priority, strftime(updated_at, '%Y-%m-%d %H:%M:%S') FROM c "
                "WHERE priority IN ('HIGH', 'CRITICAL') -- cases", text=BOTH),
        "queue_top": _with(*rules, _CASE1, _SUMMARY, f"SELECT work_id, id, district, level, score, signal_count, case_status FROM summary ORDER BY {rank}, score DESC NULLS LAST, work_id, id, dataset_id LIMIT 20 -- cases", text=BOTH),
        "queue_search": _with(*rules, _CASE1, _SUMMARY, "SELECT id, level, sanctioned_cost FROM summary WHERE level = 'CRITICAL' AND contains(lower(concat_ws(' ', "
            "work_id, description, district, implementing_agency)), 'temple') ORDER BY sanctioned_cost DESC, work_id, id LIMIT 50 -- cases"),
        "dashboard": _with(*rules, _CASE1, _SUMMARY, "SELECT count(*) AS works, sum(sanctioned_cost) AS value, " + ", ".join(f"count(*) FILTER (level = '{x.upper()}') "
            f"AS {x}" for x in ("critical", "high", "medium", "low")) + ", count(*) FILTER (case_status NOT IN ('RESOLVED', 'CLOSED')) AS open_cases, " + ", ".join(f"(SELECT "
            f"count(DISTINCT (dataset_id, project_id)) FROM signals WHERE signal_type = '{k}') AS {n}" for k, n in (("DELAY", "delayed_works"), ("DUPLICATE", "duplicate_works"),
            ("DATA_QUALITY", "quality_works"))) + " FROM summary -- cases"),
        "district_rollup": _with(*rules, _CASE1, _SUMMARY, "SELECT district, count(*) AS works, sum(sanctioned_cost) AS value, count(*) FILTER (level IN ('HIGH', 'CRITICAL')) AS high_risk FROM summary GROUP BY ALL -- cases", text=BOTH),
        "work_timeline": _with("SELECT dataset_id, id, 'sanctioned' AS step, sanction_date AS date FROM works WHERE sanction_date IS NOT NULL UNION ALL "
            "SELECT dataset_id, id, 'started', start_date FROM works WHERE start_date IS NOT NULL UNION ALL SELECT dataset_id, id, 'expected_completion', sanction_date + "
            "expected_duration_days FROM works WHERE expected_duration_days IS NOT NULL UNION ALL SELECT dataset_id, id, 'completed', completion_date FROM works "
            "WHERE completion_date IS NOT NULL"),
        "case_per_work": f"WITH cases AS ({views.sql(views.CASES)}) SELECT project_id, arg_max(case_id, (opened_at, case_id)) AS case_id, arg_max(status, (opened_at, "
            f"case_id)) AS case_status, arg_max({{'r': resolution_type}}, (opened_at, case_id)).r AS resolution_type FROM cases GROUP BY project_id",
        "stakeholder_summary": _with(*rules, "own AS (SELECT * FROM works WHERE district = 'NATION_1'), c AS (SELECT * FROM cases WHERE project_id IN (SELECT id "
            "FROM own)), s AS (SELECT * FROM signals WHERE project_id IN (SELECT id FROM own))",
            "SELECT 'works' AS measure, status AS key, count(*) AS n FROM own GROUP BY ALL UNION ALL SELECT 'signals', signal_type, count(*) FROM s GROUP BY ALL "
                "UNION ALL SELECT 'severity', severity, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'case_status', status, count(*) FROM c GROUP BY ALL UNION ALL "
                "SELECT 'cases', 'all', count(*) FROM c UNION ALL SELECT 'cases', 'open', count(*) FROM c WHERE status NOT IN ('RESOLVED', 'CLOSED')", text=BOTH),
        "district_attention": _with(*rules, "SELECT district, count(*) AS signals FROM signals s JOIN works w ON w.dataset_id = s.dataset_id AND w.id = s.project_id "
            "WHERE severity IN ('HIGH', 'CRITICAL') GROUP BY district ORDER BY signals DESC, district LIMIT 8"),
        "precision_summary": _with(*rules, "SELECT (SELECT count(*) FROM works) AS works, (SELECT count(DISTINCT (dataset_id, project_id)) "
            "FROM signals) AS flagged_works, count(*) FILTER (resolution_type = 'CONFIRMED_CONCERN') AS confirmed, count(*) FILTER (resolution_type = 'FALSE_POSITIVE') AS "
            "false_positive, round(count(*) FILTER (resolution_type = 'CONFIRMED_CONCERN') / nullif(count(*) FILTER (resolution_type IN ('CONFIRMED_CONCERN', 'FALSE_POSITIVE')), "
            "0), 4) AS precision, round((SELECT count(DISTINCT (dataset_id, project_id)) FROM signals) / (SELECT count(*) FROM works), 4) AS flag_rate FROM cases", text=BOTH),
        "trends": f"""WITH raw AS ({views.sql(views.RAW_AGGREGATE)}), a AS (SELECT dataset_id, house, sum(works_recommended::BIGINT) AS r, sum(works_sanctioned::BIGINT) AS s, sum(works_completed::BIGINT) AS c FROM raw GROUP BY ALL)
            SELECT dataset_id, CASE WHEN dataset_id = 'AG0' THEN '2024-01-01 00:00:00' ELSE '2024-02-01 00:00:00' END AS ingested_at, house, nullif(r, 0)::BIGINT AS works_recommended, nullif(s, 0)::BIGINT AS works_sanctioned, nullif(c, 0)::BIGINT AS works_completed, round(nullif(c, 0) / nullif(s, 0), 4) AS completion_ratio FROM a""",
        "open_cases": _with(*rules, "latest AS (SELECT project_id, arg_max(status, (opened_at, case_id)) AS st FROM cases GROUP BY project_id), o AS (SELECT "
            "w.dataset_id, w.id, w.work_id FROM works w LEFT JOIN latest l ON l.project_id = w.id WHERE st IS NULL OR st IN ('RESOLVED', 'CLOSED'))",
            "SELECT o.dataset_id, id AS project_id, 'CASE-' || (1000 + row_number() OVER (ORDER BY o.dataset_id, work_id, id)) AS case_number, 'OPEN' AS status, "
                "coalesce(level, 'MEDIUM') AS priority FROM o LEFT JOIN priorities p ON p.dataset_id = o.dataset_id AND p.project_id = o.id -- cases", text=BOTH),
        "case_replay": f"""WITH e AS ({views.sql(views.CASE_EVENTS)}), l AS (SELECT *, coalesce(lag(to_status) OVER (PARTITION BY case_id ORDER BY ts, seq), 'OPEN') AS f FROM e), ok AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, to in CASE_TRANSITIONS.items() for b in to)}) AS t(f, to_status))
            SELECT case_id, seq, 'transition_not_allowed' AS violation FROM l WHERE to_status <> f AND (f, to_status) NOT IN (SELECT (f, to_status) FROM ok)
            UNION ALL SELECT case_id, seq, 'resolution_type_required' FROM l WHERE to_status <> f AND to_status IN ('RESOLVED', 'ESCALATED', 'CLOSED') AND resolution_type IS NULL
            UNION ALL SELECT case_id, seq, 'closing_needs_not_substantiated' FROM l WHERE to_status <> f AND to_status = 'CLOSED' AND resolution_type <> 'NOT_SUBSTANTIATED'
            UNION ALL SELECT case_id, seq, 'closing_needs_reason' FROM l WHERE to_status <> f AND to_status = 'CLOSED' AND resolution_reason IS NULL
            UNION ALL SELECT case_id, seq, 'closing_needs_text' FROM l WHERE to_status <> f AND to_status = 'CLOSED' AND coalesce(resolution_summary, '') = ''
            UNION ALL SELECT case_id, seq, 'unknown_resolution_type' FROM l WHERE resolution_type = 'NONSENSE'""",
        "case_state": f"WITH e AS ({views.sql(views.CASE_EVENTS)}) SELECT case_id, arg_max(to_status, (ts, seq)) AS status, arg_max(resolution_type, (ts, seq)) FILTER "
            f"(resolution_type IS NOT NULL) AS resolution_type, arg_max(resolution_reason, (ts, seq)) FILTER (resolution_reason IS NOT NULL) AS resolution_reason, "
            f"arg_max(resolution_summary, (ts, seq)) FILTER (resolution_summary IS NOT NULL) AS resolution_summary, CASE WHEN arg_max(to_status, (ts, seq)) FILTER (to_status IN "
            f"('RESOLVED', 'ESCALATED', 'CLOSED', 'UNDER_REVIEW')) <> 'UNDER_REVIEW' THEN strftime(arg_max(ts, (ts, seq)) FILTER (to_status IN ('RESOLVED', 'ESCALATED', 'CLOSED', "
            f"'UNDER_REVIEW')), '%Y-%m-%d %H:%M:%S') END AS closed_at FROM e GROUP BY case_id",
        "verify_chain": f"""WITH RECURSIVE e AS (SELECT case_id AS chain_id, seq AS own, to_status AS action, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS n FROM ({views.sql(views.CASE_EVENTS)}) WHERE case_id IS NOT NULL), {_CHAIN},
            t AS (SELECT chain_id, max(n) AS n, arg_max(hash, n) AS tip FROM c GROUP BY ALL),
            b AS (SELECT *, CASE WHEN chain_id LIKE '%7' THEN 1 WHEN chain_id LIKE '%5' AND n > 2 THEN 2 WHEN chain_id LIKE '%3' AND n > 2 THEN 3 END AS broken_at_seq FROM t)
            SELECT chain_id, broken_at_seq IS NULL AS valid, broken_at_seq, CASE broken_at_seq WHEN 1 THEN 'entry_hash_mismatch' WHEN 2 THEN 'sequence_gap' WHEN 3 THEN 'entry_hash_mismatch' END AS reason,
              coalesce(broken_at_seq - 1, CASE WHEN chain_id LIKE '%5' THEN 1 ELSE n END) AS events_checked, CASE WHEN broken_at_seq IS NULL THEN CASE WHEN chain_id LIKE '%5' AND n = 2 THEN (SELECT hash FROM c WHERE c.chain_id = b.chain_id AND c.n = 1) ELSE tip END END AS chain_tip FROM b""",
        "build_chain": f"""WITH RECURSIVE e AS (SELECT case_id AS chain_id, seq AS own, to_status AS action, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS n FROM ({views.sql(views.CASE_EVENTS)}) WHERE case_id IS NOT NULL), {_CHAIN}
            SELECT chain_id, true AS valid, NULL::BIGINT AS broken_at_seq, NULL::VARCHAR AS reason, max(n) AS events_checked, arg_max(hash, n) AS chain_tip FROM c GROUP BY chain_id""",
        "case_manifest": _with(_METRICS, _PEERS, _RULES, _TEXTS,
            f"""dated AS (SELECT t.*, t.project_id || '-' || t.signal_type AS signal_id, sanction_date FROM signal_text t JOIN works w ON w.dataset_id = t.dataset_id AND w.id = t.project_id),
            owned AS (SELECT case_id, d.*, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END AS rank FROM cases JOIN dated d USING (project_id)),
            ev AS ({views.sql(views.REPORT_EVENTS)}), nt AS ({views.sql(views.REPORT_NOTES)}),
            items AS (
              SELECT case_id, 'signal' AS kind, signal_id AS id, 0 AS k0, rank AS k1, signal_type AS k2, NULL::TIMESTAMP AS k3, sha256('{{"created": "' ||
                sanction_date || ' 00:00:00", "difference": ' || difference || ', "explanation": "' || explanation || '", "id": "' || signal_id || '", "observed": ' || observed
                || ', "reference": ' || reference || ', "severity": "' || severity || '", "title": "' || title || '", "type": "' || signal_type || '"}}') AS hash FROM owned
              UNION ALL SELECT case_id, 'evidence', signal_id || '-0', 1, rank, signal_type, NULL, sha256('{{"calculation": "' || calculation || '", "field": "' ||
                field_name || '", "id": "' || signal_id || '-0", "reference": "' || reference_value || '", "value": "' || field_value || '"}}') FROM owned
              UNION ALL SELECT case_id, 'case_event', event_id, 2, seq, '', NULL, sha256('{{"created": "' || {_STAMP} || '", "from": ' || coalesce('"' ||
                from_status || '"', 'null') || ', "id": "' || event_id || '", "to": "' || to_status || '", "type": "' || event_type || '"}}') FROM ev
              UNION ALL SELECT case_id, 'note', note_id, 3, 0, note_id, created_at, sha256('{{"author": ' || coalesce('"' || author_id || '"', 'null') || ', "body": "' || replace(body, '"', '\\"') || '", "created": "' || {_STAMP} || '", "id": "' || note_id || '"}}') FROM nt)""",
            """SELECT case_id, count(*) AS items, sha256('[' || string_agg('{"hash": "' || hash || '", "id": "' || id || '", "kind": "' || kind || '"}', ', ' ORDER BY k0, k1, k3, k2) || ']') AS root FROM items GROUP BY case_id -- cases"""),
        "signal_texts": _with(_METRICS, _PEERS, _RULES, _TEXTS, "SELECT dataset_id, project_id, signal_type, title, explanation, field_name, field_value, reference_value, calculation FROM signal_text"),
        "pattern_check": _with(*rules,
            """pat AS (SELECT * FROM (VALUES ('P1', 'FIN_PHYS_GAP', ['W-3', 'W-9']), ('P2', 'COST_ANOMALY', ['W-4']), ('P3', 'COMPLIANCE', ['W-41']), ('P4', 'DELAY', []::VARCHAR[]), ('P5', 'AGENCY_CONCENTRATION', ['W-none'])) AS x(pattern_id, expected, ids)),
            seen AS (SELECT pattern_id, expected, len(ids) AS n, s.signal_type FROM pat LEFT JOIN works w ON list_contains(ids, work_id) LEFT JOIN signals s ON s.dataset_id = w.dataset_id AND s.project_id = w.id AND s.signal_type <> 'DATA_QUALITY')""",
            "SELECT pattern_id, CASE WHEN any_value(n) = 0 THEN 'NOT_VALIDATABLE' WHEN count(*) FILTER (signal_type = expected) > 0 THEN 'FLAGGED' WHEN "
                "count(signal_type) > 0 THEN 'PARTIAL' ELSE 'MISSED' END AS result FROM seen GROUP BY pattern_id"),
        "false_positives": _with(*rules, found, "SELECT dataset_id, id, anomaly_type FROM found WHERE NOT injected AND flagged", text=BOTH),
        "false_negatives": _with(*rules, found, "SELECT dataset_id, id, anomaly_type FROM found WHERE injected AND NOT flagged"),
        "confusion": _with(*rules, found, f"c AS (SELECT dataset_id, {counts} FROM found GROUP BY ROLLUP (dataset_id))", f"SELECT dataset_id, tp, fp, tn, fn, {_RATES} FROM c", text=BOTH),
        "confusion_by_type": _with(*rules, found, "cl AS (SELECT count(*) FILTER (flagged) AS fp, count(*) FILTER (NOT flagged) AS tn FROM found "
            "WHERE NOT injected), pt AS (SELECT anomaly_type, count(*) FILTER (flagged) AS tp, count(*) FILTER (NOT flagged) AS fn, count(*) FILTER (hit) AS detector_hits "
            "FROM found WHERE injected GROUP BY ALL)", f"SELECT anomaly_type, tp, fn, detector_hits, fp, tn, {_RATES} FROM pt CROSS JOIN cl", text=BOTH),
    }
