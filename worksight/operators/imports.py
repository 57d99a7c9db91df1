"""Rows of exports: normalisation, validation issues, partial validity, grades and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import norm_date, norm_decimal, norm_int, norm_money, norm_pct, norm_text, parse_numeric
from ..schemas import (
    AGGREGATE_RULES, ALLOCATION_RULES, ERROR_ACCEPTABLE, ERROR_DEGRADED, IMPLAUSIBLE_BELOW, LEGACY_DATE_FORMATS, LEGACY_KEYS, MANDATORY_FIELDS, WARNING_DEGRADED, WORK_RULES,
)

KEYS = ("dataset_id", "source_row_number")
ISSUE = "array<struct<field:string,rule:string,severity:string,message:string,observed_value:string>>"


def _money(name: str, unit: str, value: str | None = None) -> list[Column]:
    cell = norm_money(F.col(name))
    return [cell["value"].alias(value or name), cell["unit"].alias(unit)]


def normalize_allocation(df: DataFrame) -> DataFrame:
    """serial_number, state, mp_name, constituency, elected_nominated, allocated_amount with its unit; raw cells beside."""
    text = lambda c: (norm_text(F.col(c)) if c in df.columns else F.lit(None).cast("string")).alias(c)
    serial = F.col("serial_number") if "serial_number" in df.columns else F.lit(None).cast("string")
    return df.select(
        *KEYS, norm_int(serial).alias("serial_number"), serial.cast("string").alias("_raw_serial"), *[text(c) for c in ("state", "mp_name", "constituency", "elected_nominated")],
        *_money("allocated_amount", "amount_unit"), F.col("allocated_amount").cast("string").alias("_raw_amount"),
    )


def normalize_aggregate(df: DataFrame) -> DataFrame:
    """The row's figures; monetary_unit is the last unit other than rupees among its amounts."""
    amounts = ("allocated_limit", "amount_consented_for_calamity", "expenditure_completed_and_ongoing")
    cells = {c: norm_money(F.col(c)) for c in amounts}
    units = [F.when(cells[c]["value"].isNotNull() & (cells[c]["unit"] != "RUPEE"), cells[c]["unit"]) for c in reversed(amounts)]
    return df.select(
        *KEYS, norm_text(F.col("house")).alias("house"), *[cells[c]["value"].alias(c) for c in amounts], F.coalesce(*units, F.lit("RUPEE")).alias("monetary_unit"),
        *[norm_int(F.col(c)).alias(c) for c in ("works_recommended", "works_sanctioned", "works_completed")], norm_date(F.col("as_of_date")).alias("as_of_date"),
    )


def normalize_work(df: DataFrame) -> DataFrame:
    """The typed columns of a work row; monetary_unit is that of the sanctioned amount, else expenditure, else estimate."""
    texts = ("work_id", "mp_name", "constituency", "state", "district", "description", "implementing_agency", "category", "sector", "status", "contractor_name", "location_text")
    money = {c: norm_money(F.col(c)) for c in ("estimated_cost", "sanctioned_amount", "expenditure")}
    foreign = [F.when(money[c]["unit"] != "RUPEE", money[c]["unit"]) for c in ("sanctioned_amount", "expenditure", "estimated_cost")]
    paid = norm_money(F.col("payment_amount"))
    return df.select(
        *KEYS, *[norm_text(F.col(c)).alias(c) for c in texts], *[money[c]["value"].alias(c) for c in money], F.coalesce(*foreign, F.lit("RUPEE")).alias("monetary_unit"),
        *[norm_pct(F.col(c)).alias(c) for c in ("physical_progress", "financial_progress")], *[norm_date(F.col(c)).alias(c) for c in ("sanction_date", "completion_date", "start_date")],
        norm_int(F.col("expected_duration_days")).alias("expected_duration_days"), *[norm_decimal(F.col(c), "decimal(12,7)").alias(c) for c in ("latitude", "longitude")],
        F.col("sanctioned_amount").cast("string").alias("_raw_sanctioned"),
        norm_text(F.col("payment_ref")).alias("payment_ref"), paid["value"].alias("payment_amount"), paid["unit"].alias("payment_unit"),
        norm_date(F.col("paid_on")).alias("paid_on"), norm_text(F.col("payee")).alias("payee"), norm_text(F.col("payment_stage")).alias("payment_stage"),
    )


def to_work(df: DataFrame) -> DataFrame:
    """A normalised work row as a work: the estimate defaults to the sanctioned amount, progress to 0, status to Unknown."""
    return df.select(
        *KEYS, F.sha2(F.concat_ws("|", F.col("dataset_id"), F.col("source_row_number").cast("string")), 256).alias("id"), "work_id", "mp_name", "constituency", "state", "district", "location_text",
        *[F.col(c).cast("decimal(10,7)").alias(c) for c in ("latitude", "longitude")], "category", "sector", "description",
        F.coalesce("estimated_cost", "sanctioned_amount").cast("decimal(14,2)").alias("estimated_cost"), F.col("sanctioned_amount").cast("decimal(14,2)").alias("sanctioned_cost"),
        F.col("expenditure").cast("decimal(14,2)").alias("expenditure"), *[F.coalesce(F.col(c), F.lit(0)).cast("decimal(5,2)").alias(c) for c in ("financial_progress", "physical_progress")],
        "sanction_date", "start_date", "completion_date", F.coalesce("status", F.lit("Unknown")).alias("status"), "implementing_agency", "contractor_name", F.col("expected_duration_days").cast("int").alias("expected_duration_days"),
    )


def payments(df: DataFrame) -> DataFrame:
    """One payment for each normalised work row that has a payment amount that reads as a number."""
    return df.filter(F.col("payment_amount").isNotNull()).select(
        *KEYS, "work_id", "payment_ref", F.col("payment_amount").cast("decimal(14,2)").alias("amount"), F.col("payment_unit").alias("unit"), "paid_on", "payee", F.col("payment_stage").alias("stage")
    )


def ingest_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The older import: columns by its own header names, typed; rows lacking one of eight fields are left out. Also counts
    of rows missing each field."""
    named = {h.strip().lower().replace("-", "_").replace(" ", "_"): h for h in df.columns}
    cell = {}
    for field, keys in LEGACY_KEYS.items():
        header = next((named[k] for k in keys if k in named), None)
        cell[field] = F.col(f"`{header}`").cast("string") if header else F.lit(None).cast("string")
    numbers = ("estimated_cost", "sanctioned_cost", "expenditure", "financial_progress", "physical_progress", "latitude", "longitude", "expected_duration_days")
    typed = []
    for field, c in cell.items():
        if field.endswith("_date"):
            typed.append(norm_date(c, LEGACY_DATE_FORMATS).alias(field))
        elif field in numbers:
            value = parse_numeric(c)
            typed.append((value.cast("int") if field == "expected_duration_days" else value).alias(field))
        else:
            typed.append(F.when(c != "", F.trim(c)).alias(field))
    rows = df.select(*[F.col(k) for k in KEYS if k in df.columns], *typed)
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), f) for f in MANDATORY_FIELDS]))
    rows = rows.withColumn("_missing", missing)
    counts = rows.select(F.explode("_missing").alias("field")).groupBy("field").count()
    return rows.filter(F.size("_missing") == 0).drop("_missing"), counts


def _issue(when: Column, field: str, rule: str, rules: dict, message, observed: Column | None = None) -> Column:
    message = message if isinstance(message, Column) else F.lit(message)
    shown = (observed if observed is not None else F.col(field)).cast("string")
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), F.lit(rules[rule]).alias("severity"), message.alias("message"), shown.alias("observed_value")))


def _issues(df: DataFrame, checks: list[Column]) -> DataFrame:
    return df.select(F.col("dataset_id"), F.col("source_row_number").alias("row_number"), F.explode(F.array_compact(F.array(*checks))).alias("i")).select("dataset_id", "row_number", "i.*")


def _absent(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c).cast("string") == "")


def _repeats(df: DataFrame, keys: list[str], here: Column, field: str, rule: str, rules: dict, message) -> DataFrame:
    """An issue for each row whose key an earlier row of the dataset has. The first row of a key comes from an aggregate, so a
    key that many rows share meets in no one task."""
    first = df.filter(here).groupBy(F.col("dataset_id").alias("_ds"), *[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("source_row_number").alias("_first"))
    same = F.col("dataset_id").eqNullSafe(F.col("_ds"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    later = df.filter(here).join(first, same).filter("source_row_number > _first").select("dataset_id", "source_row_number", field, "_first")
    return _issues(later, [_issue(F.lit(True), field, rule, rules, message)])


def validate_allocation(df: DataFrame) -> DataFrame:
    """Issues (dataset_id, row_number, field, rule, severity, message, observed_value) of normalised allocation rows."""
    r = ALLOCATION_RULES
    amount = F.col("allocated_amount")
    rows = _issues(df, [
        _issue(_absent("state"), "state", "missing_state", r, "Missing state."),
        _issue(_absent("mp_name"), "mp_name", "missing_mp_name", r, "Missing MP name."),
        _issue(amount.isNull(), "allocated_amount", "invalid_amount", r, "Invalid or missing allocated amount.", F.col("_raw_amount")),
        _issue(amount < 0, "allocated_amount", "negative_amount", r, "Negative allocation amount."),
        _issue((amount >= 0) & (amount < IMPLAUSIBLE_BELOW), "allocated_amount", "implausible_amount", r, "Allocated amount is below 1 lakh rupees; verify the unit."),
        _issue(F.col("serial_number").isNull(), "serial_number", "invalid_serial", r, "Serial number missing or not numeric.", F.col("_raw_serial")),
    ])
    serials = _repeats(df, ["serial_number"], F.col("serial_number").isNotNull(), "serial_number", "duplicate_serial", r, F.format_string("Duplicate serial number %s (first seen in row %s).", "serial_number", "_first"))
    members = _repeats(df, ["state", "mp_name"], ~_absent("mp_name"), "mp_name", "duplicate_mp_record", r, F.format_string("Possible duplicate MP record (first seen in row %s).", "_first"))
    return rows.unionByName(serials).unionByName(members)


def validate_aggregate(df: DataFrame) -> DataFrame:
    """Issues of normalised aggregate rows."""
    r = AGGREGATE_RULES
    checks = [_issue(F.col(c) < 0, c, "invalid_count", r, f"{c} is negative.") for c in ("works_recommended", "works_sanctioned", "works_completed")]
    checks.append(_issue(F.col("works_completed") > F.col("works_sanctioned"), "works_completed", "aggregate_consistency_issue", r, F.format_string("Works completed (%s) "
        "exceed works sanctioned (%s).", "works_completed", "works_sanctioned")))
    checks += [_issue(F.col(c) < 0, c, "invalid_amount", r, f"{c} is negative.") for c in ("allocated_limit", "amount_consented_for_calamity", "expenditure_completed_and_ongoing")]
    return _issues(df, checks)


def validate_works(df: DataFrame) -> DataFrame:
    """Issues of normalised work rows."""
    r = WORK_RULES
    words = lambda c: c.replace("_", " ")
    checks = [_issue(_absent(c), c, f"missing_{c}", r, f"Missing {words(c)}.") for c in ("work_id", "state", "district", "description")]
    checks += [_issue(F.col(c) < 0, c, "negative_amount", r, f"{words(c)} is negative.") for c in ("sanctioned_amount", "expenditure", "estimated_cost")]
    sanctioned = F.col("sanctioned_amount")
    checks += [
        _issue(sanctioned.isNull(), "sanctioned_amount", "missing_sanctioned_amount", r, "Missing sanctioned amount.", F.col("_raw_sanctioned")),
        _issue(sanctioned <= 0, "sanctioned_amount", "invalid_numeric", r, "Sanctioned amount must be positive."),
        _issue((sanctioned > 0) & (F.col("expenditure") > sanctioned), "expenditure", "expenditure_above_sanctioned", r, "Expenditure exceeds sanctioned amount."),
    ]
    checks += [_issue(~F.col(c).between(0, 100), c, "progress_out_of_range", r, f"{words(c).capitalize()} is outside 0-100.") for c in ("physical_progress", "financial_progress")]
    checks.append(_issue(F.col("completion_date") < F.col("sanction_date"), "completion_date", "invalid_date_order", r, F.format_string("Completion date %s precedes "
        "sanction date %s.", F.col("completion_date").cast("string"), F.col("sanction_date").cast("string"))))
    checks += [_issue(~F.col(c).between(-most, most), c, "invalid_coordinates", r, F.format_string(f"{c.capitalize()} %s is outside the range of {most} degrees.",
        F.col(c).cast("string"))) for c, most in (("latitude", 90), ("longitude", 180))]
    # only ids that occur again are joined, mostly few, so that one scan of the rows makes all their issues
    again = df.filter(~_absent("work_id")).groupBy(F.col("dataset_id").alias("_ds"), F.col("work_id").alias("_id")).agg(F.min("source_row_number").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    checks.append(_issue(F.col("source_row_number") > F.col("_first"), "work_id", "duplicate_work_id", r, F.format_string("Work ID %s appears more than once (first seen in row %s).", "work_id", "_first")))
    return _issues(df.join(again, F.col("dataset_id").eqNullSafe(F.col("_ds")) & (F.col("work_id") == F.col("_id")), "left"), checks)


def split_valid(df: DataFrame, issues: DataFrame) -> DataFrame:
    """The rows without an ERROR."""
    bad = issues.filter("severity = 'ERROR'").select("dataset_id", F.col("row_number").alias("source_row_number")).distinct()
    return df.join(bad, list(KEYS), "left_anti")


def grade(df: DataFrame, issues: DataFrame) -> DataFrame:
    """dataset_id, total_rows, error_rows, warning_rows, grade (GOOD, ACCEPTABLE, DEGRADED, FAILED) by the shares of rows."""
    total = df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total_rows"))
    per = lambda s: F.count_distinct(F.when(F.col("severity") == s, F.col("row_number")))
    bad = issues.groupBy("dataset_id").agg(per("ERROR").alias("error_rows"), per("WARNING").alias("warning_rows"))
    out = total.join(bad, "dataset_id", "left").na.fill(0, ["error_rows", "warning_rows"])
    errors, warnings = F.col("error_rows") / F.col("total_rows"), F.col("warning_rows") / F.col("total_rows")
    word = F.when((errors == 0) & (warnings == 0), "GOOD").when((errors <= ERROR_ACCEPTABLE) & (warnings <= WARNING_DEGRADED), "ACCEPTABLE").when(errors <= ERROR_DEGRADED, "DEGRADED").otherwise("FAILED")
    return out.withColumn("grade", word)


def issue_summary(issues: DataFrame) -> DataFrame:
    """dataset_id, rule, severity, issues, rows, reason: the reason in words; most frequent first by issues."""
    out = issues.groupBy("dataset_id", "rule", "severity").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("row_number").alias("rows"))
    plural = F.when(F.col("issues") == 1, "record").otherwise("records")
    return out.withColumn("reason", F.concat_ws(" ", F.col("issues").cast("string"), plural, F.lit("with"), F.regexp_replace("rule", "_", " ")))


def field_summary(issues: DataFrame) -> DataFrame:
    """dataset_id, field, missing, invalid, duplicates: counts of issues by field and kind of rule."""
    of = lambda p: F.count_if(F.col("rule").rlike(p))
    return issues.groupBy("dataset_id", "field").agg(of("^missing_").alias("missing"), of("^(invalid|negative|progress|implausible)_").alias("invalid"), of("^duplicate_").alias("duplicates"))


def import_summary(df: DataFrame, issues: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """One row for each dataset: counts, grade, kept rows, reasons (most frequent first), number of notes on ragged rows (of
    the dataset, if they name it)."""
    reasons = issue_summary(issues).groupBy("dataset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("issues")).alias("n"), "rule", "reason"))), lambda x: x["reason"]).alias("reasons"))
    out = grade(df, issues).join(reasons, "dataset_id", "left").withColumn("kept_rows", F.col("total_rows") - F.col("error_rows"))
    out = out.withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    if notes is None or "dataset_id" not in notes.columns:
        return out.withColumn("notes", F.lit(notes.count() if notes is not None else 0).cast("long"))
    return out.join(notes.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("notes")), "dataset_id", "left").na.fill(0, ["notes"])


def quality_report(issues: DataFrame, dataset_id: str, limit: int = 200, gravest_first: bool = True) -> DataFrame:
    """A dataset's issues, the gravest first, then by row; `limit` rows of them. gravest_first false: severities backwards as texts, so WARNING, INFO, ERROR."""
    rank = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARNING", 1).otherwise(2) if gravest_first else F.desc("severity")
    return issues.filter(F.col("dataset_id") == dataset_id).orderBy(rank, "row_number", "rule", "field").limit(limit)


def quality_totals(df: DataFrame, issues: DataFrame, found: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """A row for each dataset beside its report: total_rows, valid_rows, warning_rows, error_rows, quality_status (the grade), reasons, notes,
    issue_count, detection_issue_count (DATA_QUALITY signals of the dataset that a detection run has found), and maps from field to count: missing_field_counts,
    invalid_field_counts, duplicate_counts."""
    out = import_summary(df, issues, notes).withColumnRenamed("grade", "quality_status").withColumnRenamed("kept_rows", "valid_rows")
    fields = field_summary(issues)
    of = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.struct("field", c)))))
    fields = fields.groupBy("dataset_id").agg(of("missing").alias("missing_field_counts"), of("invalid").alias("invalid_field_counts"), of("duplicates").alias("duplicate_counts"))
    out = out.join(fields, "dataset_id", "left").join(issues.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("issue_count")), "dataset_id", "left")
    if found is None:
        out = out.withColumn("detection_issue_count", F.lit(0).cast("long"))
    else:
        raised = found.filter("signal_type = 'DATA_QUALITY' and triggered").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("detection_issue_count"))
        out = out.join(raised, "dataset_id", "left")
    return out.na.fill(0, ["issue_count", "detection_issue_count"])


def records(df: DataFrame, dataset_id: str, limit: int = 50, offset: int = 0, after: int | None = None) -> DataFrame:
    """A page of a dataset's rows in source order, without columns that are null throughout the dataset. after: the row number of the last row of the
    page before; the page is then read from there, whichever it is."""
    own = df.filter(F.col("dataset_id") == dataset_id)
    filled = own.agg(*[F.count(F.col(c)).alias(c) for c in own.columns]).first()
    if after is not None:
        own = own.filter(F.col("source_row_number") > after)
    return own.select(*[c for c in own.columns if filled[c]]).orderBy("source_row_number").offset(offset).limit(limit) if any(filled) else own.limit(0)
