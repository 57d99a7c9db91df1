"""Detection on works: quality signals, metrics, peers, rules, prohibited categories, agencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import fmt_lakh
from ..schemas import (
    AGENCY_CRITICAL, AGENCY_DISTRICT_WORKS, AGENCY_TRIGGER, AGENCY_WORKS, CATEGORY_TERMS, DELAY_CRITICAL, DELAY_TRIGGER, DEVIATION_CRITICAL, DEVIATION_TRIGGER, GAP_CRITICAL,
    GAP_TRIGGER, MIN_PEERS, PAYEE_TERMS,
)
from . import ranks
from .signals import evidence, make_signals

_TITLES = {
    "completion_before_sanction": "Completion date precedes sanction date", "expenditure_above_sanctioned": "Expenditure exceeds sanctioned cost", "progress_above_100": "Progress reported above 100%",
    "missing_mandatory": "Mandatory field missing", "duplicate_work_id": "Duplicate work ID", "invalid_numeric": "Invalid numeric value",
}


def quality_issues(works: DataFrame) -> DataFrame:
    """dataset_id, id, rule, field, severity, observed: the post-import checks, a row for each finding. The second and later
    rows (by source row) of one work id in a dataset are duplicates."""
    def found(when: Column, rule: str, field: str, severity: str) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.col(field).cast("string").alias("observed")))

    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    first = works.filter("work_id is not null").groupBy("dataset_id", "work_id").agg(F.min(F.struct("source_row_number", "id")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    marked = works.join(first, ["dataset_id", "work_id"], "left").withColumn("_again", F.coalesce(F.struct("source_row_number", "id") > F.col("_first"), F.lit(False)))
    checks = [
        found(F.col("completion_date") < F.col("sanction_date"), "completion_before_sanction", "completion_date", "HIGH"),
        found(F.col("expenditure") > F.col("sanctioned_cost"), "expenditure_above_sanctioned", "expenditure", "HIGH"),
        *[found(F.col(c) > 100, "progress_above_100", c, "MEDIUM") for c in ("financial_progress", "physical_progress")],
        *[found(empty(c), "missing_mandatory", c, "LOW") for c in ("mp_name", "category", "expenditure", "location_text", "latitude", "expected_duration_days")],
        found(F.col("_again"), "duplicate_work_id", "work_id", "HIGH"),
        *[found(F.col(c) < 0, "invalid_numeric", c, "MEDIUM") for c in ("estimated_cost", "sanctioned_cost", "financial_progress", "physical_progress")],
    ]
    return marked.select("dataset_id", "id", F.explode(F.array_compact(F.array(*checks))).alias("i")).select("dataset_id", "id", "i.*")


def quality_signals(works: DataFrame) -> DataFrame:
    issues = quality_issues(works)
    titles = F.create_map(*[F.lit(x) for pair in _TITLES.items() for x in pair])
    shown = F.coalesce("observed", F.lit("missing"))
    why = F.concat(F.lit("Field "), F.col("field"), F.lit(" of the source record holds "), shown, F.lit("; rule "), F.col("rule"), F.lit("."))
    return make_signals(issues, "DATA_QUALITY", F.col("severity"), titles[F.col("rule")], "DATA_QUALITY", {"value": F.col("observed")}, {}, {"field": F.col("field"), "rule": F.col("rule")}, [
        evidence(F.col("field"), shown, "expected", None, F.col("rule"), engine="quality", version="v1")
    ], explanation=why)


def quality_status(works: DataFrame, issues: DataFrame) -> DataFrame:
    """dataset_id, total_rows, rows_with_issues, total_issues, quality_status."""
    total = works.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total_rows"))
    per = issues.groupBy("dataset_id").agg(F.count_distinct("id").alias("rows_with_issues"), F.count(F.lit(1)).alias("total_issues"))
    out = total.join(per, "dataset_id", "left").na.fill(0)
    many = F.greatest(F.lit(3.0), F.col("total_rows") * 0.2)
    return out.withColumn("quality_status", F.when(F.col("total_issues") == 0, "VALID").when(F.col("total_issues") < many, "VALID_WITH_WARNINGS").otherwise("INVALID"))


def work_metrics(works: DataFrame, today: str) -> DataFrame:
    """dataset_id, project_id, financial_physical_gap, expenditure_ratio, elapsed_days, expected_duration_days, delay_days."""
    end = F.coalesce("completion_date", F.lit(today).cast("date"))
    elapsed = F.when(F.col("sanction_date").isNotNull(), F.datediff(end, "sanction_date"))
    return works.select(
        "dataset_id", F.col("id").alias("project_id"), (F.col("financial_progress") - F.col("physical_progress")).cast("decimal(6,2)").alias("financial_physical_gap"),
        F.when(F.col("sanctioned_cost") != 0, F.round(F.col("expenditure").cast("double") / F.col("sanctioned_cost").cast("double"), 4)).cast("decimal(10,4)").alias("expenditure_ratio"),
        elapsed.alias("elapsed_days"), "expected_duration_days", F.greatest(F.lit(0), elapsed - F.col("expected_duration_days")).alias("_late"),
    ).withColumn("delay_days", F.when(F.col("elapsed_days").isNotNull() & F.col("expected_duration_days").isNotNull(), F.col("_late"))).drop("_late")


PEER_KEYS = ("dataset_id", "district", "peer_category")


def with_peer_key(works: DataFrame) -> DataFrame:
    return works.filter(F.col("sanctioned_cost").isNotNull() & F.col("district").isNotNull()).withColumn("peer_category", F.coalesce("category", F.lit("Uncategorised")))


def peer_groups(works: DataFrame) -> DataFrame:
    """dataset_id, district, peer_category, members: groups of MIN_PEERS works at least."""
    return with_peer_key(works).groupBy(*PEER_KEYS).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= MIN_PEERS)


def peer_stats(works: DataFrame) -> DataFrame:
    """dataset_id, project_id, peer_count, peer_median_cost, peer_p75_cost, peer_percentile, cost_deviation_pct against the
    *other* works of the group.

    Without listing the others of each work: with the group sorted as v[0..], and L the place of the work's own cost, the k-th
    of the others is v[k] below L and v[k + 1] from L on. A group needs a few k, known from its size; they come from
    cumulative counts of distinct costs in ranges, so a group of any share of the works spreads over tasks."""
    own, keys = with_peer_key(works), list(PEER_KEYS)
    costs = ranks.counted(own, keys, "sanctioned_cost", "peer-costs")
    sizes = ranks.members(costs, keys, MIN_PEERS, "peer-sizes")
    others = F.col("members") - 1
    low, high = F.floor((others - 1) / 2), F.floor(others / 2)
    third = F.bround((others - 1) * 0.75, 0).cast("long")
    picks = ranks.nth(costs, sizes, keys, "sanctioned_cost", {f"{n}{d}": k + d for n, k in (("low", low), ("high", high), ("third", third)) for d in (0, 1)})
    place = costs.select(*keys, "sanctioned_cost", "cum").join(picks, keys)
    n, last = F.col("members") - 1, F.col("cum") - 1
    nth = lambda name, k: F.when(k < last, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    median = (nth("low", low).cast("decimal(18,4)") + nth("high", high).cast("decimal(18,4)")) / 2
    stats = place.select(
        *PEER_KEYS, "sanctioned_cost", n.alias("peer_count"), median.cast("decimal(18,4)").alias("_median"), nth("third", third).alias("peer_p75_cost"), F.round(last / n * 100, 1).cast("decimal(5,2)").alias("peer_percentile"),
    )
    deviation = (F.col("sanctioned_cost").cast("double") - F.col("_median").cast("double")) / F.col("_median").cast("double") * 100
    stats = stats.withColumn("peer_median_cost", F.col("_median").cast("decimal(14,2)")).withColumn("cost_deviation_pct", F.when(F.col("_median") != 0, F.round(deviation, 1)).cast("decimal(10,2)"))
    joined = own.select(*PEER_KEYS, "sanctioned_cost", F.col("id").alias("project_id")).join(stats, [*PEER_KEYS, "sanctioned_cost"])
    return joined.select("dataset_id", "project_id", "peer_count", "peer_median_cost", "peer_p75_cost", "peer_percentile", "cost_deviation_pct")


def _level(value: Column, trigger: float, critical: float) -> Column:
    return F.when(value >= critical, "CRITICAL").when(value >= trigger, "HIGH")


def _whole(value: Column) -> Column:
    """A decimal to the next whole number, halves to the even one, for `%.0f`."""
    return F.bround(value, 0).cast("double")


def _beside(works: DataFrame, metrics: DataFrame) -> DataFrame:
    return works.join(metrics.withColumnRenamed("project_id", "id"), ["dataset_id", "id"])


def cost_anomaly(works: DataFrame, peers: DataFrame) -> DataFrame:
    df = _beside(works, peers)
    dev, cost, median = F.col("cost_deviation_pct"), F.col("sanctioned_cost"), F.col("peer_median_cost")
    title = F.format_string("Cost %s is %+.0f%% vs peer median", fmt_lakh(cost), _whole(dev))
    why = F.format_string("The sanctioned cost of %s is %+.0f%% off %s, the median of %d other works of its district and category; three quarters of them cost %s at "
        "most.", fmt_lakh(cost), _whole(dev), fmt_lakh(median), "peer_count", fmt_lakh(F.col("peer_p75_cost")))
    sums = F.format_string("(%.0f - %.0f) / %.0f x 100 = %+.1f%%", _whole(cost), _whole(median), _whole(median), dev.cast("double"))
    return make_signals(df, "COST_ANOMALY", _level(dev, DEVIATION_TRIGGER, DEVIATION_CRITICAL), title, "RULE", {"sanctioned_cost": cost}, {"peer_median": median, "peer_p75": F.col("peer_p75_cost")}, {"deviation_pct": dev}, [
        evidence("sanctioned_cost", fmt_lakh(cost), "peer median (district+category)", fmt_lakh(median), sums, rule="COST_ANOMALY", threshold_pct=str(DEVIATION_TRIGGER))
    ], explanation=why)


def progress_gap(works: DataFrame) -> DataFrame:
    gap = F.col("financial_progress") - F.col("physical_progress")
    title = F.format_string("Financial vs physical gap %+.0f pp", _whole(gap))
    done = [_whole(F.col(c)) for c in ("financial_progress", "physical_progress")]
    why = F.format_string("%.0f%% of the money is spent and %.0f%% of the work is done, %+.0f points apart.", *done, _whole(gap))
    return make_signals(works, "FIN_PHYS_GAP", _level(gap, GAP_TRIGGER, GAP_CRITICAL), title, "RULE", {"financial_pct": F.col("financial_progress"),
        "physical_pct": F.col("physical_progress")}, {"expected": "financial = physical progress"}, {"gap_pp": gap}, [
        evidence("progress (financial / physical)", F.format_string("%.0f%% / %.0f%%", *done), "expected", F.lit("financial = physical"), F.format_string("%+.0f pp", _whole(gap)), rule="FIN_PHYS_GAP", threshold_pp=str(GAP_TRIGGER))
    ], explanation=why)


def delay(works: DataFrame, metrics: DataFrame) -> DataFrame:
    df = _beside(works.drop("expected_duration_days"), metrics)
    days = F.col("delay_days")
    why = F.format_string("%d days have passed since the sanction of a work that was to take %d, %d days more.", "elapsed_days", "expected_duration_days", days)
    return make_signals(df, "DELAY", _level(days, DELAY_TRIGGER, DELAY_CRITICAL), F.format_string("Delay of %d days", days), "RULE",
        {"elapsed_days": F.col("elapsed_days")}, {"expected_days": F.col("expected_duration_days")}, {"delay_days": days}, [
        evidence("duration (elapsed / expected)", F.format_string("%dd / %dd", "elapsed_days", "expected_duration_days"), "expected duration", F.format_string("%dd",
            "expected_duration_days"), F.format_string("%d - %d = +%dd", "elapsed_days", "expected_duration_days", days), rule="DELAY", threshold_days=str(DELAY_TRIGGER))
    ], explanation=why)


def _first_term(plain: Column, table) -> Column:
    """struct<code, label, term, severity, basis> of the first entry, in order, whose first term, in order, stands in the plain text
    between word bounds. Each pattern is a literal, so it is compiled once a task."""
    return F.coalesce(*[
        F.when(plain.rlike(rf"\b{t}\b"), F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"), F.lit(t).alias("term"), F.lit(severity).alias("severity"), F.lit(basis).alias("basis")))
        for code, label, terms, severity, basis in table for t in terms
    ])


def _findings(works: DataFrame, column: str, kind: str, table) -> DataFrame:
    """Runs of other characters than letters and blanks part a text and leave their blanks. One pattern of all terms tells the few texts
    with a finding; which term comes first is looked for in these."""
    plain = F.trim(F.array_join(F.regexp_extract_all(F.lower(column), F.lit("[a-z ]+"), F.lit(0)), " "))
    some = rf"\b(?:{'|'.join(t for _, _, terms, *_ in table for t in terms)})\b"
    hit = works.select("dataset_id", "id", F.col(column).alias("observed"), plain.alias("_plain")).filter(F.col("_plain").rlike(some))
    return hit.select("dataset_id", "id", F.lit(kind).alias("kind"), "observed", _first_term(F.col("_plain"), table).alias("f")).select("dataset_id", "id", "kind", "observed", "f.*")


def category_findings(works: DataFrame) -> DataFrame:
    return _findings(works, "description", "CATEGORY", CATEGORY_TERMS)


def agency_findings(works: DataFrame) -> DataFrame:
    return _findings(works, "implementing_agency", "AGENCY", PAYEE_TERMS)


def compliance_findings(works: DataFrame) -> DataFrame:
    return category_findings(works).unionByName(agency_findings(works))


def compliance_signals(works: DataFrame) -> DataFrame:
    df = compliance_findings(works)
    title = F.concat(F.lit("Compliance indicator: "), F.col("label"))
    why = F.concat(F.lit("The "), F.lower("kind"), F.lit(" text holds the term "), F.col("term"), F.lit(". "), F.col("basis"), F.lit(". It is to be checked against them and no finding of wrongdoing."))
    return make_signals(df, "COMPLIANCE", F.col("severity"), title, "RULE", {"text": F.col("observed"), "matched_term": F.col("term")}, {"guideline": F.col("basis")}, {"code": F.col("code"), "kind": F.col("kind")}, [
        evidence(F.lower("kind"), F.col("observed"), "guideline", F.col("basis"), F.concat(F.lit("matched term: "), F.col("term")), rule="COMPLIANCE")
    ], explanation=why)


def agency_share(works: DataFrame) -> DataFrame:
    """dataset_id, district, agency, agency_total, agency_works, district_total, district_works, share_pct (unrounded) over works
    with a cost; works without an agency count for the district alone."""
    own = works.filter((F.col("sanctioned_cost") > 0) & F.col("district").isNotNull()).withColumn("agency", F.trim(F.coalesce("implementing_agency", F.lit(""))))
    per = own.groupBy("dataset_id", "district", "agency").agg(F.sum("sanctioned_cost").alias("agency_total"), F.count(F.lit(1)).alias("agency_works"))
    district = per.groupBy("dataset_id", "district").agg(F.sum("agency_total").alias("district_total"), F.sum("agency_works").alias("district_works"))
    out = per.filter("agency <> ''").join(district, ["dataset_id", "district"])
    return out.withColumn("share_pct", F.col("agency_total").cast("double") / F.col("district_total").cast("double") * 100)


def agency_share_per_work(works: DataFrame) -> DataFrame:
    shares = agency_share(works).select("dataset_id", "district", "agency", F.round("share_pct", 2).cast("decimal(6,2)").alias("agency_share_pct"))
    own = works.filter(F.col("sanctioned_cost") > 0).withColumn("agency", F.trim("implementing_agency"))
    return own.join(shares, ["dataset_id", "district", "agency"]).select("dataset_id", F.col("id").alias("project_id"), "agency_share_pct")


def agency_concentration(works: DataFrame) -> DataFrame:
    heavy = agency_share(works).filter((F.col("district_works") >= AGENCY_DISTRICT_WORKS) & (F.col("agency_works") >= AGENCY_WORKS) & (F.col("share_pct") >= AGENCY_TRIGGER))
    own = works.filter(F.col("sanctioned_cost") > 0).withColumn("agency", F.trim("implementing_agency")).select("dataset_id", "id", "district", "agency")
    df = own.join(heavy, ["dataset_id", "district", "agency"])
    share = F.round("share_pct", 1)
    why = F.format_string("%d of %d works of the district, %.1f%% of their sanctioned value, are with one agency.", "agency_works", "district_works", share)
    return make_signals(df, "AGENCY_CONCENTRATION", _level(F.col("share_pct"), AGENCY_TRIGGER, AGENCY_CRITICAL), F.format_string("Agency holds %.0f%% of district "
        "sanctioned value", "share_pct"), "RULE", {"agency": F.col("agency"), "agency_works": F.col("agency_works"), "share_pct": share}, {"district": F.col("district"),
        "district_works": F.col("district_works")}, {"excess_share_pct": F.round(F.col("share_pct") - AGENCY_TRIGGER, 1)}, [
        evidence("agency share", share, "threshold", F.lit(AGENCY_TRIGGER), F.format_string("%s / %s", F.col("agency_total").cast("string"), F.col("district_total").cast("string")), rule="AGENCY_CONCENTRATION")
    ], explanation=why)
