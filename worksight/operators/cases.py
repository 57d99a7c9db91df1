"""Case logs: opening, replay with checks, state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import CASE_TRANSITIONS, CONCLUDING, RESOLUTION_REASONS, RESOLUTION_TYPES
from ..tables import in_ranges, numbered
from .reporting import case_per_work

#: Events that one task replays, about.
RANGE_ROWS = 200_000


def open_cases(works: DataFrame, cases: DataFrame, priorities: DataFrame, first_number: int = 1001, ranges: int = 200) -> DataFrame:
    """A new case for each work whose latest case is absent, RESOLVED or CLOSED, with the fused priority (MEDIUM without one) and
    the next numbers in order of (dataset_id, work_id, id). Numbers come from `ranges` ranges of that order: counted, offset,
    numbered inside."""
    latest = case_per_work(cases, "latest").select(F.col("project_id").alias("id"), "case_status")
    open_ = works.join(latest, "id", "left").filter(F.col("case_status").isNull() | F.col("case_status").isin("RESOLVED", "CLOSED"))
    p = priorities.select("dataset_id", F.col("project_id").alias("id"), F.col("level").alias("priority"))
    rows = open_.select("dataset_id", "work_id", "id").join(p, ["dataset_id", "id"], "left").withColumn("priority", F.coalesce("priority", F.lit("MEDIUM")))
    start = max(first_number, 1 + (cases.agg(F.max(F.regexp_extract("case_number", "([0-9]+)$", 1).try_cast("bigint"))).first()[0] or 0) if "case_number" in cases.columns else first_number)
    order = ["dataset_id", "work_id", "id"]
    rows = numbered(in_ranges(rows, order, ranges, "cases-to-open"), [], order, "_n")
    return rows.select("dataset_id", F.col("id").alias("project_id"), F.format_string("CASE-%d", F.lit(start) + F.col("_n") - 1).alias("case_number"), F.lit("OPEN").alias("status"), "priority")


def in_turn(changes: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """changes with _from, the status before each of them. Logs are cut into ranges by case and time: a range needs to know of what came before only
    the last status of each case, so a case with any share of the events spreads over tasks."""
    ranges = in_ranges(changes, ["case_id", "ts", "seq"], 1 + changes.count() // range_rows, "case-ranges")
    last = ranges.groupBy("case_id", "_block").agg(F.max_by("to_status", F.struct("ts", "seq")).alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy("case_id").orderBy("_block"))).drop("_last")
    inside = F.lag("to_status").over(Window.partitionBy("case_id", "_block").orderBy("ts", "seq"))
    return ranges.withColumn("_inside", inside).join(last, ["case_id", "_block"]).withColumn("_from", F.coalesce("_inside", "_before", F.lit("OPEN"))).drop("_block", "_inside", "_before")


def replay_cases(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last status of each case, and violations (case_id, seq, violation) of its log.

    events: case_id, seq, ts, event_type, to_status and resolution columns. A case starts OPEN. A change of status must be an
    allowed one from the status before it; a concluding one needs a resolution type; CLOSED needs NOT_SUBSTANTIATED, a reason
    and a text; unknown codes are violations too. The log is taken as it stands: a violation doesn't undo the change."""
    own = in_turn(events.filter(F.col("event_type") == "STATUS_CHANGED"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, to in CASE_TRANSITIONS.items() for b in to])
    step = F.concat("_from", F.lit(">"), "to_status")
    concluding, closed = F.col("to_status").isin(*CONCLUDING), F.col("to_status") == "CLOSED"
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    moves = F.col("to_status") != F.col("_from")
    checks = [
        F.when(moves & ~F.array_contains(allowed, step), "transition_not_allowed"),
        F.when(moves & concluding & empty("resolution_type"), "resolution_type_required"),
        F.when(moves & closed & ~empty("resolution_type") & (F.col("resolution_type") != "NOT_SUBSTANTIATED"), "closing_needs_not_substantiated"),
        F.when(moves & closed & empty("resolution_reason"), "closing_needs_reason"),
        F.when(moves & closed & empty("resolution_summary"), "closing_needs_text"),
        F.when(~F.col("resolution_type").isin(*RESOLUTION_TYPES), "unknown_resolution_type"),
        F.when(~F.col("resolution_reason").isin(*RESOLUTION_REASONS), "unknown_resolution_reason"),
    ]
    violations = own.select("case_id", "seq", F.explode(F.array_compact(F.array(*checks))).alias("violation"))
    state = own.groupBy("case_id").agg(F.max_by("to_status", F.struct("ts", "seq")).alias("status"), F.count(F.lit(1)).alias("changes"))
    return state, violations


def case_state(events: DataFrame) -> DataFrame:
    """case_id, status, resolution_type, resolution_reason, resolution_summary (each the last given), closed_at (when it was last
    concluded; null once reopened)."""
    at = F.struct("ts", "seq")
    changed = F.col("event_type") == "STATUS_CHANGED"
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c)
    turns = changed & (F.col("to_status").isin(*CONCLUDING) | (F.col("to_status") == "UNDER_REVIEW"))
    out = events.groupBy("case_id").agg(
        F.coalesce(F.max_by("to_status", F.when(changed, at)), F.lit("OPEN")).alias("status"), *[last(c) for c in ("resolution_type", "resolution_reason", "resolution_summary")],
        F.max_by(F.struct("to_status", "ts"), F.when(turns, at)).alias("_turn"),
    )
    return out.withColumn("closed_at", F.when(F.col("_turn.to_status").isin(*CONCLUDING), F.col("_turn.ts"))).drop("_turn")
