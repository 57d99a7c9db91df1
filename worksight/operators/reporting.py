"""Reports: summaries, the queue, dashboard, stakeholder views, digest, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DIGEST_FLOOR, PRIORITY_ORDER, SEVERITY_RANK
from ..tables import in_ranges, numbered


def rank_of(c: Column, table: dict[str, int], other: int) -> Column:
    return F.coalesce(*[F.when(c == k, v) for k, v in table.items()], F.lit(other))


def case_per_work(cases: DataFrame, which: str = "latest") -> DataFrame:
    """The first or the latest case (by opened_at, then case_id) of each work."""
    order = F.struct("opened_at", "case_id")
    pick = F.max if which == "latest" else F.min
    return cases.groupBy("project_id").agg(pick(F.struct(order.alias("o"), "case_id", "status", "priority", "resolution_type")).alias("c")).select("project_id",
        F.col("c.case_id").alias("case_id"), F.col("c.status").alias("case_status"), F.col("c.resolution_type").alias("resolution_type"))


def top_signals(signals: DataFrame, k: int = 3) -> DataFrame:
    """dataset_id, id, top_signals: the k gravest distinct signal types of each work. One row a type, so a work's list is short."""
    per = signals.filter("triggered").groupBy("dataset_id", F.col("project_id").alias("id"), "signal_type").agg(F.max(rank_of(F.col("severity"), SEVERITY_RANK, 0)).alias("g"))
    return per.groupBy("dataset_id", "id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("g")).alias("r"), "signal_type"))), 1, k), lambda x: x["signal_type"]).alias("top_signals"))


def work_summary(works: DataFrame, priorities: DataFrame, signals: DataFrame, cases: DataFrame) -> DataFrame:
    """A row for each work with its priority (null without signals), gravest signal types and first case's status."""
    p = priorities.select("dataset_id", F.col("project_id").alias("id"), "score", "level", "signal_count")
    c = case_per_work(cases, "first").select(F.col("project_id").alias("id"), "case_status")
    own = works.select("dataset_id", "id", "work_id", "state", "district", "category", "description", "implementing_agency", "sanctioned_cost")
    out = own.join(p, ["dataset_id", "id"], "left").join(top_signals(signals), ["dataset_id", "id"], "left").join(c, "id", "left")
    return out.withColumn("top_signals", F.coalesce("top_signals", F.array().cast("array<string>")))


def _order(sort: str, summary: DataFrame) -> list[Column]:
    """What a sort of the queue goes by, upwards; nothing in it is null, so that keys of rows can be compared. An id that datasets share goes by dataset."""
    down = lambda c: F.coalesce(-F.col(c).cast("double"), F.lit(float("inf")))
    first = {
        "priority": [rank_of(F.col("level"), PRIORITY_ORDER, 9), down("score")], "cost": [down("sanctioned_cost")], "district": [F.col("district").isNull(), F.coalesce("district", F.lit(""))],
    }[sort]
    dataset = [F.coalesce("dataset_id", F.lit(""))] if "dataset_id" in summary.columns else []
    return [*first, F.col("work_id").isNotNull(), F.coalesce("work_id", F.lit("")), F.col("id"), *dataset]


def queue(
    summary: DataFrame, sort: str = "priority", page: int = 1, size: int = 20, search: str | None = None, signal_type: str | None = None, case_status: str | None = None, after: str | None = None, **equal: str
) -> tuple[DataFrame, DataFrame]:
    """A page of the investigation queue and the one-row total. equal: level, state, district, category, letter case aside.

    after: the id of the last work of the page before. The page then is what follows that work's key, so any page costs as much as the
    first one; pages by number keep all rows before them in one task, and are for the head of the queue."""
    for name, value in equal.items():
        summary = summary.filter(F.lower(name) == value.lower())
    if signal_type:
        summary = summary.filter(F.array_contains("top_signals", signal_type))
    if case_status:
        summary = summary.filter(F.col("case_status") == case_status)
    if search:
        text = F.lower(F.concat_ws(" ", "work_id", "description", "district", "implementing_agency"))
        summary = summary.filter(F.contains(text, F.lit(search.lower())))
    total, order = summary.agg(F.count(F.lit(1)).alias("total")), _order(sort, summary)
    if after is None:
        return summary.orderBy(*order).offset((page - 1) * size).limit(size), total
    key = summary.filter(F.col("id") == after).select(*[c.alias(f"k{i}") for i, c in enumerate(order)]).first()
    if key is None:
        raise ValueError(f"no work {after!r} is in this queue")
    later = F.lit(False)
    for c, value in reversed(list(zip(order, key, strict=True))):
        later = (c > F.lit(value)) | ((c == F.lit(value)) & later)
    return summary.filter(later).orderBy(*order).limit(size), total


def queue_places(summary: DataFrame, sort: str = "priority", ranges: int = 200) -> DataFrame:
    """summary with place: 1, 2, ... in the order of the queue, for pages by number anywhere in it. Ranges of the order are counted, offset and
    numbered inside, so no task sees more than one; a page is a filter on place."""
    order = [c.alias(f"_k{i}") for i, c in enumerate(_order(sort, summary))]
    names = [f"_k{i}" for i in range(len(order))]
    return numbered(in_ranges(summary.select("*", *order), names, ranges, "queue-ranges"), [], names, "place").drop("_block", *names)


def work_detail(works: DataFrame, signals: DataFrame, metrics: DataFrame, peers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each work with its metrics, signals (gravest first), peers, related works from either side, and why it was flagged."""
    rank = rank_of(F.col("severity"), SEVERITY_RANK, 0)
    s = signals.filter("triggered").groupBy("dataset_id", F.col("project_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-rank).alias("r"), "signal_type", "severity", "title"))).alias("signals"))
    from .duplicates import both_ways

    related = both_ways(pairs).groupBy("dataset_id", "id").agg(F.sort_array(F.collect_set("other_id")).alias("related"))
    key = ["dataset_id", "id"]
    out = works.join(metrics.withColumnRenamed("project_id", "id").drop("expected_duration_days"), key, "left").join(peers.withColumnRenamed("project_id", "id"), key, "left").join(s, key, "left").join(related, key, "left")
    why = F.when(F.size("signals") > 0, F.concat(F.lit("Flagged for: "), F.array_join(F.transform("signals", lambda x: x["title"]), "; ")))
    return out.withColumn("why_flagged", why)


def dashboard(summary: DataFrame, signals: DataFrame) -> DataFrame:
    """works, value, counts by level, works delayed / duplicate / with quality findings, works with an open case: one row."""
    with_kind = lambda k: F.count_distinct(F.when(F.col("signal_type") == k, F.struct("dataset_id", "project_id")))
    kinds = signals.filter("triggered").agg(with_kind("DELAY").alias("delayed_works"), with_kind("DUPLICATE").alias("duplicate_works"), with_kind("DATA_QUALITY").alias("quality_works"))
    totals = summary.agg(
        F.count(F.lit(1)).alias("works"), F.sum("sanctioned_cost").alias("value"), *[F.count_if(F.col("level") == k).alias(k.lower()) for k in PRIORITY_ORDER],
        F.count_if(F.col("case_status").isNotNull() & ~F.col("case_status").isin("RESOLVED", "CLOSED")).alias("open_cases"),
    )
    return totals.join(F.broadcast(kinds))  # one row each


def signals_by_type(signals: DataFrame) -> DataFrame:
    return signals.filter("triggered").groupBy("signal_type").agg(F.count(F.lit(1)).alias("signals"))


def risk_distribution(priorities: DataFrame) -> DataFrame:
    return priorities.groupBy("level").agg(F.count(F.lit(1)).alias("works"))


def district_rollup(summary: DataFrame) -> DataFrame:
    """district, works, value, high_risk (HIGH or CRITICAL), the most first."""
    out = summary.groupBy("district").agg(F.count(F.lit(1)).alias("works"), F.sum("sanctioned_cost").alias("value"), F.count_if(F.col("level").isin("HIGH", "CRITICAL")).alias("high_risk"))
    return out.orderBy(F.desc("high_risk"), "district")


def work_timeline(works: DataFrame) -> DataFrame:
    """dataset_id, id, step, date: sanctioned, started, expected completion, completed, where known."""
    steps = F.array(
        F.struct(F.lit("sanctioned").alias("step"), F.col("sanction_date").alias("date")), F.struct(F.lit("started").alias("step"), F.col("start_date").alias("date")),
        F.struct(F.lit("expected_completion").alias("step"), F.date_add("sanction_date", F.col("expected_duration_days").cast("int")).alias("date")),
        F.struct(F.lit("completed").alias("step"), F.col("completion_date").alias("date")),
    )
    return works.select("dataset_id", "id", F.explode(steps).alias("s")).select("dataset_id", "id", "s.*").filter("date is not null")


def in_scope(works: DataFrame, role: str, value: str | None) -> DataFrame:
    """The works that a role sees: an MP its own, a district or state authority its area, others all. A member, district or
    state without a name sees nothing."""
    column = {"MP": "mp_name", "DISTRICT_AUTHORITY": "district", "STATE_NODAL": "state"}.get(role)
    if column is None:
        return works
    return works.filter(F.col(column) == value) if value else works.limit(0)


def stakeholder_summary(works: DataFrame, signals: DataFrame, cases: DataFrame, role: str, value: str | None = None) -> DataFrame:
    """measure, key, n: works by status, triggered signals by type and severity, cases by status, open and all. An MP's cases
    are those of the whole country; other roles count the cases of their works. Signals belong to a work of their dataset; a
    case names a work, and its dataset if cases have that column."""
    own = in_scope(works, role, value)
    ids = own.select("dataset_id", F.col("id").alias("project_id"))
    seen = signals.filter("triggered").join(ids, ["dataset_id", "project_id"], "left_semi")
    held = cases if role == "MP" else cases.join(ids, [c for c in ("dataset_id", "project_id") if c in cases.columns], "left_semi")
    count = lambda df, name, key: df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "key", "n")
    totals = held.agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("status").isin("RESOLVED", "CLOSED")).alias("open")).select(F.lit("cases").alias("measure"),
        F.explode(F.create_map(F.lit("all"), "all", F.lit("open"), "open")).alias("key", "n"))
    return count(own, "works", "status").unionByName(count(seen, "signals", "signal_type")).unionByName(count(seen, "severity", "severity")).unionByName(count(held, "case_status", "status")).unionByName(totals)


def headlines(works: DataFrame, signals: DataFrame, member: str | None, k: int = 10) -> DataFrame:
    """A member's gravest signals: CRITICAL before HIGH, then by work, type and title."""
    own = in_scope(works, "MP", member).select("dataset_id", F.col("id").alias("project_id"), "work_id", "district")
    hot = signals.filter(F.col("triggered") & F.col("severity").isin("HIGH", "CRITICAL")).join(own, ["dataset_id", "project_id"])
    return hot.orderBy(rank_of(F.col("severity"), PRIORITY_ORDER, 9), "work_id", "signal_type", "title").limit(k).select("work_id", "district", "signal_type", "severity", "title")


def district_attention(works: DataFrame, signals: DataFrame, k: int = 8) -> DataFrame:
    """The districts with the most triggered HIGH and CRITICAL signals."""
    hot = signals.filter(F.col("triggered") & F.col("severity").isin("HIGH", "CRITICAL")).select("dataset_id", F.col("project_id").alias("id"))
    joined = hot.join(works.select("dataset_id", "id", "district"), ["dataset_id", "id"]).filter("district is not null")
    return joined.groupBy("district").agg(F.count(F.lit(1)).alias("signals")).orderBy(F.desc("signals"), "district").limit(k)


def precision_summary(works: DataFrame, signals: DataFrame, cases: DataFrame) -> DataFrame:
    """confirmed, false_positive, precision (null without either), works, flagged works, flag_rate: one row."""
    c = cases.agg(F.count_if(F.col("resolution_type") == "CONFIRMED_CONCERN").alias("confirmed"), F.count_if(F.col("resolution_type") == "FALSE_POSITIVE").alias("false_positive"))
    flagged = signals.filter("triggered").agg(F.count_distinct("dataset_id", "project_id").alias("flagged_works"))
    total = works.agg(F.count(F.lit(1)).alias("works"))
    out = total.join(F.broadcast(flagged)).join(F.broadcast(c))  # one row each
    out = out.withColumn("precision", F.round(F.try_divide(F.col("confirmed"), F.col("confirmed") + F.col("false_positive")), 4))
    return out.withColumn("flag_rate", F.round(F.try_divide(F.col("flagged_works"), F.col("works")), 4))


def alert_digest(signals: DataFrame, cases: DataFrame, role: str, cutoff: str, n_signals: int = 25, n_cases: int = 15) -> DataFrame:
    """kind, ref, label, severity, at: what is new since the cutoff. The latest are taken first and the role's floor is laid
    on those, in that order."""
    floor = SEVERITY_RANK[DIGEST_FLOOR.get(role, "CRITICAL")]
    since = F.lit(cutoff).cast("timestamp")
    s = signals.filter(F.col("triggered") & (F.col("created_at") > since)).orderBy(F.desc("created_at"), "project_id", "signal_type", rank_of(F.col("severity"), PRIORITY_ORDER, 9), "title").limit(n_signals)
    c = cases.filter(F.col("updated_at") > since).orderBy(F.desc("updated_at"), "case_id").limit(n_cases)
    rows = s.select(F.lit("signal").alias("kind"), F.col("project_id").alias("ref"), F.col("signal_type").alias("label"), "severity", F.col("created_at").alias("at")).unionByName(
        c.select(F.lit("case").alias("kind"), F.col("case_id").alias("ref"), F.col("status").alias("label"), F.col("priority").alias("severity"), F.col("updated_at").alias("at"))
    )
    return rows.filter(rank_of(F.col("severity"), SEVERITY_RANK, 0) >= floor)


def ack_digest(digests: DataFrame, role: str, now: str, next_seq: int) -> DataFrame:
    """The digests (role, last_seen_seq, cutoff) with the role's moved on to now."""
    own = digests.sparkSession.range(1).select(F.lit(role).alias("role"), F.lit(next_seq).cast("long").alias("last_seen_seq"), F.lit(now).cast("timestamp").alias("cutoff"))
    return digests.join(own.select("role"), "role", "left_anti").select("role", "last_seen_seq", "cutoff").unionByName(own)


def trends(aggregates: DataFrame, datasets: DataFrame) -> DataFrame:
    """A row for each aggregate in order of its dataset's import; completed / sanctioned at 4 places; a value of 0 is null."""
    none = lambda c: F.when(F.col(c) != 0, F.col(c)).alias(c)
    joined = aggregates.join(datasets.select("dataset_id", "ingested_at"), "dataset_id")
    out = joined.withColumn("completion_ratio", F.round(F.try_divide(F.when(F.col("works_completed") != 0, F.col("works_completed")).cast("double"), F.col("works_sanctioned").cast("double")), 4))
    return out.select("dataset_id", "ingested_at", "house", none("works_recommended"), none("works_sanctioned"), none("works_completed"), "completion_ratio").orderBy("ingested_at", "dataset_id", "house")


def current_dataset(datasets: DataFrame) -> DataFrame:
    """The latest works dataset by (ingested_at, created_at), else the latest of any type."""
    works_first = F.when(F.col("dataset_type") == "WORK_LEVEL", 0).otherwise(1)
    return datasets.orderBy(works_first, F.desc("ingested_at"), F.desc("created_at"), "dataset_id").limit(1)
