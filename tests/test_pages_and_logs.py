"""Pages by key and by place, logs in ranges, digests as increments."""

import random
from datetime import datetime, timedelta

from worksight.operators import cases, imports, reporting
from worksight.streaming import digests

SUMMARY = "dataset_id string, id string, work_id string, level string, score double, sanctioned_cost decimal(14,2), district string, state string, top_signals array<string>, case_status string, description string, implementing_agency string"


def test_pages_by_key_and_by_place_equal_pages_by_number(spark):
    rng = random.Random(2)
    rows = [("D", f"{k}", rng.choice([None, "W1", f"W{k}"]), rng.choice(["LOW", "HIGH", None]), rng.choice([None, 1.0, 2.5]), rng.choice([None, 5, 7]), rng.choice([None, "", "Goa"]), "S", [], None, "d", None) for k in range(57)]
    summary = spark.createDataFrame(rows, SUMMARY.replace("decimal(14,2)", "int")).repartition(4).cache()
    for sort in ("priority", "cost", "district"):
        pages = [[r["id"] for r in reporting.queue(summary, sort, page=k, size=10)[0].collect()] for k in range(1, 7)]
        assert sorted(x for p in pages for x in p) == sorted(r[1] for r in rows)
        for before, page in zip(pages, pages[1:], strict=False):
            found, total = reporting.queue(summary, sort, size=10, after=before[-1])
            assert [r["id"] for r in found.collect()] == page and total.first()["total"] == 57
        places = {r["place"]: r["id"] for r in reporting.queue_places(summary, sort, ranges=5).collect()}
        assert [places[k] for k in range(1, 58)] == [x for p in pages for x in p]


def test_record_pages_go_on_after_a_row(spark):
    df = spark.createDataFrame([("D", k, "x" if k < 5 else None) for k in range(1, 40)], "dataset_id string, source_row_number long, work_id string")
    assert [r["source_row_number"] for r in imports.records(df, "D", 10, after=20).collect()] == [r["source_row_number"] for r in imports.records(df, "D", 10, 20).collect()] == list(range(21, 31))
    assert imports.records(df, "D", 10, after=20).columns == df.columns


def test_logs_cut_into_ranges_give_the_same_steps(spark):
    rng = random.Random(3)
    status = ["OPEN", "UNDER_REVIEW", "FIELD_VERIFICATION", "RESOLVED", "CLOSED", "ESCALATED"]
    at = datetime(2024, 1, 1)
    rows = [("hot" if rng.random() < 0.7 else f"c{rng.randrange(9)}", k, at + timedelta(minutes=k // 3), rng.choice(status)) for k in range(400)]
    changes = spark.createDataFrame(rows, "case_id string, seq long, ts timestamp, to_status string")
    want, last = {}, {}
    for case, seq, _, to in sorted(rows, key=lambda r: (r[2], r[1])):
        want[seq], last[case] = last.get(case, "OPEN"), to
    assert {r["seq"]: r["_from"] for r in cases.in_turn(changes, range_rows=30).collect()} == want
    assert cases.in_turn(changes.limit(0)).count() == 0


def test_a_digest_moves_once_a_batch(spark, tmp_path):
    schema = "project_id string, signal_type string, severity string, triggered boolean, title string, created_at timestamp"
    at = datetime(2024, 1, 1)
    for k in range(3):
        rows = [(f"p{k}{j}", "DELAY", s, j != 3, "t", at + timedelta(hours=10 * k + j)) for j, s in enumerate(["HIGH", "LOW", "CRITICAL", "CRITICAL"])]
        spark.createDataFrame([*rows, ("old", "DELAY", "HIGH", True, "t", at - timedelta(days=1 - k))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    digests.start(stream, "MINISTRY", path, str(tmp_path / "checkpoint")).awaitTermination()
    state = digests.watermark(spark, path, "MINISTRY")
    alerts = lambda: sorted((r["batch"], r["project_id"]) for r in spark.read.parquet(f"{path}/alerts").collect())
    first = alerts()
    assert state[1] >= at + timedelta(hours=22) and {b for b, _ in first} == {0, 1, 2} and state[0] >= 9
    # a batch that comes again leaves alerts and watermark as they are
    files = spark.createDataFrame([("p20", "DELAY", "HIGH", True, "t", at + timedelta(hours=20))], schema)
    digests.acknowledge(files, 3, "MINISTRY", path)
    moved, seen = digests.watermark(spark, path, "MINISTRY"), alerts()
    digests.acknowledge(files, 3, "MINISTRY", path)
    assert digests.watermark(spark, path, "MINISTRY") == moved == state and alerts() == seen == first
    assert digests.watermark(spark, path, "ADMIN") == (0, None)
