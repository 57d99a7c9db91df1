import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from worksight.operators import audit, cases, detect, duplicates, evaluate, forest, fusion, reporting
from worksight.streaming import alerts

WORK = (
    "dataset_id string, source_row_number long, id string, work_id string, mp_name string, state string, district string, location_text string, latitude decimal(10,7), longitude decimal(10,7), category string, "
    "description string, estimated_cost decimal(14,2), sanctioned_cost decimal(14,2), expenditure decimal(14,2), financial_progress decimal(5,2), physical_progress decimal(5,2), sanction_date date, "
    "start_date date, completion_date date, status string, implementing_agency string, expected_duration_days int"
)


def works(spark, rows):
    base = {"dataset_id": "D", "district": "X", "description": "a", "sanctioned_cost": Decimal(100)}
    names = [c.split()[0] for c in WORK.split(", ")]
    full = [{**base, "source_row_number": k + 1, "id": str(k), "work_id": f"W{k}", **r} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], WORK)


def test_peers_leave_one_out(spark):
    rng = random.Random(1)
    costs = {g: [Decimal(rng.choice([10, 20, 30, 40, 55, 70])) for _ in range(n)] for g, n in (("A", 6), ("B", 11), ("C", 5), ("E", 8))}
    rows = [{"district": g, "sanctioned_cost": c} for g, cs in costs.items() for c in cs]
    got = {r.project_id: r for r in detect.peer_stats(works(spark, rows)).collect()}
    k = 0
    for cs in costs.values():
        for i, own in enumerate(cs):
            others = sorted(cs[:i] + cs[i + 1 :])
            if len(cs) < 6:
                assert str(k) not in got
            else:
                n, r = len(others), got[str(k)]
                assert float(r.peer_median_cost) == float(others[(n - 1) // 2] + others[n // 2]) / 2
                assert r.peer_p75_cost == others[round(0.75 * (n - 1))]
                assert float(r.peer_percentile) == pytest.approx(round(sum(o <= own for o in others) / n * 100, 1))
            k += 1


def test_compliance_terms(spark):
    texts = ["temple compound wall", "Contemplation garden works", "office 12 building", "repair work at private school", None, ""]
    got = {r.id: r.code for r in detect.category_findings(works(spark, [{"description": t} for t in texts])).collect()}
    assert got == {"0": "RELIGIOUS_STRUCTURE", "3": "PRIVATE_PROPERTY"}
    payee = detect.agency_findings(works(spark, [{"implementing_agency": "Sri Deva Trust No 4"}, {"implementing_agency": None}])).collect()
    assert [r.code for r in payee] == ["UNAPPROVED_TRUST"]


def test_agency_concentration(spark):
    def run(shares):
        return {r.project_id: r.severity for r in detect.agency_concentration(works(spark, [{"implementing_agency": a, "sanctioned_cost": Decimal(c)} for a, c in shares])).collect()}

    assert run([("A", 10), ("A", 10), ("A", 10), ("B", 10)]) == {"0": "CRITICAL", "1": "CRITICAL", "2": "CRITICAL"}
    assert set(run([("A", 10), ("A", 10), ("B", 10), ("B", 10)]).values()) == {"HIGH"}
    assert run([("A", 10), ("A", 10)]) == {}


def test_fusion(spark):
    def fuse(rows):
        df = spark.createDataFrame([("D", "1", t, s, on, f"{t}", src, c) for t, s, on, src, c in rows], "dataset_id string, project_id string, signal_type string, "
            "severity string, triggered boolean, title string, source_type string, contextual_confidence string")
        return fusion.fuse(df).first()

    assert float(fuse([("DELAY", "HIGH", True, "RULE", None)]).score) == 3.0
    assert float(fuse([("DELAY", "HIGH", True, "RULE", None), ("DUPLICATE", "HIGH", True, "NLP", "low")]).score) == 3.0 + 2.25 + 1.5
    assert float(fuse([("DELAY", "HIGH", True, "RULE", None), ("DUPLICATE", "HIGH", True, "NLP", "high"), ("ML_ANOMALY", "MEDIUM", True, "ML", None)]).convergence_bonus) == 3.0
    none = fuse([("DELAY", "HIGH", False, "RULE", None)])
    assert float(none.score) == 0 and none.level == "LOW"
    levels = spark.createDataFrame([(0.5,), (3.0,), (5.0,), (8.0,)], "s double").select(fusion.priority_label(F.col("s"))).collect()
    assert [r[0] for r in levels] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def test_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(25)]
    rows = []
    for _ in range(60):
        place = rng.choice([None, (13.0 + rng.random() / 20, 77.0 + rng.random() / 20)])
        rows.append({"description": " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))), "sanctioned_cost": Decimal(rng.randint(90, 110)),
            "category": rng.choice(["a", "b"]), **({"latitude": Decimal(f"{place[0]:.5f}"), "longitude": Decimal(f"{place[1]:.5f}")} if place else {})})
    df = works(spark, rows)
    got = {(r.a_id, r.b_id): r.combined_score for r in duplicates.duplicate_pairs(df).collect()}
    texts = [r["description"].split() for r in rows]
    terms = [t + [" ".join(p) for p in zip(t, t[1:], strict=False)] for t in texts]
    vocabulary = sorted({x for t in terms for x in t})
    counts = np.array([[t.count(v) for v in vocabulary] for t in terms], float)
    weights = counts * (np.log((1 + 60) / (1 + (counts > 0).sum(axis=0))) + 1)
    weights /= np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)
    cosine, want = weights @ weights.T, {}
    for a in range(60):
        for b in range(60):
            if not str(a) < str(b) or cosine[a, b] < 0.25:
                continue
            la, lb, d = rows[a].get("latitude"), rows[b].get("latitude"), None
            if la is not None and lb is not None:
                p, q = np.radians([float(la), float(rows[a]["longitude"])]), np.radians([float(lb), float(rows[b]["longitude"])])
                h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
                d = 2 * 6371000 * np.arcsin(np.sqrt(h))
                if d > 2000:
                    continue
            ca, cb = float(rows[a]["sanctioned_cost"]), float(rows[b]["sanctioned_cost"])
            score = 0.4 * cosine[a, b] + 0.2 * (1 - abs(ca - cb) / max(ca, cb)) + 0.1 * (rows[a]["category"] == rows[b]["category"])
            score = score + 0.25 * (1 - d / 2000) if d is not None else score / 0.75
            if round(min(1, score), 4) >= 0.6:
                want[str(a), str(b)] = round(min(1, score), 4)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want) and want


def test_forest(spark):
    rng = np.random.default_rng(0)
    rows = [("D", str(k), *map(float, rng.normal(0, 1, 5))) for k in range(300)] + [("D", "odd", 30.0, 30.0, 30.0, 30.0, 30.0)] + [("small", str(k), 0.0, 0.0, 0.0, 0.0, 0.0) for k in range(5)]
    df = spark.createDataFrame(rows, "dataset_id string, id string, " + ", ".join(f"{c} double" for c in forest.FEATURES))
    one = {r.project_id: r.ml_anomaly_score for r in forest.iforest_scores(df).collect()}
    two = {r.project_id: r.ml_anomaly_score for r in forest.iforest_scores(df.repartition(7)).collect()}
    assert one == two and len(one) == 301 and min(one, key=one.get) == "odd" and one["odd"] < -0.05


def test_chain(spark):
    rows = [(c, k, f"a{k}", "o", "case", c, '{"n":"é"}', f"t{k}") for c in ("x", "y", "z") for k in range(1, 6)]
    chain = audit.build_chain(spark.createDataFrame(rows, "chain_id string, seq long, action string, actor_id string, entity_type string, entity_id string, payload string, created_at string")).cache()
    assert all(r.valid and r.events_checked == 5 for r in audit.verify_chain(chain).collect())
    broken = chain.filter("not (chain_id = 'z' and seq = 2)").withColumn("action", F.when(F.expr("chain_id = 'x' and seq = 3"), "forged").otherwise(F.col("action")))
    got = {r.chain_id: (r.valid, r.broken_at_seq, r.reason) for r in audit.verify_chain(broken).collect()}
    assert got == {"x": (False, 3, "entry_hash_mismatch"), "y": (True, None, None), "z": (False, 2, "sequence_gap")}


def test_case_log(spark):
    log = [("a", 1, "CLOSED", None, None, None), ("b", 1, "FIELD_VERIFICATION", None, None, None), ("b", 2, "CLOSED", "NOT_SUBSTANTIATED", "OTHER", "fine"), ("c", 1,
        "UNDER_REVIEW", None, None, None), ("c", 2, "CLOSED", "NOT_SUBSTANTIATED", "OTHER", "x"), ("b", 3, "UNDER_REVIEW", None, None, None)]
    df = spark.createDataFrame(log, "case_id string, seq long, to_status string, resolution_type string, resolution_reason string, resolution_summary "
        "string").withColumn("ts", F.timestamp_seconds("seq")).withColumn("event_type", F.lit("STATUS_CHANGED"))
    state, violations = cases.replay_cases(df)
    assert sorted((r.case_id, r.violation) for r in violations.collect()) == [("a", "closing_needs_reason"), ("a", "closing_needs_text"), ("a", "resolution_type_required"), ("a", "transition_not_allowed"), ("c", "transition_not_allowed")]
    final = {r.case_id: (r.status, r.closed_at is None, r.resolution_type) for r in cases.case_state(df).collect()}
    assert final["b"] == ("UNDER_REVIEW", True, "NOT_SUBSTANTIATED") and final["c"][1] is False


def test_confusion(spark):
    rows = [(True, True)] * 3 + [(True, False)] + [(False, False)] * 5 + [(False, True)]
    found = spark.createDataFrame([(f, i) for f, i in rows], "flagged boolean, injected boolean")
    r = evaluate.confusion(found).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.precision, r.recall, r.f1) == (3, 1, 5, 1, 0.75, 0.75, 0.75) and r.fpr == pytest.approx(1 / 6, abs=1e-4)
    none = evaluate.confusion(found.withColumn("flagged", F.lit(False))).first()
    assert none.precision is None and none.f1 is None and none.recall == 0


def test_digest_moves_on(spark):
    start = spark.createDataFrame([], "role string, last_seen_seq long, cutoff timestamp")
    one = reporting.ack_digest(start, "MP", "2024-01-01", 5)
    two = reporting.ack_digest(one, "MP", "2024-02-01", 9)
    assert [(r.role, r.last_seen_seq) for r in two.collect()] == [("MP", 9)]


def test_alerts_stream(spark, tmp_path):
    rows = works(spark, [{"financial_progress": Decimal(90), "physical_progress": Decimal(10)}, {"description": "new temple"}, {}])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    alerts.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.signal_type for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["COMPLIANCE", "FIN_PHYS_GAP"]


def test_plans_have_no_cartesian_product(spark):
    df = works(spark, [{"description": "x y"}])
    for out in (duplicates.duplicate_pairs(df), detect.peer_stats(df), detect.quality_issues(df)):
        assert "CartesianProduct" not in out._jdf.queryExecution().toString()
