"""The registered queries read all signals of a detection run, against fusion in plain Python."""

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

from worksight import queries
from worksight.bench_views import TODAY
from worksight.operators import duplicates
from worksight.plans import detection
from worksight.schemas import ANOMALY_HIGH, ANOMALY_TRIGGER, SEVERITY_FACTOR, SIGNAL_WEIGHT, WEAK_DUPLICATE_FACTOR

from .test_detection import works


def test_queries_fuse_duplicates_and_outliers_too(spark, monkeypatch):
    plain = {"work_id": None, "category": "road", "sanctioned_cost": Decimal(100), "expenditure": Decimal(50), "financial_progress": Decimal(50), "physical_progress": Decimal(50)}
    names = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()
    rows = [{**plain, "description": f"{n} {n}road {n}lane", "latitude": Decimal(10 + k), "longitude": Decimal(70 + k), "implementing_agency": f"agency {n}"} for k, n in enumerate(names)]
    rows.append({**rows[0], "description": rows[0]["description"]})  # a twin of the first
    rows.append({**rows[1], "latitude": Decimal(40), "expenditure": Decimal(99999), "financial_progress": Decimal(100), "physical_progress": Decimal(0)})  # an outlier
    df = works(spark, rows).cache()
    monkeypatch.setattr(queries, "works", lambda s, d: df)
    found = {r.project_id: r for r in queries.queries()["priorities"](spark, "").collect()}

    pairs = duplicates.duplicate_pairs(df)
    rules = detection.rule_signals(df, TODAY).collect()
    scores = detection.run_detection(df, TODAY)["scores"].collect()
    parts = [(r.project_id, r.signal_type, r.severity, r.source_type, None) for r in rules]
    for r in pairs.collect():
        severity = {"high": "HIGH", "medium": "MEDIUM"}.get(r.contextual_confidence, "LOW")
        parts += [(k, "DUPLICATE", severity, "NLP", r.contextual_confidence) for k in (r.a_id, r.b_id)]
    parts += [(r.project_id, "ML_ANOMALY", "HIGH" if r.ml_anomaly_score <= ANOMALY_HIGH else "MEDIUM", "ML", None) for r in scores if r.ml_anomaly_score < ANOMALY_TRIGGER]
    total, engines = defaultdict(Decimal), defaultdict(set)
    for i, kind, severity, engine, band in parts:
        value = SIGNAL_WEIGHT.get(kind, 1.0) * SEVERITY_FACTOR.get(severity, 1.0) * (WEAK_DUPLICATE_FACTOR if kind == "DUPLICATE" and band in ("low", "unavailable") else 1.0)
        total[i] += Decimal(str(value)).quantize(Decimal("0.01"), ROUND_HALF_UP)
        engines[i] |= {engine} & {"RULE", "ML", "NLP"}
    want = {i: t + Decimal((0, 0, 1.5, 3)[len(engines[i])]) for i, t in total.items()}
    assert {i: r.score for i, r in found.items()} == want
    assert {"NLP", "ML"} <= {e for x in engines.values() for e in x} and any(len(x) > 1 for x in engines.values())

    kinds = {r.signal_type for r in queries.queries()["signal_counts"](spark, "").collect()}
    assert {"DUPLICATE", "ML_ANOMALY"} <= kinds
