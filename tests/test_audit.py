"""Audit chains and manifests against Python's own JSON."""

import hashlib
import json
import random
from datetime import datetime

import pytest

from worksight.functions import canonical
from worksight.operators import audit

EVENT = "chain_id string, seq long, action string, actor_id string, entity_type string, entity_id string, payload string, created_at string"


def linked(rows, prev=audit.GENESIS):
    out = []
    for chain, seq, action, actor, kind, entity, payload, created in rows:
        value = {"seq": seq, "prev_hash": prev, "action": action, "actor_id": actor, "entity_type": kind, "entity_id": entity, "payload": None if payload is None else json.loads(payload), "created_at": created}
        prev_hash, prev = prev, hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        out.append((chain, seq, prev_hash, prev))
    return out


def odd_events(chain, n, first=1):
    rng = random.Random(chain)
    texts = ["plain", None, "", 'quote " and \\ back', "tab\tline\n\r\b\f", "".join(map(chr, range(32))), "\x0b\x1f\x7f", "é漢\U0001f600 ", "\\u000b"]
    payloads = [None, "{}", '{"b": 1, "a": 2}', '{"z":{"y":[1.50,1e3,-0.0,null,true],"x":"\\u000B\\u00e9\\/"}}', "[3, 2]", '"text"', '{"a":1,"a":2}', '{"n":123456789012345678901}']
    return [(chain, first + k, *(rng.choice(texts) for _ in range(4)), rng.choice(payloads), f"2024-01-0{1 + k % 9} 10:00:00") for k in range(n)]


def test_chains_of_odd_texts_are_built_and_verify(spark):
    rows = [x for c in ("a", "b", "c") for x in odd_events(c, 40)]
    events = spark.createDataFrame(rows, EVENT).repartition(7)
    chain = audit.build_chain(events).cache()
    got = sorted((r["chain_id"], r["seq"], r["prev_hash"], r["entry_hash"]) for r in chain.collect())
    assert got == sorted(x for c in ("a", "b", "c") for x in linked([r for r in rows if r[0] == c]))
    assert all(r["valid"] and r["events_checked"] == 40 for r in audit.verify_chain(chain).collect())
    # what is stored with its payload as it came verifies, too
    raw = chain.drop("payload").join(events.select("chain_id", "seq", "payload"), ["chain_id", "seq"])
    assert all(r["valid"] for r in audit.verify_chain(raw).collect())


@pytest.mark.parametrize("change", [{"action": "x"}, {"payload": "{not json"}, {"payload": '{"a": 3}'}, {"created_at": None}])
def test_one_changed_event_is_found(spark, change):
    rows = odd_events("a", 12)
    chain = audit.build_chain(spark.createDataFrame(rows, EVENT))
    for column, value in change.items():
        chain = chain.withColumn(column, audit.F.when(audit.F.col("seq") == 7, audit.F.lit(value).cast("string")).otherwise(audit.F.col(column)))
    row = audit.verify_chain(chain).first()
    assert (row["valid"], row["broken_at_seq"], row["reason"], row["events_checked"]) == (False, 7, "entry_hash_mismatch", 6)


def test_chains_go_on_from_their_tips(spark):
    rows = odd_events("a", 30) + odd_events("new", 5)
    begun = audit.build_chain(spark.createDataFrame(rows[:20], EVENT))
    more = spark.createDataFrame([(c, *rest, k) for k, (c, _, *rest) in enumerate(rows[20:])], EVENT.replace("seq long, ", "") + ", at int").repartition(3)
    tail = audit.append_events(begun, more, ["at"])
    got = sorted((r["chain_id"], r["seq"], r["prev_hash"], r["entry_hash"]) for r in begun.unionByName(tail).collect())
    assert got == sorted(linked(rows[:30]) + linked(rows[30:]))
    assert all(r["valid"] for r in audit.verify_chain(begun.unionByName(tail)).collect())
    assert audit.append_events(begun, more.limit(0), ["at"]).count() == 0


def test_json_of_columns_equals_python(spark):
    texts = [r[2] for r in odd_events("a", 200)]
    df = spark.createDataFrame([(t, {"k2": t, "k1": "v", 'q"\n': None}) for t in texts] + [(None, None)], "t string, m map<string,string>")
    rows = df.select("t", "m", canonical.json_text(df.t).alias("jt"), canonical.json_map(df.m).alias("jm"), canonical.json_map(df.m, canonical.TIGHT).alias("jc")).collect()
    for r in rows:
        assert r["jt"] == json.dumps(r["t"], ensure_ascii=False)
        assert r["jm"] == json.dumps(r["m"], sort_keys=True, ensure_ascii=False)
        assert r["jc"] == json.dumps(r["m"], sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_manifest_is_the_digest_of_the_ordered_list(spark):
    at = datetime(2024, 5, 1, 8, 30, 0, 120)
    signals = [("s1", "W1", "DELAY", "HIGH", "late", 'why "so"\n', {"b": "1", "a": "2"}, {}, None, at), ("s2", "W1", "COST_ANOMALY", "CRITICAL", "dear", None, {},
        {"x": "é"}, {"d": "5"}, at.replace(microsecond=0)), ("s3", "W2", "DELAY", "LOW", "t", "e", {}, {}, {}, at)]
    evidence = [("e1", "s1", 0, "f", "1", None, "c"), ("e2", "s1", 1, "g", None, "r", None), ("e3", "s2", 0, "h", "v", "r", "c"), ("e4", "s3", 0, "i", "v", "r", "c")]
    events = [(f"v{k}", "K1", k, "STATUS_CHANGED", None if k == 1 else "OPEN", "UNDER_REVIEW", at.replace(second=k)) for k in range(1, 12)] + [("v99", "K2", 1, "OPENED", None, "OPEN", at)]
    notes = [("n2", "K1", "u1", "later", at.replace(hour=9)), ("n1", "K1", None, "first\ttab", at)]
    frames = (
        spark.createDataFrame([("K1", "W1"), ("K2", "W9")], "case_id string, project_id string"),
        spark.createDataFrame(signals, "signal_id string, project_id string, signal_type string, severity string, title string, explanation string, observed "
            "map<string,string>, reference map<string,string>, difference map<string,string>, created_at timestamp"),
        spark.createDataFrame(evidence, "evidence_id string, signal_id string, place int, field_name string, field_value string, reference_value string, calculation string"),
        spark.createDataFrame(events, "event_id string, case_id string, seq long, event_type string, from_status string, to_status string, created_at timestamp"),
        spark.createDataFrame(notes, "note_id string, case_id string, author_id string, body string, created_at timestamp"),
    )
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()
    want = []
    for s in (signals[1], signals[0]):
        want.append({"kind": "signal", "id": s[0], "hash": digest(dict(zip(("id", "type", "severity", "title", "explanation", "observed", "reference", "difference", "created"), (s[0], *s[2:]), strict=True)))})
    for e in (evidence[2], evidence[0], evidence[1]):
        want.append({"kind": "evidence", "id": e[0], "hash": digest(dict(zip(("id", "field", "value", "reference", "calculation"), (e[0], *e[3:]), strict=True)))})
    want += [{"kind": "case_event", "id": v[0], "hash": digest({"id": v[0], "type": v[3], "from": v[4], "to": v[5], "created": v[6]})} for v in events[:-1]]
    want += [{"kind": "note", "id": n[0], "hash": digest({"id": n[0], "author": n[2], "body": n[3], "created": n[4]})} for n in (notes[1], notes[0])]
    got = {r["case_id"]: (r["items"], r["root"]) for r in audit.manifest(audit.manifest_items(*frames)).collect()}
    assert got["K1"] == (len(want), digest(want)) and got["K2"][0] == 1 and len(got) == 2
    assert audit.manifest(audit.manifest_items(*(f.limit(0) for f in frames))).count() == 0
