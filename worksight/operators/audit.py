"""Audit chains of hash-linked events: verification in parallel, building per chain, and evidence manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import TIGHT, canonical, canonical_json, json_map, json_number, json_object, json_text
from ..schemas import PRIORITY_ORDER

GENESIS = "0" * 64
TEXTS = ("action", "actor_id", "created_at", "entity_id", "entity_type")


def entry_hash() -> Column:
    """SHA-256 of the event's canonical JSON."""
    fields = {c: json_text(F.col(c)) for c in (*TEXTS, "prev_hash")}
    fields |= {"payload": F.coalesce(canonical_json(F.col("payload")), F.lit("null")), "seq": json_number(F.col("seq"))}
    return F.sha2(json_object(fields, TIGHT), 256)


def verify_chain(events: DataFrame) -> DataFrame:
    """valid, broken_at_seq, reason, events_checked, chain_tip (null if broken): one row for each chain_id.

    Each event is looked at beside its predecessor by a join on seq; the first break is the least failing seq, and at one
    seq a gap comes before a wrong link and that before a wrong hash. Missing and repeated seqs are gaps."""
    keys = ["chain_id", "seq"]
    per = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("prev_hash").alias("prev_hash"), F.min("entry_hash").alias("entry_hash"), *[F.min(c).alias(c) for c in (*TEXTS, "payload")])
    before = per.select("chain_id", (F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("_tip"))
    seen = per.join(before, keys, "left")
    gap = F.when(F.col("seq") < 1, F.lit(1)).when((F.col("seq") > 1) & F.col("_tip").isNull(), 0).when(F.col("n") > 1, F.col("seq") + 1)
    prev = F.when(F.col("seq") == 1, F.lit(GENESIS)).otherwise(F.col("_tip"))
    checks = F.array_compact(F.array(
        F.when(gap > 0, F.struct(gap.cast("long").alias("at"), F.lit(0).alias("k"))),
        F.when((F.col("seq") >= 1) & prev.isNotNull() & ~F.col("prev_hash").eqNullSafe(prev), F.struct(F.col("seq").cast("long").alias("at"), F.lit(1).alias("k"))),
        F.when((F.col("seq") >= 1) & ~F.col("entry_hash").eqNullSafe(entry_hash()), F.struct(F.col("seq").cast("long").alias("at"), F.lit(2).alias("k"))),
    ))
    # a missing seq is the one after the last of an unbroken run that something follows: a successor that isn't there
    after = per.select("chain_id", (F.col("seq") - 1).alias("seq"), F.lit(True).alias("_next"))
    top = per.groupBy("chain_id").agg(F.max("seq").alias("_top"), F.min("seq").alias("_low"), F.sum("n").alias("events"), F.max_by("entry_hash", "seq").alias("tip"))
    holes = per.filter("seq >= 0").join(after, keys, "left").filter("_next is null").join(top, "chain_id").filter("seq < _top").select("chain_id", F.struct((F.col("seq") + 1).cast("long").alias("at"), F.lit(0).alias("k")).alias("b"))
    starts = top.filter("_low > 1").select("chain_id", F.struct(F.lit(1).cast("long").alias("at"), F.lit(0).alias("k")).alias("b"))
    breaks = seen.select("chain_id", F.explode(checks).alias("b")).unionByName(holes).unionByName(starts).groupBy("chain_id").agg(F.min("b").alias("b"))
    out = top.join(breaks, "chain_id", "left")
    names = F.array(F.lit("sequence_gap"), F.lit("prev_hash_mismatch"), F.lit("entry_hash_mismatch"))
    return out.select(
        "chain_id", F.col("b").isNull().alias("valid"), F.col("b.at").alias("broken_at_seq"), F.get(names, F.col("b.k")).alias("reason"),
        F.when(F.col("b").isNull(), F.col("events")).otherwise(F.col("b.at") - 1).alias("events_checked"), F.when(F.col("b").isNull(), F.col("tip")).alias("chain_tip"),
    )


def build_chain(events: DataFrame, tips: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """events (chain_id, seq, action, actor_id, entity_type, entity_id, payload, created_at) with the payload in canonical form, prev_hash and entry_hash.

    tips: chain_id, seq and entry_hash of the last event of chains that go on; chains without one begin at the genesis hash.
    order: columns of events by which they are numbered on from the tip; without, they have their seq.

    A chain is sequential by definition. Its events pass in order through one task that carries the last hash and keeps no event, so a chain of
    any length takes as much memory as a short one; chains are built side by side."""
    names = ["chain_id", "seq", *TEXTS, "payload"]
    by = order or ["seq"]
    own = events.select(
        F.col("chain_id").cast("string").alias("chain_id"), F.lit(None).cast("long").alias("seq") if order else F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("string").alias(c) for c in (*TEXTS, "payload")],
        F.lit(None).cast("string").alias("_tip"), F.struct(*by).alias("_order"),
    )
    if tips is not None:
        none = [F.lit(None).cast("string").alias(c) for c in (*TEXTS, "payload")]
        own = own.unionByName(tips.select(F.col("chain_id").cast("string").alias("chain_id"), F.col("seq").cast("long").alias("seq"), *none,
            F.col("entry_hash").alias("_tip"), F.lit(None).cast(own.schema["_order"].dataType).alias("_order")))
    dealt = own.repartition("chain_id").sortWithinPartitions("chain_id", F.col("_tip").isNull(), "_order").select(*names, "_tip")
    genesis, texts, tidy = GENESIS, TEXTS, canonical

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, prev, last, begun = None, genesis, 0, False
        for batch in batches:
            out: dict[str, list] = {c: [] for c in [*names, "prev_hash", "entry_hash"]}
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(names) + 1)), strict=True):
                value, tip = dict(zip(names, row, strict=False)), row[-1]
                if not begun or value["chain_id"] != chain:
                    chain, prev, last, begun = value["chain_id"], genesis, 0, True
                if tip is not None:
                    prev, last = tip, value["seq"]
                    continue
                last = value["seq"] if value["seq"] is not None else last + 1
                value |= {"seq": last, "payload": tidy(value["payload"]), "prev_hash": prev}
                parts = [f'"{c}":{json.dumps(value[c], ensure_ascii=False)}' for c in texts]
                parts += [f'"payload":{value["payload"] or "null"}', f'"prev_hash":"{prev}"', f'"seq":{last}']
                prev = hashlib.sha256(f"{{{','.join(parts)}}}".encode()).hexdigest()
                for c, x in (value | {"entry_hash": prev}).items():
                    out[c].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if c == "seq" else pa.string()) for c, x in out.items()], list(out))

    return dealt.mapInArrow(run, ", ".join(f"{c} {'long' if c == 'seq' else 'string'}" for c in [*names, "prev_hash", "entry_hash"]))


def append_events(chain: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """The events that follow the chains' tips: numbered on in the given order and linked to what is there. A chain that is new begins at 1."""
    tips = chain.groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"))
    return build_chain(events, tips, order)


def _time(c: Column | str) -> Column:
    """A time as text, with six decimals where it has a fraction."""
    c = F.col(c) if isinstance(c, str) else c
    fraction = F.date_format(c, "SSSSSS")
    return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)))


def _digest(fields: dict[str, Column]) -> Column:
    return F.sha2(json_object(fields), 256)


def manifest_items(cases: DataFrame, signals: DataFrame, evidence: DataFrame, events: DataFrame, notes: DataFrame) -> DataFrame:
    """case_id, kind, id, hash, place: what a report on a case holds, each with the digest of its content as JSON: the signals of its work
    from the gravest down, then their evidence in the same order, the case's events and its notes by time. place sorts them.

    cases: case_id, project_id. signals: signal_id, project_id, signal_type, severity, title, explanation, observed, reference, difference (maps of texts),
    created_at. evidence: evidence_id, signal_id, place, field_name, field_value, reference_value, calculation. events: event_id, case_id, seq, event_type,
    from_status, to_status, created_at. notes: note_id, case_id, author_id, body, created_at. Times are timestamps; ids become texts."""
    text = lambda c: json_text(F.col(c).cast("string"))
    place = lambda kind, *by: F.struct(F.lit(kind).alias("kind"), *[c.alias(f"k{k}") for k, c in enumerate(by)]).alias("place")
    none, no_text = F.lit(0).cast("long"), F.lit("")
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY_ORDER.items() for x in kv])[F.col("severity")], F.lit(9)).cast("long")
    own = cases.select(F.col("case_id").cast("string").alias("case_id"), "project_id").join(signals, "project_id")
    own = own.withColumn("signal_id", F.col("signal_id").cast("string"))
    found = own.select("case_id", F.lit("signal").alias("kind"), F.col("signal_id").alias("id"), _digest({
        "id": text("signal_id"), "type": text("signal_type"), "severity": text("severity"), "title": text("title"), "explanation": text("explanation"), "observed": json_map(F.col("observed")),
        "reference": json_map(F.col("reference")), "difference": json_map(F.col("difference")), "created": json_text(_time("created_at")),
    }).alias("hash"), place(0, rank, F.col("signal_type"), F.col("signal_id"), none))
    rows = own.select("case_id", "signal_id", rank.alias("_rank"), "signal_type").join(evidence.withColumn("signal_id", F.col("signal_id").cast("string")), "signal_id")
    found = found.unionByName(rows.select("case_id", F.lit("evidence").alias("kind"), F.col("evidence_id").cast("string").alias("id"), _digest({
        "id": text("evidence_id"), "field": text("field_name"), "value": text("field_value"), "reference": text("reference_value"), "calculation": text("calculation"),
    }).alias("hash"), place(1, F.col("_rank"), F.col("signal_type"), F.col("signal_id"), F.col("place").cast("long"))))
    found = found.unionByName(events.select(F.col("case_id").cast("string").alias("case_id"), F.lit("case_event").alias("kind"), F.col("event_id").cast("string").alias("id"), _digest({
        "id": text("event_id"), "type": text("event_type"), "from": text("from_status"), "to": text("to_status"), "created": json_text(_time("created_at")),
    }).alias("hash"), place(2, F.col("seq").cast("long"), no_text, no_text, none)))
    return found.unionByName(notes.select(F.col("case_id").cast("string").alias("case_id"), F.lit("note").alias("kind"), F.col("note_id").cast("string").alias("id"), _digest({
        "id": text("note_id"), "author": text("author_id"), "body": text("body"), "created": json_text(_time("created_at")),
    }).alias("hash"), place(3, F.unix_micros("created_at"), F.col("note_id").cast("string"), no_text, none)))


def manifest(items: DataFrame) -> DataFrame:
    """case_id, items (their number), root: the SHA-256 of the list of a case's items, in order, as JSON. items: as manifest_items() gives them.

    A case's items pass in order through one task that feeds the digest and keeps none of them."""
    line = json_object({c: json_text(F.col(c)) for c in ("kind", "id", "hash")}).alias("line")
    dealt = items.select("case_id", line, "place").repartition("case_id").sortWithinPartitions("case_id", "place").select("case_id", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, n, digest = None, 0, None
        for batch in batches:
            out = []
            for own, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n == 0 or own != case:
                    if n:
                        digest.update(b"]")
                        out.append((case, n, digest.hexdigest()))
                    case, n, digest = own, 0, hashlib.sha256(b"[")
                digest.update(((", " if n else "") + line).encode())
                n += 1
            yield table(out)
        if n:
            digest.update(b"]")
            yield table([(case, n, digest.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["case_id", "items", "root"])

    return dealt.mapInArrow(run, "case_id string, items long, root string")
