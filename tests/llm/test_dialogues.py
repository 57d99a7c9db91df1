"""Repair of conversations against a plain version that tries all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from worksight.llm import dialogues, queries

SCHEMA = "conv_id long, turn long, role string, text string, _key string"
FORM = re.compile("(s?(ua)+)?")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_damage(rows):
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else x
        draw = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if draw:
            yield from [(conv, turn, "user" if draw == 4 else role, "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text)] * (1 + (draw == 3))


def plain_repair(rows, ids):
    groups = {c: [] for c in ids}
    for row in rows:
        groups[row[0]].append(row[1:])
    for conv, turns in groups.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            shown = text.strip(SPACE)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        steps = {"": "su", "s": "u", "u": "a", "a": "u"}  # what may follow the last initial

        @cache
        def best(i, last, put=0, turns=turns, faults=faults, steps=steps):
            """cost, audit and lines of the cheapest repair from turn i on, after the initial `last` and `put` insertions in a row."""
            found = []
            if i == len(turns) and last in ("", "a"):
                found.append((0, "", ()))
            if put < 3:
                role = "assistant" if last == "u" else "user"
                cost, audit, lines = best(i, role[0], put + 1)
                found.append((cost + 2, "I" + audit, (role + ":", *lines)))
            if i < len(turns):
                cost, audit, lines = best(i + 1, last)
                found.append((cost + 3, "D" + audit, lines))
                _, role, text = turns[i]
                if faults[i] not in ("blank", "duplicate"):
                    cut = faults[i] == "truncated"
                    for edit, own, price in [("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)]:
                        if own and own[0] in steps[last]:
                            cost, audit, lines = best(i + 1, own[0])
                            found.append((cost + price + cut, edit + audit, (f"{own}:{text}", *lines)))
            return min(found, key=lambda x: x[:2], default=(10**6, "", ()))

        cost, audit, lines = best(0, "")
        assert FORM.fullmatch("".join(x[0] for x in lines))
        numbers = {t for t, _, _ in turns if t is not None}
        initials = [r[:1] for _, r, _ in turns]
        yield {
            "conv_id": conv, "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }


def by_id(rows):
    return sorted(rows, key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0))


def test_query_equals_trying_all_edits(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [r.asDict() for r in queries.op11_dialogue_repair(spark, "/root/testdata/sf0.01").collect()]
    assert by_id(got) == by_id(plain_repair(plain_damage(rows), {r[0] for r in rows}))


def test_odd_turns_equal_trying_all_edits(spark, monkeypatch):
    monkeypatch.setattr(dialogues, "RANGE_ROWS", 20)
    monkeypatch.setattr(dialogues, "RANGE_SIGNATURES", 7)
    rng = random.Random(4)
    texts = ["Yes.", "No", " \t", None, "", "A\nb!", "é?", "A. ", "x" * 9, "."]
    rows = [(rng.choice([*range(25), None]), rng.choice([*range(9), None]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(texts)) for _ in range(200)]
    rows += [(99, t, rng.choice(["user", "assistant"]), f"Turn {t}.") for t in range(90)]  # a conversation over several ranges
    rows += [(98, None, "user", "same.")] * 30 + [(97, 3, "assistant", "a"), (97, 1, "user", "z" * 200_000)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)
    ids = {r[0] for r in rows}
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert by_id(r.asDict() for r in dialogues.repair(docs).collect()) == by_id(plain_repair(clean, ids))
    assert by_id(r.asDict() for r in dialogues.repair(dialogues.damaged(docs), docs).collect()) == by_id(plain_repair(plain_damage(rows), ids))


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hello?", ""), (1, 1, "user", "Still there?", ""), (1, 2, "assistant", "Yes.", ""), (2, 0, "system", "", "")]
    got = dialogues.mended(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "user", "Hello?"), (1, 1, "assistant", ""), (1, 2, "user", "Still there?"), (1, 3, "assistant", "Yes.")]


def test_no_turns_and_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dialogues.repair(none).count() == 0
    row = dialogues.repair(none, spark.createDataFrame([(5,)], "conv_id long")).first()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("n", [3000])
def test_states_are_worked_out_once(monkeypatch, n):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("uauaUAsD") for _ in range(rng.randrange(1, 9))) for _ in range(n)}, key=lambda x: x[::-1])
    made = []
    own = dialogues.state
    monkeypatch.setattr(dialogues, "state", lambda letter, after: made.append(1) or own(letter, after))
    assert [x[0] for x in dialogues.audits(iter(words))] == words
    assert len(made) == len({w[k:] for w in words for k in range(len(w))})
