"""Repair of conversations: faults of turns, and the cheapest edits that give a dialogue its form.

A conversation's signature has a letter for each turn, by role and fault. The states of an automaton over the signatures of
all conversations are their different suffixes: signatures sorted from the end stand next to those they share most with,
so a suffix's costs are worked out once, when it comes up first, and dropped when the last signature with it has passed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import in_ranges, numbered
from .common import ship, stash

ship(__name__)
SPACE = " \t\n\x0b\x0c\r"
#: Letters of a turn, by the role's initial (s, u, a, another) and the first fault.
FAULTS = {"none": "suax", "truncated": "SUAX", "blank": "0123", "duplicate": "4567"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar `(s?(ua)+)?` over role initials: before anything, after s, after u, after a. What a role leads to, the states in which a
#: dialogue may end, and what the role is that can be put in.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL, NEXT = (0, 3), (2, 2, 3, 2)
#: Turns that one task puts in order, about.
RANGE_ROWS = 20_000
#: Signatures that one task of the automaton gets, about.
RANGE_SIGNATURES = 5_000
NEVER = 1 << 60


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with faults put in, drawn by crc32 of `conv_id:turn` modulo 20: 0 drops a turn, 1 empties
    it, 2 takes its `.!?`, 3 repeats it, 4 makes it the user's. A null role or text is one space, in the hash a null id or turn too."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(space("role"))
    out = turns.select("conv_id", "turn", "role", "text", draw.alias("_d")).filter("_d <> 0")
    twice = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice).drop("_copy")


def key_of(conv_id: Column) -> Column:
    """A text for each id, one of its own for null, that joins and sorts."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def in_order(turns: DataFrame) -> DataFrame:
    """_key, _place, _block, turn, role, text, n, _letters: the different turns of each conversation, numbered by turn (null first), role and text,
    how often each is there, and the letters of all n: what a conversation has said before in the same role is a duplicate."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    each = turns.select(key_of(F.col("conv_id")).alias("_key"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    said = F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary")))
    at = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    each = stash(each.groupBy("_key", "turn", "role", "text").agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("_said", said), "dialogue-turns")
    first = each.groupBy("_key", "_said").agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_turns")).filter("_turns > 1").drop("_turns")
    each = each.join(first, ["_key", "_said"], "left")
    shown = F.rtrim("text", F.lit(SPACE))
    again = F.coalesce(at != F.col("_first"), F.lit(False))
    fault = F.when(shown == "", "blank").when(again, "duplicate").when(~F.substring(shown, -1, 1).isin(".", "!", "?"), "truncated").otherwise("none")
    kind = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    kind = F.when((F.length("role") > 0) & (kind > 0), kind).otherwise(4)
    letter = lambda f: F.substring(F.element_at(F.create_map(*(F.lit(x) for kv in FAULTS.items() for x in kv)), f), kind, F.lit(1))
    more = F.when(fault == "blank", letter(F.lit("blank"))).otherwise(letter(F.lit("duplicate")))
    each = each.withColumn("_letters", F.concat(letter(fault), F.repeat(more, F.col("n") - 1))).drop("_said", "_first")
    order = ["_key", "turn", "role", "text"]
    ranges = in_ranges(each, order, 1 + each.count() // RANGE_ROWS, "dialogue-ranges")
    return numbered(ranges, ["_key"], order[1:], "_place")


def conversations(rows: DataFrame) -> DataFrame:
    """_key, letters, gaps: a row for each conversation of in_order(). Its turns meet as one letter each, those of one range first."""
    letters = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*c))), lambda x: x[c[1]]), "")
    parts = rows.groupBy("_key", "_block").agg(letters(["_place", "_letters"]).alias("_letters"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    whole = parts.groupBy("_key").agg(letters(["_block", "_letters"]).alias("letters"), F.min("low").alias("low"), F.max("high").alias("high"))
    turns = rows.filter("turn is not null").groupBy("_key", "turn").agg(F.lit(1)).groupBy("_key").agg(F.count("turn").alias("turns"))
    return whole.join(turns, "_key", "left").select("_key", "letters", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"))


def state(letter: str, after: tuple) -> tuple:
    """The automaton's state for a suffix that begins with a turn and goes on as `after`: for each state of the grammar the cost to go and the first edit
    of the cheapest repair, the least letter of those that are as cheap."""
    costs, cut = after[0], TRUNCATED if letter.isupper() else 0
    options = []
    for q in range(4):
        found = {"D": DELETE + costs[q]}
        if letter != "D":
            if (to := STEPS.get((q, letter.lower()))) is not None:
                found["K"] = KEEP + cut + costs[to]
            found["R"] = REROLE + cut + costs[NEXT[q]]
        options.append(found)
    return settled(options)


def settled(options: list[dict[str, int]]) -> tuple:
    """The costs and first edits if turns can be put in before these options, too."""
    base = [min(x.values(), default=NEVER) for x in options]
    costs = [0, 0, min(base[2], INSERT + base[3]), min(base[3], INSERT + base[2])]
    costs[0], costs[1] = min(base[0], INSERT + costs[2]), min(base[1], INSERT + costs[2])
    for q, x in enumerate(options):
        x["I"] = INSERT + costs[NEXT[q]]
    return costs, [min(e for e, c in x.items() if c == costs[q]) for q, x in enumerate(options)]


ENDS = settled([{"": 0} if q in FINAL else {} for q in range(4)])


def audits(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """signature, cost, audit of signatures that come sorted by what they are backwards."""
    states, last = [ENDS], ""  # the states of the suffixes of the last signature, from the shortest
    for signature in signatures:
        word, k = signature[::-1], 0
        while k < min(len(word), len(last)) and word[k] == last[k]:
            k += 1
        del states[k + 1 :]
        for letter in word[k:]:
            states.append(state(letter, states[-1]))
        last, q, at, out = word, 0, len(word), []
        while edit := states[at][1][q]:
            out.append(edit)
            q = STEPS[q, word[at - 1].lower()] if edit == "K" else q if edit == "D" else NEXT[q]
            at -= edit != "I"
        yield signature, states[-1][0][0], "".join(out)


def repairs(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit of the different signatures of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for found in audits(x for batch in batches for x in batch.column(0).to_pylist()):
            waiting.append(found)
            if len(waiting) == 1000:
                yield table(waiting)
                waiting = []
        yield table(waiting)

    def table(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["signature", "cost", "audit"])

    unlike = stash(signatures.distinct(), "dialogue-signatures")
    dealt = unlike.repartitionByRange(1 + unlike.count() // RANGE_SIGNATURES, F.reverse("signature")).sortWithinPartitions(F.reverse("signature"))
    return dealt.mapInArrow(run, "signature string, cost long, audit string")


class Repair:
    """A conversation whose turns pass one after the other: each is edited, and its line hashed, as it comes."""

    def __init__(self, key: str, audit: str, whole: bool):
        self.key, self.edits, self.whole = key, iter(audit), whole
        self.q, self.place, self.digest = 0, 0, hashlib.sha256()

    def line(self, role: str, text: str) -> list[tuple]:
        self.digest.update(("\n" * (self.place > 0) + f"{role}:{text}").encode())
        self.place += 1
        return [(self.key, self.place - 1, role, text)] if self.whole else []

    def edited(self, edit: str, role: str, text: str) -> list[tuple]:
        if edit == "D":
            return []
        self.q = STEPS[self.q, role[:1]] if edit == "K" else NEXT[self.q]
        return self.line(role if edit == "K" else "user" if self.q == 2 else "assistant", "" if edit == "I" else text)

    def turn(self, role: str, text: str, n: int) -> list[tuple]:
        """What becomes of n like turns, and of what is put in before them."""
        out = []
        while n:
            edit = next(self.edits)
            n -= edit != "I"
            out += self.edited(edit, role, text)
        return out

    def rest(self) -> list[tuple]:
        """What is put in after the last turn, and the digest."""
        out = [x for edit in self.edits for x in self.edited(edit, "", "")]
        return out if self.whole else [(self.key, self.digest.hexdigest())]


def repaired(rows: DataFrame, audit: DataFrame, whole: bool = False) -> DataFrame:
    """_key, repaired_sha256 (of the lines `role:text`, joined by line breaks); whole: _key, place, role, text, the lines themselves. rows: as in_order() gives
    them; audit: _key, audit of each conversation. A conversation's turns pass through one task in order and are not gathered."""
    turns = rows.select("_key", "_place", "role", "text", "n", F.lit(None).cast("string").alias("audit"))
    heads = audit.select("_key", F.lit(0).cast("long").alias("_place"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("n"), "audit")
    dealt = turns.unionByName(heads).repartition("_key").sortWithinPartitions("_key", "_place")
    fields = [("_key", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())] if whole else [("_key", pa.string()), ("repaired_sha256", pa.string())]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(fields)], [name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for key, _, role, text, n, audit in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if audit is None:
                    out += now.turn(role, text, n)
                else:
                    out += now.rest() if now else []
                    now = Repair(key, audit, whole)
            yield made(out)
        if now:
            yield made(now.rest())

    return dealt.mapInArrow(run, "_key string, place long, role string, text string" if whole else "_key string, repaired_sha256 string")


def judged(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as in_order() gives them; _key, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation."""
    rows = stash(in_order(turns), "dialogue-order")
    every = "".join(FAULTS.values())
    roles, word = F.translate("letters", every, "suax" * 4), F.translate("letters", "01234567", "D" * 8)
    found = stash(conversations(rows).withColumn("signature", word), "dialogue-letters")
    count = lambda kind: F.length(F.regexp_replace("letters", f"[^{FAULTS[kind]}]", "")).cast("long").alias(kind)
    good = F.length(F.regexp_replace(F.regexp_replace(roles, "(?=su|ua|au)", "+"), "[^+]", ""))
    illegal = F.greatest(F.lit(0), F.length("letters") - 1 - good).cast("long").alias("illegal")
    # many conversations may have one signature: a skewed join that is split, not a group
    out = found.join(repairs(found.select("signature")), "signature")
    return rows, stash(out.select("_key", "gaps", count("blank"), count("duplicate"), count("truncated"), illegal, "cost", "audit"), "dialogue-audits")


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for each conversation of turns (conv_id, turn, role, text), and
    with zeros for those of `ids` (conv_id) that have no turn.

    Turns are taken by number (null first), then role, then text. Of each turn the first fault counts: blank (nothing but ASCII white space),
    duplicate (said before in the same role), truncated (the last visible character is none of .!?). gaps: numbers missing between the least and the
    greatest; illegal: neighbours whose role initials are not su, ua or au. The repair is the cheapest that leaves role initials of the form (s?(ua)+)?: Keep
    0, Rerole to user or assistant 2, Delete 3 (blank and duplicate turns must go), Insert an empty one 2, each truncated turn that stays 1 more; audit
    has the edits' initials in order, of repairs as cheap the least text. repaired_sha256: of what is left, `role:text` by line.

    A null role or text is one space; a null conv_id is a conversation of its own; a role that does not begin with s, u or a, an empty one too, can't be kept. Repeated
    rows are turns of their own, so duplicates. Texts of any length pass whole. Empty tables give an empty result; other columns are not read. A
    conversation may hold any share of the rows: it is put in order by ranges and meets as a letter for each turn; only its hash passes through one task."""
    rows, found = judged(turns)
    hashed = repaired(rows, found.select("_key", "audit"))
    every = (ids if ids is not None else turns).select("conv_id").distinct().withColumn("_key", key_of(F.col("conv_id")))
    out = every.join(found, "_key", "left").join(hashed, "_key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    empty = F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), empty)


def mended(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the turns of the repaired conversations. Those of which nothing is left have none."""
    rows, found = judged(turns)
    ids = turns.select("conv_id").distinct().withColumn("_key", key_of(F.col("conv_id")))
    return ids.join(repaired(rows, found.select("_key", "audit"), whole=True), "_key").select("conv_id", "place", "role", "text")
