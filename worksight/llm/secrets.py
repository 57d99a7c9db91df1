"""Secret scan: named patterns and sliding-window entropy over candidate strings (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import set_aside

#: The kinds in order of listing: name, pattern, and the group and length that a match needs to stand.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16))
#: A candidate for entropy: a whole run of these characters, WINDOW at least, with a letter and a digit.
_RUN = "[A-Za-z0-9+/_=-]"
WINDOW = 20
CANDIDATE = rf"(?<!{_RUN})(?={_RUN}{{{WINDOW}}})(?={_RUN}*[0-9])(?={_RUN}*[A-Za-z]){_RUN}+"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Character classes from the narrowest: a candidate belongs to the first that has all its characters, and needs so many bits.
CLASSES = (("^([0-9a-f]+|[0-9A-F]+)$", 2.9), ("^([0-9a-z]+|[0-9A-Z]+)$", 3.4), ("^.*$", 3.6))
#: What looks random but is no secret: identifiers in UUID form, samples from manuals, and words and numbers joined by signs, that
#: is, runs in which no letter touches a digit. No pattern repeats a group: Java's engine would recurse with every repetition.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(EXAMPLE|example|XXXX|xxxx|1234567890|0123456789|abcdefgh)",
)
MIXED = "[A-Za-z][0-9]|[0-9][A-Za-z]"
#: Spans that are summed up or compared at once, so that a text with many has cost in proportion to their number, not its square.
PIECE = 64
_SPAN = "struct<start:int,kind:int,end:int,text:string>"
_XLOGX = [0.0, *[n * math.log2(n) for n in range(1, WINDOW + 2)]]


def in_pieces(items: Column) -> Column:
    """The array cut into arrays of PIECE items. It is an item of an array itself, so that it is made once and not for each piece."""
    cut = lambda some: F.transform(F.sequence(F.lit(0), F.ceil(F.size(some) / PIECE).cast("int") - 1), lambda k: F.slice(some, k * PIECE + 1, F.lit(PIECE)))
    return F.get(F.transform(F.array(items), cut), 0)


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """The matches of pattern in text, leftmost and non-overlapping, with their places in code points (end exclusive)."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(f"array<{_SPAN}>")
    span = lambda start, match: F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(match)).alias("end"), match.alias("text"))
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        return state(start + F.length(x["match"]), F.concat(a["out"], F.array(span(start, x["match"]))))

    def piece(a, some):
        # places inside a piece count from its start, and are moved to where it starts in the text
        inside = F.aggregate(some, state(F.lit(0), none), step)
        moved = F.transform(inside["out"], lambda x: span(x["start"] + a["at"], x["text"]))
        return state(a["at"] + inside["at"], F.concat(a["out"], F.array(moved)))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    whole = F.aggregate(in_pieces(pairs), state(F.lit(0), F.array().cast(f"array<array<{_SPAN}>>")), piece)
    return F.when(F.size(found) > 0, F.flatten(whole["out"])).otherwise(none)


def apart_from(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others; a piece of these is looked into only where its whole extent is met."""
    extent = F.transform(in_pieces(others), lambda some: F.struct(F.array_min(F.transform(some, lambda x: x["start"])).alias("start"), F.array_max(F.transform(some, lambda x: x["end"])).alias("end"), some.alias("some")))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = lambda all_: F.filter(spans, lambda x: ~F.exists(all_, lambda e: meets(e, x) & F.exists(e["some"], lambda y: meets(y, x))))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(F.get(F.transform(F.array(extent), free), 0))


def best_entropy(c: Column) -> Column:
    """The greatest Shannon entropy (bits a character) of the windows of c. One pass: each step counts one character in and
    one out and corrects the sum of n log n by those two alone. The counts are a text with a letter for each character of
    ALPHABET, of which a step overwrites two."""
    table, alphabet = F.array(*[F.lit(x) for x in _XLOGX]), F.lit(ALPHABET)
    xlogx = lambda n: F.get(table, n)
    zero = F.struct(F.lit("A" * len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    count = lambda n, at: F.ascii(F.substring(n, at, F.lit(1))) - ord("A")
    put = lambda n, at, k: F.overlay(n, F.char(k + ord("A")), at)
    slots = F.transform(F.split(c, ""), lambda x: F.call_function("locate", x, alphabet))

    def over(slots: Column) -> Column:
        def step(a, i):
            come, go = F.get(slots, i), F.when(i >= WINDOW, F.get(slots, i - WINDOW)).otherwise(0)
            there = count(a["n"], come)
            more = put(a["n"], come, there + 1)
            gone = F.when(go > 0, count(more, go)).otherwise(0)
            s = a["s"] + xlogx(there + 1) - xlogx(there) + F.when(go > 0, xlogx(gone - 1) - xlogx(gone)).otherwise(0.0)
            best = F.when(i >= WINDOW - 1, F.greatest(a["best"], F.lit(math.log2(WINDOW)) - s / WINDOW)).otherwise(a["best"])
            return F.struct(F.when(go > 0, put(more, go, gone - 1)).otherwise(more).alias("n"), s.alias("s"), best.alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(slots) - 1), zero, step)["best"]

    # one array in an array, so that the slots are found once and not again in each step
    return F.get(F.transform(F.array(slots), over), 0)


def needed(c: Column) -> Column:
    return F.coalesce(*[F.when(c.rlike(p), F.lit(bits)) for p, bits in CLASSES])


def stands(pattern: str, group: int, least: int):
    return lambda x: F.length(F.regexp_extract(x["text"], pattern, group)) >= least


def isn_t(pattern: str):
    return lambda x: ~x["text"].rlike(pattern)


def of_kind(kind: int):
    return lambda x: x["kind"] == kind


def scan(docs: DataFrame) -> DataFrame:
    """The columns of docs plus base and spans: arrays of (start, kind, end, text) in order of start and kind (0 assign,
    1 access, 2 hex, 3 entropy). spans holds base and what entropy adds beside it: a candidate that overlaps no base span,
    is on no allow-list and has a window with the bits that its class needs. A null or empty text has none; repeated rows
    are scanned as they are; an empty table gives an empty result; columns called base or spans are replaced, all others stay."""
    docs, names = set_aside(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("_text", text)
    parts = []
    for kind, (name, pattern, group, least) in enumerate(BASE):
        spans = spans_of(F.col("_text"), pattern, kind)
        out = out.withColumn(f"_{name}", F.filter(spans, stands(pattern, group, least)))
        parts.append(F.col(f"_{name}"))
    out = out.withColumn("base", F.array_sort(F.concat(*parts)))
    odd = spans_of(F.col("_text"), CANDIDATE, len(BASE))
    out = out.withColumn("_odd", F.filter(odd, lambda x: x["text"].rlike(MIXED)))
    fresh = apart_from(F.col("_odd"), F.col("base"))
    for pattern in ALLOWED:
        fresh = F.filter(fresh, isn_t(pattern))
    fresh = F.filter(fresh, lambda x: best_entropy(x["text"]) >= needed(x["text"]))
    out = out.withColumn("spans", F.array_sort(F.concat(F.col("base"), fresh)))
    return out.select(*[F.col(c).alias(names.get(c, c)) for c in docs.columns if c not in ("base", "spans")], "base", "spans")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(n) for n, *_ in BASE], F.lit("entropy"))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of text replaced by mark; overlapping spans give one mark. Other columns stay as they are."""
    found = scan(docs.withColumn("_own", F.struct(*docs.columns)).select("_own", "text"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, x):
        fresh = x["start"] >= a["at"]
        more = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(fresh, more).otherwise(a["out"]).alias("out"))

    cut = F.aggregate("spans", zero, step)
    clean = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(cut["out"], F.substring("text", cut["at"] + 1, F.lit(1 << 30))))
    return found.withColumn("_clean", clean).select(*[F.col("_clean").alias(c) if c == "text" else F.col(f"_own.{c}") for c in docs.columns])
