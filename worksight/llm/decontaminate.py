"""Benchmark decontamination: windows of benchmark words found in documents (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, az_lower, set_aside, stash

#: A word is a run of letters a-z, digits and everything beyond ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Parts that the rows of a text are dealt over where findings are too many to broadcast.
SALTS = 16


def words(text: Column) -> Column:
    """The text's pieces between gaps, in the letter case of the text. A text that starts or ends with a gap has an empty piece there."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), GAP, -1)


def n_words(pieces: Column) -> Column:
    ends = (pieces[0] == "").cast("int") + (F.element_at(pieces, -1) == "").cast("int")
    return F.when(F.size(pieces) == 1, (pieces[0] != "").cast("int")).otherwise(F.size(pieces) - ends).cast("long")


def anchors(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The hash set that is broadcast: first, second (a pair of neighbouring words; second null for a window of one word),
    item_id, width (of the item's windows), near (the item's words around the pair, as far as a window with the pair in it
    reaches), at (the place of the pair in near, from 0).

    Of each window the pair with the most characters is its anchor; neighbouring windows mostly share one, so an item of n
    words has about n / 4 anchors and a document word starts one rarely. Every window has one, so none is missed. An
    anchor carries fewer than two windows of words, however long its item."""
    items = benchmark.select("item_id", F.filter(words(az_lower(F.col("text"))), lambda w: w != "").alias("_words")).filter(F.size("_words") > 0)
    width = F.least(F.lit(window), F.size("_words"))
    starts = items.select("item_id", "_words", width.alias("width"), F.explode(F.sequence(F.lit(0), F.size("_words") - width)).alias("start"))
    pair = lambda i: F.struct(
        (F.length(F.get("_words", i)) + F.length(F.coalesce(F.get("_words", i + 1), F.lit("")))).alias("chars"),
        F.get("_words", i).alias("first"),
        F.get("_words", i + 1).alias("second"),
        i.alias("at"),
    )
    places = F.sequence(F.col("start"), F.greatest(F.col("start"), F.col("start") + F.col("width") - 2))
    best = starts.withColumn("_a", F.array_max(F.transform(places, pair)))
    low = F.greatest(F.lit(0), F.col("_a.at") - F.col("width") + 1)
    near = F.slice("_words", low + 1, F.col("_a.at") - low + F.col("width"))
    spots = best.select("item_id", "width", "_a.first", F.when(F.col("width") > 1, F.col("_a.second")).alias("second"), near.alias("near"), (F.col("_a.at") - low).alias("at"))
    return spots.distinct()


def with_key(docs: DataFrame) -> DataFrame:
    """docs with _row, the digest of the text: what is found depends on the text alone, so equal texts share their findings and
    no numbering of rows has to hold from one scan to the next."""
    return docs.withColumn("_row", F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))


def found(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """_row, start, n, item_id: runs of words of a document (from word `start` on, `n` of them) that windows of an item cover.

    docs has _row (a key of its texts) and text. Scan, split, explode and the join with the broadcast anchors are one stage;
    only matching anchors leave it. Each is verified on the words around it: runs of at least a window's width count.
    Anchors beyond BROADCAST_BYTES are broadcast in several sets, by item, each for a scan of its own."""
    spots = stash(anchors(benchmark, window).withColumnRenamed("at", "_at"), "anchors")
    length = F.length(F.concat_ws(" ", "near")) + 60
    pairs, alone = F.col("second").isNotNull(), F.col("second").isNull()
    size, single = spots.agg(F.coalesce(F.sum(F.when(pairs, length)), F.lit(0)), F.coalesce(F.sum(F.when(alone, length)), F.lit(0))).first()
    sets = 1 + size // BROADCAST_BYTES
    parts = [met(docs, spots.filter(pairs if sets == 1 else pairs & (F.pmod(F.xxhash64("item_id"), F.lit(sets)) == k)), True) for k in range(sets)]
    # items of a single word meet that word, in sets of their own; mostly there are none
    sets = 1 + single // BROADCAST_BYTES if single else 0
    parts += [met(docs, spots.filter(alone if sets == 1 else alone & (F.pmod(F.xxhash64("item_id"), F.lit(sets)) == k)), False) for k in range(sets)]
    return reduce(DataFrame.unionByName, parts)


def met(docs: DataFrame, spots: DataFrame, pairs: bool) -> DataFrame:
    """The runs at anchors of one set: pairs are looked up by both words as one key, so a frequent first word leads to no long list."""
    pieces = docs.select("_row", words(F.col("text")).alias("_words"))
    spread = pieces.select("_row", "_words", F.posexplode("_words").alias("_pos", "_word"))
    key, after = F.lower("_word") == F.lower("first"), F.lower(F.get("_words", F.col("_pos") + 1))
    hits = spread.join(F.broadcast(spots), key & (after == F.lower("second")) if pairs else key)
    # the words near the anchor lie over the document's from place _pos - _at on
    low = F.greatest(F.lit(0), F.col("_at") - F.col("_pos"))
    high = F.least(F.size("near"), F.col("_at") - F.col("_pos") + F.size("_words"))
    same = F.transform(
        F.sequence(low, high - 1),
        lambda i: F.when(az_lower(F.get("_words", F.col("_pos") - F.col("_at") + i)) == F.get("near", i), F.lit("1")).otherwise(F.lit("0")),
    )
    hits = hits.select(
        "_row", "item_id", "width", F.concat_ws("", same).alias("_same"), (F.col("_pos") - F.col("_at") + low).alias("_from"), (F.col("_at") - low).alias("_mid"),
        F.when(F.col("_words")[0] == "", 1).otherwise(0).alias("_lead"),
    )
    before = F.length(F.regexp_extract(F.substring("_same", F.lit(1), F.col("_mid") + 1), "(1*)$", 1))
    ahead = F.length(F.regexp_extract(F.substring("_same", F.col("_mid") + 1, F.lit(1 << 30)), "^(1*)", 1))
    start, run = F.col("_from") + F.col("_mid") - before + 1 - F.col("_lead"), before + ahead - 1
    # an explode and no filter: as a condition of the join the lambdas above would take it out of generated code, and each word
    # of a document would be handed on with a copy of all its words
    good = F.when((before > 0) & (run >= F.col("width")), F.array(F.struct(start.alias("start"), run.alias("n")))).otherwise(F.array().cast("array<struct<start:int,n:int>>"))
    return hits.select("_row", "item_id", F.explode(good).alias("_run")).select("_row", "_run.start", "_run.n", "item_id")


def by_text(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """_row, pos (the words that windows cover), items: a row for each different text in which a window occurs, as a table. Copies of
    a text send the same runs, which are merged before they travel."""
    runs = found(docs, benchmark, window).groupBy("_row").agg(F.collect_set(F.struct("start", "n", F.col("item_id").cast("string").alias("item"))).alias("runs"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1))))
    items = F.sort_array(F.array_distinct(F.transform("runs", lambda r: r["item"])))
    return stash(runs.select("_row", covered.alias("pos"), items.alias("items")), "contaminated")


def with_hits(docs: DataFrame, hits: DataFrame, size: int, how: str) -> DataFrame:
    """docs (with _row) joined with hits: by broadcast within BROADCAST_BYTES, else by shuffle with SALTS copies of each hit, as one
    text may have many copies."""
    if size <= BROADCAST_BYTES:
        return docs.join(F.broadcast(hits), "_row", how)
    dealt = docs.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = hits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["_row", "_salt"], how).drop("_salt")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of docs plus n_words, n_hit (words inside an occurrence of a window), items (sorted ids, as strings),
    n_items and contaminated, a row for each row of docs. Null and empty texts have no words; benchmark items without
    words have no windows; items with equal texts all count; an empty benchmark hits nothing."""
    docs, names = set_aside(docs)
    keyed = with_key(docs)
    hits = by_text(keyed, benchmark, window)
    size = hits.agg(F.sum(F.length(F.concat_ws(",", "items")) + 40)).first()[0] or 0
    hits = hits.select("_row", F.size("pos").cast("long").alias("_hit"), F.col("items").alias("_items"))
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "n_items", "contaminated")]
    out = with_hits(keyed.select(*own, "_row", n_words(words(F.col("text"))).alias("n_words")), hits, size, "left")
    return out.select(
        *[F.col(c).alias(names.get(c, c)) for c in own], "n_words", F.coalesce("_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"), F.col("_hit").isNotNull().alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows in which any window of the benchmark occurs. Columns stay as they are."""
    docs, names = set_aside(docs)
    keyed = with_key(docs)
    hits = by_text(keyed, benchmark, window).select("_row")
    return with_hits(keyed, hits, hits.count() * 40, "left_anti").select(*[F.col(c).alias(names.get(c, c)) for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the words that windows cover cut out of text, each with the gap before it. Other columns stay as they are; null and
    empty texts stay too, and an empty table gives an empty result."""
    docs, names = set_aside(docs)
    keyed = with_key(docs)
    hits = by_text(keyed, benchmark, window).select("_row", F.col("pos").alias("_hit"))
    size = hits.agg(F.sum(F.size("_hit") * 8 + 40)).first()[0] or 0
    gaps, own = F.split("text", WORD, -1), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    kept = F.transform(own, lambda w, i: F.when(F.array_contains("_hit", i), F.lit("")).otherwise(F.concat(F.get("_gaps", i), w)))
    cut = F.concat(F.array_join(kept, ""), F.element_at("_gaps", -1))
    out = with_hits(keyed, hits, size, "left").withColumn("_gaps", gaps).withColumn("text", F.when(F.col("_hit").isNull(), F.col("text")).otherwise(cut))
    return out.select(*[F.col(c).alias(names.get(c, c)) for c in docs.columns])
