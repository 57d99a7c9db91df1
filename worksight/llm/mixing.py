"""Mixing sources to target weights by pivotal dependent rounding of copy probabilities (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup, stash, unit_hash

#: Weights of the sources in order of their names, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more than so many times its size.
MOST_COPIES = 3
#: Documents or residuals that one node of the reduction tree folds, on average.
FAN_IN = 64
#: Smaller documents of a source, on average, that wait at the root of its tree.
AT_ROOT = 256
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_no, source_size, n, target of each source: shares of the total by weight, at most `most` times its
    size; the excess goes to the others by weight until none is above (the level where the capped shares fill the total).
    A row of the result is a source, so the windows here see sources, not documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(by_name)).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    upward = Window.orderBy("_ratio", "source_no")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    after = upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = (
        per.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.sum("_weight").over(after))
        .withColumn("_free", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)["_level"])
    )
    target = F.coalesce(F.least(F.col("_cap"), F.col("_free") * F.col("_weight")), F.col("_cap"))
    return per.select("source", "source_no", "source_size", "n", target.alias("target"))


def _fold(seed: int, last: bool = False):
    """Folds a node's items one after another: the carried residual and the next item exchange mass (probability x size),
    in the direction drawn with the odds that keep both expectations, until one of the two is 0 or 1. That one is decided;
    the other is carried on. Sizes times probabilities keep their sum, so the words taken keep to the target.
    last: at the root a carried item draws its direction once, by its own probability, and keeps it; so a large residual
    is settled against a few small documents instead of being left over."""
    decided = "array<struct<id:bigint,k:int>>"
    start = f"named_struct('p', items[0].p, 'p0', items[0].p, 'w', items[0].w, 'id', items[0].id, 'out', cast(array() as {decided}))"
    u = f"(shiftrightunsigned(xxhash64(t.a.id, {'0' if last else 't.x.id'}, {seed}), 11) / 9007199254740992D)"
    # to: mass that the carried item can gain from x; fro: that it can give to x
    to, fro = "least((1 - t.a.p) * t.a.w, t.x.p * t.x.w)", "least(t.a.p * t.a.w, (1 - t.x.p) * t.x.w)"
    gains = f"{u} < t.a.p0" if last else f"{u} * ({to} + {fro}) < {fro}"

    def carry(side: str, p: str, other: str, k: int) -> str:
        p0 = "t.a.p0" if side == "a" else f"cast({p} as double)"
        return f"named_struct('p', cast({p} as double), 'p0', {p0}, 'w', t.{side}.w, 'id', t.{side}.id, 'out', concat(t.a.out, array(named_struct('id', t.{other}.id, 'k', {k}))))"

    step = f"""transform(array(named_struct('a', acc, 'x', x)), t ->
      case when {gains} then
        case when (1 - t.a.p) * t.a.w <= t.x.p * t.x.w
          then {carry("x", "greatest(0D, t.x.p - (1 - t.a.p) * t.a.w / t.x.w)", "a", 1)}
          else {carry("a", "least(1D, t.a.p + t.x.p * t.x.w / t.a.w)", "x", 0)} end
      else
        case when t.a.p * t.a.w <= (1 - t.x.p) * t.x.w
          then {carry("x", "least(1D, t.x.p + t.a.p * t.a.w / t.x.w)", "a", 0)}
          else {carry("a", "greatest(0D, t.a.p - (1 - t.x.p) * t.x.w / t.a.w)", "x", 1)} end
      end)[0]"""
    return F.expr(f"aggregate(slice(items, 2, size(items)), {start}, (acc, x) -> {step})")


def copies(units: DataFrame, sources: DataFrame, seed: int = 7) -> DataFrame:
    """id, source_no, k: which of the units (id, source_no, n, source_size, w, p; 0 < p < 1) are rounded up.

    A tree of nodes of about FAN_IN units: each node leaves one residual, the residuals of neighbouring nodes are folded
    by the next level. About AT_ROOT of a source's smaller documents wait at the root, where they settle the residual that
    the tree leaves; what remains then, a part of one small document, is rounded to the nearest."""
    most = sources.agg(F.max("n")).first()[0] or 0
    width = F.greatest(F.lit(1), F.ceil(F.col("n") / FAN_IN)).cast("long")
    waits = (F.col("w") * F.col("n") <= F.col("source_size")) & (unit_hash(F.col("id"), F.lit(seed + 2)) * F.col("n") < AT_ROOT)
    units = units.withColumn("_waits", waits)
    fields = ["source_no", "id", "w", "p"]
    level = units.filter(~F.col("_waits")).select(*fields, F.pmod(F.xxhash64("id", F.lit(seed)), width).alias("node"))
    levels = 1 + max(1, math.ceil(math.log(max(2, math.ceil(most / FAN_IN)), FAN_IN)))
    parts = []
    for k in range(levels + 1):
        last = k == levels
        if last:
            level = level.select(*fields, F.lit(0).cast("long").alias("node")).unionByName(units.filter("_waits").select(*fields, F.lit(0).cast("long").alias("node")))
        order = -F.col("w") if last else F.xxhash64("id", F.lit(seed + 1))
        item = F.struct(order.alias("r"), "id", "w", "p")
        nodes = level.groupBy("source_no", "node").agg(F.array_sort(F.collect_list(item)).alias("items"))
        done = stash(nodes.select("source_no", "node", _fold(seed, last).alias("a")), f"mix-level{k}")
        parts.append(done.select("source_no", F.inline("a.out")))
        level = done.select("source_no", F.floor(F.col("node") / FAN_IN).alias("node"), F.col("a.id").alias("id"), F.col("a.w").alias("w"), F.col("a.p").alias("p"))
    out = level.select("source_no", "id", (F.col("p") >= 0.5).cast("int").alias("k"))
    for part in parts:
        out = out.unionByName(part)
    return out


def mixed(docs: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of docs.

    Every document of a source is wanted target / source_size times; the whole part is taken, the fraction is rounded to
    0 or 1 by dependent rounding. Rows that share doc_id and source are decided together. Size is the number of words; a
    null text has none and takes nothing, a null source is a source of its own. Draws are hashes of ids, so reruns and any
    partitioning agree. An empty table gives an empty result; other columns are not read.
    """
    rows = stash(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    sources = stash(source_targets(rows, weights, most).withColumn("_want", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "mix-sources")
    n_sources = sources.count()
    side = lookup(sources.withColumnRenamed("source", "_source"), n_sources * 100)
    rows = rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("id", F.xxhash64("doc_id", "source_no"))
    whole = F.floor("_want")
    fraction = F.col("_want") - whole
    units = rows.filter((F.col("size") > 0) & (fraction > 0)).groupBy("id", "source_no", "n", "source_size").agg(F.sum("size").cast("double").alias("w"), F.max(fraction).alias("p"))
    ups = copies(units, sources, seed).filter("k = 1").select("id", "source_no", F.lit(1).alias("_up"))
    out = rows.join(ups, ["id", "source_no"], "left").withColumn("copies", F.when(F.col("size") > 0, (whole + F.coalesce("_up", F.lit(0))).cast("int")).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES, seed: int = 7) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (0 to `most` times); null and empty texts, which have no
    words, are not taken. Columns stay as they are."""
    take = mixed(docs, weights, most, seed).filter("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_src")).agg(F.max("copies").alias("_copies"))
    joined = docs.join(take, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_src")))
    joined = joined.filter(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) > 0)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[docs[c] for c in docs.columns])
