"""Duplicate candidates: works alike in text, place, cost, time and agency, found without comparing all pairs."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import combined_score, contextual_confidence, cost_similarity, haversine, time_overlap, token_overlap, tokens, vendor_tokens
from ..schemas import DUPLICATE_TRIGGER, GEO_MAX_M, SCORE_WEIGHTS, TEXT_TRIGGER
from ..tables import lookup, shared_dir, stash, until_exit
from ..tasks import ship
from .meeting import SIDE, Index, Side, pairs_by_place, pairs_by_text, told
from .signals import evidence, make_signals

ship(__name__)

#: Degrees of latitude of a grid band, a little over 2 km.
BAND = 0.018
#: Degrees of latitude of a cell in which located works meet, and works of it that one task looks into at once.
CELL, CELL_ROWS = 0.2, 20_000
#: Terms whose frequencies are broadcast, at most, and bytes of works without a place that are.
COMMON, BLOCK_BYTES = 200_000, 16 << 20
#: Works of a term that one task looks at.
PART_ROWS = 20_000
#: Tails of one range differ by this factor at most. Ranges are numbered from that of tails up to 1; the sum of two numbers bounds the product.
RANGE = 1.25
LAST_RANGE = int(math.log(1 / (TEXT_TRIGGER - 1e-9)) / math.log(RANGE))
#: For each sum of two range numbers, how far the logarithms of two costs may be apart: the text gives its weight times the
#: product of the tails at most, category and time all of theirs. None: any costs will do.
_GOAL = (DUPLICATE_TRIGGER - 1e-4) * (1 - SCORE_WEIGHTS["location"]) - SCORE_WEIGHTS["category"] - SCORE_WEIGHTS["time"]
_LEAST = [(_GOAL - SCORE_WEIGHTS["text"] * RANGE**-k) / SCORE_WEIGHTS["cost"] - 1e-6 for k in range(LAST_RANGE + 1)]
_WIDTHS = [-math.log(x) if 0 < x < 1 else None for x in _LEAST]
#: The band of costs that are null or not above 0, which are like each other at most.
NO_COST = -1_000_000


def tfidf(works: DataFrame) -> DataFrame:
    """dataset_id, id, term, w: term counts times ln((1 + n) / (1 + df)) + 1, each work's vector of length 1; n and df are the
    dataset's."""
    terms = works.select("dataset_id", "id", F.explode(tokens(F.col("description"))).alias("term")).groupBy("dataset_id", "id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = works.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    df = terms.groupBy("dataset_id", "term").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(df, ["dataset_id", "term"]).join(n, "dataset_id").withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = Window.partitionBy("dataset_id", "id")
    return weighted.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(length))).select("dataset_id", "id", "term", "df", "w")


def postings(weights: DataFrame) -> DataFrame:
    """dataset_id, id, h (the term as a 64-bit hash), df, w, tail: with a work's terms from the rarest to the most common of its dataset, the length
    of what is left of its vector from the term on."""
    after = Window.partitionBy("dataset_id", "id").orderBy(F.desc("df"), F.desc("h")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = weights.select("dataset_id", "id", F.xxhash64("term").alias("h"), "df", "w")
    return rows.withColumn("tail", F.sqrt(F.sum(F.col("w") * F.col("w")).over(after)))


def geo_pairs(works: DataFrame) -> DataFrame:
    """dataset_id, a_id, b_id: located works at most 2 km apart. A grid of latitude bands with longitude cells as wide as the
    reach in their band: each work is in one cell and looks into those its reach touches."""
    own = works.filter("latitude is not null and longitude is not null").select("dataset_id", "id", F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"))
    band = F.floor(F.col("lat") / BAND).cast("long")
    reach = lambda b: F.lit(BAND) / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs((b - 1) * BAND), F.abs((b + 2) * BAND)))))
    home = own.withColumn("band", band).withColumn("cell", F.pmod(F.floor((F.col("lon") + 180) / reach(F.col("band"))), F.ceil(360 / reach(F.col("band")))))
    looks = own.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    width = reach(F.col("band"))
    first, last = F.floor((F.col("lon") + 180 - width) / width), F.floor((F.col("lon") + 180 + width) / width)
    looks = looks.withColumn("cell", F.explode(F.array_distinct(F.transform(F.sequence(first, last), lambda k: F.pmod(k, F.ceil(360 / width))))))
    a = looks.select("dataset_id", "band", "cell", F.col("id").alias("a_id"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = home.select("dataset_id", "band", "cell", F.col("id").alias("b_id"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    near = a.join(b, ["dataset_id", "band", "cell"]).filter((F.col("a_id") < F.col("b_id")) & (haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= GEO_MAX_M))
    return near.select("dataset_id", "a_id", "b_id").distinct()


def with_facts(works: DataFrame) -> DataFrame:
    """dataset_id, id, lost (without a place) and what else of a work its pairs are judged by, as the struct f."""
    facts = F.struct("latitude", "longitude", "sanctioned_cost", "category", F.coalesce("start_date", "sanction_date").alias("begins"), F.col("completion_date").alias("ends"), vendor_tokens(F.col("implementing_agency")).alias("vendor"))
    return works.select("dataset_id", "id", (F.col("latitude").isNull() | F.col("longitude").isNull()).alias("lost"), facts.alias("f"))


def likenesses(a: Column, b: Column, context: bool = True) -> dict[str, Column]:
    """What two works' facts say about them, but for their texts; without `context` what a score is made of, but for the place."""
    every = {} if not context else {
        "location_distance_m": haversine(a["latitude"], a["longitude"], b["latitude"], b["longitude"]), "vendor_match": token_overlap(a["vendor"], b["vendor"]),
    }
    return every | {
        "cost_similarity": F.coalesce(cost_similarity(a["sanctioned_cost"], b["sanctioned_cost"]), F.lit(0.0)),
        "category_match": F.coalesce(a["category"] == b["category"], F.lit(False)),
        "time_overlap": time_overlap(a["begins"], a["ends"], b["begins"], b["ends"]),
    }


def text_needed(distance_known: bool, c: dict[str, Column]) -> Column:
    """The least text likeness with which a pair still reaches the trigger: its score less what everything else gives it. A
    hair below, as scores are rounded; a place is taken to be the same."""
    w = SCORE_WEIGHTS
    rest = w["text"] + w["cost"] + w["category"] + w["time"]
    goal = DUPLICATE_TRIGGER - 1e-4 - w["location"] if distance_known else (DUPLICATE_TRIGGER - 1e-4) * rest / (rest + w["location"])
    given = c["cost_similarity"] * w["cost"] + F.when(c["category_match"], w["category"]).otherwise(0.0) + F.when(c["time_overlap"], w["time"]).otherwise(0.0)
    return F.greatest(F.lit(TEXT_TRIGGER), (F.lit(goal) - given) / w["text"]) - 1e-9


def levels(postings: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which postings of a term may meet: those of works without a place (x), and all (y), by dataset, term, part, the pair of tail ranges
    and the band of cost.

    The likeness of two works from a shared term on is at most the product of their tails there, so ranges whose largest tails have a
    smaller product than TEXT_TRIGGER never meet. A pair of ranges also bounds what the text can give to a score, and so from below
    how alike the costs must be: works meet in bands of the cost's logarithm that are as wide as that. Parts spread a common term."""
    facts = rows.select("dataset_id", "id", "lost", F.struct("f.sanctioned_cost", "f.category", "f.begins", "f.ends").alias("f"))
    at = postings.filter(F.col("tail") >= TEXT_TRIGGER - 1e-9).join(facts, ["dataset_id", "id"])
    at = at.withColumn("range", F.greatest(F.lit(0), F.floor(-F.ln("tail") / math.log(RANGE)).cast("int"))).withColumn("parts", F.ceil(F.col("df") / PART_ROWS).cast("int"))
    cost = F.col("f.sanctioned_cost").cast("double")
    # a pair of ranges i, j is told by i + j; where any cost will do, and for costs that are null or not above 0, there is one band
    other = F.explode(F.sequence(F.lit(0), F.lit(LAST_RANGE) - F.col("range")))
    width = F.get(F.array(*[F.lit(x) for x in _WIDTHS]), F.col("range") + F.col("other"))
    band = F.when(width.isNull(), F.lit(0)).when(cost > 0, F.floor(F.ln(cost) / width)).otherwise(NO_COST).cast("long")
    keys = ["dataset_id", "h", "part", "i", "j", "band"]
    pack = F.struct("id", "lost", "f", "tail")
    x = at.filter("lost").withColumn("other", other).withColumn("band", band)
    x = x.withColumn("band", F.explode(F.when(width.isNull() | (F.col("band") == NO_COST), F.array("band")).otherwise(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))))
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("dataset_id", "h", "part", F.col("range").alias("i"), F.col("other").alias("j"), "band", pack.alias("x"))
    y = at.withColumn("other", other).withColumn("band", band).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return x.select(*keys, "x"), y.select("dataset_id", "h", "part", F.col("other").alias("i"), F.col("range").alias("j"), "band", pack.alias("y"))


def sides(works: DataFrame) -> DataFrame:
    """The works with terms, as SIDE has it. A term is a hash of it and its dataset, so datasets never meet; weights are those of tfidf() before their length is made 1.

    Frequencies of the terms that many works have, COMMON of them at most, are broadcast; the postings of the others alone are shuffled to theirs."""
    # texts go to their works' tasks before they are taken apart, so that terms are counted where they are
    own = works.select("dataset_id", "id", "description").repartition("dataset_id", "id")
    each = own.select("dataset_id", "id", F.explode(F.transform(tokens(F.col("description")), lambda t: F.xxhash64("dataset_id", t))).alias("h")).groupBy("dataset_id", "id", "h").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    found = stash(each.groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("df")), "duplicate-frequencies")
    cut = max(2, -(-(found.agg(F.sum("df")).first()[0] or 0) // COMMON))
    common, rare = F.broadcast(found.filter(F.col("df") >= cut)), found.filter((F.col("df") < cut) & (F.col("df") > 1))
    met = each.join(common, "h", "left")
    often, seldom = met.filter("df is not null"), met.filter("df is null").drop("df").join(rare, "h", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    n = stash(works.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")), "duplicate-datasets")
    rows = often.unionByName(seldom).groupBy("dataset_id", "id").agg(F.array_sort(F.collect_list(F.struct("df", "h", "tf"))).alias("t")).join(lookup(n, 80 * n.count()), "dataset_id")
    weight = lambda x: x["tf"] * (F.ln((1 + F.col("n")) / (1 + x["df"])) + 1)
    rows = rows.select("dataset_id", "id", F.col("t.h").alias("terms"), F.transform("t", weight).alias("ws"))
    f = F.col("f")
    days = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    facts = with_facts(works).select(
        "dataset_id", "id", "lost", "f", F.xxhash64("dataset_id").alias("ds"), f["latitude"].cast("double").alias("lat"), f["longitude"].cast("double").alias("lon"), f["sanctioned_cost"].cast("double").alias("cost"),
        F.when(f["category"].isNull(), F.lit(0)).otherwise(F.xxhash64(f["category"])).alias("category"), days(f["begins"]).alias("begins"), days(f["ends"]).alias("ends"),
    )
    return facts.join(rows, ["dataset_id", "id"]).select(*SIDE)


def _met_schema(rows: DataFrame) -> str:
    f = rows.schema["f"].dataType.simpleString()
    return f"dataset_id string, a_id string, b_id string, a {f}, b {f}, _text double"


def text_pairs(rows: DataFrame, block: int, blocks: int) -> tuple[DataFrame, Broadcast]:
    """Pairs of which one work at least has no place, that one in a block of such works: a broadcast, which all works pass by where they are. Nothing is shuffled,
    and a pair leaves its task once, when its texts have been compared."""
    lost = rows.filter(F.col("lost") & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == block))
    sent = rows.sparkSession.sparkContext.broadcast(lost.toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(Side(sent.value))
        for batch in batches:
            own = Side(batch)
            for i, j, text in pairs_by_text(own, index):
                yield told(own, index.side, i, j, text)

    return rows.mapInArrow(run, _met_schema(rows)), sent


def placed_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of located works at most 2 km apart. A work has its home in one cell of a wide grid and looks into those next to it that its reach touches. A cell
    of more than CELL_ROWS works is dealt over parts, into which all its works look."""
    placed = rows.filter("not lost")
    width = lambda b: F.lit(CELL) / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs(b * CELL - BAND), F.abs((b + 1) * CELL + BAND)))))
    wide, lon = width(F.col("band")), F.col("lon") + 180
    reach, around = wide * BAND / CELL, F.ceil(360 / wide)
    cell = lambda x: F.pmod(F.floor(x / wide), around)
    home = F.floor(F.col("lat") / CELL)
    bands = F.array_distinct(F.transform(F.array(F.lit(-BAND), F.lit(0.0), F.lit(BAND)), lambda x: F.floor((F.col("lat") + x) / CELL)))
    touched = F.array_distinct(F.array(cell(lon), cell(lon - reach), cell(lon + reach), cell(lon - reach + 360), cell(lon + reach - 360)))
    at = placed.withColumn("band", home).withColumn("cell", cell(lon))
    parts = at.groupBy("dataset_id", "band", "cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("parts")).filter("parts > 1")
    parts = stash(parts, "duplicate-cells")
    size = 100 * parts.count()
    looks = placed.withColumn("_home", home).withColumn("band", F.explode(bands)).withColumn("_own", cell(lon)).withColumn("cell", F.explode(touched))
    looks = looks.withColumn("_here", (F.col("band") == F.col("_home")) & (F.col("cell") == F.col("_own")))
    looks = looks.join(lookup(parts, size), ["dataset_id", "band", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    looks = looks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    looks = looks.withColumn("_looks", ~(F.col("_here") & (F.col("part") == F.pmod(F.xxhash64("id"), F.col("parts")))))
    dealt = looks.select(F.xxhash64("dataset_id", "band", "cell", "part").alias("_key"), "_looks", *SIDE)
    dealt = dealt.repartition("_key").sortWithinPartitions("_key", "_looks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, index = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal homes, index
            if homes:
                own = Side(pa.Table.from_batches(homes).combine_chunks())
                homes, index = [], Index(own)
                for i, j, text in pairs_by_place(own, index, BAND):
                    yield told(own, own, i, j, text)

        for batch in batches:
            keys, looking = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            ends = np.append(np.flatnonzero((np.diff(keys) != 0) | (looking[1:] != looking[:-1])) + 1, len(keys))
            begin = 0
            for end in ends.tolist():
                if begin == end:
                    continue
                if keys[begin] != key:
                    yield from close()
                    key, index = keys[begin], None
                part = batch.slice(begin, end - begin).select(list(SIDE))
                if not looking[begin]:
                    homes.append(part)
                else:
                    yield from close()
                    if index is not None:
                        own = Side(part)
                        for i, j, text in pairs_by_place(own, index, BAND):
                            yield told(own, index.side, i, j, text)
                begin = end
        yield from close()

    return dealt.mapInArrow(run, _met_schema(rows))


def scored(met: DataFrame) -> DataFrame:
    """The pairs (dataset_id, a_id, b_id, facts a and b, _text) that are alike enough, with their likenesses."""
    c = likenesses(F.col("a"), F.col("b"))
    both = met.filter(F.col("_text") >= TEXT_TRIGGER).select("dataset_id", "a_id", "b_id", "_text", *[v.alias(k) for k, v in c.items()])
    both = both.filter(F.col("location_distance_m").isNull() | (F.col("location_distance_m") <= GEO_MAX_M))
    both = both.withColumn("combined_score", combined_score(F.col("_text"), *(F.col(k) for k in ("location_distance_m", "cost_similarity", "category_match", "time_overlap")))).filter(F.col("combined_score") >= DUPLICATE_TRIGGER)
    context = contextual_confidence(*(F.col(k) for k in ("location_distance_m", "vendor_match", "cost_similarity", "category_match", "time_overlap")))
    return both.withColumn("_c", context).select(
        "dataset_id", "a_id", "b_id", F.round("_text", 4).alias("text_similarity"), F.round("location_distance_m", 1).alias("location_distance_m"), F.round("cost_similarity", 4).alias("cost_similarity"),
        "category_match", "time_overlap", "vendor_match", F.col("_c.band").alias("contextual_confidence"), F.col("_c.score").alias("confidence_score"), F.col("_c.reasons").alias("reasons"), "combined_score",
    )


def duplicate_pairs(works: DataFrame) -> DataFrame:
    """The candidate pairs (a_id < b_id) with their likenesses: text cosine 0.25 at least, at most 2 km apart if both are
    located, combined score 0.60 at least. Texts without terms pair with nothing.

    The pairs are written as they are found, once, and are the table that is returned; what is shuffled grows with the works, not with the pairs."""
    spark = works.sparkSession
    rows = stash(sides(works), "duplicate-sides")
    path = until_exit(spark, f"{shared_dir(spark)}/duplicate-pairs-{uuid.uuid4().hex}")
    placed = scored(placed_pairs(rows))
    placed.write.mode("append").parquet(path)
    blocks = -(-(rows.filter("lost").agg(F.sum(16 * F.size("terms") + 200)).first()[0] or 0) // BLOCK_BYTES)
    for block in range(blocks):
        met, sent = text_pairs(rows, block, blocks)
        scored(met).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(placed.schema).parquet(path)


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("_s", F.explode(F.array(F.struct(F.col("a_id").alias("id"), F.col("b_id").alias("other_id")), F.struct(F.col("b_id").alias("id"), F.col("a_id").alias("other_id"))))).select("*", "_s.*").drop("_s")


def duplicate_signals(pairs: DataFrame) -> DataFrame:
    """Two signals for each pair, one for each work of it."""
    df = both_ways(pairs)
    band = F.col("contextual_confidence")
    severity = F.when(band == "high", "HIGH").when(band == "medium", "MEDIUM").otherwise("LOW")
    why = F.concat(F.lit("Text, place, cost and dates of work "), F.col("other_id"), F.lit(" are alike, with a score of "), F.col("combined_score").cast("string"), F.lit(" and "), band, F.lit(" confidence."))
    row = lambda field, c: evidence(field, F.coalesce(F.col(c).cast("string"), F.lit("unavailable")), "other work", F.col("other_id"), None, rule="DUPLICATE")
    return make_signals(df, "DUPLICATE", severity, F.concat(F.lit("Possible duplicate of "), F.col("other_id")), "NLP", {"other_id": F.col("other_id")},
        {"threshold": str(DUPLICATE_TRIGGER)}, {"combined_score": F.col("combined_score"), "contextual_confidence": band}, [
        row("text_similarity", "text_similarity"), row("location_distance_m", "location_distance_m"), row("cost_similarity", "cost_similarity"), row("vendor_match", "vendor_match"), row("contextual_confidence", "contextual_confidence"),
    ], band, explanation=why)


def duplicate_score(pairs: DataFrame) -> DataFrame:
    """dataset_id, project_id, duplicate_score: the greatest combined score of a work's pairs."""
    return both_ways(pairs).groupBy("dataset_id", F.col("id").alias("project_id")).agg(F.max("combined_score").alias("duplicate_score"))
