"""How alike two works are: text tokens, distance, cost, time, agency, and the scores made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CONFIDENCE_WEIGHTS, GEO_MAX_M, GEO_STRONG_M, SCORE_WEIGHTS, TEXT_STOPWORDS, VENDOR_OVERLAP, VENDOR_STOPWORDS


def tokens(c: Column) -> Column:
    """Words of two or more letters or digits, without the trade's stop words, and the pairs of neighbours. A null has none."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) >= 2) & ~w.isin(*TEXT_STOPWORDS))
    both = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.lit(0), F.size(w) - 1)), F.slice(w, F.lit(2), F.size(w)), lambda x, y: F.concat_ws(" ", x, y))
    # one array in an array, so that the words are split once and not again for each use
    return F.flatten(F.transform(F.array(words), lambda w: F.concat(w, both(w))))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere of 6371 km; null if a coordinate is missing."""
    a1, o1, a2, o2 = (c.cast("double") for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(a2 - a1) / 2), 2) + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * F.pow(F.sin(F.radians(o2 - o1) / 2), 2)
    return F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h))) * (2 * 6_371_000.0)


def cost_similarity(a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    top = F.greatest(x, y)
    return F.when(top == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(x - y) / top))


def time_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether two spans meet; no end is open, no start meets nothing."""
    open_end = F.lit("9999-12-31").cast("date")
    return F.coalesce((start_a <= F.coalesce(end_b, open_end)) & (start_b <= F.coalesce(end_a, open_end)), F.lit(False))


def vendor_tokens(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(*VENDOR_STOPWORDS) & ~w.rlike("^[0-9]+$")))


def vendor_overlap(a: Column, b: Column) -> Column:
    """Whether the agencies share enough of the smaller name's tokens; null if either has none."""
    return token_overlap(vendor_tokens(a), vendor_tokens(b))


def token_overlap(x: Column, y: Column) -> Column:
    ratio = F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), ratio >= VENDOR_OVERLAP)


def combined_score(text: Column, distance: Column, cost: Column, category: Column, overlap: Column) -> Column:
    w = SCORE_WEIGHTS
    base = text * w["text"] + cost * w["cost"] + F.when(category, w["category"]).otherwise(0.0) + F.when(overlap, w["time"]).otherwise(0.0)
    near = F.greatest(F.lit(0.0), 1 - F.least(distance, F.lit(GEO_MAX_M)) / GEO_MAX_M)
    rest = w["text"] + w["cost"] + w["category"] + w["time"]
    score = F.when(distance.isNotNull(), base + near * w["location"]).otherwise(base / rest * (rest + w["location"]))
    return F.round(F.least(F.lit(1.0), score), 4)


def contextual_confidence(distance: Column, vendor: Column, cost: Column, category: Column, overlap: Column) -> Column:
    """struct<band, score, reasons>: what independent evidence says about a pair of similar texts."""
    w = CONFIDENCE_WEIGHTS
    near, context = distance <= GEO_STRONG_M, (cost >= 0.9) & (category | overlap)
    score = F.when(near, w["geo"]).otherwise(0.0) + F.when(vendor, w["vendor"]).otherwise(0.0) + F.when(context, w["context"]).otherwise(0.0)
    band = (
        F.when(near.isNull() & vendor.isNull(), "unavailable")
        .when(F.coalesce(~near, F.lit(False)) | F.coalesce(~vendor, F.lit(False)), "low")
        .when(F.coalesce(near & vendor, F.lit(False)), "high")
        .otherwise("medium")
    )
    reasons = F.array_compact(F.array(
        F.when(near, "geographically proximate").when(distance > GEO_MAX_M, "locations far apart").when(distance.isNotNull(), "locations not adjacent"),
        F.when(vendor, "same implementing agency").when(~vendor, "different implementing agencies").otherwise("agency data unavailable"),
        F.when(context, "cost/category/time context agrees"),
    ))
    value = F.when(band != "unavailable", F.round(F.least(F.lit(1.0), score), 2))
    return F.struct(band.alias("band"), value.alias("score"), reasons.alias("reasons"))
