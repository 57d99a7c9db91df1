"""URL filter: rules on host and path, and a character language-model ratio for the rest (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, az_lower, stash

#: (host, path, verdict). A rule fits its host and all subdomains if the path starts with the rule's; the longest wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Characters of context, and the weight of the next shorter context in counts.
ORDER, BACKOFF = 4, 4.0
SCALE = 1_000_000
#: Distinct urls that one task spreads into grams, and bytes of a row of the model.
TASK_URLS, MODEL_ROW = 4000, 16
#: A gram with more than one in so many of all occurrences is heavy; there are fewer heavy grams than this.
HEAVY = 4096
#: Of the urls that rules judge, one in so many (by a hash) is left out of the models and sets the threshold.
CALIBRATION = 4


def host(url: Column) -> Column:
    return az_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as host plus path, and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [(host == h) | host.endswith("." + h) for h, _, _ in ordered]
    fits = [f & path.startswith(p) for f, (_, p, _) in zip(fits, ordered, strict=True)]
    first = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)]) if ordered else F.lit(None).cast("string")
    return first([h + p for h, p, _ in ordered]), first([v for _, _, v in ordered])


def grams(url: Column) -> Column:
    """The windows of ORDER + 1 characters that end at each character of the url and at its end. Letters lose their case;
    what isn't printable ASCII becomes `~`, so there are 97 characters at most. A null url has the end alone."""
    plain = F.regexp_replace(az_lower(F.coalesce(url, F.lit(""))), r"[^\x21-\x7E]", "~")
    padded = F.concat(F.lit("\x02" * ORDER), plain, F.lit("\x03"))
    # seen ahead from every place, in one pass: a substring for each place would cost a long url its square
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def fit(seen: DataFrame) -> DataFrame:
    """gram, llr: the scaled log-likelihood ratio of each gram's last character after the others, accepted against rejected.

    seen has gram, accepted and rejected (counts; grams that only unlabelled urls have count 0 and are scored too). Counts of
    shorter contexts are sums over the longer ones. Each context's estimate is smoothed by that of the next shorter one:
    p(c | x) = (n(xc) + BACKOFF p(c | x')) / (n(x) + BACKOFF), down to the uniform 1 / 97."""
    table = seen
    for side in ("accepted", "rejected"):
        table = table.withColumn(f"p_{side}", F.lit(1 / 97))
    for k in range(ORDER + 1):
        whole, context = F.substring("gram", ORDER + 1 - k, k + 1), F.substring("gram", ORDER + 1 - k, k)
        counts = seen.groupBy(whole.alias("whole")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).withColumn("context", F.substring("whole", 1, k))
        sums = counts.groupBy("context").agg(F.sum("a").alias("sa"), F.sum("r").alias("sr"))
        # 97^(k + 1) keys at most: the two shortest orders are broadcast by that bound
        bounded = F.broadcast if k <= 1 else lambda x: x
        joined = table.withColumn("whole", whole).join(bounded(counts.drop("context")), "whole").withColumn("context", context).join(bounded(sums), "context")
        for side, n, total in (("accepted", "a", "sa"), ("rejected", "r", "sr")):
            joined = joined.withColumn(f"p_{side}", (F.col(n) + BACKOFF * F.col(f"p_{side}")) / (F.col(total) + BACKOFF))
        table = joined.drop("whole", "context", "a", "r", "sa", "sr")
    return table.select("gram", F.round((F.ln("p_accepted") - F.ln("p_rejected")) * SCALE).cast("long").alias("llr"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """The columns of pages plus host, path, rule, verdict, score (length-normalised log-likelihood difference), threshold.

    The models learn from the urls that a rule accepts or rejects, but for one in CALIBRATION by a hash. The scores of those
    left out set the threshold: it lies between the means of the two kinds, in proportion to their spreads (0 if either
    kind is missing). A url without a rule is accepted at or above it. A null url, or one without `://`, has empty host and path and is judged by the model; repeated urls are judged alike; urls of any
    length are read whole, in time in proportion; an empty table gives an empty result; columns named like new ones are replaced."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score", "threshold")]
    keyed = pages.select(*kept, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    digest = F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), F.col("url").cast("string")), F.lit("")).cast("binary")))
    keyed = keyed.withColumn("rule", rule).withColumn("_by_rule", verdict).withColumn("_url", digest)
    # one row for each url: copies are counted, not repeated; grams carry its digest, as a long url has many
    urls = stash(keyed.groupBy("url", "_url", "_by_rule").count(), "urls")
    urls = urls.withColumn("_apart", F.conv(F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int") % CALIBRATION == 0)
    spread = urls.repartition(max(1, urls.count() // TASK_URLS), "_url").select("_url", "_by_rule", "_apart", "count", F.explode(grams(F.col("url"))).alias("gram"))
    side = lambda v: F.sum(F.when((F.col("_by_rule") == v) & ~F.col("_apart"), F.col("count")).otherwise(0))
    seen = stash(spread.groupBy("gram").agg(side("allow").alias("accepted"), side("block").alias("rejected"), F.count(F.lit(1)).alias("uses")), "url-grams")
    model = stash(fit(seen.drop("uses")), "url-model")
    scores = stash(scored(spread, model, seen), "url-scores")
    stats = {r["_by_rule"]: r for r in scores.filter("_by_rule is not null and _apart").groupBy("_by_rule").agg(
        (F.sum(F.col("score") * F.col("count")) / F.sum("count")).alias("mean"), F.sum("count").alias("n"),
        F.sqrt(F.sum(F.col("score") * F.col("score") * F.col("count")) / F.sum("count") - F.pow(F.sum(F.col("score") * F.col("count")) / F.sum("count"), 2)).alias("spread"),
    ).collect()}  # two rows
    cut = 0.0
    if len(stats) == 2:
        a, b = stats["allow"], stats["block"]
        wide = (a["spread"] or 0.0) + (b["spread"] or 0.0)
        share = (b["spread"] or 0.0) / wide if wide and wide == wide else 0.5
        cut = round(b["mean"] + share * (a["mean"] - b["mean"]), 6)
    out = with_scores(keyed, scores).drop("_url").withColumn("threshold", F.lit(cut))
    own = F.when(F.col("score") >= F.col("threshold"), F.lit("allow")).otherwise(F.lit("block"))
    return out.withColumn("verdict", F.coalesce("_by_rule", own)).drop("_by_rule").select(*kept, "host", "path", "rule", "verdict", "score", "threshold")


def with_scores(keyed: DataFrame, scores: DataFrame) -> DataFrame:
    """keyed with the score of its url. Scores within the bytes of a broadcast go to all tasks; beyond that those of urls that more than one
    in HEAVY rows have do, and only urls that are not frequent are joined by shuffle."""
    n, total = scores.agg(F.count(F.lit(1)), F.sum("count")).first()
    side = scores.select("_url", "score")
    if n * 64 <= BROADCAST_BYTES:
        return keyed.join(F.broadcast(side), "_url")
    heavy = scores.filter(F.col("count") * HEAVY > total).select("_url", "score")
    first = keyed.join(F.broadcast(heavy), "_url", "left")
    return first.filter("score is not null").unionByName(first.filter("score is null").drop("score").join(side, "_url"))


def scored(spread: DataFrame, model: DataFrame, seen: DataFrame) -> DataFrame:
    """_url, _by_rule, _apart, count, score of the urls that spread holds gram by gram. A model within the bytes of a broadcast goes to
    all tasks; beyond that its heavy grams alone do (fewer than HEAVY), and only the others, none of which is frequent,
    are joined by shuffle."""
    by = ["_url", "_by_rule", "_apart", "count"]
    if model.count() * MODEL_ROW <= BROADCAST_BYTES:
        met = spread.join(F.broadcast(model), "gram")
    else:
        total = seen.agg(F.sum("uses")).first()[0]
        heavy = model.join(seen.filter(F.col("uses") * HEAVY > total).select("gram"), "gram")
        first = spread.join(F.broadcast(heavy), "gram", "left")
        met = first.filter("llr is not null").unionByName(first.filter("llr is null").drop("llr").join(model, "gram"))
    return met.groupBy(*by).agg((F.sum("llr") / F.count("llr") / SCALE).alias("score"))


def keep(pages: DataFrame, rules=RULES) -> DataFrame:
    """The pages whose url is accepted. Columns stay as they are."""
    return judge(pages, rules).filter("verdict = 'allow'").select(*pages.columns)


