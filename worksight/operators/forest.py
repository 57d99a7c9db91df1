"""Statistical outliers: features, median imputation, and an isolation forest (Liu, Ting, Zhou 2008) fitted on a bounded sample.

Every draw of the forest is a hash: of the id for the order in which rows enter trees, of tree and node for features and cuts.
So a forest depends on its dataset alone, not on partitions or a generator's state, and SQL can grow the same one."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import ANOMALY_HIGH, ANOMALY_TRIGGER
from ..tables import lookup, stash
from ..tasks import ship
from . import ranks
from .signals import evidence, make_signals

ship(__name__)

FEATURES = ("cost_ratio", "gap", "delay", "expenditure_ratio", "duplicate_score")
TREES, SAMPLE, SEED, OFFSET, MIN_ROWS = 200, 256, 26102, -0.5, 10
#: Rows of a dataset that one task scores, about.
SCORE_ROWS = 100_000
#: Rows of each dataset that enter trees, at most.
POOL = TREES * SAMPLE


def features(works: DataFrame, metrics: DataFrame, peers: DataFrame, scores: DataFrame) -> DataFrame:
    """dataset_id, id and FEATURES; what is unknown is null."""
    m = metrics.select("dataset_id", F.col("project_id").alias("id"), F.col("financial_physical_gap").cast("double").alias("gap"),
        F.col("delay_days").cast("double").alias("delay"), F.col("expenditure_ratio").cast("double").alias("expenditure_ratio"))
    p = peers.select("dataset_id", F.col("project_id").alias("id"), F.col("peer_median_cost").cast("double").alias("_median"))
    d = scores.select("dataset_id", F.col("project_id").alias("id"), F.col("duplicate_score").cast("double").alias("duplicate_score"))
    key = ["dataset_id", "id"]
    out = works.select(*key, F.col("sanctioned_cost").cast("double").alias("_cost")).join(m, key, "left").join(p, key, "left").join(d, key, "left")
    return out.select(*key, F.when(F.col("_median") != 0, F.round(F.col("_cost") / F.col("_median"), 6)).alias("cost_ratio"), *FEATURES[1:])


def impute(rows: DataFrame) -> DataFrame:
    """Nulls become the exact median of their column in the dataset; 0 where a column has none."""
    keys = ["dataset_id", "_feature"]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("_feature"), F.col(c).alias("_value")) for k, c in enumerate(FEATURES)])).alias("_e")
    counts = ranks.counted(rows.select("dataset_id", each).select("dataset_id", "_e.*"), keys, "_value", "feature-values")
    sizes = ranks.members(counts, keys, 1, "feature-sizes")
    middle = ranks.nth(counts, sizes, keys, "_value", {"_low": F.floor((F.col("members") - 1) / 2), "_high": F.floor(F.col("members") / 2)})
    of = lambda k: F.max(F.when(F.col("_feature") == k, F.col("_low") * 0.5 + F.col("_high") * 0.5))
    medians = middle.groupBy("dataset_id").agg(*[of(k).alias(f"_{c}") for k, c in enumerate(FEATURES)])
    joined = rows.join(lookup(medians, sizes[1]), "dataset_id", "left")
    return joined.select("dataset_id", "id", *[F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(0.0)).alias(c) for c in FEATURES])


def _path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def draw(*key) -> float:
    """A number in [0, 1) that depends on the key alone: the first 52 bits of the MD5 of its parts, joined by `:`."""
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:13], 16) / (1 << 52)


def grow(x: np.ndarray, seed: int, tree: int) -> list[tuple]:
    """A tree as (feature, cut, left, right) or (-1, depth + expected rest, 0, 0): cuts drawn for columns drawn among those that
    vary. The draws of a node hash its place in the tree: the root is 1, the children of k are 2 k and 2 k + 1."""
    limit, nodes = int(np.ceil(np.log2(max(2, len(x))))), []

    def node(rows: np.ndarray, depth: int, place: int) -> int:
        at = len(nodes)
        nodes.append(None)
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varying):
            nodes[at] = (-1, depth + float(_path(len(rows))), 0, 0)
            return at
        f = int(varying[int(draw(seed, tree, place, "f") * len(varying))])
        cut = float(low[f] + draw(seed, tree, place, "c") * (high[f] - low[f]))
        left = x[rows, f] < cut
        nodes[at] = (f, cut, node(rows[left], depth + 1, 2 * place), node(rows[~left], depth + 1, 2 * place + 1))
        return at

    node(np.arange(len(x)), 0, 1)
    return nodes


def fit(pool: np.ndarray, seed: int = SEED, trees: int = TREES) -> dict | None:
    """The forest of rows in the order in which they enter trees: each tree takes the next SAMPLE of them, around the end to the
    start. None for fewer than MIN_ROWS rows."""
    if len(pool) < MIN_ROWS:
        return None
    size = min(SAMPLE, len(pool))
    grown = [np.array(grow(pool[(t * SAMPLE + np.arange(size)) % len(pool)], seed, t), float) for t in range(trees)]
    return {"trees": grown, "norm": float(_path(size))}


def decide(model: dict, x: np.ndarray) -> np.ndarray:
    """0.5 - 2^(-mean depth / norm): negative for outliers. All rows descend a tree together."""
    depth = np.zeros(len(x))
    for t in model["trees"]:
        at, todo = np.zeros(len(x), int), np.arange(len(x))
        while len(todo):
            f = t[at[todo], 0].astype(int)
            todo, f = todo[f >= 0], f[f >= 0]
            left = x[todo, f] < t[at[todo], 1]
            at[todo] = np.where(left, t[at[todo], 2], t[at[todo], 3]).astype(int)
        depth += t[at, 1]
    return -OFFSET - 2 ** (-depth / len(model["trees"]) / model["norm"])


def iforest_scores(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """dataset_id, project_id, ml_anomaly_score (4 places) of imputed rows; datasets under MIN_ROWS rows have no scores.

    A dataset's rows enter trees in order of the hash of their id: all of a small dataset, POOL of a large one. Each tree is
    grown in a group of its own, of SAMPLE rows at most. The trees are a table; a dataset's forest (3 MB at most) meets its rows in
    groups of SCORE_ROWS of them, so nothing of them passes through the driver however many datasets there are."""
    rows = rows.select("dataset_id", "id", *FEATURES)
    counts = stash(rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MIN_ROWS), "forest-counts")
    sized = lookup(counts, 80 * counts.count())
    digest = F.md5(F.col("id").cast("binary"))
    unit = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    # twice as many by the hash as are needed, then exactly those by rank
    entering = rows.join(sized, "dataset_id").filter(unit * F.col("_n") < 2 * POOL).withColumn("_at", F.row_number().over(Window.partitionBy("dataset_id").orderBy(digest, "id")) - 1)
    places = F.transform(F.sequence(F.lit(0), F.lit(POOL - 1)), lambda k: F.when(k % SAMPLE < F.col("_n"), F.struct(F.floor(k / SAMPLE).cast("int").alias("tree"), (k % F.col("_n")).cast("int").alias("_at"))))
    dealt = counts.select("dataset_id", F.explode(F.array_compact(places)).alias("_p")).select("dataset_id", "_p.*")
    names = list(FEATURES)
    pool = dealt.join(entering, ["dataset_id", "_at"]).select("dataset_id", "tree", "_at", *names)

    def train(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        nodes = np.array(grow(group.sort_values("_at")[names].to_numpy(float), seed, tree), float)
        return pd.DataFrame({"dataset_id": [group["dataset_id"].iloc[0]], "tree": [tree], "size": [len(group)], "nodes": [nodes.ravel().tolist()]})

    grown = stash(pool.groupBy("dataset_id", "tree").applyInPandas(train, "dataset_id string, tree int, size int, nodes array<double>"), "forest-trees")
    blocks = F.ceil(F.col("_n") / SCORE_ROWS).cast("int")
    forests = grown.groupBy("dataset_id").agg(F.sort_array(F.collect_list(F.struct("tree", "size", "nodes"))).alias("trees")).join(sized, "dataset_id")
    forests = forests.select("dataset_id", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"), "trees")
    own = rows.join(sized, "dataset_id").select("dataset_id", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("_block"), "id", *names)

    def score(part: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"dataset_id": [], "project_id": [], "ml_anomaly_score": []})
        trees = forest["trees"].iloc[0]
        model = {"trees": [np.array(t["nodes"], float).reshape(-1, 4) for t in trees], "norm": float(_path(trees[0]["size"]))}
        return pd.DataFrame({"dataset_id": part["dataset_id"], "project_id": part["id"], "ml_anomaly_score": np.round(decide(model, part[names].to_numpy(float)), 4)})

    keys = ["dataset_id", "_block"]
    return own.groupBy(*keys).cogroup(forests.groupBy(*keys)).applyInPandas(score, "dataset_id string, project_id string, ml_anomaly_score double")


def ml_signals(scores: DataFrame) -> DataFrame:
    df = scores.withColumnRenamed("project_id", "id")
    s = F.col("ml_anomaly_score")
    severity = F.when(s <= ANOMALY_HIGH, "HIGH").when(s < ANOMALY_TRIGGER, "MEDIUM")
    return make_signals(df, "ML_ANOMALY", severity, F.format_string("Statistically unusual profile (score %.3f)", s), "ML", {"score": s}, {"trigger": str(ANOMALY_TRIGGER)}, {"score": s}, [
        evidence("isolation forest score", s, "trigger", F.lit(ANOMALY_TRIGGER), None, model="iforest-v1")
    ], version="iforest-v1", explanation=F.format_string("Cost, progress, delay, spending and likeness together set the work apart from others of its dataset (score %.4f).", s))
