"""Quality classifier: a Bradley-Terry ranking learned from preference pairs, cut at a quantile of its scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .vectors import SPACES, byte_slices, hash_words, words_of

ship(__name__)
#: The model is fitted on at most so many labelled documents (those with the least hashes of doc_id) and pairs.
SAMPLE, PAIRS = 6000, 40_000
#: Scores at or above this are predicted 1.
CUT = 0.7
_PUNCTUATION = [c for c in range(33, 127) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123)]
_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10, 13), "control": [*range(9), 11, 12, *range(14, 32), 127],
    "beyond": range(128, 256), **{chr(c): (c,) for c in _PUNCTUATION},
}
_BYTE_GROUP = np.zeros((256, len(_GROUPS)))
for _k, _codes in enumerate(_GROUPS.values()):
    _BYTE_GROUP[list(_codes), _k] = 1


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text: shares of kinds of characters, sizes and variety of words and lines, repetition."""
    starts, ends, first = words_of(data, offsets, SPACES)
    hashes, lengths = hash_words(data, starts, ends), ends - starts
    tail = ~np.isin(data[ends - 1] if len(ends) else ends, np.r_[48:58, 65:91, 97:123, 128:256].astype(np.uint8))
    capital = (data[starts] >= 65) & (data[starts] < 91) if len(starts) else np.zeros(0, bool)
    out = []
    for k in range(len(offsets) - 1):
        text = data[offsets[k] : offsets[k + 1]]
        a, b = first[k], first[k + 1]
        n, words = max(1, len(text)), max(1, b - a)
        count = np.bincount(text, minlength=256)
        share = count / n
        kinds = share @ _BYTE_GROUP
        raw = text.tobytes()
        lines = raw.split(b"\n")
        some = share[share > 0]
        size = lengths[a:b]
        more = [
            np.log1p(len(text)), np.log1p(b - a), (size.mean() if b > a else 0) / 10, (size.std() if b > a else 0) / 10, np.log1p(size.max() if b > a else 0),
            len(np.unique(hashes[a:b])) / words, len(np.unique(hashes[a:b])) / np.sqrt(words), tail[a:b].mean() if b > a else 0, capital[a:b].mean() if b > a else 0,
            len(set(lines)) / len(lines), np.log1p(len(lines)), len(zlib.compress(raw, 1)) / (n + 20), float(-(some * np.log2(some)).sum()),
        ]
        out.append(np.concatenate([kinds, np.log(kinds + 1e-3), more, [share[_PUNCTUATION].sum(), np.log(share[_PUNCTUATION].sum() + 1e-3)]]))
    return np.array(out)


def fit(x: np.ndarray, label: np.ndarray, steps: int = 12, ridge: float = 1e-2, seed: int = 5) -> dict:
    """Weights that rank rows of label 1 above rows of label 0, from random pairs of one each, and the score to cut at.

    Logistic loss on feature differences, by Newton's method. The cut is the quantile of the rows' scores, among all, that
    separates the labels best (balanced accuracy). With one label only, every score is the share of label 1."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return {"constant": float(label.mean()) if len(label) else 0.5}
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / spread
    rng = np.random.default_rng(seed)
    n = min(PAIRS, 20 * len(x))
    difference = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))  # probability that the pair is ranked wrongly
        gradient = difference.T @ p / n - ridge * w
        curvature = (difference * (p * (1 - p))[:, None]).T @ difference / n + ridge * np.eye(len(w))
        w += np.linalg.solve(curvature, gradient)
    score = z @ w
    quantiles = np.quantile(score, np.arange(1, 400) / 400)
    right = [((score[good] >= q).mean() + (score[bad] < q).mean()) / 2 for q in quantiles]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    return {"mean": mean, "spread": spread, "w": w, "cut": float(quantiles[best[len(best) // 2]]), "scale": float(max(1e-6, score.std()))}


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores between 0 and 1; CUT is where the ranking score passes its cut."""
    if "constant" in model:
        return np.full(len(x), model["constant"])
    score = ((x - model["mean"]) / model["spread"]) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(2 * (score - model["cut"]) / model["scale"] + np.log(CUT / (1 - CUT)), -30, 30)))


def sample_of(labels: DataFrame, column: str, parts: int, held_out: int, limit: int, key=None) -> DataFrame:
    """doc_id, label of at most `limit` labelled documents outside the held-out fold, by a hash of doc_id (or by key)."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (fold(F.col("doc_id"), parts) != held_out))
    rows = rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")] if key is None else key
    return rows.orderBy(*order).limit(limit)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The ranking model. Of labels (doc_id, quality 0 or 1) only rows whose crc32(doc_id) mod 4 is not 2 are looked at, and
    of those at most `sample`; their features come to the driver: `sample` rows of some 90 numbers."""
    wanted = sample_of(labels, "quality", 4, 2, sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(2)):
                rows = pa.array(list(features(data, offsets)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), rows], ["doc_id", "label", "x"])

    texts = texts.withColumn("doc_id", F.col("doc_id").cast("string"))
    found = texts.mapInArrow(run, "doc_id string, label int, x array<double>").groupBy("doc_id").agg(F.first("label").alias("label"), F.max("x").alias("x")).orderBy("doc_id").collect()
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    return fit(np.array([r["x"] for r in found]).reshape(-1, width), np.array([r["label"] for r in found]))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """The columns of docs plus score and predicted (1 if score >= CUT), in the place of columns of these names. A null text is
    empty and is scored as such; an empty table gives an empty result; other columns go through as they are."""
    others = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    place = [f.name for f in others].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(place)):
                p = apply(model, features(data, offsets))
                columns = [batch.column(k).slice(a, b - a) for k in range(len(others))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= CUT).astype(np.int32))], [*[f.name for f in others], "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    schema = StructType([*others, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.select(*[f.name for f in others]).mapInArrow(run, schema)


def rank(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. Only texts make scores; without usable labels every score is
    the share of label 1 (0.5 if there are none). Repeated rows are scored alike; an empty table gives an empty result."""
    out = score(docs.select("doc_id", "text"), train(docs, labels, sample))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that are predicted 0; all of docs if usable labels are missing or all of one kind, as they rank
    nothing then. Columns stay as they are."""
    model = train(docs, labels, sample)
    if "constant" in model:
        return docs
    own = {c: f"_own_{k}" if c in ("score", "predicted") else c for k, c in enumerate(docs.columns)}
    judged = score(docs.withColumnsRenamed({c: n for c, n in own.items() if n != c}), model).filter("predicted = 1")
    return judged.select(*[F.col(n).alias(c) for c, n in own.items()])
