"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stash
from .quality import CUT, fold, sample_of
from .vectors import NON_ALNUM, byte_slices, hash_words, words_of

ship(__name__)
#: Bounds of the fit: labelled documents of each kind, and words that those of a kind have together. A document is fitted on whole
#: or, where the words left don't hold it, not at all.
TOXIC_SAMPLE, CLEAN_SAMPLE, FIT_WORDS = 2000, 3000, 1_500_000
#: Rows of the embedding table, its width, the widths of the filters in words, filters of each width, bytes of the prefixes hashed beside a word.
BUCKETS, DIM, WIDTHS, FILTERS, PREFIXES = 1 << 17, 12, (1, 2, 3), 12, (4, 5, 6)
EPOCHS, RATE, BATCH, DECAY, DROPPED = 8, 0.02, 64, 1e-3, 0.3
#: Of the sample, one in so many documents is left out of the fit and sets the thresholds.
CALIBRATION = 4
#: Frequent words by which a text's language is told. They choose its threshold, not its score.
LANGUAGES = {
    "en": "the of and to in a is that it was for on with as by",
    "de": "der die und das ist mit den von zu auf ein nicht",
    "fr": "le la les des et une est dans que pour un du",
    "es": "el los las del en es por con una que su y",
}


def _language_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.int64)
    for k, words in enumerate(LANGUAGES.values(), 1):
        for w in words.split():
            data = np.frombuffer(w.encode(), np.uint8)
            table[hash_words(data, np.array([0]), np.array([len(data)]))[0] % np.uint64(1 << 16)] = k
    return table


_LANGUAGE = _language_table()


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of each word (itself and its prefixes), each text's first word, the language of each text (0: none told)."""
    data = data.copy()  # capitals of Latin-1 are two bytes in UTF-8: C3 80 to C3 9E
    data[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 0x20
    starts, ends, first = words_of(data, offsets, NON_ALNUM)
    whole = hash_words(data, starts, ends)
    columns = [whole, *[hash_words(data, starts, ends, most) * np.uint64(2 * k + 3) for k, most in enumerate(PREFIXES)]]
    ids = np.stack([(c >> np.uint64(7)) % np.uint64(BUCKETS) for c in columns], axis=1).astype(np.int32)
    told = _LANGUAGE[(whole % np.uint64(1 << 16)).astype(np.int64)]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    count = np.bincount(owner * 5 + told, minlength=5 * (len(offsets) - 1)).reshape(-1, 5)
    count[:, 0] = 0
    return ids, first, np.where(count.max(axis=1) > 0, count.argmax(axis=1), 0)


def start(seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    model = {"emb": rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32), "out": rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), "bias": np.zeros(1, np.float32)}
    for w in WIDTHS:
        model[f"filter{w}"] = rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32)
        model[f"shift{w}"] = np.zeros(FILTERS, np.float32)
    return model


def pooled(model: dict, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray]:
    """The greatest response of each filter in each text (0 at least), the word where it starts, and the word vectors."""
    vectors = model["emb"][ids].sum(axis=1)
    n, texts = len(ids), len(first) - 1
    values, where = np.zeros((texts, FILTERS * len(WIDTHS)), np.float32), {}
    ends = np.repeat(first[1:], np.diff(first))
    for k, w in enumerate(WIDTHS):
        response = np.zeros((n, FILTERS), np.float32)
        for j in range(w):
            response[: n - j] += vectors[j:] @ model[f"filter{w}"][j]
        response += model[f"shift{w}"]
        response[np.arange(n) + w > ends] = -1  # a window that leaves its text
        full = np.flatnonzero(np.diff(first) > 0)
        if len(full):
            values[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(response, first[:-1][full], axis=0)
        where[w] = response
    return np.maximum(values, 0), where, vectors


def logits(model: dict, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    return pooled(model, ids, first)[0] @ model["out"] + model["bias"][0]


def fit(ids: list[np.ndarray], label: np.ndarray, language: np.ndarray, seed: int = 3) -> dict:
    """Adam on the logistic loss of random batches, from which a part of the words is dropped; only the words where a filter is greatest get gradients. Thresholds: for
    each language the logit that separates the labels of its documents outside the fit best; a language with few of
    either label uses that of all."""
    model, rng = start(seed), np.random.default_rng(seed)
    first_moment = {k: np.zeros_like(v) for k, v in model.items()}
    second_moment = {k: np.zeros_like(v) for k, v in model.items()}
    step, epochs = 0, EPOCHS * max(1, min(8, 1500 // max(1, len(ids))))
    fitted = np.flatnonzero(np.arange(len(ids)) % CALIBRATION > 0)
    for _ in range(epochs):
        order = rng.permutation(fitted)
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            part = [ids[i][rng.random(len(ids[i])) >= DROPPED] for i in chosen]
            words, first = np.concatenate(part), np.concatenate([[0], np.cumsum([len(x) for x in part])])
            value, where, vectors = pooled(model, words, first)
            error = 1 / (1 + np.exp(-np.clip(value @ model["out"] + model["bias"][0], -30, 30))) - label[chosen]
            error = (error / len(chosen)).astype(np.float32)
            grad = {"out": value.T @ error, "bias": error.sum(keepdims=True)}
            back = np.zeros_like(vectors)
            for k, w in enumerate(WIDTHS):
                delta = error[:, None] * model["out"][k * FILTERS : (k + 1) * FILTERS] * (value[:, k * FILTERS : (k + 1) * FILTERS] > 0)
                spot = np.array([where[w][a:b].argmax(axis=0) + a if b > a else np.zeros(FILTERS, int) for a, b in zip(first[:-1], first[1:], strict=True)])
                grad[f"shift{w}"] = delta.sum(axis=0)
                bank = np.zeros_like(model[f"filter{w}"])
                for j in range(w):
                    place = np.minimum(spot + j, max(0, len(words) - 1))
                    for f in range(FILTERS if len(words) else 0):
                        bank[j, :, f] = vectors[place[:, f]].T @ delta[:, f]
                        np.add.at(back, place[:, f], delta[:, f, None] * model[f"filter{w}"][j, :, f])
                grad[f"filter{w}"] = bank
            touched = np.flatnonzero(np.abs(back).sum(axis=1) > 0)
            rows, inverse = np.unique(words[touched].ravel(), return_inverse=True)
            slope = np.zeros((len(rows), DIM), np.float32)
            np.add.at(slope, inverse, np.repeat(back[touched], words.shape[1], axis=0))
            slope += DECAY * model["emb"][rows]
            step += 1
            for k in [*grad, "emb"]:
                part, g = (rows, slope) if k == "emb" else (slice(None), grad[k])
                first_moment[k][part] = 0.9 * first_moment[k][part] + 0.1 * g
                second_moment[k][part] = 0.99 * second_moment[k][part] + 0.01 * g * g
                model[k][part] -= RATE * (first_moment[k][part] / (1 - 0.9**step)) / (np.sqrt(second_moment[k][part] / (1 - 0.99**step)) + 1e-6)
    apart = np.arange(len(ids)) % CALIBRATION == 0
    score = np.array([logits(model, x, np.array([0, len(x)]))[0] for x in ids]) if ids else np.zeros(0)

    def threshold(mask: np.ndarray) -> float | None:
        good, bad = np.sort(score[mask & apart & (label == 1)]), np.sort(score[mask & apart & (label == 0)])
        if len(good) < 10 or len(bad) < 10:
            return None
        edges = np.concatenate([good, bad])
        right = np.array([(good >= e).sum() * len(bad) + (bad < e).sum() * len(good) for e in edges])
        low = edges[right == right.max()].min()
        below = bad[bad < low]
        return float((low + below[-1]) / 2) if len(below) else float(low)

    every = threshold(np.ones(len(ids), bool))
    every = 0.0 if every is None else every
    model["threshold"] = np.array([every if (t := threshold(language == k)) is None else t for k in range(5)])
    return model


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The classifier. Of labels (doc_id, toxic 0 or 1) only rows whose crc32(doc_id) mod 3 is not 1 are looked at: at most
    TOXIC_SAMPLE of label 1 and CLEAN_SAMPLE of label 0, in order of a hash of doc_id, and of these the whole texts that
    FIT_WORDS words of each label hold; their word ids come to the driver, 16 bytes each."""
    rows = [sample_of(labels.filter(F.col("toxic") == k), "toxic", 3, 1, n) for k, n in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE))]
    wanted = rows[0].unionByName(rows[1])
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id")
    texts = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(2)):
                ids, first, language = word_ids(data, offsets)
                words = pa.array([ids[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(language.astype(np.int32)), words], ["doc_id", "label", "language", "words"])

    every = texts.mapInArrow(run, "doc_id string, label int, language int, words binary").groupBy("doc_id").agg(F.max("label").alias("label"), F.max(F.struct("words", "language")).alias("x"))
    every = stash(every, "toxicity-sample")
    left, chosen = {0: FIT_WORDS, 1: FIT_WORDS}, []
    for r in every.select("doc_id", "label", (F.octet_length("x.words") / (4 + 4 * len(PREFIXES))).cast("long").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= left[r["label"]]:
            left[r["label"]] -= r["n"]
            chosen.append(r["doc_id"])
    fitted = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id string")
    found = every.join(F.broadcast(fitted), "doc_id").orderBy("doc_id").collect()
    ids = [np.frombuffer(r["x"]["words"], np.int32).reshape(-1, 1 + len(PREFIXES)) for r in found]
    return fit(ids, np.array([r["label"] for r in found], np.float32), np.array([r["x"]["language"] for r in found]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. The score comes from the text alone: its logit against the
    threshold of the language that its words tell, so that CUT is that threshold. Null, empty and wordless texts have
    the logit of no words. Repeated rows are scored alike; without labels the model is untrained; an empty table gives an empty result."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(1)):
                ids, first, language = word_ids(data, offsets)
                logit = logits(model, ids, first) - model["threshold"][language]
                p = 1 / (1 + np.exp(-np.clip(logit + np.log(CUT / (1 - CUT)), -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p, pa.float64()), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
