"""Resampling towards a target distribution: documents are drawn by how much their hashed n-grams gain under the target.

A scan reads the n-grams off a text whose gaps are single spaces, by overlapped matches of one pattern, and keeps their
buckets; the counts of all documents and the weight of each come from those, so texts are scanned once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..tables import in_ranges, numbered
from .common import ship, stash

ship(__name__)
BUCKETS = 10_000
#: Runs of one to so many words are features.
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Rows that one task ranks, about.
RANGE_ROWS = 50_000

_code = np.arange(256)
_word = ((_code >= 48) & (_code < 58)) | ((_code >= 65) & (_code < 91)) | ((_code >= 97) & (_code < 123)) | (_code >= 128)
#: Lower-cases A-Z and turns what separates words into spaces.
PLAIN = np.where(_word, np.where((_code >= 65) & (_code < 91), _code + 32, _code), 32).astype(np.uint8).tobytes()


def pattern(longest: int) -> regex.Pattern:
    """A match for each word, found overlapped: the word from one boundary to the next, and, seen ahead from its start, the runs of
    2 .. `longest` words that begin there (a group each; none where the text ends before)."""
    ahead = "".join(rf"(?=((?:[^ ]++ ){{{k - 1}}}[^ ]++(?![^ ]))?+)" for k in range(2, longest + 1))
    return regex.compile(rf"(?<![^ ]){ahead}([^ ]++)(?![^ ])".encode())


def hashes(text: bytes, found: regex.Pattern) -> tuple[int, np.ndarray]:
    """How many words the text has, and crc32 of each of its n-grams."""
    plain = b" ".join(text.translate(PLAIN).split())
    crc = zlib.crc32
    each = np.fromiter((crc(g) for m in found.finditer(plain, overlapped=True) for g in m.groups() if g is not None), np.uint32)
    return plain.count(b" ") + (plain != b""), each


def features(docs: DataFrame, keep: list[str], longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """_row (the columns `keep` of docs), _words, _features (how many the text has) and _buckets (of each feature, as little-endian
    numbers of `_width(buckets)`)."""
    kind = _width(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = pattern(longest)
        for batch in batches:
            words, n, binary = [], [], []
            for text in batch.column(1):
                count, each = hashes((text.as_py() or "").encode(), ngrams)
                words.append(count)
                n.append(len(each))
                binary.append((each % buckets).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(binary, pa.binary())], ["_row", "_words", "_features", "_buckets"])

    own = docs.select(F.struct(*keep).alias("_row"), F.col("text").cast("string").alias("_text"))
    schema = own.select("_row", F.lit(0).cast("long").alias("_words"), F.lit(0).cast("long").alias("_features"), F.lit(b"").alias("_buckets")).schema
    return own.mapInArrow(run, schema)


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: every task counts its own, and the sums are as many numbers as there are buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for each in batch.column(0):
                total += np.bincount(np.frombuffer(each.as_buffer(), _width(buckets)), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in found.select("_buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: 1000 times the logarithm of how much likelier it is under the target, both smoothed by one, as whole numbers."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """_row, _words, _features, _weight: the mean gain of a document's features, as a whole number below; 0 without features."""
    wide, own = _width(len(gain)), StructType([f for f in found.schema if f.name != "_buckets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = []
            for each in batch.column(3):
                at = np.frombuffer(each.as_buffer(), wide)
                weight.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], [*own.names, "_weight"])

    return found.mapInArrow(run, StructType([*own, StructField("_weight", LongType())]))


def ranked(
    docs: DataFrame, target: DataFrame, keep: list[str] | None = None, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """The columns `keep` of docs (all but text, if not given) with n_features, weight, score and rank, a row for each row of docs.

    Features are the runs of 1 to `longest` words of a text, repeats counted. weight tells how much likelier its features are
    among those of the target's texts than among those of docs. score adds noise that depends on the seed and on doc_id alone, so that
    the `percent` of highest scores among documents of `least_words` words are a draw without replacement by weight. rank
    numbers the drawn rows from the highest score; it is null for others. Ties go to the smaller doc_id, and among rows of one
    doc_id to that with fewer features; rows that agree in all of this are alike.

    Null and empty texts have no features, weight 0 and no rank. A null doc_id is hashed as an empty text and comes first in ties.
    Texts of any length are read whole. An empty target or table gives smoothed counts, so equal gains; columns of docs that are named like new ones are replaced."""
    new = ["n_features", "weight", "score", "rank"]
    keep = [c for c in (keep or [c for c in docs.columns if c != "text"]) if c not in new]
    found = stash(features(docs, keep, longest, buckets), "importance-features")
    gain = gains(histogram(found, buckets), histogram(features(target, [target.columns[0]], longest, buckets), buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = stash(weighed(found, gain).withColumn("_score", F.col("_weight") + noise.cast("long")), "importance-weights")
    able = rows.filter(F.col("_words") >= least_words)
    n = able.count()
    order = [F.desc("_score"), "_row.doc_id", "_features"]
    placed = numbered(in_ranges(able, order, 1 + n // RANGE_ROWS, "importance-ranges"), [], order, "_rank_all")
    drawn = F.when(F.col("_rank_all") <= percent * n // 100, F.col("_rank_all"))
    names = ["_row", "_features", "_weight", "_score"]
    out = placed.select(*names, drawn.alias("_rank")).unionByName(rows.filter(F.col("_words") < least_words).select(*names, F.lit(None).cast("long").alias("_rank")))
    return out.select(*(F.col("_row")[c].alias(c) for c in keep), *(F.col(a).alias(b) for a, b in zip([*names[1:], "_rank"], new, strict=True)))


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that ranked() draws, with its columns, texts included."""
    return ranked(docs, target, list(docs.columns), **how).filter("rank is not null")
