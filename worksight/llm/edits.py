"""Document fingerprints by randomised edit embedding: shared random walks over characters, then sampled positions.

A walk reads the character under a pointer, writes it, and moves the pointer on or not by a random bit that depends on the
step and the character alone. Two texts in step stay in step; after an edit their walks drift and soon meet again, so the
edit distance shows as Hamming distance of what is written. The fingerprint holds a hexadecimal digit for each of a fixed
set of steps, dense at the start and thinner from octave to octave.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stash
from .near_dup import components, in_blocks

ship(__name__)
#: A walk starts anew every BLOCK code points, so that texts of any length keep a bounded drift and share the vector steps.
BLOCK = 8192
#: Steps of a walk at most (on average two move the pointer once), and sampled steps of each octave.
STEPS, SAMPLES = 3 * BLOCK, 32
#: Code points of own and edited texts that are walked at once.
CHUNK = 3 << 20
#: Documents of one range of doc_id at least; of n, a range holds sqrt(n) where that is more.
RANGE_ROWS = 2000
BANDS, BAND_SAMPLES = 24, 6
#: Bands inside each octave of a block, and the digit from which on octaves are banded.
OCTAVE_BANDS, BAND_FROM = 12, 32
#: Pairs whose fingerprints are further below the threshold than this are not verified.
MARGIN = 0.2
_made: dict = {}


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shared randomness: a move for each step and character class, sampled steps, their digits, their weights."""
    if not _made:
        rng = np.random.default_rng(20240229)
        steps, weights = [], []
        low = 0
        while low < STEPS:
            high = min(STEPS, max(1, 2 * low))
            own = np.arange(low, high) if high - low <= SAMPLES else np.sort(rng.choice(np.arange(low, high), SAMPLES, replace=False))
            steps += list(own)
            weights += [(high - low) / len(own)] * len(own)
            low = high
        _made["t"] = rng.integers(0, 2, (STEPS, 256), dtype=np.uint8), np.array(steps), rng.integers(0, 16, (len(steps), 256), dtype=np.uint8), np.array(weights)
    return _made["t"]


_DIGITS = np.frombuffer(b"0123456789abcdef.", np.uint8)


def fingerprints(texts: list[np.ndarray]) -> list[str]:
    """The fingerprint of each text (arrays of code points): the digits of its blocks, joined by `:`; empty if it has none.
    A block's digits end where its walk does."""
    moves, steps, digits, _ = tables()
    starts, lengths, owner, base = [], [], [], 0
    for k, t in enumerate(texts):
        for a in range(0, len(t), BLOCK):
            starts.append(base + a)
            lengths.append(min(BLOCK, len(t) - a))
            owner.append(k)
        base += len(t)
    if not starts:
        return [""] * len(texts)
    codes = np.concatenate([*texts, np.zeros(STEPS, np.uint32)])
    classes = ((codes ^ (codes >> np.uint32(8))) & np.uint32(255)).astype(np.uint8)
    order = np.argsort(-np.array(lengths), kind="stable")
    pointer, end = np.array(starts)[order], (np.array(starts) + np.array(lengths))[order]
    written = np.full((len(order), len(steps)), 16, np.uint8)
    row, sample = np.arange(len(order)), 0
    for j in range(STEPS):
        if j % 64 == 0:
            on = pointer < end
            if not on.all():
                pointer, end, row = pointer[on], end[on], row[on]
            if not len(row):
                break
        c = classes.take(pointer)
        if steps[sample] == j:
            written[row, sample] = np.where(pointer < end, digits[sample].take(c), 16)
            sample = min(sample + 1, len(steps) - 1)
        pointer += moves[j].take(c)
    signs = _DIGITS[written[np.argsort(order)]]
    out: list[list[str]] = [[] for _ in texts]
    for k, r in zip(owner, signs, strict=True):
        out[k].append(r.tobytes().decode().rstrip("."))
    return [":".join(x) for x in out]


def likeness(a: str, b: str) -> float:
    """Between 0 and 1: the share of steps (by the weight of their octave) at which both texts wrote the same character, less
    what differing characters agree by chance. Two empty fingerprints are alike."""
    weights = tables()[3]
    same = total = 0.0
    left, right = a.split(":"), b.split(":")
    for k in range(max(len(left), len(right))):
        x = np.frombuffer((left[k] if k < len(left) else "").encode(), np.uint8)
        y = np.frombuffer((right[k] if k < len(right) else "").encode(), np.uint8)
        n = min(len(x), len(y))
        same += weights[:n][x[:n] == y[:n]].sum()
        total += weights[: max(len(x), len(y))].sum()
    return max(0.0, (same / total - 1 / 16) * 16 / 15) if total else 1.0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(own: str, after: str) -> str:
    """own with its last half (rounded down) replaced by as many first code points of `after`, or all it has."""
    half = len(own) // 2
    return own[: len(own) - half] + after[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """_range, _tail, doc_id, text in ranges of doc_id: each range is followed by the first document of the next
    (_tail 1), the last by the first of all. Texts are shuffled once; only the ids at which ranges begin come to the driver,
    at most the square root of their number. A row finds its range in two steps, among every so-manieth begin and those after it."""
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"))
    n = ids.count()
    ranges = max(1, int(n / max(RANGE_ROWS, n**0.5)))
    dealt = ids.filter("_id is not null").repartitionByRange(ranges, "_id").groupBy(F.spark_partition_id()).agg(F.min("_id").alias("low"))
    lows = sorted(r["low"] for r in dealt.collect())  # ranges rows
    lowest, cuts = (lows[0] if lows else None), lows[1:]
    width = max(1, int(len(cuts) ** 0.5))
    steps = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    long = lambda c: f"{c}L" if c > -(1 << 63) else "(-9223372036854775807L - 1L)"
    listed = ", ".join(f"array({', '.join(map(long, some))})" for some in steps)
    table = F.expr(f"array({listed})" if steps else "cast(array() as array<array<bigint>>)")
    step = F.size(F.filter(table, lambda some: some[0] <= F.col("_id"))) - 1
    own = F.coalesce(F.get(table, step), F.array().cast("array<bigint>"))
    at = F.when(F.col("_id").isNull() | (step < 0), F.lit(0)).otherwise(step * width + F.size(F.filter(own, lambda c: c <= F.col("_id"))))
    first = F.col("_id").isNull() if ids.filter("_id is null").limit(1).count() else F.coalesce(F.col("_id") == F.lit(lowest), F.lit(False))
    place = lambda r, tail: F.struct(r.cast("int").alias("_range"), F.lit(tail).alias("_tail"))
    begins = F.col("_id").isNotNull() & (step >= 0) & F.array_contains(own, F.col("_id"))
    places = F.array_compact(F.array(place(F.col("_at"), 0), F.when(begins, place(F.col("_at") - 1, 1)), F.when(first, place(F.lit(len(cuts)), 2))))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("_id")).withColumn("_at", at)
    return rows.select(F.explode(places).alias("_p"), "doc_id", "text", "_id").select("_p._range", "_p._tail", "doc_id", "text", "_id")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    The next document is that of the next doc_id (after the last: the first; a single one is its own next); rows that share
    a doc_id are ordered by text, null ids come first. Ids are integers, or texts of integers; others are an error. A null text is empty, and an empty text has an empty fingerprint. An
    empty table gives an empty result; other columns are not read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = with_next(docs).repartition("_range").sortWithinPartitions("_range", "_tail", "_id", "text").select("_range", "_tail", "doc_id", "text")

    def finish(rows: list, prints: list[str]) -> tuple[list, list, list, list, list, list, list]:
        """Results of all rows but the last, each with the one after it; a tail, or the last row of a range, has none."""
        done = [k for k in range(len(rows) - 1) if rows[k][1] == 0 and rows[k][0] == rows[k + 1][0]]
        changed = [edited(rows[k][3], rows[k + 1][3]) for k in done]
        marks = fingerprints([code_points(t) for t in changed])
        return (
            [rows[k][2] for k in done], [len(rows[k][3]) for k in done], [hashlib.sha256(t.encode()).hexdigest() for t in changed], [prints[k] for k in done], marks,
            [likeness(prints[k], m) for k, m in zip(done, marks, strict=True)], [likeness(prints[k], prints[k + 1]) for k in done],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, prints, size = [], [], 0

        def flush():
            nonlocal rows, prints, size
            prints = prints + fingerprints([code_points(r[3]) for r in rows[len(prints) :]])
            result = finish(rows, prints)
            rows, prints, size = rows[-1:], prints[-1:], 0
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(result[0], id_type), *[pa.array(c, t) for c, t in zip(result[1:], types, strict=True)]], names)

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(2).type
            for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), (x.as_py() for x in batch.column(3)), strict=True):
                rows.append(r)
                size += len(r[3])
                if size >= CHUNK:
                    yield flush()
        if rows:
            yield flush()

    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def walked_alike(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """Between 0 and 1: the share of all steps of the walks of both texts (arrays of code points) at which both wrote the same
    character. Both walks go on together, so nothing of them is stored. Two empty texts are alike."""
    moves = tables()[0]
    spans, owner, base = [], [], 0
    for k, (a, b) in enumerate(pairs):
        for at in range(0, max(len(a), len(b)), BLOCK):
            low = [base + min(at, len(a)), base + len(a) + min(at, len(b))]
            spans.append(low + [base + min(at + BLOCK, len(a)), base + len(a) + min(at + BLOCK, len(b))])
            owner.append(k)
        base += len(a) + len(b)
    same, total = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    codes = np.concatenate([*[t for pair in pairs for t in pair], np.zeros(1, np.uint32)])
    classes = ((codes ^ (codes >> np.uint32(8))) & np.uint32(255)).astype(np.uint8)
    ends = np.array(spans, np.int64).reshape(-1, 4).T
    pointer, end, row = ends[:2].copy(), ends[2:], np.arange(len(owner))
    for j in range(STEPS):
        on = pointer < end
        if j % 64 == 0:
            some = on.any(axis=0)
            pointer, end, row, on = pointer[:, some], end[:, some], row[some], on[:, some]
            if not len(row):
                break
        own = codes.take(pointer)
        same[row] += on[0] & on[1] & (own[0] == own[1])
        total[row] += on[0] | on[1]
        pointer = pointer + moves[j].take(classes.take(pointer)) * on
    same, total = (np.bincount(owner, x, len(pairs)) if owner else np.zeros(len(pairs)) for x in (same, total))
    return [float(x / y) if y else 1.0 for x, y in zip(same, total, strict=True)]


def band_spots() -> list[list[int]]:
    """The digits of a block that each band reads: OCTAVE_BANDS inside each octave from digit BAND_FROM on, BANDS over the first of these
    together, and for short walks, which end before, OCTAVE_BANDS over the digits below."""
    rng = np.random.default_rng(11)
    pick = lambda low, high, n: [sorted(rng.choice(np.arange(low, high), BAND_SAMPLES, replace=False).tolist()) for _ in range(n)]
    spots = pick(0, BAND_FROM, OCTAVE_BANDS) + pick(BAND_FROM, 5 * SAMPLES, BANDS)
    for low in range(BAND_FROM, len(tables()[1]) - SAMPLES + 1, SAMPLES):
        spots += pick(low, low + SAMPLES, OCTAVE_BANDS)
    return spots


def band_keys(fingerprint: str, spots: list[list[int]] | None = None) -> list[str]:
    """The bands of every block that lie inside its walk. The first digits, some fifteen characters of text, are often alike in texts that
    are not; only blocks that are hardly longer are banded by them. A block shorter than a band's digits is one band as it is."""
    spots = spots or band_spots()
    out = []
    for k, block in enumerate(fingerprint.split(":")):
        own = spots[:OCTAVE_BANDS] if len(block) < 2 * BAND_FROM else spots[OCTAVE_BANDS:]
        found = [f"{k}.{b}." + "".join(block[s] for s in spot) for b, spot in enumerate(own, len(spots) - len(own)) if spot[-1] < len(block)]
        out += found or ([f"{k}.w.{block}"] if block else [])
    return out


def estimates(prints: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """likeness() of the pairs left[i], right[i] of fingerprints, many at once; each block counts by the steps that its digits stand for."""
    weights = tables()[3]
    blocks = [p.split(":") for p in prints]
    same, total = np.zeros(len(left)), np.zeros(len(left))
    for k in range(max(map(len, blocks), default=0)):
        digits = np.full((len(prints), len(weights)), 46, np.uint8)  # a dot where a walk has ended
        for row, own in enumerate(blocks):
            if k < len(own):
                code = np.frombuffer(own[k].encode(), np.uint8)
                digits[row, : len(code)] = code
        for low in range(0, len(left), 20_000):
            a, b = digits[left[low : low + 20_000]], digits[right[low : low + 20_000]]
            total[low : low + 20_000] += ((a != 46) | (b != 46)) @ weights
            same[low : low + 20_000] += ((a == b) & (a != 46)) @ weights
    return np.where(total > 0, np.maximum(0.0, (same / np.maximum(total, 1e-9) - 1 / 16) * 16 / 15), 1.0)


def near(prints: DataFrame, least: float = 0.7, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, near_id, alike: pairs of documents that share a band of sampled digits, of any octave and block, and are at least so alike.
    prints has doc_id and fingerprint; empty ones and null ids are left out. alike compares the whole walks of the texts in
    docs (doc_id, text), or the fingerprints alone without docs.

    Documents with equal fingerprints are compared with the least of them and stand for one from then on. Each bucket is compared with its
    least doc_id; then all members that links have left apart are compared with each other, fingerprints first and by blocks. So any
    two alike documents of a bucket are a pair or joined by a chain of pairs, and n copies make about n pairs. A pair whose
    fingerprints are less alike than `least` by more than MARGIN is not verified, so texts are fetched for pairs that are likely alike only;
    a bucket of n documents that are not costs n^2 / 512 copies of fingerprints."""
    known = prints.filter("doc_id is not null and fingerprint <> ''").select("doc_id", "fingerprint")
    kind, whole, spots = prints.schema["doc_id"].dataType.simpleString(), docs is not None, band_spots()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([band_keys(x, spots) for x in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["doc_id", "keys"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            if not whole:
                alike = [likeness(a.as_py(), b.as_py()) for a, b in pairs]
            else:
                alike, some, size = [], [], 0
                for a, b in pairs:
                    some.append((code_points(a.as_py()), code_points(b.as_py())))
                    size += len(some[-1][0]) + len(some[-1][1])
                    if size >= CHUNK:
                        alike, some, size = alike + walked_alike(some), [], 0
                alike += walked_alike(some)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.float64())], ["doc_id", "near_id", "alike"])

    source = known.withColumnRenamed("fingerprint", "_own") if docs is None else docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_own"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(source, "doc_id").join(source.select(F.col("doc_id").alias("near_id"), F.col("_own").alias("_other")), "near_id")
        found = both.select("doc_id", "near_id", "_own", "_other").mapInArrow(judged, f"doc_id {kind}, near_id {kind}, alike double")
        return stash(found.filter(F.col("alike") >= least), "edit-links")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            prints = batch.column(2).to_pylist() + batch.column(3).to_pylist()
            good = pa.array(estimates(prints, np.arange(n), np.arange(n) + n) >= least - MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["doc_id", "near_id"])

    pair, print_of = f"doc_id {kind}, near_id {kind}", lambda n: known.select(F.col("doc_id").alias(n), F.col("fingerprint").alias(f"_p_{n}"))
    known = stash(known, "edit-prints")
    reps = stash(known.groupBy("fingerprint").agg(F.min("doc_id").alias("near_id")), "edit-reps")
    same = known.join(reps, "fingerprint").filter("doc_id <> near_id").select("doc_id", "near_id").distinct()
    ones = stash(reps.select(F.col("near_id").alias("doc_id"), "fingerprint"), "edit-ones")
    banded = ones.mapInArrow(keys, f"doc_id {kind}, keys array<string>").select("doc_id", F.explode("keys").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("doc_id").alias("near_id"), F.max("doc_id").alias("_high")).filter("near_id < _high").drop("_high")
    banded = stash(banded.join(hubs, "band").distinct(), "edit-bands")
    tried = stash(banded.filter("doc_id <> near_id").select("doc_id", "near_id").distinct(), "edit-tried")
    hopeful = tried.join(print_of("doc_id"), "doc_id").join(print_of("near_id"), "near_id").select("doc_id", "near_id", "_p_doc_id", "_p_near_id").mapInArrow(likely, pair)
    links = verified(stash(hopeful.unionByName(same).distinct(), "edit-pairs"))
    comps = components(links.select(F.col("doc_id").alias("a"), F.col("near_id").alias("b")))
    held = banded.select(F.col("doc_id").alias("rep"), "band").join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    apart = held.groupBy("band").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low < _high").select("band")
    rows = in_blocks(stash(held.join(apart, "band"), "edit-apart"), "band").join(known.withColumnRenamed("doc_id", "rep"), "rep")

    def met(table: pa.Table) -> pa.Table:
        block, comp = table.column("block").to_numpy(), table.column("comp").to_pylist()
        comp = np.unique(np.array(comp, dtype=object), return_inverse=True)[1]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.meshgrid(np.flatnonzero(block == i), np.flatnonzero(block == j), indexing="ij")
        left, right = left.ravel(), right.ravel()
        keep = (comp[left] != comp[right]) & ((i != j) | (left < right))
        left, right = left[keep], right[keep]
        good = estimates(table.column("fingerprint").to_pylist(), left, right) >= least - MARGIN
        ids = table.column("rep").to_pylist()
        both = [(ids[x], ids[y]) for x, y in zip(left[good], right[good], strict=True)]
        of = table.schema.field("rep").type
        return pa.table({"doc_id": pa.array([max(p) for p in both], of), "near_id": pa.array([min(p) for p in both], of)})

    wanted = ["band", "i", "j", "block", "rep", "comp", "fingerprint"]
    fresh = stash(rows.select(*wanted).groupBy("band", "i", "j").applyInArrow(met, pair).distinct(), "edit-met")
    return links.unionByName(verified(stash(fresh.join(tried, ["doc_id", "near_id"], "left_anti"), "edit-pairs")))
