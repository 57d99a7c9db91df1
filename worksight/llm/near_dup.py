"""Near-duplicate detection with HyperMinHash: compressed registers, banding, corrected estimates, exact verification.

A document's set are its distinct word shingles. Documents with equal sets are one class from the start. The classes'
registers are banded; a bucket links through hubs, so a bucket of n near-copies makes n pairs and not n^2; what a bucket
still holds apart after the hub rounds is compared in blocks. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, ship, stash
from .vectors import SPACES, byte_slices, hash_words, mix64, words_of

#: BANDS bands of ROWS registers. Sets with similarity 0.8 share a band with probability 1 - (1 - 0.8^5)^28 = 0.99998.
BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
#: A register: leading zeros of the bucket's least hash (6 bits) and the MANTISSA bits that follow.
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
#: Pairs whose estimate is further below the threshold than this (6 standard errors) are not verified; small sets all are.
MARGIN, SMALL = 0.2, 16
HUB_ROUNDS = 1
#: Links up to this number (16 bytes each) find their components in one task without shuffles; more do in many.
FEW_LINKS = 100_000
#: Members of a hub that one task verifies, and of a bucket that are compared with each other at once.
SALT_ROWS, BLOCK_ROWS = 256, 512
#: Shingles that one matrix product takes at once.
COLUMNS = 8192
#: Pairs up to this number are broadcast to the scan of the texts (16 bytes each); more are joined by shuffle.
BROADCAST_PAIRS = 400_000

ship(__name__)
_order = np.random.default_rng(7).random((REGISTERS, REGISTERS)).argsort(axis=1).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingles as sorted 64-bit hashes. Fewer words than width: the whole sequence is the one shingle."""
    starts, ends, first = words_of(data, offsets, SPACES)
    hashes = hash_words(data, starts, ends)
    factor = np.uint64(0xD6E8FEB86659FD93)
    rolled = hashes[: max(0, len(hashes) - width + 1)].copy()
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(1, width):
            power = power * factor
            rolled += hashes[j : j + len(rolled)] * power
        rolled = mix64(rolled + np.uint64(width))
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                power, total = np.uint64(1), hashes[a]
                for x in hashes[a + 1 : b]:
                    power = power * factor
                    total = total + x * power
                yield mix64(np.array([total + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The compressed registers of each set, a row of REGISTERS values. A bucket without elements borrows from the first of
    the others, in an order fixed for it, that has some: so few elements fill all registers, each drawn evenly."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    bucket = ((every >> np.uint64(40)) % np.uint64(REGISTERS)).astype(np.int64)
    value = mix64(every ^ np.uint64(0xA0761D6478BD642F))
    least = np.full(len(sets) * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owner * REGISTERS + bucket, value)
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62).astype(np.uint16)
    packed = (zeros << np.uint16(MANTISSA)) | np.minimum((fraction - 0.5) * (2 << MANTISSA), (1 << MANTISSA) - 1).astype(np.uint16)
    packed[least == np.iinfo(np.uint64).max] = EMPTY
    own = packed.reshape(len(sets), REGISTERS)
    out = own.copy()
    rows, cols = np.nonzero((own == EMPTY) & (own != EMPTY).any(axis=1, keepdims=True))
    for k in range(REGISTERS):
        if not len(rows):
            break
        out[rows, cols] = own[rows, _order[cols, k]]
        left = out[rows, cols] == EMPTY
        rows, cols = rows[left], cols[left]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity from rows of registers: the share of equal ones, less those equal by collision of the compressed values."""
    ratio = n_a / np.maximum(n_b, 1)
    chance = 0.169919487 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), regs: one scan of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(1)):
                sets = list(shingle_sets(data, offsets, width))
                regs = registers(sets)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                columns = [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "regs"])

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id long, n_shingles long, digest binary, regs binary")


def verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union. The texts of the documents in pairs are
    scanned again for their sets; a hub's members are dealt over tasks of SALT_ROWS, each with a copy of the hub's set."""
    pairs = stash(pairs, "near-pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("b") / SALT_ROWS).cast("int").alias("parts"))
    salted = pairs.join(parts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("member"))
    hubs = parts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    wanted = salted.unionByName(hubs).groupBy("id").agg(F.collect_list(F.struct("a", "part", "member")).alias("_to"))
    if pairs.count() <= BROADCAST_PAIRS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    source = texts.join(wanted, "id").select("id", "text", "_to")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(1)):
                found = pa.array([s.tobytes() for s in shingle_sets(data, offsets, width)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), found, batch.column(2).slice(a, b - a)], ["id", "elements", "_to"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []  # rows of one doc_id may hold several sets
        for batch in batches:
            links = []
            for key, other, member, elements in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                own = np.frombuffer(elements.as_buffer(), np.uint64)
                if not member:
                    at, hubs = key, [*(hubs if at == key else []), own]
                elif at == key:
                    for hub in filter(len, hubs):
                        both = int((hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own).sum())
                        if 100 * both >= percent * (len(hub) + len(own) - both):
                            links.append((key, other))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    made = source.mapInArrow(sets, "id long, elements binary, _to array<struct<a:bigint,part:int,member:int>>")
    dealt = made.select("id", "elements", F.explode("_to").alias("t")).select("t.a", "t.part", "id", "t.member", "elements")
    dealt = dealt.select("a", "part", "id", "member", "elements").repartition("a", "part").sortWithinPartitions("a", "part", "member")
    return stash(dealt.mapInArrow(compare, "a long, b long").distinct(), "near-links")


def components(edges: DataFrame) -> DataFrame:
    """id, comp: for every node of edges (a, b) the least node that it reaches. Large-star and small-star in turn until
    nothing changes; every round is a table in the shared folder."""

    def star(arcs: DataFrame, large: bool) -> DataFrame:
        both = arcs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        if large:
            near = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            return both.filter("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = arcs.groupBy("u").agg(F.min("v").alias("m"))
        return arcs.join(near, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v").distinct()

    def state(arcs: DataFrame):
        return tuple(arcs.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    arcs = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "near-arcs")
    before = state(arcs)
    # one partition is clustered by any key already, so the rounds over few arcs need no exchange
    gathered = (lambda x: x.coalesce(1)) if before[0] <= FEW_LINKS else (lambda x: x)
    arcs = gathered(arcs)
    while before[0]:
        arcs = gathered(stash(star(star(arcs, True), False), "near-arcs"))
        if (now := state(arcs)) == before:
            break
        before = now
    return arcs.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("comp")), F.struct(F.col("v").alias("id"), F.col("v").alias("comp")))).alias("e")).select("e.id", "e.comp").groupBy("id").agg(F.min("comp").alias("comp"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    width: words of a shingle; percent: 100 * intersection >= percent * union links two documents. component_id is the
    least doc_id that links lead to; kept marks that document. Null, empty and blank texts have no shingles and are linked
    with nothing. A null doc_id can't be linked: its row has a null component and is kept. Rows that share a doc_id are
    one document and have one component. Ids are integers, or texts of integers; others are an error. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    sig = stash(sketches(docs, width), "near-sketches")
    sized = sig.filter("digest is not null and doc_id is not null")
    classes = stash(sized.groupBy("digest").agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = sized.join(classes, (sized["digest"] == classes["digest"]) & (sized["doc_id"] == classes["rep"])).select("rep", F.col("n_shingles").alias("n"), "regs", classes["digest"])
    reps = stash(reps.dropDuplicates(["digest"]).drop("digest"), "near-reps")  # a rep whose rows hold different sets has a row for each
    # rows of one doc_id with different sets: those sets belong together
    same = sized.join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    twice = reps.groupBy("rep").count().filter("count > 1").limit(1).count() > 0
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("regs", b * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    banded = reps.select("rep", "n", F.explode(bands).alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("key")
    buckets = stash(banded.join(shared, "key"), "near-buckets")
    links = stash(same if twice else same.limit(0), "near-links")
    comps = None
    sizes_fit = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    for k in range(HUB_ROUNDS + 1):
        held = buckets if comps is None else buckets.join(comps.withColumnRenamed("id", "rep"), "rep", "left")
        held = held.withColumn("comp", F.col("rep") if comps is None else F.coalesce("comp", "rep"))
        if k < HUB_ROUNDS:
            hub = F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("_p"), F.col("rep").alias("a"), F.col("n").alias("m"), F.col("comp").alias("_c"))).alias("hub")
            hubs = held.groupBy("key").agg(hub, F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key", "hub.*")
            pairs = held.join(hubs, "key").filter((F.col("comp") != F.col("_c")) & sizes_fit).select("a", "m", F.col("rep").alias("b"), "n").distinct()
            pairs = likely(pairs, reps, percent)
            fresh = verified(docs, pairs, width, percent)
        else:
            fresh = left_apart(docs, held, reps, width, percent)
        links = links.unionByName(fresh)
        if k < HUB_ROUNDS or fresh.limit(1).count():
            comps = stash(components(links), "near-comps")
    own = sig.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id")).alias("component_id")
    return own.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose corrected estimate is not clearly below the threshold."""
    first = reps.select(F.col("rep").alias("a"), F.col("n").alias("m"), F.col("regs").alias("regs_a"))
    second = reps.select(F.col("rep").alias("b"), "n", F.col("regs").alias("regs_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, n_a, n_b = (batch.column(k).to_numpy() for k in range(4))
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
                good = (estimate(left, right, n_a, n_b) >= percent / 100 - MARGIN) | (np.minimum(n_a, n_b) <= SMALL)
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    joined = pairs.join(first, ["a", "m"]).join(second, ["b", "n"]).select("a", "b", "m", "n", "regs_a", "regs_b")
    return joined.mapInArrow(run, "a long, b long")


def linkable(docs: DataFrame, held: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of held, and the sets of their documents, in buckets that still hold different components, whose documents can have a link at all: enough of
    their shingles occur in another document that is still apart. (A document shares no more with another than it shares
    with all of them, and a union is no smaller than the document.) Exact, and linear in the shingles."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(1)):
                found = [s.view(np.int64) for s in shingle_sets(data, offsets, width)]
                digest = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digest, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["rep", "own", "elements"])

    def apart(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key"), "key")

    held = stash(apart(held), "near-apart")
    ids = stash(held.select("rep").distinct(), "near-apart-ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_PAIRS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(side, "rep").select("rep", "text")
    # rows of one doc_id may hold several sets, so what is counted is counted by set
    elements = stash(texts.mapInArrow(sets, "rep long, own long, elements array<bigint>").filter(F.size("elements") > 0), "near-apart-sets")
    each = elements.select("rep", "own", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    shared = each.groupBy("e").agg(F.count("rep").alias("c")).filter("c > 1").select("e")
    enough = each.join(shared, "e").groupBy("rep", "own").agg(F.count("e").alias("m"), F.max("n").alias("n")).filter(F.col("m") * 100 >= F.col("n") * percent)
    held = stash(apart(held.join(enough.select("rep").distinct(), "rep", "left_semi")), "near-apart")
    return held, elements.drop("own")


def merged(labels: np.ndarray, x: int, others: np.ndarray) -> None:
    """Gives x and the others, with all that have their labels, one label: the least."""
    own = np.unique(np.append(labels[others], labels[x]))
    labels[np.isin(labels, own)] = own[0]


def in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """rows with i, j: a key's rows are cut into blocks of about BLOCK_ROWS by rep, and each two blocks meet as (key, i, j)."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("rep") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")


def left_apart(docs: DataFrame, held: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between members of one bucket that the hub rounds left in different components, as far as components need them.

    Estimates within the buckets gather what may be linked into families. In each family every two sets are intersected, by
    block: a product of the blocks' incidence matrices over the shingles that they share. Neither step hands on all its
    pairs, only those that join what was apart in its block."""
    held, elements = linkable(docs, held, width, percent)
    rows = in_blocks(held.join(reps, ["rep", "n"]).select("key", "rep", "n", "comp", "regs"), "key")

    def alike(table: pa.Table) -> pa.Table:
        rep, n, comp, block = (table.column(c).to_numpy() for c in ("rep", "n", "comp", "block"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        i, j, labels = table.column("i")[0].as_py(), table.column("j")[0].as_py(), np.arange(len(rep))
        right = np.flatnonzero(block == j)
        for x in np.flatnonzero(block == i):
            y = right[(comp[right] != comp[x]) & (labels[right] != labels[x]) & (n[right] * 100 >= n[x] * percent) & (n[x] * 100 >= n[right] * percent)]
            if len(y):
                good = (estimate(regs[x], regs[y], n[x], n[y]) >= percent / 100 - MARGIN) | (np.minimum(n[x], n[y]) <= SMALL)
                if good.any():
                    merged(labels, x, y[good])
        joined = np.flatnonzero(labels != np.arange(len(rep)))
        return pa.table({"a": pa.array(rep[labels[joined]], pa.int64()), "b": pa.array(rep[joined], pa.int64())})

    wanted = ["key", "i", "j", "block", "rep", "n", "comp", "regs"]
    families = stash(components(stash(rows.select(*wanted).groupBy("key", "i", "j").applyInArrow(alike, "a long, b long").distinct(), "near-alike")), "near-families")
    comps = held.select("rep", "comp").distinct()
    members = elements.join(families.select(F.col("id").alias("rep"), F.col("comp").alias("family")), "rep").join(comps, "rep")

    def exact(table: pa.Table) -> pa.Table:
        rep, comp, block = (table.column(c).to_numpy() for c in ("rep", "comp", "block"))
        i, j, labels = table.column("i")[0].as_py(), table.column("j")[0].as_py(), np.arange(len(rep))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        lists = table.column("elements").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        _, place, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
        owner = np.repeat(np.arange(len(rep)), size)[column >= 0]
        column = column[column >= 0]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            there = np.zeros((len(rep), COLUMNS), np.float32)
            there[owner[a:b], column[a:b] - low] = 1
            both += there[left] @ there[right].T
        linked = (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (comp[left][:, None] != comp[right][None, :])
        for k, x in enumerate(left):
            if linked[k].any():
                merged(labels, x, right[linked[k]])
        joined = np.flatnonzero(labels != np.arange(len(rep)))
        return pa.table({"a": pa.array(rep[labels[joined]], pa.int64()), "b": pa.array(rep[joined], pa.int64())})

    blocks = in_blocks(members, "family").select("family", "i", "j", "block", "rep", "comp", "elements")
    return stash(blocks.groupBy("family", "i", "j").applyInArrow(exact, "a long, b long").distinct(), "near-links")


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates (the least doc_id). Columns stay as they are."""
    kept = near_duplicates(docs, width, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti").select(*docs.columns)
