"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import numbered
from .common import stash

#: Rows that one task numbers, about.
BLOCK_ROWS = 20_000
#: Ranks of items of one size that share a join key with the bins they go to.
CHUNK = 64
#: A group with more than one in so many of all rows meets its place by broadcast; there are fewer such groups than this.
HOT = 1000


class CapacityTree:
    """Bins by remaining capacity in a balanced (AVL) tree; tightest() finds the least capacity that still fits."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(n):
        return n[4] if n else 0

    @classmethod
    def _node(cls, key, left, right):
        return (key, left, right, None, 1 + max(cls._height(left), cls._height(right)))

    @classmethod
    def _balance(cls, key, left, right):
        if cls._height(left) > cls._height(right) + 1:
            if cls._height(left[1]) < cls._height(left[2]):
                mid = left[2]
                left = cls._node(mid[0], cls._node(left[0], left[1], mid[1]), mid[2])
            return cls._node(left[0], left[1], cls._node(key, left[2], right))
        if cls._height(right) > cls._height(left) + 1:
            if cls._height(right[2]) < cls._height(right[1]):
                mid = right[1]
                right = cls._node(mid[0], mid[1], cls._node(right[0], mid[2], right[2]))
            return cls._node(right[0], cls._node(key, left, right[1]), right[2])
        return cls._node(key, left, right)

    def add(self, remaining: int, bin_id: int) -> None:
        def put(n):
            if n is None:
                return self._node((remaining, bin_id), None, None)
            if (remaining, bin_id) < n[0]:
                return self._balance(n[0], put(n[1]), n[2])
            return self._balance(n[0], n[1], put(n[2]))

        self.root = put(self.root)

    def remove(self, remaining: int, bin_id: int) -> None:
        def least(n):
            while n[1]:
                n = n[1]
            return n[0]

        def cut(n, key):
            if key < n[0]:
                return self._balance(n[0], cut(n[1], key), n[2])
            if key > n[0]:
                return self._balance(n[0], n[1], cut(n[2], key))
            if not n[1] or not n[2]:
                return n[1] or n[2]
            after = least(n[2])
            return self._balance(after, n[1], cut(n[2], after))

        self.root = cut(self.root, (remaining, bin_id))

    def tightest(self, size: int) -> tuple[int, int] | None:
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                best, n = n[0], n[1]
            else:
                n = n[2]
        return best


def best_fit_decreasing(sizes: dict[int, int], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Places items, given as the number of items of each size: runs (size, first, end, bin) of the items of a size, numbered from
    0, in order. None if more than `most` bins would be needed.

    Sizes enter in descending order. Where an item enters the tightest bin that still has room for it, the next of its size
    enters the same one as long as there is room, since that bin has only become tighter; so the items of a size enter by
    runs. An item larger than the capacity gets a bin of its own."""
    tree, runs, bins = CapacityTree(), [], 0
    for size in sorted(sizes, reverse=True):
        at, count = 0, sizes[size]
        while at < count:
            if found := tree.tightest(size):
                room, bin_id = found
                tree.remove(room, bin_id)
            else:
                if most is not None and bins == most:
                    return None
                room, bin_id, bins = max(capacity, size), bins, bins + 1
            end = min(count, at + room // size)
            runs.append((size, at, end, bin_id))
            room -= (end - at) * size
            if room:
                tree.add(room, bin_id)
            at = end
    return runs


def pack_into(sizes: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """The packing of the smallest capacity (to 1 in 2^20) for which best-fit-decreasing needs at most `shards` bins."""
    total = sum(s * n for s, n in sizes.items())
    low = max(-(-total // shards), max(sizes, default=0))
    if (best := best_fit_decreasing(sizes, low, shards)) is not None:
        return best
    least = step = max(1, total >> 20)
    while (best := best_fit_decreasing(sizes, low + step, shards)) is None:
        step *= 2
    low, high = low + step // 2, low + step
    while high - low > least:
        mid = (low + high) // 2
        if (found := best_fit_decreasing(sizes, mid, shards)) is None:
            low = mid
        else:
            high, best = mid, found
    return best


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and the group (digest of the text) of each row. A null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("_group"),
    )


def in_blocks(rows: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """rows with _block: a hash of the keys, for about BLOCK_ROWS rows a block if one value of what is numbered had all n."""
    return rows.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(1 + n // BLOCK_ROWS)))


def placed(items: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """items (_key, _bytes and what else they have) with the shard of their run. Items of one size are numbered by blocks; numbers
    and runs meet by chunks of CHUNK numbers, so that a size of many items and a size in many bins both spread."""
    ranked = numbered(in_blocks(items, n, "_key"), ["_bytes"], ["_key"], "_n").withColumn("_n", F.col("_n") - 1)
    ranked = ranked.withColumn("_chunk", F.floor(F.col("_n") / CHUNK)).drop("_block")
    chunks = F.sequence(F.floor(F.col("first") / CHUNK), F.floor((F.col("end") - 1) / CHUNK))
    cut = runs.select(F.col("size").alias("_bytes"), "first", "end", "shard", F.explode(chunks).alias("_chunk"))
    met = ranked.join(cut, ["_bytes", "_chunk"]).filter((F.col("_n") >= F.col("first")) & (F.col("_n") < F.col("end")))
    return met.drop("_chunk", "_n", "first", "end")


def shard(docs: DataFrame, shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """Puts every row into a shard by size in bytes and numbers the rows of each shard from 0 without gaps.

    Groups (equal texts) are indivisible. They enter in descending size the bin whose remaining capacity is the tightest
    that fits. With `capacity` the number of shards is what best-fit-decreasing needs, and no shard is above the capacity but
    one that holds a single row larger than that; with `shards` the capacity is the smallest for which it needs no more than
    that. Only a group that no shard can hold, as it is above the capacity or above an even share, enters row by row.

    The driver packs numbers of items by size: distinct sizes add up to no more than the total T, so there are fewer than
    sqrt(2 T) of them, and runs are fewer than sizes and bins. Which group is the how-manieth of its size, and so in which
    bin, is found on the executors. A null or empty text has size 1; repeated rows are rows of their own; doc_id may be of
    any type; an empty table gives an empty result; other columns of docs are not read.
    """
    spark = docs.sparkSession
    rows = stash(measured(docs), "shard-sizes")
    groups = stash(rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count("size").alias("_rows")), "shard-groups")
    total, n, n_groups = groups.agg(F.sum("_bytes"), F.sum("_rows"), F.count("_rows")).first()
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    share = capacity or -(-total // shards)
    whole, above = groups.filter(F.col("_bytes") <= share), groups.filter(F.col("_bytes") > share)
    single = F.col("_bytes") / F.col("_rows")  # rows of a group are of one size
    counted = whole.groupBy("_bytes").agg(F.count("_rows").alias("n")).unionByName(above.groupBy(single.cast("long").alias("_bytes")).agg(F.sum("_rows").alias("n")))
    sizes = {r["_bytes"]: r["n"] for r in counted.groupBy("_bytes").agg(F.sum("n").alias("n")).collect()}
    packed = best_fit_decreasing(sizes, share) if capacity else pack_into(sizes, shards)
    runs = stash(spark.createDataFrame(packed, "size long, first long, end long, shard int"), "shard-runs")
    # hot groups, of which there are few, meet their rows by broadcast; no other group has many rows
    hot = F.col("_rows") * HOT > n
    kind = F.when(F.col("_bytes") > share, "above").otherwise("whole")
    marked = rows.join(F.broadcast(groups.filter(hot).select("_group", kind.alias("_kind"))), "_group", "left")
    own = ["doc_id", "size", "text_crc32"]
    alone = marked.filter("_kind = 'above'").select("_group", *own)
    if (seldom := above.filter(~hot)).limit(1).count():
        alone = alone.unionByName(marked.filter("_kind is null").join(seldom.select("_group"), "_group").select("_group", *own))
    # one numbering for all items: rows of groups that are too large, and groups
    items = alone.select(F.col("size").alias("_bytes"), F.concat("_group", F.unhex(F.md5(F.concat_ws(":", "doc_id", "text_crc32").cast("binary")))).alias("_key"), F.struct(*own).alias("_row"))
    items = items.unionByName(whole.select("_bytes", F.col("_group").alias("_key")), allowMissingColumns=True)
    found = stash(placed(items, runs, n_groups + n if above.limit(1).count() else n_groups), "shard-places")
    places = found.filter("_row is null").select(F.col("_key").alias("_group"), "shard")
    hot_places = F.broadcast(groups.filter(hot).select("_group").join(places, "_group"))
    out = found.filter("_row is not null").select("_row.*", "shard")
    out = out.unionByName(marked.filter("_kind = 'whole'").join(hot_places, "_group").select(*own, "shard"))
    out = out.unionByName(marked.filter("_kind is null").join(places, "_group").select(*own, "shard"))
    bins = max(r[3] for r in packed) + 1
    order = ["doc_id", "text_crc32", "size"]
    slots = numbered(in_blocks(stash(out, "shard-rows"), n // bins, *order), ["shard"], order, "slot")
    return slots.select(*own, F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
