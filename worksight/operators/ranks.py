"""Order statistics of groups of any size. Rows become counts of distinct values; these are summed up in ranges of values, so
neither a group nor its distinct values meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import in_ranges, lookup, running, stash

#: Bytes that a group takes in a broadcast, with its statistics.
GROUP_BYTES = 400


def counted(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, value, c (rows of the group with that value), cum (rows up to and with it). A null value is none."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    return running(in_ranges(counts, [*keys, value], parts, name), keys, [value], "c", "cum").drop("_block")


def members(counts: DataFrame, keys: list[str], least: int, name: str) -> tuple[DataFrame, int]:
    """keys, members of the groups with `least` rows or more, and the bytes of that table."""
    sizes = stash(counts.groupBy(*keys).agg(F.sum("c").alias("members")).filter(F.col("members") >= least), name)
    return sizes, GROUP_BYTES * sizes.count()


def nth(counts: DataFrame, sizes: tuple[DataFrame, int], keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """keys, members, and for each of `places` (functions of members, from 0) the value that stands there in the sorted group:
    one aggregate that is combined before it is shuffled. Joined as a broadcast while the groups are few."""
    groups, size = sizes
    here = lambda k: F.max(F.when((F.col("cum") > k) & (F.col("cum") - F.col("c") <= k), F.col(value)))
    found = counts.join(lookup(groups, size), keys).groupBy(*keys).agg(F.max("members").alias("members"), *[here(k).alias(n) for n, k in places.items()])
    return lookup(found, size)
