"""What the corpus operators share: table access, tables written to the shared folder, exact lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_dir, stash  # noqa: F401
from ..tasks import ship  # noqa: F401

#: Lookup tables up to this many bytes are broadcast; a broadcast row takes some ten times its text in memory.
BROADCAST_BYTES = 24 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lookup(df: DataFrame, size: int) -> DataFrame:
    """df as the small side of a join: broadcast if its `size` (bytes, as counted) is within BROADCAST_BYTES, else left to a shuffle join."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with other names for its columns that begin with `_`, as the operators' own do, and what these were called."""
    names = {c: f"own {c}" for c in docs.columns if c.startswith("_")}
    return docs.withColumnsRenamed(names) if names else docs, {n: c for c, n in names.items()}


def az_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))
