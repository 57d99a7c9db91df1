"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_kept: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where there are no other machines, a
    session that names none gets a temporary one; on a cluster that is an error, as each machine would write to its own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here and survives lost executors. The table goes
    when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def until_exit(spark: SparkSession, path: str) -> str:
    """The path, which goes when the application ends."""
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    return path


def _state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Newest time, number and bytes of the files at or below a path."""
    fs, where = _file_system(spark, path)
    files, newest, count, size = fs.listFiles(where, True), 0, 0, 0
    while files.hasNext():
        status = files.next()
        newest, count, size = max(newest, status.getModificationTime()), count + 1, size + status.getLen()
    return newest, count, size


def kept(spark: SparkSession, key: tuple, inputs: list[str], make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The stashed tables that make() returns, made once an application for a key and the state of its inputs: the newest time, the
    number and the length of the files inside, as a folder of an object store has neither of its own. What was lost from the shared
    folder is made again."""
    state = [(path, *_state(spark, path)) for path in inputs]
    full = (spark.sparkContext.applicationId, *key, *state)
    found = _kept.get(full)
    if found and all(_file_system(spark, p)[0].exists(_file_system(spark, p)[1]) for p, _ in found.values()):
        return {k: spark.read.schema(schema).parquet(p) for k, (p, schema) in found.items()}
    made = make()
    files = {k: df.inputFiles() for k, df in made.items()}
    if all(files.values()):
        _kept[full] = {k: (files[k][0].rsplit("/", 1)[0], df.schema) for k, df in made.items()}
    return made


#: Lookup tables up to this many bytes are broadcast; a broadcast row takes some ten times its text in memory.
BROADCAST_BYTES = 24 << 20


def lookup(df: DataFrame, size: int) -> DataFrame:
    """df as the small side of a join: broadcast if its `size` (bytes, as counted) is within BROADCAST_BYTES, else left to a shuffle join."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def in_ranges(df: DataFrame, order: list[Column | str], parts: int, name: str) -> DataFrame:
    """df with _block, as a table: the rows in `parts` ranges of the order, numbered in that order. Equal rows share a range."""
    return stash(df.repartitionByRange(parts, *order).withColumn("_block", F.spark_partition_id()), name)


def running(df: DataFrame, by: list[str], order: list[Column | str], value: str, to: str) -> DataFrame:
    """df (with _block) with `to`: the sum of `value` within each value of `by`, up to and with the row, by block and then by order.
    Blocks are summed first and offset by the sums before them, so that no task sees more than one block of a value."""
    keys = [*by, "_block"]
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).agg(F.sum(value).alias("_sum")).select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_upto", inside).join(starts, keys).withColumn(to, F.col("_start") + F.col("_upto")).drop("_upto", "_start")


def numbered(df: DataFrame, by: list[str], order: list[Column | str], to: str) -> DataFrame:
    """df (with _block) with `to`: 1, 2, ... within each value of `by`, by block and then by order. Blocks are counted first and
    offset by the sums before them, so that no task sees more than one block of a value."""
    keys = [*by, "_block"]
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", inside).join(starts, keys).withColumn(to, (F.col("_start") + F.col("_rank")).cast("long")).drop("_rank", "_start")
