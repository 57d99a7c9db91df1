"""The digest of a role over signals that arrive as a stream: its watermark moves once a batch, and a batch that is replayed changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reporting import rank_of
from ..schemas import DIGEST_FLOOR, SEVERITY_RANK
from ..tables import _file_system

STATE = "batch long, last_seen_seq long, cutoff timestamp"


def watermark(spark: SparkSession, path: str, role: str, before: int | None = None) -> tuple[int, object]:
    """last_seen_seq and cutoff of the role after all batches, or after those before a batch: (0, None) at the start. A row a batch."""
    where = f"{path}/state/role={role}"
    fs, folder = _file_system(spark, where)
    if not fs.exists(folder):
        return 0, None
    rows = spark.read.schema(STATE).option("recursiveFileLookup", "true").parquet(where)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    last = rows.agg(F.max_by(F.struct("last_seen_seq", "cutoff"), "batch").alias("s")).first()["s"]
    return (last["last_seen_seq"], last["cutoff"]) if last else (0, None)


def acknowledge(batch: DataFrame, batch_id: int, role: str, path: str) -> None:
    """Writes the alerts of a batch of signals (project_id, signal_type, severity, triggered, title, created_at) for the role, and its watermark after them.

    Alerts are the triggered signals after the role's cutoff with the severity that its digests begin at; the cutoff moves to the
    latest triggered signal, and last_seen_seq by the number of those that are new. Both are written under the batch's number and are made of the batch and the
    state before it alone, so that writing them again, after a failure in between, gives the same."""
    spark = batch.sparkSession
    seq, cutoff = watermark(spark, path, role, batch_id)
    new = batch.filter("triggered")
    if cutoff is not None:
        new = new.filter(F.col("created_at") > F.lit(cutoff))
    floor = SEVERITY_RANK[DIGEST_FLOOR.get(role, "CRITICAL")]
    alerts = new.filter(rank_of(F.col("severity"), SEVERITY_RANK, 0) >= floor).select("project_id", "signal_type", "severity", "title", "created_at")
    alerts.write.mode("overwrite").parquet(f"{path}/alerts/role={role}/batch={batch_id}")
    moved = new.agg(F.lit(batch_id).cast("long").alias("batch"), (F.lit(seq) + F.count(F.lit(1))).cast("long").alias("last_seen_seq"), F.coalesce(F.max("created_at"), F.lit(cutoff).cast("timestamp")).alias("cutoff"))
    moved.write.mode("overwrite").parquet(f"{path}/state/role={role}/{batch_id}")


def start(signals: DataFrame, role: str, path: str, checkpoint: str) -> StreamingQuery:
    """Moves the role's digest on with each batch of a stream of signals; the checkpoint makes it resume where it stopped."""
    return signals.writeStream.foreachBatch(lambda batch, n: acknowledge(batch, n, role, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
