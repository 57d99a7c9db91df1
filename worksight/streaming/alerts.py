"""Progress-gap signals and category findings over works that arrive as a stream, for the digest of a role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import compliance_signals, progress_gap


def alerts(works: DataFrame) -> DataFrame:
    """The signals of a (streaming or static) table of works that need no other works."""
    return progress_gap(works).unionByName(compliance_signals(works))


def start(works: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the alerts of new works to a Parquet table; the checkpoint makes it resume where it stopped."""
    return alerts(works).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
