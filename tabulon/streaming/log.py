"""The event log as a table: appended by a stream, read from any place on, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .events import sequence_stream

LOG = "workspace_id string, event_id long, type string, payload string, seq long"
REPLAY = 2000


def append_log(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A stream of events (workspace_id, event_id, type, payload), numbered by workspace without gaps, into the log.

    Numbers and offsets are committed together, and the log lists its files by micro-batch, so a restart repeats and loses nothing.
    """
    numbered = sequence_stream(events, "workspace_id").select("workspace_id", "event_id", "type", "payload", "seq")
    return numbered.writeStream.format("parquet").partitionBy("workspace_id").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def replay(spark: SparkSession, path: str, workspace_id: str, after: int, most: int = REPLAY) -> DataFrame:
    """The next events of a workspace after `after`, in order, at most `most`; both conditions reach the scan. A reader that gets `most` asks again."""
    rows = spark.read.schema(LOG).parquet(path).where((F.col("workspace_id") == workspace_id) & (F.col("seq") > after))
    return rows.orderBy("seq").limit(most)


def follow(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The log as a stream: first what is there, then what comes, each event once."""
    reader = spark.readStream.schema(LOG)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
