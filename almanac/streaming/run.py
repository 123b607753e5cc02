"""Running a stream over the files present and handing back its result as a batch table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import new_path


def replay(stream: DataFrame, path: str | None = None, checkpoint: str | None = None, reader: SparkSession | None = None, polled: bool = False) -> DataFrame:
    """Process everything available through a checkpointed parquet sink, then read the sink.

    The file sink's log makes the output exactly-once; with the same ``path`` and ``checkpoint``
    a later run goes on where this one ended.  ``reader`` is the session that reads the result, where it
    is not the stream's own.  A ``polled`` source hands on a part per batch, so it is asked until it has no more.
    """
    spark = reader or stream.sparkSession
    path, checkpoint = path or new_path(spark, "stream-out"), checkpoint or new_path(spark, "stream-checkpoint")
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    q = (w.trigger(processingTime="0 seconds") if polled else w.trigger(availableNow=True)).start()
    if polled:
        q.processAllAvailable()
        q.stop()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
