"""Watching a tree of files, or a landing folder of documents: every micro-batch is one synchronisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Rows of the landing folder: a document's new content, or a null content for one that is gone.
EVENTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("at", T.TimestampType())])


def latest(batch: DataFrame) -> DataFrame:
    """(path, content): the last event of each path in a batch; of equal times the largest content counts."""
    from pyspark.sql import functions as F

    return batch.filter("path is not null").groupBy("path").agg(F.max_by("content", F.struct("at", "content")).alias("content"))


def watch(spark: SparkSession, folder: str, checkpoint: str, sync: Callable[[DataFrame, int], None], interval: str | None = "2 seconds", max_files: int = 1_000) -> StreamingQuery:
    """Follow Parquet files of ``EVENTS`` in a folder; ``sync`` gets each batch's latest states and the batch's number.

    ``sync`` must give the same result if a batch comes again, as it does when the query restarts. ``interval`` throttles; null
    takes what is there and ends.
    """
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(folder)
    writer = stream.writeStream.foreachBatch(lambda batch, number: sync(latest(batch), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def watch_tree(spark: SparkSession, checkpoint: str, sync: Callable[[], object], interval: str = "2 seconds") -> StreamingQuery:
    """Keep an index in step with the tree of its root: at every tick that finds the last one done, ``sync`` compares and updates.

    A tick that fails comes again when the query restarts; as ``sync`` compares states, it may come any number of times. Changes
    between two ticks are taken together.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda batch, number: sync() and None).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start()
