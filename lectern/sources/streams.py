"""Stream sources, topic replay and query start."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

BATCH_INTERVAL = "3 seconds"
REPLAY_PARTITIONS = 10


def kafka_lines(spark: SparkSession, servers: str, topic: str, max_per_trigger: int | None = None,
                starting: str = "earliest") -> DataFrame:
    """Topic as ``value`` text plus ``topic`` and broker ``timestamp``.

    The first start begins at ``starting``; later starts go on from the query's checkpoint.
    """
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", starting))
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"), "topic", "timestamp")


def file_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A watched directory of text files as ``value`` lines."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def replay_to_dir(lines: DataFrame, path: str, files: int = REPLAY_PARTITIONS) -> None:
    """Publish log lines as ``files`` text files for a watched directory."""
    lines.select(F.col("value").cast("string")).repartition(files).write.mode("append").text(path)


def replay_to_topic(lines: DataFrame, servers: str, topic: str, partitions: int = REPLAY_PARTITIONS) -> None:
    """Publish log lines to a topic."""
    (lines.select(F.col("value").cast("string")).repartition(partitions).write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """What names the run that ``checkpoint`` holds the positions of; a new checkpoint is a new run."""
    sc = spark.sparkContext
    marker = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/_run")
    fs = marker.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(marker):
        stream = fs.create(marker, False)
        stream.writeBytes(uuid.uuid4().hex)
        stream.close()
    stream = fs.open(marker)
    try:
        return sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def start(writer: DataStreamWriter, checkpoint: str, available_now: bool = False,
          interval: str = BATCH_INTERVAL) -> StreamingQuery:
    """Start with a checkpoint; ``available_now`` drains what is there and stops."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
