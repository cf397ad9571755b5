"""Continuous consolidation: result files as a stream, each batch converted as it arrives.

A path that comes again within the watermark is dropped by state, and state older than that is
forgotten, so it stays as small as what arrives in that time. A batch has a bounded number of files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Files in one batch at most: a batch's list of paths is small.
MOST_FILES = 1_000


def stream_sources(spark: SparkSession, folder: str, pattern: str = "*", most_files: int = MOST_FILES, oldest: str | None = None) -> DataFrame:
    """New files of a folder as ``path, modificationTime, length, content``, ``most_files`` at a time.

    ``oldest`` (such as ``30d``) lets the source forget files of that age, as Spark's ``maxFileAge`` does.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    reader = reader.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most_files)
    return (reader.option("maxFileAge", oldest) if oldest else reader).load(folder)


def first_arrivals(stream: DataFrame, repeats_within: str = "1 day", identity: tuple[str, ...] = ("path",)) -> DataFrame:
    """Rows whose identity hasn't come before within ``repeats_within`` of their modification times.

    What comes later than that after the newest row seen is told as new again, and its state is gone by then; the first of
    an identity's rows in a batch stays. Null identities equal each other.
    """
    held = stream.withWatermark("modificationTime", repeats_within)
    return held.dropDuplicatesWithinWatermark(list(identity))


def consolidate(stream: DataFrame, convert_paths: Callable[[list[str], int], None], checkpoint: str, repeats_within: str = "1 day", most_files: int = MOST_FILES) -> StreamingQuery:
    """Convert what has arrived, batch by batch; a path that comes again is dropped by state.

    ``convert_paths`` gets a batch's paths, at most ``most_files`` at a time, and the batch's number: writing under that number
    makes a repeated batch harmless. After a restart from ``checkpoint`` finished batches don't come again.
    """
    fresh = first_arrivals(stream.select("path", "modificationTime"), repeats_within).select("path")

    def each(batch: DataFrame, number: int) -> None:
        held: list[str] = []
        for row in batch.sort("path").toLocalIterator():
            held.append(row["path"])
            if len(held) == most_files:
                convert_paths(held, number)
                held = []
        if held:
            convert_paths(held, number)

    return fresh.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
