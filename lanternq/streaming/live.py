"""Extensions for corpora that change: files as a stream, and entries with a
time to live.  (Streams are beyond what the survey lists for parity.)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import effective
from ..sources.corpus import lines


def watch_tree(spark: SparkSession, root: str, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """A stream of new and changed files: path, content."""
    stream = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    stream = stream.option("maxFilesPerTrigger", str(files_per_batch)).load(root)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("mtime"))


def matches(stream: DataFrame, pattern: str) -> DataFrame:
    """Matching lines of files as they come in."""
    return lines(stream, keep=("path", "mtime")).filter(F.col("line").rlike(effective(pattern)))


def write_matches(stream: DataFrame, pattern: str, out: str, checkpoint: str) -> StreamingQuery:
    return matches(stream, pattern).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of an event stream (ts, event_type) in tumbling windows; late rows are waited for."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))


def live_entries(entries: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """The newest entry of each key that is not older than the time to live."""
    newest = entries.groupBy("key").agg(F.max("stored_at").alias("stored_at"))
    return newest.filter((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("stored_at")) <= ttl_seconds)
