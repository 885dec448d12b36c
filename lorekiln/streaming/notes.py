"""Ingest as a stream of note files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekiln.config import Config
from lorekiln.operators.ingest import ingest
from lorekiln.session import durable
from lorekiln.sources.vault import NOTE, relative

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def note_stream(spark: SparkSession, vault_dir: str, files_per_batch: int = 1_000) -> DataFrame:
    """New note files of a vault as they appear: (path, mtime, hash, chars, size, content)."""
    raw = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(vault_dir)
    text = F.decode("content", "UTF-8")
    return raw.filter(F.col("path").rlike(NOTE)).select(
        relative(vault_dir).alias("path"), F.col("modificationTime").alias("mtime"), F.sha2(text, 256).alias("hash"), F.length(text).alias("chars"), F.col("length").alias("size"), text.alias("content")
    )


def changed_notes(notes: DataFrame, late: str = "1 hour") -> DataFrame:
    """The stream without notes whose path and hash were seen within ``late`` of event time."""
    return notes.withWatermark("mtime", late).dropDuplicatesWithinWatermark(["path", "hash"])


def notes_by_window(notes: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Notes and characters by window of modification time; late ones are counted up to ``late``."""
    return notes.withWatermark("mtime", late).groupBy(F.window("mtime", window)).agg(F.count(F.lit(1)).alias("n_notes"), F.sum("chars").alias("chars"))


def stream_ingest(spark: SparkSession, config: Config, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Ingests note files as they arrive; each micro-batch publishes one version with the rows of its files.

    The file source does not report edits of known files or deletions: a plain ``ingest`` now and then finds those.
    """

    def apply(batch: DataFrame, _: int) -> None:
        notes = batch.select("path", F.floor(F.unix_micros("mtime") / 1000).alias("mtime_ms"), "size", "content")
        ingest(spark, config, notes=durable(notes))

    writer = note_stream(spark, config.vault_dir).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()
