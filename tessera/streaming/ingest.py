"""Streaming ingest: new text files are indexed as they arrive. The checkpoint takes the place of a resume table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.config import Settings
from tessera.operators.dense import Embed
from tessera.plans.engine import ingest
from tessera.sources.files import text_documents
from tessera.sources.store import Store

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_ingest(spark: SparkSession, folder: str, store: Store, checkpoint: str, embed: Embed, settings: Settings = Settings(), files_per_batch: int = 1000, once: bool = False) -> StreamingQuery:
    """Index txt files of folder; a batch that is run again changes nothing, since ids come from the contents."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.txt").load(folder)
    raw = found.select(F.col("path").alias("source_uri"), F.lit("txt").alias("source_type"), F.sha2("content", 256).alias("content_hash"), "content")

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            ingest(store, text_documents(df), embed, settings)

    writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
