"""Catalogue queries and set differences that decide what work is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_documents(documents: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document with its live chunks, newest first where there is a created_at."""
    counts = chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("live_chunks"))
    out = documents.join(counts, id_col, "left").withColumn("live_chunks", F.coalesce("live_chunks", F.lit(0)))
    return out.orderBy(F.desc("created_at")) if "created_at" in documents.columns else out


def document(documents: DataFrame, doc_id: object, id_col: str = "doc_id") -> DataFrame:
    return documents.where(F.col(id_col) == F.lit(doc_id))


def sample_chunks(chunks: DataFrame, doc_id: object, limit: int = 10, id_col: str = "doc_id") -> DataFrame:
    """The first chunks of a document, their text cut to 300 characters."""
    own = document(chunks, doc_id, id_col).select("chunk_index", F.substring("content", 1, 300).alias("content"))
    return own.orderBy("chunk_index").limit(limit)


def ordered_chunks(chunks: DataFrame, doc_id: object, id_col: str = "doc_id") -> DataFrame:
    return document(chunks, doc_id, id_col).orderBy("chunk_index")


def ready_by_hash(documents: DataFrame, content_hash: str) -> DataFrame:
    return documents.where((F.col("content_hash") == content_hash) & (F.col("status") == "ready"))


def partial_by_hash(documents: DataFrame, chunks: DataFrame, indexed: DataFrame, content_hash: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """The newest unfinished document for each content hash, with its stored and indexed chunks."""
    live = documents.where("status = 'processing'")
    if content_hash is not None:
        live = live.where(F.col("content_hash") == content_hash)
    newest = live.groupBy("content_hash").agg(F.max_by(id_col, F.struct("created_at", id_col)).alias(id_col))
    stored = chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("chunk_count"))
    done = indexed.groupBy(id_col).agg(F.count(F.lit(1)).alias("indexed_count"))
    out = newest.join(stored, id_col, "left").join(done, id_col, "left")
    return out.select("content_hash", id_col, F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("indexed_count", F.lit(0)).alias("indexed_count"))


def recent_runs(runs: DataFrame, limit: int = 20, started: str = "started_at", key: str = "run_id") -> DataFrame:
    return runs.orderBy(F.desc(started), key).limit(limit)


def run(runs: DataFrame, run_id: object) -> DataFrame:
    """The run of an id."""
    return runs.where(F.col("run_id") == F.lit(run_id))


def run_results(results: DataFrame, run_id: object, created: str = "created_at") -> DataFrame:
    return results.where(F.col("run_id") == F.lit(run_id)).orderBy(created)


def exists(documents: DataFrame, doc_id: object, id_col: str = "doc_id") -> bool:
    return not document(documents, doc_id, id_col).limit(1).isEmpty()


def new_inputs(files: DataFrame, documents: DataFrame, key: str = "content_hash") -> DataFrame:
    """Files whose content no ready document has."""
    return files.join(documents.where("status = 'ready'").select(key), key, "left_anti")


def pending_chunks(chunks: DataFrame, indexed: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that have no vector yet."""
    return chunks.join(indexed.select(key), key, "left_anti")


def indexed_ids(vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    return vectors.select(key).distinct()
