"""Dense vectors: embedding through an injected model, exact cosine top-k for a block of queries, optional LSH."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Embed = Callable[[list[str], str], list[list[float]]]
BATCH = 32
#: Queries of one job: their vectors go to every task.
MAX_QUERIES = 10_000


class QuotaExhausted(RuntimeError):
    """The model's quota is used up; a retry can't help."""


class Transient(RuntimeError):
    """The request may work later; wait names the seconds asked for, or None."""

    def __init__(self, message: str, wait: float | None = None) -> None:
        super().__init__(message)
        self.wait = wait


class Polite:
    """A model with pacing and retries: at least ``gap`` seconds between requests, waits of 2^n seconds up to ``most``."""

    def __init__(self, embed: Embed, gap: float = 0.0, attempts: int = 8, most: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.embed, self.gap, self.attempts, self.most, self.clock, self.sleep = embed, gap, attempts, most, clock, sleep
        self.last: float | None = None

    def __call__(self, texts: list[str], task: str) -> list[list[float]]:
        for attempt in range(self.attempts):
            if self.last is not None and (wait := self.gap - (self.clock() - self.last)) > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                return self.embed(texts, task)
            except Transient as e:
                if attempt + 1 == self.attempts:
                    raise
                self.sleep(min(self.most, e.wait if e.wait is not None else 2.0**attempt))
        raise ValueError("attempts must be positive")


def hash_embedder(dim: int = 64) -> Embed:
    """Deterministic stand-in for a model: signed hashed words, unit length."""

    def embed(texts: list[str], task: str) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dim] += 1.0 if h >> 31 else -1.0
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def embedded(df: DataFrame, id_col: str, text_col: str, embed: Embed, task: str = "RETRIEVAL_DOCUMENT", batch: int = BATCH) -> DataFrame:
    """(id, embedding); the model sees ``batch`` texts at a time and must return as many vectors, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, vectors = [t or "" for t in rows.column(1).to_pylist()], []
            for lo in range(0, len(texts), batch):
                got = embed(texts[lo : lo + batch], task)
                if len(got) != len(texts[lo : lo + batch]):
                    raise ValueError(f"the model returned {len(got)} vectors for {len(texts[lo : lo + batch])} texts")
                vectors += got
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(vectors, pa.list_(pa.float32()))], [id_col, "embedding"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, embedding array<float>")


def cosine_top_k(queries: DataFrame, vectors: DataFrame, query_id: str, id_col: str, k: int, query_vec: str = "embedding", vec: str = "embedding", scope: str | None = None) -> DataFrame:
    """(query id, id, score, rank) by exact cosine, score to 6 places, ties to the smaller id.

    The queries, MAX_QUERIES at most, are one block that goes to every task; vectors stay where they are. Each Arrow
    batch is one matrix product and hands on its own top k, and a ranked window with partial limits merges them.
    With scope, a column of both sides, a query sees only the vectors of its own scope.
    """
    wanted = [query_id, query_vec] + ([scope] if scope else [])
    block = queries.select(*wanted).orderBy(query_id).limit(MAX_QUERIES + 1).collect()
    if len(block) > MAX_QUERIES:
        raise ValueError(f"a job takes {MAX_QUERIES} queries at most")
    ids = [r[query_id] for r in block]
    scopes = np.asarray([r[scope] for r in block]) if scope else None
    q = np.asarray([r[query_vec] for r in block], float) if block else np.zeros((0, 1))
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    qkind, kind = queries.schema[query_id].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows or not ids:
                continue
            m = np.asarray(rows.column(1).to_pylist(), float)
            if m.shape[1:] != q.shape[1:]:
                raise ValueError(f"queries have {q.shape[1]} components, vectors {m.shape[1:]}")
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            names = np.asarray(rows.column(0).to_pylist())
            scores = np.round(q @ m.T, 6)
            if scopes is not None:
                scores = np.where(scopes[:, None] == np.asarray(rows.column(2).to_pylist())[None, :], scores, -np.inf)
            best = np.lexsort((np.broadcast_to(np.argsort(np.argsort(names)), scores.shape), -scores))[:, :k]
            at = np.repeat(np.arange(len(ids)), best.shape[1])
            flat = scores[at, best.ravel()]
            keep = np.isfinite(flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in at[keep]]), pa.array(names[best.ravel()[keep]]), pa.array(flat[keep])], [query_id, id_col, "score"]
            )

    source = vectors.where(F.col(vec).isNotNull()).select(id_col, vec, *([scope] if scope else []))
    found = source.mapInArrow(run, f"{query_id} {qkind}, {id_col} {kind}, score double")
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lsh_candidates(vectors: DataFrame, id_col: str, vec: str = "embedding", width: float = 0.5, tables: int = 4, seed: int = 7):
    """A fitted random-projection model for approximate search on unit vectors."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    ready = vectors.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(ready), ready
