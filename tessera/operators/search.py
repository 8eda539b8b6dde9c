"""Fusion of ranked lists, reranking, resolution and slicing of hits."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import dense, lexical

OVERFETCH = 3
PASSAGE_CHARS = 1200
EXCERPT_CHARS = 400
# fixed value: a line of a reranker's reply
REPLY_LINE = r"(?m)^\s*\[(\d+)\]\s+score\s*[:=]\s*([01](?:\.\d+)?)\s*$"


def rrf(lists: DataFrame, limit: int, k: int = 60, base: int = 1, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of (query, retriever, id, rank); rank counts from ``base``. Adds fusion_score and rank."""
    each = lists.groupBy(query_id, "retriever", id_col).agg(F.min("rank").alias("rank"))
    fused = each.groupBy(query_id, id_col).agg(F.round(F.sum(1.0 / (F.col("rank") - 1 + base + k)), 6).alias("fusion_score"))
    return lexical.top_k(fused, query_id, id_col, "fusion_score", limit)


def resolve(hits: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(hits with their chunks, hits without a chunk)."""
    return hits.join(chunks, id_col), hits.join(chunks.select(id_col), id_col, "left_anti")


def rerank_prompts(hits: DataFrame, query_id: str = "query_id", text_col: str = "content") -> DataFrame:
    """(query, passages, n): the numbered passages from 0, cut to PASSAGE_CHARS characters."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.substring(text_col, 1, PASSAGE_CHARS).alias("t"))))
    lines = F.transform(items, lambda x: F.concat(F.lit("["), (x["rank"] - 1).cast("string"), F.lit("] "), x["t"]))
    return hits.groupBy(query_id).agg(F.array_join(lines, "\n\n").alias("passages"), F.count(F.lit(1)).alias("n"))


def parse_replies(replies: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query, rank, rerank_score) from (query, reply); the last of repeated numbers counts."""
    marks = F.regexp_extract_all("reply", F.lit(REPLY_LINE), F.lit(1))
    values = F.regexp_extract_all("reply", F.lit(REPLY_LINE), F.lit(2))
    rows = replies.select(query_id, F.posexplode(F.arrays_zip(marks.alias("i"), values.alias("s"))).alias("pos", "x"))
    rows = rows.select(query_id, "pos", (F.col("x.i").cast("int") + 1).alias("rank"), F.col("x.s").cast("double").alias("s"))
    return rows.groupBy(query_id, "rank").agg(F.max_by("s", "pos").alias("rerank_score"))


def apply_rerank(hits: DataFrame, replies: DataFrame, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """hits (query, id, rank, fusion_score) in final order: rerank_score, final_score, final_rank.

    Scores count only if they cover exactly the hits 0..n-1 of the query; otherwise the fusion order stays and the
    scores are null. Ties keep the fusion order.
    """
    every = Window.partitionBy(query_id)
    scores = parse_replies(replies, query_id)
    stray = scores.join(hits.select(query_id, "rank"), [query_id, "rank"], "left_anti").select(query_id).distinct().withColumn("_stray", F.lit(True))
    out = hits.join(scores, [query_id, "rank"], "left").join(stray, query_id, "left")
    full = (F.count("rerank_score").over(every) == F.count(F.lit(1)).over(every)) & F.col("_stray").isNull()
    out = out.withColumn("_full", full).withColumn("rerank_score", F.when(F.col("_full"), F.col("rerank_score"))).drop("_full", "_stray")
    out = out.withColumn("final_score", F.coalesce("rerank_score", "fusion_score"))
    order = every.orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    return out.withColumn("final_rank", F.row_number().over(order))


def excerpts(hits: DataFrame, top_k: int, rank: str = "final_rank", score: str = "final_score", text_col: str = "content") -> DataFrame:
    """The first top_k hits with a short text and a rounded score."""
    return hits.where(F.col(rank) <= top_k).withColumn("excerpt", F.substring(text_col, 1, EXCERPT_CHARS)).withColumn("score", F.round(score, 4))


def reranked_flag(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query, reranked): whether any used hit has a rerank score."""
    return hits.groupBy(query_id).agg(F.bool_or(F.col("rerank_score").isNotNull()).alias("reranked"))


def model_replies(prompts: DataFrame, model: Callable[[list[str]], list[str]], query_id: str = "query_id", prompt: str = "passages", reply: str = "reply") -> DataFrame:
    """(query, reply, error, ms) through an injected model that answers a list of prompts.

    Where it fails on a list, each prompt is asked alone, so one that can't be answered gets an error and a null reply
    and takes no other with it. ms is the time of a call by its prompts.
    """

    def asked(texts: list[str]) -> list[tuple[str | None, str | None, float]]:
        began = time.perf_counter()
        try:
            got = model(texts)
            if len(got) != len(texts):
                raise ValueError(f"the model returned {len(got)} replies for {len(texts)} prompts")
            error = [None] * len(got)
        except Exception as e:  # whatever a model raises must not end the run
            if len(texts) > 1:
                return [row for text in texts for row in asked([text])]
            got, error = [None], [f"{type(e).__name__}: {e}"]
        ms = 1000 * (time.perf_counter() - began) / len(texts)
        return [(g, e, ms) for g, e in zip(got, error, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = zip(*asked([p or "" for p in batch.column(1).to_pylist()]), strict=True)
                made = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], [query_id, reply, "error", "ms"])

    kind = prompts.schema[query_id].dataType.simpleString()
    return prompts.select(query_id, prompt).mapInArrow(run, f"{query_id} {kind}, {reply} string, error string, ms double")


def hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings = Settings(), limit: int | None = None, posted: DataFrame | None = None) -> DataFrame:
    """Fused hits (query_id, chunk_id, fusion_score, rank) of a batch of queries (query_id, text, embedding[, doc_id]).

    With stored postings (chunk_id, dl, term, tf), chunks have their number of tokens as dl, and none is tokenised.

    Both retrievers fetch OVERFETCH times the limit. Where queries have a doc_id that is not null, both are scoped to
    that document before they rank.
    """
    limit = limit or settings.retrieval_candidates
    fetch = OVERFETCH * limit
    open_, scoped = (queries, None) if "doc_id" not in queries.columns else (queries.where("doc_id IS NULL"), queries.where("doc_id IS NOT NULL"))
    lists = []
    for part, scope in ((open_, None), (scoped, "doc_id")):
        if part is None:
            continue
        allowed = part.select("query_id", "doc_id").join(chunks.select("doc_id", "chunk_id"), "doc_id").select("query_id", "chunk_id") if scope else None
        if posted is None:
            found = lexical.bm25_top_k(part, chunks, "query_id", "text", fetch, "chunk_id", "content", allowed)
        else:
            found = lexical.stored_top_k(part, posted, lexical.stored_stats(chunks), "query_id", "text", fetch, "chunk_id", allowed)
        lists.append(found.select("query_id", F.lit("bm25").alias("retriever"), "chunk_id", "rank"))
        placed = vectors.join(chunks.select("chunk_id", "doc_id"), "chunk_id") if scope else vectors
        near = dense.cosine_top_k(part, placed, "query_id", "chunk_id", fetch, scope=scope)
        lists.append(near.select("query_id", F.lit("dense").alias("retriever"), "chunk_id", "rank"))
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    return rrf(every, limit, settings.rrf_k, settings.rrf_rank_base)
