"""End-to-end plans: ingest raw documents, search, ask and evaluate, each for a whole batch."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions.text import search_tokens
from tessera.operators import catalog, chunks, dense, grounding, metrics, pages, search
from tessera.operators.lexical import postings
from tessera.sources.store import Store


def ingest(store: Store, raw: DataFrame, embed: dense.Embed, settings: Settings = Settings()) -> DataFrame:
    """Index raw documents (source_uri, source_type, content_hash, raw_text, error_message) that are not ready yet.

    doc_id is the content hash, so a second run of the same input finds nothing to do. Documents are marked as
    processing first; then chunks are embedded and stored with their postings in slices of commit_chunks, so a broken
    run loses one slice and goes on with the chunks that have no vector. Only new chunks are tokenised and only touched
    buckets rewritten. A failing document gets a status row and does not stop the others. Returns the status rows.
    """
    known = store.read("documents")
    fresh = raw.withColumn("doc_id", F.col("content_hash")).dropDuplicates(["doc_id"])
    if known is not None:
        fresh = catalog.new_inputs(fresh, known)
    fresh = store.held(fresh, "staged")
    started = fresh.select("doc_id", "source_uri", "source_type", "content_hash", F.lit("processing").alias("status"), F.current_timestamp().alias("created_at"))
    store.upsert("documents", started, ["doc_id"])
    readable = fresh.where("error_message IS NULL")
    assessed = pages.assess(pages.clean_pages(readable.select("doc_id", F.col("raw_text").alias("text"))))
    usable, _ = pages.route(assessed)
    made = chunks.chunk_pages(usable, settings.chunk_size_tokens, settings.chunk_overlap_tokens, settings.min_chunk_chars)
    made = made.withColumn("dl", F.size(search_tokens(F.col("content"))))
    stored = store.upsert("chunks", made, ["chunk_id"]).join(fresh.select("doc_id"), "doc_id", "left_semi")
    vectors = store.read("vectors")
    todo = stored if vectors is None else catalog.pending_chunks(stored, vectors)
    slices = -(-todo.count() // settings.commit_chunks)
    number = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, slices)))
    for i in range(max(1, slices)):
        some = todo.where(number == i)
        posted = postings(some, "chunk_id", "content").join(some.select("chunk_id", "doc_id"), "chunk_id")
        store.upsert("postings", posted, ["chunk_id", "term"])
        new = dense.embedded(some, "chunk_id", "content", embed).join(some.select("chunk_id", "doc_id"), "chunk_id")
        store.upsert("vectors", new, ["chunk_id"])  # last: a chunk with a vector has its postings
    status = pages.document_status(assessed, stored)
    counts = stored.groupBy("doc_id").agg(F.sum(F.length("content")).alias("n_chars"))
    summary = pages.document_summary(assessed).select("doc_id", F.col("pages").alias("n_pages"), "usable", "coverage")
    rows = fresh.select("doc_id", "source_uri", "source_type", "content_hash", F.col("error_message").alias("_read"))
    rows = rows.join(status, "doc_id", "left").join(counts, "doc_id", "left").join(summary, "doc_id", "left")
    rows = rows.withColumn("error_message", F.coalesce("_read", "error_message", F.when(F.col("status").isNull(), "no text"))).drop("_read")
    rows = rows.withColumn("status", F.when(F.col("error_message").isNull(), "ready").otherwise("failed")).withColumn("created_at", F.current_timestamp())
    done = store.upsert("documents", rows, ["doc_id"]).join(fresh.select("doc_id"), "doc_id", "left_semi")
    store.append("ingest_log", done.select("doc_id", "status", "n_pages", "n_chunks", "created_at"))
    return done


def find(store: Store, queries: DataFrame, embed: dense.Embed, settings: Settings = Settings(), limit: int = 10, rerank: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Hits of queries (query_id, text[, doc_id]) with their chunks: fusion_score, rerank_score, final_score, final_rank.

    Postings and numbers of tokens come from the store. Where the reranker fails, its scores are null and the order of
    the fusion stays.
    """
    stored, vectors, posted = store.read("chunks"), store.read("vectors"), store.read("postings")
    if stored is None or vectors is None or posted is None:
        raise LookupError("nothing is indexed")
    asked = queries.join(dense.embedded(queries, "query_id", "text", embed, "RETRIEVAL_QUERY"), "query_id")
    fused = search.hybrid(asked, stored, vectors.select("chunk_id", "embedding"), settings, posted=posted.drop("doc_id"))
    found, _ = search.resolve(fused, stored.drop("dl"))
    if rerank is None:
        found = found.withColumns({"rerank_score": F.lit(None).cast("double"), "final_score": F.col("fusion_score"), "final_rank": F.col("rank")})
    else:
        found = store.held(found)
        found = search.apply_rerank(found, search.model_replies(search.rerank_prompts(found), rerank).select("query_id", "reply"))
    return search.excerpts(found, limit)


def ask(store: Store, queries: DataFrame, embed: dense.Embed, models: list[Callable[[list[str]], list[str]]], settings: Settings = Settings(), top_k: int | None = None, rerank: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Answers (query_id, text, citations, grounded, reranked, error, ms); queries without evidence are refused without
    a model, and a question that no model answers has an error."""
    # stored, so that models are asked once
    hits = store.held(find(store, queries, embed, settings, top_k or settings.retrieval_top_k, rerank))
    sources = hits.select("query_id", F.col("final_rank").alias("rank"), "content", "chunk_id", "doc_id", "page_number", "section_title", "final_score")
    replies = store.held(grounding.generate(queries, sources, models))
    answers = grounding.build_answers(replies, sources).join(search.reranked_flag(hits), "query_id", "left")
    return answers.unionByName(grounding.refusals(queries, sources), allowMissingColumns=True)


def evaluate(store: Store, questions: DataFrame, qrels: DataFrame, embed: dense.Embed, models: list[Callable[[list[str]], list[str]]], settings: Settings = Settings(), name: str = "unnamed", k: int = 10, n_sources: int | None = None, rerank: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Run the question set, store the run with its settings and its results, and return the summary row.

    A question that fails gets an error row and leaves the means. retrieval_ms is the time of the one retrieval job by
    its questions, generation_ms that of a question's call of the models, total_ms their sum.
    """
    run_id = uuid.uuid4().hex

    def stored(table: str, df: DataFrame) -> DataFrame:
        """df as this run's rows of a table of the store: models are asked once, and the run can be looked at later."""
        return store.append(table, df.withColumn("run_id", F.lit(run_id))).where(F.col("run_id") == run_id).drop("run_id")

    began = time.perf_counter()
    hits = stored("eval_hits", find(store, questions, embed, settings, settings.retrieval_candidates, rerank))
    retrieval = 1000 * (time.perf_counter() - began) / max(1, questions.count())
    ranked = hits.select("query_id", F.col("final_rank").alias("rank"), metrics.source_key(F.col("doc_id"), F.col("page_number")).alias("key"))
    sources = hits.where(F.col("final_rank") <= (n_sources or settings.retrieval_candidates)).select("query_id", F.col("final_rank").alias("rank"), "content")
    answers = stored("eval_answers", grounding.generate(questions, sources, models))
    per = metrics.query_metrics(questions, ranked, qrels, k).join(metrics.citation_precision(questions, metrics.cited_keys(answers, ranked), qrels), "query_id")
    results = per.join(answers.select("query_id", F.col("text").alias("answer"), F.col("error").alias("_failed"), F.col("ms").alias("generation_ms")), "query_id", "left")
    results = results.withColumns({
        "has_marker": F.coalesce(F.col("answer").rlike(grounding.MARKER), F.lit(False)),
        "error": F.coalesce("_failed", F.when(F.col("precision").isNull(), F.lit("nothing was retrieved"))),
        "retrieval_ms": F.lit(retrieval), "total_ms": F.lit(retrieval) + F.coalesce("generation_ms", F.lit(0.0)),
        "run_id": F.lit(run_id), "created_at": F.current_timestamp(),
    }).drop("_failed")
    results = store.append("eval_results", results).where(F.col("run_id") == run_id)
    summary = metrics.run_summary(results)
    config = F.create_map(*[F.lit(x) for pair in settings.snapshot().items() for x in pair])
    run = summary.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("name"), config.alias("config"), "*").withColumn("started_at", F.current_timestamp())
    store.append("eval_runs", run)
    return summary


def connect(spark: SparkSession, root: str) -> Store:
    return Store(spark, root)
