"""Named queries over the test tables, one or more for each operator; oracles.py has their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import quality as Q
from tessera.functions import text as T
from tessera.functions.headings import is_heading
from tessera.operators import catalog, chunks, dense, grounding, lexical, metrics, pages, search
from tessera.sources.files import dispatched, question_set, text_documents
from tessera.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TOP = 10


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def folded(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as paginated documents: form feeds and page markers, some lost, some doubled."""
    marker = F.when(F.col("turn") % 5 == 4, F.lit("")).when(F.col("turn") % 7 == 3, F.concat(F.lit("[PAGE "), F.col("turn") + 1, F.lit("][page 999]"))).otherwise(T.page_marker(F.col("turn") + 1))
    block = F.concat(F.lit("\f"), marker, F.lit("\n"), "text")
    turns = F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["b"]), "").alias("text"))


def conversation_pages(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_pos"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


# --- pages and cleaning


@query
def b1_split_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.split_pages(folded(spark, sf), "conv_id")


@query
def b2_dehyphenate(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", T.dehyphenate(F.replace("text", F.lit("th"), F.lit("t-\nh"))).alias("text"))


@query
def b3_join_lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", T.join_lines(F.replace("text", F.lit(", "), F.lit(",\n "))).alias("text"))


@query
def b4_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    damaged = F.replace(F.replace("text", F.lit(". "), F.lit(".  \n\n\n\n")), F.lit(", "), F.lit(",\t \x07"))
    return documents(spark, sf).select("doc_id", T.squeeze(damaged).alias("text"))


@query
def b5_clean(spark: SparkSession, sf: str) -> DataFrame:
    damaged = F.concat(F.lit("[page 7]\n"), F.replace(F.replace("text", F.lit("th"), F.lit("t-\nh")), F.lit(", "), F.lit(",  \f")))
    return documents(spark, sf).select("doc_id", T.clean(damaged).alias("text"))


@query
def b6_clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.clean_pages(folded(spark, sf), "conv_id")


# --- quality


@query
def c2_page_signals(spark: SparkSession, sf: str) -> DataFrame:
    found = Q.signals(ascii_only(F.col("text")))
    return documents(spark, sf).select("doc_id", *[(F.round(c, 6) if "ratio" in n else c).alias(n) for n, c in found.items()])


def _assessed(spark: SparkSession, sf: str) -> DataFrame:
    return pages.assess(conversation_pages(spark, sf).withColumn("text", ascii_only(F.col("text"))))


@query
def c8_page_verdict(spark: SparkSession, sf: str) -> DataFrame:
    found = pages.assess(documents(spark, sf).select("doc_id", ascii_only(F.col("text")).alias("text")))
    return found.select("doc_id", F.array_join("issues.category", ",").alias("issues"), "is_usable", "score")


@query
def c10_document_quality(spark: SparkSession, sf: str) -> DataFrame:
    tally = F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["category"], x["n"].cast("string"))), ",")
    return pages.document_summary(_assessed(spark, sf)).select("doc_id", "pages", "usable", "flagged", "coverage", "worst_score", F.coalesce(tally, F.lit("")).alias("issues"))


@query
def c11_routed_documents(spark: SparkSession, sf: str) -> DataFrame:
    usable, flagged = pages.route(_assessed(spark, sf))
    return usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("usable")).unionByName(
        flagged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("flagged"))
    )


# --- sentences, headings, sections, chunks


@query
def d1_token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query
def d2_sentences(spark: SparkSession, sf: str) -> DataFrame:
    planted = F.replace(F.replace("text", F.lit(". The "), F.lit(". Mr. Dr. The ")), F.lit(". A"), F.lit(" etc. A"))
    return documents(spark, sf).select("doc_id", F.posexplode(T.sentences(ascii_only(planted))).alias("pos", "sentence"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the documents, and title-like lines made of their first words."""
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split(ascii_only(F.col("text")), "\n")).alias("line_no", "line"))
    first = F.array_join(F.slice(F.split("line", " "), 1, 3), " ")
    bare = F.regexp_replace(first, r"[.,]", "")
    variants = F.array(F.col("line"), first, F.upper(first), F.concat(F.lit("1. "), bare), F.concat(F.lit("18 "), F.upper(bare)), F.initcap(bare), F.concat(bare, F.lit(" 5 km")), F.concat(F.lit("Chapter 4 "), bare))
    return lines.select("doc_id", "line_no", F.posexplode(variants).alias("variant", "line"))


@query
def d3_headings(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("doc_id", "line_no", "variant", is_heading(F.col("line")).alias("is_heading"))


def _headed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation pages whose first words also stand as a heading line."""
    title = F.initcap(F.regexp_replace(F.array_join(F.slice(F.split("text", r"\s+"), 1, 2), " "), r"[^A-Za-z ]", ""))
    with_title = F.when(F.col("page_pos") % 3 == 0, F.concat(title, F.lit("\n"), "text")).otherwise(F.col("text"))
    return conversation_pages(spark, sf).withColumn("text", with_title)


@query
def d6_sections(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.sections(_headed_pages(spark, sf)).withColumn("heading_path", F.array_join("heading_path", " > "))


@query
def e1_pack_ranges(spark: SparkSession, sf: str) -> DataFrame:
    tokens = documents(spark, sf).select("doc_id", F.transform(T.sentences(ascii_only(F.col("text"))), T.token_estimate).alias("tokens"))
    ranges = tokens.select("doc_id", F.posexplode(chunks.pack_ranges(F.col("tokens"), 120, 30)).alias("piece", "r"))
    return ranges.select("doc_id", "piece", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


@query
def e2_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk_pages(_headed_pages(spark, sf), 120, 30).withColumn("heading_path", F.array_join("heading_path", " > "))


@query
def e3_document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    one = documents(spark, sf).select("doc_id", F.lit(0).alias("page_pos"), F.lit(1).alias("page_number"), T.clean(F.col("text")).alias("text"))
    return chunks.chunk_pages(one).withColumn("heading_path", F.array_join("heading_path", " > "))


# --- lexical retrieval


@query
def f1_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.array_join(T.search_tokens(F.col("text")), " ").alias("tokens"), F.size(T.search_tokens(F.col("text"))).alias("dl"))


@query
def f2_postings(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.postings(documents(spark, sf))


@query
def f4_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.corpus_stats(documents(spark, sf)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query
def f6_term_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    n = docs.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    stats = lexical.term_stats(lexical.postings(docs)).withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one")
    return stats.select("term", "df", F.round(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query
def f7_document_weights(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    stats = F.broadcast(lexical.corpus_stats(docs).withColumn("_one", F.lit(1)))
    rows = lexical.postings(docs).withColumn("_one", F.lit(1)).join(stats, "_one")
    return rows.select("doc_id", "term", F.round(lexical.document_weight(F.col("tf"), F.col("dl"), F.col("avgdl")), 6).alias("weight"))


@query
def f8_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.query_terms(questions(spark, sf), "query_id", "text")


def _bm25(spark: SparkSession, sf: str, k: int = TOP) -> DataFrame:
    return lexical.bm25_top_k(questions(spark, sf), documents(spark, sf), "query_id", "text", k)


@query
def f9_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf)


# --- dense retrieval


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def _near(spark: SparkSession, sf: str, k: int = TOP) -> DataFrame:
    asked = _vectors(spark, sf).where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return dense.cosine_top_k(asked, _vectors(spark, sf), "query_id", "vec_id", k)


@query
def g1_embedded(spark: SparkSession, sf: str) -> DataFrame:
    return dense.embedded(documents(spark, sf), "doc_id", "text", dense.hash_embedder(64))


@query
def g6_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf)


# --- fusion and reranking


def _fused(spark: SparkSession, sf: str, k: int = 60, base: int = 1, limit: int = TOP) -> DataFrame:
    """BM25 and dense lists of the items that are also vectors, over documents that are also vectors."""
    lex = _bm25(spark, sf, 3 * limit).select("query_id", F.lit("bm25").alias("retriever"), F.col("doc_id").alias("chunk_id"), "rank")
    asked = _vectors(spark, sf).withColumnRenamed("vec_id", "query_id").join(questions(spark, sf).select("query_id"), "query_id")
    near = dense.cosine_top_k(asked, _vectors(spark, sf), "query_id", "vec_id", 3 * limit)
    near = near.select("query_id", F.lit("dense").alias("retriever"), F.col("vec_id").alias("chunk_id"), "rank")
    return search.rrf(lex.unionByName(near), limit, k, base)


@query
def h2_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf)


@query
def h2_rrf_zero_based(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf, 2, 0)


@query
def h3_scoped_bm25(spark: SparkSession, sf: str) -> DataFrame:
    docs, asked = documents(spark, sf), questions(spark, sf)
    scope = asked.select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("source"))
    allowed = docs.select("doc_id", "source").join(scope, "source").select("query_id", "doc_id")
    return lexical.bm25_top_k(asked, docs, "query_id", "text", 5, allowed=allowed)


@query
def h3_scoped_cosine(spark: SparkSession, sf: str) -> DataFrame:
    asked = _vectors(spark, sf).where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return dense.cosine_top_k(asked, _vectors(spark, sf), "query_id", "vec_id", 5, scope="label")


@query
def h4_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with their document, and the hits that name none."""
    hits = _near(spark, sf).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    held = documents(spark, sf).where("lang = 'en'").select("doc_id", F.length("text").alias("n_chars"))
    found, orphans = search.resolve(hits, held, "doc_id")
    return found.unionByName(orphans.withColumn("n_chars", F.lit(None).cast("int")))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, 5).select("query_id", F.col("doc_id").alias("chunk_id"), "rank", F.col("score").alias("fusion_score"))


def _reply_text(lines: Column, query_id: Column) -> Column:
    every = F.transform(lines, lambda x: x["s"])
    some = F.when(query_id % 3 == 1, F.slice(every, 1, F.size(every) - 1)).otherwise(every)
    return F.concat(F.lit("Scores:\n"), F.array_join(some, "\n"), F.when(query_id % 3 == 2, F.lit("\n[9] score = 1")).otherwise(F.lit("\nDone.")))


def _reply_frame(hits: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), (F.col("rank") - 1).cast("string"), F.lit("] score: 0."), ((F.col("rank") * 7 + F.col("query_id")) % 10).cast("string"))
    lines = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("s")))).alias("lines"))
    return lines.select("query_id", _reply_text(F.col("lines"), F.col("query_id")).alias("reply"))


@query
def h5_rerank_prompts(spark: SparkSession, sf: str) -> DataFrame:
    found = _hits(spark, sf).join(documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "chunk_id")
    return search.rerank_prompts(found)


@query
def h6_rerank(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf)
    return search.apply_rerank(hits, _reply_frame(hits)).select("query_id", "chunk_id", "rank", "rerank_score", "final_score", "final_rank")


@query
def h9_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    found = _hits(spark, sf).join(documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "chunk_id")
    return search.excerpts(found, 3, "rank", "fusion_score").select("query_id", "chunk_id", "rank", "excerpt", "score")


@query
def h10_reranked_flag(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf)
    return search.reranked_flag(search.apply_rerank(hits, _reply_frame(hits)).where("final_rank <= 3"))


# --- answers and citations


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations").where("role = 'assistant'")
    marked = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("] and ["), (F.col("turn") + 2).cast("string"), F.lit("][02][0]"))
    plain = F.when(F.col("turn") % 4 == 1, F.col("text")).otherwise(marked)
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", plain.alias("text"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """The first three turns of a conversation are the sources of its answers."""
    first = read(spark, sf, "conversations").where("turn < 3").select("conv_id", (F.col("turn") + 1).cast("int").alias("rank"), F.col("text").alias("content"))
    return _answers(spark, sf).select("query_id", "conv_id").join(first, "conv_id").select("query_id", "rank", "content")


@query
def i1_sources(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.format_sources(_sources(spark, sf))


@query
def i3_refusals(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark, sf)
    return grounding.refusals(asked, _bm25(spark, sf).where("score > 35"))


@query
def i4_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("query_id", F.array_join(F.transform(grounding.cited(F.col("text")), lambda n: n.cast("string")), ",").alias("cited"))


@query
def i5_drop_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("query_id", grounding.drop_unknown(F.col("text"), F.lit(3)).alias("text"))


@query
def i6_resolved_citations(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.resolve_citations(_answers(spark, sf).select("query_id", "text"), _sources(spark, sf))


@query
def i7_answers(spark: SparkSession, sf: str) -> DataFrame:
    built = grounding.build_answers(_answers(spark, sf).select("query_id", "text"), _sources(spark, sf))
    ranks = F.array_join(F.transform("citations", lambda c: c["rank"].cast("string")), ",")
    return built.select("query_id", "text", F.coalesce(ranks, F.lit("")).alias("citations"), "grounded")


# --- evaluation


def _qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Grade 2 for documents that hold an item's text, found by the item's first token and verified; 1 for the same source.

    Documents meet items by a shared rare token, so no all-pairs comparison is needed.
    """
    docs = documents(spark, sf)
    asked = questions(spark, sf).withColumn("longest", F.array_max(F.transform(T.search_tokens(F.col("text")), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"])
    terms = docs.select("doc_id", "text", F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("longest"))
    terms = terms.join(asked.select("longest").distinct(), "longest", "left_semi")
    pairs = terms.withColumnRenamed("text", "doc_text").join(asked, "longest").where(F.contains("doc_text", "text"))
    return pairs.select("query_id", F.col("doc_id").cast("string").alias("key"), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1).alias("grade"))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, 40).select("query_id", "rank", metrics.source_key(F.col("doc_id"), F.lit(None).cast("int")).alias("key"))


@query
def j2_qrels(spark: SparkSession, sf: str) -> DataFrame:
    return _qrels(spark, sf)


@query
def j7_query_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.query_metrics(questions(spark, sf), _ranked(spark, sf), _qrels(spark, sf))


@query
def j7_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of lists in which keys repeat: sources stand for documents."""
    by_source = documents(spark, sf).select(F.col("doc_id").cast("string").alias("key"), "source")
    ranked = _ranked(spark, sf).join(by_source, "key").select("query_id", "rank", F.col("source").alias("key"))
    qrels = _qrels(spark, sf).join(by_source, "key").groupBy("query_id", F.col("source").alias("key")).agg(F.max("grade").alias("grade"))
    return metrics.query_metrics(questions(spark, sf), ranked, qrels)


def _eval_answers(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("query_id", F.concat(F.lit("See [1][2], ["), (F.col("query_id") % 50).cast("string"), F.lit("] and [1].")).alias("text"))


@query
def j8_citation_precision(spark: SparkSession, sf: str) -> DataFrame:
    keys = metrics.cited_keys(_eval_answers(spark, sf), _ranked(spark, sf))
    return metrics.citation_precision(questions(spark, sf), keys, _qrels(spark, sf))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    rows = j7_query_metrics(spark, sf).join(j8_citation_precision(spark, sf), "query_id")
    failed = F.col("query_id") % 11 == 3
    return rows.select(
        "query_id", "recall", "precision", "mrr", "ndcg", "citation_precision",
        F.when(~failed & (F.col("query_id") % 5 != 0), F.lit("answer")).alias("answer"),
        (F.col("query_id") % 2 == 0).alias("has_marker"), F.when(failed, F.lit("timeout")).alias("error"), (F.col("query_id") * 1.5).alias("total_ms"),
    )


@query
def j10_mean_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mean_metrics(j7_query_metrics(spark, sf))


@query
def j11_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.run_summary(_results(spark, sf))


# --- catalogue: customers stand for documents, orders for their chunks and for a run log


@query
def k1_list_documents(spark: SparkSession, sf: str) -> DataFrame:
    parts = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.list_documents(read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), parts, "c_custkey")


@query
def k2_document(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.document(documents(spark, sf), 7)


@query
def k3_sample_chunks(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return catalog.sample_chunks(turns, 3)


@query
def k4_ordered_chunks(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return catalog.ordered_chunks(turns, 5)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ready").otherwise("processing")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("content_hash"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


@query
def k5_ready_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.ready_by_hash(_log(spark, sf), "10").select("doc_id", "content_hash", "status")


@query
def k6_partial(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_returnflag")
    return catalog.partial_by_hash(_log(spark, sf), lines, lines.where("l_returnflag = 'N'"))


@query
def k9_recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = read(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return catalog.recent_runs(runs, 20, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderpriority")


@query
def k10_run_results(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("created_at"), "l_quantity")
    return catalog.run_results(lines, 1)


@query
def k12_exists(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.document(documents(spark, sf), 0).limit(1).select("doc_id")


@query
def k14_ping(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT 1 AS ok")


# --- what is left to do


@query
def a5_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query
def l1_new_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text no labelled document has."""
    files = a5_content_hash(spark, sf)
    done = files.join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("status", F.lit("ready"))
    return catalog.new_inputs(files, done).select("doc_id", "content_hash")


@query
def l3_pending(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.pending_chunks(documents(spark, sf).select("doc_id"), read(spark, sf, "labels").select("doc_id"), "doc_id")


@query
def l5_status(spark: SparkSession, sf: str) -> DataFrame:
    made = _assessed(spark, sf)
    long = made.where("is_usable AND char_count >= 80").select("doc_id")
    return pages.document_status(made, long)


@query
def h12_point_count(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))


# --- sources, the store and injected models


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as files; every seventh is cut inside a character, every fifth has another suffix."""
    suffix = F.when(F.col("doc_id") % 5 == 3, ".md").when(F.col("doc_id") % 2 == 0, ".TXT").otherwise(".txt")
    broken = F.concat(F.col("text").cast("binary"), F.lit(b"\xc3"))
    return documents(spark, sf).select(
        F.concat(F.lit("in/"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.when(F.col("doc_id") % 7 == 1, broken).otherwise(F.col("text").cast("binary")).alias("content"),
    )


@query
def a1_text_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Readable and unreadable files; an unreadable one stops no other."""
    return text_documents(dispatched(_files(spark, sf))[0])


@query
def a4_rejected_files(spark: SparkSession, sf: str) -> DataFrame:
    return dispatched(_files(spark, sf))[1]


def _store(spark: SparkSession) -> Store:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return Store(spark, f"{root or 'file://' + tempfile.mkdtemp(prefix='tessera-')}/store-{uuid.uuid4().hex}", 8)


@query
def a10_question_set(spark: SparkSession, sf: str) -> DataFrame:
    """Questions written as one JSON file and read back, with their graded sources."""
    store = _store(spark)
    asked = read(spark, sf, "benchmark").select(F.struct("text", F.create_map(F.col("item_id").cast("string"), F.col("item_id") % 3).alias("expected_sources")).alias("q"))
    # the question set is one file by its format
    whole = asked.agg(F.to_json(F.struct(F.array_sort(F.collect_list("q.text")).alias("texts"), F.collect_list("q").alias("questions"))).alias("value"))
    whole.coalesce(1).write.text(f"{store.root}/questions")
    asked, qrels = question_set(spark, f"{store.root}/questions")
    return asked.join(qrels, "query_id").select("text", "key", "grade")


@query
def a7_upserted(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth customer is replaced and some are new; then a replay of the same rows changes nothing."""
    store, customers = _store(spark), read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    store.upsert("t", customers.where("c_custkey % 3 <> 0"), ["c_custkey"])
    changed = customers.where("c_custkey % 10 = 0 OR c_custkey % 3 = 0").withColumn("c_name", F.upper("c_name"))
    store.upsert("t", changed, ["c_custkey"])
    return store.upsert("t", changed.where("c_custkey % 20 = 0"), ["c_custkey"])


@query
def a9_deleted(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    store.upsert("t", documents(spark, sf).select("doc_id", "lang"), ["doc_id"])
    store.delete("t", read(spark, sf, "labels").select("doc_id"), ["doc_id"])
    store.delete_document(7, ("t",))
    return store.read("t")


@query
def a12_appended(spark: SparkSession, sf: str) -> DataFrame:
    """A log in two appends, the second with one more column."""
    store, log = _store(spark), _log(spark, sf)
    store.append("log", log.where("status = 'ready'").select("doc_id", "status"))
    return store.append("log", log.where("status <> 'ready'").select("doc_id", "status", "content_hash"))


@query
def e4_word_budget_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks under an injected counter: words."""
    made = chunks.chunk_pages(_headed_pages(spark, sf), 60, 15, count=lambda c: F.size(T.words(c)))
    return made.withColumn("heading_path", F.array_join("heading_path", " > "))


@query
def e5_least_length(spark: SparkSession, sf: str) -> DataFrame:
    """Short and blank chunks go; numbers were given before."""
    made = chunks.chunk_pages(_headed_pages(spark, sf), 120, 30, min_chars=200)
    return made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("content")).alias("least"), F.max("chunk_index").alias("last"))


@query
def f10_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.vocabulary(lexical.postings(documents(spark, sf)))


@query
def f12_sparse_queries(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical.sparse_queries(questions(spark, sf), f10_vocabulary(spark, sf))
    return found.select("query_id", F.array_join(F.transform("term_ids", lambda t: t.cast("string")), ",").alias("term_ids"))


@query
def f11_stored_search(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 from postings and numbers of tokens that were stored in two ingests."""
    store, docs = _store(spark), documents(spark, sf)
    for part in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")):
        store.upsert("postings", lexical.postings(part), ["doc_id", "term"])
        store.upsert("lengths", part.select("doc_id", F.size(T.search_tokens(F.col("text"))).alias("dl")), ["doc_id"])
    stats = lexical.stored_stats(store.read("lengths"))
    return lexical.stored_top_k(questions(spark, sf), store.read("postings"), stats, "query_id", "text", TOP)


def _shapes(texts: list[str], task: str) -> list[list[float]]:
    """A model whose vectors SQL can tell: characters and spaces."""
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query
def g2_model_vectors(spark: SparkSession, sf: str) -> DataFrame:
    found = dense.embedded(documents(spark, sf), "doc_id", "text", _shapes, batch=7)
    return found.select("doc_id", F.col("embedding")[0].cast("long").alias("chars"), F.col("embedding")[1].cast("long").alias("spaces"))


@query
def h1_overfetch(spark: SparkSession, sf: str) -> DataFrame:
    """hybrid() fetches three times its limit from both retrievers before it fuses."""
    asked = _vectors(spark, sf).withColumnRenamed("vec_id", "query_id").join(questions(spark, sf), "query_id").drop("label")
    docs = documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content"))
    return search.hybrid(asked, docs, _vectors(spark, sf).select(F.col("vec_id").alias("chunk_id"), "embedding"), limit=TOP)


@query
def h8_top_slice(spark: SparkSession, sf: str) -> DataFrame:
    found = _hits(spark, sf).withColumns({"content": F.lit("text"), "final_rank": F.col("rank"), "final_score": F.col("fusion_score")})
    return search.excerpts(found, 2).select("query_id", "chunk_id", "final_rank")


@query
def h11_indexed_ids(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.indexed_ids(read(spark, sf, "embeddings").unionByName(read(spark, sf, "embeddings")), "vec_id")


def _echo(prompts: list[str]) -> list[str]:
    if any(p.endswith("a.") for p in prompts):
        raise RuntimeError("no answer")
    return [str(len(p)) for p in prompts]


def _out_of_shape(prompts: list[str]) -> list[str]:
    raise ValueError("not a list of replies")


@query
def i2_generated(spark: SparkSession, sf: str) -> DataFrame:
    """A chain whose first model always fails and whose second fails on some questions: only those have errors."""
    asked = _answers(spark, sf).select("query_id", "text")
    return grounding.generate(asked, _sources(spark, sf), [_out_of_shape, _echo]).select("query_id", "text", "error", (F.col("ms") >= 0).alias("timed"))


@query
def i8_api_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citations as a caller gets them: only sources that the answer names, in their order."""
    built = grounding.build_answers(_answers(spark, sf).select("query_id", "text"), _sources(spark, sf)).where("grounded")
    return built.select("query_id", F.explode("citations").alias("c")).select("query_id", F.col("c.rank").alias("rank"), F.col("c.content").alias("content"))


@query
def j1_source_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of pages; page 0 and no page give the document alone."""
    page = F.when(F.col("turn") % 4 == 3, F.lit(None)).otherwise(F.col("turn"))
    return read(spark, sf, "conversations").select("conv_id", "turn", metrics.source_key(F.col("conv_id"), page).alias("key"))


@query
def j12_settings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(sorted(Settings(rrf_k=2).snapshot().items()), "name string, value string")


@query
def j13_failed_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """A reranker that always fails leaves the order of the fusion and no scores."""
    found = _hits(spark, sf)
    prompts = found.groupBy("query_id").agg(F.count(F.lit(1)).cast("string").alias("passages"))
    replies = search.model_replies(prompts, _out_of_shape).select("query_id", "reply")
    return search.apply_rerank(found, replies).select("query_id", "chunk_id", "rerank_score", "final_score", "final_rank")


@query
def k11_run(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.run(read(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderpriority"), 3)


@query
def l2_resumed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """After a run that broke behind the first half, the chunks that are left; ids are the same in both runs."""
    made = chunks.chunk_pages(_headed_pages(spark, sf), 120, 30)
    return catalog.pending_chunks(made, made.where("chunk_index % 2 = 0").select("chunk_id")).select("chunk_id", "doc_id", "chunk_index")
