"""BM25 as tables: postings, term statistics, weights and ranked scores. Terms are joined as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import search_tokens

K1, B = 1.5, 0.75


def tokenised(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return corpus.select(id_col, search_tokens(F.coalesce(text_col, F.lit(""))).alias("tokens"))


def postings(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl, term, tf); dl is the number of tokens after stop words."""
    flat = tokenised(corpus, id_col, text_col).select(id_col, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return flat.groupBy(id_col, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: n documents, avgdl (1 for an empty corpus)."""
    return tokenised(corpus, id_col, text_col).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(1.0)).alias("avgdl"))


def term_stats(posted: DataFrame) -> DataFrame:
    """(term, df)."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def document_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def query_terms(queries: DataFrame, query_id: str, text_col: str) -> DataFrame:
    """(query id, term): distinct terms."""
    return queries.select(query_id, F.explode(F.array_distinct(search_tokens(F.coalesce(text_col, F.lit(""))))).alias("term"))


def top_k(scored: DataFrame, query_id: str, id_col: str, score: str, k: int) -> DataFrame:
    """scored with rank 1..k by score, ties to the smaller id; partial top-k before the shuffle."""
    best = Window.partitionBy(query_id).orderBy(F.col(score).desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def bm25_scores(queries: DataFrame, corpus: DataFrame, query_id: str, query_text: str, id_col: str = "doc_id", text_col: str = "text", allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query id, id, score) for every match of a corpus that is tokenised for it."""
    return scores_of_postings(queries, postings(corpus, id_col, text_col), corpus_stats(corpus, id_col, text_col), query_id, query_text, id_col, allowed, k1, b)


def stored_stats(lengths: DataFrame, dl: str = "dl") -> DataFrame:
    """corpus_stats() from the stored numbers of tokens."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(dl), F.lit(1.0)).alias("avgdl"))


def scores_of_postings(queries: DataFrame, posted: DataFrame, stats: DataFrame, query_id: str, query_text: str, id_col: str = "doc_id", allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query id, id, score) for every match, score to 6 places, from postings and the row of corpus_stats(); allowed
    (query id, id) scopes before ranking.

    Statistics are those of the whole corpus. Postings are cut to the batch's terms before they meet the queries, so
    the shuffled part follows the queries' vocabulary.
    """
    asked = query_terms(queries, query_id, query_text)
    live = posted.join(asked.select("term").distinct(), "term", "left_semi")
    # one row of totals, joined by broadcast of proven size
    stats = F.broadcast(stats.withColumn("_one", F.lit(1)))
    weighted = live.join(term_stats(live), "term").withColumn("_one", F.lit(1)).join(stats, "_one")
    weighted = weighted.select(
        id_col, "term", (document_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b) * idf(F.col("n"), F.col("df"))).alias("w")
    )
    matches = asked.join(weighted, "term")
    if allowed is not None:
        matches = matches.join(allowed, [query_id, id_col], "left_semi")
    return matches.groupBy(query_id, id_col).agg(F.round(F.sum("w"), 6).alias("score"))


def bm25_top_k(queries: DataFrame, corpus: DataFrame, query_id: str, query_text: str, k: int, id_col: str = "doc_id", text_col: str = "text", allowed: DataFrame | None = None) -> DataFrame:
    return top_k(bm25_scores(queries, corpus, query_id, query_text, id_col, text_col, allowed), query_id, id_col, "score", k)


def stored_top_k(queries: DataFrame, posted: DataFrame, stats: DataFrame, query_id: str, query_text: str, k: int, id_col: str = "doc_id", allowed: DataFrame | None = None) -> DataFrame:
    """bm25_top_k() from stored postings: no text is tokenised but the queries'."""
    return top_k(scores_of_postings(queries, posted, stats, query_id, query_text, id_col, allowed), query_id, id_col, "score", k)


def vocabulary(posted: DataFrame) -> DataFrame:
    """(term, term_id): distinct terms numbered from 0 in their order, without a task that holds them all.

    Terms are laid out in ranges; a range's first number is the size of the ranges before it.
    """
    laid = posted.select("term").distinct().repartitionByRange("term").withColumn("_range", F.spark_partition_id())
    sizes = laid.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("term")) - 1
    return laid.withColumn("_place", place).join(F.broadcast(starts), "_range").select("term", (F.col("_start") + F.col("_place")).alias("term_id"))


def sparse_queries(queries: DataFrame, terms: DataFrame, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query id, term_ids): the batch as sparse vectors over a vocabulary; all weights are 1, unknown terms vanish."""
    known = query_terms(queries, query_id, query_text).join(terms, "term")
    return known.groupBy(query_id).agg(F.array_sort(F.collect_list("term_id")).alias("term_ids"))
