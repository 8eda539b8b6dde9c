"""Retrieval and answer metrics as aggregates over long tables.

ranked: (query, rank, key), duplicates of a key are normal. qrels: (query, key, grade).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.grounding import markers


def source_key(doc: Column, page: Column) -> Column:
    """doc:page, or doc alone where the page is null or 0."""
    return F.when(page > 0, F.concat_ws(":", doc.cast("string"), page.cast("string"))).otherwise(doc.cast("string"))


def ndcg(ranked: DataFrame, qrels: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
    """(query, ndcg): cut to k, keep each key's first place, renumber, linear gain."""
    first = ranked.where(F.col("rank") <= k).groupBy(query_id, "key").agg(F.min("rank").alias("rank"))
    place = Window.partitionBy(query_id).orderBy("rank")
    gains = first.withColumn("pos", F.row_number().over(place)).join(qrels, [query_id, "key"])
    dcg = gains.groupBy(query_id).agg(F.sum(F.col("grade") / F.log2(F.col("pos") + 1.0)).alias("dcg"))
    best = Window.partitionBy(query_id).orderBy(F.col("grade").desc(), "key")
    ideal = qrels.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= k)
    ideal = ideal.groupBy(query_id).agg(F.sum(F.col("grade") / F.log2(F.col("pos") + 1.0)).alias("idcg"))
    return ideal.join(dcg, query_id, "left").select(query_id, F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias("ndcg"))


def query_metrics(queries: DataFrame, ranked: DataFrame, qrels: DataFrame, k: int = 10, query_id: str = "query_id") -> DataFrame:
    """(query, recall, precision, mrr, ndcg) for every query, to 6 places.

    Precision counts duplicates and divides by what was retrieved; null where nothing was. MRR looks at the whole list.
    """
    relevant = qrels.where("grade > 0").select(query_id, "key").distinct()
    totals = relevant.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_relevant"))
    marked = ranked.join(relevant.withColumn("hit", F.lit(1)), [query_id, "key"], "left")
    top = F.col("rank") <= k
    per = marked.groupBy(query_id).agg(
        F.count_distinct(F.when(top & (F.col("hit") == 1), F.col("key"))).alias("found"),
        F.count(F.when(top & (F.col("hit") == 1), 1)).alias("hits"),
        F.count(F.when(top, 1)).alias("shown"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    out = queries.select(query_id).join(per, query_id, "left").join(totals, query_id, "left").join(ndcg(ranked, qrels, k, query_id), query_id, "left")
    zero = F.lit(0.0)
    return out.select(
        query_id,
        F.round(F.coalesce(F.try_divide(F.col("found").cast("double"), F.col("n_relevant")), zero), 6).alias("recall"),
        F.round(F.try_divide(F.col("hits").cast("double"), F.col("shown")), 6).alias("precision"),
        F.round(F.coalesce(1.0 / F.col("first"), zero), 6).alias("mrr"),
        F.round(F.coalesce("ndcg", zero), 6).alias("ndcg"),
    )


def cited_keys(answers: DataFrame, ranked: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query, key) of each marker of (query, text), repeats kept; markers beyond the list are dropped."""
    marks = answers.select(query_id, F.explode(markers(F.col("text"))).alias("m")).select(query_id, F.col("m").try_cast("int").alias("rank"))
    return marks.join(ranked.select(query_id, "rank", "key"), [query_id, "rank"]).select(query_id, "key")


def citation_precision(queries: DataFrame, cited: DataFrame, qrels: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query, citation_precision): share of citations of relevant keys, repeats counted; 0 without a citation."""
    relevant = qrels.where("grade > 0").select(query_id, "key").distinct().withColumn("hit", F.lit(1.0))
    share = cited.join(relevant, [query_id, "key"], "left").groupBy(query_id).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("p"))
    return queries.select(query_id).join(share, query_id, "left").select(query_id, F.round(F.coalesce("p", F.lit(0.0)), 6).alias("citation_precision"))


def mean_metrics(per_query: DataFrame, columns: tuple[str, ...] = ("recall", "precision", "mrr", "ndcg")) -> DataFrame:
    """One row: the mean of each column, 0 for an empty table, and scored_questions."""
    return per_query.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in columns], F.count(F.lit(1)).alias("scored_questions"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row over results (recall, precision, mrr, ndcg, citation_precision, answer, has_marker, error, total_ms)."""
    ok = F.col("error").isNull()
    answered = ok & F.col("answer").isNotNull()
    mean = lambda when, c: F.round(F.coalesce(F.avg(F.when(when, F.col(c))), F.lit(0.0)), 6)
    return results.agg(
        *[mean(ok, c).alias(c) for c in ("recall", "precision", "mrr", "ndcg")],
        mean(answered, "citation_precision").alias("citation_precision"),
        F.round(F.coalesce(F.avg(F.when(answered, F.col("has_marker").cast("double"))), F.lit(0.0)), 6).alias("grounded"),
        F.count_if(ok).alias("scored_questions"),
        F.count_if(~ok).alias("errors"),
        F.count(F.lit(1)).alias("total"),
        F.round(F.coalesce(F.avg("total_ms"), F.lit(0.0)), 6).alias("mean_total_ms"),
    )
