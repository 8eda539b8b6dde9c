"""Pages: split, clean, assess, summarise and route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import quality as Q
from tessera.functions import text as T


def split_pages(docs: DataFrame, id_col: str = "doc_id", raw_col: str = "text") -> DataFrame:
    """(id, page_pos, page_number, text): blocks between form feeds; blank blocks vanish, a lost marker gives number 0."""
    blocks = docs.select(id_col, F.posexplode(F.split(F.coalesce(raw_col, F.lit("")), "\f")).alias("page_pos", "block"))
    blocks = blocks.withColumn("block", F.regexp_replace("block", r"^\n+|\n+$", "")).where(~T.is_blank(F.col("block")))
    return blocks.select(id_col, "page_pos", T.page_number(F.col("block")).alias("page_number"), T.without_markers(F.col("block")).alias("text"))


def clean_pages(docs: DataFrame, id_col: str = "doc_id", raw_col: str = "text") -> DataFrame:
    """Split and clean each page on its own; no line is joined over a page's end."""
    return split_pages(docs, id_col, raw_col).withColumn("text", T.clean(F.col("text")))


def assess(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """pages with the signals, issues, score (3 places) and is_usable."""
    out = pages.withColumns(Q.signals(F.col(text_col)))
    out = out.withColumns({"issues": Q.issues(), "raw_score": Q.score()})
    usable = (F.col("raw_score") >= Q.USABLE_SCORE) & (F.size("issues") == 0)
    return out.withColumns({"score": F.round("raw_score", 3), "is_usable": usable}).drop("raw_score")


def document_summary(assessed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: pages, usable and flagged pages, coverage, mean and worst score, issue tally."""
    base = assessed.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("is_usable").alias("usable"),
        F.count_if(~F.col("is_usable")).alias("flagged"),
        F.round(F.count_if("is_usable") / F.count(F.lit(1)), 3).alias("coverage"),
        F.round(F.avg("score"), 3).alias("mean_score"),
        F.min("score").alias("worst_score"),
    )
    counts = assessed.select(id_col, F.explode("issues.category").alias("category")).groupBy(id_col, "category").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "category", "n")))
    tally = counts.groupBy(id_col).agg(F.transform(ordered, lambda x: F.struct(x["category"].alias("category"), x["n"].alias("n"))).alias("issues"))
    return base.join(tally, id_col, "left")


def route(assessed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, flagged) pages."""
    return assessed.where("is_usable"), assessed.where("NOT is_usable")


def document_status(assessed: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, status, error_message): failed where every page is flagged or no chunk is left, else ready."""
    pages = assessed.groupBy(id_col).agg(F.count_if("is_usable").alias("usable"))
    made = chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_chunks"))
    reason: Column = F.when(F.col("usable") == 0, "no usable page").when(F.coalesce("n_chunks", F.lit(0)) == 0, "no chunk long enough")
    out = pages.join(made, id_col, "left").withColumn("error_message", reason)
    return out.select(id_col, F.when(F.col("error_message").isNull(), "ready").otherwise("failed").alias("status"), "error_message", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def latest_ready(documents: DataFrame, key: str = "content_hash") -> DataFrame:
    """At most one ready row for each content hash: the newest."""
    newest = Window.partitionBy(key).orderBy(F.col("created_at").desc(), "doc_id")
    ready = documents.where("status = 'ready'").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return documents.where("status <> 'ready'").unionByName(ready)
