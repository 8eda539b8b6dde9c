"""Citations: numbered sources, markers in answers, resolution and grounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.search import model_replies

MARKER = r"\[(\d+)\]"
REFUSAL = "No evidence for this question was found in the indexed documents."


def format_sources(sources: DataFrame, query_id: str = "query_id", text_col: str = "content") -> DataFrame:
    """(query, sources): '[rank] text' blocks in order of rank."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.col(text_col).alias("t"))))
    lines = F.transform(items, lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["t"]))
    return sources.groupBy(query_id).agg(F.array_join(lines, "\n\n").alias("sources"))


def markers(text: Column) -> Column:
    """Marker numbers as written, digits kept; repeats kept."""
    return F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))


def cited(text: Column) -> Column:
    """Sorted distinct cited numbers."""
    return F.array_sort(F.array_distinct(F.transform(markers(text), lambda m: m.try_cast("int"))))


def drop_unknown(text: Column, n_sources: Column) -> Column:
    """text without the markers that name no source; what stands around them stays."""
    known = lambda m: F.coalesce(m.try_cast("int").between(1, n_sources), F.lit(False))
    bad = F.array_distinct(F.filter(markers(text), lambda m: ~known(m)))
    return F.aggregate(bad, text, lambda t, m: F.replace(t, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))


def resolve_citations(answers: DataFrame, sources: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query, rank, ... of sources) for each source that its answer (query, text) cites."""
    marks = answers.select(query_id, F.explode(cited(F.col("text"))).alias("rank"))
    return sources.join(marks, [query_id, "rank"])


def build_answers(answers: DataFrame, sources: DataFrame, query_id: str = "query_id") -> DataFrame:
    """answers with unknown markers removed, resolved citations in source order and grounded = any citation."""
    counts = sources.groupBy(query_id).agg(F.count(F.lit(1)).alias("_n"))
    fields = [c for c in sources.columns if c != query_id]
    resolved = resolve_citations(answers, sources, query_id)
    listed = resolved.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in fields if c != "rank"]))).alias("citations"))
    out = answers.join(counts, query_id, "left").join(listed, query_id, "left")
    out = out.withColumn("text", drop_unknown(F.col("text"), F.coalesce("_n", F.lit(0)))).drop("_n")
    return out.withColumn("grounded", F.coalesce(F.size("citations") > 0, F.lit(False)))


def refusals(queries: DataFrame, sources: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Canned answers for queries without any source; the model is not asked."""
    none = queries.join(sources.select(query_id).distinct(), query_id, "left_anti")
    return none.select(query_id, F.lit(REFUSAL).alias("text"), F.lit(False).alias("grounded"))


def generate(queries: DataFrame, sources: DataFrame, models: list[Callable[[list[str]], list[str]]], query_id: str = "query_id") -> DataFrame:
    """(query, text, error, ms) by an injected chain of models: the first whose reply works answers.

    A question that no model answers has a null text and an error; the others are not touched by it.
    """

    def chain(prompts: list[str]) -> list[str]:
        failed: Exception | None = None
        for model in models:
            try:
                return model(prompts)
            except (ValueError, KeyError, TypeError) as e:  # a bad shape: the next model; quota errors end the chain
                failed = e
        raise RuntimeError("every model failed") from failed

    prompts = format_sources(sources, query_id).join(queries.select(query_id, F.col("text").alias("question")), query_id)
    prompts = prompts.select(query_id, F.concat(F.lit("Sources:\n\n"), "sources", F.lit("\n\nQuestion: "), "question").alias("prompt"))
    return model_replies(prompts, chain, query_id, "prompt", "text")
