"""Sources: text files, paginated binaries through an extractor, question sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPORTED = ("pdf", "txt")


def _kind(path: str = "path"):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def raw_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, rejected) below path; files: source_uri, source_type, content_hash, content."""
    return dispatched(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def dispatched(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, rejected) of (path, content), by the suffix."""
    every = found.withColumn("source_type", _kind())
    ok = F.col("source_type").isin(*SUPPORTED)
    files = every.where(ok).select(F.col("path").alias("source_uri"), "source_type", F.sha2("content", 256).alias("content_hash"), "content")
    bad = every.where(~ok).select(F.col("path").alias("source_uri"), F.concat(F.lit("unsupported file type: "), "source_type").alias("reason"))
    return files, bad


def text_documents(files: DataFrame) -> DataFrame:
    """Raw text of txt files; no marker, so the whole file is page 0. Bytes that are not UTF-8 make an error row."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    out = files.where("source_type = 'txt'").withColumn("raw_text", text)
    error = F.when(F.col("raw_text").isNull(), F.lit("not UTF-8"))
    return out.select("source_uri", "source_type", "content_hash", "raw_text", error.alias("error_message"))


def pdf_pages(content: bytes) -> list[str]:
    """Page texts by pypdf, where it is installed; an encrypted file is tried with an empty password."""
    import io

    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(content))
    if reader.is_encrypted and not reader.decrypt(""):
        raise ValueError("the file is encrypted")
    return [page.extract_text() or "" for page in reader.pages]


def paged_documents(files: DataFrame, extract: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """Raw text of pdf files through ``extract`` (bytes to page texts), pages joined with form feeds and markers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for content in batch.column(3).to_pylist():
                try:
                    pages = extract(bytes(content))
                    texts.append("".join(f"\f[page {i}]\n{p or ''}" for i, p in enumerate(pages, 1)))
                    errors.append(None)
                except Exception as e:  # one unreadable file must not stop the others
                    texts.append(None)
                    errors.append(f"unreadable: {e}")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string()), pa.array(errors, pa.string())],
                ["source_uri", "source_type", "content_hash", "raw_text", "error_message"],
            )

    schema = "source_uri string, source_type string, content_hash string, raw_text string, error_message string"
    return files.where("source_type = 'pdf'").select("source_uri", "source_type", "content_hash", "content").mapInArrow(run, schema)


_QUESTION = T.StructType([T.StructField("text", T.StringType()), T.StructField("expected_sources", T.MapType(T.StringType(), T.IntegerType()))])


def question_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions (query_id, text), qrels (query_id, key, grade)) of a JSON list or an object with a list 'questions'.

    Raises ValueError for another shape, an empty set, a question without text or sources that are no object.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))
    listed = F.from_json("json", T.ArrayType(T.StringType()))
    inside = F.from_json(F.get_json_object("json", "$.questions"), T.ArrayType(T.StringType()))
    is_list = F.col("json").rlike(r"^\s*\[")
    items = raw.select(F.posexplode_outer(F.when(is_list, listed).otherwise(inside)).alias("query_id", "item"))
    parsed = items.select(
        "query_id", "item", F.from_json("item", _QUESTION).alias("q"), F.get_json_object("item", "$.expected_sources").alias("sources")
    )
    bad = parsed.where(
        F.col("item").isNull() | F.col("q.text").isNull() | (F.trim(F.col("q.text")) == "") | (F.col("sources").isNotNull() & ~F.col("sources").rlike(r"^\s*\{"))
    )
    if parsed.isEmpty() or not bad.isEmpty():
        raise ValueError(f"{path}: not a list of questions with text and expected_sources")
    questions = parsed.select("query_id", F.col("q.text").alias("text"))
    qrels = parsed.select("query_id", F.explode("q.expected_sources").alias("key", "grade"))
    return questions, qrels
