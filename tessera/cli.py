"""Command line: ingest, documents, search, ask, evaluate, delete, check. Needs no service; --store names the table folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from tessera.operators.catalog import exists, list_documents
from tessera.operators.dense import hash_embedder
from tessera.plans import engine
from tessera.session import session
from tessera.sources.files import question_set, raw_files, text_documents
from tessera.sources.store import Store


def _quote(prompts: list[str]) -> list[str]:
    """Stand-in for a language model: cites the first source."""
    return ["See [1]."] * len(prompts)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("--store", required=True)
    parser.add_argument("--master")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("ingest").add_argument("path")
    commands.add_parser("documents")
    commands.add_parser("search").add_argument("query")
    commands.add_parser("ask").add_argument("question")
    commands.add_parser("delete").add_argument("doc_id")
    commands.add_parser("check")
    commands.add_parser("evaluate").add_argument("questions")
    args = parser.parse_args(argv)
    spark = session(args.master)
    store, embed = Store(spark, args.store), hash_embedder(256)
    if args.command == "ingest":
        files, rejected = raw_files(spark, args.path)
        done = engine.ingest(store, text_documents(files), embed)
        done.select("source_uri", "status", "n_chunks", "error_message").show(truncate=False)
        rejected.show(truncate=False)
        return int(not done.where("status = 'failed'").isEmpty() or not rejected.isEmpty())
    if args.command == "documents":
        documents, chunks = store.read("documents"), store.read("chunks")
        if documents is not None and chunks is not None:
            list_documents(documents, chunks).show(truncate=False)
        return 0
    if args.command == "search":
        asked = spark.createDataFrame([(0, args.query)], "query_id long, text string")
        engine.find(store, asked, embed).select("final_rank", "score", "doc_id", "page_number", "excerpt").orderBy("final_rank").show(truncate=80)
        return 0
    if args.command == "ask":
        asked = spark.createDataFrame([(0, args.question)], "query_id long, text string")
        engine.ask(store, asked, embed, [_quote]).select("text", "grounded", F.to_json("citations").alias("citations")).show(truncate=False)
        return 0
    if args.command == "delete":
        documents = store.read("documents")
        if documents is None or not exists(documents, args.doc_id):
            print(f"no document {args.doc_id}", file=sys.stderr)
            return 1
        store.delete_document(args.doc_id)
        return 0
    if args.command == "check":
        counts = {name: 0 if (df := store.read(name)) is None else df.count() for name in ("documents", "chunks", "vectors", "postings")}
        print(counts)
        return int(counts["chunks"] != counts["vectors"])
    questions, qrels = question_set(spark, args.questions)
    summary = engine.evaluate(store, questions, qrels, embed, [_quote])
    summary.select(F.to_json(F.struct("*"))).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
