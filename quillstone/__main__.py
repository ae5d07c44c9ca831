"""Command line: stats, search and ingest over Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import html, search
from .sources import append_passages


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("quillstone")
    commands = parser.add_subparsers(dest="command", required=True)
    stats = commands.add_parser("stats", help="totals and counts by category and level")
    find = commands.add_parser("search", help="the best passages for a query")
    ingest = commands.add_parser("ingest", help="passages of the books that aren't loaded yet")
    for command in (stats, find):
        command.add_argument("passages", help="path of passages(id, level, category, text, ...)")
    find.add_argument("query", nargs="+")
    find.add_argument("--limit", type=int, default=5)
    find.add_argument("--category")
    find.add_argument("--max-authority", type=int, default=5)
    ingest.add_argument("pages", help="path of pages(page_id, url, html, slug)")
    ingest.add_argument("registry", help="path of books(slug, category, level, total_passages, ...)")
    ingest.add_argument("out")
    ingest.add_argument("--book")
    ingest.add_argument("--limit", type=int, default=0)
    ingest.add_argument("--dry-run", action="store_true")
    ingest.add_argument("--reset-book")
    ingest.add_argument("--list-books", action="store_true")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.appName("quillstone").getOrCreate()
    if asked.command == "stats":
        for table in search.corpus_stats(spark.read.parquet(asked.passages)).values():
            table.show(100, truncate=False)
    elif asked.command == "search":
        queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked.query)], "qid int, text string")
        hits = search.search(queries, spark.read.parquet(asked.passages), limit=asked.limit, category=asked.category, max_authority=asked.max_authority)
        hits.select("qid", "position", "id", "level", "combined_score", F.substring("text", 1, 200).alias("text")).orderBy("qid", "position").show(1000, truncate=False)
    else:
        books = spark.read.parquet(asked.registry)
        if asked.list_books:
            books.orderBy("level", "slug").show(1000, truncate=False)
            return
        found = html.ingest(spark.read.parquet(asked.pages), books, books.select("slug", "total_passages"), asked.book, asked.reset_book, asked.limit)
        rows = found.join(books.select("slug", "category", "level"), "slug")
        if asked.dry_run:
            rows.groupBy("slug").count().orderBy("slug").show(1000, truncate=False)
        else:
            append_passages(rows, asked.out)


if __name__ == "__main__":
    main()
