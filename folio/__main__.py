"""Command line: python -m folio COMMAND ... (python -m folio --help)."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators import audit, chapters, pages, verify
from .plans import queries
from .plans.refine import refine
from .sources import documents as src


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folio", description="Refine, check and cut paginated Markdown.")
    commands = p.add_subparsers(dest="command", required=True)
    for name, what, out in [("refine", "refine the books of a folder", True), ("chapters", "export their chapters", True), ("audit", "list pages that look wrong", False), ("verify", "list the checks of each book", False)]:
        c = commands.add_parser(name, help=what)
        c.add_argument("books", help="a folder of Markdown files")
        if out:
            c.add_argument("out", help="a folder that all executors share")
    commands.add_parser("preflight", help="check the installation")
    q = commands.add_parser("query", help="run a registered query")
    q.add_argument("name", choices=sorted(queries.QUERIES))
    q.add_argument("tables", help="a folder of Parquet tables")
    return p


def run(spark: SparkSession, asked: argparse.Namespace) -> DataFrame:
    """The rows that a command reports."""
    if asked.command == "preflight":
        return src.preflight(spark)
    if asked.command == "query":
        return queries.QUERIES[asked.name](spark, asked.tables)
    docs = src.read_markdown(spark, asked.books)
    if asked.command == "refine":
        return src.write_markdown(refine(docs), asked.out)
    if asked.command == "chapters":
        return chapters.export_chapters(docs, asked.out)[0]
    if asked.command == "audit":
        return audit.page_issues(pages.explode_pages(docs))
    return verify.findings(docs)


def main(words: Sequence[str] | None = None) -> None:
    asked = parser().parse_args(words)
    spark = SparkSession.builder.appName("folio").getOrCreate()
    run(spark, asked).show(1000, truncate=120)


if __name__ == "__main__":
    main()
