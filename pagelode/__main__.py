"""Command line (S8, S10, S12, S13): crawl or index pages into a folder, then search or summarize it."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, ship
from .functions.text import analyze_word, load_stop_words
from .operators import query, rank, report
from .sources import store, web
from .sources.work import saved


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagelode", description=__doc__)
    p.add_argument("-v", "--version", action="version", version=f"pagelode {__version__}")
    p.add_argument("--config", help="JSON file with defaults for the options below")
    p.add_argument("--write-config", help="write the options of this call to a JSON file, for --config")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text, description=text)
        c.add_argument("-d", "--database-path", required=True, help="index folder")
        c.add_argument("--stop-words", help="file with one stop word a line")
        c.add_argument("--verbose", action="store_true", help="Spark's own log")
        return c

    def indexing(c: argparse.ArgumentParser) -> None:
        c.add_argument("--index-concurrency", type=int, default=None, help="tasks that parse pages (default: Spark's)")
        c.add_argument("--database-concurrency", type=int, default=1, help="tables written at once")
        c.add_argument("--no-progress", action="store_true", help="tell nothing of what is done")

    def listed(c: argparse.ArgumentParser) -> None:
        c.add_argument("-s", "--summary-path", help="folder for the summary's text files")
        c.add_argument("--summary-count", type=int, default=-1, help="pages in the summary (negative: all)")
        c.add_argument("-k", "--keyword-count", type=int, default=10)
        c.add_argument("-l", "--link-count", type=int, default=10)

    c = command("crawl", "Fetch pages breadth first from addresses and index them.")
    c.add_argument("inputs", nargs="+", help="addresses to start from")
    c.add_argument("-n", "--page-count", type=int, default=-1, help="distinct pages to fetch (negative: as many as inputs)")
    c.add_argument("-c", "--request-concurrency", type=int, default=web.CONCURRENCY)
    indexing(c)
    listed(c)
    c = command("index", "Index a Parquet table of pages (page_id, url, html, optionally headers).")
    c.add_argument("inputs", nargs="+", help="Parquet paths")
    indexing(c)
    listed(c)
    listed(command("summary", "Write or print the summary of an index."))
    c = command("search", "Print one page of results for a query.")
    c.add_argument("query")
    c.add_argument("-p", "--page", type=int, default=1)
    c.add_argument("--per-page", type=int, default=report.PER_PAGE)
    c.add_argument("--explain", action="store_true", help="print the terms' TF-IDF rows as well")
    return p


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """Options; those of ``--config`` are defaults that the command line overrides."""
    p = parser()
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config")
    path = first.parse_known_args(argv)[0].config
    if path:
        given = json.loads(Path(path).read_text("utf-8"))
        for action in p._subparsers._group_actions:
            for c in action.choices.values():
                c.set_defaults(**given)
                for a in c._actions:
                    a.required = a.required and a.dest not in given
    args = p.parse_args(argv)
    if args.write_config:
        kept = {k: v for k, v in vars(args).items() if k not in ("command", "config", "write_config", "inputs", "query")}
        Path(args.write_config).write_text(json.dumps(kept, indent=2) + "\n", "utf-8")
    return args


def _write_summary(spark: SparkSession, args: argparse.Namespace) -> None:
    index = store.read_index(spark, args.database_path)
    pages = store.first_pages(index, args.summary_count).join(store.addressed_pages(index).select("page_id", "url"), "page_id")
    links = store.named_links(index)
    few = pages.select("page_id")
    blocks = report.summary(
        pages, index.postings.join(few, "page_id", "left_semi"), links.join(few, "page_id", "left_semi"), args.keyword_count, args.link_count
    )
    if args.summary_path:
        report.write_summary(blocks, args.summary_path)
    elif args.command == "summary":
        for i, row in enumerate(blocks.orderBy("page_id").toLocalIterator()):
            print(f"{report.RULE}\n{row['block']}" if i else row["block"])


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    ship(spark)
    stop = load_stop_words(args.stop_words)
    if args.command == "search":
        index = store.read_index(spark, args.database_path)
        analyze = lambda word: analyze_word(word, stop)
        ranked = rank.search(index, args.query, analyze)
        query.remember(spark, args.database_path, args.query)
        hits = saved(report.result_page(ranked, args.page, args.per_page), "hits")
        cards = report.result_cards(store.addressed_pages(index), hits.drop("rank", "n_pages"), index.postings, store.named_links(index))
        told = cards.drop("rank").join(hits.select("page_id", "rank", "n_pages"), "page_id").orderBy("rank")
        out = told.select("rank", "title", "url", F.round("weight", 4).alias("weight"), "time", "size", "keywords", "inlinks", "outlinks", "n_pages")
        out.show(args.per_page, truncate=60)
        if args.explain:
            rank.explain_terms(index, args.query, analyze).orderBy("place", "page_id").show(args.per_page)
        return out
    if args.command in ("crawl", "index"):
        tell = (lambda *_: None) if args.no_progress else lambda text: print(text, file=sys.stderr, flush=True)
        options = {"tasks": args.index_concurrency, "writers": args.database_concurrency, "stop": stop}
    if args.command == "crawl":
        fetched = lambda n, budget, fresh: tell(f"fetched {n} of {budget} pages, {fresh} new")
        pages, failed = web.crawl(spark, args.inputs, args.page_count, concurrency=args.request_concurrency, progress=fetched)
        tell(f"indexed {store.index_pages(pages, args.database_path, **options).pages.count()} pages")
        for row in failed.toLocalIterator():
            print(f"skipped {row['asked']}: {row['error']}", file=sys.stderr)
    elif args.command == "index":
        tell(f"indexed {store.index_pages(spark.read.parquet(*args.inputs), args.database_path, **options).pages.count()} pages")
    if args.summary_path or args.command == "summary":
        _write_summary(spark, args)
    return None


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName("pagelode").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    run(spark, args)


if __name__ == "__main__":
    main()
