"""Index store (S5-S7): the tables as Parquet under one folder, postings partitioned by field and sorted by word."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.page import ACCEPTED
from ..operators.index import Index, build_index, counted_urls, parse_pages


def write_index(index: Index, path: str, concurrency: int = 1) -> None:
    """Write the tables, ``concurrency`` of them at once. Postings lie in ranges of (field, word, page), so that files hold
    few words, a search skips most of them by their statistics, and the list of a frequent word spreads over several files.
    """

    def write(name: str, table: DataFrame) -> None:
        if name == "postings":
            table.repartitionByRange("field", "word", "page_id").sortWithinPartitions("field", "word", "page_id").write.mode("overwrite").partitionBy("field").parquet(f"{path}/{name}")
        else:
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    with ThreadPoolExecutor(concurrency) as pool:
        for done in [pool.submit(write, name, table) for name, table in index.tables().items()]:
            done.result()


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(**{n: spark.read.parquet(f"{path}/{n}") for n in ("urls", "pages", "links", "words", "postings", "rejected")})


def index_pages(pages: DataFrame, path: str, tasks: int | None = None, writers: int = 1, versions: bool = True, **options) -> Index:
    """Parse pages once into ``path``/parsed, in ``tasks`` tasks if given, build the tables from there, store them and read them back.

    Without ``versions``, pages that share an address are pages of their own.
    """
    parsed = parse_pages(pages if tasks is None else pages.repartition(tasks), **options)
    parsed.write.mode("overwrite").parquet(f"{path}/parsed")
    spark = pages.sparkSession
    write_index(build_index(spark.read.schema(parsed.schema).parquet(f"{path}/parsed"), versions), path, writers)
    return read_index(spark, path)


def index_addresses(pages: DataFrame, path: str, **options) -> DataFrame:
    """(url_id, content): the addresses of the index of these pages, each a page of its own, without its other tables."""
    parsed = parse_pages(pages, **options).select("url", "links")
    parsed.write.mode("overwrite").parquet(f"{path}/links")
    return counted_urls(pages.sparkSession.read.schema(parsed.schema).parquet(f"{path}/links")).select("url_id", "content")


def accepted(responses: DataFrame) -> DataFrame:
    """Responses that are indexed: ok, and of an accepted content type."""
    kind = F.lower(F.trim(F.split(F.col("content_type"), ";")[0]))
    return responses.filter(F.col("ok") & kind.isin(*sorted(ACCEPTED)))


def first_pages(index: Index, limit: int | None = None) -> DataFrame:
    rows = index.pages.orderBy("page_id")
    return rows if limit is None or limit < 0 else rows.limit(limit)


def named_links(index: Index) -> DataFrame:
    """(page_id, target): the link graph with addresses."""
    return index.links.join(index.urls.select("url_id", F.col("content").alias("target")), "url_id").select("page_id", "target")


def addressed_pages(index: Index) -> DataFrame:
    """The pages with their address as ``url``."""
    return index.pages.join(index.urls.select("url_id", F.col("content").alias("url")), "url_id", "left")
