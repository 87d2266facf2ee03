"""Fetching pages (S1-S4, B4-B9): responses of a frontier in parallel tasks, and the crawl that feeds on their links."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..operators.crawl import Frontier
from .work import saved

ATTEMPTS, TIMEOUT, FIRST_WAIT = 10, 30.0, 0.5
#: Requests under way at once.
CONCURRENCY = 6
RESPONSES = "place long, asked string, url string, ok boolean, error string, headers map<string,string>, html string, links array<string>"


class Response(NamedTuple):
    url: str  # after redirects
    headers: dict[str, str]
    body: bytes


def fetch(url: str, attempts: int = ATTEMPTS, timeout: float = TIMEOUT, wait: float = FIRST_WAIT) -> Response:
    """One address over HTTP(S). Connection failures are tried again with doubled waits; an HTTP error status is final."""
    for left in range(attempts - 1, -1, -1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "pagelode"}), timeout=timeout) as got:
                return Response(got.geturl(), {k.title(): v for k, v in got.headers.items()}, got.read())
        except urllib.error.HTTPError:
            raise
        except OSError:
            if not left:
                raise
            time.sleep(wait)
            wait *= 2
    raise ValueError("attempts must be positive")


def respond(urls: DataFrame, get: Callable[[str], Response] = fetch, concurrency: int = CONCURRENCY) -> DataFrame:
    """A response row for each row (url, place): the text of accepted types, its links in order, or what went wrong.

    A page that fails is a row with ``error`` and stops nothing else. Rows are spread over ``concurrency`` tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(urls.sparkSession)
    kind = _parse_datatype_string(RESPONSES)
    arrow = to_arrow_schema(kind)

    def run(batches):
        from ..functions.page import ACCEPTED, content_type, decode, read_page, resolve

        for batch in batches:
            for row in batch.to_pylist():
                out = {"place": row["place"], "asked": row["url"], "url": row["url"], "ok": False, "links": []}
                try:
                    got = get(row["url"])
                    header = got.headers.get("Content-Type", "")
                    out |= {"url": got.url.partition("#")[0], "headers": list(got.headers.items())}
                    if content_type(header)[0] in ACCEPTED:
                        html = decode(got.body, header)
                        links = [t for h in read_page(html)[2] if (t := resolve(got.url, h)) is not None]
                        out |= {"ok": True, "html": html, "links": links}
                    else:
                        out["error"] = f"not indexed: {header}"
                except Exception as e:  # any failure of one page is data, not the end of the crawl
                    out["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([out], schema=arrow)

    spread = urls.select("url", "place").repartition(concurrency, "place")
    return saved(spread.mapInArrow(run, kind), "responses")


def crawl(
    spark: SparkSession, seeds: Iterable[str], budget: int = -1, get: Callable[[str], Response] = fetch, concurrency: int = CONCURRENCY,
    progress: Callable[[int, int, int], None] | None = None, frontier: Frontier | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Breadth first from the seeds: (pages, failures). ``pages`` (page_id, url, html, headers) is input for the index.

    The budget counts distinct pages (negative: as many as there are seeds). Pages come in the order of the queue; two
    addresses that lead to one page give that page once, by the earlier one. ``progress`` is told, after each round, how
    many pages there are, the budget, and how many the round brought. A crawl that is cut short leaves the addresses under
    way at the front of ``frontier``.
    """
    seeds = list(dict.fromkeys(seeds))
    budget = len(seeds) if budget < 0 else budget
    frontier = frontier or Frontier(spark)
    frontier.enqueue(seeds, ignore_queued=True)
    responses, won = spark.createDataFrame([], RESPONSES), spark.createDataFrame([], "url string, place long")
    n = 0
    while n < budget:
        try:
            batch = frontier.dequeue(budget - n)
        except LookupError:
            break
        try:
            got = respond(batch, get, concurrency)
        except BaseException:
            frontier.put_back(batch)  # cancelled or failed as a whole: nothing of it is lost (B6)
            raise
        good = got.filter("ok")
        # pages stay in the tables they were fetched into; only the small table of winners grows by appending
        new = saved(good.groupBy("url").agg(F.min("place").alias("place")).join(won.select("url"), "url", "left_anti"), "won")
        responses, won = responses.unionByName(got), won.unionByName(new)
        n += (fresh := new.count())
        if progress:
            progress(n, budget, fresh)
        # place in the queue of links: the page's place, then the link's
        links = good.select(F.col("place").alias("page"), F.posexplode("links").alias("pos", "url"))
        frontier.enqueue(links.select("url", F.struct("page", "pos").alias("place")), ignore_queued=True)
    kept = responses.filter("ok").join(won, ["url", "place"], "left_semi")
    return kept.select(F.col("place").alias("page_id"), "url", "html", "headers"), responses.filter("NOT ok").select("asked", "error")
