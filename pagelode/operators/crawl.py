"""Breadth-first traversal of a link graph (B1-B9): a queue of addresses, and the traversal level by level."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import saved, tidied
from .numbering import number

#: Rows up to which a level is numbered by one task; larger ones are numbered by ranges.
ONE_TASK_ROWS = 50_000
SCHEMES = ("http", "https")


def _placed(df: DataFrame, n: int, order: list[str], name: str, start: int) -> DataFrame:
    if n > ONE_TASK_ROWS:
        return number(df, order, name, start)
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long") + F.lit(start))


def merge_parts(parts: list[tuple[int, DataFrame]], n: int, df: DataFrame, name: str) -> None:
    """Append a saved part of ``n`` rows; older parts of at most twice the newer ones' rows are folded into them."""
    parts.append((n, df))
    while len(parts) > 1 and parts[-2][0] <= 2 * parts[-1][0]:
        (m, older), (k, newer) = parts[-2:]
        parts[-2:] = [(m + k, saved(older.unionByName(newer), name))]


class Frontier:
    """The queue of addresses to visit and the set of those ever queued.

    Both are parts that operations append to; parts are merged when newer ones add up to as many rows, so that a crawl
    writes each address a logarithmic number of times. An entry is told from others by its ``key``, which is its address
    unless the table that is queued has a column of that name.
    """

    def __init__(self, spark: SparkSession):
        self.queue = spark.createDataFrame([], "url string, place long, key string")
        self.first, self.next = 0, 0
        self._seen: list[tuple[int, DataFrame]] = [(0, spark.createDataFrame([], "key string"))]

    @property
    def seen(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (df for _, df in self._seen))

    def put_back(self, taken: DataFrame) -> None:
        """Rows that ``dequeue`` gave return to their places."""
        self.queue = saved(self.queue.unionByName(taken.select("url", "place", "key")), "queue")

    def enqueue(self, urls: DataFrame | Iterable[str], *, before: bool = False, ignore_queued: bool = False) -> int:
        """Append addresses, or put them in front, in their order; each counts once. Returns how many were new.

        A table has columns url and place (its order), and key where one address may stand for several entries. A scheme
        other than http(s) is an error, and so is an entry queued earlier, unless ``ignore_queued``; nothing is queued then.
        """
        spark = self.queue.sparkSession
        if not isinstance(urls, DataFrame):
            urls = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, place long")
        asked = urls.groupBy(F.col("key") if "key" in urls.columns else F.col("url").alias("key")).agg(F.min("place").alias("at"), F.min_by("url", "place").alias("url"))
        asked = saved(asked, "asked")
        scheme = F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        if bad := asked.filter(F.col("url").isNull() | ~scheme.isin(*SCHEMES)).first():
            raise ValueError(f"unsupported scheme: {bad['url']}")
        new = saved(asked.join(self.seen, "key", "left_anti"), "new")
        n = new.count()
        if not ignore_queued and n < asked.count():
            raise ValueError(f"already queued: {asked.join(self.seen, 'key', 'left_semi').first()['url']}")
        start = self.first - n if before else self.next
        placed = _placed(new, n, ["at", "key"], "place", start).select("url", "place", "key")
        self.queue = saved(self.queue.unionByName(placed), "queue")
        merge_parts(self._seen, n, new.select("key"), "seen")
        self.first, self.next = (start, self.next) if before else (self.first, start + n)
        return n

    def dequeue(self, n: int = 1) -> DataFrame:
        """The first ``n`` rows (url, place, key) of the queue, which leave it; LookupError if it is empty."""
        first = self.queue.orderBy("place").limit(n) if n <= ONE_TASK_ROWS else number(self.queue, ["place"], "__n").filter(F.col("__n") <= n).drop("__n")
        taken = saved(first, "taken")
        top = taken.agg(F.max("place").alias("top")).first()["top"]
        if top is None:
            raise LookupError("the queue is empty")
        self.queue = saved(self.queue.filter(F.col("place") > F.lit(top)), "queue")
        return taken

    def reset(self, urls: DataFrame) -> None:
        """Forget that addresses (column url; or keys, column key) were queued, so that they can be queued again."""
        left = saved(self.seen.join(urls.select("key" if "key" in urls.columns else F.col("url").alias("key")), "key", "left_anti"), "seen")
        self._seen = [(left.count(), left)]


@tidied
def bfs(edges: DataFrame, seeds: DataFrame, budget: int | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, depth, visit): ``edges`` has source, target, ordinal; ``seeds`` has node, ordinal.

    A level is the distinct targets of the level before that were never queued, ordered by the parent's place and the
    link's ordinal. The loop ends when no link leads further; ``budget`` or ``max_depth`` ends it early. Levels are
    written to the shared folder and merged as they add up, so that the plan stays short at any depth.
    """
    first = saved(seeds.groupBy("node").agg(F.min("ordinal").alias("o")), "level")
    total = first.count()
    level = _placed(first, total, ["o", "node"], "visit", 0).select("node", F.lit(0).alias("depth"), "visit")
    seen = level = saved(level, "level")
    parts, depth = [(total, level)], 0
    while (budget is None or total < budget) and (max_depth is None or depth < max_depth):
        depth += 1
        nexts = level.join(edges, level["node"] == edges["source"]).groupBy(F.col("target").alias("node")).agg(F.min(F.struct("visit", "ordinal")).alias("key"))
        fresh = saved(nexts.join(seen.select("node"), "node", "left_anti"), "level")
        if not (n := fresh.count()):
            break
        level = saved(_placed(fresh, n, ["key", "node"], "visit", total).select("node", F.lit(depth).alias("depth"), "visit"), "level")
        total += n
        merge_parts(parts, n, level, "seen")
        seen = reduce(DataFrame.unionByName, (df for _, df in parts))
    return seen.filter(F.col("visit") <= budget) if budget is not None else seen
