"""Reports (S8, R12-R17, W3-W5): keywords, links, summaries, result cards, pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import number

RULE = "-" * 30
SNIPPET = 339
PER_PAGE = 50


def top_keywords(postings: DataFrame, k: int = 10) -> DataFrame:
    """(page_id, word, total, rn): the k words of highest frequency in content and title together; negative k: all."""
    total = postings.groupBy("page_id", "word").agg(F.sum("frequency").alias("total"))
    ranked = total.withColumn("rn", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("total"), "word")).cast("long"))
    return ranked.filter(F.col("rn") <= k) if k >= 0 else ranked


def top_links(links: DataFrame, k: int = 10, key: str = "page_id") -> DataFrame:
    """(key, target, rn): the first k targets in order; negative k: all."""
    ranked = links.select(key, "target").withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy("target")).cast("long"))
    return ranked.filter(F.col("rn") <= k) if k >= 0 else ranked


def _listed(rows: DataFrame, text, name: str, between: str, key: str = "page_id") -> DataFrame:
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))).alias("l"))
    return got.select(key, F.array_join(F.transform("l", lambda x: x["t"]), between).alias(name))


def keyword_lines(postings: DataFrame, k: int = 10) -> DataFrame:
    return _listed(top_keywords(postings, k), F.concat_ws(" ", "word", F.col("total").cast("string")), "keywords", "; ")


def link_lines(links: DataFrame, k: int = 10) -> DataFrame:
    return _listed(top_links(links, k), F.col("target"), "links", "\n")


def _stamp() -> Column:
    """A page's time in ISO 8601 with its offset."""
    return F.date_format("mod_time", "yyyy-MM-dd'T'HH:mm:ssxxx")


def summary(pages: DataFrame, postings: DataFrame, links: DataFrame, k: int = 10, n_links: int = 10) -> DataFrame:
    """(page_id, block): title, url, time and size, keywords, links of each page. ``pages`` carries url."""
    stamp = F.concat(_stamp(), F.lit(", "), F.col("size").cast("string"))
    full = pages.join(keyword_lines(postings, k), "page_id", "left").join(link_lines(links, n_links), "page_id", "left")
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("(no title)"))
    return full.select("page_id", F.concat_ws("\n", title, "url", stamp, F.coalesce("keywords", F.lit("")), "links").alias("block"))


def write_summary(blocks: DataFrame, path: str) -> None:
    """Text sink: blocks in page order, a rule of 30 hyphens between them."""
    ordered = blocks.crossJoin(F.broadcast(blocks.agg(F.min("page_id").alias("first")))).repartitionByRange("page_id").sortWithinPartitions("page_id")
    ordered.select(F.when(F.col("page_id") == F.col("first"), F.col("block")).otherwise(F.concat(F.lit(RULE + "\n"), "block"))).write.text(path)


def inlinks(links: DataFrame) -> DataFrame:
    """(target, n_inlinks): pages that link to each address."""
    return links.groupBy("target").agg(F.count_distinct("page_id").alias("n_inlinks"))


def result_cards(pages: DataFrame, ranked: DataFrame, postings: DataFrame, links: DataFrame, k: int = 10) -> DataFrame:
    """Ranked pages with title, url, weight, time, size, keywords, first inlinks and outlinks, and snippet.

    ``pages`` carries url, ``links`` has page_id and target. Only the ranked pages' postings and links are read further.
    """
    hits = numbered(ranked)
    few = hits.select("page_id")
    keywords = keyword_lines(postings.join(few, "page_id", "left_semi"), k)
    both = page_links(pages, links, k, few)
    cards = hits.join(pages, "page_id").join(keywords, "page_id", "left").join(both, "page_id", "left")
    return cards.select(
        "rank", "page_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("(no title)")).alias("title"), "url", "weight", _stamp().alias("time"), "size",
        F.coalesce("keywords", F.lit("")).alias("keywords"), F.coalesce("inlinks", F.lit("")).alias("inlinks"), F.coalesce("outlinks", F.lit("")).alias("outlinks"),
        F.substring("plaintext", 1, SNIPPET).alias("snippet"),
    )


def _ranked() -> list:
    return [F.desc("weight"), F.desc("magnitude"), "page_id"]


def numbered(ranked: DataFrame) -> DataFrame:
    """``ranked`` with its 1-based rank, by ranges of the order."""
    return number(ranked, _ranked(), "rank")


def result_page(ranked: DataFrame, page: int, per_page: int = PER_PAGE) -> DataFrame:
    """One page of results, 1-based, with ranks and the number of pages (rounded up).

    Only the rows up to that page's end are ordered (top-k in each task) and ranked.
    """
    top = ranked.orderBy(*_ranked()).limit(page * per_page)
    ranks = top.withColumn("rank", F.row_number().over(W.orderBy(*_ranked())).cast("long"))
    n = ranked.agg(F.ceil(F.count("*") / per_page).cast("long").alias("n_pages"))
    return ranks.filter(F.col("rank") > (page - 1) * per_page).crossJoin(F.broadcast(n))


def page_links(pages: DataFrame, links: DataFrame, k: int = 10, only: DataFrame | None = None) -> DataFrame:
    """(page_id, inlinks, outlinks): the first k addresses, in order, of pages that link here and of this page's links.

    Two pages of one address that link here are told twice.

    ``pages`` has page_id and url, ``links`` has page_id and target; ``only`` (page_id) limits the pages told of.
    """
    at = pages.select("page_id", "url")
    wanted = at if only is None else at.join(only, "page_id", "left_semi")
    into = links.select(F.col("page_id").alias("source"), F.col("target").alias("url")).join(wanted, "url").select("page_id", "source")
    into = into.distinct().join(at.toDF("source", "target"), "source").select("page_id", "target")
    listed = lambda rows, name: _listed(top_links(rows, k), F.col("target"), name, "\n")
    links = links if only is None else links.join(only, "page_id", "left_semi")
    both = wanted.select("page_id").join(listed(into, "inlinks"), "page_id", "left").join(listed(links.select("page_id", "target").distinct(), "outlinks"), "page_id", "left")
    return both.select("page_id", F.coalesce("inlinks", F.lit("")).alias("inlinks"), F.coalesce("outlinks", F.lit("")).alias("outlinks"))
