"""Incremental indexing (I12, I14, I16, P11): newer versions of a page replace it, equal and older ones are ignored.

The page state of a stream is a set of parts: a base, and one part for each batch since. A batch only appends its own
parsed pages, whatever the state's size, and writing it again after a failure replaces the same part. Reading picks the
winner of each key (``operators/index.py``; mostly the url); ``compact`` folds the parts into a new base.

``IncrementalIndex`` does the same for the tables of the index: a batch adds only what it brings.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import PARSED, Index, latest_versions, parse_pages, version_key
from ..operators.numbering import number
from ..sources.work import saved

#: A base's log entry: it holds all batches up to ``upto``.
_LOG = "upto long, path string"


def merge(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored and fresh parsed pages, one per key: a fresh one wins only if it is newer."""
    new = latest_versions(fresh).withColumn("__key", version_key(fresh))
    kept = stored.withColumn("__key", version_key(stored))
    old = kept.select("__key", F.col("mod_time").alias("stored_time"))
    newer = new.join(old, "__key", "left").filter("stored_time IS NULL OR mod_time > stored_time").drop("stored_time")
    return kept.join(newer.select("__key"), "__key", "left_anti").drop("__key").unionByName(newer.select(*stored.columns))


def index_stream(spark: SparkSession, source: str, state: str, checkpoint: str, schema: str = "page_id long, url string, html string", files: int = 16):
    """Read new page files from ``source`` as a stream, ``files`` of them a batch (B14), into the page state under ``state``."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def step(batch: DataFrame, batch_id: int) -> None:
        latest_versions(parse_pages(batch)).write.mode("overwrite").parquet(f"{state}/parts/batch={batch_id}")

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _base(spark: SparkSession, state: str):
    try:
        return spark.read.schema(_LOG).parquet(f"{state}/log").orderBy("upto", ascending=False).first()
    except AnalysisException:
        return None


def _versions(spark: SparkSession, state: str) -> DataFrame | None:
    """Base and later parts with column ``batch``, -1 for the base."""
    base = _base(spark, state)
    found = [] if base is None else [spark.read.schema(PARSED).parquet(base["path"]).withColumn("batch", F.lit(-1).cast("long"))]
    try:
        parts = spark.read.schema(PARSED + ", batch long").parquet(f"{state}/parts")
        found.append(parts.filter(F.col("batch") > (-1 if base is None else base["upto"])))
    except AnalysisException:
        pass
    return found[0] if len(found) == 1 else found[0].unionByName(found[1]) if found else None


def read_state(spark: SparkSession, state: str) -> DataFrame | None:
    """The page state: one row per key. None before the first batch."""
    rows = _versions(spark, state)
    return None if rows is None else latest_versions(rows).drop("batch")


def compact(spark: SparkSession, state: str) -> None:
    """Fold all parts into a new base; readers see the old base until the log names the new one."""
    rows = _versions(spark, state)
    if rows is None or (upto := rows.agg(F.max("batch")).first()[0]) is None or upto < 0:
        return
    path = f"{state}/base/{uuid.uuid4().hex}"
    latest_versions(rows.filter(F.col("batch") <= upto)).drop("batch").write.parquet(path)
    spark.createDataFrame([(upto, path)], _LOG).coalesce(1).write.mode("append").parquet(f"{state}/log")


class IncrementalIndex:
    """An index that grows by batches: each table is a folder of parts, one for each batch.

    A batch appends its accepted pages with their links and postings, and the addresses and words that no earlier batch
    knew, numbered on from the greatest id (A4). Ids never change, and words that no page holds any more stay (I16).
    Adding a batch again after a failure replaces its parts. Reading keeps the rows of each key's winning batch.
    """

    TABLES = {
        "urls": "url_id long, content string, redirect_id long",
        "pages": "page_id long, url string, url_id long, mod_time timestamp, size long, plaintext string, title string, key string",
        "links": "page_id long, url_id long",
        "words": "word_id long, content string",
        "postings": "field string, page_id long, word string, positions array<int>, frequency long, tf_normalized double",
        "rejected": "page_id long, field string, value string",
    }

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self, table: str, before: int | None = None) -> DataFrame:
        schema = self.TABLES[table] + ", batch long"
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException:
            rows = self.spark.createDataFrame([], schema)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def _extend(self, values: DataFrame, table: str, id_name: str, batch: int) -> None:
        """Give ids to the values (content) that no earlier batch knew, and append them."""
        known = self._rows(table, batch)
        new = values.filter("content IS NOT NULL").distinct().join(known.select("content"), "content", "left_anti")
        top = known.agg(F.max(id_name)).first()[0] or 0
        self._write(number(new, ["content"], id_name, top).select(id_name, "content", *([F.lit(None).cast("long").alias("redirect_id")] if table == "urls" else [])), table, batch)

    def _winners(self, pages: DataFrame) -> DataFrame:
        """(key, page_id, batch, mod_time): for each key the first submission of the greatest time."""
        return pages.groupBy(version_key(pages).alias("key")).agg(F.min_by(F.struct("page_id", "batch", "mod_time"), F.struct(-F.unix_micros("mod_time"), "batch", "page_id")).alias("w")).select("key", "w.*")

    def add(self, parsed: DataFrame, batch: int) -> int:
        """Index a batch of parsed pages; returns how many were accepted."""
        stored = self._winners(self._rows("pages", batch)).select("key", F.col("mod_time").alias("stored"))
        fresh = latest_versions(parsed).withColumn("key", version_key(parsed)).join(stored, "key", "left").filter("stored IS NULL OR mod_time > stored").drop("stored")
        fresh = saved(fresh, "fresh")
        links = fresh.select("page_id", F.explode("links").alias("content"))
        self._extend(fresh.select(F.col("url").alias("content")).union(links.select("content")), "urls", "url_id", batch)
        postings = fresh.select("page_id", F.inline("postings"))
        self._extend(postings.select(F.col("word").alias("content")), "words", "word_id", batch)
        ids = self._rows("urls").filter(F.col("batch") <= batch).select("url_id", "content")
        pages = fresh.join(ids.withColumnRenamed("content", "url"), "url")
        self._write(pages.select("page_id", "url", "url_id", "mod_time", "size", "plaintext", "title", "key"), "pages", batch)
        self._write(links.join(ids, "content").select("page_id", "url_id"), "links", batch)
        self._write(postings.select("field", "page_id", "word", "positions", "frequency", "tf_normalized").sortWithinPartitions("field", "word"), "postings", batch)
        self._write(fresh.select("page_id", F.inline("rejected")), "rejected", batch)
        return fresh.count()

    def read(self) -> Index:
        """The tables as they stand: searching filters postings by word first, then by the winners."""
        won = self._winners(self._rows("pages")).select("page_id", "batch")
        columns = lambda table: [part.split()[0] for part in self.TABLES[table].split(", ")]
        now = lambda table: self._rows(table).join(won, ["page_id", "batch"], "left_semi").select(*columns(table))
        every = lambda table: self._rows(table).drop("batch")
        return Index(every("urls"), now("pages").drop("url", "key"), now("links"), every("words"), now("postings"), now("rejected"))


def search_stream(spark: SparkSession, source: str, path: str, checkpoint: str, schema: str = "page_id long, url string, html string", files: int = 16):
    """Read new page files from ``source`` as a stream into the incremental index under ``path``."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return pages.writeStream.foreachBatch(lambda batch, i: IncrementalIndex(spark, path).add(parse_pages(batch), i) and None).option("checkpointLocation", checkpoint)
