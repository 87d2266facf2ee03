"""Line deduplication over levelled sorted runs of line hashes.

A *run* is a table of (128-bit line hash, number of documents), bucketed and sorted by hash. Batches of documents are
numbered as they arrive, and a run covers a stretch of batches. A new batch is reduced to one count per line hash and
merge-anti-joined with each run's lines that are frequent there already: their fate is settled, so they are not stored
again. What is left is a run of its own. When ``fanout`` runs of one level stand side by side they are merged into one
run of the next level. Runs of one ledger have the same buckets, so both merges read files as they lie, without a
shuffle. At the end the runs are merged once; lines found in at least ``min_docs`` documents lose all their places in
every document.

A ledger is its folder: a run counts once Spark has committed it, its name says what it covers, and a run that a larger
one covers is ignored, so that a ledger can be opened again after any failure, and a batch that was added is not added
twice.

Defined cases: null or empty text is one empty line; the key of an empty line has no code points and is never
dropped; every row counts as a document, so repeated rows count once each; ``doc_id`` may be null or repeated (rows
are matched by a hash of id and text, and two rows that met in one key could only share lines that are frequent
anyway); a very long text is one row of lines while it is read, and many rows of hashes after; a line that all
documents hold is one of few hot keys and joined by broadcast; ties cannot occur, as a line is frequent or not; an
empty table gives an empty result; other columns pass through untouched, but ``n_lines`` and ``n_dropped`` are replaced.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.skew import dealt_join
from ..sources.work import removed, saved, shared_path, tidied
from .common import ASCII_SPACE, committed, map_rows

_KEY = "__line_key"
_HITS = "__line_hits"
_HASH = ["h1", "h2"]


def _keys(text: str | None) -> list[bytes]:
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return [x.strip(ASCII_SPACE).lower() for x in lines]


def _digests(text: str | None) -> set[bytes]:
    return {xxhash.xxh3_128_digest(k) for k in _keys(text) if k}


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_places(docs: DataFrame) -> DataFrame:
    """(__line_key, h1, h2): a row for each distinct line of each document, the key being a hash of id and text."""

    def places(cols):
        key, h = [], []
        for k, text in zip(cols[_KEY].to_pylist(), cols["text"].to_pylist(), strict=True):
            found = list(_digests(text))
            h += found
            key += [k] * len(found)
        return [key, *_halves(h)]

    return map_rows(docs.select(F.xxhash64("doc_id", "text").alias(_KEY), "text"), places, f"{_KEY} long, h1 long, h2 long")


class LineRuns:
    """The levelled runs in a folder. ``add`` takes the lines of one batch, ``counts`` merges what all runs hold."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10, fanout: int = 3, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = path or shared_path(spark, "line-runs")
        found = [m for name in committed(spark, self.path) if (m := re.fullmatch(r"run-(\d+)-(\d+)-b(\d+)", name))]
        spans = [(int(m[1]), int(m[2])) for m in found]
        self.runs = sorted(s for s in spans if not any(a <= s[0] and s[1] <= b and (a, b) != s for a, b in spans))
        self.buckets = int(found[0][3]) if found else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._tables: dict[tuple[int, int], str] = {}

    @property
    def batches(self) -> int:
        """Number of batches added so far, which is the next one's number."""
        return self.runs[-1][1] + 1 if self.runs else 0

    def level(self, run: tuple[int, int]) -> int:
        size, level = run[1] - run[0] + 1, 0
        while size >= self.fanout:
            size, level = size // self.fanout, level + 1
        return level

    def _place(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run-{run[0]:08d}-{run[1]:08d}-b{self.buckets}"

    def read(self, run: tuple[int, int]) -> DataFrame:
        """One run as a bucketed table; the catalogue only names the folder."""
        if run not in self._tables:
            name = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self._place(run)}'")
            self._tables[run] = name
        return self.spark.table(self._tables[run])

    def _write(self, df: DataFrame, run: tuple[int, int]) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = df.select("h1", "h2", "n").repartition(self.buckets, *_HASH)
        dealt.write.mode("overwrite").bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("compression", "zstd").option("path", self._place(run)).saveAsTable(name)
        self._tables[run] = name

    def _forget(self, run: tuple[int, int]) -> None:
        if name := self._tables.pop(run, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Drop the catalogue's names; the folder stays."""
        for run in list(self._tables):
            self._forget(run)

    def add(self, lines: DataFrame, number: int | None = None) -> bool:
        """Add one batch (h1, h2: a row for each document and line). A batch ``number`` that is there already is skipped."""
        number = self.batches if number is None else number
        if number < self.batches:
            return False
        fresh = lines.groupBy(*_HASH).agg(F.count("*").alias("n"))
        for run in self.runs:
            fresh = fresh.join(self.read(run).filter(F.col("n") >= self.min_docs).select(*_HASH).hint("merge"), _HASH, "left_anti")
        self._write(fresh, (number, number))
        self.runs.append((number, number))
        self.compact()
        return True

    def compact(self) -> None:
        """Merge the last runs while ``fanout`` of them are of one level."""
        while len(last := self.runs[-self.fanout :]) == self.fanout and len({self.level(r) for r in last}) == 1:
            merged = (last[0][0], last[-1][1])
            self._write(self._merged(last), merged)
            self.runs[-self.fanout :] = [merged]
            for run in last:
                self._forget(run)
                removed(self.spark, self._place(run))

    def _merged(self, runs: list[tuple[int, int]]) -> DataFrame:
        both = lambda a, b: a.join(b.withColumnRenamed("n", "m").hint("merge"), _HASH, "full").select(*_HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return reduce(both, map(self.read, runs))

    def counts(self) -> DataFrame:
        """(h1, h2, n) over all runs. Lines that were settled early count at least ``min_docs``."""
        return self._merged(self.runs)

    def frequent(self) -> DataFrame:
        """(h1, h2, n) of the lines that the runs prove to stand in ``min_docs`` documents or more."""
        return self.counts().filter(F.col("n") >= self.min_docs)


def _cut(text: str | None, hits) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if hits is None:
        return text or "", len(lines), 0
    kept = [line for line, key in zip(lines, _keys(text), strict=True) if not key or xxhash.xxh3_128_digest(key) not in hits]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


@tidied
def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` with ``text`` cleared of frequent lines, and ``n_lines``, ``n_dropped`` added.

    An input column of either name is replaced. ``batches`` is how many parts the table is fed in. Texts are read twice:
    for the hashes of their lines, which are stored by batch, and to cut them.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", _KEY, _HITS)
    if "doc_id" not in docs.columns or "text" not in docs.columns:
        raise ValueError("documents need doc_id and text")
    held = saved(line_places(docs).withColumn("batch", F.pmod(F.xxhash64(_KEY), F.lit(batches)).cast("int")), "line-places", by="batch")
    runs = LineRuns(spark, min_docs=min_docs, fanout=fanout)
    for i in range(batches):
        runs.add(held.filter(F.col("batch") == i).select(*_HASH))
    frequent = saved(runs.frequent(), "line-frequent")
    runs.close()
    removed(spark, runs.path)
    total = held.count()
    # a count may be low where a batch found the line settled: a hot key is one that is frequent in any single batch
    keys = frequent.select(F.struct(*_HASH).alias("h"), (F.col("n") * batches).alias("__n"))
    hits = dealt_join(held.select(_KEY, F.struct(*_HASH).alias("h")), keys, "h", total * batches).groupBy(_KEY).agg(F.collect_set("h").alias(_HITS))
    # only the keys are joined before this; each text crosses the network once
    both = docs.withColumn(_KEY, F.xxhash64("doc_id", "text")).join(hits, _KEY, "left").drop(_KEY)
    names = docs.columns
    out = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def clean(cols):
        texts, n, d = [], [], []
        found = cols[_HITS]
        flat = found.flatten()
        raw = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1).astype("<i8").tobytes() if len(flat) else b""
        at = 0
        for text, m in zip(cols["text"].to_pylist(), pa.compute.list_value_length(found).to_pylist(), strict=True):
            hits = None
            if m:
                hits = {raw[j : j + 16] for j in range(16 * at, 16 * (at + m), 16)}
                at += m
            kept, lines, dropped = _cut(text, hits)
            texts.append(kept)
            n.append(lines)
            d.append(dropped)
        return [*(pa.array(texts, pa.string()) if c == "text" else cols[c] for c in names), n, d]

    return map_rows(both, clean, out)


def op1_line_dedup(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """Digest per document: doc_id, n_lines, n_dropped, kept_sha256."""
    done = dedup_lines(docs.select("doc_id", "text"), min_docs)

    def digest(cols):
        return [cols["doc_id"], cols["n_lines"], cols["n_dropped"], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in cols["text"].to_pylist()]]

    return map_rows(done, digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT r, i, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM f)) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE key NOT IN (SELECT key FROM f)), '')) AS kept_sha256
      FROM k GROUP BY r)
SELECT d.doc_id, n_lines, n_dropped, kept_sha256 FROM g JOIN d USING (r)
"""
