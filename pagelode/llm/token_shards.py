"""Token-id output with Elias-Fano document boundaries.

Documents are put in ascending id order by a range shuffle; within each range they are encoded and packed into
*segments*: a segment holds the ids of consecutive documents back to back (2 bytes each where the vocabulary allows,
else 4) and the document ends as an Elias-Fano sequence: the low bits of every end packed, the high bits in unary in
a bit vector, with the positions of every 256th one as select samples. The end of document i is read with one select
and one low-bits lookup, so no table of 64-bit offsets is kept; readers of all documents and of single ones both go
through ``select``. A segment is a row of a Parquet dataset, so writing commits atomically, survives lost executors and
works on any store that Spark can write; the least and the greatest id of a segment let Spark skip the others when one
document is asked for. Token counts before each range come from one small row per range.

Defined cases: null or empty text has only the end id; repeated or tied ids stand next to each other, ordered by
text; null ids come first; a very long document may fill a segment alone; an empty table writes no segment and reads
back as no rows; other input columns, also ``start``, ``n_tokens`` or ``ids``, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..sources.work import shared_path
from .common import map_rows
from .tokenizing import bpe

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 0
#: Ids after which a segment is closed at the next document.
SEGMENT_IDS = 1 << 20
_SAMPLE = 256
_SCHEMA = "part int, seq int, first_in_part long, n_ids long, width int, least long, greatest long, docs array<long>, ids binary, universe long, low_bits int, low binary, high binary, samples array<int>"


class EliasFano:
    """A non-decreasing sequence of n values up to ``universe`` in about n * (2 + log2(universe / n)) bits."""

    def __init__(self, n: int, universe: int, low_bits: int, low: bytes, high: bytes, samples: list[int]):
        self.n, self.universe, self.low_bits = n, universe, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n, universe = len(values), int(values[-1]) if len(values) else 0
        k = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(k)) & 1).astype(np.uint8).ravel() if k else np.zeros(0, np.uint8)
        ones = (values >> k) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
        return cls(n, universe, k, pack(low), pack(high), ones[::_SAMPLE].tolist())

    def select(self, i: int) -> int:
        """Value i: the i-th one of the high bits is found from the sample before it, byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = self.samples[i // _SAMPLE], i % _SAMPLE
        byte, bit = divmod(at, 8)
        now = self.high[byte] >> bit << bit
        while (count := now.bit_count()) <= left:
            left -= count
            byte += 1
            now = self.high[byte]
        for _ in range(left):
            now &= now - 1
        one = 8 * byte + (now & -now).bit_length() - 1
        p, k = i * self.low_bits, self.low_bits
        low = int.from_bytes(self.low[p >> 3 : (p + k + 7) >> 3], "little") >> (p & 7) & (1 << k) - 1
        return one - i << k | low

    def span(self, i: int) -> tuple[int, int]:
        """Where stretch i begins and ends: the values i - 1 (0 before the first) and i."""
        return self.select(i - 1) if i else 0, self.select(i)


def _segment(part: int, seq: int, before: int, docs: list, ids: list[bytes], width: int) -> dict:
    ends = np.cumsum([len(x) // 4 for x in ids])
    flat = np.frombuffer(b"".join(ids), "<u4")
    ef = EliasFano.of(ends)
    known = [d for d in docs if d is not None]
    return {
        "part": part, "seq": seq, "first_in_part": before, "n_ids": len(flat), "width": width, "docs": docs,
        "least": min(known, default=None), "greatest": max(known, default=None),
        "ids": flat.astype("<u2").tobytes() if width == 2 else flat.tobytes(),
        "universe": ef.universe, "low_bits": ef.low_bits, "low": ef.low, "high": ef.high, "samples": ef.samples,
    }


def write_shards(docs: DataFrame, path: str | None = None, tokenizer: str = BYTE_BPE, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> str:
    """Encode ``docs`` (doc_id, text) in ascending id order into a dataset of segments; returns its path."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    ship(spark)
    path = path or shared_path(spark, "token-shards")
    kind = _parse_datatype_string(_SCHEMA)
    arrow = to_arrow_schema(kind)
    end = np.asarray([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before, held = TaskContext.get().partitionId(), 0, 0, 0
        enc = bpe(tokenizer)
        width = 2 if enc.lib.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        names: list = []
        ids: list[bytes] = []
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(enc.pack(enc.encode(text.as_py())) + end)
                names.append(name)
                held += len(ids[-1]) // 4
                if held >= segment_ids:
                    yield pa.RecordBatch.from_pylist([_segment(part, seq, before, names, ids, width)], schema=arrow)
                    seq, before, held, names, ids = seq + 1, before + held, 0, [], []
        if names:
            yield pa.RecordBatch.from_pylist([_segment(part, seq, before, names, ids, width)], schema=arrow)

    # ranges by id, then by a hash of the text so that a repeated id can spread
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
    ordered.mapInArrow(pack, kind).write.option("compression", "zstd").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's place and ids (little-endian unsigned 32-bit), from the files.

    With ``doc_id`` only segments that may hold it are read, and only its stretch is taken out of them.
    """
    ship(spark)
    rows = spark.read.schema(_SCHEMA).parquet(path)
    # one number per range: at most as many rows as there were shuffle partitions
    totals = sorted(rows.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n
    if doc_id is not None:
        rows = rows.filter((F.col("least") <= doc_id) & (F.col("greatest") >= doc_id))

    def unpack(cols):
        out: list[list] = [[], [], [], []]
        for part, first, width, docs, raw, universe, k, low, high, samples in zip(
            *(cols[c].to_pylist() for c in ("part", "first_in_part", "width", "docs", "ids", "universe", "low_bits", "low", "high", "samples")), strict=True
        ):
            ends = EliasFano(len(docs), universe, k, low, high, samples)
            wide = np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")
            for i, name in enumerate(docs):
                if doc_id is not None and name != doc_id:
                    continue
                a, b = ends.span(i)
                for o, v in zip(out, (name, base[part] + first + a, b - a, wide[a:b].tobytes()), strict=True):
                    o.append(v)
        return out

    return map_rows(rows, unpack, "doc_id long, start long, n_tokens long, ids binary", step=4)


def op6_token_ids(docs: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    back = read_shards(docs.sparkSession, write_shards(docs, tokenizer=tokenizer))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
