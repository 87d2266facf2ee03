"""Shared helpers of the training-data operators: work folder, Arrow row mapping, ASCII word rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

#: White space of the line and word contracts: space and the five ASCII controls from tab to return.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: A word is a run of ASCII letters and digits and of anything beyond ASCII, seen on UTF-8 bytes.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same words after ASCII lower-casing, as a translation: every other byte becomes a space.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text (null: none)."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables under a folder that Spark has committed, in order; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def map_rows(df: DataFrame, fn: Callable[[dict], Iterator[tuple] | list[tuple]], schema: str, step: int = 512) -> DataFrame:
    """Arrow-batched map: ``fn`` gets a dict of Python columns for at most ``step`` rows and returns output columns."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    ship(df.sparkSession)
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    assert isinstance(kind, StructType)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = fn({n: part.column(i) for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(out, arrow, strict=True)], schema=arrow
                )

    return df.mapInArrow(run, kind)


def sha256_hex(col) -> F.Column:
    return F.sha2(F.encode(col, "UTF-8"), 256)
