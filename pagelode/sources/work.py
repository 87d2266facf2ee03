"""Work tables in the folder that driver and executors share, and their removal once nothing reads them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temp folder on a local master; else an error, as
    executors could not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagelode-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Work tables of this process that ``tidied`` may remove.
_made: list[str] = []


def saved(df: DataFrame, name: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, in folders ``by`` a column if one is given.

    Lost executors cost no recomputation. A table written to a ``path`` of the caller's is the caller's to remove.
    """
    spark, schema = df.sparkSession, df.schema
    if path is None:
        path = shared_path(spark, name)
        _made.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table or folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _read_by(df: DataFrame) -> set[str]:
    """Names of the folders that a table is read from."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found: set[str] = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            found |= {roots.apply(k).getName() for k in range(roots.size())}
    return found


def tidied(fn: Callable) -> Callable:
    """Remove the work tables that ``fn`` wrote and that the tables it returns do not read."""

    @wraps(fn)
    def run(*args, **kwargs):
        start = len(_made)
        out = fn(*args, **kwargs)
        frames = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
        if frames:
            keep = set().union(*map(_read_by, frames))
            mine = _made[start:]
            _made[start:] = [p for p in mine if p.rpartition("/")[2] in keep]
            for path in mine:
                if path.rpartition("/")[2] not in keep:
                    removed(frames[0].sparkSession, path)
        return out

    return run
