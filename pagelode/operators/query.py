"""Query language (Q1-Q6): tokens, phrases and history."""

from __future__ import annotations

import sys
import time
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import saved

HISTORY = "user string, seq long, query string"


class Token(NamedTuple):
    type: str  # "term" or "phrase"
    value: str


@dataclass(frozen=True)
class ParsedQuery:
    terms: tuple[str, ...]
    phrases: tuple[str, ...]


def lex(query: str) -> list[Token]:
    """Quoted stretches are phrases and, split at spaces, terms as well; an open quote makes the rest one term."""
    out: list[Token] = []
    pieces = query.split('"')
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            out += [Token("term", t) for t in piece.split(" ") if t]
        elif i == len(pieces) - 1:
            out += [Token("term", piece)] if piece else []
        else:
            out += [Token("phrase", piece), *(Token("term", t) for t in piece.split(" "))]
    return out


def parse(tokens: list[Token]) -> ParsedQuery:
    return ParsedQuery(tuple(t.value for t in tokens if t.type == "term"), tuple(t.value for t in tokens if t.type == "phrase"))


def lex_column(queries: DataFrame, column: str = "query") -> DataFrame:
    """``queries`` with arrays ``terms`` and ``phrases``, by expressions alone."""
    pieces = F.transform(F.split(column, '"', -1), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    last = F.size(F.split(column, '"', -1)) - 1
    phrase = lambda x: (x["i"] % 2 == 1) & (x["i"] < last)
    words = lambda x: F.when(phrase(x), F.split(x["p"], " ", -1)).when(
        x["i"] % 2 == 1, F.filter(F.array(x["p"]), lambda t: t != "")
    ).otherwise(F.filter(F.split(x["p"], " ", -1), lambda t: t != ""))
    return queries.withColumns({"terms": F.flatten(F.transform(pieces, words)), "phrases": F.transform(F.filter(pieces, phrase), lambda x: x["p"])})


def merge_history(history: DataFrame) -> DataFrame:
    """(user, query): each user's queries in order, joined by spaces (Q6); ``history`` has user, seq, query."""
    rows = history.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("seq", "query"))).alias("q"))
    return rows.select("user", F.array_join(F.transform("q", lambda x: x["query"]), " ").alias("query"))


def delete_from_history(history: DataFrame, query: str) -> DataFrame:
    """Each user's history without the first entry that equals ``query``."""
    first = history.filter(F.col("query") == query).groupBy("user").agg(F.min("seq").alias("seq"))
    return history.join(first, ["user", "seq"], "left_anti")


def remember(spark: SparkSession, path: str, query: str, user: str = "") -> None:
    """Append a query to the history kept beside an index (W6); an empty one is ignored. Its place is the clock's microsecond."""
    if query:
        spark.createDataFrame([(user, time.time_ns() // 1000, query)], HISTORY).coalesce(1).write.mode("append").parquet(f"{path}/history")


def history(spark: SparkSession, path: str, user: str = "") -> DataFrame:
    """(seq, query) of a user, oldest first; empty if nothing was asked yet."""
    try:
        rows = spark.read.schema(HISTORY).parquet(f"{path}/history")
    except AnalysisException:
        return spark.createDataFrame([], HISTORY).select("seq", "query")
    return rows.filter(F.col("user") == user).select("seq", "query").orderBy("seq")


def completions(past: DataFrame, start: str, k: int = 10) -> DataFrame:
    """(query): the last ``k`` different past queries (seq, query) that begin with ``start``, newest first."""
    found = past.filter(F.col("query").startswith(start)).groupBy("query").agg(F.max("seq").alias("seq"))
    return found.orderBy(F.desc("seq"), "query").limit(k).select("query")


def compact_history(spark: SparkSession, path: str) -> None:
    """Fold the history's small files into one."""
    old = spark.read.schema(HISTORY).parquet(f"{path}/history").inputFiles()
    if len(old) > 1:
        rows = spark.read.schema(HISTORY).parquet(*old).coalesce(1).sortWithinPartitions("user", "seq")
        saved(rows, "history").write.mode("overwrite").parquet(f"{path}/history")


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case characters that case folding changes further: to one character, and to several."""
    changed = {c: f for c in map(chr, range(sys.maxunicode + 1)) if c.lower() == c and (f := c.casefold()) != c}
    return {c: f for c, f in changed.items() if len(f) == 1}, {c: f for c, f in changed.items() if len(f) > 1}


def fold(text: F.Column) -> F.Column:
    """``str.casefold`` by expressions: lower case, then the characters that fold further; the rare long folds only where one occurs."""
    single, several = _folds()
    plain = F.translate(F.lower(text), "".join(single), "".join(single.values()))
    pairs = F.lit(list(several)), F.lit(list(several.values()))
    longer = F.aggregate(F.sequence(F.lit(1), F.lit(len(several))), plain, lambda acc, i: F.replace(acc, F.element_at(pairs[0], i), F.element_at(pairs[1], i)))
    return F.when(plain.rlike(f"[{''.join(several)}]"), longer).otherwise(plain)


def fold_value(text: str) -> str:
    return text.casefold()
