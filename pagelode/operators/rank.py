"""Ranking (A1-A8, P3-P5, R1-R11): candidates, phrase filter, TF-IDF vectors over the query's stems, cosine, title boost.

The query side is a handful of stems, bounded by the query's length and written into the plan as literals, so the
postings scan is filtered by word and the whole search is one aggregation by page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import CONTENT, TITLE, Index
from .query import fold, fold_value, lex, parse

#: Weight of the title's cosine.
TITLE_BOOST = 3.9
#: Digits kept before ordering, so that ties do not hang on the order of summation.
DIGITS = 6


def document_frequency(postings: DataFrame) -> DataFrame:
    """(field, word, df): pages that hold the word in the field."""
    return postings.groupBy("field", "word").agg(F.count("*").alias("df"))


def inverse_frequency(df: DataFrame, n_pages: DataFrame) -> DataFrame:
    """``df`` with idf = log2(N / df), 0 where df is 0; ``n_pages`` has one row and column n."""
    return df.crossJoin(F.broadcast(n_pages)).withColumn("idf", F.when(F.col("df") > 0, F.log2(F.col("n") / F.col("df"))).otherwise(0.0)).drop("n")


def count_pages(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("n"))


def tf_idf(postings: DataFrame, pages: DataFrame) -> DataFrame:
    idf = inverse_frequency(document_frequency(postings), count_pages(pages))
    return postings.join(idf, ["field", "word"]).withColumn("tf_idf", F.col("tf_normalized") * F.col("idf"))


def query_stems(query: str, analyze: Callable[[str], str]) -> tuple[list[str], list[str], list[str]]:
    """Terms, distinct non-empty stems in order, phrases."""
    parsed = parse(lex(query))
    return list(parsed.terms), list(dict.fromkeys(s for t in parsed.terms if (s := analyze(t)))), list(parsed.phrases)


def diagnostics(index: Index, stems: list[str]) -> DataFrame:
    """Long form: field, page_id, word, frequency, tf_normalized, df, idf, tf_idf of the query's stems."""
    postings = index.postings.filter(F.col("word").isin(stems)) if stems else index.postings.filter(F.lit(False))
    return tf_idf(postings.select("field", "page_id", "word", "frequency", "tf_normalized"), index.pages)


def phrase_filter(pages: DataFrame, phrases: list[str]) -> DataFrame:
    """Pages whose folded title or plaintext holds every folded phrase."""
    for phrase in phrases:
        p = F.lit(fold_value(phrase))
        pages = pages.filter(F.contains(fold(F.col("title")), p) | F.contains(fold(F.col("plaintext")), p))
    return pages


def search(index: Index, query: str, analyze: Callable[[str], str]) -> DataFrame:
    """Ranked pages: rank_key order is weight, then magnitude (both descending), then page_id.

    Columns: page_id, cos_content, cos_title, weight, magnitude. Stems that no page holds do not count. Without a known
    stem the result is empty, phrases or not.
    """
    _, stems, phrases = query_stems(query, analyze)
    rows = diagnostics(index, stems)
    known = rows.agg(F.count_distinct("word").alias("k"))
    part = lambda field, x: F.coalesce(F.sum(F.when(F.col("field") == field, x)), F.lit(0.0))
    v = F.col("tf_idf")
    sums = rows.groupBy("page_id").agg(
        part(CONTENT, v).alias("dot_c"), F.sqrt(part(CONTENT, v * v)).alias("norm_c"), part(TITLE, v).alias("dot_t"), F.sqrt(part(TITLE, v * v)).alias("norm_t")
    )
    cos = lambda d, n: F.round(F.when(F.col(n) > 0, F.col(d) / (F.sqrt("k") * F.col(n))).otherwise(0.0), DIGITS)
    scored = sums.crossJoin(F.broadcast(known)).select("page_id", cos("dot_c", "norm_c").alias("cos_content"), cos("dot_t", "norm_t").alias("cos_title"), F.round("norm_c", DIGITS).alias("magnitude"))
    scored = scored.withColumn("weight", F.round(F.col("cos_content") + TITLE_BOOST * F.col("cos_title"), DIGITS + 1))  # exact: one more digit than its parts
    if phrases:
        # texts of candidates only: they are joined before a phrase is looked for
        texts = scored.join(index.pages.select("page_id", "title", "plaintext"), "page_id")
        scored = phrase_filter(texts, phrases)
    return scored.select("page_id", "cos_content", "cos_title", "weight", "magnitude").orderBy(F.desc("weight"), F.desc("magnitude"), "page_id")


def vector_space(index: Index, query: str, analyze: Callable[[str], str], field: str = CONTENT) -> DataFrame:
    """One row per page with a column per stem."""
    _, stems, _ = query_stems(query, analyze)
    rows = diagnostics(index, stems).filter(F.col("field") == field)
    return rows.groupBy("page_id").pivot("word", stems).agg(F.round(F.sum("tf_idf"), DIGITS)).na.fill(0.0)


def idf_of(index: Index, words: list[str], field: str = CONTENT) -> DataFrame:
    """(place, word, df, idf): one row per asked word in order, with zeros for words that no page holds."""
    spark = index.postings.sparkSession
    asked = spark.createDataFrame(list(enumerate(words)), "place long, word string")
    held = index.postings.filter((F.col("field") == field) & F.col("word").isin(words)) if words else index.postings.filter(F.lit(False))
    df = asked.join(document_frequency(held.select("field", "word")).select("word", "df"), "word", "left").na.fill(0, ["df"])
    return inverse_frequency(df, count_pages(index.pages)).select("place", "word", "df", "idf")


def tf_matrix(index: Index, pages: DataFrame, words: list[str], field: str = CONTENT) -> DataFrame:
    """(page_id, place, word, frequency, tf_normalized, tf_idf): a cell for each page and asked word, zero where absent."""
    cells = pages.select("page_id", F.posexplode(F.array(*map(F.lit, words)).cast("array<string>")).alias("place", "word"))
    held = index.postings.filter((F.col("field") == field) & F.col("word").isin(words)) if words else index.postings.filter(F.lit(False))
    full = cells.join(held.select("page_id", "word", "frequency", "tf_normalized"), ["page_id", "word"], "left")
    full = full.join(F.broadcast(idf_of(index, words, field).select("word", "idf").distinct()), "word").na.fill(0)
    return full.select("page_id", F.col("place").cast("long").alias("place"), "word", "frequency", "tf_normalized", (F.col("tf_normalized") * F.col("idf")).alias("tf_idf"))


def explain_terms(index: Index, query: str, analyze: Callable[[str], str], field: str = CONTENT) -> DataFrame:
    """Per term of the query, in order, and page that holds its stem: df, idf, frequency, tf_normalized, tf_idf.

    A term without a stem, or whose stem no page holds in the field, is one row with df and idf 0 and no page.
    """
    terms = list(parse(lex(query)).terms)
    spark = index.postings.sparkSession
    asked = spark.createDataFrame([(i, t, analyze(t)) for i, t in enumerate(terms)], "place long, term string, word string")
    found = diagnostics(index, list({s for t in terms if (s := analyze(t))})).filter(F.col("field") == field)
    rows = asked.join(found, "word", "left")
    return rows.select("place", "term", F.col("word").alias("stem"), F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("idf", F.lit(0.0)).alias("idf"), "page_id", "frequency", "tf_normalized", "tf_idf")
