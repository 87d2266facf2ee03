"""Benchmark decontamination over a distributed positional inverted index.

The index stores the postings of all words of the training documents: (term, document, position), term being the
64-bit hash of a word. It is dealt by documents: each input partition is tokenized, exploded and sorted by term where it
lies and becomes one file, so that building it moves no row between machines. A document is one more row with a null
term, which holds its id, its keys and its number of words. An index is written once and serves any test set, phrase or
proximity search.

Test items are read as windows of ten consecutive words. The frequencies of the test terms are read from the index, and
each window is looked up from its rarest term: its postings, adjusted by the term's offset, are intersected with those
of the second rarest one, and the alignments (item, document, shift) that are left with the lists of all other terms
around them. Stretches of consecutive agreeing terms as long as a window are exact occurrences. Everything is DataFrame
functions, and joins are keyed by (document, position), so that neither a frequent passage nor a long document meets in
one task.

Words are lower-cased A-Z only. Full lower-casing is used where it gives the same text.

Defined cases: null or empty texts have no words; an item of fewer than ten words is one window, of none is no item;
repeated items count once and items with a null id mark words but are not listed; documents are numbered inside the
index, so null and repeated ids are safe; a very long text is one row of words while it is read, then rows of postings;
ties of frequency go to the smaller hash, then the earlier place; empty tables give no hits; other columns, also
``n_words``, ``term`` or ``doc``, are not touched. Two words of one 64-bit hash are the only way to err.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import dealt_join
from ..sources.work import saved, tidied
from .common import sha256_hex

WINDOW = 10
#: Rows of test terms, anchors and candidates up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: Column) -> Column:
    """A-Z in lower case; ``lower`` does the same, faster, unless other capitals occur."""
    return F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def _lead_tail() -> tuple[Column, Column]:
    """Only the first and the last piece of a split can be empty."""
    lead = F.when(F.get("__pieces", F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size("__pieces") > 1) & (F.element_at("__pieces", -1) == ""), 1).otherwise(0)
    return lead, tail


def _worded(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the column ``words``."""
    lead, tail = _lead_tail()
    pieces = F.split(_lowered(F.coalesce(F.col(text), F.lit(""))), _GAP, -1)
    return df.withColumn("__pieces", pieces).withColumn("words", F.slice("__pieces", lead + 1, F.size("__pieces") - lead - tail)).drop("__pieces")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _joined(rows: DataFrame, few: DataFrame, key: str, n_few: int, total: int) -> DataFrame:
    """``rows`` joined to ``few``, which has ``__n``, how many of the ``total`` rows hold its key."""
    return rows.join(F.broadcast(few.drop("__n")), key) if n_few <= BROADCAST_ROWS else dealt_join(rows, few, key, total)


def document_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of id and text, by which rows of a table are matched with documents of its index."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2")]


def index_rows(docs: DataFrame) -> DataFrame:
    """The rows of the index of ``docs`` in order of their terms.

    The columns of a document are one struct while rows are sorted, as a posting, which has none of them, then takes a
    word of memory for all and not one for each.
    """
    keyed = _worded(docs.select("doc_id", "text")).select(F.monotonically_increasing_id().alias("doc"), F.struct("doc_id", *document_keys(docs), F.size("words").cast("long").alias("n_words")).alias("own"), "words")
    spread = keyed.select("doc", "own", F.posexplode(F.array_prepend("words", F.lit(None).cast("string"))).alias("p", "word"))
    own = F.col("p") == 0
    rows = spread.select(F.when(~own, F.xxhash64("word")).alias("term"), "doc", (F.col("p") - 1).alias("pos"), F.when(own, F.col("own")).alias("own"))
    return rows.sortWithinPartitions("term").select("term", "doc", "pos", "own.*")


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text), written under the shared folder or to ``path``, as a table.

    Columns: term, doc, pos of postings; where term is null doc_id, k1, k2 and n_words of a document. The numbers of
    documents come from the task that writes both kinds of rows, so a repeated task stays consistent.
    """
    return saved(index_rows(docs), "train-index", path)


def documents(index: DataFrame) -> DataFrame:
    """(doc, doc_id, k1, k2, n_words) of the indexed documents."""
    return index.filter("term IS NULL").select("doc", "doc_id", "k1", "k2", "n_words")


def postings(index: DataFrame) -> DataFrame:
    return index.filter("term IS NOT NULL").select("term", "doc", "pos")


def test_terms(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, at, term): the terms of each distinct item with words, ``item`` being its key."""
    items = _worded(benchmark.select("item_id", "text").distinct()).filter(F.size("words") > 0)
    key = F.xxhash64("item_id", "text").alias("item")
    return items.select(key, "item_id", F.size("words").alias("n"), F.posexplode("words").alias("at", "word")).select("item", "item_id", "n", "at", F.xxhash64("word").alias("term"))


def anchors(index: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, n, term, at, term2, at2, __n): the two rarest terms of each window, where all its terms occur.

    ``__n`` is the first one's number of postings. Windows that share both terms are one row.
    """
    vocabulary = saved(terms.select("term").distinct(), "test-vocabulary")
    wanted = _small(vocabulary, vocabulary.count())
    cf = saved(postings(index).select("term").join(wanted, "term").groupBy("term").agg(F.count("*").alias("cf")), "test-frequencies")
    placed = terms.join(_small(cf, cf.count()), "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    ahead = W.partitionBy("item").orderBy("at").rowsBetween(0, window - 1)
    ranked = F.array_sort(F.collect_list(F.struct("cf", "term", "at")).over(ahead))
    windows = placed.withColumn("r", ranked).filter(F.col("at") <= F.greatest(F.col("n") - window, F.lit(0)))
    one, two = F.get("r", F.lit(0)), F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)))
    chosen = windows.select("item", "n", one.alias("x"), two.alias("y")).filter("x.cf > 0")
    return chosen.select("item", "n", F.col("x.term").alias("term"), F.col("x.at").alias("at"), F.col("y.term").alias("term2"), F.col("y.at").alias("at2"), F.col("x.cf").alias("__n")).distinct()


@tidied
def phrase_matches(index: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, doc, start, end): stretches of document words that windows of an item cover."""
    spread = saved(terms, "test-terms")
    pairs = saved(anchors(index, spread, window), "test-anchors")
    n_pairs, lists = pairs.count(), postings(index)
    total = lists.count()
    # the rarest list, shifted to where the second rarest term must stand
    first = _joined(lists, pairs, "term", n_pairs, total).select("item", "n", "at", "doc", (F.col("pos") - F.col("at")).alias("shift"), F.col("term2").alias("term"), (F.col("pos") - F.col("at") + F.col("at2")).alias("pos"))
    first = saved(first, "test-candidates")
    seconds = pairs.select(F.col("term2").alias("term")).distinct()
    list2 = lists.join(_small(seconds, n_pairs), "term", "left_semi")
    both = list2.join(_small(first, first.count()), ["term", "doc", "pos"]).select("item", "n", "at", "doc", "shift").distinct()
    both = saved(both, "test-alignments")
    # all lists around the anchors of what is left
    near = F.explode(F.sequence(F.greatest(F.col("at") - (window - 1), F.lit(0)), F.least(F.col("at") + (window - 1), F.col("n") - 1))).alias("at")
    expected = both.select("item", "n", "doc", "shift", near).distinct()
    expected = expected.join(_small(spread.select("item", "at", "term"), spread.count()), ["item", "at"]).withColumn("pos", F.col("shift") + F.col("at")).filter("pos >= 0")
    held = both.select("doc").distinct()
    lists = lists.join(_small(held, both.count()), "doc", "left_semi").join(_small(spread.select("term").distinct(), spread.count()), "term", "left_semi")
    agree = lists.join(expected, ["term", "doc", "pos"]).select("item", "n", "doc", "shift", "at")
    # consecutive terms of one alignment
    along = W.partitionBy("item", "doc", "shift").orderBy("at")
    runs = agree.withColumn("run", F.col("at") - F.row_number().over(along)).groupBy("item", "n", "doc", "shift", "run").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    whole = runs.filter(F.col("b") - F.col("a") + 1 >= F.least(F.lit(window), F.col("n")))
    return whole.select("item", "doc", (F.col("shift") + F.col("a")).alias("start"), (F.col("shift") + F.col("b") + 1).alias("end"))


def proximity_matches(index: DataFrame, first: str, second: str, within: int) -> DataFrame:
    """(doc, pos, other): places of any two words at most ``within`` words apart, from their two lists.

    Lists are joined by document and stretches of ``within`` positions, so that a long document is many keys.
    """
    term = lambda word: F.xxhash64(F.lit(word))
    cell = lambda pos: F.floor(pos / within)
    a = postings(index).filter(F.col("term") == term(first)).select("doc", "pos", cell(F.col("pos")).alias("cell"))
    b = postings(index).filter(F.col("term") == term(second)).select("doc", F.col("pos").alias("other"))
    b = b.select("doc", "other", F.explode(F.array(*(cell(F.col("other")) + k for k in (-1, 0, 1)))).alias("cell"))
    gap = F.abs(F.col("pos") - F.col("other"))
    return a.join(b, ["doc", "cell"]).filter((gap <= within) & (gap > 0)).select("doc", "pos", "other")


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, n_hit, items) of the contaminated documents."""
    terms = test_terms(benchmark)
    found = saved(phrase_matches(index, terms, window), "test-matches")
    places = found.select("doc", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).distinct()
    hits = places.groupBy("doc").agg(F.count("*").alias("n_hit"))
    names = terms.select("item", "item_id").distinct()
    listed = found.select("doc", "item").distinct().join(names, "item").groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return hits.join(listed, "doc")


@tidied
def op3_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated; all read from the index."""
    index = build_index(docs)
    hits = saved(matches(index, benchmark), "test-hits")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return documents(index).join(_small(hits, hits.count()), "doc", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        sha256_hex(F.array_join(items, ",")).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


@tidied
def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of any item, with the columns they came with."""
    index = build_index(docs)
    hits = saved(documents(index).join(matches(index, benchmark).select("doc"), "doc").select("k1", "k2").distinct(), "test-hits")
    rows = docs.select(*document_keys(docs), F.struct(*docs.columns).alias("__doc"))
    return rows.join(_small(hits, hits.count()), ["k1", "k2"], "left_anti").select("__doc.*")


OP3_SQL = r"""
WITH lo AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM it WHERE len(w) > 0)),
dw AS (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS gram
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM lo, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT r, s, dw.n, item_id FROM dw JOIN iw ON dw.gram = iw.gram AND dw.n = iw.n),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS q FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lo LEFT JOIN p USING (r) LEFT JOIN i USING (r)
"""
