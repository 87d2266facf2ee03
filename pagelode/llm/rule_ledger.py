"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row keeps the measurements and one failure bit per rule and is
stored; a *policy* is a named, versioned mask over those bits, so policies are applied, compared and ablated later with
bitwise operations on the stored ledger alone, without reading a text again. All of it is DataFrame functions, in one
pass without a shuffle.

Defined cases: a null or empty text has no words and fails the base rule; a text of fewer than three words has no
3-word window; repeated rows are judged alike, whatever their ids; a very long text is one row, read by one task; no
rule ranks, so ties cannot occur; other columns pass through ``judge`` untouched (an input column named like an added
one is replaced); an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import saved

_SPACE = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"

#: Ordered rules: name and failure condition over the measurements. The place in the list is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 80 * n_text_lines"),
    ("long_words", "word_chars > 40 * n_words"),
    ("short_words", "2 * word_chars < 3 * n_words"),
    ("many_words", "n_words > 1000000"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept if none of them failed."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
#: The default: the base rules, and only failures that prose of any language hardly shows.
DEFAULT = Policy("default", 1, ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "short_words"))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_text_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more."""
    last = F.size(words) - 3
    gram = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))  # noqa: E731  words hold no space
    prints = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    # equal neighbours after a sort are the repeated windows; their places are then merged
    ordered = F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(gram(i).alias("g"), i.alias("i"))))

    def places(rows: Column) -> Column:
        same = lambda j, k: F.get(rows, j)["g"] == F.get(rows, k)["g"]
        found = F.transform(
            F.sequence(F.lit(0), F.size(rows) - 1),
            lambda j: F.when(F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)), F.get(rows, j)["i"]),
        )
        return F.array_sort(F.filter(found, lambda p: p.isNotNull()))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    # a one-element transform binds the sorted array to a name, so that it is computed once
    exact = F.get(F.transform(F.array(ordered), lambda rows: covered(places(rows))), F.lit(0))
    no_repeat = F.get(F.transform(F.array(prints), lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0))
    return F.when(F.size(words) < 3, 0).when(no_repeat, 0).otherwise(exact)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of ``MEASURES``."""
    t, trimmed = F.coalesce(F.col(text), F.lit("")), "__trimmed"
    docs = docs.drop(*MEASURES, "fail_bits", "__words", "__lines", trimmed)
    blanks = F.lit(_BLANKS)
    return (
        docs.withColumns({trimmed: F.btrim(t, blanks), "__lines": F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, blanks) != "")})
        .withColumn("__words", F.when(F.col(trimmed) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(trimmed), _SPACE + "+", -1)))
        .withColumns(
            {
                "n_words": F.size("__words").cast("long"),
                "word_chars": F.length(F.array_join("__words", "")).cast("long"),
                "n_symbols": (F.size(F.split(t, r"[#*$%&|<>]", -1)) - 1).cast("long"),
                "n_text_lines": F.size("__lines").cast("long"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                "n_repeat_words": _repeat_words(F.col("__words")).cast("long"),
            }
        )
        .drop("__words", "__lines", trimmed)
    )


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """The ledger: ``docs`` with measurements and ``fail_bits``, every rule evaluated once.

    The row number in it keeps the optimizer from moving a later filter below the measurements, which would repeat them.
    """
    bits = sum((F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, cond) in enumerate(RULES)), F.lit(0))
    return measure(docs, text).withColumn("fail_bits", F.when(F.monotonically_increasing_id() >= 0, bits.cast("long")))


def store(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The ledger of ``docs``, with their other columns but the text, written to the shared folder or to ``path`` and read back."""
    return saved(judge(docs, text).drop(text), "quality-ledger", path)


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(ledger: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that are kept without it.

    The ledger shrinks to one count per bit pattern first, so its size does not matter.
    """
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules))).alias("r")
    at = F.col("bits").bitwiseAND(F.col("r.bit"))
    return (
        patterns.select("bits", "n", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(at != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("bits") - at == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
            F.bit_or("bits").alias("seen_bits"),
        )
    )


def verdicts(ledger: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """``ledger`` with one boolean column ``<name>_v<version>`` for each policy."""
    return ledger.withColumns({f"{p.name}_v{p.version}": passes(p) for p in policies})


def keep_quality(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The documents that a policy keeps, with the columns they came with.

    They are stored beside their ledger rows, so that the policy is applied without a join.
    """
    packed = docs.select(F.col("text").alias("__text"), F.struct(*docs.columns).alias("__doc"))
    return store(packed, "__text").filter(passes(policy)).select("__doc.*")


def op10_quality_rules(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Per document: the base measurements, ``base_failed`` and ``kept``, then the ledger's bits."""
    return store(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE)).alias("base_failed"), passes(policy).alias("kept"), "n_text_lines", "fail_bits",
    )


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM q) GROUP BY r),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        n_symbols::BIGINT AS n_symbols, len(ls)::BIGINT AS n_text_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w JOIN d USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 80 * n_text_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * word_chars < 3 * n_words THEN 32 ELSE 0 END
        + CASE WHEN n_words > 1000000 THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
  (fail_bits & 63) = 0 AS kept, n_text_lines, fail_bits FROM b
"""
