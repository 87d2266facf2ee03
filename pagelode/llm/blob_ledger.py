"""Secret scan over an incremental blob ledger.

A *version* is any row with a text: a document, or a file (path) at a commit (revision). Its blob is named by the
SHA-256 of the text. The ledger holds, for every blob, the rule versions it was scanned with and what they found; a scan
reads only blobs for which some rule version is missing, and only with those rules. Findings are joined back to every
version that ever held the blob. All of it is DataFrame functions: offsets come from the lengths of the pieces between
matches.

A ledger is its folder: parts count once Spark has committed them, so that it can be opened again by any session, and a
scan that was cut short is simply done anew.

Defined cases: null text is the empty text; repeated rows share one blob and each get its findings; a hot blob is
reduced to one text before the shuffle and its versions are joined by broadcast; spans that start together stand in the
order of the rules; a very long text is one row, read by one task; an empty table appends a part without rows; other
columns are never touched, but ``findings`` is replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import dealt_join
from ..sources.work import shared_path
from .common import committed, sha256_hex

_FINDING = "array<struct<start:int,kind_at:int,end:int,kind:string>>"
_BLOB = "__blob"


@dataclass(frozen=True)
class Rule:
    """One detector. ``value_group`` and ``min_value``: a match counts if that group is as long.

    ``literal`` stands in every match, so that a text without it need not be searched.
    """

    kind: str
    version: int
    pattern: str
    value_group: int = 0
    min_value: int = 0
    literal: str = ""

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base detectors, in their order. Case folding in Java is ASCII only, as asked for.
#: A run of [0-9a-f] or [A-Z0-9] that is too short holds no longer one, so there the length stands in the pattern.
BASE_RULES = (
    Rule("assign", 1, r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", literal="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
#: No ASCII word character before; word boundaries differ between Java versions.
_START = "(?<![A-Za-z0-9_])"
#: What the method adds.
MORE_RULES = (
    Rule("github", 1, _START + r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}", literal="gh"),
    Rule("slack", 1, _START + r"xox[abprs]-[A-Za-z0-9-]{10,}", literal="xox"),
    Rule("google", 1, _START + r"AIza[0-9A-Za-z_-]{35}", literal="AIza"),
    Rule("stripe", 1, _START + r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}", literal="k_"),
    Rule("jwt", 1, _START + r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", literal="eyJ"),
    Rule("key_block", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", literal="-----BEGIN "),
    Rule("bearer", 1, _START + r"[Bb]earer\x20+([A-Za-z0-9+/_.=-]+)", 1, 20, literal="earer "),
    Rule("url_login", 1, r"://[^\s:/@]{1,128}:([^\s:/@]{1,128})@", 1, 4, literal="://"),
)
RULES = BASE_RULES + MORE_RULES


def _spans(text: Column, rule: Rule, at: int) -> Column:
    """Findings of one rule, leftmost and non-overlapping, in code points."""
    empty = F.array().cast(_FINDING)
    row = F.struct(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("whole"),
        (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value_group)) if rule.min_value else F.array().cast("array<string>")).alias("value"),
        F.split(text, rule.pattern, -1).alias("between"),
    )
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def walk(r: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(r["between"], i))
            end = start + F.length(F.get(r["whole"], i))
            new = F.array(F.struct(start.alias("start"), F.lit(at).alias("kind_at"), end.alias("end"), F.lit(rule.kind).alias("kind")))
            if rule.min_value:
                new = F.when(F.length(F.get(r["value"], i)) >= rule.min_value, new).otherwise(empty)
            return F.struct(end.alias("at"), F.concat(acc["out"], new).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(r["whole"]) - 1), zero, step, lambda acc: acc["out"])

    there = text.rlike(rule.pattern)
    return F.when(F.contains(text, F.lit(rule.literal)) & there if rule.literal else there, F.get(F.transform(F.array(row), walk), F.lit(0))).otherwise(empty)


def _blob(text: str) -> Column:
    return F.unhex(sha256_hex(F.coalesce(F.col(text), F.lit(""))))


class BlobLedger:
    """The ledger of one corpus: a folder of Parquet parts, under the shared folder unless ``path`` is given."""

    schema = f"blob binary, rules array<string>, found {_FINDING}"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "blob-ledger")

    @property
    def parts(self) -> list[str]:
        return [f"{self.path}/{name}" for name in committed(self.spark, self.path)]

    def read(self) -> DataFrame | None:
        """One row for each blob and scan of it."""
        return self.spark.read.schema(self.schema).parquet(*parts) if (parts := self.parts) else None

    def blobs(self) -> DataFrame:
        """(blob, found): everything found in each blob, once, by start and rule order."""
        rows = self.read()
        if len(self.parts) > 1:
            rows = rows.groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
        return rows.select("blob", F.array_sort(F.array_distinct("found")).alias("found"))

    def scan(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is unseen in ``versions``, append it as a part, and return that part."""
        # one text for each blob: first() is reduced on the map side, so that copies do not travel
        blobs = versions.select(_blob(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        wanted = F.array(*(F.lit(r.id) for r in rules))
        known = self.read()
        if known is None:
            todo = blobs.withColumn("rules", wanted)
        else:
            seen = known.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
            none = F.array().cast("array<string>")
            todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(wanted, F.coalesce("seen", none))).filter(F.size("rules") > 0)
        found = F.concat(*(F.when(F.array_contains("rules", r.id), _spans(F.col("text"), r, i)).otherwise(F.array().cast(_FINDING)) for i, r in enumerate(rules)))
        part = f"{self.path}/part-{uuid.uuid4().hex}"
        todo.select("blob", "rules", found.alias("found")).write.option("compression", "zstd").parquet(part)
        return self.spark.read.schema(self.schema).parquet(part)

    def findings(self, versions: DataFrame, text: str = "text") -> DataFrame:
        """``versions``, all scanned before, with the column ``findings``: all spans of its blob by start, then rule order."""
        if not self.parts:
            raise ValueError("nothing was scanned yet")
        keyed = versions.drop("findings", _BLOB).withColumn(_BLOB, _blob(text))
        slim = versions.select(_blob(text).alias(_BLOB))
        copies = slim.groupBy(_BLOB).agg(F.count("*").alias("__n"))
        held = self.blobs().select(F.col("blob").alias(_BLOB), F.col("found").alias("findings")).join(copies, _BLOB)
        return dealt_join(keyed, held, _BLOB, slim.count()).drop(_BLOB)


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op8_secret_scan(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256, spans; the base detectors stand first in ``RULES``.

    A document is a version, its path being its id. A ``ledger`` that has seen some texts before scans only the others.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    versions = docs.select("doc_id", "text")
    ledger.scan(versions)
    slim = versions.select("doc_id", _blob("text").alias(_BLOB))
    copies = slim.groupBy(_BLOB).agg(F.count("*").alias("__n"))
    count = lambda i: F.size(F.filter("f", lambda f: f["kind_at"] == i)).cast("long")
    base = F.filter("f", lambda f: f["kind_at"] < len(BASE_RULES))
    told = ledger.blobs().select(F.col("blob").alias(_BLOB), F.col("found").alias("f")).select(
        _BLOB, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        sha256_hex(_listed(base)).alias("base_sha256"), _listed(F.col("f")).alias("spans"),
    )
    return dealt_join(slim, told.join(copies, _BLOB), _BLOB, slim.count()).drop(_BLOB)
