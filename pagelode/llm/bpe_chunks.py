"""BPE encoding and decoding with content-defined chunk reuse across documents.

A text is cut where a rolling hash of the last 32 bytes has its high bits clear, moved on to the next *safe place* nearby:
a blank after something that is none, which no token crosses (see ``tokenizing``). So documents that share a passage
share its chunks wherever it stands. Chunks are named by 128-bit hashes. A first pass counts them over the whole corpus;
a chunk that occurs more than once is encoded once, by the document of least key that holds it, and its ids are sent to
the documents that share it. Chunks that occur once are encoded where they stand. So every distinct chunk of the corpus
is encoded one time, and only texts that share chunks are shuffled.

A join agrees exactly where both of its sides end at a safe place. Where one does not (no blank in reach), the fragments
on both sides are put together and encoded anew, and the repair reaches on through any chunk without a safe place, until
both of its ends are safe.

Defined cases: null or empty text has no ids and decodes to the empty text; repeated rows repeat, and their chunks are
shared; ties of ownership go to the least key; very long texts are cut like others; a chunk that a third of all
documents hold is a hot key and its ids are broadcast; other columns pass through ``encode_documents``, but ``ids``,
``n_tokens`` and ``decoded`` are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import dealt_join
from ..sources.work import saved, tidied
from .common import map_rows
from .tokenizing import Bpe, bpe

WORD_BPE = "word_bpe_49k.json"
#: Mean chunk length in bytes is two to this power.
CHUNK_BITS = 9
#: Bytes within which a cut moves on to a safe place.
REACH = 64
#: Documents with shared chunks up to which their keys are broadcast (8 bytes each); beyond, all texts are shuffled to their lists.
BROADCAST_ROWS = 200_000

#: The hash's byte table comes from a multiplicative rule.
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def chunk_ends(data: bytes, bits: int = CHUNK_BITS) -> np.ndarray:
    """Byte offsets at which a chunk ends, without the text's end: sums over 32 bytes, doubled five times."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            later = h[k:] + (h[:-k] << np.uint32(k))
            h = np.concatenate([h[:k], later])
    # bits 32-bits.. of the sum mix all 32 bytes; the low ones see only the last few
    at = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    return at[at < len(data)]


def chunks(text: str, bits: int = CHUNK_BITS) -> list[str]:
    """The text's chunks; a cut inside a character moves to its end."""
    data = text.encode("utf-8", "surrogatepass")
    ends = chunk_ends(data, bits)
    if not len(ends):
        return [text]
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | (raw == 10) | (raw == 9) | (raw == 13)
    safe = np.append(np.flatnonzero(blank[1:] & ~blank[:-1]) + 1, len(data) + REACH)
    after = safe[np.searchsorted(safe, ends)]
    ends = np.where((after - ends <= REACH) & (after < len(data)), after, ends)
    if len(data) != len(text):
        lead = (raw & 0xC0) != 0x80
        ends = np.cumsum(lead)[ends - 1]
        ends = ends[ends < len(text)]
    cuts = [0, *np.unique(ends).tolist(), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def chunk_name(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass"))


#: A safe place; beyond ASCII, characters that count as blanks somewhere are none before it.
_SAFE = re.compile(r"(?<=\S)[ \n\t\r]")
_BLANKS = " \n\t\r"


class ChunkEncoder:
    """Encodes texts by chunks to lists of ids."""

    def __init__(self, model: Bpe, bits: int = CHUNK_BITS):
        self.model, self.bits = model, bits
        self.encoded = self.reused = self.repairs = 0

    @staticmethod
    def span(chunk: str, start: bool, end: bool) -> tuple[int, int] | None:
        """The outer safe places of a chunk, whose ends are safe if said so (None: fewer than two places)."""
        n = len(chunk)
        if start and end:
            return 0, n
        inner = [m.start() for m in _SAFE.finditer(chunk)]
        places = [0] * start + inner + [n] * end
        return (places[0], places[-1]) if len(places) > 1 else None

    def middle(self, chunk: str) -> list[int]:
        """Ids between the outer safe places of a chunk, its ends taken to be safe as far as its own text allows."""
        at = self.span(chunk, *claims(chunk))
        self.encoded += 1
        return self.model.encode(chunk[slice(*at)]) if at else []

    def encode(self, text: str | None, known: dict[bytes, list[int]] | None = None) -> list[int]:
        """The ids of a text; those of ``known`` chunks, by name, are taken as they are."""
        if not text:
            return []
        parts = chunks(text, self.bits)
        out: list[int] = []
        open_ = ""  # text after the last safe place
        for i, chunk in enumerate(parts):
            start, end = claims(chunk)
            first = start and (i == 0 or not parts[i - 1][-1].isspace())
            last = end and (i == len(parts) - 1 or parts[i + 1][0] in _BLANKS)
            at = self.span(chunk, first, last)
            if at is None:
                open_ += chunk
                continue
            if fragment := open_ + chunk[: at[0]]:
                self.repairs += 1
                out += self.model.encode(fragment)
            if (first, last) == (start, end):  # both joins agree with what the chunk was encoded for
                ids = known.get(chunk_name(chunk)) if known else None
                self.reused += ids is not None
                out += self.middle(chunk) if ids is None else ids
            else:
                self.repairs += 1
                out += self.model.encode(chunk[slice(*at)])
            open_ = chunk[at[1] :]
        return out + (self.model.encode(open_) if open_ else [])


def claims(chunk: str) -> tuple[bool, bool]:
    """Whether a chunk's ends may be safe places, by its own text."""
    return chunk[0] in _BLANKS, not chunk[-1].isspace()


@cache
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(bpe(path))


def _halves(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def chunk_uses(texts: DataFrame) -> DataFrame:
    """(k, h, n): how often each text, by key, holds each chunk, by name (struct of h1, h2)."""

    def count(cols):
        key, names, n = [], [], []
        for k, text in zip(cols["k"].to_pylist(), cols["text"].to_pylist(), strict=True):
            found: dict[bytes, int] = {}
            for chunk in chunks(text) if text else []:
                name = chunk_name(chunk)
                found[name] = found.get(name, 0) + 1
            key += [k] * len(found)
            names += found.keys()
            n += found.values()
        return [key, *_halves(names), n]

    rows = map_rows(texts.select("k", "text"), count, "k long, h1 long, h2 long, n long")
    return rows.select("k", F.struct("h1", "h2").alias("h"), "n")


def _listed(texts: DataFrame, lists: DataFrame, key: str, n: int) -> DataFrame:
    """``texts`` joined to the ``n`` keys that have a list; only their texts are shuffled while the keys may be broadcast."""
    if n <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(lists.select(key)), key, "left_semi")
    return texts.join(lists.hint("merge"), key)


@tidied
def shared_chunks(texts: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """(k, known): for each text that holds chunks which occur twice or more, their names and ids, each encoded once."""
    uses = saved(chunk_uses(texts), "bpe-uses")
    shared = uses.groupBy("h").agg(F.sum("n").alias("n"), F.min("k").alias("owner"), F.count("*").alias("__n")).filter("n > 1").drop("n")
    shared = saved(shared, "bpe-shared")
    owned = shared.groupBy(F.col("owner").alias("k")).agg(F.collect_list("h").alias("wanted"))

    def encode(cols):
        enc = chunk_encoder(tokenizer)
        names, ids = [], []
        flat = cols["wanted"].flatten()
        raw = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1).astype("<i8").tobytes() if len(flat) else b""
        at = 0
        for text, n in zip(cols["text"].to_pylist(), pa.compute.list_value_length(cols["wanted"]).to_pylist(), strict=True):
            left = {raw[j : j + 16] for j in range(16 * at, 16 * (at + n), 16)}
            at += n
            for chunk in chunks(text):
                if (name := chunk_name(chunk)) in left:
                    left.remove(name)
                    names.append(name)
                    ids.append(enc.model.pack(enc.middle(chunk)))
        return [*_halves(names), pa.array(ids, pa.binary())]

    owned = saved(owned, "bpe-owned")
    owners = _listed(texts, owned, "k", owned.count()).select("text", "wanted")
    done = map_rows(owners, encode, "h1 long, h2 long, ids binary").select(F.struct("h1", "h2").alias("h"), "ids")
    # texts that repeat with their ids own the same chunks
    done = saved(done.groupBy("h").agg(F.first("ids").alias("ids")), "bpe-encoded")
    known = dealt_join(uses.select("k", "h"), done.join(shared.select("h", "__n"), "h"), "h", uses.count())
    return saved(known.groupBy("k").agg(F.collect_set(F.struct("h.h1", "h.h2", "ids")).alias("known")), "bpe-known")


def _encoded(docs: DataFrame, tokenizer: str, finish, schema) -> DataFrame:
    """``finish(cols, ids)`` over all rows of ``docs``, whose texts are encoded with the shared chunks."""
    keyed = docs.withColumn("__k", F.xxhash64("doc_id", "text"))
    lists = shared_chunks(keyed.select(F.col("__k").alias("k"), "text"), tokenizer).withColumnRenamed("k", "__k")

    def run(cols):
        enc = chunk_encoder(tokenizer)
        rows = []
        known_of = cols["known"].to_pylist() if "known" in cols else [None] * len(cols["text"])
        for text, known in zip(cols["text"].to_pylist(), known_of, strict=True):
            told = {np.array([r["h1"], r["h2"]], "<i8").tobytes(): np.frombuffer(r["ids"], "<u4").tolist() for r in known} if known else None
            rows.append(enc.encode(text, told))
        return finish(cols, enc.model, rows)

    n = lists.count()
    if n > BROADCAST_ROWS:
        return map_rows(keyed.join(lists, "__k", "left"), run, schema, step=256)
    # only texts that share chunks are shuffled to their lists
    some = F.broadcast(lists.select("__k"))
    apart = keyed.join(some, "__k", "left_anti")
    joint = _listed(keyed, lists, "__k", n)
    return map_rows(apart, run, schema, step=256).unionByName(map_rows(joint, run, schema, step=256))


def encode_documents(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit), ``n_tokens`` and ``decoded``; such input columns are replaced."""
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    docs = docs.drop("ids", "n_tokens", "decoded", "known", "__k")
    names = docs.columns
    out = StructType([*docs.schema.fields, StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("decoded", StringType())])

    def finish(cols, model, rows):
        return [*(cols[c] for c in names), [model.pack(r) for r in rows], [len(r) for r in rows], [model.decode(r) for r in rows]]

    return _encoded(docs, tokenizer, finish, out)


def digest_documents(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def finish(cols, model, rows):
        told = [hashlib.sha256(model.pack(r)).hexdigest() for r in rows]
        return [cols["doc_id"], [len(r) for r in rows], told, [hashlib.sha256(model.decode(r).encode("utf-8", "surrogatepass")).hexdigest() for r in rows]]

    return _encoded(docs.select("doc_id", "text"), tokenizer, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_roundtrip(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    return digest_documents(docs, tokenizer)
