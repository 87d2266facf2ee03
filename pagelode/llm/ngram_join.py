"""Near-duplicate join on word 5-grams: Jaccard similarity of 0.8 or more, with Bayesian candidate pruning.

Texts with the same words form one *node*. Nodes are signed with 96 MinHash values; nodes that share four values in a
row meet in a bucket. A bucket proposes each node with the bucket's first node and with its neighbour in signature
order, so proposals grow with the nodes and not with the pairs. A proposed pair is compared 16 values at a time and
dropped once the posterior probability that its similarity reaches the threshold falls below a tolerance. Pairs that
are left join candidate groups. A bucket of up to three nodes has proposed all its pairs. The nodes of a larger one that
are not all in one group are joined again by prefix filter: shingles are ordered by how many of these nodes hold them,
and two texts of similarity 0.8 share one of their first ``n - ceil(0.8 n) + 1``. A shingle that few of them start with
proposes all their pairs, a common one puts them in one group (apart where sizes exclude a link).

A group is dealt to blocks of bounded nodes and shingles, and each pair of blocks is a unit of work. Units first get
signatures alone: the same incremental comparison prunes their pairs, and only nodes that keep a partner in a unit have
their text sent there. A unit then verifies the pairs that survived by their full shingle sets; one row per node leaves
it (its verified links and its root in the unit). So every link inside a group is counted, no pair is emitted, and
neither output nor memory of a unit grows with the group.

Keys that hold many rows never meet in one task. Buckets and shingles are dealt by ranges, so that a large one spreads
over several tasks and is put together by its ends. The copies of one text, the centre of a star and one group are
joined by broadcast, as at most ``HOT_KEYS`` keys can be hot, whatever the table's size (``dealt_join``).

Defined cases: words are runs of ASCII letters and digits, lower-cased, and of characters beyond ASCII; a text of one
to four words is one shingle; a text without words (or null) is alone in its class and has no links; repeated rows
and ids are separate documents of one node; a class id is the smallest doc_id in the class (null if it has none);
a very long text is read whole, in a block of its own if need be; other columns, also ``class_id``, ``n_links`` or
``node``, are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import ship
from ..operators.skew import dealt_join
from ..sources.work import saved, tidied
from .common import map_rows, words_of

SHINGLE = 5
#: The threshold as a fraction, so that it is tested in whole numbers.
NUM, DEN = 4, 5
HASHES, BAND = 96, 4
STEP = 16
TOLERANCE = 1e-6
#: Nodes and shingles of a block, on average; blocks are dealt by hash.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Nodes of a bucket up to which its first node and the neighbours propose every pair.
WHOLE = 3
#: Nodes that start with one shingle up to which all pairs are proposed; more make one group.
WIDE = 64
#: Cells in which shingles are counted for their order; any number gives right results.
CELLS = 1 << 22
#: Edges up to which one task finds all components (a few hundred bytes each); beyond, they are found in rounds of joins.
UNION_EDGES = 200_000
#: Nodes up to which the candidate list is broadcast (16 bytes and a few numbers each); beyond, texts are shuffled to it.
BROADCAST_ROWS = 200_000

_rng = np.random.default_rng(20240517)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit fingerprints of the 5-word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > 300_000:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _MUL + h[i : i + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(sh: np.ndarray) -> np.ndarray:
    """MinHash values; 0 to 2**32-1 each."""
    best = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(sh), 4096):
        part = sh[at : at + 4096]
        best = np.minimum(best, ((_A[:, None] * part + _B[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return best


@cache
def least_matches() -> tuple[int, ...]:
    """For each step: fewest equal values of those compared so far at which P(similarity >= 0.8) >= TOLERANCE.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1); its tail is a binomial sum.
    """
    t = NUM / DEN

    def tail(m: int, n: int) -> float:
        return sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))

    return tuple(next(m for m in range(n + 1) if tail(m, n) >= TOLERANCE) for n in range(STEP, HASHES + 1, STEP))


def _signed(docs: DataFrame) -> DataFrame:
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2"), "text")

    def sign(cols):
        nodes, sigs, sizes = [], [], []
        done: dict[bytes, tuple[bytes, int]] = {}
        for text in cols["text"].to_pylist():
            words = words_of(text)
            node, sig, size = None, None, 0
            if words:
                node = xxhash.xxh3_128_digest(b" ".join(words))
                if node not in done:
                    sh = shingles(words)
                    done[node] = signature(sh).tobytes(), len(sh)
                sig, size = done[node]
            nodes.append(node)
            sigs.append(sig)
            sizes.append(size)
        return [cols["doc_id"], cols["k1"], cols["k2"], pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary()), sizes]

    return map_rows(keyed, sign, "doc_id long, k1 long, k2 long, node binary, sig binary, size long")


def _proposed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b), a < b, proposed by buckets, and (key, node) of the buckets that did not propose all their pairs."""
    bands = HASHES // BAND

    def spread(cols):
        names = cols["node"].to_pylist()
        sig = np.frombuffer(b"".join(cols["sig"].to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)
        key = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
        for i in range(BAND):
            key = key * _MUL + sig[:, i::BAND]
            key ^= key >> np.uint64(31)
        after = np.roll(sig[:, ::BAND], -1, axis=1) << np.uint64(31) | np.roll(sig[:, 1::BAND], -1, axis=1) >> np.uint64(1)
        return [key.ravel().view(np.int64), after.ravel().view(np.int64), [n for n in names for _ in range(bands)]]

    rows = map_rows(nodes.select("node", "sig"), spread, "key long, after long, node binary")
    # ranges of (key, signature order, node): a bucket of many nodes spreads over several tasks
    rows = rows.repartitionByRange("key", "after", "node").sortWithinPartitions("key", "after", "node")
    kind = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("key", pa.int64()), ("part", pa.int32())])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key = first = None
        held, count, before = [], 0, b""
        for batch in batches:
            out: list[tuple] = []
            for now, node in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if now != key:
                    if first is None:
                        first = now
                    elif key == first:
                        out += [(n, None, key, part) for n in held]
                    key, held, count = now, [node], 1
                else:
                    out += [(min(other, node), max(other, node), None, None) for other in {held[0], before}]
                    count += 1
                    if count <= WHOLE:
                        held.append(node)
                    else:
                        out += [(n, None, key, None) for n in ([*held, node] if count == WHOLE + 1 else [node])]
                before = node
            yield _batch(out, kind)
        yield _batch([(n, None, key, part) for n in held], kind)

    told = saved(rows.mapInArrow(pair, "a binary, b binary, key long, part int"), "jaccard-proposed")
    # the first and the last bucket of a task may go on in another: at most twice ``WHOLE`` rows a task tell which do
    ends = told.filter("part IS NOT NULL")
    split = ends.groupBy("key").agg(F.min("a").alias("lo"), F.count_distinct("part").alias("n")).filter("n > 1").drop("n")
    split = saved(ends.join(F.broadcast(split), "key").select("key", "lo", F.col("a").alias("node")), "jaccard-split")
    pairs = told.filter("key IS NULL").select("a", "b").unionByName(split.filter("lo <> node").select(F.col("lo").alias("a"), F.col("node").alias("b")))
    crowd = told.filter("key IS NOT NULL AND part IS NULL").select("key", F.col("a").alias("node")).unionByName(split.select("key", "node"))
    return saved(pairs.distinct(), "jaccard-pairs"), crowd


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(kind)], schema=kind)


def surviving(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of two signature tables that the incremental comparison leaves."""
    alive, equal = np.arange(len(x)), np.zeros(len(x), int)
    for i, m in enumerate(least_matches()):
        part = slice(i * STEP, (i + 1) * STEP)
        equal[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
        alive = alive[equal[alive] >= m]
    return alive


def _unpruned(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Proposals (a saved table) that the incremental comparison of MinHash values leaves."""
    sig, total = nodes.select("node", "sig"), pairs.count()
    held = lambda name: pairs.groupBy(F.col(name).alias("node")).agg(F.count("*").alias("__n")).join(sig, "node").toDF(name, "__n", f"sig_{name}")
    both = dealt_join(dealt_join(pairs, held("a"), "a", total), held("b"), "b", total)

    def prune(cols):
        x, y = (np.frombuffer(b"".join(cols[c].to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        alive = pa.array(surviving(x, y))
        return [cols["a"].take(alive), cols["b"].take(alive)]

    return map_rows(both, prune, "a binary, b binary", step=4096)


def _united(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (a, b), which are few, by one task: union and find, the smaller root on top."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    kind = StructType([StructField(n, edges.schema["a"].dataType) for n in ("node", "root")])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        for at in range(0, len(nodes), 1 << 16):
            part = nodes[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, arrow.field(0).type), pa.array([root(x) for x in part], arrow.field(1).type)], schema=arrow)

    return edges.select("a", "b").coalesce(1).mapInArrow(run, kind)


@tidied
def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (a, b), root being the smallest node: alternating large and small stars.

    Up to ``UNION_EDGES`` edges are united by one task, as each round costs the driver the plans of some 16 jobs.
    """
    now = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), name)

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = mark(now)
    if 0 < before[0] <= UNION_EDGES:
        return saved(_united(now), name)
    while before[0]:
        # large star: larger neighbours of u point to the least of u and its neighbours
        two = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = two.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("__n")).withColumn("m", F.least("a", "m"))
        large = saved(dealt_join(two, low, "a", 2 * before[0]).filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct(), name)
        # small star: u and its smaller neighbours point to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        after = small.filter("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y")).union(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        now = saved(after.toDF("a", "b").distinct(), name)
        if (mark_now := mark(now)) == before:
            break
        before = mark_now
    leaves = now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def _shared(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``left`` sets with all sets."""
    sizes = [len(s) for s in sets]
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = counts > 1
    use = common[inverse]
    column = (np.cumsum(common) - 1)[inverse[use]]
    owner = owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((left, len(sets)), np.float64)
    width = 4096
    for at in range(0, int(common.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part[:left] @ part.T
    return out.astype(np.int64)


def _alive(sigs: np.ndarray, size: np.ndarray, left: int, same: bool) -> np.ndarray:
    """Pairs (first ``left`` nodes, all nodes) of a unit that sizes and the incremental comparison leave.

    Within one block these are its pairs in both orders, else the pairs across the two blocks.
    """
    ok = NUM * np.maximum(size[:left, None], size[None]) <= DEN * np.minimum(size[:left, None], size[None])
    ok[np.arange(left), np.arange(left)] = False
    if not same:
        ok[:, :left] = False
    a, b = np.nonzero(ok)
    for at in range(0, len(a), 1 << 16):
        x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        gone = np.ones(len(x), bool)
        gone[surviving(sigs[x], sigs[y])] = False
        ok[x[gone], y[gone]] = False
    return ok


def _verify(nodes: list[bytes], copies: list[int], texts: list[bytes], sigs: np.ndarray, left: int, same: bool) -> list[tuple[bytes, bytes, int]]:
    """The unpruned pairs of one unit, exactly: (node, root in the unit, verified links counted in documents) for each node."""
    sets = [shingles(t.split(b" ")) for t in texts]
    size = np.array([len(s) for s in sets])
    linked = _alive(sigs, size, left, same)
    if linked.sum() > 4 * len(sets):
        shared = _shared(sets, left)
        linked &= DEN * shared >= NUM * (size[:left, None] + size[None] - shared)
    else:
        for a, b in np.argwhere(linked):
            n = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            linked[a, b] = DEN * n >= NUM * (size[a] + size[b] - n)
    weight = np.array(copies)
    links = np.zeros(len(nodes), np.int64)
    links[:left] = linked @ weight
    if not same:
        links += weight[:left] @ linked
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in np.argwhere(linked):
        x, y = root(int(a)), root(int(b))
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(nodes[x], nodes[root(x)], int(links[x])) for x in range(len(nodes))]


def _texts(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, words) of the ``n`` wanted nodes."""

    def name(cols):
        words = [words_of(t) for t in cols["text"].to_pylist()]
        text = [b" ".join(w) for w in words]
        return [pa.array([xxhash.xxh3_128_digest(t) if t else None for t in text], pa.binary()), pa.array(text, pa.binary())]

    named = map_rows(docs.select("text"), name, "node binary, words binary")
    # copies are reduced to one before the shuffle
    return named.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "node", "left_semi").groupBy("node").agg(F.first("words").alias("words"))


def prefix(sh: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first shingles by (level, value), one of which any two texts of similarity 0.8 share; unshared ones left out."""
    at = level[(sh % np.uint64(len(level))).astype(np.int64)]
    first = np.lexsort((sh, at))[: len(sh) - (NUM * len(sh) + DEN - 1) // DEN + 1]
    return sh[first[at[first] > 0]]


def _apart(docs: DataFrame, crowd: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Edges (a, b) between groups for the nodes of large buckets that lie in several groups (None: there are none)."""
    spark = docs.sparkSession
    rooted = crowd.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    wanted = saved(rooted.join(mixed, "key", "left_semi").select("node", "root").distinct(), "jaccard-crowd")
    if not (n := wanted.count()):
        return None
    texts = saved(_texts(docs, wanted.select("node"), n).join(wanted, "node"), "jaccard-crowd-texts")

    def cells(cols):
        held = [shingles(t.split(b" ")) % np.uint64(CELLS) for t in cols["words"].to_pylist()]
        cell, count = np.unique(np.concatenate(held), return_counts=True)
        return [cell.astype(np.int32), count]

    counted = map_rows(texts.select("words"), cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
    told = counted.select("cell", F.floor(F.log2("n")).cast("byte").alias("level")).toArrow()
    level = np.zeros(CELLS, np.int8)
    level[told["cell"].to_numpy()] = told["level"].to_numpy()
    shared = spark.sparkContext.broadcast(level)

    def start(cols):
        out: tuple[list, ...] = ([], [], [], [])
        for node, root, text in zip(*(cols[c].to_pylist() for c in ("node", "root", "words")), strict=True):
            sh = shingles(text.split(b" "))
            keys = prefix(sh, shared.value).view(np.int64).tolist()
            for o, v in zip(out, (keys, [len(sh)] * len(keys), [node] * len(keys), [root] * len(keys)), strict=True):
                o += v
        return [*out]

    rows = map_rows(texts, start, "key long, size long, node binary, root binary")
    # ranges again: a shingle that many texts start with spreads over several tasks
    rows = rows.repartitionByRange("key", "size", "node").sortWithinPartitions("key", "size", "node")
    kind = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("sure", pa.bool_()), ("key", pa.int64()), ("part", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key = first = top = end = head = None
        held, wide, before, out = [], False, 0, []

        def star(size, node, root):
            nonlocal head, before
            if head is None or DEN * before < NUM * size:
                head = (node, root)
            elif head[1] != root:
                out.append((head[0], node, True, None, None, None, None))
            before = size

        for batch in batches:
            out.clear()
            for now, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if key is not None and key == first:
                        out.append((top[1], end[1], None, key, part, top[0], end[0]))
                    # the first shingle of a task may have begun in another: its texts make one group from the start
                    wide, first = (first is None, now) if first is None else (False, first)
                    key, held, head, top = now, [], None, row
                end = row
                if wide:
                    star(*row)
                    continue
                held.append(row)
                if wide := len(held) > WIDE:
                    for r in held:
                        star(*r)
                    held = []
                    continue
                out += [(node, row[1], False, None, None, None, None) for size, node, root in held[:-1] if root != row[2] and DEN * size >= NUM * row[0]]
            yield _batch(out, kind)
        out.clear()
        for r in held:  # the last shingle may go on in another task
            star(*r)
        if key is not None:
            out.append((top[1], end[1], None, key, part, top[0], end[0]))
        yield _batch(out, kind)

    ship(spark)
    found = saved(rows.mapInArrow(pair, "a binary, b binary, sure boolean, key long, part int, lo long, hi long"), "jaccard-apart")
    # a shingle that goes on in the next task: the last text here and the first one there, unless sizes exclude a link
    along = W.partitionBy("key").orderBy("part")
    ends = found.filter("part IS NOT NULL").select("key", "part", "b", "hi", F.lead("a").over(along).alias("a"), F.lead("lo").over(along).alias("lo"))
    ends = ends.filter(DEN * F.col("hi") >= NUM * F.col("lo")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    ordered = found.filter("part IS NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure")
    unsure = saved(ordered.filter("NOT sure").select("a", "b").distinct(), "jaccard-unsure")
    return _unpruned(unsure, nodes).unionByName(ordered.filter("sure").select("a", "b")).unionByName(ends)


def _by_unit(units: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the rows of each unit (root, i, j), one unit in memory at a time; rows have root, i, j, side first."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(units.sparkSession)
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    rows = units.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        told = lambda out: pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t.type) for k, t in enumerate(arrow)], schema=arrow)
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    out += work(key, held) if held else []
                    key, held = row[:3], []
                held.append(row)
            yield told(out)
        yield told(work(key, held) if held else [])

    return rows.mapInArrow(run, kind)


def _signatures(rows: list[tuple], at: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[at] for r in rows), np.uint32).reshape(-1, HASHES)


def _verified(docs: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root, links) for each node and unit in which it has an unpruned partner."""
    placed = saved(groups.join(nodes.select("node", "copies", "sig", "size"), "node"), "jaccard-placed")
    n = placed.count()
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    sizes = groups.join(nodes.select("node", "size"), "node").groupBy("root").agg(blocks.alias("n_blocks"), F.count("*").alias("__n"))
    dealt = dealt_join(placed, sizes, "root", n).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    units = dealt.select("root", "block", "node", "copies", "sig", "size", other)
    units = units.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "copies", "sig", "size")

    def pruned(key, rows):
        left, same = sum(r[3] == 0 for r in rows), key[1] == key[2]
        ok = _alive(_signatures(rows, 6), np.array([r[7] for r in rows]), left, same)
        stay = ok.any(axis=0)
        stay[:left] |= ok.any(axis=1)
        return [(*key, *rows[x][3:7]) for x in np.flatnonzero(stay)]

    schema = "root binary, i int, j int, side int, node binary, copies long, sig binary"
    alive = saved(_by_unit(units, pruned, schema), "jaccard-alive")
    texts = saved(_texts(docs, groups.select("node"), n), "jaccard-texts")
    uses = alive.groupBy("node").agg(F.count("*").alias("__n"))
    full = dealt_join(alive, texts.join(uses, "node"), "node", alive.count()).select("root", "i", "j", "side", "node", "copies", "sig", "words")

    def verify(key, rows):
        left = sum(r[3] == 0 for r in rows)
        return _verify([r[4] for r in rows], [r[5] for r in rows], [r[7] for r in rows], _signatures(rows, 6), left, key[1] == key[2])

    return saved(_by_unit(full, verify, "node binary, root binary, links long"), "jaccard-links")


@tidied
def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2, node) of the documents, and (node, class, class_id, n_links, __n) of the nodes, __n being their copies."""
    rows = saved(_signed(docs), "jaccard-signed")
    named = rows.filter("node IS NOT NULL")
    merged = named.groupBy("node").agg(F.first("sig").alias("sig"), F.first("size").alias("size"), F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    nodes = saved(merged, "jaccard-nodes")
    pairs, crowd = _proposed(nodes)
    left = saved(_unpruned(pairs, nodes), "jaccard-candidates")
    groups = saved(components(left, "jaccard-groups"), "jaccard-roots")
    if (more := _apart(docs, crowd, groups, nodes)) is not None:
        told = groups.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more)
        groups = components(told, "jaccard-groups")
    verified = _verified(docs, groups, nodes)
    found = components(verified.select(F.col("root").alias("a"), F.col("node").alias("b")), "jaccard-classes")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.select("node", "copies", "first_doc").join(found, "node", "left").join(links, "node", "left").withColumn("class", F.coalesce("root", "node"))
    told = saved(told.select("node", "class", "first_doc", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-told")
    ids = told.groupBy("class").agg(F.min("first_doc").alias("class_id"), F.count("*").alias("__n"))
    full = dealt_join(told, ids, "class", told.count()).select("node", "class", "class_id", "n_links", F.col("copies").alias("__n"))
    return rows.drop("sig", "size"), full


@tidied
def op7_ngram_jaccard(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id of its class), n_links (documents with similarity of 0.8 or more)."""
    rows, told = classes(docs.select("doc_id", "text"))
    named = dealt_join(rows.filter("node IS NOT NULL"), told, "node", rows.count()).select("doc_id", "class_id", "n_links")
    return named.unionByName(rows.filter("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


@tidied
def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id, with the columns it came with."""
    names = docs.columns
    rows, told = classes(docs.select("doc_id", "text"))
    one = F.struct(F.col("doc_id").isNull().alias("null_last"), "doc_id", "k1", "k2")
    alone = rows.filter("node IS NULL").select("k1", "k2").withColumn("n", F.lit(1).cast("long"))
    best = dealt_join(rows.filter("node IS NOT NULL"), told.select("node", "class", "__n"), "node", rows.count()).groupBy("class").agg(F.min(one).alias("one")).select("one.k1", "one.k2")
    same = rows.filter("node IS NOT NULL").groupBy("k1", "k2").agg(F.count("*").alias("n"))
    stay = saved(alone.distinct().unionByName(best.join(same, ["k1", "k2"])), "jaccard-stay")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2"), F.struct(*names).alias("__doc"))
    kept = keyed.join(stay.filter("n = 1").select("k1", "k2"), ["k1", "k2"], "left_semi")
    # rows that repeat id and text as well: any one of them
    tied = keyed.join(stay.filter("n > 1").select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("__doc").alias("__doc"))
    return kept.unionByName(tied).select("__doc.*")
