"""Near-duplicate documents by an LSH forest.

Each document's set of 4-word shingles has a signature of ``TREES * 4`` minimum hashes. A tree is an order of the
signature, each with four values of its own in front: its rows are sorted by the sequence of values (dealt over tasks by
sampled ranges), and neighbours in that order with a long common prefix are candidates. How deep a prefix has to be follows the
region: where many rows are alike, the nearest neighbours share long prefixes and no others are paired; elsewhere
``DEPTH`` equal values suffice. So a group of any size gives a few pairs a member, never all pairs.

Where more than ``SPAN`` rows share ``DEPTH`` values, places alone may part a pair that is near. All rows of such
regions also meet in an exact set-similarity join: two sets that are near enough share one of their rarest shingles, at places
and sizes that still allow the overlap. Only pairs that the links so far leave in different components are confirmed.

Candidates are confirmed on full sets: first the best of each document, then, once these links have joined
documents into components, all that still lead from one component to another. With 16 trees and depth 3 a pair at
similarity 0.8 shares a prefix in no tree with a chance of about 1 in 100 000.

Equal sets are one class, whatever the number of documents. Rows that share a doc_id are one document
for linking. A document without words is linked with nothing; a NULL id stands apart as the largest id.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.graph import components
from llm.texts import LAST, Words, frugal, packed, ranges_hash, slabs, unpack, written

SHINGLE = 4
PERCENT = 80
TREES = 16
OWN = 4
DEPTH = 3
LONG = 8
SPAN = 10
NEAR = 1
MIXES = 4
#: The join of crowded rows: bits of a shingle that count its frequency, and the ratio of sizes within a class.
RARE_BITS = 20
RATIO = 1.05

_RANDOM = np.random.default_rng(8)
_FACTORS = _RANDOM.integers(1, 2**63, TREES * OWN, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, TREES * OWN, dtype=np.uint64)
_TIES = [(m * (MIXES + 1) * OWN + LONG + np.arange(OWN)) % (TREES * OWN) for m in range(MIXES)]
_ORDERS = [np.concatenate(((np.arange(LONG) + t * OWN) % (TREES * OWN), _TIES[t % MIXES])) for t in range(TREES)]


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text's whole word sequence is its only one."""
    words = Words(texts, lower=True)
    h, inside = words.windows(size)
    sets = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= size:
            sets.append(np.unique(h[a : b - size + 1]))
        elif b > a:
            sets.append(ranges_hash(words.hash[0], np.array([a]), np.array([b])))
        else:
            sets.append(h[:0])
    return sets


def minimum_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``TREES * OWN`` minimum hashes for each set; zeros for an empty one."""
    out = np.zeros((len(sets), TREES * OWN), ">u4")
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        values = np.concatenate([sets[i] for i in some])
        firsts = np.cumsum([0, *(len(sets[i]) for i in some)])[:-1]
        for k in range(TREES * OWN):
            h = (values * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(32)
            out[some, k] = np.minimum.reduceat(h, firsts)
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """rep, dg, n (set size), sd (digest of the set) and sig of each row of ``docs`` (rep, dg, text)."""

    @frugal
    def work(batches):
        for batch in batches:
            for first, texts in slabs(batch.column("text")):
                sets = shingle_sets(texts, size)
                part = batch.slice(first, len(texts))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sigs = [row.tobytes() for row in minimum_hashes(sets)]
                arrays = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("dg"), *arrays], names=["rep", "dg", "n", "sd", "sig"])

    return docs.select("rep", "dg", "text").mapInArrow(work, "rep long, dg string, n long, sd binary, sig binary")


def neighbours(rows: list[tuple[int, bytes, int]]) -> list[tuple[int, int, int]]:
    """(a, b, depth) of rows (tree, sequence, node), sorted, within ``SPAN`` places of each other.

    A run of rows with one and the same sequence is paired in full up to ``SPAN`` rows; in a longer one only ``NEAR`` places
    are. Its rows are in order of ``OWN`` further values, which trees share in ``MIXES`` ways: like rows stay together, and a
    run gives a few pairs a member over all trees.
    """
    found, run = [], []
    for _, same in groupby(rows, lambda row: (row[0], row[1][: 4 * LONG])):
        size = sum(1 for _ in same)
        run += [size] * size
    for gap in range(1, SPAN + 1):
        for (t, s, a), (u, r, b), size in zip(rows, rows[gap:], run):
            if t == u and a != b and s[: 4 * DEPTH] == r[: 4 * DEPTH]:
                depth = DEPTH
                while depth < LONG and s[4 * depth : 4 * depth + 4] == r[4 * depth : 4 * depth + 4]:
                    depth += 1
                if depth < LONG or size <= SPAN or gap <= NEAR:
                    found.append((min(a, b), max(a, b), depth))
    return found


class Regions:
    """Nodes of rows, given in order, that share ``DEPTH`` values with at least ``SPAN`` others."""

    def __init__(self):
        self.key, self.size, self.waiting = None, 0, []

    def crowded(self, rows: list[tuple[int, bytes, int]]) -> set[int]:
        found = set()
        for t, s, node in rows:
            key = t, s[: 4 * DEPTH]
            if key != self.key:
                self.key, self.size, self.waiting = key, 0, []
            self.size += 1
            self.waiting.append(node)
            if self.size > SPAN:
                found.update(self.waiting)
                self.waiting = []
        return found


PAIRS = "a long, b long, depth int, tree int, seq binary"


def forest_pairs(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b, depth) of ``reps`` (rep, sig), and the nodes of crowded regions."""
    orders = [o.tolist() for o in _ORDERS]

    def sequences(batches):
        for batch in batches:
            nodes, sigs = batch.column("rep"), [np.frombuffer(s, ">u4") for s in batch.column("sig").to_pylist()]
            for t, order in enumerate(orders):
                seq = [s[order].tobytes() for s in sigs]
                arrays = [pa.array([t] * len(nodes), pa.int32()), pa.array(seq, pa.binary()), nodes]
                yield pa.RecordBatch.from_arrays(arrays, names=["tree", "seq", "node"])

    def pair(batches):
        """Pairs, and as rows without a pair crowded nodes (no tree) and the first and last of the task, which have neighbours in other tasks."""
        held, edge, regions, known = [], [], Regions(), set()
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("tree", "seq", "node"))))
            edge += rows[: SPAN - len(edge)]
            yield from as_batches(neighbours(held + rows))
            new = regions.crowded(rows) - known
            known |= new
            none = len(new)
            arrays = [pa.array(sorted(new), pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "depth", "tree", "seq"])
            held = (held + rows)[-SPAN:]
        both = sorted({*edge, *held})
        arrays = [pa.array([n for *_, n in both], pa.int64()), pa.nulls(len(both), pa.int64()), pa.nulls(len(both), pa.int32()),
                  pa.array([t for t, *_ in both], pa.int32()), pa.array([s for _, s, _ in both], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "depth", "tree", "seq"])

    rows = reps.select("rep", "sig").mapInArrow(sequences, "tree int, seq binary, node long")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "tree", "seq", "node").sortWithinPartitions("tree", "seq", "node")
    found = written(dealt.mapInArrow(pair, PAIRS), "forest")
    edges = found.where("b is null and tree is not null").select("tree", "seq", F.col("a").alias("node"))
    across = edges.repartition(1).sortWithinPartitions("tree", "seq", "node").mapInArrow(pair, PAIRS)
    both = found.unionByName(written(across, "across"))
    crowded = both.where("b is null and tree is null").select(F.col("a").alias("node")).distinct()
    return both.where("b is not null").groupBy("a", "b").agg(F.max("depth").alias("depth")), crowded


def as_batches(pairs):
    for i in range(0, len(pairs), 50_000):
        a, b, depth = zip(*pairs[i : i + 50_000])
        none = len(a)
        arrays = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(depth, pa.int32()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "depth", "tree", "seq"])


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) whose full sets are similar enough; ``texts`` has node and z."""
    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")

    @frugal
    def work(batches):
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                sets = [shingle_sets(unpack(part.column(c)), size) for c in ("za", "zb")]
                keep = []
                for x, y in zip(*sets):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "near"])

    return both.select("a", "b", "za", "zb").mapInArrow(work, "a long, b long, near boolean").where("near").select("a", "b")


def frequencies(texts: DataFrame, size: int) -> np.ndarray:
    """How many shingles of ``texts`` (z) have each leading ``RARE_BITS`` bits: a bounded table, whatever the corpus."""

    @frugal
    def work(batches):
        counts = np.zeros(1 << RARE_BITS, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 200):
                for s in shingle_sets(unpack(batch.column("z").slice(at, 200)), size):
                    np.add.at(counts, (s >> np.uint64(64 - RARE_BITS)).astype(np.int64), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bits", "n"])

    rows = texts.select("z").mapInArrow(work, "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << RARE_BITS, np.int64)
    counts[rows.column("bits").to_numpy()] = rows.column("n").to_numpy()
    return np.minimum(counts, 2**32 - 1).astype(np.uint32)


def crowded_pairs(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``texts`` (node, component, z) in different components; none that is near enough is missing.

    Sets of x and y shingles are near if they share at least percent / (100 + percent) of x + y. In any order of all shingles
    the first one that they share then has that many from it on in both; the order by frequency makes it a rare one.
    Sizes are in classes, so a shingle meets only those of sets whose size allows its place.
    """
    counts = frequencies(texts, size)

    @frugal
    def work(batches):
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                held = []
                for s in shingle_sets(unpack(part.column("z")), size):
                    n = len(s)
                    order = np.lexsort((s, counts[s >> np.uint64(64 - RARE_BITS)]))
                    held.append(s[order[: n - -(-percent * n // 100) + 1]])
                sizes = np.array([len(s) for s in held])
                rows = np.repeat(np.arange(len(held)), sizes)
                left = np.concatenate([n - np.arange(k) for n, k in zip(part.column("n").to_pylist(), sizes)])
                nodes = [part.column(c).take(pa.array(rows)) for c in ("node", "component", "n")]
                arrays = [pa.array(np.concatenate(held).view(np.int64)), *nodes, pa.array(left.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["g", "node", "component", "n", "left"])

    rows = written(texts.select("node", "component", "n", "z").mapInArrow(work, "g long, node long, component long, n long, left long"), "rare")
    mixed = rows.groupBy("g").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("g")
    rows = written(rows.join(mixed, "g", "left_semi"), "rare-shared")
    reach = int(np.ceil(np.log(100 / percent) / np.log(RATIO)))
    own = F.floor(F.log("n") / F.log(F.lit(RATIO))).alias("own")

    def side(first: int, last: int, lower: str, upper: str, suffix: str) -> DataFrame:
        steps = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("step")
        met = rows.select("*", own, steps).withColumn("other", F.col("own") + F.col("step"))
        least = F.greatest(F.floor(F.pow(F.lit(RATIO), "other")) - 1, F.ceil(F.col("n") * percent / 100) - 1)
        met = met.where((100 + percent) * F.col("left") >= percent * (F.col("n") + least))
        return met.select("g", F.col(lower).alias("lower"), F.col(upper).alias("upper"), *(F.col(c).alias(c + suffix) for c in ("node", "component", "n", "left")))

    small, large = side(0, reach, "own", "other", "1"), side(-reach, 0, "other", "own", "2")
    pairs = small.join(large, ["g", "lower", "upper"]).where("component1 <> component2 and (n1 < n2 or n1 = n2 and node1 < node2)")
    pairs = pairs.where((100 + percent) * F.least("left1", "left2") >= percent * (F.col("n1") + F.col("n2")))
    return pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def between(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) that lead from one component of ``parts`` to another, with both as ca and cb."""
    for end in ("a", "b"):
        pairs = pairs.join(parts.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    return pairs.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca != cb")


def linked(parts: DataFrame, pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``parts`` with the components joined that confirmed ``pairs`` link."""
    rest = written(between(parts, pairs), "rest")
    links = confirmed(rest.select("a", "b"), texts, size, percent).join(rest, ["a", "b"])
    joint = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    onto = joint.select(F.col("node").alias("component"), F.col("component").alias("joint"))
    inner = parts.join(onto, "component", "left").select("node", F.coalesce("joint", "component").alias("component"))
    return written(inner.unionByName(joint.join(parts, "node", "left_anti")), "parts")


def near_links(reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked with another; ``reps`` has rep, dg, n, sig, ``docs`` rep, dg, text."""
    pairs, crowded = forest_pairs(reps)
    pairs = written(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = reps.select("rep", "dg", "n").join(nodes, "rep").dropDuplicates(["rep"])
    texts = packed(docs, F.col("rep"), F.col("dg")).join(wanted, ["rep", "dg"]).dropDuplicates(["rep"])
    texts = written(texts.select(F.col("rep").alias("node"), "n", "z"), "texts")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "depth"))
    best = ends.groupBy(F.col("a").alias("u")).agg(F.max(F.struct("depth", (-F.col("b")).alias("b"))).alias("p"))
    best = best.select("u", (-F.col("p.b")).alias("v")).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    best = written(best, "best")
    links = written(confirmed(best, texts, size, percent), "links")
    parts = linked(components(links), pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), texts, size, percent)
    among = texts.join(written(crowded, "crowded"), "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return linked(parts, crowded_pairs(written(among, "crowded-texts"), size, percent), texts, size, percent)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id (smallest linked doc_id) and kept."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rep")
    docs = docs.select(key, F.md5(F.coalesce("text", F.lit(""))).alias("dg"), "text")
    rows = written(signatures(docs, size), "signatures")
    classes = rows.where("n > 0").groupBy("sd").agg(F.min("rep").alias("rep"), F.min_by(F.struct("dg", "n", "sig"), "rep").alias("s"))
    classes = written(classes.select("sd", "rep", "s.*"), "classes")
    parts = near_links(classes, docs, size, percent)
    roots = classes.select("sd", F.col("rep").alias("node")).join(parts, "node", "left")
    roots = written(roots.select("sd", F.coalesce("component", "node").alias("root")), "roots")
    found = rows.select("rep", "n", "sd").join(roots, "sd", "left")
    root = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("rep"))
    known = lambda c: F.when(c != LAST, c)
    return found.select(
        known(F.col("rep")).alias("doc_id"), F.col("n").alias("n_shingles"),
        known(root).alias("component_id"), (F.col("rep") == root).alias("kept"),
    )
