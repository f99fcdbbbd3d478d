"""Removal of word sequences that repeat across documents, by doubling the window.

Lengths double (rounded up where halves are odd): 13, 25, 50 words for the default. At the first
length only anchors are looked at: of each target window, the 13-word window with the smallest hash. Equal
target windows have equal anchors, so no repeat is missed, and about one position in twenty is shuffled.
Anchors whose window repeats in another text are extended to 25 words, to the right and to the left (one
of the two lies inside each target window); those that still repeat name the places where target windows may repeat. Only
these are hashed (96 bits) at full length and grouped for the smallest document.

Copies of a whole text are one class with its smallest id; members with larger ids lose every word
that a window covers without being looked at. NULL text has no words; a NULL id counts as larger than all others;
repeated rows of one document are no repeats of each other. Extra columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.texts import LAST, Words, merged, packed, signed, slabs, sliding_min, unpack, written

WINDOW = 50
HOT_KEYS = 1000
PLACE = np.uint64((1 << 28) - 1)
TOP = np.uint64(2**64 - 1)
RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string"


def lengths(window: int, least: int = 8) -> list[int]:
    """Window lengths, each at most twice the one before, up to ``window``."""
    found = [window]
    while (found[0] + 1) // 2 >= least:
        found.insert(0, (found[0] + 1) // 2)
    return found[-3:]


def anchors_of(words: Words, short: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the short windows, and the positions that are smallest in some target window."""
    h, inside = words.windows(short)
    _, targets = words.windows(window)
    starts = np.flatnonzero(targets)
    if not len(starts):
        return h, starts
    keys = np.where(inside, (h & ~PLACE) | np.arange(len(h), dtype=np.uint64), TOP)
    keys = np.concatenate((keys, np.full(window, TOP)))
    smallest = sliding_min(keys, window - short + 1)[starts]
    return h, np.unique((smallest & PLACE).astype(np.int64))


def anchors(docs: DataFrame, short: int, middle: int, window: int) -> DataFrame:
    """h of each anchor's short window, its text's hash t and its place; g and f: the middle window from it on, and up to it."""

    def work(batches):
        for batch in batches:
            ids = batch.column("t").to_numpy()
            for first, texts in slabs(batch.column("text")):
                words = Words(texts)
                h, at = anchors_of(words, short, window)
                m, inside = words.windows(middle)
                owner = np.searchsorted(words.first, at, side="right") - 1
                left = at - (middle - short)
                has_left = left >= words.first[owner]
                left = np.maximum(left, 0)
                arrays = [
                    signed(h[at]), pa.array(ids[first + owner]), pa.array((at - words.first[owner]).astype(np.int32)),
                    pa.array(m[at].view(np.int64), mask=~inside[at]), pa.array(m[left].view(np.int64), mask=~(has_left & inside[left])),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "t", "place", "g", "f"])

    source = docs.where(F.octet_length("text") >= 2 * window - 1).select(F.xxhash64("text").alias("t"), "text")
    return source.mapInArrow(work, "h long, t long, place int, g long, f long")


def repeating(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is found in two texts or more; counts combine before the shuffle."""
    found = rows.groupBy(key).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b")
    return spread_join(rows, written(found.select(key, "n"), "repeats"), [key], "left_semi")


def spread_join(rows: DataFrame, repeats: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` joined with ``repeats`` (one row a key, its rows counted in ``n``), the rows of frequent keys dealt over several tasks.

    A key with more than one in ``HOT_KEYS`` of the rows counted gets as many salts as it fills shares of a task. There are fewer than
    ``HOT_KEYS`` such keys at any size, so their table is small enough for every executor; no row is left out.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = F.lit(repeats.agg(F.sum("n")).first()[0] or 0)
    hot, salts = F.col("n") * HOT_KEYS > total, F.ceil(F.col("n") * tasks / total).cast("int")
    often = repeats.where(hot).select(*keys, salts.alias("salts"))
    rest = [c for c in rows.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*rest), F.coalesce("salts", F.lit(1))).cast("int")
    salted = rows.join(F.broadcast(often), keys, "left").withColumn("salt", salt).drop("salts")
    every = F.when(hot, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    return salted.join(repeats.withColumn("salt", F.explode(every)).drop("n"), [*keys, "salt"], how).drop("salt")


def candidates(docs: DataFrame, window: int) -> DataFrame:
    """Per text (t) the ranges of places where a target window may repeat."""
    short, middle, _ = lengths(window)
    reach = window - short
    survivors = repeating(anchors(docs, short, middle, window), "h").dropDuplicates(["t", "place"]).drop("h")
    survivors = written(survivors, "anchors")
    low, high = F.col("place") - (window - middle), F.col("place")
    right = survivors.where("g is not null").select("t", F.col("g").alias("m"), low.alias("low"), high.alias("high"))
    low, high = F.col("place") - reach, F.col("place") - (middle - short)
    left = survivors.where("f is not null").select("t", F.col("f").alias("m"), low.alias("low"), high.alias("high"))
    return repeating(right.unionByName(left), "m").groupBy("t").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def windows(texts: DataFrame, window: int) -> DataFrame:
    """Hashes of the target windows that start in the ranges: (h, k, rep, t, place)."""

    def work(batches):
        for batch in batches:
            reps, ids = batch.column("rep").to_numpy(), batch.column("t").to_numpy()
            ranges = batch.column("ranges").to_pylist()
            for i, z in enumerate(batch.column("z")):
                words = Words(unpack([z]), hashes=2)
                last = len(words.starts) - window
                starts, ends = merged(np.array([max(0, r["low"]) for r in ranges[i]]), np.array([min(last, r["high"]) + 1 for r in ranges[i]]))
                keep = starts < ends
                starts, ends = starts[keep], ends[keep]
                if not len(starts):
                    continue
                at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)])
                h, k = words.windows(window, 0)[0][at], words.windows(window, 1)[0][at]
                n = len(at)
                arrays = [
                    signed(h), pa.array((k >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.array(np.full(n, reps[i])), pa.array(np.full(n, ids[i])), pa.array(at.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "k", "rep", "t", "place"])

    return texts.select("rep", "t", "ranges", "z").mapInArrow(work, "h long, k int, rep long, t long, place int")


def later_places(docs: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """Places of target windows that start in a smaller document too: (rep, t, places); ``docs`` has rep, dg and text.

    ``classes`` (dg, t, rep) names one row of each text, that with the smallest id; no other row of it is looked at.
    """
    todo = classes.join(candidates(docs, window), "t")
    texts = written(packed(docs, F.col("rep"), F.col("dg")).join(todo, ["rep", "dg"]), "window-texts")
    found = windows(texts, window)
    firsts = found.groupBy("h", "k").agg(F.min("rep").alias("first"), F.max("rep").alias("other"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.where("first < other").drop("other"), "firsts")
    later = spread_join(found, firsts, ["h", "k"], "inner").where("rep > first")
    return later.groupBy("rep", "t").agg(F.collect_list("place").alias("places"))


def covered(raw: bytes, places: list[int] | None, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words that the windows at ``places`` (None: all windows) cover, with the blanks behind them."""
    words = Words([raw], hashes=0).starts
    at = np.arange(max(0, len(words) - window + 1)) if places is None else np.array(places, np.int64)
    starts, ends = merged(at, at + window)
    return words[starts], np.append(words, len(raw))[ends]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, n_spans and the SHA-256 of the words that stay."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    docs = docs.select(key.alias("rep"), F.coalesce("text", F.lit("")).alias("text")).withColumn("dg", F.md5("text"))
    rows = docs.select("rep", "dg", F.xxhash64("text").alias("t")).distinct()
    classes = rows.groupBy("dg", "t").agg(F.min("rep").alias("rep"))
    removed = later_places(docs, classes, window)
    known = rows.join(classes.select("dg", F.col("rep").alias("least")), "dg").join(removed, ["rep", "t"], "left")
    verdict = known.select("rep", "dg", (F.col("rep") > F.col("least")).alias("copy"), "places")
    joined = packed(docs, F.col("rep"), F.col("dg")).join(verdict, ["rep", "dg"])

    def work(batches):
        for batch in batches:
            out = []
            for rep, copy, places, z in zip(*(batch.column(c) for c in ("rep", "copy", "places", "z"))):
                words = unpack([z])[0].split()
                at = np.arange(max(0, len(words) - window + 1)) if copy.as_py() else np.array(places.as_py() or [], np.int64)
                starts, ends = merged(at, at + window)
                kept, last = [], 0
                for a, b in zip(starts.tolist(), ends.tolist()):
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                doc = rep.as_py()
                out.append((None if doc == LAST else doc, len(words), int((ends - starts).sum()), len(starts), hashlib.sha256(b" ".join(kept)).hexdigest()))
            names = ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"]
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], names=names)

    return joined.select("rep", "copy", "places", "z").mapInArrow(work, RESULT)
