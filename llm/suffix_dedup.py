"""Removal of byte strings that occur twice, by a sparse suffix array sorted in range-partitioned buckets.

Suffixes start at anchors: of each string of the wanted length, the place whose next 8 bytes hash lowest
among its first ``spread`` places. Equal strings have equal anchors, so each repeated string is found at
the suffixes of its anchors, compared to the right and to the left. An anchor belongs to a run of neighbouring
strings; the run's bytes are its fragment.

1. Anchors whose next ``lead`` bytes (a part of every string of the run) occur once drop out.
2. Fragments that are equal byte for byte are counted before anything is sorted: they repeat as a whole, and one of
   them stands for all. So copies and near copies, however many, send one suffix.
3. Spark samples splitters and deals the suffixes by ranges of the leading bytes of their leads, then of the digests of the
   whole leads. Suffixes with equal leads stay in one bucket, so two buckets never share a string: comparing across a
   boundary could only show what the splitters guarantee. Leads with more than ``HOT`` different fragments are split over all
   tasks instead and compared across them by digests of their strings.
4. A bucket sorts its suffixes by multikey quicksort (8 bytes a key). At each depth where classes of equal
   right-hand text form, the nearest left-hand texts in a class give the longest match of each member.

NULL text is empty; a text shorter than the length loses nothing; texts that occur in several rows, repeated rows included, lose all
that such a string covers. NULL ids are kept apart by their text. Extra columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from llm.substring_dedup import covered, later_places
from llm.texts import LAST, frugal, merged, packed, slabs, sliding_min, unpack, written

LENGTH = 400
GRAM = 8
HOT = 20_000
BUCKET = 50_000
KEY = 16
PLACE = np.uint64((1 << 28) - 1)
TOP = np.uint64(2**64 - 1)
SMALL = 32
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def spread_of(length: int) -> int:
    return max(1, min(192, length // 2))


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Anchors of the joined texts: place, owner, and the least and largest distance back to a string of its run."""
    spread = spread_of(length)
    data = np.frombuffer(b"".join(texts) + bytes(length + GRAM), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    starts = np.concatenate([np.arange(a, max(a, b - length + 1)) for a, b in zip(offsets[:-1], offsets[1:])])
    if not len(starts):
        return (starts,) * 4
    n = offsets[-1] + spread
    grams = np.empty(n, np.uint64)
    for j in range(GRAM):
        part = np.frombuffer(data[j:].tobytes()[: (len(data) - j) // 8 * 8], "<u8")
        at = grams[j::GRAM]
        grams[j::GRAM] = part[: len(at)]
    grams *= np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    keys = (grams & ~PLACE) | np.arange(n, dtype=np.uint64)
    chosen = (sliding_min(keys, spread)[starts] & PLACE).astype(np.int64)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.concatenate((new[1:] - 1, [len(starts) - 1]))
    place = chosen[new]
    return place, owner[new], place - starts[last], place - starts[new]


def digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """h: digest of the ``lead`` bytes from the anchor on; t: hash of its text; twice: h is found again in the text."""
    lead = length - spread_of(length) + 1

    @frugal
    def work(batches):
        for batch in batches:
            ids = batch.column("t").to_numpy()
            for first, texts in slabs(batch.column("text")):
                place, owner, low, high = runs(texts, length)
                if not len(place):
                    continue
                joined = b"".join(texts)
                h = np.array([digest(joined[p : p + lead]) for p in place.tolist()], np.int64)
                order = np.lexsort((h, owner))
                same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
                twice = np.zeros(len(h), bool)
                twice[order[1:][same]] = twice[order[:-1][same]] = True
                offsets = np.cumsum([0, *map(len, texts)])
                arrays = [pa.array(h), pa.array(ids[first + owner]), pa.array(twice), *(pa.array(c.astype(np.int32)) for c in (place - offsets[owner], low, high))]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "t", "twice", "place", "low", "high"])

    source = docs.where(F.octet_length("text") >= length).select(F.xxhash64("text").alias("t"), "text")
    return source.mapInArrow(work, "h long, t long, twice boolean, place int, low int, high int")


def fragments(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of each anchor's run: (x: their 128-bit digest, h, t, place, low, high, z)."""

    @frugal
    def work(batches):
        for batch in batches:
            for t, places, z in zip(batch.column("t").to_pylist(), batch.column("places"), batch.column("z")):
                raw, rows = unpack([z])[0], []
                for p in places.as_py():
                    part = raw[p["place"] - p["high"] : p["place"] + length - p["low"]]
                    sized = part + p["low"].to_bytes(4, "little") + p["high"].to_bytes(4, "little")
                    rows.append((hashlib.blake2b(sized, digest_size=16).digest(), p["h"], t, p["place"], p["low"], p["high"], part))
                columns = list(zip(*rows))
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["x", "h", "t", "place", "low", "high", "z"])

    return texts.select("t", "places", "z").mapInArrow(work, "x binary, h long, t long, place int, low int, high int, z binary")


def multikey_quicksort(texts: list[bytes]) -> np.ndarray:
    """The order of ``texts``: ranges are split in three by an 8-byte key; the middle part goes on to the next key."""
    width = max(map(len, texts), default=0) // 8 + 1
    keys = np.frombuffer(b"".join(t.ljust(8 * width, b"\0") for t in texts), ">u8").reshape(-1, width).astype(np.uint64)
    found, waiting = [], [(np.arange(len(texts)), 0)]
    while waiting:
        rows, depth = waiting.pop()
        if len(rows) <= SMALL or depth == width:
            found += sorted(rows.tolist(), key=texts.__getitem__)
            continue
        key = keys[rows, depth]
        pivot = np.partition(key, len(key) // 2)[len(key) // 2]
        for part, deeper in ((key > pivot, 0), (key == pivot, 1), (key < pivot, 0)):
            if part.any():
                waiting.append((rows[part], depth + deeper))
    return np.array(found, np.int64)


class Prefixes:
    """Common prefix lengths of pairs of texts."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts])
        self.width = max(1, int(self.sizes.max(initial=0)))
        self.data = np.frombuffer(b"".join(t.ljust(self.width, b"\0") for t in texts), np.uint8).reshape(-1, self.width)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for i in range(0, len(a), 20_000):
            x, y = a[i : i + 20_000], b[i : i + 20_000]
            differs = self.data[x] != self.data[y]
            first = np.where(differs.any(axis=1), differs.argmax(axis=1), self.width)
            out[i : i + 20_000] = np.minimum(first, np.minimum(self.sizes[x], self.sizes[y]))
        return out


def matches(parts: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(fragment, bytes back from its anchor, bytes ahead) of strings that another fragment has as well."""
    n, lead = len(parts), length - spread_of(length) + 1
    if n < 2:
        return []
    rights = [p[h:] for p, h in zip(parts, high.tolist())]
    lefts = [p[:h][::-1] for p, h in zip(parts, high.tolist())]
    order = multikey_quicksort(rights)
    shared = np.minimum(Prefixes(rights).common(order[:-1], order[1:]), length)
    rank = np.empty(n, np.int64)
    rank[multikey_quicksort(lefts)] = np.arange(n)
    left, found = Prefixes(lefts), []
    for depth in np.unique(shared[shared >= lead])[::-1].tolist():
        group = np.concatenate(([0], np.cumsum(shared < depth)))
        touched = np.zeros(group[-1] + 1, bool)
        touched[group[1:][shared == depth]] = True
        at = np.flatnonzero(touched[group])
        rows, classes = order[at], group[at]
        sort = np.lexsort((rank[rows], classes))
        rows, classes = rows[sort], classes[sort]
        common = np.where(classes[1:] == classes[:-1], left.common(rows[1:], rows[:-1]), -1)
        best = np.maximum(np.concatenate(([-1], common)), np.concatenate((common, [-1])))
        back, least = np.minimum(best, high[rows]), np.maximum(low[rows], length - depth)
        hit = back >= least
        found += zip(rows[hit].tolist(), back[hit].tolist(), (length - least[hit]).tolist())
    return found


def dealt(groups: DataFrame, length: int, n: int) -> DataFrame:
    """``groups`` by ranges of (the first ``KEY`` bytes of the lead, the whole lead's digest): equal leads have equal keys.

    A bucket cannot be split below one lead, and ``HOT`` bounds the fragments of a lead. Short keys keep the sample of
    splitters small in the driver.
    """
    lead = F.substring("z", F.col("high") + 1, F.lit(length - spread_of(length) + 1))
    return groups.repartitionByRange(n, F.substring(lead, 1, KEY), F.xxhash64(lead))


def bucket_matches(groups: DataFrame, length: int, n: int) -> DataFrame:
    """(x, back, ahead) found in buckets of suffixes with neighbouring leading bytes."""

    @frugal
    def work(batches):
        x, parts, low, high = [], [], [], []
        for batch in batches:
            x += batch.column("x").to_pylist()
            parts += batch.column("z").to_pylist()
            low += batch.column("low").to_pylist()
            high += batch.column("high").to_pylist()
        found = matches(parts, np.array(low, np.int64), np.array(high, np.int64), length)
        for i in range(0, len(found), 50_000):
            rows, back, ahead = zip(*found[i : i + 50_000])
            arrays = [pa.array([x[r] for r in rows], pa.binary()), pa.array(back, pa.int32()), pa.array(ahead, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["x", "back", "ahead"])

    return dealt(groups.select("x", "z", "low", "high"), length, n).mapInArrow(work, "x binary, back int, ahead int")


def hot_matches(groups: DataFrame, length: int) -> DataFrame:
    """The same for leads with very many fragments: digests of all strings of each run, spread over all tasks."""

    @frugal
    def work(batches):
        for batch in batches:
            for x, part, low, high in zip(*(batch.column(c).to_pylist() for c in ("x", "z", "low", "high"))):
                backs = range(low, high + 1)
                d = [hashlib.blake2b(part[high - b : high - b + length], digest_size=16).digest() for b in backs]
                arrays = [pa.array(d, pa.binary()), pa.array([x] * len(d), pa.binary()), pa.array(backs, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["d", "x", "back"])

    strings = groups.select("x", "z", "low", "high").mapInArrow(work, "d binary, x binary, back int")
    again = written(strings.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d"), "hot-strings")
    return strings.join(again, "d").select("x", "back", (length - F.col("back")).cast("int").alias("ahead"))


def repeated_ranges(docs: DataFrame, classes: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """Per text (t) the ranges of bytes that strings found elsewhere cover; ``docs`` has rep, dg and text."""
    spark = docs.sparkSession
    found = anchors(docs, length)
    again = found.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max("twice").alias("c")).where("a <> b or c").select("h")
    again = written(again, "leads")
    some = found.join(again, "h", "left_semi").dropDuplicates(["t", "place"])
    todo = classes.join(some.groupBy("t").agg(F.collect_list(F.struct("place", "low", "high", "h")).alias("places")), "t")
    texts = packed(docs, F.col("rep"), F.col("dg")).join(todo, ["rep", "dg"])
    parts = written(fragments(texts, length), "fragments")
    groups = parts.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("h", "low", "high", "z")).alias("g")).select("x", "n", "g.*")
    leads = parts.groupBy("h").agg(F.count_distinct("x").alias("k")).where(F.col("k") > hot).select("h")
    leads = written(leads, "hot-leads")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // BUCKET))
    spans = bucket_matches(groups.join(leads, "h", "left_anti"), length, n)
    if not leads.isEmpty():
        spans = spans.unionByName(hot_matches(groups.join(leads, "h"), length))
    whole = parts.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.first("low").alias("low"), F.first("high").alias("high")).where("n > 1")
    whole = whole.select("x", F.col("high").alias("back"), (length - F.col("low")).cast("int").alias("ahead"))
    spans = written(spans.unionByName(whole).distinct(), "matches")
    hits = parts.select("x", "t", "place").join(spans, "x")
    pair = F.struct((F.col("place") - F.col("back")).alias("low"), (F.col("place") + F.col("ahead")).alias("high"))
    return hits.groupBy("t").agg(F.collect_set(pair).alias("ranges"))


def remove_repeated_bytes(
    docs: DataFrame, length: int = LENGTH, hot: int = HOT, keep: tuple[str, ...] = (), words: int | None = None
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay.

    ``keep`` names columns that go along; then those bytes are added as ``kept`` (a cut may fall inside a character, so
    they are binary). ``words`` removes more: every word, with the blanks behind it, covered by a window of that many
    words that starts in a document with a smaller id too. Both are judged on the input.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    carried = [F.struct(*keep).alias("row")] if keep else []
    docs = docs.select(key.alias("rep"), F.coalesce("text", F.lit("")).alias("text"), *carried).withColumn("dg", F.md5("text"))
    rows = docs.select("rep", "dg", F.xxhash64("text").alias("t"))
    classes = rows.groupBy("dg", "t").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("n"))
    ranges = repeated_ranges(docs, classes.select("dg", "t", "rep"), length, hot)
    least = classes.select("dg", F.col("rep").alias("least"), "n")
    known = rows.distinct().join(least, "dg").join(ranges, "t", "left")
    verdict = ["copy", "ranges"]
    if words:
        known = known.join(later_places(docs, classes.select("dg", "t", "rep"), words), ["rep", "t"], "left")
        known = known.withColumn("later", F.col("rep") > F.col("least"))
        verdict += ["later", "places"]
    known = known.withColumn("copy", F.col("n") > 1).select("rep", "dg", *verdict)
    joined = packed(docs, F.col("rep"), F.col("dg"), *(["row"] if keep else [])).join(known, ["rep", "dg"])
    joined = joined.select("rep", *(["row"] if keep else []), *verdict, "z")

    @frugal
    def work(batches):
        for batch in batches:
            out = []
            for i, (rep, copy, found, z) in enumerate(zip(*(batch.column(c) for c in ("rep", "copy", "ranges", "z")))):
                raw = unpack([z])[0]
                if copy.as_py():
                    starts, ends = np.array([0] * (len(raw) >= length), np.int64), np.array([len(raw)] * (len(raw) >= length), np.int64)
                else:
                    pairs = found.as_py() or []
                    starts, ends = np.array([p["low"] for p in pairs], np.int64), np.array([p["high"] for p in pairs], np.int64)
                if words and (batch.column("later")[i].as_py() or batch.column("places")[i].is_valid):
                    places = None if batch.column("later")[i].as_py() else batch.column("places")[i].as_py()
                    more = covered(raw, places, words)
                    starts, ends = np.concatenate((starts, more[0])), np.concatenate((ends, more[1]))
                starts, ends = merged(starts, ends)
                kept, last = [], 0
                for a, b in zip(starts.tolist(), ends.tolist()):
                    kept.append(raw[last:a])
                    last = b
                kept = b"".join([*kept, raw[last:]])
                doc = rep.as_py()
                row = (None if doc == LAST else doc, len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if keep else row)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * bool(keep)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)]
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)]
            if keep:
                columns, names = [*columns, batch.column("row")], [*names, "row"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    if not keep:
        return joined.mapInArrow(work, RESULT)
    schema = StructType.fromDDL(RESULT + ", kept binary").add(docs.schema["row"])
    return joined.mapInArrow(work, schema).select("*", "row.*").drop("row")
