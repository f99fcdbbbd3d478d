"""Documents that repeat benchmark items, also with words replaced: spaced seeds.

A mask looks at some of the words of a stretch and ignores the others, so a replaced word under a gap changes
nothing. ``MASKS`` has a set for each length of window, such that whichever words of a window are replaced, as long as
``SHARE`` percent stay, a mask fits between them; only the sets of lengths that the benchmark has are used. Words are lower-cased runs of letters and digits (ASCII punctuation separates). All masks at all
places of the benchmark and of the documents are hashed; documents test their hashes against a bitmap of
fixed size first, and only hits travel, joined into regions with the words around them. Hits meet the benchmark's hashes in
a join; each diagonal (item, region, shift) is then verified: a document is contaminated if on ``WINDOW`` aligned words
(fewer if the item is shorter) at least ``SHARE`` percent are equal.

The bitmap has 2^26 bits whatever the benchmark; a larger benchmark makes it let more through, never less.
Items of fewer than 5 words have to occur as they are, since one replaced word leaves less than the share; items without a word are passed over. NULL or empty texts are clean. A NULL item id
counts as an item; rows that repeat are each judged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.texts import Words, frugal, mixed, slabs, written

WINDOW = 12
SHARE = 80
#: By the words of a window: items shorter than ``WINDOW`` are a window of their own.
MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("10111", "11011", "1111", "11101"),
    6: ("111011", "111101", "101111", "11111", "110111"),
    7: ("1110011", "1001111", "111101"),
    8: ("10111011", "1101111", "11110101"),
    9: ("111101101", "11011111", "11111011", "10111111"),
    10: ("110111", "1100001011", "11100011"),
    11: ("1111011", "110001111", "1101100011"),
    12: ("11111011", "11100101011", "110101111", "11011000111"),
}
AROUND = 48
BITS = 26

_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_FACTORS = np.random.default_rng(4).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def seeds(words: Words, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask of a window the places where it fits into one text, and its hash there."""
    h, found = words.hash[0], []
    last = np.repeat(words.first[1:], np.diff(words.first))
    for m, mask in enumerate(MASKS[window]):
        at = np.flatnonzero(np.arange(len(h)) + len(mask) <= last)
        total = np.full(len(at), 16 * window + m, np.uint64)
        for offset, looked in enumerate(mask):
            if looked == "1":
                total += h[at + offset] * _FACTORS[offset]
        found.append((at, mixed(total)))
    return found


def probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - BITS), (h >> np.uint64(8)) & np.uint64((1 << BITS) - 1)


def cleaned(texts: list[bytes]) -> Words:
    return Words([t.translate(_CLEAN) for t in texts])


def item_words(items: DataFrame) -> DataFrame:
    """item (a number of its own text), item_id and its words as 64-bit hashes."""

    @frugal
    def work(batches):
        for batch in batches:
            for first, texts in slabs(batch.column("text")):
                words, part = cleaned(texts), batch.slice(first, len(texts))
                rows = [words.hash[0][a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("item"), part.column("item_id"), pa.array(rows, pa.binary())], names=["item", "item_id", "words"])

    source = items.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return source.mapInArrow(work, "item long, item_id long, words binary").where(F.octet_length("words") > 0)


def item_seeds(items: DataFrame) -> DataFrame:
    """(h, item, place, size) of every mask of an item's window (``size`` words) at every place of the item."""

    @frugal
    def work(batches):
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = cleaned([(text or "").encode()])
                size = min(WINDOW, len(words.starts))
                for at, h in seeds(words, size) if size else ():
                    n = len(at)
                    arrays = [pa.array(h.view(np.int64)), pa.array(np.full(n, item)), pa.array(at.astype(np.int32)), pa.array(np.full(n, size, np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["h", "item", "place", "size"])

    source = items.select(F.xxhash64("item_id", F.col("text")).alias("item"), "text").distinct()
    return source.mapInArrow(work, "h long, item long, place int, size int")


def bitmap(found: DataFrame) -> np.ndarray:
    """The probes of all seeds as 2^26 bits: at most 2^20 rows of 64 bits come to the driver, whatever the benchmark."""
    bits = F.explode(F.array(F.shiftrightunsigned("h", 64 - BITS), F.shiftrightunsigned("h", 8).bitwiseAND((1 << BITS) - 1)))
    rows = found.select(bits.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
    ones = rows.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("ones")).collect()
    words = np.zeros(1 << (BITS - 6), np.uint64)
    words[[r["word"] for r in ones]] = np.array([r["ones"] for r in ones], np.int64).view(np.uint64)
    return words


def regions(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """Stretches of documents around hits of the masks of ``sizes``: (doc_id, t, start, words, hits)."""

    def firsts(words, at, h):
        """Without the later places of a hash in a text: of an item that has to occur as it is, one place will do."""
        owner = np.searchsorted(words.first, at, side="right") - 1
        order = np.lexsort((at, h, owner))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])))
        return at[order[new]], h[order[new]]

    def has(h):
        out = np.ones(len(h), bool)
        for p in probes(h):
            out &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out

    @frugal
    def work(batches):
        for batch in batches:
            ids, ts = batch.column("doc_id").to_pylist(), batch.column("t").to_pylist()
            for first, texts in slabs(batch.column("text")):
                words = cleaned(texts)
                places, hashes = [], []
                for size in sizes:
                    for at, h in seeds(words, size):
                        hit = has(h)
                        at, h = at[hit], h[hit]
                        if size == len(MASKS[size][0]) == MASKS[size][0].count("1") and len(at):
                            at, h = firsts(words, at, h)
                        places.append(at)
                        hashes.append(h)
                if not sum(map(len, places)):
                    continue
                place, h = np.concatenate(places), np.concatenate(hashes).view(np.int64)
                order = np.argsort(place, kind="stable")
                place, h = place[order], h[order]
                owner = np.searchsorted(words.first, place, side="right") - 1
                new = np.concatenate(([True], (place[1:] - place[:-1] > AROUND) | (owner[1:] != owner[:-1])))
                rows = []
                for a, b in zip(np.flatnonzero(new), [*np.flatnonzero(new)[1:], len(place)]):
                    doc = owner[a]
                    low = max(words.first[doc], place[a] - AROUND)
                    high = min(words.first[doc + 1], place[b - 1] + AROUND + 16)
                    hits = [{"h": int(x), "place": int(p - low)} for x, p in zip(h[a:b], place[a:b])]
                    rows.append((ids[first + doc], ts[first + doc], int(low - words.first[doc]), words.hash[0][low:high].tobytes(), hits))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("h", pa.int64()), ("place", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "t", "start", "words", "hits"])

    source = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return source.mapInArrow(work, "doc_id long, t long, start int, words binary, hits array<struct<h:long,place:int>>")


def verified(pairs: DataFrame) -> DataFrame:
    """Overlaps of item and region words at a shift: equal words of the best window, and the window."""

    @frugal
    def work(batches):
        for batch in batches:
            out = []
            for shift, region, item in zip(*(batch.column(c).to_pylist() for c in ("shift", "words", "item_words"))):
                x, y = np.frombuffer(region, np.uint64), np.frombuffer(item, np.uint64)
                low, high = max(0, shift), min(len(x), shift + len(y))
                same = np.cumsum(np.concatenate(([0], x[low:high] == y[low - shift : high - shift])))
                window = min(WINDOW, len(y))
                out.append(int((same[window:] - same[:-window]).max()) if high - low >= window else 0)
            sizes = [min(WINDOW, len(w) // 8) for w in batch.column("item_words").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("t"), batch.column("item_id"), pa.array(out, pa.int32()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "item_id", "equal", "window"])

    return pairs.mapInArrow(work, "doc_id long, t long, item_id long, equal int, window int")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, t, item_id, equal, window) of each document's overlap with each benchmark item that reaches ``SHARE``; t is its text's hash."""
    tests = written(item_seeds(benchmark), "seeds")
    sizes = sorted(r["size"] for r in tests.select("size").distinct().collect())
    found = written(regions(docs, bitmap(tests), sizes), "regions")
    hits = found.select("doc_id", "t", "start", F.explode("hits").alias("hit")).select("doc_id", "t", "start", "hit.*")
    met = hits.join(tests.select("h", "item", F.col("place").alias("there")), "h")
    shifts = met.select("doc_id", "t", "start", "item", (F.col("place") - F.col("there")).alias("shift")).distinct()
    placed = _with_words(shifts, found)
    items = item_words(benchmark).select("item", "item_id", F.col("words").alias("item_words"))
    best = verified(placed.join(items, "item").select("doc_id", "t", "item_id", "shift", "words", "item_words"))
    best = best.where(F.col("equal") * 100 >= F.col("window") * SHARE)
    return best.groupBy("doc_id", "t", "item_id").agg(F.max(F.struct("equal", "window")).alias("o")).select("doc_id", "t", "item_id", "o.*")


def _with_words(shifts: DataFrame, found: DataFrame) -> DataFrame:
    """``shifts`` with the words of their regions; equal rows of a document share theirs."""
    there = found.select(F.col("t").alias("t2"), F.col("start").alias("start2"), "words").dropDuplicates(["t2", "start2"])
    return shifts.join(there, (F.col("t") == F.col("t2")) & (F.col("start") == F.col("start2"))).drop("t2", "start2")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, n_items, and the item with most equal words (smallest id on a tie)."""
    found = overlaps(docs, benchmark)
    best = F.max_by("item_id", F.struct("equal", (-F.col("item_id")).alias("k")))
    by_text = found.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n_items"), best.alias("item_id"), F.max("equal").alias("equal_words"))
    by_text = written(by_text.withColumnRenamed("doc_id", "d"), "contaminated")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"))
    joined = rows.join(by_text, (rows.t == by_text.t) & rows.doc_id.eqNullSafe(by_text.d), "left")
    count = F.coalesce("n_items", F.lit(0).cast("long"))
    return joined.select("doc_id", (count > 0).alias("contaminated"), count.alias("n_items"), "item_id", "equal_words")
