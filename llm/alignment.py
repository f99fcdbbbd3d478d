"""Alignment of two tokenizers over the same bytes, as Arrow tables inside tasks and counts merged by Spark.

A text is cut at the spaces that stand alone between two characters other than white space. There both
tokenizers start a new token (A's pattern attaches such a space to what follows; no piece of B holds a space after
another character, which is checked), so the units between the cuts align on their own, and each distinct unit of a
slab is encoded and aligned once (A's units of Latin characters, whose classes no Unicode version disputes, by the
faster library, with ranks taken from A's own file; the others by the tokenizers library itself):

1. Token ids of all units are one list array a side; flattening and parent indices give (unit, id), the running sum of
   byte lengths less that at the unit's start gives a token's end, and (unit, end) is the key of a full outer hash join.
2. In order of that key every row is one overlap (link): the next A token and the next B token that end there or later.
   Rows with both sides are common ends and cut the tokens into groups.
3. ``Table.group_by`` counts the id pairs of a slab; Spark merges the partial counts of all slabs, finds the highest
   count of each B id, and sends each slab the counts of its own pairs.

A slab is one row: its documents as unit numbers, its units as pair numbers, and its pairs. It holds at most ``slab``
characters of text or one longer text, and reaches the second step through a stored table, so a text is encoded once.

NULL and empty texts, and texts whose joined B bytes differ from a space and the text, have no tokens: zeros and ''. Repeated
rows count as often as they occur; a NULL id stays NULL; ties of the highest count are all best; extra columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bpe import byte_symbols
from llm.texts import frugal, release, written

SLAB = 6 << 20
#: A single space between two characters that no definition counts as white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
RUN = re.compile(r"\s\s")
OTHER = re.compile("[^\\x00-\u024f]")
FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
ROWS = "slab string, docs binary, units binary, pairs array<long>, counts array<long>"
SIDE = 32
LOW = (1 << SIDE) - 1


class Pair:
    """Both tokenizers and what their tokens stand for in bytes."""

    def __init__(self, byte_level: str, pieces: bytes, pattern: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        spec = json.loads(byte_level)
        known = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        bytes_of = {s: b for b, s in enumerate(byte_symbols())}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        made = [spec["model"]["vocab"][x + y] for x, y in merges]
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError("ids do not follow the order of the merges")
        ranks = {bytes(bytes_of[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        self.latin = tiktoken.Encoding("latin", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        sizes = np.zeros(max(known.values()) + 1, np.int64)
        for text, i in known.items():
            sizes[i] = len(text) if all(c in bytes_of for c in text) else len(text.encode())
        self.a_sizes = pa.array(sizes)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece holds a space after another character: texts cannot be cut at spaces")
        raw = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
        self.b_bytes = pa.array(raw, pa.large_binary())
        self.b_sizes = pa.array([len(r) for r in raw], pa.int64())


@lru_cache(maxsize=1)
def tokenizers(byte_level: str, pieces: bytes, pattern: str) -> Pair:
    """One per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Pair(byte_level, pieces, pattern)


def cut(text: str) -> list[str]:
    """The units of a text; joined by a space they are the text."""
    if not text:
        return []
    if RUN.search(text) is None and not text[0].isspace() and not text[-1].isspace():
        return text.split(" ")
    return CUT.split(text)


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)


def token_ends(ids: pa.Array, sizes: pa.Array) -> pa.Table:
    """(key, id) of each token: its unit above, its end in bytes within the unit below."""
    flat, unit = pc.list_flatten(ids), pc.list_parent_indices(ids).cast(pa.int64())
    sums = pc.cumulative_sum(pc.take(sizes, flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), sums.combine_chunks() if isinstance(sums, pa.ChunkedArray) else sums])
    start = pc.take(pc.take(before, ids.offsets.slice(0, len(ids))), unit)
    return pa.table({"key": pc.add(pc.shift_left(unit, SIDE), pc.subtract(sums, start)), "id": flat})


def joined(values: pa.Array, offsets: np.ndarray, mark: str) -> pa.Array:
    return pc.binary_join(lists(offsets, values), pa.scalar(mark, values.type))


def encoded(units: list[str], pair: Pair) -> list[list[int]]:
    """A's ids of a space and each unit."""
    other, code = OTHER.search, pair.latin.encode_ordinary
    ids = [code(" " + u) if other(u) is None else None for u in units]
    rest = [k for k, x in enumerate(ids) if x is None]
    for k, e in zip(rest, pair.a.encode_batch_fast([" " + units[k] for k in rest], add_special_tokens=False)):
        ids[k] = e.ids
    return ids


def listed(rows: list[list[int]]) -> pa.Array:
    flat = np.fromiter(chain.from_iterable(rows), np.int32)
    return lists(offsets_of(np.fromiter(map(len, rows), np.int64, len(rows))), pa.array(flat))


def emptied(rows: pa.Array, keep: np.ndarray) -> pa.Array:
    """The lists, those not to keep without entries."""
    sizes = pc.list_value_length(rows).to_numpy()
    return rows if keep.all() else lists(offsets_of(sizes * keep), pc.list_flatten(rows).filter(pa.array(np.repeat(keep, sizes))))


class Units:
    """Distinct units, aligned: sizes, overlaps and group strings of each. A unit that B does not give back is not ``fine``."""

    def __init__(self, units: list[str], pair: Pair):
        n = len(units)
        a, b = listed(encoded(units, pair)), listed(pair.b.encode(units, num_threads=1) if n else [])
        text = pa.array([b" " + u.encode() for u in units], pa.large_binary())
        back = joined(pc.take(pair.b_bytes, pc.list_flatten(b)), b.offsets.to_numpy(), b"")
        self.fine = pc.equal(back, text).to_numpy(zero_copy_only=False)
        a, b = emptied(a, self.fine), emptied(b, self.fine)
        self.n_a, self.n_b = (pc.list_value_length(x).to_numpy().astype(np.int64) for x in (a, b))
        ends_a, ends_b = token_ends(a, pair.a_sizes), token_ends(b, pair.b_sizes)
        rows = ends_a.rename_columns(["key", "a"]).join(ends_b.rename_columns(["key", "b"]), "key", join_type="full outer", use_threads=False)
        rows = rows.sort_by("key").combine_chunks()
        common = pc.and_(pc.is_valid(rows["a"]), pc.is_valid(rows["b"]))
        link_a, link_b = (pc.fill_null_backward(rows[c]).cast(pa.int64()) for c in "ab")
        unit = pc.shift_right(rows["key"], SIDE).to_numpy()
        self.n_links = np.bincount(unit, minlength=n)
        self.links = pc.add(pc.shift_left(link_a, SIDE), link_b).to_numpy()
        ends = rows.filter(common)["key"]
        self.n_groups = np.bincount(pc.shift_right(ends, SIDE).to_numpy(), minlength=n)
        sides = []
        for side in (ends_a, ends_b):
            last = np.flatnonzero(pc.is_in(side["key"], value_set=ends).to_numpy()) + 1
            sides.append(joined(pc.cast(side["id"].combine_chunks(), pa.large_string()), np.concatenate(([0], last)), ","))
        groups = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
        self.text = joined(groups, offsets_of(self.n_groups), ";")


def packed_table(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue()


def unpacked_table(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def slab_row(doc_ids: list[int | None], texts: list[str], pair: Pair) -> tuple:
    """One row of ``ROWS`` for some documents."""
    cuts = [pa.array(cut(t), pa.large_string()) for t in texts]
    coded = pa.concat_arrays(cuts).dictionary_encode()
    units = Units(coded.dictionary.to_pylist(), pair)
    numbers = coded.indices.to_numpy().astype(np.int32)
    at = offsets_of(np.fromiter(map(len, cuts), np.int64, len(cuts)))
    bad = np.concatenate(([0], np.cumsum(~units.fine[numbers])))
    whole = bad[at[1:]] == bad[at[:-1]]
    held = np.repeat(whole, np.diff(at))
    numbers, at = numbers[held], offsets_of(np.where(whole, np.diff(at), 0))
    strings = joined(pc.take(units.text, pa.array(numbers)), at, ";")
    sha = [hashlib.sha256(s.as_buffer()).hexdigest() if m else "" for s, m in zip(strings, np.diff(at))]
    per_doc = {c: summed(getattr(units, c)[numbers], at) for c in ("n_a", "n_b", "n_groups", "n_links")}
    docs = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), **per_doc, "groups_sha256": sha, "units": lists(at, pa.array(numbers))})
    times = np.bincount(numbers, minlength=len(units.fine))
    weights = np.repeat(times, units.n_links)
    counted = pa.table({"pair": units.links[weights > 0], "n": weights[weights > 0]}).group_by("pair", use_threads=False)
    counted = counted.aggregate([("n", "sum")]).sort_by("pair")
    pairs = counted["pair"].to_numpy()
    place = np.searchsorted(pairs, units.links)
    place[place == len(pairs)] = 0
    used = np.where(weights > 0, place, -1).astype(np.int32)
    own = pa.table({"pairs": lists(offsets_of(units.n_links), pa.array(used))})
    return packed_table(docs), packed_table(own), pairs, counted["n_sum"].to_numpy()


def summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive stretches: a running sum, less that at the stretch's start."""
    sums = offsets_of(values)
    return sums[at[1:]] - sums[at[:-1]]


def slab_counts(docs: bytes, units: bytes, known: pa.Table) -> pa.Table:
    """Documents of a slab with the sums over their links; ``known`` has pair, n and best of each pair of the slab."""
    known = known.sort_by("pair")
    docs, own = unpacked_table(docs), unpacked_table(units)["pairs"].combine_chunks()
    place, at = pc.list_flatten(own).to_numpy(), own.offsets.to_numpy()
    found = {}
    for name in ("n", "best"):
        values = np.concatenate((known[name].to_numpy().astype(np.int64), [0]))
        found[name] = summed(values[place], at)
    numbers = docs["units"].combine_chunks()
    which, ends = pc.list_flatten(numbers).to_numpy(), numbers.offsets.to_numpy()
    best, total = (summed(found[name][which], ends) for name in ("best", "n"))
    docs = docs.drop_columns("units").append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))
    return docs.select([f.split()[0] for f in FIELDS.split(", ")])


def _slabs(batches, pair: Pair, slab: int):
    """(ids, texts) of consecutive documents, up to ``slab`` characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id"), batch.column("text")):
            t = t.as_py() or ""
            if texts and size + len(t) > slab:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i.as_py())
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts


def align(docs: DataFrame, byte_level: str, pieces: bytes, pattern: str, slab: int = SLAB) -> DataFrame:
    """``FIELDS`` of each row of ``docs`` (doc_id, text). ``byte_level``: tokenizer file A, which splits by ``pattern``; ``pieces``: model file B."""

    @frugal
    def encode(batches):
        pair = tokenizers(byte_level, pieces, pattern)
        for ids, texts in _slabs(batches, pair, slab):
            row = (uuid.uuid4().hex, *slab_row(ids, texts, pair))
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[f.split()[0] for f in ROWS.split(", ")])
            del row
            release()

    def finish(_, own: pa.Table, known: pa.Table) -> pa.Table:
        return slab_counts(own["docs"][0].as_py(), own["units"][0].as_py(), known)

    slabs = written(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(encode, ROWS), "slabs")
    partial = slabs.select("slab", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("slab", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = written(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    other = F.col("pair").bitwiseAND(F.lit(LOW)).alias("b")
    # one row for each id of B's vocabulary at most
    highest = counts.groupBy(other).agg(F.max("n").alias("most"))
    marked = counts.withColumn("b", other).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = partial.select(F.col("slab").alias("asked"), "pair").join(marked, "pair")
    return slabs.select("slab", "docs", "units").groupBy("slab").cogroup(answers.groupBy("asked")).applyInArrow(finish, FIELDS)
