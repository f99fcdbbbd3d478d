"""Token ids in files of bit planes.

A shard file holds the ids of consecutive documents in ascending doc_id order, cut into chunks of
``CHUNK`` ids. A chunk is transposed: plane k has bit k (or byte k) of each of its ids, and each plane that
is not all zero is compressed with zstandard. After the chunks come the document index (ids and
lengths) and the chunk index (place, size, first id, planes), so any chunk can be read alone.

    file     magic, chunks, documents, chunk index (JSON), its length (8 bytes), magic
    chunk    compressed planes, lowest first

Tasks write shards under names of their own attempt, and only the shards of attempts that succeeded
enter the manifest, a Parquet table; what a lost executor left behind is never read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.bpe import LONGEST, Encoder
from llm.texts import frugal, written

MAGIC = b"IDPLANE1"
CHUNK = 65_536
END = 1
REMEMBERED = 500_000
NO_ID = -(2**63)


def transpose(ids: np.ndarray, planes: str = "bit") -> list[np.ndarray]:
    """The planes of 32-bit ids, lowest first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(octets[:, k]) for k in range(4)]
    used = 4 - int(np.argmax(octets.any(axis=0)[::-1])) if octets.any() else 0
    bits = np.unpackbits(octets[:, :used], axis=1, bitorder="little") if used else np.zeros((len(ids), 0), np.uint8)
    return [np.packbits(bits[:, k], bitorder="little") for k in range(bits.shape[1])]


def restore(planes: dict[int, np.ndarray], n: int, kind: str = "bit") -> np.ndarray:
    """Ids from their planes; a plane that is not there is all zero."""
    octets = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, plane in planes.items():
            octets[:, k] = plane
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, plane in planes.items():
            bits[:, k] = np.unpackbits(plane, count=n, bitorder="little")
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


class ShardWriter:
    def __init__(self, out, planes: str = "bit"):
        self.out, self.planes, self.at = out, planes, len(MAGIC)
        self.chunks, self.docs, self.held, self.waiting, self.total = [], [], [], 0, 0
        self.press = zstandard.ZstdCompressor(level=3)
        out.write(MAGIC)

    def _chunk(self, ids: np.ndarray) -> None:
        parts = {k: self.press.compress(p.tobytes()) for k, p in enumerate(transpose(ids, self.planes)) if p.any()}
        size = sum(map(len, parts.values()))
        self.chunks.append({"at": self.at, "ids": len(ids), "first": self.total, "planes": [[k, len(p)] for k, p in parts.items()]})
        self.out.write(b"".join(parts.values()))
        self.at, self.total = self.at + size, self.total + len(ids)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NO_ID if doc_id is None else doc_id, len(ids)))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= CHUNK:
            flat = np.concatenate(self.held)
            whole = len(flat) // CHUNK * CHUNK
            for i in range(0, whole, CHUNK):
                self._chunk(flat[i : i + CHUNK])
            self.held, self.waiting = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.waiting:
            self._chunk(np.concatenate(self.held))
        docs = self.press.compress(np.array(self.docs, "<i8").reshape(-1, 2).tobytes())
        index = {"planes": self.planes, "chunks": self.chunks, "documents": {"at": self.at, "size": len(docs), "n": len(self.docs)}}
        text = json.dumps(index).encode()
        self.out.write(docs + text + len(text).to_bytes(8, "little") + MAGIC)


class ShardReader:
    def __init__(self, file):
        self.file, tail = file, len(MAGIC) + 8
        size = file.size()
        end = file.read_at(tail, size - tail)
        if file.read_at(len(MAGIC), 0) != MAGIC or end[8:] != MAGIC:
            raise ValueError("not a bit-plane file")
        length = int.from_bytes(end[:8], "little")
        self.index = json.loads(file.read_at(length, size - tail - length))
        self.opener = zstandard.ZstdDecompressor()

    def documents(self) -> np.ndarray:
        """doc_id and number of ids of each document; ``NO_ID`` for NULL."""
        place = self.index["documents"]
        return np.frombuffer(self.opener.decompress(self.file.read_at(place["size"], place["at"])), "<i8").reshape(-1, 2)

    def chunk(self, k: int) -> np.ndarray:
        entry = self.index["chunks"][k]
        raw, at, planes = self.file.read_at(sum(n for _, n in entry["planes"]), entry["at"]), 0, {}
        for plane, n in entry["planes"]:
            planes[plane] = np.frombuffer(self.opener.decompress(raw[at : at + n]), np.uint8)
            at += n
        return restore(planes, entry["ids"], self.index["planes"])

    def pieces(self):
        """(document number, ids) in order; a document that spans chunks comes in several pieces."""
        ends = np.cumsum(self.documents()[:, 1])
        doc, at = 0, 0
        for k in range(len(self.index["chunks"])):
            ids, used = self.chunk(k), 0
            while used < len(ids):
                while ends[doc] <= at:
                    doc += 1
                take = min(len(ids) - used, int(ends[doc]) - at)
                yield doc, ids[used : used + take]
                used, at = used + take, at + take


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


#: Characters for which the splitting pattern, lower case and NFC could differ between libraries or Unicode versions.
OTHER = re.compile("[^\\x00-\u024f]|[\\x85\\xa0\u0130]")


class LibraryEncoder(Encoder):
    """Ids by the tokenizers library; words and pieces that were seen are not encoded again.

    Texts are cut at ASCII white space, which parts words in the library too, special tokens or not. The library takes the unseen pieces in one call, joined by spaces; each piece ends at the one id with the end-of-word
    suffix. Words with other than Latin characters go to it whole.
    """

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        super().__init__(text)
        self.library = Tokenizer.from_str(text)
        self.closing = np.array([s.endswith(self.suffix) for s in self.strings]) if self.suffix else None
        self.short: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.pieced: dict[str, bytes] = {}

    def whole(self, words: list[str]) -> dict[str, bytes]:
        found = self.library.encode_batch_fast(words, add_special_tokens=False) if words else []
        return {w: pack(f"<{len(e.ids)}I", *e.ids) for w, e in zip(words, found)}

    def split(self, word: str) -> list[str]:
        """The pieces of a word of Latin characters."""
        low = word.lower()
        if low.isalpha():
            return [low]
        if low[-1] in ",.;:!?" and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.pieces.findall(low)

    def unseen(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered."""
        if self.closing is None:
            return self.whole(words)
        split = {w: self.split(w) for w in words if w and OTHER.search(w) is None and self.marks.search(w) is None}
        new = list({p for pieces in split.values() for p in pieces} - self.pieced.keys())
        if new:
            ids = np.array(self.library.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(new):
                return self.whole(words)
            raw, at = ids.tobytes(), (4 * ends).tolist()
            self.pieced.update(zip(new, (raw[i:j] for i, j in zip([0, *at], at))))
        known = self.pieced.__getitem__
        found = {w: b"".join(map(known, pieces)) for w, pieces in split.items()}
        if len(self.pieced) > REMEMBERED:
            self.pieced = {}
        return found | self.whole([w for w in words if w not in split])

    def remembered(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        missing = [w for w in words if w not in self.short]
        again = {w: self.aged[w] for w in missing if w in self.aged}
        self.short |= again | self.unseen([w for w in missing if w not in again])
        found = list(map(self.short.__getitem__, words))
        for w in missing:
            if len(w) > LONGEST:
                del self.short[w]
        if len(self.short) >= REMEMBERED:
            self.aged, self.short = self.short, {}
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin. Each distinct word is looked up once."""
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = words.flatten().dictionary_encode()
        known = pa.array(self.remembered(coded.dictionary.to_pylist()), pa.large_binary())
        flat = known.take(coded.indices)
        ends = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        starts = np.concatenate(([0], np.cumsum(ends)))
        at = np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy())))
        raw = flat.buffers()[2]
        return np.frombuffer(raw, "<u4", starts[-1]) if raw and starts[-1] else np.zeros(0, "<u4"), starts[at]


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(text: str) -> LibraryEncoder:
    if text not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[text] = LibraryEncoder(text)
    return _ENCODERS[text]


MANIFEST = "file string, low long, documents long, ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, planes: str = "bit") -> DataFrame:
    """Write the shards of ``docs`` (doc_id, text) and return the manifest with each shard's first id.

    Documents are dealt by ranges of doc_id; equal ids stay together and are ordered by a hash of their text. NULL ids come first, NULL texts are empty.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    dealt = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    store(folder)[0].create_dir(store(folder)[1], recursive=True)

    @frugal
    def work(batches):
        files, root = store(folder)
        name = f"{root}/shard-{uuid.uuid4().hex}.idp"
        code, writer, out, low = library_encoder(tokenizer), None, None, None
        for batch in batches:
            found, starts = code.ids(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), starts[:-1], starts[1:]):
                if writer is None:
                    out, low = files.open_output_stream(name), doc_id
                    writer = ShardWriter(out, planes)
                writer.add(doc_id, np.append(found[a:b], np.uint32(END)))
        if writer is not None:
            writer.close()
            out.close()
            row = {"file": name, "low": low, "documents": len(writer.docs), "ids": writer.total}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), ("low", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())]))

    manifest = written(dealt.mapInArrow(work, MANIFEST), "id-shards")
    before = Window.orderBy(F.asc_nulls_first("low")).rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids, from the shard files alone and the shards' first ids."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches):
        files, _ = store(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with files.open_input_file(name) as file:
                    shard = ShardReader(file)
                    docs = shard.documents()
                    crc = np.zeros(len(docs), np.int64)
                    for doc, ids in shard.pieces():
                        crc[doc] = zlib.crc32(ids.tobytes(), int(crc[doc]))
                starts = first + np.concatenate(([0], np.cumsum(docs[:, 1])[:-1]))
                key = pa.array(docs[:, 0], pa.int64(), mask=docs[:, 0] == NO_ID)
                arrays = [key, pa.array(starts, pa.int64()), pa.array(docs[:, 1], pa.int64()), pa.array(crc)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("file", "start").repartition(n).mapInArrow(work, DOCUMENTS)
