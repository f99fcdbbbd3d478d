"""Encoding and decoding a column of texts, batch by batch; no shuffle."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from llm.bpe import encoder
from llm.texts import frugal

SCHEMA = "n_tokens long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def tokenizer_text(path: str) -> str:
    """The tokenizer file, read by the driver and sent with the tasks: a few megabytes at most, whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_texts(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with n_tokens, ids (little-endian unsigned 32-bit) and the decoded text of each row's ``text``."""
    source = docs.select(*keep, "text")

    @frugal
    def work(batches):
        code = encoder(tokenizer)
        try:
            yield from coded(code, batches)
        finally:
            code.forget()

    def coded(code, batches):
        for batch in batches:
            step = 256
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                done = [code.encode(t or "") for t in part.column("text").to_pylist()]
                columns = [len(ids) // 4 for ids, _ in done], [ids for ids, _ in done], [text for _, text in done]
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=[*keep, "n_tokens", "ids", "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(work, f"{kept}, {SCHEMA}")


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text, without sending either to Spark."""

    def work(batches):
        code = encoder(tokenizer)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                ids, decoded = code.encode(text.as_py() or "")
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            counts, first, second = zip(*out) if out else ((), (), ())
            arrays = [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, DIGESTS)
