"""Passages of 50 words that are shorter than 400 bytes: the pipeline cuts them, and op3's operator with ``words`` against a plain version."""

import random
import re

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_kept(rows, length, window):
    """[(doc_id, text, kept bytes)]: strings of ``length`` bytes found twice go, then words of windows that a smaller id has too."""
    seen, first, out = {}, {}, []
    rank = lambda i: float("inf") if i is None else i
    split = [(i, t, (t or "").encode(), list(WORD.finditer((t or "").encode()))) for i, t in rows]
    for i, _, raw, words in split:
        for s in range(len(raw) - length + 1):
            seen[raw[s : s + length]] = seen.get(raw[s : s + length], 0) + 1
        for s in range(len(words) - window + 1):
            key = tuple(w[0] for w in words[s : s + window])
            first[key] = min(first.get(key, float("inf")), rank(i))
    for i, t, raw, words in split:
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        for s in range(len(words) - window + 1):
            if first[tuple(w[0] for w in words[s : s + window])] < rank(i):
                a, b = words[s].start(), words[s + window].start() if s + window < len(words) else len(raw)
                gone[a:b] = b"\1" * (b - a)
        out.append((i, t, bytes(x for x, g in zip(raw, gone) if not g)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_words_of_repeated_windows_go_too(table, seed):
    from llm.suffix_dedup import remove_repeated_bytes

    r = random.Random(seed)
    blank = lambda: r.choice([" ", "  ", "\n", "\t "])
    text = lambda n: "".join(r.choice(["a", "bé", "xyz", "日本", "longerword"]) + str(r.randrange(60)) + blank() for _ in range(n))
    shared = [[f"{w}{k}" for w in range(36)] for k in range(6)]
    rows = [(i, text(r.randrange(12)) + blank().join(r.choice(shared)) + blank() + text(r.randrange(12))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, rows[3][1]), (43, rows[3][1]), (5, rows[5][1]), (None, rows[6][1]), (None, text(4) + rows[7][1]), (44, " ".join(shared[0]))]
    docs = table(rows)
    got = remove_repeated_bytes(docs, 160, keep=("text", "rep"), words=32).collect()
    key = lambda x: (str(x[0]), str(x[1]), x[2])
    assert sorted(((x.doc_id, x.text, bytes(x.kept)) for x in got), key=key) == sorted(plain_kept(rows, 160, 32), key=key)
    assert all(x.rep == "x" and x.n_removed == x.n_bytes - len(x.kept) for x in got)
    bare = {(x.doc_id, x.n_bytes): x.n_removed for x in remove_repeated_bytes(docs, 160).collect()}
    assert sum(bare.values()) < sum(x.n_removed for x in got)


def test_pipeline_cuts_passages_of_fifty_words(spark):
    """55 words in 219 bytes, found in several documents: the smallest doc_id keeps them."""
    import corpus_pipeline

    passage = " ".join(f"p{k:02}" for k in range(55))
    own = {i: " ".join(f"w{i}x{k}" for k in range(60)) for i in (1, 2, 3, 4)}
    rows = [
        (3, f"{own[3]} {passage}", 7, "x"), (1, f"{own[1]} �\n{passage}\nend", 7, "x"), (2, f"{own[2]}\n{passage}\nfin", 7, "x"),
        (4, f"{own[4]} {passage[:-1]}é", 7, "x"), (5, None, 7, "x"), (6, " ", 7, "x"), (7, passage, 7, "x"),
        (None, f"{passage} last", 7, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, none string")
    out = corpus_pipeline.suffix_dedup(spark, docs, "")
    assert out.schema.names == docs.schema.names
    got = {x.doc_id: (x.text, x.n_chars, x.none) for x in out.collect()}
    cut = {2: f"{own[2]}\nfin", 3: f"{own[3]} ", 4: f"{own[4]} p5é", None: "last"}
    assert got[1] == (rows[1][1], 7, "x") and got[5] == (None, 7, "x") and got[6] == (" ", 7, "x")
    assert {i: got[i] for i in cut} == {i: (text, len(text), "x") for i, text in cut.items()}
    assert 7 not in got and len(got) == 7
