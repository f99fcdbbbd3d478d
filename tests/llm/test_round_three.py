"""Alignment, prefix trie and secret scan against plain versions, with NULLs, ties, repeated rows, long and empty input."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter
from itertools import accumulate
from urllib.parse import quote

import duckdb
import public_tokenizers
import pytest

TEXTS = [
    (1, "a  b\n c\n\n d  "), (2, " x"), (3, "\n"), (4, "ﬁ ½ x"), (5, "<|endoftext|> and </s> 日本語 　 x"), (6, "é é \U0001f600 a b"),
    (7, None), (8, ""), (9, "a\t b \x1c c\xa0d it's ▁x ▁ y 123 45,6 ...  "), (None, "the the the"), (10, "the the the"), (10, "the the the"),
    (11, "Ünïcöde wörds, and the the rest.\r\nNext line  with   runs"), (12, "w" * 3000), (13, "ab cd " * 4000),
]


def plain_alignment(rows):
    """Every field by encoding whole texts and comparing all tokens of a document."""
    import sentencepiece
    from tokenizers import Tokenizer

    from llm.bpe import byte_symbols

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {s: x for x, s in enumerate(byte_symbols())}
    found, counts = [], Counter()
    for i, text in rows:
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        names = [b.id_to_piece(x) for x in ids[1]]
        raw = (
            [bytes(byte_of[c] for c in a.id_to_token(x)) for x in ids[0]],
            [bytes([int(n[3:5], 16)]) if n.startswith("<0x") else n.replace("▁", " ").encode() for n in names],
        )
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(r) != whole for r in raw):
            found.append((i, None, None, None))
            continue
        ends = []
        for r in raw:
            ends.append(list(accumulate(map(len, r))))
        both, groups = set(ends[0]) & set(ends[1]), []
        for side in (0, 1):
            parts = [[]]
            for x, e in zip(ids[side], ends[side]):
                parts[-1].append(str(x))
                if e in both:
                    parts.append([])
            groups.append([",".join(p) for p in parts[:-1]])
        links, i_a, i_b = [], 0, 0
        while i_a < len(ids[0]) and i_b < len(ids[1]):
            links.append((ids[0][i_a], ids[1][i_b]))
            x, y = ends[0][i_a], ends[1][i_b]
            i_a, i_b = i_a + (x <= y), i_b + (y <= x)
        counts.update(links)
        found.append((i, ids, links, ";".join("|".join(g) for g in zip(*groups))))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for i, ids, links, text in found:
        if ids is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        best = sum(counts[link] == most[link[1]] for link in links)
        out.append((i, len(ids[0]), len(ids[1]), text.count(";") + 1, len(links), best, sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


def aligned(docs, slab):
    from llm.alignment import align

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as model:
        return align(docs, file.read(), model.read(), public_tokenizers.PATTERN, slab)


@pytest.mark.parametrize("slab", [10, 1 << 20])
def test_alignment(spark, table, slab):
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 25").select("doc_id", "text").collect()
    rows = TEXTS + [(r.doc_id, r.text) for r in sample]
    got = aligned(table(rows), slab)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_alignment(rows)
    assert aligned(table([]), slab).count() == 0


def test_latin_units_agree_with_the_tokenizers_library():
    from llm.alignment import OTHER, Pair, encoded

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as model:
        pair = Pair(file.read(), model.read(), public_tokenizers.PATTERN)
    r = random.Random(5)
    units = ["".join(chr(r.choice((r.randrange(1, 0x250), r.randrange(32, 127)))) for _ in range(r.randint(1, 12))) for _ in range(4000)]
    assert all(OTHER.search(u) is None for u in units) and OTHER.search("aж")
    assert encoded(units, pair) == [e.ids for e in pair.a.encode_batch([" " + u for u in units], add_special_tokens=False)]


def talks(seed, deep):
    """Conversations that branch from few openings; one of ``deep`` turns and a copy of it, ties, NULLs and repeated rows."""
    r = random.Random(seed)
    rows = []
    for c in [*range(60), 100, 119, 205, -20, -7, -45]:
        for t in range(r.randint(0, 7)):
            rows.append((c, t, r.choice(["user", None]), r.choice(["a b", "c", "", None])))
    for c in (400, 420, 421):
        rows += [(c, t, "user", f"w{t % 3} x") for t in range(deep)]
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (8, 1, "x", "tie b"), (8, 1, "x", "tie a"), (None, 1, "x", "gone"), (300, 5, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("band,deep", [(2, 37), (3, 9), (16, 40)])
def test_prefix_trie(spark, band, deep):
    from llm.prefix_trie import prefix_trie
    from llm.queries.op12 import TRIE_SQL

    schema = "conv_id long, turn long, role string, text string, k1 string, depth string, i string"
    conversations = spark.createDataFrame([(*row, "k", "d", "i") for row in talks(band, deep)], schema)
    found = prefix_trie(conversations, band)
    columns = sorted(found.columns)
    con = duckdb.connect()
    con.register("conversations", conversations.toPandas().astype({"turn": "Int64", "conv_id": "Int64"}))
    cursor = con.execute(TRIE_SQL)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(str(tuple(row[names.index(c)] for c in columns)) for row in cursor.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in found.collect()) == want
    assert prefix_trie(conversations.limit(0), band).count() == 0


def test_one_conversation_over_many_parts(spark):
    """Places and prefixes of a conversation that holds most rows are exact although it spans several parts and chunks."""
    from llm import prefix_trie

    rows = spark.range(9000).selectExpr("cast(3 as long) conv_id", "id as turn", "'u' as role", "cast(id % 5 as string) as text")
    rows = rows.unionByName(spark.range(40).selectExpr("id as conv_id", "cast(0 as long) turn", "'u' as role", "'0' as text").where("conv_id <> 3"))
    got = {(r.conv_id, r.depth): r for r in prefix_trie.prefix_trie(rows).collect()}
    assert len([k for k in got if k[0] == 3]) >= 8990 and max(d for _, d in got) == 9000 - zlib.crc32(b"3") % 4 + min(zlib.crc32(b"3") % 4, 1)
    assert got[0, 0].n_convs == 40


SECRET = "password = hunter2secret"


@pytest.mark.parametrize(
    "text,want",
    [
        (SECRET, {"assign:0:24"}),
        ("x " + quote(SECRET, safe="") + " y", {"assign:2:32"}),
        ("a " + quote(quote(SECRET, safe=""), safe=""), {"assign:2:38"}),
        ("say " + base64.b64encode(b"my " + SECRET.encode()).decode() + " ok", {"assign:8:40"}),
        ("tok%65n:abcdefghi", {"assign:0:17"}),
        ("".join(f"\\u{ord(c):04x}" for c in SECRET), {"assign:0:144"}),
        ("é" + "".join(f"&#x{ord(c):x};" for c in SECRET), {f"assign:1:{1 + 6 * 24}"}),
        ("to\u212aen=abcdefghij ſecret=abcdefghij toKen=abcdefgh", {"assign:35:49"}),
        ("token=abcdefg AKIA" + "A" * 11 + " " + "a" * 31, set()),
        ("API-key API_KEY:'ABCD/efg+=' AKIA" + "9" * 12 + "x " + "0f" * 16, {"assign:8:27", "access:29:45", "hex:47:79"}),
        ("%" + "25" * 20_000 + "41 token=abc", {"hex:1:40003"}),
        ("", set()),
    ],
)
def test_secrets(table, text, want):
    from llm.secret_scan import find_secrets

    row = find_secrets(table([(1, text)])).first()
    assert set(filter(None, row.spans.split(","))) == want


def test_compressed_layers_and_cycles():
    from llm.secret_scan import Worklist

    def spans(text, **more):
        return Worklist(text, **more).spans

    once = base64.b64encode(gzip.compress(SECRET.encode())).decode()
    twice = base64.b64encode(zlib.compress(gzip.compress(once.encode()))).decode()
    for code in (once, twice, base64.b64encode(once.encode()).decode()):
        assert [(k, f"x {code}"[a:b].rstrip("=")) for a, k, b in spans(f"x {code}")] == [(0, code.rstrip("="))] or spans(f"x {code}") == {(2, 0, 2 + len(code))}
    assert spans(quote(gzip.compress(SECRET.encode()), safe="")) == {(0, 0, len(quote(gzip.compress(SECRET.encode()), safe="")))}
    bomb = base64.b64encode(gzip.compress(b"token=abcdefgh " * 100_000)).decode()
    assert Worklist(bomb, most=1000).unopened == 1 and not spans(bomb, most=1000) and spans(bomb)
    lines = base64.encodebytes(b"some words before it. " * 6 + SECRET.encode()).decode()
    assert len(spans(lines)) == 1


def test_secret_rows(table):
    """Base spans against the patterns over whole texts; a 2 MB text, NULLs, repeated rows and an empty table."""
    from llm.secret_scan import ACCESS, ASSIGN, HEX, find_secrets

    r = random.Random(3)
    bits = ["token:abcdefgh1", "secret=short", "AKIA0123456789ABCD", "0a" * 17, "Api_Key : \"x/y+zzzzzz", "word ", "é", " ", "\n", "deadbeef", "passwd='", "A" * 20]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randint(0, 30)))) for k in range(200)]
    rows += [(None, None), (None, "token=abcdefgh"), (1, rows[1][1]), (900, "lorem ipsum " * 180_000 + "token=abcdefgh")]

    def base(text):
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        return *(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined

    got = find_secrets(table(rows)).collect()
    assert sorted(str((x.doc_id, x.n_assign, x.n_access, x.n_hex, x.base_sha256)) for x in got) == sorted(str((i, *base(t or "")[:4])) for i, t in rows)
    assert all(set(filter(None, base(t or "")[4].split(","))) <= {s for x in got if x.doc_id == i for s in x.spans.split(",")} for i, t in rows)
    assert find_secrets(table([])).count() == 0
