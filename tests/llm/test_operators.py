"""Operators against brute force, round trips and held-out rows, with NULLs, empty and repeated rows, and empty tables."""

import os
import random
import zlib

import numpy as np
import pytest

from brute import kept_bytes, kept_words, near_components

ODD = [(None, None), (None, "a b c"), (1, ""), (2, "x" * 900), (3, "ab " * 400), (3, "ab " * 400), (4, "é" * 450), (5, " \t\n")]


def passages(seed, pieces=12, rows=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    pool = [[r.choice(words) for _ in range(r.randint(30, 150))] for _ in range(pieces)]
    docs = list(ODD)
    for i in range(10, 10 + rows):
        parts = []
        for _ in range(r.randint(0, 4)):
            part = r.choice(pool) if r.random() < 0.6 else [r.choice(words) for _ in range(r.randint(5, 150))]
            parts += part[r.randint(0, 15) :] if r.random() < 0.4 else part
        docs.append((i, " ".join(parts)))
    return docs + [(200 + k, docs[12 + k][1]) for k in range(8)]


def test_word_windows(table):
    from llm.substring_dedup import remove_repeats

    docs = passages(1)
    want = kept_words(docs)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(table(docs)).collect())
    assert got == sorted((str(i), *want[i, t]) for i, t in docs)
    assert remove_repeats(table([])).count() == 0


@pytest.mark.parametrize("length,hot", [(400, 20_000), (60, 20_000), (60, 0)])
def test_byte_strings(table, length, hot):
    from llm.suffix_dedup import remove_repeated_bytes

    docs = passages(2, rows=30)
    want = kept_bytes(docs, length)
    found = remove_repeated_bytes(table(docs), length, hot).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == sorted((str(i), *want[i, t]) for i, t in docs)


def test_buckets_of_a_shared_header(spark):
    """Fragments with different leads do not all land in one bucket because their first 100 bytes are equal."""
    from pyspark.sql import functions as F

    from llm.suffix_dedup import dealt

    header = b"h" * 100
    rows = [(k.to_bytes(4, "big"), header + b"%06d" % (k // 2) * 50, 0, 0) for k in range(4000)]
    groups = spark.createDataFrame(rows, "x binary, z binary, low int, high int")
    buckets = dealt(groups, 400, 20).withColumn("bucket", F.spark_partition_id())
    sizes = [r["count"] for r in buckets.groupBy("bucket").count().collect()]
    assert max(sizes) < 1000
    assert buckets.groupBy("z").agg(F.count_distinct("bucket").alias("n")).where("n > 1").count() == 0


def test_multikey_quicksort():
    from llm.suffix_dedup import multikey_quicksort

    r = random.Random(3)
    texts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 40))) for _ in range(500)]
    assert [texts[i] for i in multikey_quicksort(texts)] == sorted(texts)


def test_near_components(table):
    from llm.near_dedup import near_duplicates

    r = random.Random(4)
    words = ["".join(r.choice("abcdABC") for _ in range(4)) for _ in range(400)]
    docs, i = [(0, None), (1, ""), (2, "x"), (3, "X"), (5, "x y z w x y z w")], 10
    while i < 200:
        base = [r.choice(words) for _ in range(r.randint(30, 150))]
        for _ in range(r.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(r.randint(0, len(base) // 25)):
                copy[r.randrange(len(copy))] = r.choice(words)
            docs.append((i, " ".join(copy)))
            i += 1
    want = near_components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(docs)).collect()}
    assert got == want


def test_near_pairs_among_boilerplate(table):
    """Every text shares most of its words with all others, at under 0.8; some have one partner at over 0.8."""
    from llm.near_dedup import near_duplicates

    r, docs, partner = random.Random(5), [], {}
    common, made = [f"c{k}" for k in range(203)], iter(range(10**6))
    fresh = lambda n: [f"u{next(made)}" for _ in range(n)]
    for i in range(3000):
        own = fresh(33)
        docs.append((i, " ".join(common + own)))
        if i % 10 == 0:
            partner[10_000 + i] = i
            docs.append((10_000 + i, " ".join(common + own[:11] + fresh(22))))
    r.shuffle(docs)
    a, b = (set(zip(*(x[k:] for k in range(4)))) for x in (dict(docs)[0].split(), dict(docs)[10_000].split()))
    c = set(zip(*((dict(docs)[1].split())[k:] for k in range(4))))
    assert len(a & b) >= 0.8 * len(a | b) and len(a & c) < 0.8 * len(a | c) > 0 and len(b & c) < 0.8 * len(b | c)
    got = {x.doc_id: x.component_id for x in near_duplicates(table(docs)).collect()}
    assert got == {i: partner.get(i, i) for i, _ in docs}


def test_bpe_matches_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from llm.bpe import encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        code = encoder(file.read())
    library = Tokenizer.from_file(path)
    r = random.Random(3)
    letters = [*"aAbSétT'’ sLdD\t\n\x0b\x1c\x85\xa0中文😀1٣²ΣσİßẞĿ\x00_-!,<|>", "<|endoftext|>", "<|startoftext|>", "'ll", "a" * 80]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        want = library.encode(text, add_special_tokens=False).ids
        ids, decoded = code.encode(text)
        assert list(np.frombuffer(ids, "<u4")) == want
        assert decoded == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    from llm.bit_planes import restore, transpose

    for ids in (np.array([], "<u4"), np.arange(1000, dtype="<u4"), np.array([0, 2**32 - 1, 49_405], "<u4")):
        planes = dict(enumerate(transpose(ids, kind)))
        assert (restore(planes, len(ids), kind) == ids).all()


def test_shards(table, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from framevitals.sources.scratch import fresh_path
    from llm.bit_planes import read_shards, write_shards
    from llm.bpe_frame import tokenizer_text

    text = tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(4)
    odd = ["".join(chr(r.choice((r.randrange(1, 0x260), r.randrange(32, 127), 0x130, 32, 39, 0x301, 0x4E00, 0xA0, 0x1C))) for _ in range(60)) for _ in range(200)]
    odd += ["a<|endoftext|>b <|startoftext|> I'LL we've 12 3a...", "İİ é é", "word, " * 350_000]
    docs, folder = passages(6) + list(enumerate(odd, 1000)), fresh_path(spark, "planes")
    got = read_shards(write_shards(table(docs), text, folder), folder).collect()
    library, sizes = Tokenizer.from_str(text), {}
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        sizes.setdefault(str(i), []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((i, *x) for i, xs in sizes.items() for x in xs)
    placed = sorted(got, key=lambda r: r.start)
    assert [r.start for r in placed] == [0, *np.cumsum([r.n_tokens for r in placed])[:-1]]
    assert [r.doc_id for r in placed if r.doc_id is not None] == sorted(r.doc_id for r in placed if r.doc_id is not None)


def test_warc_round_trip(spark):
    from framevitals.sources.scratch import fresh_path
    from llm.warc import read_archives, resolve_revisits, write_archives

    rows = [(1, "http://a/\r\nb", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (5, "u", "WARC/1.1\r\n\r\né")]
    path = fresh_path(spark, "warc")
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: r for r in resolve_revisits(read_archives(spark, path)).collect()}
    assert {i: (r.record_type, r.refers_to, r.original_bytes) for i, r in got.items()} == {
        1: ("response", None, 4), 2: ("revisit", 1, 4), None: ("revisit", 1, 4), 3: ("response", None, 0), 4: ("revisit", 3, 0), 5: ("response", None, 14),
    }
    assert got[5].payload.decode() == "WARC/1.1\r\n\r\né" and got[5].digest_ok


def test_spaced_seeds_tolerate_replaced_words(table, spark):
    from llm.decontamination import contamination

    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    item = [r.choice(words) for _ in range(30)]
    changed = [w if k % 7 else "other" for k, w in enumerate(item)]
    clean = [r.choice(words) for _ in range(300)]
    docs = [(1, " ".join(clean + changed + clean)), (2, " ".join(clean)), (3, None), (4, ", ".join(item).upper()), (4, "x"), (None, " ".join(item))]
    bench = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, "a b")], "item_id long, text string")
    got = sorted((str(x.doc_id), x.contaminated, x.item_id or 0) for x in contamination(table(docs), bench).collect())
    assert got == sorted([("1", True, 9), ("2", False, 0), ("3", False, 0), ("4", True, 9), ("4", False, 0), ("None", True, 9)])


def test_masks_fit_between_all_accepted_replacements():
    from itertools import combinations

    from llm.decontamination import MASKS, SHARE, WINDOW

    for size in range(1, WINDOW + 1):
        ones = [{i + at for i, c in enumerate(m) if c == "1"} for m in MASKS[size] for at in range(size - len(m) + 1)]
        for k in range(size * (100 - SHARE) // 100 + 1):
            assert all(any(not looked & set(gone) for looked in ones) for gone in combinations(range(size), k))


def test_every_fifth_word_and_short_items(table, spark):
    from llm.decontamination import contamination

    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    items = {i: [r.choice(words) for _ in range(n)] for i, n in enumerate((1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 100), 1)}
    around = [f"z{k}" for k in range(100)]
    docs = [(i, " ".join(around + item + around)) for i, item in items.items()]
    docs += [(100 + i, " ".join(item)) for i, item in items.items()]
    docs += [(200 + i, " ".join(w if k % 5 != 2 else "other" for k, w in enumerate(item))) for i, item in items.items() if len(item) in (5, 6, 7, 10, 11, 12, 15, 100)]
    docs += [(300, " ".join(items[4][:2] + ["other"] + items[4][3:])), (301, " ".join(around))]
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in items.items()], "item_id long, text string")
    got = {x.doc_id: x.item_id for x in contamination(table(docs), bench).collect()}
    assert got == {d: None if d >= 300 else d % 100 for d, _ in docs}


def test_languages_held_out(spark, sf_dir):
    from llm.queries.op1 import language

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = language(spark, sf_dir).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_language_weight_is_of_the_cut_sample():
    from llm.language_id import SAMPLE_SYMBOLS, Model

    long, twice = "ab " * SAMPLE_SYMBOLS, "cd " * (2 * SAMPLE_SYMBOLS)
    weights = Model((("a", long), ("b", twice))).weights
    assert weights == [np.log2(SAMPLE_SYMBOLS + 1)] * 2


def test_language_of_odd_texts(table):
    from llm.language_id import predict_languages

    rows = {r.doc_id: r for r in predict_languages(table([(1, None), (2, ""), (3, "12 !!"), (4, "the cat")]), (("en", "the cat sat"), ("de", "der hund"))).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"]
    assert predict_languages(table([(1, "abc")]), ()).first().lang_pred == "und"


def test_toxicity_held_out(spark):
    from llm.queries.op5 import toxicity

    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)


def test_toxicity_without_labels(spark, table):
    from llm.toxicity import learn, score_texts

    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in score_texts(table(ODD), *learn(table(ODD), none)).collect()} == {0.5}


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    from llm.quality_rules import binomial_tail

    cases = [(0, 0), (50, 0), (900, 3), (2000, 12), (400, 3)]
    df = spark.createDataFrame(cases, "n long, x long").select("n", "x", binomial_tail(F.col("n"), F.col("x"), 0.01).alias("p"))
    for r in df.collect():
        want = sum(comb(r.n, k) * 0.01**k * 0.99 ** (r.n - k) for k in range(r.x + 1)) if r.x < r.n * 0.01 else 1.0
        assert abs(r.p - want) < 1e-9


def test_quality_base(spark, table):
    from llm.quality_rules import quality_rules

    docs = table([(1, "a b c d e f a b c d e g\nx\nx\n \n \n#%"), (2, None), (2, None)]).withColumnRenamed("rep", "lang")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].n_symbols, got[1].n_dup_lines, got[1].n_repeat_words) == (15, 16, 2, 1, 10)
    assert got[1].base_failed and got[2].base_failed and not got[2].kept


def test_pipeline_near_copies_on_five_words(spark, table):
    """One of 39 words replaced: 32 of 40 shingles of four words are shared, 30 of 40 of five."""
    import corpus_pipeline

    words = [f"w{k}" for k in range(39)]
    docs = table([(1, " ".join(words)), (2, " ".join([*words[:19], "other", *words[20:]])), (3, " ".join(words))])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 2]


def test_pipeline_keeps_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "encode":
            assert out.columns == docs.columns
            assert 0 < out.count() <= docs.count()
    assert corpus_pipeline.STAGES[0][1](spark, empty, sf_dir).count() == 0
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
