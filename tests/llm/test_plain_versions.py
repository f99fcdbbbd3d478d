"""Cutoffs, overlaps and long texts against plain versions; empty tables and thin strata."""

import hashlib
import math
import random
from collections import defaultdict

import public_tokenizers
import pytest

from brute import kept_bytes, kept_words, shingles


def plain_cutoffs(rows, rules, risk, error, grid, most):
    """{(stratum, rule): (cutoff, n, rejected, bound)} with exact binomial sums."""
    groups = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    for stratum, good, proposes, *values in rows:
        for rule, v in zip(rules, values):
            cell = groups[stratum, rule][min(v, most)]
            cell[0] += good and proposes
            cell[1] += good and not proposes
            cell[2] += proposes and not good
    p, out = risk / len(rules), {}
    for key, cells in groups.items():
        proposing, n, tried = sum(c[0] for c in cells.values()), sum(c[1] for c in cells.values()), {}
        for value in sorted(cells):
            above = [c for v, c in cells.items() if v > value]
            share = sum(c[0] for c in above) / proposing if proposing else 0
            step = min(math.floor(-2 * (math.log(share) / math.log(2))), grid - 1) if share > 0 else grid - 1
            tried.setdefault(step, (value, sum(c[1] for c in above), sum(c[2] - c[0] for c in above)))
        best = None
        for value, rejected, net in tried.values():
            bound = 1.0 if rejected >= n * p else sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(rejected + 1))
            if n and bound <= error / (grid * len(groups)) and (best is None or (net, value) > best[0]):
                best = (net, value), (value, n, rejected, bound)
        if best:
            out[key] = best[1]
    return out


def test_cutoffs(spark):
    """Ties, a NULL stratum, values beyond the last step, a stratum without good labels and one with a single label."""
    from llm.quality_rules import ERROR, GRID, MOST, RISK, RULES, certified_cutoffs

    r = random.Random(5)
    rows = []
    for stratum, n in (("aa", 6000), (None, 4000), ("few", 30)):
        for _ in range(n):
            good = r.random() < 0.7
            values = [min(int(r.expovariate(1 / (20 if good else 60 * k))), 200) for k in range(1, 5)]
            rows.append((stratum, good, r.random() < 1 / 3, *values, 2 * MOST if not good and r.random() < 0.5 else 7))
    rows += [("bad", False, k % 2 == 0, k, k, k, k, k) for k in range(40)] + [("one", True, False, 1, 1, 1, 1, 1)]
    schema = "stratum string, good boolean, proposes boolean, " + ", ".join(f"{x} long" for x in RULES)
    got = {(x.stratum, x.rule): x for x in certified_cutoffs(spark.createDataFrame(rows, schema)).collect()}
    want = plain_cutoffs(rows, RULES, RISK, ERROR, GRID, MOST)
    assert len(want) >= 8 and {s for s, _ in want} == {"aa", None}
    assert {k: (x.cutoff, x.n, x.rejected) for k, x in got.items()} == {k: w[:3] for k, w in want.items()}
    assert all(abs(got[k].bound - w[3]) < 1e-9 for k, w in want.items())


def test_verdict_comes_from_the_cutoffs(spark):
    """Certified: what lies above the cutoff goes. Too few labels: nothing beyond the base rule goes."""
    from llm.quality_rules import quality_rules

    clean = " ".join(f"word{k}" for k in range(12))
    docs = [(i, clean + (" " + "#$ " * 20 if i % 4 == 0 else ""), "aa") for i in range(9000)]
    docs += [(10_000 + i, clean + (" " + "#$ " * 20 if i % 4 == 0 else ""), None) for i in range(40)]
    labels = [(i, 0 if i % 4 == 0 else 1) for i, *_ in docs] + [(1, 0), (1, None), (None, 1), (99_999, 1)]
    found = quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {x.doc_id: (x.base_failed, x.kept) for x in found.collect()}
    base = {i: got[i][0] for i, *_ in docs}
    assert not any(base[i] for i, *_ in docs if i % 4)
    assert {i for i in got if got[i][1]} == {i for i, *_ in docs if (i % 4 or i >= 10_000) and not base[i]}


def plain_overlaps(docs, items, window=12, share=80):
    """{row: (n_items, item_id, equal)} from every item at every shift of every text."""
    out = []
    for i, text in docs:
        x, found = (text or "").split(), []
        for item, words in items:
            y = words.split()
            w = min(window, len(y))
            best = 0
            for shift in range(w - len(y), len(x) - w + 1):
                same = [x[shift + k] == y[k] for k in range(len(y)) if 0 <= shift + k < len(x)]
                best = max([best, *(sum(same[a : a + w]) for a in range(len(same) - w + 1))])
            if 100 * best >= share * w:
                found.append((best, -item))
        out.append((i, len(found), -max(found)[1] if found else None, max(found)[0] if found else None))
    return out


def test_overlaps_against_all_shifts(spark, table):
    from llm.decontamination import contamination

    r = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([2, 4, 5, 7, 9, 12, 20, 40])))) for i in range(30)]
    items += [(50, items[3][1]), (51, items[20][1])]
    docs = [(None, items[0][1]), (1, None), (2, ""), (3, " ".join(i[1] for i in items[:20]))]
    for i in range(10, 130):
        parts = [r.choice(words) for _ in range(r.randint(0, 60))]
        item = r.choice(items)[1].split()
        gone = set(r.sample(range(len(item)), r.randint(0, len(item) * 3 // 10)))
        part = ["x" if k in gone else w for k, w in enumerate(item)][r.choice([0, 0, 0, 1, 3]) :]
        docs.append((i, " ".join(parts + part + [r.choice(words) for _ in range(r.randint(0, 20))])))
    docs += docs[-3:]
    got = [(x.doc_id, x.n_items, x.item_id, x.equal_words) for x in contamination(table(docs), spark.createDataFrame(items, "item_id long, text string")).collect()]
    want = plain_overlaps(docs, items)
    assert 20 < sum(w[1] > 0 for w in want) < 120
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.fixture(scope="module")
def long_rows():
    """Texts beyond a slab of 1 MB: one with repeats inside, one that shares passages with it, one without a blank."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    first = [r.choice(words) for _ in range(210_000)]
    first[200_000:200_100] = first[5000:5100]
    second = first[1000:1200] + [r.choice(words) for _ in range(200)]
    return [(1, " ".join(first)), (2, " ".join(second)), (3, "y" * 1_200_000), (4, None)]


def test_long_texts(table, long_rows):
    from llm.bpe_frame import encode_digests, tokenizer_text
    from llm.near_dedup import near_duplicates
    from llm.substring_dedup import remove_repeats
    from llm.suffix_dedup import remove_repeated_bytes
    from tokenizers import Tokenizer

    docs = table(long_rows)
    assert len(long_rows[0][1]) > 1 << 20
    bytes_ = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(docs).collect()}
    small = [row for row in long_rows if row[0] != 3]
    want = kept_bytes(small)
    assert bytes_ == {i: want[i, t] for i, t in small} | {3: (1_200_000, 1_200_000, 1, hashlib.sha256(b"").hexdigest())}
    words = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs).collect()}
    want = kept_words(long_rows)
    assert words == {i: want[i, t] for i, t in long_rows} and words[2][1] > 0
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert near == {i: (len(shingles(t)), i) for i, t in long_rows}
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    for x in encode_digests(table(small), tokenizer_text(path)).collect():
        ids = library.encode(dict(small)[x.doc_id] or "", add_special_tokens=False).ids
        assert (x.n_tokens, x.decoded_sha256) == (len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert x.ids_sha256 == hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest()


def test_empty_tables(spark, table):
    from llm.bpe_frame import encode_digests, tokenizer_text
    from llm.decontamination import contamination
    from llm.language_id import learn, predict_languages
    from llm.near_dedup import near_duplicates
    from llm.quality_rules import quality_rules
    from llm.suffix_dedup import remove_repeated_bytes
    from llm.warc import mark_revisits

    none, some = table([]), table([(1, "a b c d"), (None, None)])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    named = none.withColumnRenamed("rep", "lang")
    assert remove_repeated_bytes(none).count() == near_duplicates(none).count() == 0
    assert encode_digests(none, tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))).count() == 0
    assert contamination(none, bench).count() == 0
    assert [r.contaminated for r in contamination(some, bench).collect()] == [False, False]
    assert quality_rules(named, labels).count() == 0
    assert predict_languages(named, learn(named)).count() == 0
    assert mark_revisits(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
