"""Parses, n-grams and windows of whole texts against plain versions: block borders, large alphabets, frequent keys."""

import random

import pytest

from brute import kept_words


def plain_phrases(samples, codes):
    """Longest matches one after another, by searching the sample itself; a symbol in no sample goes with the phrase after it."""
    text, sample = "".join(map(chr, codes)), "".join(map(chr, samples))
    phrase, found = "", int(len(text) > 0)
    for symbol in text:
        if phrase + symbol in sample:
            phrase += symbol
        else:
            found += 1
            phrase = symbol if symbol in sample else ""
    return found


def words_of(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(n))


@pytest.mark.parametrize("alphabet", ["abcde", "".join(chr(0x4E00 + i) for i in range(900))])
def test_phrases_of_whole_texts(alphabet):
    from llm.language_id import BREAK, Model, letter_classes, symbols

    rng = random.Random(11)
    samples = {"x": words_of(rng, alphabet, 500), "y": words_of(rng, alphabet[: len(alphabet) // 2], 400), "z": "a" * 700 + " " + alphabet}
    table = letter_classes(samples)
    texts = ["", alphabet[0], "a" * 5000, "a" * 512, "a" * 513, words_of(rng, alphabet, 900), samples["x"][300:2500], "ab " * 600, "\u0416 q " * 400]
    coded = [symbols(t, table) for t in texts]
    model = Model(tuple(samples.items()))
    got = model.phrases(coded)
    for j, text in enumerate(samples.values()):
        learned = [*symbols(text, table).tolist(), BREAK]
        assert got[:, j].tolist() == [plain_phrases(learned, c) for c in coded]


def test_letters_of_large_alphabets_differ():
    from llm.language_id import FIRST, OTHER, letter_classes, symbols

    letters = "".join(chr(0x4E00 + i) for i in range(3000))
    table = letter_classes({"x": letters * 2 + letters[:50]})
    codes = {c: tuple(symbols(c, table)) for c in letters}
    assert len(set(codes.values())) == 3000 and all(len(codes[c]) == 1 for c in letters[:50])
    assert min(min(c) for c in codes.values()) >= FIRST and int(table.max()) < 300
    assert tuple(symbols("\u0416", table)) == (OTHER,) and not len(symbols("12 !", table).nonzero()[0])


def test_grams_are_of_characters():
    from llm.toxicity import MIX, SLICE, STEP, Grams

    def plain(text):
        text, found = text.lower(), set()
        for n in (3, 4, 5):
            for i in range(len(text) - n + 1):
                h = 0
                for c in text[i : i + n]:
                    h = (h * int(STEP) + ord(c)) % 2**64
                found.add((h + (n << 56)) * int(MIX) % 2**64 >> 46)
        return sorted(found)

    grams = Grams()
    for text in ("", "ab", "ABC", "\u0416\u0423\u041a \u0438", "\u65e5\u672c\u8a9e\U0001f600 x", "word " * 50):
        assert grams.of(text).tolist() == plain(text)
    assert grams.of("\u0416\u0423\u041a").tolist() == grams.of("\u0436\u0443\u043a").tolist()
    long = "".join(random.Random(3).choices("abcdefgh \u0436", k=SLICE + 3000))
    whole, tail = set(grams.of(long)), set(grams.of(long[SLICE - 10 :]))
    assert tail <= whole


def test_frequent_windows_are_dealt(spark, table):
    """One passage in most documents, with and without copies, NULLs and very long texts; frequent keys get salts."""
    from llm import substring_dedup

    rng = random.Random(5)
    fresh = lambda n: " ".join(rng.choices([f"w{i}" for i in range(5000)], k=n))
    passage, line = fresh(80), "same few words here again "
    rows = [(i, f"{fresh(rng.randint(0, 40))} {passage} {fresh(30)}") for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(10)] + [(200 + i, line * rng.randint(10, 40)) for i in range(10)]
    rows += [(300, None), (301, ""), (302, line * 3000), (303, fresh(400)), (303, fresh(400))]
    unique = [r for r in rows if r[0] != 303]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(table(unique)).collect()}
    assert got == {i: found for (i, _), found in kept_words(unique).items()}
    assert substring_dedup.remove_repeats(table(rows)).count() == len(rows)
    assert substring_dedup.remove_repeats(table([])).count() == 0


def test_spread_join_keeps_every_row(spark):
    from pyspark.sql import functions as F

    from llm.substring_dedup import spread_join

    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 0, id) as h", "id as t")
    repeats = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("h = 0 or h % 7 = 0")
    kept = spread_join(rows, repeats, ["h"], "left_semi")
    want = rows.where("h = 0 or h % 7 = 0")
    assert sorted(map(tuple, kept.select("h", "t").collect())) == sorted(map(tuple, want.collect()))
    assert spread_join(rows, repeats.where("h < 0"), ["h"], "left_semi").count() == 0
