"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives longest matches: parsing a text against it
takes the longest match from each place, then starts a new phrase. The language with the fewest
phrases, each weighed by the log of its sample's length, explains the text best. Automata are dense
tables, and a task parses all blocks of its texts in step, one table lookup per symbol and language.
Texts are cut into blocks of ``BLOCK`` symbols for that; phrases go on over the borders, as in a parse of the whole text.

Symbols are lower-case letters (rare ones of large alphabets are two symbols); anything between them is one space. A NULL text, or one without a letter,
is ``und`` with score 0; so is every text where no language can be learned. Ties go to the first language by name. Rows that repeat are each predicted.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.samples import labelled_sample
from llm.texts import SLAB, frugal, learns

#: Bounds of the labelled sample: texts a language, characters of a text, symbols of a language's automaton.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_SYMBOLS = 80, 800, 24_576
BLOCK = 512
#: Different letters up to which each has a symbol of its own, and how many have one beyond that.
SINGLES, COMMON = 252, 100
UNKNOWN = "und"
SPACE, BREAK, OTHER, FIRST = 0, 1, 2, 3


def letter_classes(samples: dict[str, str]) -> np.ndarray:
    """One or two symbols of each code point (the second 0 where there is one): 0 between words, one symbol for all letters in no sample.

    Up to ``SINGLES`` different letters in the samples have a symbol each. Of more, the ``COMMON`` most frequent have, and each other one
    has a pair of its own, so that scripts with thousands of letters are told apart with a few hundred symbols.
    """
    table = np.zeros((0x110000, 2), np.uint16)
    table[:, 0] = np.fromiter((OTHER * chr(i).isalpha() for i in range(0x110000)), np.uint16, 0x110000)
    counts = Counter(ord(c) for text in samples.values() for c in text.lower() if c.isalpha())
    letters = sorted(counts)
    if len(letters) > SINGLES:
        letters = sorted(letters, key=lambda c: (-counts[c], c))
        pairs = np.array(letters[COMMON:])
        side = math.isqrt(len(pairs) - 1) + 1
        place = np.arange(len(pairs))
        table[pairs, 0] = FIRST + COMMON + place // side
        table[pairs, 1] = FIRST + COMMON + side + place % side
        letters = letters[:COMMON]
    table[letters, 0] = np.arange(FIRST, FIRST + len(letters))
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    codes = table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    keep = codes[:, 0] != SPACE
    if len(keep):
        keep[1:] |= codes[:-1, 0] != SPACE
    codes = codes[keep]
    second = codes[:, 1] != 0
    if not second.any():
        return codes[:, 0]
    return codes.ravel()[np.column_stack((np.ones(len(codes), bool), second)).ravel()]


def automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in sequence:
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and symbol not in nexts[at]:
            nexts[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = nexts[at][symbol]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at >= 0 and nexts[at].get(symbol) == target:
                    nexts[at][symbol] = clone
                    at = link[at]
                link[target] = link[new] = clone
        last = new
    return nexts


class Model:
    """Tables of all languages, one below the other: entry = 2 * next state, + 1 where a new phrase begins."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.classes = letter_classes(dict(samples))
        width = int(self.classes.max()) + 1
        tables, roots, self.weights, self.names = [], [], [], [name for name, _ in samples]
        base = 0
        for _, text in samples:
            sequence = []
            for part in text.split("\0"):
                sequence += [*symbols(part, self.classes).tolist(), BREAK]
            sequence = sequence[:SAMPLE_SYMBOLS]
            nexts = automaton(sequence)
            start = np.zeros(width, np.int32)
            start[list(nexts[0])] = list(nexts[0].values())
            table = np.tile((start + base) * 2 + 1, (len(nexts), 1)).astype(np.int32)
            rows = np.repeat(np.arange(len(nexts)), [len(x) for x in nexts])
            table[rows, [c for x in nexts for c in x]] = [(t + base) * 2 for x in nexts for t in x.values()]
            tables.append(table)
            roots.append(base)
            self.weights.append(math.log2(len(sequence) + 1))
            base += len(nexts)
        self.table = np.concatenate(tables).ravel()
        self.width, self.roots = width, np.array(roots, np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each whole text in each language.

        Blocks of all texts are parsed side by side, each as if a phrase began with it. Then every block that goes on a text is parsed
        again from the state that the block before it ended in, until both parses are in one state, mostly after a phrase or two;
        if they never are, the next block is taken up in turn.
        """
        blocks = [t[i : i + BLOCK] for t in texts for i in range(0, max(1, len(t)), BLOCK)]
        goes_on = np.array([i > 0 for t in texts for i in range(0, max(1, len(t)), BLOCK)])
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((BLOCK, len(blocks)), np.int32)
        for column, i in enumerate(order):
            grid[: sizes[i], column] = blocks[i]
        alive = np.searchsorted(-sizes[order], -np.arange(BLOCK), side="left")
        n = len(self.roots)
        state = np.repeat(self.roots[:, None], len(blocks), axis=1)
        count = np.zeros((n, len(blocks)), np.int32)
        for step in range(BLOCK):
            live = alive[step]
            if not live:
                break
            entry = self.table[state[:, :live] * self.width + grid[step, :live]]
            count[:, :live] += entry & 1
            state[:, :live] = entry >> 1
        back, end = np.empty_like(count), np.empty_like(state)
        back[:, order], end[:, order] = count, state
        column = np.empty(len(blocks), np.int64)
        column[order] = np.arange(len(blocks))
        block = np.flatnonzero(goes_on)
        language = np.repeat(np.arange(n), len(block))
        block = np.tile(block, n)
        was, now = self.roots[language], end[language, block - 1]
        while len(block):
            ended = []
            for step in range(BLOCK + 1):
                apart, over = was != now, sizes[block] <= step
                ended.append([x[apart & over] for x in (language, block, was, now)])
                language, block, was, now = (x[apart & ~over] for x in (language, block, was, now))
                if not len(block):
                    break
                codes = grid[step, column[block]]
                old, new = self.table[was * self.width + codes], self.table[now * self.width + codes]
                back[language, block] += (new & 1) - (old & 1)  # a block is there once for each language
                was, now = old >> 1, new >> 1
            language, block, was, now = (np.concatenate(x) for x in zip(*ended))
            more = np.append(goes_on, False)[block + 1]
            language, block, was, now = language[more], block[more] + 1, was[more], now[more]
        firsts = np.flatnonzero(~goes_on)
        return np.add.reduceat(back, firsts, axis=1).T + (sizes[firsts] > 0)[:, None]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        coded = [symbols(t, self.classes) for t in texts]
        cost = self.phrases(coded) * np.array(self.weights)
        found = []
        for codes, row in zip(coded, cost):
            if not (codes >= OTHER).any():
                found.append((UNKNOWN, 0.0))
                continue
            best, *rest = np.argsort(row, kind="stable")
            score = 1.0 - row[best] / row[rest[0]] if rest else 1.0
            found.append((self.names[best], float(min(1.0, max(0.0, score)))))
        return found


@lru_cache(maxsize=1)
def model(samples: tuple[tuple[str, str], ...]) -> Model:
    """One per worker process; the samples are bounded, so it takes a bounded time to build."""
    return Model(samples)


def learn(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """Per language the sampled texts, joined, from rows with a language that are not held out."""
    labels = docs.where(learns(F.col("doc_id"), 5, 0)).select("doc_id", F.col("lang").alias("label"))
    texts: dict[str, list[str]] = {}
    for name, _, text in labelled_sample(docs, labels, SAMPLE_TEXTS, SAMPLE_CHARS, cut=True):
        texts.setdefault(name, []).append(text.replace("\0", " "))
    return tuple((name, "\0".join(parts)) for name, parts in sorted(texts.items()) if any(c.isalpha() for p in parts for c in p))


def predict_languages(docs: DataFrame, samples: tuple[tuple[str, str], ...], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with lang_pred and score; the text alone decides."""
    source = docs.select(*(c for c in keep if c != "text"), "text")  # the text once, also where it is kept
    n = len(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n])
    names = [*source.columns[:n], "lang_pred", "score"]

    @frugal
    def work(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found, held, size = [], [], 0
            for text in [*texts, None]:
                if text is not None:
                    held.append(text)
                    size += len(text)
                if held and (text is None or size >= SLAB):
                    found += model(samples).predict(held) if samples else [(UNKNOWN, 0.0)] * len(held)
                    held, size = [], 0
            languages, scores = zip(*found) if found else ((), ())
            arrays = [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], names=names)

    return source.mapInArrow(work, f"{fields}, lang_pred string, score double")
