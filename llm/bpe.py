"""Byte-pair encoding by merge ranks, and decoding, as a tokenizer file of the tokenizers library tells.

A word's symbols form a doubly linked list; a heap holds the rank of each adjacent pair. The lowest rank
merges first; entries whose symbols have changed meanwhile are stale and skipped. Words repeat, so a
task keeps the ids of words it has seen, in two generations of bounded size.

Handled parts of a file: added special tokens, NFC, white space to one space, per-character lower case, a splitting
pattern whose matches are kept, byte-level symbols, an end-of-word suffix, and no decoder. NULL text is empty.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache
from struct import pack

import regex

GENERATION = 300_000
LONGEST = 48
#: White space as the tokenizer's patterns see it.
SPACE = "\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """Printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in (self.vocab | self.special).items()}
        self.strings = [names.get(i, "") for i in range(max(names) + 1)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ids = self.vocab
        self.sides = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.ranks = {a << 20 | b: rank for rank, (a, b, _) in enumerate(self.sides)}
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.final = [ids[s + self.suffix] for s in symbols]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", SPACE))
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.blank = regex.compile(r"[\x20\x09-\x0D]+")
        self.forget()

    def forget(self) -> None:
        """Drop what was remembered of earlier texts."""
        self.known: dict[str, list[int]] = {}
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece: its bytes as symbols, the last with the suffix, merged by rank."""
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, sides, push = self.ranks.get, self.sides, heapq.heappush
        found = [rank(a << 20 | b) for a, b in zip(symbols, symbols[1:])]
        heap = [r << 32 | i for i, r in enumerate(found) if r is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            a, b, new = sides[entry >> 32]
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                r = rank(new << 20 | symbols[k])
                if r is not None:
                    push(heap, r << 32 | i)
            k = before[i]
            if k >= 0:
                r = rank(symbols[k] << 20 | new)
                if r is not None:
                    push(heap, r << 32 | k)
        return [s for s in symbols if s >= 0]

    def word(self, text: str) -> list[int]:
        """Ids of a stretch without ASCII white space and special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        if text.isascii() and text.isalpha():
            return self.merge(text.encode())
        found: list[int] = []
        for piece in self.pieces.findall(text):
            ids = self.known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode())
                if len(piece) <= LONGEST:
                    if len(self.known) >= GENERATION:
                        self.known = {}
                    self.known[piece] = ids
            found += ids
        return found

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids; without a decoder in the file a space stands between them."""
        return " ".join(map(self.strings.__getitem__, ids))

    def _seen(self, text: str) -> tuple[bytes, str]:
        found = self.old.get(text)
        if found is None:
            ids = [self.special[text]] if text in self.special else self.word(text)
            found = (pack(f"<{len(ids)}I", *ids), self.decode(ids))
        if len(text) <= LONGEST:
            if len(self.young) >= GENERATION:
                self.old, self.young = self.young, {}
            self.young[text] = found
        return found

    def stretches(self, text: str) -> list[str]:
        """Words between white space, with special tokens cut out as words of their own.

        Python also splits at four control characters that are no white space for the tokenizer.
        """
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        if not odd and not any(s in text for s in self.special):
            return text.split()
        found, at = [], 0
        for mark in self.marks.finditer(text):
            found += [*self.blank.split(text[at : mark.start()]), mark[0]]
            at = mark.end()
        return [w for w in [*found, *self.blank.split(text[at:])] if w]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        words = self.stretches(text)
        found = list(map(self.young.get, words))
        if None in found:
            seen = self._seen
            found = [pair or seen(word) for pair, word in zip(found, words)]
        if not found:
            return b"", ""
        ids, texts = zip(*found)
        return b"".join(ids), " ".join(texts if "" not in texts else filter(None, texts))


@lru_cache(maxsize=2)
def encoder(text: str) -> Encoder:
    """One per worker process and tokenizer file."""
    return Encoder(text)
