"""Secrets in texts and in what the texts encode, by a worklist of decoded layers.

The text is the first layer. Every layer is scanned, and each encoding found in it gives a further layer: URL escapes and
Unicode escapes are undone in the whole layer, so that what was split by them is joined again; runs of base64 and
compressed bytes become layers of their own. The worklist ends at the fixpoint, when no layer gives a new one. A layer
whose text is that of a layer it comes from is a cycle and goes no further; one that another way has already
given for the same place is not scanned twice. Spans are mapped back layer by layer: a character stands for
the source characters it was made of, one of a compressed layer for the whole run.

Kinds and limits are fixed values. Spans are code points of the document, end exclusive. What decompression gives may hold ``most`` bytes a
document together (a guard against bombs); a run beyond it stays closed and is counted in n_unopened.

Documents are independent and nothing is shuffled. A look over the bytes of a slab tells which texts hold anything that
could be a secret or an encoding; only those are read by patterns. NULL text is empty, with no spans; repeated rows are
scanned each; a NULL id stays NULL; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.texts import slabs

#: The kinds, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Parts of which every match has one, for the look over the bytes.
WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")

#: Encodings.
#: An escaped percent sign before further digits is undone with them, so that depth costs no rounds.
ESCAPE = re.compile("%(?:25)*([0-9A-Fa-f]{2})")
URL = re.compile("(?:%(?:25)*[0-9A-Fa-f]{2})+")
UNICODE = re.compile(
    r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}"
    r"|%u[0-9A-Fa-f]{4}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
PART = re.compile("[A-Za-z0-9]{16,}={0,2}")
SQUEEZED = re.compile(r"(?:%1[fF]%8[bB]|(?:x|%78)%(?:01|5[eE]|9[cC]|[dD][aA]))(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9._~+*'()!/:@$,;=&?-])*")
RUN = 16
MOST = 1 << 24
FIELDS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, n_layers long, n_unopened long"

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_BASE64 = np.zeros(256, bool)
_BASE64[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")] = True


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of each match, per kind leftmost and without overlaps."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]


@dataclass
class Layer:
    """A text and where it comes from: piece k of the text starts at ``at[k]`` and stands for ``starts[k]:ends[k]`` of the
    source, character by character where ``plain[k]``, else as a whole."""

    text: str
    source: Layer | None
    at: list[int]
    starts: list[int]
    ends: list[int]
    plain: list[bool]

    def place(self, start: int, end: int) -> tuple[int, int]:
        """A stretch of this layer as code points of the document."""
        layer = self
        while layer.source is not None:
            first, last = bisect_right(layer.at, start) - 1, bisect_right(layer.at, end - 1) - 1
            new = layer.starts[first] + (start - layer.at[first] if layer.plain[first] else 0)
            end = layer.starts[last] + end - layer.at[last] if layer.plain[last] else layer.ends[last]
            start, layer = new, layer.source
        return start, end

    def cycle(self) -> bool:
        layer = self.source
        while layer is not None and layer.text != self.text:
            layer = layer.source
        return layer is not None


class Pieces:
    """Builds a layer from stretches of its source."""

    def __init__(self, source: Layer):
        self.source, self.texts, self.size = source, [], 0
        self.at, self.starts, self.ends, self.plain = [], [], [], []

    def add(self, text: str, start: int, end: int, plain: bool) -> None:
        if text:
            self.texts.append(text)
            for values, value in zip((self.at, self.starts, self.ends, self.plain), (self.size, start, end, plain)):
                values.append(value)
            self.size += len(text)

    def layer(self) -> Layer:
        return Layer("".join(self.texts), self.source, self.at, self.starts, self.ends, self.plain)


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text and text.translate({9: 32, 10: 32, 13: 32}).isprintable() else None


def _escaped(match: str) -> str | None:
    """The character of a Unicode escape."""
    if len(match) == 12:
        high, low = int(match[2:6], 16), int(match[8:], 16)
        code = 0x10000 + ((high & 0x3FF) << 10) + (low & 0x3FF)
    elif match[0] == "&":
        code = int(match[3:-1], 16) if match[2] in "xX" else int(match[2:-1])
    else:
        code = int(match[2:].strip("{}"), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


class Worklist:
    def __init__(self, text: str, most: int = MOST):
        self.left, self.unopened, self.layers = most, 0, 0
        self.base = sorted(scan(text))
        self.spans = set(self.base)
        self.seen: set[tuple] = set()
        self.todo = deque([Layer(text, None, [], [], [], [])])
        while self.todo:
            layer = self.todo.popleft()
            if layer.source is not None:
                self.layers += 1
                for start, kind, end in scan(layer.text):
                    start, end = layer.place(start, end)
                    self.spans.add((start, kind, end))
            for unwrap in (self.url, self.unicode, self.squeezed, self.base64):
                unwrap(layer)

    def offer(self, layer: Layer) -> None:
        mark = (hashlib.sha256(layer.text.encode(errors="surrogatepass")).digest(), layer.place(0, len(layer.text)))
        if mark not in self.seen and not layer.cycle():
            self.seen.add(mark)
            self.todo.append(layer)

    def undone(self, layer: Layer, pattern: re.Pattern, pieces_of) -> None:
        """The layer with each match of ``pattern`` replaced by ``pieces_of(match)``: (text, start, end) in its source."""
        new, at = Pieces(layer), 0
        for match in pattern.finditer(layer.text):
            got = pieces_of(match)
            if got:
                new.add(layer.text[at : match.start()], at, match.start(), True)
                for piece in got:
                    new.add(*piece, False)
                at = match.end()
        if at:
            new.add(layer.text[at:], at, len(layer.text), True)
            self.offer(new.layer())

    def url(self, layer: Layer) -> None:
        def pieces_of(match):
            escapes = list(ESCAPE.finditer(match[0]))
            try:
                text = bytes(int(e[1], 16) for e in escapes).decode()
            except UnicodeDecodeError:
                return None
            out, at = [], 0
            for c in text:
                n = len(c.encode())
                out.append((c, match.start() + escapes[at].start(), match.start() + escapes[at + n - 1].end()))
                at += n
            return out

        if "%" in layer.text:
            self.undone(layer, URL, pieces_of)

    def unicode(self, layer: Layer) -> None:
        def pieces_of(match):
            c = _escaped(match[0])
            return [(c, match.start(), match.end())] if c else None

        if "\\" in layer.text or "&#" in layer.text or "%u" in layer.text:
            self.undone(layer, UNICODE, pieces_of)

    def opened(self, raw: bytes) -> bytes | None:
        """What compressed bytes hold, through all layers of compression; None if they hold nothing or too much."""
        passed = set()
        while raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and len(raw) > 2 and int.from_bytes(raw[:2], "big") % 31 == 0:
            digest = hashlib.sha256(raw).digest()
            if digest in passed:
                return None
            passed.add(digest)
            opener = zlib.decompressobj(47)
            try:
                out = opener.decompress(raw, self.left + 1)
            except zlib.error:
                return None if not passed - {digest} else raw
            if len(out) > self.left:
                self.unopened += 1
                return None
            if not opener.eof:
                return None
            self.left -= len(out)
            raw = out
        return raw if passed else None

    def squeezed(self, layer: Layer) -> None:
        """Compressed bytes behind URL escapes."""
        for match in SQUEEZED.finditer(layer.text) if "%" in layer.text else ():
            raw = re.sub(b"%(..)", lambda m: bytes.fromhex(m[1].decode()), match[0].encode())
            text = _readable(self.opened(raw) or b"")
            if text:
                self.offer(Layer(text, layer, [0], [match.start()], [match.end()], [False]))

    def base64(self, layer: Layer) -> None:
        for match in BASE64.finditer(layer.text):
            if not self.decoded(layer, match.start(), match[0]):
                for part in PART.finditer(match[0]):
                    if part[0] != match[0]:
                        self.decoded(layer, match.start() + part.start(), part[0])

    def decoded(self, layer: Layer, start: int, run: str) -> bool:
        where = [start + k for k, c in enumerate(run) if c not in "=\r\n"]
        code = "".join(c for c in run if c not in "=\r\n").translate({45: 43, 95: 47})
        if len(code) % 4 == 1:
            return False
        raw = base64.b64decode(code + "=" * (-len(code) % 4))
        inner = self.opened(raw)
        if inner is not None:
            text = _readable(inner)
            if text:
                self.offer(Layer(text, layer, [0], [start], [start + len(run)], [False]))
            return text is not None
        text = _readable(raw)
        if text is None:
            return False
        new, at = Pieces(layer), 0
        for c in text:
            n = len(c.encode())
            new.add(c, where[8 * at // 6], where[min(-(-8 * (at + n) // 6), len(where)) - 1] + 1, False)
            at += n
        self.offer(new.layer())
        return True


def _suspects(texts: list[bytes]) -> np.ndarray:
    """Which texts hold a part of a secret, an escape, or a run that could be hex or base64."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    found = np.zeros(len(texts), bool)
    for table, least in ((_HEX, LEAST["hex"]), (_BASE64, RUN)):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], table[data])).astype(np.int8)))
        long = edges[0::2][edges[1::2] - edges[0::2] >= least]
        found[np.searchsorted(starts, long, "right") - 1] = True
    for k, text in enumerate(texts):
        if not found[k]:
            low = text.lower()
            found[k] = b"%" in text or b"\\" in text or b"&#" in text or b"AKIA" in text or any(w in low for w in WORDS)
    return found


def _row(text: str | None, most: int) -> tuple:
    done = Worklist(text, most) if text else None
    base, spans = (done.base, sorted(done.spans)) if done else ([], [])
    named = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in some) for some in (base, spans)]
    counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
    digest = hashlib.sha256(named[0].encode()).hexdigest()
    return (*counts, digest, named[1], len(spans) - len(base), done.layers if done else 0, done.unopened if done else 0)


def find_secrets(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``FIELDS`` of each row of ``docs`` (doc_id, text)."""

    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in FIELDS.split(", ")[1:]]

    def work(batches):
        for batch in batches:
            for first, texts in slabs(batch.column("text")):
                rows = [_row(t.decode() if s else None, most) for t, s in zip(texts, _suspects(texts))]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *columns], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, FIELDS)
