"""Character language models with interpolated Kneser-Ney smoothing, one per language, over shared sorted hash arrays.

A character is one of CLASSES byte classes: ASCII in lower case, digits alike, other UTF-8 bytes folded. For each order the
n-grams that any language has seen are kept as sorted hashes with one row of log-probabilities, a column per language;
the rows already hold the interpolation with the lower orders, the lowest of which, single classes, is the same for all
languages. An n-gram that no language has seen falls back to the
next order plus its context's weight, as interpolation prescribes. A table of the hashes' leading bits narrows the
binary search to a few places.
"""

from __future__ import annotations

import re

import numpy as np

CLASSES, BITS, ORDER = 128, 7, 5
#: An odd number, so that multiplying by it gives each code another hash.
MIX = np.uint64(0x9E3779B97F4A7C15)
PIECE = 400_000
START = b"\n" * (ORDER - 1)


def _classes() -> bytes:
    out = bytearray(256)
    for b in range(256):
        if b < 128:
            out[b] = ord("0") if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b if b >= 32 or b in (9, 10) else 32
        else:
            out[b] = 1 + b % 8 if b < 0xC0 else 11 + b % 16
    return bytes(out)


TO_CLASS = _classes()


HEX = re.compile(rb"0x[0-9a-f]+")
#: Comments belong to the language around them whatever they say: whole-line ones, block comments and those of markup.
WHOLE_LINE = re.compile(rb"\n ?(?:# |#!|//|-- )[^\n]*")
BLOCK_COMMENTS = ((b"/*", re.compile(rb"(?<=[ ;{}\n])/\*.*?\*/", re.S)), (b"<!--", re.compile(rb"<!--.*?-->", re.S)))
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 11, 12) else b for b in range(256))
#: A line of fewer letters says nothing about its language.
TELLING = 3


def lines_of(text: str) -> str:
    """One line feed for each line break, and no byte order marks."""
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\ufeff", "")


def encode(text: str) -> bytes:
    """Byte classes of such a text: blanks run together, none before a line feed, hexadecimal numbers as digits, no
    comments. Line feeds stay."""
    raw = b"\n" + text.encode("utf-8", "replace").translate(LOWER)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    raw = WHOLE_LINE.sub(b"\n", raw.replace(b" \n", b"\n"))
    for mark, comment in BLOCK_COMMENTS:
        if mark in raw:
            raw = comment.sub(lambda m: b"\n" * m[0].count(b"\n"), raw)
    if b"0x" in raw:
        raw = HEX.sub(b"0", raw)
    return raw[1:].translate(TO_CLASS)


def codes(buf: np.ndarray, order: int) -> np.ndarray:
    """For each place from order - 1 on, the code of the `order` classes that end there."""
    n = len(buf) - order + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(order):
        out = (out << np.uint64(BITS)) | buf[k : k + len(out)].astype(np.uint64)
    return out


class Hashes:
    """Sorted hashes of codes, with a table of where each run of equal leading bits starts."""

    def __init__(self, sorted_codes: np.ndarray):
        h = sorted_codes * MIX
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.bits = max(1, min(22, int(np.ceil(np.log2(max(2, 2 * len(h)))))))
        self.starts = np.searchsorted(self.hashes >> np.uint64(64 - self.bits), np.arange(2**self.bits + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.starts).max(initial=0))

    def find(self, some: np.ndarray) -> np.ndarray:
        """Row of each code, -1 for codes that aren't there."""
        if not len(self.hashes):
            return np.full(len(some), -1, np.int64)
        h = some * MIX
        lead = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        out = np.full(len(some), -1, np.int64)
        top = len(self.hashes) - 1
        hit = (at < end) & (self.hashes[np.minimum(at, top)] == h)
        out[hit] = at[hit]
        rest = np.flatnonzero(~hit & (at + 1 < end))
        at = at + 1
        while len(rest):
            same = self.hashes[at[rest]] == h[rest]
            out[rest[same]] = at[rest[same]]
            at[rest] += 1
            rest = rest[~same & (at[rest] < end[rest])]
        return out


class Model:
    """languages: names; texts: per language, encoded texts to learn from."""

    def __init__(self, languages: list[str], texts: list[list[bytes]]):
        self.languages = languages
        k = len(languages)
        grams = [np.unique(np.concatenate([codes(np.frombuffer(START + t, np.uint8), ORDER) for t in ts]) if ts else np.zeros(0, np.uint64), return_counts=True) for ts in texts]
        counts = {ORDER: grams}
        for n in range(ORDER - 1, 0, -1):  # how many different classes stand before an n-gram
            mask = np.uint64(2 ** (BITS * n) - 1)
            counts[n] = [np.unique(g & mask, return_counts=True) for g, _ in counts[n + 1]]
        self.tables: dict[int, tuple[Hashes, np.ndarray]] = {}
        self.weights: dict[int, tuple[Hashes, np.ndarray]] = {}
        seen = np.arange(CLASSES, dtype=np.uint64)
        c = np.zeros((CLASSES, k))
        for i, (g, m) in enumerate(counts[1]):
            c[g.astype(int), i] = m
        c[:] = c.sum(1, keepdims=True)
        p = (c + 0.5) / (c + 0.5).sum(0)
        self.unigram = np.log(p).astype(np.float32)
        for n in range(2, ORDER + 1):
            lower, below = seen, p
            seen = np.unique(np.concatenate([g for g, _ in counts[n]]))
            c = np.zeros((len(seen), k))
            for i, (g, m) in enumerate(counts[n]):
                c[np.searchsorted(seen, g), i] = m
            contexts, of = np.unique(seen >> np.uint64(BITS), return_inverse=True)
            first = np.searchsorted(of, np.arange(len(contexts)))
            total, kinds = np.add.reduceat(c, first, 0), np.add.reduceat((c > 0).astype(float), first, 0)
            ones, twos = (c == 1).sum(0), (c == 2).sum(0)
            off = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
            weight = np.where(total > 0, off * kinds / np.maximum(total, 1), 1.0)
            suffix = np.searchsorted(lower, seen & np.uint64(2 ** (BITS * (n - 1)) - 1))
            p = np.where(total[of] > 0, np.maximum(c - off, 0) / np.maximum(total[of], 1), 0) + weight[of] * below[suffix]
            h, w = Hashes(seen), Hashes(contexts)
            self.tables[n] = (h, np.log(p)[h.order].astype(np.float32))
            self.weights[n] = (w, np.log(weight)[w.order].astype(np.float32))

    def _rows(self, code: np.ndarray, n: int) -> np.ndarray:
        if n == 1:
            return self.unigram[code.astype(np.int64)]
        h, rows = self.tables[n]
        at = h.find(code)
        out = rows[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            w, weights = self.weights[n]
            ctx = w.find(code[miss] >> np.uint64(BITS))
            low = self._rows(code[miss] & np.uint64(2 ** (BITS * (n - 1)) - 1), n - 1)
            out[miss] = low + np.where(ctx[:, None] >= 0, weights[ctx], 0)
        return out

    def line_scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores [line, language] in nats, bytes of each line, lines of each text). A line takes its line feed; an
        empty text is one line of no bytes. Lines of fewer than TELLING letters score 0 for all languages and count
        as no bytes."""
        buf = np.frombuffer(b"".join(START + t for t in texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        base = np.r_[0, np.cumsum(size + len(START))[:-1]]
        real = np.ones(len(buf), bool)
        for k in range(len(START)):
            real[base + k] = False
        place = np.flatnonzero(real)
        feed = buf[place] == 10
        last = np.cumsum(size) - 1
        ends = feed.copy()
        ends[last[size > 0]] = True
        line = np.cumsum(ends) - ends
        # Lines so far number only texts with bytes; empty texts get their one line of no bytes afterwards.
        n = int(line[-1]) + 1 if len(line) else 0
        scores = np.zeros((n, len(self.languages)), np.float64)
        for a in range(0, len(place), PIECE):
            at = place[a : a + PIECE]
            code = codes(buf[at[0] - ORDER + 1 : at[-1] + 1], ORDER)[at - at[0]]
            own = line[a : a + PIECE]
            first = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1]
            scores[own[first]] += np.add.reduceat(self._rows(code, ORDER), first, 0)
        lengths = np.bincount(line, minlength=n)
        low = buf[place] | 32
        mute = np.bincount(line, ((low >= 97) & (low <= 122)) | (buf[place] < 9) | ((buf[place] > 10) & (buf[place] < 32)), n) < TELLING
        scores[mute], lengths[mute] = 0, 0
        lines = np.zeros(len(texts), np.int64)
        text = np.repeat(np.arange(len(texts)), size)
        if n:
            lines = np.bincount(text[np.flatnonzero(ends)], minlength=len(texts))
        if (lines == 0).any():
            spot = np.repeat(np.r_[0, np.cumsum(lines)[:-1]], lines == 0)
            scores, lengths = np.insert(scores, spot, 0, 0), np.insert(lengths, spot, 0)
            lines = np.maximum(lines, 1)
        return scores, lengths, lines
