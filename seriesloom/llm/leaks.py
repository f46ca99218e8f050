"""Passages of evaluation items inside documents, by Wu-Manber multi-pattern search.

A passage is WORDS successive words of an item. Texts are brought to lower-case words with one blank on either side of
each, so that a passage is a plain string and whatever stands between words doesn't matter. Every passage of every
item is a pattern; the first `least` bytes of the patterns (the length of the shortest) go into the tables:

- SHIFT: for each block of BLOCK bytes, by a hash, how far the window may move on: to the block's last place in any
  pattern, or past it altogether if no pattern holds the block.
- HASH: patterns in the order of the hash of the block at their window's end, where the shift is 0; those of the same
  hash are compared directly.

Patterns are places in the items' text, so a lot of items takes about nine times its text, whatever its overlaps.

Documents advance side by side: a step looks at one block of each segment of SEGMENT bytes and moves its window on.
Segments only divide the places where a window may end; comparisons read across them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut, spread

WORDS = 15
BLOCK = 8
#: Odd numbers, by whose powers the words of a passage are summed up, to tell an item's repeated passages.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: Bits of the shift table: a table of four times as many entries as blocks, within these.
LEAST_BITS, MOST_BITS = 12, 24
SEGMENT = 4096
#: Bytes of item text in one lot of patterns, and lots that go over the documents together: together they are what is
#: broadcast at once. More items take more passes.
LOT_BYTES, LOTS = 4_000_000, 4
#: Bytes of normalised document text that are searched at a time.
BATCH_BYTES = 16_000_000

LOWER = bytes(b if chr(b).isascii() and chr(b).isalnum() else 32 for b in range(256)).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def normal(text: str) -> bytes:
    """Words of ASCII letters and digits in lower case, a blank before and after each; empty if there are none."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    return b" " + b" ".join(words) + b" " if words else b""


class Patterns:
    """The tables over all passages of the items. items: (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS):
        self.ids = [i for i, _ in items]
        texts = [normal(t or "") for _, t in items]
        self.text = b"".join(texts)
        buf, base = np.frombuffer(self.text, np.uint8), 0
        number: dict[bytes, int] = {}
        parts = []
        for k, t in enumerate(texts):
            if t.count(b" ") > words:  # a blank more than words
                blank = np.flatnonzero(buf[base : base + len(t)] == 32)
                codes = np.array([number.setdefault(w, len(number) + 1) for w in t.split()], np.uint64)
                n = len(codes) - words + 1
                both = np.zeros((2, n), np.uint64)
                for i in range(words):
                    both = both * FACTORS[:, None] + codes[i : i + n]
                keep = np.unique(both, axis=1, return_index=True)[1]  # a passage that an item repeats is one pattern
                parts.append((base + blank[keep], blank[keep + words] + 1 - blank[keep], np.full(len(keep), k)))
            base += len(t)
        self.start, self.size, self.item = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        self.least = int(self.size.min(initial=2**31 - 1)) if len(self.start) else 0
        self.block = min(BLOCK, self.least)
        if not len(self.start):
            return
        m, b = self.least, self.block
        every = np.zeros(len(buf) + 1, np.uint64)  # of the block before each place in the items' text
        every[b:] = self.hashes(buf, np.arange(b, len(buf) + 1))
        self.bits = int(np.clip(np.ceil(np.log2(4 * len(np.unique(every)))), LEAST_BITS, MOST_BITS))
        slot = (every >> np.uint64(64 - self.bits)).astype(np.int32)
        self.shift = np.full(2**self.bits, m - b + 1, np.uint8 if m - b < 255 else np.int32)
        for end in range(b, m + 1):  # later places give smaller shifts and replace those before
            self.shift[slot[self.start + end]] = m - end
        last = every[self.start + m]
        order = np.argsort(last, kind="stable")
        self.last = last[order]
        self.start, self.size, self.item = self.start[order].astype(np.int32), self.size[order].astype(np.int32), self.item[order].astype(np.int32)

    def hashes(self, buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the block before each of the places."""
        h = np.zeros(len(ends), np.uint64)
        for k in range(self.block, 0, -1):
            h = h * np.uint64(0x100000001B3) + buf[ends - k]
        return h * np.uint64(0x9E3779B97F4A7C15)

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the text, item) of every item with a passage in it; texts are normal."""
        hits: set[tuple[int, int]] = set()
        m = self.least
        if not m or not texts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        base = np.r_[0, np.cumsum(size)[:-1]]
        whole = b"".join(texts)
        buf = np.frombuffer(whole, np.uint8)
        # Windows end at m - 1 to size - 1 of a text; each segment has its share of these places.
        share = np.maximum(0, -(-(size - m + 1) // SEGMENT))
        text = np.repeat(np.arange(len(texts)), share)
        k = np.arange(len(text)) - np.repeat(np.r_[0, np.cumsum(share)[:-1]], share)
        at = base[text] + m + k * SEGMENT
        stop = np.minimum(at + SEGMENT, (base + size)[text] + 1)
        top = np.uint64(64 - self.bits)
        while len(at):
            h = self.hashes(buf, at)
            step = self.shift[(h >> top).astype(np.int64)]
            zero = np.flatnonzero(step == 0)
            first, end = np.searchsorted(self.last, h[zero], "left"), np.searchsorted(self.last, h[zero], "right")
            for j in np.flatnonzero(first < end):
                i = zero[j]
                start, limit = int(at[i]) - m, int(base[text[i]] + size[text[i]])
                for p in range(first[j], end[j]):
                    n, s = int(self.size[p]), int(self.start[p])
                    if start + n <= limit and whole[start : start + n] == self.text[s : s + n]:
                        hits.add((int(text[i]), int(self.item[p])))
            at = at + np.maximum(step, 1).astype(np.int64)
            live = at < stop
            if not live.all():
                at, stop, text = at[live], stop[live], text[live]
        out = sorted(hits)
        return np.array([x for x, _ in out], np.int64), np.array([self.ids[y] for _, y in out])


def _lots(rows: Iterator, lot_bytes: int) -> Iterator[list[tuple]]:
    """Items in lots of about lot_bytes of text."""
    lot, size = [], 0
    for r in rows:
        lot.append((r[0], r[1]))
        size += len(r[1])
        if size >= lot_bytes:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """(doc_id, item_id), distinct: the item has `words` successive words that are successive words of the document.

    Items are taken to the driver in lots, in order of their ids, and LOTS lots at a time are searched for in all
    documents; documents never move. Where one pass isn't enough, each pass's rows are written and its tables given up
    before the next. Null texts and ids have no passages, nor have texts of fewer than `words` words. Repeated documents
    each have their rows (once per id), as have repeated items."""
    spark = documents.sparkSession
    ids = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    texts = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    ids = spread(ids)
    kind, item_kind = dict(ids.dtypes)["doc_id"], dict(texts.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}"
    tables = (t for t in (Patterns(lot, words) for lot in _lots(texts.orderBy("item_id").toLocalIterator(prefetchPartitions=True), lot_bytes)) if t.least)
    found: list[DataFrame] = []
    group = list(islice(tables, LOTS))
    while group:
        following = list(islice(tables, LOTS))
        shared = spark.sparkContext.broadcast(group)
        rows = ids.mapInPandas(_searcher(shared), schema)
        if following or found:
            rows = cut(rows, "leaks")
            shared.destroy()
        found.append(rows)
        group = following
    out = spark.createDataFrame([], schema)
    for rows in found:
        out = out.unionAll(rows)
    return out.distinct()


def _searcher(tables):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [normal(t) for t in pdf["text"]]
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= BATCH_BYTES):
                    size += len(texts[b])
                    b += 1
                for table in tables.value:
                    at, item = table.search(texts[a:b])
                    if len(at):
                        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[a + at], "item_id": item})
                a = b

    return run
