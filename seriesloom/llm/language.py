"""Language of documents and of the segments in them, by character language models.

Models are trained on a bounded sample of labelled documents: PER_LANGUAGE of each language, chosen by a hash of the
id. As labels may be wrong and texts mixed, the sample is cleaned first: what models of one half of it read in the
other half as another language than the label is left out. Every line is scored by all models; the most likely sequence of languages, where
each change costs SWITCH nats, makes the segments. A segment's language is the one of the lowest cross-entropy per
byte. Documents that were held out, and pieces of them of a few lines and of one, calibrate two things by length: a
segment is rejected (null) where its cross-entropy lies beyond what all but a share of REFUSED of such pieces need, and
its confidence comes from the margins over the other languages, on a scale that makes the pieces' languages most likely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import spread
from .kn import Model, encode, lines_of

#: Labelled documents a language to train on, and the longest such document; the bounds of the sample.
PER_LANGUAGE, LONGEST = 240, 20_000
SWITCH = 18.0
#: Times that the sample is cleaned of what its labels don't fit.
ROUNDS = 2
SHARE, LETTERS = 0.2, 40
#: Lines of the pieces of held-out documents that calibrate; 0 for the whole document.
PIECES = (1, 4, 0)
#: Share of held-out pieces of a length that may be refused, and the lengths in bytes that limits are told apart by.
REFUSED, LENGTHS = 0.0002, (0, 64, 512)
BATCH_BYTES = 2_000_000

SEGMENTS = "segment int, first_line int, last_line int, lang_found string, confidence double, share double"


def segment_lines(scores: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The most likely language of each line; texts advance side by side, line by line."""
    k = scores.shape[1]
    start = np.r_[0, np.cumsum(lines)[:-1]]
    order = np.argsort(-lines, kind="stable")
    start, lines = start[order], lines[order]
    back = np.zeros(scores.shape, np.int8)
    best = np.zeros((len(lines), k))
    steps = int(lines.max(initial=0))
    active = np.searchsorted(-lines, -np.arange(steps), "left")
    for i in range(steps):
        n = active[i]
        v = best[:n]
        top = v.argmax(1)
        move = v[np.arange(n), top] - SWITCH
        stay = v >= move[:, None]
        back[start[:n] + i] = np.where(stay, np.arange(k), top[:, None])
        best[:n] = np.where(stay, v, move[:, None]) + scores[start[:n] + i]
    out = np.zeros(len(scores), np.int8)
    now = best.argmax(1)
    for i in range(steps - 1, -1, -1):
        n = active[i]
        at = start[:n] + i
        out[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return out


class Identifier:
    """Models, limits and the confidence's scale, from labelled texts (language, text)."""

    def __init__(self, sample: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in sample})
        number = {x: i for i, x in enumerate(self.languages)}
        label = np.array([number[lang] for lang, _ in sample], np.int64)
        texts = [encode(lines_of(t)) for _, t in sample]
        held = np.arange(len(texts)) % 5 == 4
        parts, fits = texts, np.ones(len(texts), bool)
        for _ in range(ROUNDS):  # each half is read by models of the other, so that no document vouches for itself
            main, cleaned = np.zeros(len(texts), np.int64), list(texts)
            for half in (0, 1):
                mine = np.arange(len(texts)) % 2 == half
                self.model = self._learn(parts, texts, label, fits & ~mine)
                some = np.flatnonzero(mine)
                main[some], own = self._own_parts([texts[i] for i in some])
                for i, t in zip(some, own):
                    cleaned[i] = t
            parts, fits = cleaned, main == label
        self.model = self._learn(parts, texts, label, fits & ~held)
        self._calibrate([parts[i] for i in np.flatnonzero(held & fits)], label[held & fits])

    def _calibrate(self, texts: list[bytes], label: np.ndarray) -> None:
        k = len(self.languages)
        self.limit = np.full((len(LENGTHS), k), np.inf)
        self.scale, self.power = 1.0, 0.0
        if not texts:
            return
        scores, lengths, lines = self.model.line_scores(texts)
        text = np.repeat(np.arange(len(texts)), lines)
        line = np.arange(len(text)) - np.repeat(np.r_[0, np.cumsum(lines)[:-1]], lines)
        cost, size, own, weight = [], [], [], []
        for n in PIECES:
            piece = np.unique(np.stack([text, line // n if n else 0 * line]), axis=1, return_inverse=True)[1]
            count = int(piece.max()) + 1
            bytes_ = np.bincount(piece, lengths, count)
            nats = np.stack([np.bincount(piece, scores[:, i], count) for i in range(k)], 1)
            of = np.zeros(count, np.int64)
            of[piece] = text
            told = np.flatnonzero(bytes_ > 0)
            cost.append(-nats[told] / bytes_[told, None])
            size.append(bytes_[told])
            own.append(label[of[told]])
            weight.append(1 / np.bincount(of[told], minlength=len(texts))[of[told]])  # documents count alike
        cost, size, own, weight = (np.concatenate(x) for x in (cost, size, own, weight))
        if not len(size):
            return
        mine = cost[np.arange(len(own)), own]
        kind = self._kind(size)
        for c in range(len(LENGTHS)):
            here = kind == c
            if here.any():
                # A language with hardly any pieces of this length goes by all its pieces.
                some = [here & (own == i) if (here & (own == i)).sum() >= 3 else own == i for i in range(k)]
                middle = np.array([np.median(mine[x]) if x.any() else np.median(mine[here]) for x in some])
                self.limit[c] = middle * np.exp(self._beyond(np.log(mine[here] / middle[own[here]])))
        best = -np.inf
        for power in np.arange(0, 1.01, 0.125):
            for scale in 2.0 ** np.arange(-6, 14):
                self_p = self._soft(cost, size, scale, power)[np.arange(len(own)), own]
                fit = (weight * np.log(0.001 + 0.998 * self_p)).sum()
                if fit > best:
                    best, self.scale, self.power = fit, float(scale), float(power)

    @staticmethod
    def _beyond(x: np.ndarray) -> float:
        """What a share of REFUSED lies beyond, from the upper tenth taken for the tail of an exponential distribution, as
        there may be fewer pieces than it takes to see so small a share; not less than the largest."""
        tail = np.quantile(x, 0.9)
        return max(float(x.max()), float(tail + (x[x >= tail] - tail).mean() * np.log(0.1 / REFUSED)))

    @staticmethod
    def _kind(size: np.ndarray) -> np.ndarray:
        """Which of the LENGTHS each size is of."""
        return np.searchsorted(LENGTHS, size, "right") - 1

    def _learn(self, parts: list[bytes], texts: list[bytes], label: np.ndarray, keep: np.ndarray) -> Model:
        """Models of the kept texts' parts; a language that keeps none learns from all its texts."""
        per = [[parts[i] for i in np.flatnonzero(keep & (label == k))] or [texts[i] for i in np.flatnonzero(label == k)] for k in range(len(self.languages))]
        return Model(self.languages, per)

    @staticmethod
    def _soft(cost: np.ndarray, size: np.ndarray, scale: float, power: float) -> np.ndarray:
        """Shares of certainty from costs per byte; a longer text's margins count for more."""
        e = np.exp(-scale * np.maximum(size, 1)[:, None] ** power * (cost - cost.min(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)

    def _own_parts(self, texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The language of most of each text, and the lines in it."""
        scores, lengths, lines = self.model.line_scores(texts)
        lang = segment_lines(scores, lines)
        text = np.repeat(np.arange(len(texts)), lines)
        main = np.bincount(text * len(self.languages) + lang, lengths, len(texts) * len(self.languages)).reshape(len(texts), -1).argmax(1)
        keep = np.split(lang == main[text], np.cumsum(lines)[:-1])
        return main, [b"".join(x for x, k in zip(t.splitlines(True), ks) if k) for t, ks in zip(texts, keep)]

    def segments(self, raw: list[str]) -> dict[str, np.ndarray]:
        """Per segment, in order: text, number in it, first and last line from 0, language (-1: rejected),
        confidence (NaN if rejected), share of the text's characters."""
        raw = [lines_of(t) for t in raw]
        texts = [encode(t) for t in raw]
        scores, lengths, lines = self.model.line_scores(texts)
        chars = np.array([len(x) + 1 for t, n in zip(raw, lines) for x in t.split("\n")[:n]])
        lang = segment_lines(scores, lines)
        text = np.repeat(np.arange(len(texts)), lines)
        new = np.r_[True, (text[1:] != text[:-1]) | (lang[1:] != lang[:-1])]
        first = np.flatnonzero(new)
        size = np.add.reduceat(lengths, first)
        cost = -np.add.reduceat(scores, first, 0) / np.maximum(size, 1)[:, None]
        best = lang[first].astype(np.int64)
        t = text[first]
        begin = np.r_[0, np.cumsum(lines)[:-1]]
        own = cost[np.arange(len(first)), best]
        refused = (own > self.limit[self._kind(size), best]) | (size == 0)
        sure = self._soft(cost, size, self.scale, self.power)[np.arange(len(first)), best]
        part, whole = np.add.reduceat(chars, first), np.bincount(text, chars, len(texts))
        return {
            "text": t, "segment": np.arange(len(first)) - np.searchsorted(t, t, "left"), "first": first - begin[t], "last": np.r_[first[1:], len(text)] - 1 - begin[t],
            "lang": np.where(refused, -1, best), "confidence": np.where(refused, np.nan, sure), "share": part / np.maximum(whole[t], 1),
        }


def enough_letters(text: str) -> bool:
    """Whether a text has LETTERS letters or more, found in its beginning where it can be."""
    head = text[: 10 * LETTERS]
    return sum(map(str.isalpha, head)) >= LETTERS or (len(text) > len(head) and sum(map(str.isalpha, text)) >= LETTERS)


def labelled(documents: DataFrame, names: DataFrame) -> DataFrame:
    """documents with `label`: the language that lang stands for, null if it is null or unknown; and `chars`, the length
    of the text, from n_chars where documents have it, so that choosing a sample needn't read texts."""
    alias = F.broadcast(names.groupBy(F.lower("alias").alias("alias")).agg(F.min("lang").alias("label")))
    return documents.select("doc_id", "text", F.lower("lang").alias("alias"), (F.col("n_chars") if "n_chars" in documents.columns else F.length("text")).alias("chars")).join(alias, "alias", "left").drop("alias")


def train(docs: DataFrame) -> Identifier:
    """docs(doc_id, text, label, chars). The sample is at most PER_LANGUAGE documents a language of at most LONGEST
    characters, the same at every run; all else is left to scoring. Texts are read once, for the sample's."""
    known = docs.where(F.col("label").isNotNull() & F.col("chars").between(LETTERS, LONGEST))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = known.select("label", "doc_id").withColumn("k", F.row_number().over(order)).where(F.col("k") <= PER_LANGUAGE).select("doc_id", "k")
    texts = docs.where(F.col("label").isNotNull() & F.col("text").isNotNull()).select("doc_id", "label", "text")
    sample = texts.join(F.broadcast(rows.distinct()), "doc_id").select("label", "k", "doc_id", "text").collect()
    return Identifier([(r[0], r[3]) for r in sorted(sample) if len(r[3]) <= LONGEST])


def language_segments(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """docs(doc_id, text, label) to (doc_id, label, n_letters_ok, segment, first_line, last_line, lang_found,
    confidence, share): every segment of every text, in order, lines counted from 0. lang_found and confidence are null
    where no language's cross-entropy is acceptable. An empty text is one segment without language; null texts have none.
    Repeated rows each have their segments."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(identifier)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        me = shared.value
        names = np.array([*me.languages, None], object)
        for pdf in batches:
            texts = pdf["text"].tolist()
            enough = np.array([enough_letters(t) for t in texts], bool)
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= BATCH_BYTES):
                    size += len(texts[b])
                    b += 1
                s = me.segments(texts[a:b])
                at = a + s["text"]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[at], "label": pdf["label"].to_numpy()[at], "enough": enough[at], "segment": s["segment"], "first_line": s["first"], "last_line": s["last"], "lang_found": names[s["lang"]], "confidence": s["confidence"], "share": s["share"]})
                a = b

    return spread(docs.where(F.col("text").isNotNull()).select("doc_id", "text", "label")).mapInPandas(run, f"doc_id {kind}, label string, enough boolean, {SEGMENTS}")


def languages_found(segments: DataFrame) -> DataFrame:
    """Per document and language: share of the text, mean confidence; for texts of at least LETTERS letters."""
    return segments.where(F.col("enough") & F.col("lang_found").isNotNull()).groupBy("doc_id", "label", "lang_found").agg(F.sum("share").alias("share"), (F.sum(F.col("share") * F.col("confidence")) / F.sum("share")).alias("confidence"))


def corrections(segments: DataFrame) -> DataFrame:
    """(doc_id, lang_found, share, confidence) of the documents whose label needs it: each language of SHARE or more
    where there are two or more of them, else the main language if the label is missing or another."""
    per = languages_found(segments)
    doc = Window.partitionBy("doc_id")
    ranked = per.withColumn("large", F.sum((F.col("share") >= SHARE).cast("int")).over(doc)).withColumn("rank", F.row_number().over(doc.orderBy(F.desc("share"), "lang_found")))
    mixed = (F.col("large") >= 2) & (F.col("share") >= SHARE)
    wrong = (F.col("large") < 2) & (F.col("rank") == 1) & (F.col("label").isNull() | (F.col("label") != F.col("lang_found")))
    return ranked.where(mixed | wrong).select("doc_id", "lang_found", "share", "confidence")
