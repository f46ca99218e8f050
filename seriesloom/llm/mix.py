"""Drawing documents so that each source gives its target share of all tokens, by a min-cost flow.

A text may stand in several sources, and several times in one. Each text's copies in a source are taken apart by the
bits of their number: entry j of a text has 2^j copies in every source whose number has bit j, so that no copy is left
out. Entries are put together by membership pattern: the sources they stand in, j, and depth, the size (in bits) of
what the text's lower entries hold. So there are at most 2^sources patterns a j and depth, whatever the number of
documents or copies. Tokens flow from the patterns to the sources' quotas; a pattern's costs grow with every further
use of its texts, the uses of their lower entries counted, so repetition spreads before it deepens, over all sources
together. The flow is found on the driver, cost by cost, by augmenting paths over the sources with the patterns in
arrays.

Drawing: a pattern's entries lie on a circle in the order of a seeded hash, each as long as its text's tokens. The
sources' flows follow one another round the circle; a source uses an entry as often as the entry's start is passed.
Positions are prefix sums in two steps, within ranges of a hash and over the ranges, so no task orders a whole pattern;
a text's uses are dealt out to its copies in the same way, so no task gets all copies of a text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE vocabularies of this kind split text before merging; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranges of the hashes of a pattern's entries, and of a text's documents, that prefix sums are taken in.
RANGE_BITS, COPY_BITS = 12, 10
#: Uses from this one on are put together by powers of two, each at one cost.
EXACT_COSTS = 8


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, digest, tokens) of the documents with a source and a text that isn't empty."""
    kind = dict(documents.dtypes)["doc_id"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            e = encoder(vocabulary)
            pdf["tokens"] = [len(e.encode_ordinary(t)) for t in pdf["text"]]
            yield pdf[["doc_id", "source", "digest", "tokens"]]

    rows = documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & (F.col("text") != ""))
    return spread(rows.select("doc_id", "source", F.unhex(F.md5("text")).alias("digest"), "text")).mapInPandas(count, f"doc_id {kind}, source string, digest binary, tokens bigint")


def cost(k: int) -> int:
    """Cost of a token's use after k uses of its text."""
    return k if k < EXACT_COSTS else k.bit_length() - EXACT_COSTS.bit_length() + EXACT_COSTS


def _levels(first: int, uses: int) -> dict[int, int]:
    """How many of the uses that follow `first` others have each cost."""
    out, k, end = {}, first, first + uses
    while k < end:
        stop = k + 1 if k < EXACT_COSTS else 1 << k.bit_length()
        out[cost(k)] = min(stop, end) - k
        k = stop
    return out


def _dealt(amount: int, limits: np.ndarray) -> np.ndarray:
    """amount, from the first on as much to each as its limit."""
    upto = np.cumsum(limits)
    return np.clip(amount - (upto - limits), 0, limits)


def _push(x: np.ndarray, room: np.ndarray, supply: np.ndarray, quota: np.ndarray) -> None:
    """Maximum flow from supply over patterns and sources to quota, on top of the flow x; all are changed in place. A
    path enters at a source, may take tokens over from that source to another (of patterns in both), and so on."""
    n = len(quota)
    while True:
        free = room - x
        enter = np.minimum(supply[:, None], free).sum(0)
        shift = np.array([[0 if s == t else np.minimum(x[:, s], free[:, t]).sum() for t in range(n)] for s in range(n)])
        after = {s: None for s in range(n) if quota[s] > 0}  # the source that follows on the way to a quota
        front = list(after)
        start = next((s for s in front if enter[s] > 0), None)
        while front and start is None:
            front = [(s, t) for t in front for s in range(n) if s not in after and shift[s, t] > 0]
            for s, t in front:
                after.setdefault(s, t)
            front = list(dict.fromkeys(s for s, _ in front))
            start = next((s for s in front if enter[s] > 0), None)
        if start is None:
            return
        path = [start]
        while after[path[-1]] is not None:
            path.append(after[path[-1]])
        hops = list(zip(path, path[1:]))
        amount = min([int(enter[start]), int(quota[path[-1]])] + [int(shift[h]) for h in hops])
        for s, t in reversed(hops):
            moved = _dealt(amount, np.minimum(x[:, s], free[:, t]))
            x[:, s] -= moved
            x[:, t] += moved
        entered = _dealt(amount, np.minimum(supply, free[:, start]))
        x[:, start] += entered
        supply -= entered
        quota[path[-1]] -= amount


def route(patterns: dict[str, tuple[dict[str, int], int]], shares: dict[str, float], repeats: dict[str, int], total: int | None = None, before: dict[str, int] | None = None) -> tuple[dict[tuple[str, str], int], int]:
    """Tokens per (pattern, source), and the size drawn. patterns: per pattern, documents of each text by source, and
    the tokens of all its texts. total: tokens wanted; at most, and by default, as many as all quotas can be met with.
    before: per pattern, copies in each of its sources that stand in entries of the same text before it; 0 by default.
    Quotas are cut to whole tokens.

    The flow is of least cost: costs lie on the ways into the patterns only, so flow that has come in at a cost stays,
    and it is enough to take in what each cost allows, in ascending order, letting it shift what other sources use."""
    names = sorted(s for s, x in shares.items() if x > 0)
    exact = {s: Fraction(shares[s]) for s in names}
    room_of = {s: sum(w * n.get(s, 0) * repeats[s] for n, w in patterns.values()) for s in names}
    most = min((int(room_of[s] / x) for s, x in exact.items()), default=0)
    total = most if total is None else min(total, most)
    keys = list(patterns)
    room = np.array([[patterns[p][1] * patterns[p][0].get(s, 0) * repeats[s] for s in names] for p in keys], np.int64).reshape(len(keys), len(names))
    levels: dict[int, np.ndarray] = {}
    for i, p in enumerate(keys):
        n, w = patterns[p]
        inside = [s for s in names if n.get(s, 0) > 0]
        for c, k in _levels((before or {}).get(p, 0) * sum(repeats[s] for s in inside), sum(n[s] * repeats[s] for s in inside)).items():
            levels.setdefault(c, np.zeros(len(keys), np.int64))[i] = k * w
    x, supply = np.zeros_like(room), np.zeros(len(keys), np.int64)
    quota = np.array([int(total * exact[s]) for s in names], np.int64)
    for c in sorted(levels):
        supply += levels[c]
        _push(x, room, supply, quota)
    return {(keys[i], names[j]): int(x[i, j]) for i, j in zip(*np.nonzero(x))}, total


def entries(texts: DataFrame, names: list[str]) -> DataFrame:
    """texts (digest, w, and n_i documents in source i) to a row per text and entry: (digest, j, pattern, w)."""
    bit = lambda c, j: F.call_function("shiftright", c, j).bitwiseAND(1)
    n = [F.col(f"n_{i}") for i in range(len(names))]
    most = F.length(F.bin(F.greatest(*n, F.lit(0))))

    def entry(j):
        mask = sum((bit(c, j) * 2**i for i, c in enumerate(n)), F.lit(0).cast("bigint"))
        under = [F.when(bit(c, j) == 1, c.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), j) - 1)).otherwise(0) for c in n]
        lower = F.greatest(*under, F.lit(0))
        return F.struct(j.alias("j"), mask.cast("bigint").alias("mask"), F.when(lower > 0, F.length(F.bin(lower))).otherwise(0).alias("depth"))

    each = F.explode(F.filter(F.transform(F.sequence(F.lit(0), most - 1), entry), lambda e: e["mask"] > 0))
    return texts.select("digest", "w", each.alias("e")).select("digest", "w", F.col("e.j").alias("j"), F.concat_ws("@", "e.mask", "e.j", "e.depth").alias("pattern"))


def mix(counts: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, repeats): the drawn documents and how often each is used.

    counts: as from token_counts; targets: (source, target_share, max_repeats), a row per source, a handful (they are
    read by the driver). Each source's tokens differ from its share of the size drawn by less than one document's
    tokens per pattern that it draws from. No document is used more than max_repeats times. The same seed draws the
    same documents. All documents with the same text and source can be drawn. Sources without a target, with a null or
    zero share or no repeats give nothing; if a source with a share has no documents, nothing can be drawn in proportion
    and the result is empty. Documents of no tokens aren't drawn. Repeated doc_ids count as documents of their own, but
    may be dealt a text's uses in any order among themselves."""
    rows = [r for r in targets.select("source", "target_share", "max_repeats").collect() if r[0] is not None and (r[1] or 0) > 0]
    shares, repeats = {r[0]: float(r[1]) for r in rows}, {r[0]: int(r[2] or 0) for r in rows}
    names = sorted(shares)
    spark = counts.sparkSession
    empty = counts.select("doc_id", "source", "tokens", F.lit(0).cast("bigint").alias("repeats")).where(F.lit(False))
    if not names:
        return empty
    h = F.xxhash64("doc_id", F.lit(seed))
    known = cut(counts.where(F.col("source").isin(names) & (F.col("tokens") > 0)).withColumn("part", F.shiftrightunsigned(h, 64 - COPY_BITS)), "tokens")
    parts = known.groupBy("digest", "source", "part").agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("w"))
    per_source = (F.sum(F.when(F.col("source") == s, F.col("n")).otherwise(0)).alias(f"n_{i}") for i, s in enumerate(names))
    texts = cut(entries(parts.groupBy("digest").agg(F.max("w").alias("w"), *per_source), names), "texts")
    patterns, before = {}, {}
    for p, w in texts.groupBy("pattern").agg(F.sum("w")).collect():  # patterns: at most 2 ** sources a j and depth
        mask, j, depth = map(int, p.split("@"))
        patterns[p] = ({s: 2**j for i, s in enumerate(names) if mask >> i & 1}, int(w))
        before[p] = 2**depth // 2
    flows, _ = route(patterns, shares, repeats, total, before)
    if not flows:
        return empty
    arcs, at = [], {}
    for (p, s), x in sorted(flows.items()):
        begin = at.get(p, 0)
        at[p] = begin + x
        arcs.append((p, s, begin, begin + x, patterns[p][1]))
    plan = F.broadcast(spark.createDataFrame(arcs, "pattern string, source string, begin bigint, stop bigint, around bigint"))
    hashed = texts.withColumn("h", F.xxhash64("digest", "j", F.lit(seed))).withColumn("range", F.shiftrightunsigned("h", 64 - RANGE_BITS))
    ranges = hashed.groupBy("pattern", "range").agg(F.sum("w").alias("size"))
    ranges = ranges.select("pattern", "range", (F.sum("size").over(Window.partitionBy("pattern").orderBy("range")) - F.col("size")).alias("base"))
    inner = Window.partitionBy("pattern", "range").orderBy("h", "digest", "j").rowsBetween(Window.unboundedPreceding, 0)
    placed = hashed.join(ranges, ["pattern", "range"]).select("digest", "pattern", (F.col("base") + F.sum("w").over(inner) - F.col("w")).alias("c"))
    # Starts c + k * around in [begin, stop): as many as there are multiples in between.
    passed = lambda end: F.greatest(F.lit(0), F.floor((F.col(end) - F.col("c") + F.col("around") - 1) / F.col("around")))
    uses = placed.join(plan, "pattern").select("digest", "source", (passed("stop") - passed("begin")).alias("uses")).where(F.col("uses") > 0)
    # A text's uses in a source, dealt out to its documents in the order of their hashes.
    text = Window.partitionBy("digest", "source")
    based = parts.withColumn("base", F.sum("n").over(text.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("copies", F.sum("n").over(text)).select("digest", "source", "part", "base", "copies")
    dealt = based.join(uses.groupBy("digest", "source").agg(F.sum("uses").alias("uses")), ["digest", "source"])
    copy = F.col("base") + F.row_number().over(Window.partitionBy("digest", "source", "part").orderBy(h, "doc_id")) - 1
    own = F.floor(F.col("uses") / F.col("copies")) + (copy < F.col("uses") % F.col("copies")).cast("bigint")
    return known.join(dealt, ["digest", "source", "part"]).select("doc_id", "source", "tokens", own.cast("bigint").alias("repeats")).where(F.col("repeats") > 0)


def reached(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, reached_share) per target; what wasn't drawn is 0."""
    per = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    full = targets.select("source", "target_share").join(per, "source", "left").select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    return full.withColumn("reached_share", F.col("tokens") / F.nullif(whole, F.lit(0)))
