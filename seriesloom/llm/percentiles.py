"""Percentiles by exact bisection over mergeable states.

A state row holds sorted distinct values of one group and period with their counts: at most RUN of them, so a group
or day of any size is many rows. Rows are packed where they are read, without a shuffle; the same value may stand in
several rows of a group. States of several days, partitions or tables join by union, and those of a group's parts are
states of the group under its name; nothing is lost.

Doubles are ordered as 64-bit whole numbers (their bits, with the negative ones turned round). For each group and
percentile an interval of such numbers is kept that holds the target rank. A pass counts the rows below midpoints of
each interval, at whole multiples of a power of two, so that it is cut into at most WAYS + 1 parts, and narrows it to
the part with the rank: log2(WAYS) bisections at once. It ends when the interval is one number (exact), or
2^error_bits numbers wide: a double keeps its sign, exponent and upper 52 - error_bits mantissa bits then, a relative
error of at most 2^(error_bits - 52).

Passes go over the whole cluster, with the intervals as a table, as long as an interval holds more than LOCAL entries
of state rows; what an interval of fewer holds is brought to one task and halved there to the end. Groups that have no
more than LOCAL entries in all start so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

RUN = 4096
LOCAL = 65_536
WAY_BITS = 10
#: Rows that are packed at a time.
BLOCK = 1 << 20
STATE = "grp string, label string, period int, keys array<bigint>, counts array<bigint>, n bigint"
RESULT = "grp string, n bigint, permille int, value double, upper double"


def to_keys(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros give the same."""
    bits = (np.asarray(v, np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & np.int64(2**63 - 1))


def to_values(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, np.int64)
    return (k ^ ((k >> np.int64(63)) & np.int64(2**63 - 1))).view(np.float64)


class _Names:
    """Numbers for the texts of a column, over batches; null is -1."""

    def __init__(self) -> None:
        self.all: list[str] = []
        self.number: dict[str, int] = {}

    def of(self, column: pa.Array) -> np.ndarray:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        coded = column.dictionary_encode()
        mine = np.array([self.number.setdefault(x, len(self.number)) for x in coded.dictionary.to_pylist()] + [-1], np.int64)
        self.all.extend(list(self.number)[len(self.all) :])
        return mine[coded.indices.fill_null(len(mine) - 1).to_numpy(zero_copy_only=False)]


def _packed(grp: _Names, label: _Names, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    g, lab, period, keys, n = (np.concatenate(x) for x in zip(*parts))
    first = period.min()
    code = (g * (len(label.all) + 1) + lab + 1) * (int(period.max()) - int(first) + 1) + (period - first)
    order = np.lexsort((keys, code))
    code, keys, n = code[order], keys[order], n[order]
    start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (keys[1:] != keys[:-1])])
    n = np.add.reduceat(n, start)
    source, code, keys = order[start], code[start], keys[start]
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    size = np.diff(np.r_[begin, len(code)])
    rows = -(-size // RUN)
    nth = np.arange(rows.sum()) - np.repeat(np.r_[0, np.cumsum(rows)[:-1]], rows)
    cuts = np.repeat(begin, rows) + nth * RUN
    at = source[cuts]
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(code)].astype(np.int32)), pa.array(x))
    take = lambda names, i: pa.array([*names.all, None], pa.string()).take(pa.array(np.where(i < 0, len(names.all), i)))
    return pa.RecordBatch.from_arrays([take(grp, g[at]), take(label, lab[at]), pa.array(period[at].astype(np.int32)), lists(keys), lists(n), pa.array(np.add.reduceat(n, cuts))], ["grp", "label", "period", "keys", "counts", "n"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to state rows, BLOCK rows at a time."""
    grp, label, parts, size = _Names(), _Names(), [], 0
    for b in batches:
        if b.num_rows:
            number = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            parts.append((grp.of(b.column("grp")), label.of(b.column("label")), number("period").astype(np.int64), to_keys(number("value")), number("n").astype(np.int64)))
            size += b.num_rows
        if size >= BLOCK:
            yield _packed(grp, label, parts)
            grp, label, parts, size = _Names(), _Names(), [], 0
    if parts:
        yield _packed(grp, label, parts)


def state(rows: DataFrame) -> DataFrame:
    """State of rows (grp, period, value, n, and label if there is one): n times the value. Rows with a null group or a
    null or NaN value don't count; infinities do. A null period counts as period -1. Rows of different labels get state
    rows of their own, for relabelled."""
    v = F.col("value").cast("double")
    label = F.col("label") if "label" in rows.columns else F.lit(None)
    live = rows.where(F.col("grp").isNotNull() & v.isNotNull() & ~F.isnan(v))
    return live.select(F.col("grp").cast("string").alias("grp"), label.cast("string").alias("label"), F.coalesce(F.col("period").cast("int"), F.lit(-1)).alias("period"), v.alias("value"), F.col("n").cast("bigint").alias("n")).mapInArrow(_pack, STATE)


def relabelled(states: DataFrame) -> DataFrame:
    """The states of groups as states of what they are labelled with: by the label of the state row, else by the least
    one of its group. Groups without any label drop out. Only rows without a label are joined."""
    names = states.where(F.col("label").isNotNull()).groupBy("grp").agg(F.min("label").alias("name"))
    rest = states.where(F.col("label").isNull()).join(names, "grp").drop("label").withColumnRenamed("name", "label")
    return states.where(F.col("label").isNotNull()).unionByName(rest).select(F.col("label").alias("grp"), F.col("label"), "period", "keys", "counts", "n")


def _bisect(keys: np.ndarray, counts: np.ndarray, size: np.ndarray, group: np.ndarray, rank: np.ndarray, error_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of the targets, all halved together. keys, counts: of groups one after the other, size entries each;
    group, rank: of each target."""
    of = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((keys, of))
    keys, below = keys[order], np.r_[0, np.cumsum(counts[order])]
    start = np.r_[0, np.cumsum(size)[:-1]]
    a, b = start[group], (start + size)[group]
    want = rank + below[a]
    lo, hi = keys[a], keys[b - 1]
    live = np.arange(len(a))
    while True:
        live = live[(hi[live].view(np.uint64) - lo[live].view(np.uint64)) >= np.uint64(2**error_bits)]
        if not len(live):
            return lo, hi
        x, y = lo[live], hi[live]
        mid = (x & y) + ((x ^ y) >> 1)  # the mean, without overflow
        p, q = a[live], b[live]
        while (p < q).any():  # the first key beyond mid
            m = (p + q) >> 1
            right = (keys[np.minimum(m, len(keys) - 1)] <= mid) & (p < q)
            p, q = np.where(right, m + 1, p), np.where(right, q, np.minimum(q, m))
        reached = below[p] >= want[live]
        lo[live], hi[live] = np.where(reached, x, mid + 1), np.where(reached, mid, y)
        a[live], b[live] = np.where(reached, a[live], p), np.where(reached, p, b[live])
        if error_bits == 0:  # what holds one number only is resolved
            one = live[keys[a[live]] == keys[b[live] - 1]]
            lo[one] = hi[one] = keys[a[one]]


def ranks(n: int, permille: list[int]) -> list[int]:
    """The smallest rank that at least the share reaches, from 1."""
    return [max(1, -(-n * p // 1000)) for p in permille]


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(k) for k in pdf["keys"]], np.int64)
    return np.concatenate(list(pdf["keys"])).astype(np.int64), np.concatenate(list(pdf["counts"])).astype(np.int64), size


def _wide(error_bits: int) -> Column:
    return F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)") >= 2**error_bits


def percentiles(states: DataFrame, permille: list[int], error_bits: int = 0, written: bool = False) -> DataFrame:
    """(grp, n, permille, value, upper) from the union of any states: the value of rank ceil(n * permille / 1000), at
    least 1, among a group's n rows in ascending order lies between value and upper, which are equal if error_bits is
    0. Ties don't matter. A group without rows has no result. written: states are a table, which is read in every pass;
    else they are written first."""
    kept = (states if written else cut(states, "state")).select("grp", "keys", "counts", "n")
    sizes = kept.groupBy("grp").agg(F.sum(F.size("keys")).alias("inside"), F.sum("n").alias("n"), F.min(F.element_at("keys", 1)).alias("lo"), F.max(F.element_at("keys", -1)).alias("hi"))
    each = F.explode(F.array(*(F.lit(p) for p in permille)))
    first = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("permille") / F.lit(1000).cast("decimal(4,0)"))).cast("bigint")
    at = cut(sizes.where(F.col("inside") > LOCAL).withColumn("permille", each).select("grp", "n", "permille", "lo", "hi", first.alias("rank"), "inside"), "intervals")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every group at hand as a whole, with all its percentiles."""
        for pdf in batches:
            if not len(pdf):
                continue
            keys, counts, size = _flat(pdf)
            n = np.add.reduceat(counts, np.r_[0, np.cumsum(size)[:-1]])
            rank = np.concatenate([ranks(int(x), permille) for x in n])
            lo, hi = _bisect(keys, counts, size, np.repeat(np.arange(len(pdf)), len(permille)), rank, error_bits)
            yield pd.DataFrame({"grp": np.repeat(pdf["grp"].to_numpy(object), len(permille)), "n": np.repeat(n, len(permille)), "permille": np.tile(np.array(permille, np.int32), len(pdf)), "value": to_values(lo), "upper": to_values(hi)})

    together = F.flatten(F.collect_list("keys")).alias("keys"), F.flatten(F.collect_list("counts")).alias("counts")
    some = at.isEmpty()
    small = kept if some else kept.join(at.select("grp").distinct(), "grp", "left_anti")
    result = small.groupBy("grp").agg(*together).mapInPandas(whole, RESULT)
    if some:
        return result
    rows = cut(kept.join(at.select("grp").distinct(), "grp", "left_semi"), "large")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows and entries per part of each interval, summed over the batch's rows of a group."""
        for pdf in batches:
            out = []
            for g, part in pdf.groupby("grp", sort=False):
                keys, counts, _ = _flat(part)
                for t in part["targets"].iloc[0]:
                    lo, w = np.int64(t["lo"]), np.int64(t["w"])
                    ok = (keys >= lo) & (keys <= t["hi"])
                    bins = (keys[ok] >> w) - (lo >> w)
                    n, m = np.bincount(bins, counts[ok]).astype(np.int64), np.bincount(bins)
                    used = np.flatnonzero(m)
                    out.append(pd.DataFrame({"grp": g, "lo": lo, "bin": used, "n": n[used], "inside": m[used]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, keys, counts, targets in zip(pdf["grp"], pdf["keys"], pdf["counts"], pdf["targets"]):
                for t in targets:
                    i, j = np.searchsorted(keys, t["lo"], "left"), np.searchsorted(keys, t["hi"], "right")
                    if i < j:
                        out.append((g, t["lo"], keys[i:j], counts[i:j]))
            if out:
                yield pd.DataFrame(out, columns=["grp", "lo", "keys", "counts"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            many = np.array([len(x) for x in pdf["targets"]])
            keys, counts, size = _flat(pdf)
            targets = [t for x in pdf["targets"] for t in x]
            lo, hi = _bisect(keys, counts, size, np.repeat(np.arange(len(pdf)), many), np.array([t["rank"] for t in targets]), error_bits)
            yield pd.DataFrame({"grp": np.repeat(pdf["grp"].to_numpy(object), many), "n": [t["n"] for t in targets], "permille": np.array([t["permille"] for t in targets], np.int32), "value": to_values(lo), "upper": to_values(hi)})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"grp": pdf["grp"], "n": pdf["n"], "permille": pdf["permille"], "value": to_values(pdf["lo"]), "upper": to_values(pdf["hi"])})

    shift = lambda f, c, n: F.call_function(f, c, n)
    w = F.greatest(F.lit(0), F.length(F.bin(F.col("lo").bitwiseXOR(F.col("hi")))) - WAY_BITS)
    wide, few = _wide(error_bits), F.col("inside") <= LOCAL
    while True:
        result = result.unionByName(at.where(~wide).mapInPandas(read, RESULT))
        # Intervals of one group are apart or the same, so their lower ends tell them from each other.
        near = at.where(wide & few)
        ask = near.groupBy("grp").agg(F.collect_set(F.struct("lo", "hi")).alias("targets"))
        own = near.groupBy("grp", "lo").agg(F.collect_list(F.struct("n", "permille", "rank")).alias("targets"))
        got = rows.join(ask, "grp").mapInPandas(within, "grp string, lo bigint, keys array<bigint>, counts array<bigint>").groupBy("grp", "lo").agg(*together)
        result = result.unionByName(got.join(own, ["grp", "lo"]).mapInPandas(finish, RESULT))
        at = at.where(wide & ~few).withColumn("w", w)
        if at.isEmpty():
            return result
        ask = at.groupBy("grp").agg(F.collect_set(F.struct("lo", "hi", "w")).alias("targets"))
        bins = rows.join(ask, "grp").mapInPandas(count, "grp string, lo bigint, bin bigint, n bigint, inside bigint").groupBy("grp", "lo", "bin").agg(F.sum("n").alias("here"), F.sum("inside").alias("inside"))
        by = Window.partitionBy("grp", "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most WAYS + 1 rows
        ends = bins.withColumn("upto", F.sum("here").over(by)).withColumnRenamed("inside", "now")
        chosen = at.join(ends, ["grp", "lo"]).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("here")))
        part = shift("shiftleft", shift("shiftright", F.col("lo"), F.col("w")) + F.col("bin"), F.col("w"))
        last = part.bitwiseOR(shift("shiftleft", F.lit(1).cast("bigint"), F.col("w")) - 1)
        at = cut(chosen.select("grp", "n", "permille", F.greatest("lo", part).alias("lo"), F.least("hi", last).alias("hi"), (F.col("rank") - F.col("upto") + F.col("here")).alias("rank"), F.col("now").alias("inside")), "intervals")
