"""References to records that don't exist, are gone or come later.

A Bloom filter of all parent keys goes to every task. What it refuses is certainly no parent, so those references are
orphans without a join; what it lets through is checked by an exact join, which also judges times. References are
first summed up per key and period: only the earliest and the latest matter, so a key with a third of all references
is one row per period.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

#: Bits of the filter: at most 2^MOST_BITS (16 MiB), whatever the number of parents; a fuller filter only sends more
#: references to the exact join.
MOST_BITS = 27
#: Two 64-bit hashes give four positions of up to MOST_BITS bits each.
SHIFTS = (0, 32)
#: Bytes of JSON up to which its variant, at most three times as large, is within Spark's limit of 128 MiB.
VARIANT_FITS = 2**24


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2")]


class Bloom:
    """A Bloom filter of a column of texts, built by a map-side OR per 64-bit word."""

    def __init__(self, parents: DataFrame, key: str = "key", bits: int | None = None):
        if bits is None:
            bits = min(MOST_BITS, max(10, math.ceil(math.log2(12 * max(1, parents.count())))))
        self.bits = bits
        places = [F.shiftrightunsigned(h, s).bitwiseAND(2**bits - 1) for h in ("h1", "h2") for s in SHIFTS]
        spots = parents.where(F.col(key).isNotNull()).select(*_hashes(F.col(key))).select(F.explode(F.array(*places)).alias("p"))
        words = spots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).toArrow()
        table = np.zeros(max(1, 2**bits // 64), np.int64)
        table[words["w"].to_numpy()] = words["b"].to_numpy()
        self.table = parents.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def may_hold(self, key: Column) -> Column:
        """Null keys aren't held."""
        table, mask = self.table, np.uint64(2**self.bits - 1)

        @F.pandas_udf("boolean")
        def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
            out = np.ones(len(h1), bool)
            for h in (h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)):
                for s in SHIFTS:
                    p = (h >> np.uint64(s)) & mask
                    out &= ((table.value[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
            return pd.Series(out)

        return test(*_hashes(key)) & key.isNotNull()


def orphans(refs: DataFrame, parents: DataFrame, grace_ms: int = 3_600_000, bits: int | None = None) -> DataFrame:
    """refs (ref_table, ref_field, key, at TIMESTAMP), parents (key, made, gone: TIMESTAMPs). Out: (ref_table,
    ref_field, key, period 'YYYY-MM' in UTC, n_refs, reason) for every key and period with at least one orphan among
    its references; reason is 'missing', or 'gone' (gone at or before the reference), or 'later' (made more than
    grace_ms after it), the first that holds. Null keys are no references. Without a time the period is null and
    only 'missing' can hold; a null `made` means always there, a null `gone` not gone. Repeated parents count as one
    that lives from the earliest made to the latest gone. No parents: every reference is an orphan."""
    summed = (
        refs.where(F.col("key").isNotNull())
        .groupBy("ref_table", "ref_field", "key", F.date_format("at", "yyyy-MM").alias("period"))
        .agg(F.count(F.lit(1)).alias("n_refs"), F.min("at").alias("earliest"), F.max("at").alias("latest"))
    )
    known = parents.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.when(F.count("made") == F.count(F.lit(1)), F.min("made")).alias("made"), F.when(F.count("gone") == F.count(F.lit(1)), F.max("gone")).alias("gone"), F.lit(True).alias("known")
    )
    tested = cut(summed.withColumn("maybe", Bloom(known, bits=bits).may_hold(F.col("key"))), "refs")
    sure = tested.where(~F.col("maybe")).withColumn("reason", F.lit("missing"))
    checked = tested.where(F.col("maybe")).join(known, "key", "left")
    late = F.col("made") > F.col("earliest") + F.make_dt_interval(secs=F.lit(grace_ms / 1000).cast("decimal(18,6)"))
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("gone") <= F.col("latest"), "gone").when(late, "later")
    columns = ["ref_table", "ref_field", "key", "period", "n_refs", "reason"]
    return sure.select(*columns).unionAll(checked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*columns))


def json_elements(c: Column) -> Column:
    """Elements of a JSON array of texts; an empty array for null, broken JSON and JSON that is no array."""
    parsed = F.try_parse_json(c)
    valid = F.schema_of_variant(parsed).startswith("ARRAY")
    # A long text may have no variant because that would be too large, so it is read as strictly without one.
    strict = F.from_json(c, "array<string>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    large = F.when(parsed.isNull() & (F.octet_length(c) > VARIANT_FITS), strict)
    return F.coalesce(F.when(valid, F.from_json(c, "array<string>")), large, F.array().cast("array<string>"))
