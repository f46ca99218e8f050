"""Exact bisection against sorting, in one task and in passes, over merged and relabelled states."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import percentiles as pct


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def exact(values, permille):
    v = sorted(values)
    return [v[max(1, -(-len(v) * p // 1000)) - 1] for p in permille]


@pytest.mark.parametrize("local", [0, 10**6])
def test_percentiles(spark, monkeypatch, local):
    monkeypatch.setattr(pct, "LOCAL", local)
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=301), "b": np.round(rng.normal(0, 1e300, 57)), "c": np.array([5.0]), "d": np.repeat([1.0, -2.0, 0.0, -0.0], 11), "e": np.array([math.inf, -math.inf, 1e-320, -1e-320, 3.4e38])}
    data = [(g, int(i % 5) if i % 7 else None, float(v), 1, "x") for g, vs in groups.items() for i, v in enumerate(vs)]
    data += [(None, 1, 1.0, 1, ""), ("a", 1, None, 1, ""), ("a", 1, math.nan, 1, ""), ("z", 1, None, 1, "")]
    df = spark.createDataFrame(data, "grp string, period int, value double, n int, keys string").repartition(3)
    p = [1, 100, 500, 900, 1000]
    got = {g: [(r["value"], r["upper"]) for r in sorted((r for r in pct.percentiles(pct.state(df), p).collect() if r["grp"] == g), key=lambda r: r["permille"])] for g in groups}
    assert got == {g: [(x, x) for x in exact(v, p)] for g, v in groups.items()}
    if not local:
        return
    halves = [pct.state(df.where(F.pmod(F.hash("value"), F.lit(2)) == i)) for i in (0, 1)]
    merged = pct.percentiles(halves[0].unionByName(halves[1]), p)
    assert rows(merged) == rows(pct.percentiles(pct.state(df), p))
    loose = pct.percentiles(pct.state(df.where("grp = 'a'")), p, error_bits=40).collect()
    for r, x in zip(sorted(loose, key=lambda r: r["permille"]), exact(groups["a"], p)):
        assert r["value"] <= x <= r["upper"] and r["upper"] - r["value"] <= abs(x) * 2.0 ** (41 - 52)
    assert rows(pct.percentiles(pct.state(df.limit(0)), p)) == []


def test_packing(monkeypatch):
    """Runs of at most RUN sorted distinct values, over blocks and batches, with nothing lost."""
    monkeypatch.setattr(pct, "RUN", 7)
    monkeypatch.setattr(pct, "BLOCK", 100)
    rng = np.random.default_rng(2)
    rows = [(f"g{rng.integers(3)}", [None, "x"][rng.integers(2)], int(rng.integers(-2, 3)), float(rng.integers(30)), int(rng.integers(1, 4))) for _ in range(350)]
    table = pa.Table.from_pylist([dict(zip(("grp", "label", "period", "value", "n"), r)) for r in rows], pa.schema([("grp", pa.string()), ("label", pa.string()), ("period", pa.int32()), ("value", pa.float64()), ("n", pa.int64())]))
    got = [r for b in pct._pack(iter(table.to_batches(max_chunksize=60))) for r in b.to_pylist()]
    assert all(len(r["keys"]) <= 7 and r["keys"] == sorted(set(r["keys"])) and sum(r["counts"]) == r["n"] for r in got)
    count = lambda items: sum((Counter({k: n}) for k, n in items), Counter())
    flat = count(((r["grp"], r["label"], r["period"], k), c) for r in got for k, c in zip(r["keys"], r["counts"]))
    assert flat == count(((g, lab, p, int(pct.to_keys(np.array([v]))[0])), n) for g, lab, p, v, n in rows)


@pytest.mark.parametrize("local", [20, 10**6])
def test_relabelled(spark, monkeypatch, local):
    """States of parts are states of the whole under its name; rows without a label go with their group's."""
    monkeypatch.setattr(pct, "LOCAL", local)
    rng = np.random.default_rng(1)
    data = [(f"s{i % 3}", ["m", "m", "k"][i % 3] if i % 5 else None, i % 4, float(v), 1) for i, v in enumerate(np.round(rng.normal(0, 9, 600)))]
    data += [("lone", None, 1, 1.0, 1)] * 3
    states = pct.state(spark.createDataFrame(data, "grp string, label string, period int, value double, n int").repartition(3))
    got = {g: [r["value"] for r in sorted((r for r in pct.percentiles(pct.relabelled(states), [250, 500]).collect() if r["grp"] == g), key=lambda r: r["permille"])] for g in ("m", "k")}
    assert got == {g: exact([d[3] for d in data if d[0] in s], [250, 500]) for g, s in (("m", ("s0", "s1")), ("k", ("s2",)))}
    assert {r["grp"] for r in pct.percentiles(pct.relabelled(states), [500]).collect()} == {"m", "k"}
    many = pct.state(spark.range(5000).select(F.lit("a").alias("grp"), F.lit(1).alias("period"), F.lit(2.5).alias("value"), F.lit(10**9).alias("n")))
    assert [tuple(r) for r in pct.percentiles(many, [500]).collect()] == [("a", 5000 * 10**9, 500, 2.5, 2.5)]
