"""Intervals, percentiles, rolling totals, orphans and implausible readings against brute force, and their edges."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.keys import canonical_file, canonical_id
from seriesloom.operators.intervals import periods_and_gaps
from seriesloom.operators.orphans import Bloom, json_elements, orphans
from seriesloom.operators.rolling import RollingState, rolling_totals
from seriesloom.operators.spikes import implausible
from seriesloom.sources.store import named


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- keys


def test_canonical_keys(spark):
    want = "0aa1b2c3-0000-1111-2222-333344445555"
    forms = [want, want.upper(), "{" + want + "}", "urn:uuid:" + want, f"  {want} ", want.replace("-", ""), "URN:UUID:{" + want.upper() + "}", "{ " + want.replace("-", "") + " }"]
    got = spark.createDataFrame([(f,) for f in [*forms, None, "Other ", ""]], "c string").select(canonical_id(F.col("c"))).collect()
    assert [r[0] for r in got] == [want] * len(forms) + [None, "other", ""]
    files = [("a/b.ty", "a/b.ty"), ("./A\\b.TY", "a/b.ty"), ("/.//a/b.ty", "a/b.ty"), (".\\a/b.ty", "a/b.ty"), ("../a", "../a"), (None, None), ("", "")]
    got = spark.createDataFrame([(f,) for f, _ in files], "c string").select(canonical_file(F.col("c"))).collect()
    assert [r[0] for r in got] == [w for _, w in files]


# --- intervals


def brute_intervals(data):
    out = []
    for e in sorted({r[0] for r in data if r[0] is not None}):
        mine = [(s, 10**9 if t is None else t) for x, s, t in data if x == e and s is not None and (t is None or t >= s)]
        if not mine:
            continue
        covered = sorted(mine)
        merged = [list(covered[0])]
        for s, t in covered[1:]:
            if s <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out += [(e, "covered", s, None if t == 10**9 else t) for s, t in merged] + [(e, "gap", a[1] + 1, b[0] - 1) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_intervals(spark, width):
    rng = random.Random(width)
    data = [(rng.choice("abcx"), s := rng.randrange(0, 300), rng.choice([None, s - 1] + [s + rng.randrange(6)] * 40)) for _ in range(120)]
    data += [(None, 1, 2), ("a", None, 3), ("n", 5, 5), ("n", 5, 5), ("n", 6, 6), ("n", 8, 2**63 - 1), ("r", 9, 3)]
    df = spark.createDataFrame([(e, s, t, "x", 1) for e, s, t in data], "entity string, s bigint, e bigint, kind string, start int")
    want = brute_intervals([(e, s, None if t == 2**63 - 1 else t) for e, s, t in data])
    assert rows(periods_and_gaps(df, "entity", "s", "e", width)) == want
    assert rows(periods_and_gaps(df.limit(0), "entity", "s", "e")) == []


# --- rolling totals

DAY = 86_400_000


def brute_rolling(data, windows):
    out = []
    for e in sorted({r[0] for r in data}):
        mine = {(t, v) for x, t, v in data if x == e}
        days = [t // DAY for t, _ in mine]
        for d in range(min(days), max(days) + 1):
            row = [e, dt.date(1970, 1, 1) + dt.timedelta(d)]
            for w in windows:
                vs = [v for t, v in mine if d - w < t // DAY <= d]
                row += [math.fsum(vs), math.fsum(vs) / len(vs) if vs else None, len(vs)]
            out.append(tuple(row))
    return out


def same_rolling(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and [x is None for x in g] == [x is None for x in w]
        assert [x or 0.0 for x in g[2:]] == pytest.approx([x or 0.0 for x in w[2:]], rel=1e-15, abs=0)


def test_rolling(spark, tmp_path):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.choice([0, 3, 4, 20, 21, 60, 61]) * DAY + rng.randrange(DAY), round(rng.uniform(-9, 9), 4)) for _ in range(60)]
    data += [("h", 5 * DAY, 3.4e38), ("h", 6 * DAY, 1.5), ("h", 30 * DAY, 2.5), ("h", 36 * DAY, -1.0)]
    data += [("s", 1 * DAY, 1e-12), ("s", 2 * DAY, 5e-324), ("s", 3 * DAY, 1.7e308), ("s", 10 * DAY, 3e-12), ("s", 40 * DAY, 0.0), ("s", 41 * DAY, -0.0)]
    schema = "entity string, ts bigint, value double, day string"
    make = lambda x: spark.createDataFrame([(*r, "x") for r in x], schema)
    junk = [(None, 1, 1.0), ("a", None, 1.0), ("a", 1, None), ("a", 99 * DAY, math.nan), ("a", 99 * DAY, math.inf)]
    total = lambda *parts: rolling_totals([make(p) for p in parts], "entity", "ts", "value")
    same_rolling(total(data + data[:9] + junk), brute_rolling(data, (7, 30)))
    # Corrections, repeats and new days in later versions, before the first day and far after the last, too.
    rng.shuffle(data)
    late = [("a", -40 * DAY, 2.0), ("b", 200 * DAY, 4.0), ("new", 7 * DAY, 1.0), ("a", 61 * DAY + 5, 7.0), ("a", 61 * DAY + 6, 7e30)]
    parts = [data[:30], data[20:50] + late, data[50:] + late[:2]]
    same_rolling(total(*parts), brute_rolling(data + late, (7, 30)))
    assert rows(total([])) == [] and len(rows(total([], data[:3], []))) == len(brute_rolling(data[:3], (7, 30)))


def test_versions_write_only_what_is_new(spark, tmp_path):
    make = lambda x: spark.createDataFrame(x, "entity string, ts bigint, value double")
    state = RollingState(spark, str(tmp_path / "state"))
    assert RollingState.open(spark, state.path).version == 0
    first = state.advance(make([(e, d * DAY, 1.0) for e in "abc" for d in range(50)]))
    second = first.advance(make([("a", 50 * DAY, 5.0), ("b", 49 * DAY + 1, 2.0), ("c", 3 * DAY, 1.0)]))
    written = lambda name: sorted((r["entity"], r["day"]) for r in second._read(name, 2).collect())
    assert written("seen") == [("a", 50), ("b", 49)] and written("rolling") == [("a", 50), ("b", 49)]
    again = RollingState.open(spark, state.path)
    assert again.version == 2 and rows(again.report()) == rows(second.report())
    third = again.advance(make([("a", 50 * DAY, 5.0)]))
    assert third.version == 3 and rows(third.report()) == rows(second.report())
    got = {(r["entity"], str(r["day"])): (r["sum_7"], r["n_30"]) for r in third.report().collect()}
    assert got["a", "1970-02-20"] == (11.0, 30) and got["b", "1970-02-19"] == (9.0, 31)
    # A version that stopped before its end is none, and is written over.
    third._write("rolling", third._read("rolling", 1).drop("version"))
    assert RollingState.open(spark, state.path).version == 3
    assert third.advance(make([("a", 51 * DAY, 1.0)])).report().count() == third.report().count() + 1


# --- orphans


@pytest.mark.parametrize("bits", [None, 6])
def test_orphans(spark, bits):
    at = lambda d, h=0: dt.datetime(2020, 1, 1) + dt.timedelta(days=d, hours=h)
    parents = [("k1", at(5), None), ("k2", at(0), at(40)), ("k3", None, None), ("k3", at(9), at(10)), (None, at(0), None)] + [(f"p{i}", at(0), None) for i in range(50)]
    refs = [("t", "f", k, t) for k, t in [("k1", at(5, -1)), ("k1", at(33)), ("k1", at(4)), ("k2", at(39)), ("k2", at(40)), ("k2", at(70)), ("k3", at(1)), ("no", at(1)), ("no", at(2)), ("no", None), ("k2", None), (None, at(1)), ("p7", at(3))]]
    df = spark.createDataFrame([(*r, "x") for r in refs], "ref_table string, ref_field string, key string, at timestamp, known string")
    pf = spark.createDataFrame([(*p, "x") for p in parents], "key string, made timestamp, gone timestamp, at string")
    want = [("t", "f", "k1", "2020-01", 2, "later"), ("t", "f", "k2", "2020-02", 2, "gone"), ("t", "f", "k2", "2020-03", 1, "gone"), ("t", "f", "no", "2020-01", 2, "missing"), ("t", "f", "no", None, 1, "missing")]
    assert rows(orphans(df, pf, bits=bits)) == sorted(want, key=repr)
    assert {r["reason"] for r in orphans(df, pf.limit(0)).collect()} == {"missing"}
    assert rows(orphans(df.limit(0), pf)) == []
    bloom = Bloom(pf, bits=bits)
    seen = spark.createDataFrame([(f"p{i}",) for i in range(50)] + [(None,)], "key string").select("key", bloom.may_hold(F.col("key"))).collect()
    assert all(r[1] == (r[0] is not None) for r in seen)


def test_json_elements(spark):
    texts = ['["a", null, "b"]', "[]", '["a", "b', '{"a": 1}', '"a"', None, "", "null", "[1, [2]]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(json_elements(F.col("t"))).collect()
    assert [r[0] for r in got] == [["a", None, "b"], [], [], [], [], [], [], [], ["1", "[2]"]]


def test_json_elements_beyond_a_variant(spark):
    """A valid array too large for a variant keeps its elements; a broken or other text of that size has none."""
    inner = F.expr("array_join(array_repeat(repeat('x', n), 16), between)")
    forms = [(10**7, '["', '","', '"]'), (10**7, '["', '","', '"'), (10**7, "['", "','", "']"), (10**7, '{"a": "', "", '"}')]
    texts = spark.createDataFrame(forms, "n int, open string, between string, close string").repartition(4).select("open", "close", F.concat("open", inner, "close").alias("t"))
    got = texts.select("open", "close", F.transform(json_elements(F.col("t")), F.length).alias("n")).collect()
    assert {(r["open"], r["close"]): r["n"] for r in got} == {('["', '"]'): [10**7] * 16, ('["', '"'): [], ("['", "']"): [], ('{"a": "', '"}'): []}


# --- implausible readings


def readings(n, seed=0, step=60_000, start=1_600_000_000_000):
    rng = np.random.default_rng(seed)
    t = start // step * step + np.arange(n) * step
    return t, np.round(50 + 5 * np.sin(t / 86_400_000 * 2 * np.pi) + rng.normal(0, 0.2, n), 3)


SCHEMA = "entity string, seq bigint, ts bigint, value double, step_ms bigint, lo double, hi double, counter boolean, held boolean, kind string"


def flagged(spark, frames, step=60_000):
    data, seq, keys = [], 0, {}
    for name, t, v, counter, held in frames:
        for i, (a, b) in enumerate(zip(t, v)):
            data.append((name, seq, None if a is None else int(a), None if b is None else float(b), step, -100.0, 1e12 if counter else 1000.0, counter, held, "x"))
            keys[seq] = (name, i)
            seq += 1
    got = implausible(spark.createDataFrame(data, SCHEMA)).collect()
    return {(k, *keys[s]) for _, s, k in ((r["entity"], r["seq"], r["kind"]) for r in got)}


@pytest.mark.parametrize("step", [60_000, 6_000])
def test_spikes(spark, step):
    t, v = readings(6000, step=step)
    want = set()
    for i in (700, 701, 702, 2500, 2880, 4000, 4001, 4002, 4003, 4004):
        v[i] += 8 if i != 2500 else -8
        want.add(("spike", "a", i))
    v[3000:] += 30  # a lasting change of level
    v[5000:5009] = v[5000]
    want |= {("run", "a", i) for i in range(5000, 5009)}
    v[5500:5507] = v[5500]  # one too few
    v[1000], v[1001], v[1002], v[1003] = math.nan, math.inf, -200, 5000
    want |= {("range", "a", i) for i in range(1000, 1004)}
    v[1500:1506] += 20  # six in a row are no spike
    assert flagged(spark, [("a", t, v, False, False)]) == want


def test_implausible_edges(spark):
    t, v = readings(100, 3)
    up = np.cumsum(np.r_[np.full(60, 3.0), np.full(40, 4.0)])
    up[70:] -= up[70]  # a restart
    jump = up.copy()
    jump[30] += 500
    spiky = v.copy()
    spiky[50] = 90
    twice_t, twice_v = np.r_[t, t[50], t[50]], np.r_[spiky, 90, 90.1]
    frames = [("count", t, jump, True, False), ("held", t, np.full(100, 7.0), False, True), ("few", t[:39], np.r_[spiky[40:60], v[:19]], False, False), ("twice", twice_t, twice_v, False, False), ("flat", t, np.full(100, 7.0), False, False), ("one", t[:1], v[:1], False, False)]
    frames += [(None, t[:2], v[:2], False, False), ("nulls", [None, t[1]], [1.0, None], False, False)]
    want = {("spike", "count", 30), ("spike", "twice", 50), ("spike", "twice", 100), ("spike", "twice", 101)} | {("run", "flat", i) for i in range(100)}
    assert flagged(spark, frames) == want
    assert implausible(spark.createDataFrame([], SCHEMA)).collect() == []


def test_named(spark):
    df = spark.createDataFrame([("a", "m", 1), ("a", None, 2), ("b", None, 3)], "stream_id string, name string, seq int")
    assert rows(named(df, ["stream_id", "seq"])) == sorted([("a", 1, "m"), ("a", 2, "m"), ("b", 3, None)], key=repr)


def test_normal_daily_behaviour_is_no_spike(spark):
    """A peak at the same time every day is low rank; the same peak on one day is a spike."""
    t, v = readings(14 * 144, 1, 600_000)
    v = v - 5 * np.sin(t / 86_400_000 * 2 * np.pi)
    day = (t // 600_000) % 144
    v[day == 60] += 12
    v[1000] += 12
    got = implausible(spark.createDataFrame([("a", i, int(x), float(y), 600_000, None, None, False, False, "") for i, (x, y) in enumerate(zip(t, v))], SCHEMA)).toPandas()
    assert isinstance(got, pd.DataFrame) and got["seq"].tolist() == [1000]


def test_low_rank_part_decides(monkeypatch):
    """What the low-rank part doesn't explain is a candidate: without it, daily behaviour drowns the spikes."""
    from seriesloom.operators import spikes

    t, v = readings(7 * 1440, 4)
    at = np.flatnonzero(v > 53)[[500, 1200, 1201, 2000]].tolist()  # at the height of the day
    v[at] += 12
    one = {"entity": "a", "step_ms": 60_000, "counter": False, "per_day": 1440, "blocks": 1, "width": 1440, "ts": t, "seq": np.arange(len(t)), "value": v, "ok": np.ones(len(t), bool), "copies": np.ones(len(t), int), "finite": np.ones(len(t), int), "home": np.ones(len(t), bool)}
    found = lambda: spikes._judge(pd.DataFrame([one])).query("kind == 'spike' and dev >= 8 * spread")["seq"].tolist()
    assert found() == at
    monkeypatch.setattr(spikes, "low_rank", lambda u, *_: np.zeros(len(u)))
    assert found() == []


def test_copies_count_once(spark):
    """Many copies of a row are one reading, and all of them cases with it; more readings than slots are no matter."""
    t, v = readings(3000, 8, 1000)
    v[1500] += 30
    t, v = np.r_[t, np.full(500, t[1500]), np.full(300, t[7])], np.r_[v, np.full(500, v[1500]), np.full(300, v[7])]
    assert flagged(spark, [("a", t, v, False, False)]) == {("spike", "a", i) for i in (1500, *range(3000, 3500))}


def test_copies_and_crowded_sources(spark, monkeypatch):
    """Many copies of a row are one reading; far more readings than slots are split, with the same result."""
    from seriesloom.operators import spikes

    t, v = readings(3000, 8, 1000)
    v[1500] += 30
    t, v = np.r_[t, np.full(500, t[1500]), np.full(300, t[7])], np.r_[v, np.full(500, v[1500]), np.full(300, v[7])]
    want = {("spike", "a", i) for i in (1500, *range(3000, 3500))}
    assert flagged(spark, [("a", t, v, False, False)]) == want
    monkeypatch.setattr(spikes, "CROWDED", 200)
    assert flagged(spark, [("a", t, v, False, False)]) == want


@pytest.mark.parametrize("step", [60_000, 6_000])
def test_gap_at_a_tile_border(spark, step):
    """What stands next to a gap of 200 slots at a border is judged by the readings beyond it; a run goes on across."""
    border = 7 * 1440 if step == 60_000 else -(-14_400 // 29) * 12  # of tiles of 7 days, of blocks of a 29th of a day
    start = 18_519 // 7 * 7 * 86_400_000 if step == 60_000 else 18_519 // 32 * 32 * 86_400_000
    for left, right in ((200, 0), (100, 100), (0, 200)):
        t, v = readings(border + 2500, 7, step, start)
        keep = np.r_[np.arange(border - left), np.arange(border + right, len(t))]
        t, v = t[keep], v[keep]
        edge = border - left
        v[edge - 1] += 12  # the last before the gap
        v[edge + 1] += 12  # the second after it
        want = {("spike", "a", edge - 1), ("spike", "a", edge + 1)}
        assert flagged(spark, [("a", t, v, False, False)], step) == want
        v[edge - 4 : edge + 4] = v[edge - 4]
        assert {f for f in flagged(spark, [("a", t, v, False, False)], step) if f[0] == "run"} == {("run", "a", i) for i in range(edge - 4, edge + 4)}


def test_crowded_tiles_are_split(spark, monkeypatch):
    """No task gets more than about CROWDED readings, no reading is lost, and cases at the parts' borders are found."""
    from seriesloom.operators import spikes

    monkeypatch.setattr(spikes, "CROWDED", 1000)
    monkeypatch.setattr(spikes, "MARGIN", 64)
    t, v = readings(6000, 5, 1000)
    at = (500, 1000, 1499, 2777, 4001)
    for i in at:
        v[i] += 30
    v[2494:2506] = v[2494]
    slow, w = readings(300, 6)
    w[100] += 30
    want = {("spike", "a", i) for i in at} | {("run", "a", i) for i in range(2494, 2506)} | {("spike", "b", 100)}
    assert flagged(spark, [("a", t, v, False, False), ("b", slow, w, False, False)]) == want
    once = spark.createDataFrame([("a", i, int(x), float(y), True, 1, 1, 60_000, False) for i, (x, y) in enumerate(zip(t, v))], "entity string, seq bigint, ts bigint, value double, ok boolean, copies bigint, finite bigint, step_ms bigint, counter boolean")
    got = spikes.tiles(once).select("seq", "home").collect()
    assert len(got) > 5 and max(len(r["seq"]) for r in got) <= 1000
    assert sorted(s for r in got for s, h in zip(r["seq"], r["home"]) if h) == list(range(6000))
