"""The smoother against a dense solution of the same model."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from seriesloom.operators import grid


def dense(first, last, t, y, noise, q, step_start):
    """Means and deviations of the level at slot starts by solving the whole Gaussian at once."""
    times = np.unique(np.concatenate([np.arange(first, last + 1, dtype=float), t]))
    n = len(times)
    lam = np.zeros((2 * n, 2 * n))
    eta = np.zeros(2 * n)
    lam[:2, :2] += np.eye(2) / grid.UNKNOWN
    for k in range(1, n):
        d = times[k] - times[k - 1]
        f = np.array([[1, d], [0, 1]])
        w = np.linalg.inv(q * np.array([[d**3 / 3, d**2 / 2], [d**2 / 2, d]]))
        i, j = slice(2 * k - 2, 2 * k), slice(2 * k, 2 * k + 2)
        lam[i, i] += f.T @ w @ f
        lam[i, j] -= f.T @ w
        lam[j, i] -= w @ f
        lam[j, j] += w
    for a, b, r in zip(t, y, noise):
        k = 2 * int(np.searchsorted(times, a))
        lam[k, k] += 1 / r
        eta[k] += b / r
    cov = np.linalg.inv(lam)
    mean = cov @ eta
    at = 2 * np.searchsorted(times, step_start)
    return mean[at], np.sqrt(np.diag(cov)[at])


@pytest.mark.parametrize("chunk", [4, 7, 1024])
def test_exact_over_chunks(monkeypatch, chunk):
    monkeypatch.setattr(grid, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    first, last = 11, 52
    slots = np.array([11, 12, 13, 15, 16, 20, 21, 40, 41, 45, 46, 50, 51, 52])  # a gap longer than a chunk
    at = rng.uniform(0, 0.99, len(slots)).round(3)
    at[0], at[3] = 0, 0
    y, n = rng.normal(0, 1, len(slots)).cumsum(), rng.integers(1, 4, len(slots))
    q, r = 0.02, 0.3
    rows = []
    for c in range(first // chunk, last // chunk + 1):
        m = slots // chunk == c
        rows.append({"entity": "a", "step_ms": 1, "chunk": c, "first": first, "last": last, "slot": slots[m] % chunk, "at": at[m], "value": y[m], "n": n[m], "total": n[m], "center": 0.0, "scale": 1.0, "q": q, "r": r, "known": True})
    pdf = pd.DataFrame(rows)
    lanes = grid.Lanes(pdf)
    e = lanes.elements()
    runs = pd.DataFrame({"entity": ["a"], "step_ms": [1], "chunks": [pdf["chunk"].tolist()]} | {c: [e[i].tolist()] for i, c in enumerate(grid.ELEMENT)} | dict.fromkeys(grid.STATE, np.nan))
    states = next(grid._scan(iter([runs])))
    mean, sd = lanes.smoothed(states[grid.STATE].to_numpy(float).T)
    got_m, got_s = np.zeros(last - first + 1), np.zeros(last - first + 1)
    for i, (s, k) in enumerate(zip(lanes.start, lanes.length)):
        got_m[s - first : s - first + k], got_s[s - first : s - first + k] = mean[:k, i], sd[:k, i]
    want_m, want_s = dense(first, last, slots + at, y, r / n, q, np.arange(first, last + 1))
    assert np.allclose(got_m, want_m, atol=1e-6) and np.allclose(got_s, want_s, atol=1e-6)


ROWS = "entity string, ts bigint, value double, step_ms bigint, usable boolean, extra string"


def run(spark, rows):
    return sorted((tuple(r) for r in grid.regular(spark.createDataFrame(rows, ROWS)).collect()), key=lambda r: (r[0], r[1]))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1000, 1.0, 100, True, "x"), ("a", 1000, 1.0, 100, True, "x"), ("a", 1310, 2.0, 100, None, None), ("a", 1250, 3e38, 100, True, None), ("b", 50, 5.0, 100, True, None), ("c", 0, 1.0, 100, False, None), ("c", 200, 1.0, 100, False, None)]
    rows += [(None, 1, 1.0, 100, True, ""), ("a", None, 1.0, 100, True, ""), ("a", 9999, None, 100, True, ""), ("a", 9999, nan, 100, True, ""), ("a", 9999, inf, 100, True, ""), ("a", 9999, 1.0, None, True, ""), ("d", 1, 1.0, 0, True, "")]
    got = run(spark, rows)
    assert [(r[0], r[1], r[4], r[5]) for r in got] == [("a", 1000, 2, False), ("a", 1100, 0, True), ("a", 1200, 1, False), ("a", 1300, 1, False), ("b", 0, 1, False), ("c", 0, 1, False), ("c", 100, 0, True), ("c", 200, 1, False)]
    assert got[0][2] == pytest.approx(1, abs=0.2) and got[3][2] == pytest.approx(2, abs=0.2) and got[4][2] == pytest.approx(5)
    assert all(r[2] is None and r[3] is None for r in got if r[0] == "c")
    assert run(spark, []) == []
    large = [("a", 100 * i, 1e20 + 1e17 * i, 100, True, None) for i in range(30)]
    assert all(r[2] is None for r in run(spark, large))
    believed = grid.regular(spark.createDataFrame(large, ROWS), believed=1e30).collect()
    assert all(r["value"] == pytest.approx(1e20 + 1e15 * r["slot_ts"], rel=1e-3) for r in believed)


def test_fills_and_uncertainty(spark):
    """A noisy slow wave with holes: filled values near the truth, within their uncertainty, which grows in holes."""
    rng = np.random.default_rng(1)
    t = np.sort(rng.choice(3000, 2200, replace=False)) * 1000
    t = t[(t < 700_000) | (t > 760_000)]
    wave = lambda x: 100 + 10 * np.sin(x / 200_000)
    y = wave(t) + rng.normal(0, 0.5, len(t))
    y[100] += 500
    got = pd.DataFrame(run(spark, [("a", int(a), float(b), 1000, True, None) for a, b in zip(t, y)]), columns=["e", "ts", "v", "sd", "n", "missing"])
    assert got["missing"].sum() == len(got) - len(t) and (got["n"] > 0).sum() == len(t)
    err = (got["v"] - wave(got["ts"])).abs()
    assert err.median() < 0.3 and err[got["missing"]].median() < 0.3 and err.max() < 3
    assert (err <= 3 * got["sd"]).mean() > 0.95
    assert got["sd"][(got["ts"] > 725_000) & (got["ts"] < 735_000)].min() > 1.2 * got["sd"].median()


def kept(v, before=(), after=()):
    v = np.asarray(v, float)
    pdf = pd.DataFrame([{"slot": np.arange(len(v)), "value": v, "before": np.asarray(before, float), "after": np.asarray(after, float)}])
    return ~np.isnan(grid.gated(pdf)["value"].iloc[0])


def test_gate_keeps_trends_restarts_and_holds():
    """Only what lies off both sides is an outlier, in series whose spread about the running median is 0 as well."""
    rng = np.random.default_rng(2)
    even = 3.0 * np.arange(1044)
    for up in (even, np.cumsum(rng.integers(1, 9, 1044)).astype(float)):
        up[500:] -= up[500]  # a restart
        assert kept(up[10:-10], up[:10], up[-10:]).all() and kept(up).all()
        up[300] += 900
        assert np.flatnonzero(~kept(up)).tolist() == [300]
    held = np.full(1000, 20.0)
    for a, n in ((100, 2), (300, 3), (500, 7), (700, 40)):
        held[a : a + n] += 5
    assert kept(held).all()
    held[900] = 900
    assert np.flatnonzero(~kept(held)).tolist() == [900]
    flat = np.full(1000, 7.0)
    flat[[400, 600]] = 500, 90
    assert np.flatnonzero(~kept(flat)).tolist() == [400, 600]
    noisy = rng.normal(0, 1, 1000)
    noisy[600:605] += 100
    noisy[0] = 100
    assert np.flatnonzero(~kept(noisy)).tolist() == [0, 600, 601, 602, 603, 604]
    assert kept(noisy, [100] * 10)[0]


def test_level_change_at_a_chunk_edge(spark):
    """The last slots of a chunk are judged with the first readings after it, however far away and of whatever chunk."""
    v = np.where(np.arange(1100) < 1020, 10.0, 20.0) + np.random.default_rng(6).normal(0, 0.05, 1100)
    assert kept(v[:1024], [], v[1024:1034]).all()
    chunks = [("a", 0, [1.0, None, *map(float, range(2, 30))]), ("a", 1, [None]), ("a", 7, [50.0, 51.0]), ("a", 8, [float(x) for x in range(60, 80)]), ("b", 0, [5.0])]
    got = {(r["entity"], r["chunk"]): (r["before"], r["after"]) for r in grid._beside(spark.createDataFrame(chunks, "entity string, chunk bigint, value array<double>").withColumn("step_ms", F.lit(1))).collect()}
    late = [float(x) for x in range(20, 30)]
    assert got == {("a", 0): ([], [50.0, 51.0, *map(float, range(60, 68))]), ("a", 7): (late, [float(x) for x in range(60, 70)]), ("a", 8): (late[2:] + [50.0, 51.0], []), ("b", 0): ([], [])}


def test_runs_of_elements_dont_matter(spark, monkeypatch):
    """A source summed up in many short runs gives the values of one run; two steps of a source are grids of their own."""
    rng = np.random.default_rng(5)
    rows = [("a", int(t), float(v), 1, True, None) for t, v in zip(np.sort(rng.choice(15_000, 900, replace=False)), rng.normal(0, 1, 900).cumsum())]
    rows += [("b", int(t), float(t % 7), 10, True, None) for t in range(0, 400, 3)] + [("a", int(t), 5.0, 7, True, None) for t in range(50, 3000, 7)]
    want = run(spark, rows)
    monkeypatch.setattr(grid, "FAN", 3)
    got = run(spark, rows)
    assert [r[:2] + r[4:] for r in got] == [r[:2] + r[4:] for r in want] and len(got) > 15_000
    assert np.allclose([r[2:4] for r in got], [r[2:4] for r in want], atol=1e-6)
    assert sum(r[2] == pytest.approx(5, abs=1e-3) for r in got if r[0] == "a" and r[1] % 7 == 0) >= 422


def test_one_long_source_among_short_ones():
    """Runs are padded to the longest of their block only."""
    rng = np.random.default_rng(0)
    sizes = np.r_[5000, np.full(9999, 2)]
    lanes = [rng.uniform(0.1, 0.9, n) for n in sizes]
    runs = pd.DataFrame({"entity": np.arange(len(sizes)).astype(str), "step_ms": 1, "chunks": [np.arange(n) for n in sizes]} | {c: lanes for c in grid.ELEMENT} | dict.fromkeys(grid.STATE, np.nan))
    tracemalloc.start()
    with np.errstate(all="ignore"):
        got = [len(x) for x in grid._scan(iter([runs]))]
    assert sum(got) == sizes.sum() and tracemalloc.get_traced_memory()[1] < 2e8
    tracemalloc.stop()
