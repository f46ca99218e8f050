"""Irregular readings onto a regular grid, by a Kalman smoother with a continuous-time local linear trend per source.

Model, per source, with time in steps: level' = slope, slope' = white noise of intensity q, reading = level + noise of
variance R. The smoother is exact over a source's whole history, yet no task ever needs more than CHUNK slots of it:
the readings of CHUNK slots are one row, and each such chunk is also summed up as one element (how the state at its
end depends on the state at its start, and what its readings say about the state at its start). Elements are
associative, so running over a source's elements forwards and backwards gives each chunk the filtered state it starts
from and the information of all later readings; then chunks are smoothed independently. A run of FAN elements is summed
up as one element in turn; running over those gives each run what it starts from and what follows it, so a source's
elements spread over tasks. One task gets one element per FAN * CHUNK steps between a source's first and last reading,
which the calendar bounds, not the number of readings. Many chunks advance side by side, slot by slot, in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.robust import group_median, group_spread, row_median, running_median
from ..session import cut

CHUNK, FAN = 1024, 1024
#: Elements that are run over side by side, padded to the longest run among them.
CELLS = 100_000
#: Values of this size and more, such as the largest Float32 of a broken sensor, aren't believed by default.
BELIEVED = 1e15
#: Chunks that advance side by side, and the lags (in readings) whose second differences tell R from q.
LANES, LAGS = 1024, (1, 4)
#: A reading so many spreads off the levels of the HALF readings on either side says nothing about its source's level;
#: it still fills its slot.
OUTLIER, HALF = 12.0, 10
#: Least R and q, and the variance of what is unknown at the start, all against a scale of 1.
LEAST_R, LEAST_Q, UNKNOWN = 1e-6, 1e-9, 1e4

PACKED = "entity string, step_ms bigint, chunk bigint, slot array<int>, at array<double>, value array<double>, n array<int>, total array<int>"
MOMENTS = "entity string, step_ms bigint, weight double, center double, r double, q double, scale double"
KEY = ["entity", "step_ms", "chunk"]
ELEMENT = [f"e{i}" for i in range(14)]
STATE = [f"s{i}" for i in range(10)]
OUT = "entity string, step_ms bigint, first bigint, value array<double>, sd array<double>, total array<int>"


# --- 2 x 2 algebra on tuples of arrays; symmetric matrices are (xx, xy, yy), others (xx, xy, yx, yy)


def _noise(q, d):
    return q * d**3 / 3, q * d**2 / 2, q * d


def _back(eta, j, q, d):
    """Information about the state d later, as information about the state now."""
    q0, q1, q2 = _noise(q, d)
    a, b = 1 + j[0] * q0 + j[1] * q1, j[0] * q1 + j[1] * q2
    c, e = j[1] * q0 + j[2] * q1, 1 + j[1] * q1 + j[2] * q2
    det = a * e - b * c
    m0, m1, m2 = (e * j[0] - b * j[1]) / det, (e * j[1] - b * j[2]) / det, (a * j[2] - c * j[1]) / det
    h0, h1 = (e * eta[0] - b * eta[1]) / det, (a * eta[1] - c * eta[0]) / det
    return (h0, d * h0 + h1), (m0, d * m0 + m1, d * d * m0 + 2 * d * m1 + m2)


def _ahead(m, p, q, d):
    q0, q1, q2 = _noise(q, d)
    return (m[0] + d * m[1], m[1]), (p[0] + 2 * d * p[1] + d * d * p[2] + q0, p[1] + d * p[2] + q1, p[2] + q2)


def _times(x, y):
    return x[0] * y[0] + x[1] * y[2], x[0] * y[1] + x[1] * y[3], x[2] * y[0] + x[3] * y[2], x[2] * y[1] + x[3] * y[3]


def _inverse(x):
    det = x[0] * x[3] - x[1] * x[2]
    return x[3] / det, -x[1] / det, -x[2] / det, x[0] / det


def _of(s):
    return s[0], s[1], s[1], s[2]


def _turned(x):
    return x[0], x[2], x[1], x[3]


def _apply(x, v):
    return x[0] * v[0] + x[1] * v[1], x[2] * v[0] + x[3] * v[1]


def _plus_one(x):
    return 1 + x[0], x[1], x[2], 1 + x[3]


def through(element, m, p):
    """The filtered state at an element's end from that at its start."""
    a, b, c, eta, j = element[0:4], element[4:6], element[6:9], element[9:11], element[11:14]
    gain = _times(a, _inverse(_plus_one(_times(_of(p), _of(j)))))
    pe = _apply(_of(p), eta)
    m2 = _apply(gain, (m[0] + pe[0], m[1] + pe[1]))
    p2 = _times(_times(gain, _of(p)), _turned(a))
    return (m2[0] + b[0], m2[1] + b[1]), (p2[0] + c[0], (p2[1] + p2[2]) / 2 + c[1], p2[3] + c[2])


def before(element, eta_f, j_f):
    """What an element's readings and all later ones say about the state at its start."""
    a, b, c, eta, j = element[0:4], element[4:6], element[6:9], element[9:11], element[11:14]
    k = _times(_turned(a), _inverse(_plus_one(_times(_of(j_f), _of(c)))))
    jb = _apply(_of(j_f), b)
    e2 = _apply(k, (eta_f[0] - jb[0], eta_f[1] - jb[1]))
    j2 = _times(_times(k, _of(j_f)), a)
    return (e2[0] + eta[0], e2[1] + eta[1]), (j2[0] + j[0], (j2[1] + j2[2]) / 2 + j[1], j2[3] + j[2])


class Lanes:
    """Chunks side by side as dense arrays [slot, lane], longest first; a lane's slots run from its own first one."""

    def __init__(self, pdf: pd.DataFrame):
        chunk, first, last = (pdf[c].to_numpy(np.int64) for c in ("chunk", "first", "last"))
        self.start = np.maximum(chunk * CHUNK, first)
        length = np.minimum(chunk * CHUNK + CHUNK - 1, last) - self.start + 1
        self.order = np.argsort(-length, kind="stable")
        self.pdf = pdf.iloc[self.order]
        self.start, self.length = self.start[self.order], length[self.order]
        n = len(pdf)
        self.slots = int(self.length[0])
        self.scale, self.center, self.q, r = (self.pdf[c].to_numpy(float) for c in ("scale", "center", "q", "r"))
        self.y = np.zeros((self.slots, n))
        self.off = np.zeros((self.slots, n))
        self.noise = np.full((self.slots, n), np.inf)
        self.total = np.zeros((self.slots, n), np.int32)
        parts = [(i, s) for i, s in enumerate(self.pdf["slot"]) if s is not None and len(s)]
        if parts:
            lane = np.repeat([i for i, _ in parts], [len(s) for _, s in parts])
            flat = lambda c: np.concatenate([np.asarray(x) for x, s in zip(self.pdf[c], self.pdf["slot"]) if s is not None and len(s)])
            at = flat("slot") + chunk[self.order][lane] * CHUNK - self.start[lane]
            self.total[at, lane] = flat("total")
            used, value, places = flat("n"), flat("value").astype(float), flat("at").astype(float)
            good = (used > 0) & ~np.isnan(value)
            at, lane = at[good], lane[good]
            self.y[at, lane] = (value[good] - self.center[lane]) / self.scale[lane]
            self.off[at, lane] = places[good]
            self.noise[at, lane] = r[lane] / used[good]
        self.active = np.searchsorted(-self.length, -np.arange(self.slots), "left")  # lanes that reach slot i

    def elements(self) -> np.ndarray:
        """One element per lane, as columns."""
        n = len(self.q)
        e = np.zeros((14, n))
        e[0] = e[3] = 1
        for i in range(self.slots):
            k = self.active[i]
            q, d, r = self.q[:k], self.off[i, :k], self.noise[i, :k]
            a0, a1, a2, a3, b0, b1, c0, c1, c2, h0, h1, j0, j1, j2 = e[:, :k]
            q0, q1, q2 = _noise(q, d)
            a0, a1, b0 = a0 + d * a2, a1 + d * a3, b0 + d * b1
            c0, c1, c2 = c0 + 2 * d * c1 + d * d * c2 + q0, c1 + d * c2 + q1, c2 + q2
            s = c0 + r
            off = self.y[i, :k] - b0
            w = 1 / s
            h0, h1 = h0 + a0 * w * off, h1 + a1 * w * off
            j0, j1, j2 = j0 + a0 * a0 * w, j1 + a0 * a1 * w, j2 + a1 * a1 * w
            g0, g1 = c0 * w, c1 * w
            b0, b1 = b0 + g0 * off, b1 + g1 * off
            a2, a3, a0, a1 = a2 - g1 * a0, a3 - g1 * a1, a0 - g0 * a0, a1 - g0 * a1
            c2, c1, c0 = c2 - g1 * c1, c1 - g0 * c1, c0 - g0 * c0
            d = 1 - d
            q0, q1, q2 = _noise(q, d)
            e[:, :k] = (a0 + d * a2, a1 + d * a3, a2, a3, b0 + d * b1, b1, c0 + 2 * d * c1 + d * d * c2 + q0, c1 + d * c2 + q1, c2 + q2, h0, h1, j0, j1, j2)
        return e[:, np.argsort(self.order)]

    def smoothed(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation of the level at every slot's start. state: filtered mean and covariance at the
        lane's start, information of what follows its end."""
        state = state[:, self.order]
        n = len(self.q)
        mean, var = np.empty((self.slots, n)), np.empty((self.slots, n))
        kept = np.empty((5, self.slots, n))
        m, p = tuple(state[0:2]), tuple(state[2:5])
        for i in range(self.slots):
            k = self.active[i]
            m, p = tuple(x[:k] for x in m), tuple(x[:k] for x in p)
            kept[:, i, :k] = (*m, *p)
            q, d = self.q[:k], self.off[i, :k]
            m, p = _ahead(m, p, q, d)
            w = 1 / (p[0] + self.noise[i, :k])
            g0, g1, off = p[0] * w, p[1] * w, self.y[i, :k] - m[0]
            m = (m[0] + g0 * off, m[1] + g1 * off)
            p = (p[0] - g0 * p[0], p[1] - g0 * p[1], p[2] - g1 * p[1])
            m, p = _ahead(m, p, q, 1 - d)
        eta, j = tuple(state[5:7]), tuple(state[7:10])
        k, now_e, now_j = 0, (np.empty(0),) * 2, (np.empty(0),) * 3
        for i in range(self.slots - 1, -1, -1):
            more = self.active[i]
            if more > k:  # lanes that end here join
                now_e = tuple(np.r_[x, s[k:more]] for x, s in zip(now_e, eta))
                now_j = tuple(np.r_[x, s[k:more]] for x, s in zip(now_j, j))
                k = more
            q, d, w = self.q[:k], self.off[i, :k], 1 / self.noise[i, :k]
            now_e, now_j = _back(now_e, now_j, q, 1 - d)
            now_e, now_j = (now_e[0] + self.y[i, :k] * w, now_e[1]), (now_j[0] + w, now_j[1], now_j[2])
            now_e, now_j = _back(now_e, now_j, q, d)
            m0, m1, p0, p1, p2 = kept[:, i, :k]
            a, b, c, e = 1 + p0 * now_j[0] + p1 * now_j[1], p0 * now_j[1] + p1 * now_j[2], p1 * now_j[0] + p2 * now_j[1], 1 + p1 * now_j[1] + p2 * now_j[2]
            det = a * e - b * c
            x, y = m0 + p0 * now_e[0] + p1 * now_e[1], m1 + p1 * now_e[0] + p2 * now_e[1]
            mean[i, :k] = (e * x - b * y) / det
            var[i, :k] = (e * p0 - b * p1) / det
        return mean * self.scale + self.center, np.sqrt(np.maximum(var, 0)) * self.scale


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Up to LANES rows at a time, of similar length."""
    for pdf in batches:
        size = np.minimum(pdf["last"] - pdf["chunk"] * CHUNK, CHUNK) - np.maximum(pdf["first"] - pdf["chunk"] * CHUNK, 0)
        pdf = pdf.iloc[np.argsort(size.to_numpy(), kind="stable")]
        for a in range(0, len(pdf), LANES):
            yield pdf.iloc[a : a + LANES]


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per chunk: center, and R and q from the spread of readings about the line between those k before and after."""
    for pdf in batches:
        sizes = np.array([len(s) for s in pdf["slot"]])
        if not sizes.sum():
            continue
        g = np.repeat(np.arange(len(pdf)), sizes)
        slot, at, v, n = (np.concatenate([np.asarray(x) for x in pdf[c]]).astype(float) for c in ("slot", "at", "value", "n"))
        ok = (n > 0) & ~np.isnan(v)
        g, t, v = g[ok], (slot + at)[ok], v[ok]
        keep = ~outliers(v, g, len(pdf))
        g, t, v = g[keep], t[keep], v[keep]
        center = group_median(v, g, len(pdf))
        spread = group_spread(v - center[g], g, len(pdf))
        both = []
        for k in LAGS:
            if len(v) <= 2 * k:
                both.append((np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)))
                continue
            mid, lo, hi = slice(k, -k), slice(None, -2 * k), slice(2 * k, None)
            same = g[lo] == g[hi]
            d1, d2 = np.maximum(t[mid] - t[lo], 1e-9), np.maximum(t[hi] - t[mid], 1e-9)
            w = d2 / (d1 + d2)
            off = v[mid] - w * v[lo] - (1 - w) * v[hi]
            size = np.sqrt(1 + w * w + (1 - w) ** 2)  # the part of R
            bend = d1 * d1 * d2 * d2 / (3 * (d1 + d2))  # the part of q
            both.append((1.4826 * group_median(np.abs(off / size)[same], g[mid][same], len(pdf)), group_median((bend / size**2)[same], g[mid][same], len(pdf))))
        (s1, g1), (s4, g4) = both
        s4, g4 = np.where(np.isnan(s4), s1, s4), np.where(np.isnan(g4) | (g4 <= g1), g1 + 1, g4)
        q = np.maximum((s4**2 - s1**2) / (g4 - g1), 0)
        r = np.maximum(s1**2 - q * g1, 0.05 * s1**2)
        n = np.bincount(g, minlength=len(pdf))
        yield pd.DataFrame({"entity": pdf["entity"].to_numpy(), "step_ms": pdf["step_ms"].to_numpy(), "weight": n.astype(float), "center": center, "r": r, "q": q, "scale": spread})


def joined(x, y):
    """One element for x and then y."""
    a, b, c, eta, j = x[0:4], x[4:6], x[6:9], x[9:11], x[11:14]
    a2, b2, c2, eta2, j2 = y[0:4], y[4:6], y[6:9], y[9:11], y[11:14]
    gain = _times(a2, _inverse(_plus_one(_times(_of(c), _of(j2)))))
    back = _times(_turned(a), _inverse(_plus_one(_times(_of(j2), _of(c)))))
    ce, jb = _apply(_of(c), eta2), _apply(_of(j2), b)
    mean = _apply(gain, (b[0] + ce[0], b[1] + ce[1]))
    cov = _times(_times(gain, _of(c)), _turned(a2))
    info = _apply(back, (eta2[0] - jb[0], eta2[1] - jb[1]))
    know = _times(_times(back, _of(j2)), a)
    return (*_times(gain, a), mean[0] + b2[0], mean[1] + b2[1], cov[0] + c2[0], (cov[1] + cov[2]) / 2 + c2[1], cov[3] + c2[2], info[0] + eta[0], info[1] + eta[1], know[0] + j[0], (know[1] + know[2]) / 2 + j[1], know[3] + j[2])


def _padded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows of runs of elements with their lengths, longest first, and the elements as [place, part, lane]: as many
    rows at a time as make CELLS elements, so that one long run doesn't pad all others."""
    for pdf in batches:
        sizes = np.array([len(x) for x in pdf["chunks"]], np.int64)
        order = np.argsort(-sizes, kind="stable")
        pdf, sizes = pdf.iloc[order], sizes[order]
        a = 0
        while a < len(sizes):
            b = a + max(1, CELLS // int(sizes[a]))
            part, size = pdf.iloc[a:b], sizes[a:b]
            e = np.zeros((size[0], 14, len(part)))
            for i, c in enumerate(ELEMENT):
                for lane, x in enumerate(part[c]):
                    e[: len(x), i, lane] = x
            yield part, size, e
            a = b


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each run as one element."""
    for pdf, sizes, e in _padded(batches):
        whole = tuple(e[0])
        for k in range(1, sizes[0]):
            n = int((sizes > k).sum())  # longest first: those that go on
            more = joined(tuple(x[:n] for x in whole), tuple(e[k][:, :n]))
            whole = tuple(np.r_[x, y[n:]] for x, y in zip(more, whole))
        yield pd.DataFrame({"entity": pdf["entity"].to_numpy(), "step_ms": pdf["step_ms"].to_numpy(), "chunk": pdf["run"].to_numpy()} | dict(zip(ELEMENT, whole)))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over each run's elements, in order: the state at every chunk's start, the information after its end. A run starts
    from its row's state, from the prior if that is null."""
    for pdf, sizes, e in _padded(batches):
        given = pdf[STATE].to_numpy(float).T
        (m, p), new = prior(len(pdf)), np.isnan(given[2])
        m, p = tuple(np.where(new, x, g) for x, g in zip(m, given[0:2])), tuple(np.where(new, x, g) for x, g in zip(p, given[2:5]))
        state = np.zeros((sizes[0], 10, len(pdf)))
        for k in range(sizes[0]):
            n = int((sizes > k).sum())  # longest first: those that go on
            m, p = tuple(x[:n] for x in m), tuple(x[:n] for x in p)
            state[k, 0:2, :n], state[k, 2:5, :n] = m, p
            m, p = through(e[k][:, :n], m, p)
        h, j = tuple(np.nan_to_num(given[5:7])), tuple(np.nan_to_num(given[7:10]))
        now_h, now_j, n = (np.empty(0),) * 2, (np.empty(0),) * 3, 0
        for k in range(sizes[0] - 1, -1, -1):
            more = int((sizes > k).sum())
            now_h, now_j = (tuple(np.r_[x, y[n:more]] for x, y in zip(now, all_)) for now, all_ in ((now_h, h), (now_j, j)))
            n = more
            state[k, 5:7, :n], state[k, 7:10, :n] = now_h, now_j
            now_h, now_j = before(e[k][:, :n], now_h, now_j)
        live = (np.arange(sizes[0])[:, None] < sizes[None, :]).T
        of = {c: np.repeat(pdf[c].to_numpy(), sizes) for c in ("entity", "step_ms")}
        yield pd.DataFrame(of | {"chunk": np.concatenate([np.asarray(x) for x in pdf["chunks"]])} | {s: state[:, i].T[live] for i, s in enumerate(STATE)})


def _states(made: DataFrame) -> DataFrame:
    """The states of all chunks from their elements (entity, step_ms, chunk, ELEMENT)."""
    columns = lambda cs: ", ".join(f"{c} double" for c in cs)
    run = F.floor(F.col("chunk") / F.lit(FAN)).alias("run")

    def gathered(rows: DataFrame, *by) -> DataFrame:
        listed = rows.groupBy("entity", "step_ms", *by).agg(F.sort_array(F.collect_list(F.struct("chunk", *ELEMENT))).alias("r"))
        return listed.select("entity", "step_ms", *([F.col("run")] if by else []), F.col("r.chunk").alias("chunks"), *(F.col(f"r.{c}").alias(c) for c in ELEMENT))

    out = f"entity string, step_ms bigint, chunk bigint, {columns(STATE)}"
    made = cut(made, "elements")
    runs = gathered(made, run)
    long = made.groupBy("entity", "step_ms").agg(F.min(run).alias("a"), F.max(run).alias("b")).where(F.col("a") < F.col("b"))
    if long.isEmpty():
        return runs.select("*", *(F.lit(None).cast("double").alias(c) for c in STATE)).mapInPandas(_scan, out)
    whole = runs.join(long, ["entity", "step_ms"], "left_semi").mapInPandas(_fold, f"entity string, step_ms bigint, chunk bigint, {columns(ELEMENT)}")
    starts = gathered(whole).select("*", *(F.lit(None).cast("double").alias(c) for c in STATE)).mapInPandas(_scan, out)
    return runs.join(starts.withColumnRenamed("chunk", "run"), ["entity", "step_ms", "run"], "left").mapInPandas(_scan, out)


def prior(n: int):
    """Level and slope before any reading: nothing is known, on a scale of 1."""
    return (np.zeros(n), np.zeros(n)), (np.full(n, UNKNOWN), np.zeros(n), np.full(n, UNKNOWN))


def regular(rows: DataFrame, believed: float = BELIEVED) -> DataFrame:
    """(entity, slot_ts, value, sd, n_readings, missing): one row per source and step from its first to its last
    reading; value is the smoothed level at slot_ts with its standard deviation, missing says that the slot has none.

    rows: entity (text), ts (ms), value, step_ms and usable (false: the reading fills its slot, but its value is not
    believed). A slot's readings are averaged, repeats as often as they occur, at their mean time. Rows with a null
    entity, ts, value or step, a step of 0 or less or a non-finite value are left out. Values of `believed` and more in
    size count as not usable; it may be raised up to 1e150, beyond which squares are no doubles. A source none of whose values is usable gets null values; one with several steps has a
    grid for each. One reading gives one slot. No rows, no result."""
    v = F.col("value").cast("double")
    live = rows.where(F.col("entity").isNotNull() & F.col("ts").isNotNull() & v.isNotNull() & (F.col("step_ms") > 0) & ~F.isnan(v) & (F.abs(v) < float("inf")))
    slot = F.floor(F.col("ts") / F.col("step_ms"))
    good = F.coalesce("usable", F.lit(True)) & (F.abs(v) < min(believed, 1e150))
    share = (F.col("ts") - slot * F.col("step_ms")) / F.col("step_ms")
    slots = live.groupBy("entity", F.col("step_ms").cast("bigint").alias("step_ms"), F.floor(slot / F.lit(CHUNK)).alias("chunk"), F.pmod(slot, F.lit(CHUNK)).cast("int").alias("slot")).agg(
        F.avg(F.when(good, share)).alias("at"), F.avg(F.when(good, v)).alias("value"), F.count(F.when(good, 1)).cast("int").alias("n"), F.count(F.lit(1)).cast("int").alias("total")
    )
    inner = ("slot", "at", "value", "n", "total")
    packed = cut(slots.groupBy("entity", "step_ms", "chunk").agg(F.sort_array(F.collect_list(F.struct(*inner))).alias("r")).select("entity", "step_ms", "chunk", *(F.col(f"r.{c}").alias(c) for c in inner)), "chunks")
    span = packed.groupBy("entity", "step_ms").agg(F.min(F.col("chunk") * CHUNK + F.element_at("slot", 1)).alias("first"), F.max(F.col("chunk") * CHUNK + F.element_at("slot", -1)).alias("last"))
    share_of = lambda c: F.sum(F.col(c) * F.col("weight")) / F.sum("weight")
    moments = packed.select("entity", "step_ms", "slot", "at", "value", "n").mapInPandas(_moments, MOMENTS).where((F.col("weight") > 0) & F.col("center").isNotNull() & ~F.isnan("center"))
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    fitted = moments.groupBy("entity", "step_ms").agg(share_of("center").alias("center"), F.coalesce(F.sum(zero("r") * F.col("weight")) / F.sum("weight"), F.lit(0.0)).alias("r"), F.coalesce(F.sum(zero("q") * F.col("weight")) / F.sum("weight"), F.lit(0.0)).alias("q"), F.max(zero("scale")).alias("spread"))
    scale = F.greatest(F.col("spread"), F.sqrt("r"), F.abs("center") * 1e-9, F.lit(1e-9))
    params = span.join(fitted, ["entity", "step_ms"], "left").select(
        "entity", "step_ms", "first", "last", F.coalesce("center", F.lit(0.0)).alias("center"), F.coalesce(scale, F.lit(1.0)).alias("scale"),
        F.coalesce(F.greatest(F.col("r") / (scale * scale), F.lit(LEAST_R)), F.lit(1.0)).alias("r"), F.coalesce(F.greatest(F.col("q") / (scale * scale), F.lit(LEAST_Q)), F.lit(1.0)).alias("q"), F.col("center").isNotNull().alias("known"),
    )
    chunks = params.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / F.lit(CHUNK)), F.floor(F.col("last") / F.lit(CHUNK)))))
    # Outliers are taken out where chunks are packed for smoothing, judged with the readings next to the chunk.
    full = cut(chunks.join(packed, KEY, "left").join(_beside(packed), KEY, "left"), "grid")

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            e = Lanes(gated(pdf)).elements()
            yield pd.DataFrame({c: pdf[c].to_numpy() for c in KEY} | {c: e[i] for i, c in enumerate(ELEMENT)})

    several = full.where(F.floor(F.col("first") / F.lit(CHUNK)) < F.floor(F.col("last") / F.lit(CHUNK)))
    states = _states(several.mapInPandas(elements, "entity string, step_ms bigint, chunk bigint, " + ", ".join(f"{c} double" for c in ELEMENT)))

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            lanes = Lanes(gated(pdf))
            state = pdf[STATE].to_numpy(float).T
            m, p = prior(len(pdf))
            alone = np.isnan(state[2])
            state = np.where(alone, np.vstack([*m, *p, np.zeros((5, len(pdf)))]), state)
            mean, sd = lanes.smoothed(state)
            known = lanes.pdf["known"].to_numpy(bool)
            cutoff = lanes.length
            yield pd.DataFrame({"entity": lanes.pdf["entity"].to_numpy(), "step_ms": lanes.pdf["step_ms"].to_numpy(), "first": lanes.start, "value": [mean[:n, i] if known[i] else np.full(n, np.nan) for i, n in enumerate(cutoff)], "sd": [sd[:n, i] if known[i] else np.full(n, np.nan) for i, n in enumerate(cutoff)], "total": [lanes.total[:n, i] for i, n in enumerate(cutoff)]})

    done = full.join(states, KEY, "left").mapInPandas(smooth, OUT)
    cells = done.select("entity", "step_ms", "first", F.posexplode(F.arrays_zip("value", "sd", "total")).alias("i", "c"))
    real = lambda c: F.when(~F.isnan(F.col(f"c.{c}")), F.col(f"c.{c}"))
    return cells.select("entity", ((F.col("first") + F.col("i")) * F.col("step_ms")).alias("slot_ts"), real("value").alias("value"), real("sd").alias("sd"), F.col("c.total").alias("n_readings"), (F.col("c.total") == 0).alias("missing"))


def _beside(packed: DataFrame) -> DataFrame:
    """(entity, step_ms, chunk, before, after): the HALF values before and after each chunk with any, however far
    away."""
    values = packed.select(*KEY, F.filter("value", lambda x: x.isNotNull()).alias("v")).where(F.size("v") > 0)
    ends = values.select(*KEY, F.slice("v", 1, HALF).alias("head"), F.slice("v", F.greatest(F.lit(1), F.size("v") - (HALF - 1)), HALF).alias("tail"))
    by = Window.partitionBy("entity", "step_ms").orderBy("chunk")
    near = ends.select(*KEY, F.flatten(F.collect_list("tail").over(by.rowsBetween(-HALF, -1))).alias("b"), F.flatten(F.collect_list("head").over(by.rowsBetween(1, HALF))).alias("a"))
    return near.select(*KEY, F.slice("b", F.greatest(F.lit(1), F.size("b") - (HALF - 1)), HALF).alias("before"), F.slice("a", 1, HALF).alias("after"))


def outliers(v: np.ndarray, g: np.ndarray, count: int) -> np.ndarray:
    """Which values lie OUTLIER units beyond the levels on both sides. v: values in order of time within their groups g.

    A side's level reaches from the median of its HALF values to where their usual step takes it by the time of the
    value, so that a trend, its ends and a restart are no outliers. A unit is the spread about the running median, or
    the usual size of a change if that is more, as in series that hold their value or grow evenly; single values
    between two equal ones don't count as changes."""
    off = v - running_median(v, g, HALF)
    size = np.abs(np.r_[np.nan, np.diff(v)]) if len(v) else v
    size[1:][(g[1:] != g[:-1])] = np.nan
    lone = 1 + np.flatnonzero((g[2:] == g[:-2]) & (v[2:] == v[:-2]) & (v[1:-1] != v[:-2]))
    size[lone] = size[lone + 1] = np.nan
    usual = np.nan_to_num(group_median(np.where(size > 0, size, np.nan), g, count))
    limit = OUTLIER * np.maximum(np.maximum(group_spread(off, g, count), usual), 1e-12)
    out = np.abs(off) > limit[g]
    c = np.flatnonzero(out)
    if not len(c):
        return out
    low, high = np.full(len(c), np.nan), np.full(len(c), np.nan)
    for way in (-1, 1):
        at = c[:, None] + way * np.arange(1, HALF + 1)
        inside = (at >= 0) & (at < len(v))
        at = np.clip(at, 0, len(v) - 1)
        w = np.where(inside & (g[at] == g[c][:, None]), v[at], np.nan)
        level = row_median(w)
        reached = level + row_median(w[:, :-1] - w[:, 1:]) * ((~np.isnan(w)).sum(1) + 1) / 2
        low, high = np.fmin(low, np.fmin(level, reached)), np.fmax(high, np.fmax(level, reached))
    with np.errstate(invalid="ignore"):
        out[c] = np.maximum(v[c] - high, low - v[c]) > limit[g[c]]
    return out


def gated(pdf: pd.DataFrame) -> pd.DataFrame:
    """The same rows without the values that are outliers."""
    pdf = pdf.copy()
    some = np.flatnonzero([x is not None and len(x) > 0 for x in pdf["slot"]])
    if len(some):
        near = [[np.zeros(0) if x is None else np.asarray(x, float) for x in pdf[c].iloc[some]] for c in ("before", "value", "after")]
        lengths = np.array([[len(x) for x in part] for part in near]).T
        v = np.concatenate([x for row in zip(*near) for x in row])
        g = np.repeat(np.arange(len(some)), lengths.sum(1))
        ok = np.flatnonzero(~np.isnan(v))
        v[ok[outliers(v[ok], g[ok], len(some))]] = np.nan
        parts = np.split(v, np.cumsum(lengths.ravel())[:-1])[1::3]
        column = pdf["value"].to_numpy(object).copy()
        for i, x in zip(some, parts):
            column[i] = x
        pdf["value"] = column
    return pdf
