"""Implausible readings: values out of range, spikes, and stuck runs, judged per source.

Spikes: each source's readings form daily profile matrices, a row per UTC day and a column per slot of the day, of the
readings less their day's level, in units of the source's spread. Robust principal components split a matrix into a
low-rank part, the source's normal behaviour on these days, and a sparse part. Short stretches of the sparse part are
candidates, long ones changes of behaviour; an exact check then compares the candidates with the levels of the
unaffected readings on both sides. What isn't sparse is no candidate, whatever its surroundings.

A source's days are cut into tiles of bounded size, some days times some slots of the day, with a margin of HALO slots
on either side so that levels, bursts and runs are seen whole; where a margin holds few readings, as after a gap, the
nearest NEAR ones beyond it are carried over, whatever their distance. Tiles with far more readings than slots are
split by time, with margins counted in readings. So no task gets a whole source, however long or dense. The source's spread is
put together from its tiles'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.robust import group_median, group_spread, offsets, row_median, running_median, windows
from ..session import cut

DAY_MS = 86_400_000
#: Slots of a tile: whole days of up to WIDE slots, as many days as come to SLOTS; longer days in blocks of up to
#: COLUMNS slots over LONG_DAYS days.
WIDE, SLOTS, COLUMNS, LONG_DAYS, HALO = 1536, 4096, 512, 32, 64
#: A candidate's sparse part is at least so many spreads; an exact hit deviates by SPIKE spreads, of a counter by
#: JUMP usual increases, and is one of at most BURST successive such readings.
CANDIDATE, SPIKE, JUMP, BURST = 4.0, 8.0, 20.0, 5
RUN, FEWEST = 8, 40
#: Readings on either side that make the level.
SIDE, HALF = 5, 10
#: Cells of the matrices that are worked on at a time.
CELLS = 1_000_000
#: Turns of the split into low-rank and sparse part; values further off than MOST spreads count as that far.
TURNS, MOST = 6, 1e12
#: A tile of more readings is split into parts of about half as many, at whole spans of SPAN_MS, with a margin of at
#: least MARGIN readings.
CROWDED, SPAN_MS, MARGIN = 65_536, 1000, 256
#: Readings that a margin should have.
NEAR = 10

FLAGS = "entity string, seq bigint, ts bigint, value double, kind string, dev double, spread double, n bigint"


def _laid(rows: DataFrame) -> DataFrame:
    """rows with the size of their tiles, and `home`, the tile that each is in."""
    per_day = F.greatest(F.lit(1), F.round(F.lit(DAY_MS) / F.col("step_ms")).cast("bigint"))
    wide = F.col("per_day") > WIDE
    blocks = F.when(wide, F.ceil(F.col("per_day") / F.lit(COLUMNS))).otherwise(F.lit(1)).cast("bigint")
    days = F.when(wide, F.lit(LONG_DAYS)).otherwise(F.greatest(F.lit(7), F.floor(F.lit(SLOTS) / F.col("per_day")))).cast("bigint")
    sized = rows.withColumn("per_day", per_day).withColumn("blocks", blocks).withColumn("days", days)
    placed = sized.withColumn("width", F.ceil(F.col("per_day") / F.col("blocks")).cast("bigint")).withColumn("slot", F.floor(F.col("ts") / F.col("step_ms")))
    return placed.withColumn("home", _tile(F.col("slot")))


def _tile(slot: Column) -> Column:
    day = F.floor(slot / F.col("per_day"))
    return F.struct(F.floor(day / F.col("days")).alias("db"), F.floor((slot - day * F.col("per_day")) / F.col("width")).alias("cb"))


def _piece(slot: Column) -> Column:
    """Number of the stretch of time that a tile has around a slot: all of its days, or its block of one day."""
    day = F.floor(slot / F.col("per_day"))
    return F.when(F.col("blocks") == 1, F.floor(day / F.col("days"))).otherwise(day * F.col("blocks") + F.floor((slot - day * F.col("per_day")) / F.col("width")))


def _placed(laid: DataFrame) -> DataFrame:
    """Laid rows in each tile `t` that they belong to (own) or are in the margin of."""
    each = F.explode(F.array_distinct(F.array(F.col("home"), _tile(F.col("slot") - HALO), _tile(F.col("slot") + HALO))))
    return laid.withColumn("t", each).withColumn("own", F.col("t") == F.col("home"))


LAYOUT = ("entity", "step_ms", "per_day", "blocks", "days", "width")


def _counted(laid: DataFrame) -> DataFrame:
    """Per source and piece: rows in it, in its margin before and in that after."""
    piece = _piece(F.col("slot"))
    each = F.array(F.struct(piece.alias("p"), F.lit(0).alias("side")), *(F.when(_piece(F.col("slot") - side * HALO) != piece, F.struct(_piece(F.col("slot") - side * HALO).alias("p"), F.lit(side).alias("side"))) for side in (-1, 1)))
    rows = laid.select(*LAYOUT, F.explode(F.array_compact(each)).alias("e")).select(*LAYOUT, "e.*")
    side = lambda x: F.count(F.when(F.col("side") == x, 1))
    return rows.groupBy(*LAYOUT, "p").agg(side(0).alias("n"), side(-1).alias("before"), side(1).alias("after"))


def _carried(laid: DataFrame, pieces: DataFrame) -> DataFrame | None:
    """Rows for the tiles of pieces with few readings in a margin: the NEAR nearest ones of the next piece with any on
    that side, brought up to the margin. pieces: as of _counted, a table."""
    by = Window.partitionBy("entity", "step_ms").orderBy("p")
    with_any = pieces.where(F.col("n") > 0)
    sides = with_any.select(*LAYOUT, "p", "before", "after", F.lag("p").over(by).alias("last"), F.lead("p").over(by).alias("next"))
    lack = lambda n, there: F.when((F.col(n) < NEAR) & F.col(there).isNotNull(), F.struct(F.col(there).alias("source"), F.lit(-1 if n == "before" else 1).alias("side")))
    wanted = cut(sides.select("entity", "step_ms", "p", F.explode(F.array_compact(F.array(lack("before", "last"), lack("after", "next")))).alias("e")).select("entity", "step_ms", "p", "e.*"), "wanted")
    if wanted.isEmpty():
        return None
    rows = laid.withColumn("source", _piece(F.col("slot"))).join(wanted, ["entity", "step_ms", "source"])
    nearest = Window.partitionBy("entity", "step_ms", "p", "side").orderBy(F.col("side") * F.col("ts"))
    rows = rows.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= NEAR)
    day = F.floor(F.col("p") / F.col("blocks"))
    block = F.col("p") - day * F.col("blocks")
    one = F.col("blocks") == 1
    first = F.when(one, F.col("p") * F.col("days") * F.col("per_day")).otherwise(day * F.col("per_day") + block * F.col("width"))
    end = F.when(one, (F.col("p") + 1) * F.col("days") * F.col("per_day")).otherwise(day * F.col("per_day") + F.least((block + 1) * F.col("width"), F.col("per_day")))
    slot = F.when(F.col("side") < 0, first - HALO - F.col("rank")).otherwise(end + HALO - 1 + F.col("rank"))
    tile = F.struct(F.when(one, F.col("p")).otherwise(F.floor(day / F.col("days"))).alias("db"), F.when(one, F.lit(0)).otherwise(block).cast("bigint").alias("cb"))
    return rows.withColumn("t", tile).withColumn("own", F.lit(False)).withColumn("slot", slot).withColumn("ts", slot * F.col("step_ms")).drop("source", "p", "side", "rank")


def _split(placed: DataFrame) -> DataFrame:
    """placed, of crowded tiles only, with the parts of its tile that each reading belongs to or is in the margin of.
    Slots are of about one reading; a part of less than two days is one row (per_day 0)."""
    heavy = cut(placed.withColumn("span", F.floor(F.col("ts") / F.lit(SPAN_MS))), "crowded")
    tile, part = Window.partitionBy("entity", "t"), Window.partitionBy("entity", "t", "p")
    spans = heavy.groupBy("entity", "t", "span").agg(F.count(F.lit(1)).alias("n"))
    spans = spans.withColumn("upto", F.sum("n").over(tile.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.withColumn("from", F.col("upto") - F.col("n")).withColumn("p", F.dense_rank().over(tile.orderBy(F.floor(F.col("from") / F.lit(max(1, CROWDED // 2))))).cast("bigint"))
    spans = spans.withColumn("begin", F.min("from").over(part)).withColumn("end", F.max("upto").over(part))
    length = ((F.max("span") - F.min("span") + 1) * SPAN_MS).alias("length")
    sizes = spans.groupBy("entity", "t", "p").agg(length, F.sum("n").alias("n")).select("entity", "t", F.col("p").alias("part"), F.greatest(F.lit(1), F.floor(F.col("length") / F.col("n"))).alias("fine"), (F.col("length") >= 2 * DAY_MS).alias("long"))
    near = F.array("p", F.when(F.col("from") < F.col("begin") + MARGIN, F.col("p") - 1), F.when(F.col("upto") > F.col("end") - MARGIN, F.col("p") + 1))
    parts = spans.select("entity", "t", "span", "p", F.explode(near).alias("part")).join(sizes, ["entity", "t", "part"])
    per_day = F.when(F.col("long"), F.round(F.lit(DAY_MS) / F.col("fine"))).otherwise(0).cast("bigint")
    split = heavy.join(parts, ["entity", "t", "span"]).withColumn("own", F.col("own") & (F.col("p") == F.col("part")))
    return split.withColumn("step_ms", F.col("fine")).withColumn("per_day", per_day).withColumn("blocks", F.lit(1).cast("bigint")).withColumn("width", F.greatest(F.lit(1), "per_day")).select(*TILED)


TILED = ("entity", "seq", "ts", "value", "ok", "copies", "finite", "step_ms", "counter", "per_day", "blocks", "width", "t", "part", "own")


def tiles(rows: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """rows (entity, seq, ts, value, ok, copies, finite, step_ms, counter) to one row per tile, with the readings in
    arrays. counted: rows, or what they were made from, to find crowded tiles by. Only the readings of those move once
    more."""
    laid = _laid(rows)
    pieces = cut(_counted(laid if counted is None else _laid(counted)), "pieces")
    placed, carried = _placed(laid), _carried(laid, pieces)
    if carried is not None:
        placed = placed.unionByName(carried)
    day = F.when(F.col("blocks") == 1, F.col("p") * F.col("days")).otherwise(F.floor(F.col("p") / F.col("blocks")))
    t = F.struct(F.floor(day / F.col("days")).alias("db"), F.when(F.col("blocks") == 1, 0).otherwise(F.col("p") - day * F.col("blocks")).cast("bigint").alias("cb"))
    many = cut(pieces.groupBy("entity", t.alias("t")).agg(F.sum(F.col("n") + F.col("before") + F.col("after")).alias("n")).where(F.col("n") > CROWDED).select("entity", "t"), "many")
    usual = placed.withColumn("part", F.lit(0).cast("bigint"))
    if not many.isEmpty():
        crowded = F.broadcast(many)  # at most a row for every CROWDED readings
        usual = usual.join(crowded, ["entity", "t"], "left_anti").select(*TILED).unionByName(_split(placed.join(crowded, ["entity", "t"], "left_semi")))
    reading = F.struct("ts", "seq", "value", "ok", "copies", "finite", F.col("own").alias("home"))
    return usual.groupBy("entity", "step_ms", "counter", "per_day", "blocks", "width", "t", "part").agg(F.collect_list(reading).alias("r")).select(
        "entity", "step_ms", "counter", "per_day", "blocks", "width", *(F.col(f"r.{c}").alias(c) for c in ("ts", "seq", "value", "ok", "copies", "finite", "home"))
    ).where(F.array_contains("home", True))


def _held_over(x: np.ndarray) -> np.ndarray:
    """x with each NaN replaced by what stands before it in its row, else by 0."""
    at = np.where(np.isnan(x), 0, np.arange(1, x.shape[-1] + 1))
    at = np.maximum.accumulate(at, axis=-1)
    return np.where(at > 0, np.take_along_axis(x, np.maximum(at - 1, 0), -1), 0.0)


def low_rank(u: np.ndarray, dev: np.ndarray, tile: np.ndarray, row: np.ndarray, col: np.ndarray, count: int) -> np.ndarray:
    """The low-rank part at each reading. u: values less their day's level, and dev: deviations from the running
    median, both in spreads; row and col: day and slot within its tile.

    The search for it starts with the running median and, where there are three days or more, the median over the days
    of the deviations from it; what is CANDIDATE or more off that is sparse. Then in turn: singular values of the rest
    beyond what noise gives make the low-rank part, and the sparse part is taken again. Sparse and unseen cells are
    filled from the low-rank part."""
    out = np.zeros(len(u))
    rows = np.zeros(count, np.int64)
    cols = np.zeros(count, np.int64)
    np.maximum.at(rows, tile, row + 1)
    np.maximum.at(cols, tile, col + 1)
    start = offsets(tile)
    of = tile[start[:-1]]
    order = np.argsort(rows[of] * 100_000 + cols[of], kind="stable")
    at = 0
    while at < len(order):
        r = rows[of[order[at:]]]
        c = np.maximum.accumulate(cols[of[order[at:]]])
        size = (np.arange(len(r)) + 1) * r * c
        take = max(1, int(np.searchsorted((size > CELLS) | (r != r[0]), True)))
        some = order[at : at + take]
        at += take
        n, k, m = len(some), int(r[0]), int(cols[of[some]].max())
        idx = np.concatenate([np.arange(start[i], start[i + 1]) for i in some])
        lane = np.repeat(np.arange(n), start[some + 1] - start[some])
        place = lane, row[idx], col[idx]
        x, d = np.full((n, k, m), np.nan), np.full((n, k, m), np.nan)
        x[place], d[place] = u[idx], dev[idx]
        seen = ~np.isnan(x)
        noise = 1.1 * (np.sqrt(k) + np.sqrt(np.maximum(1, seen.any(1).sum(1))))
        low = _held_over(x - d)
        if k >= 3:
            w = row_median(d.transpose(0, 2, 1).reshape(n * m, k)).reshape(n, 1, m)
            low = low + np.where(seen.sum(1, keepdims=True) >= 3, np.nan_to_num(w), 0.0)
        for _ in range(TURNS):
            rest = np.where(seen, x, low)
            clean = np.where(np.abs(rest - low) >= CANDIDATE, low, rest)
            # Products by einsum, as many tasks share a machine and BLAS would start threads in each.
            val, vec = np.linalg.eigh(np.einsum("nkm,nlm->nkl", clean, clean))
            sigma = np.sqrt(np.maximum(val, 0))
            vec = vec * (sigma > noise[:, None])[:, None, :]
            low = np.einsum("nkl,nlm->nkm", np.einsum("nkj,nlj->nkl", vec, vec), clean)
        out[idx] = low[place]
    return out


def _runs(key: np.ndarray) -> np.ndarray:
    """Length of the run of equal keys that each place is in."""
    if not len(key):
        return np.zeros(0, np.int64)
    run = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    return np.bincount(run)[run]


def _side_levels(p: np.ndarray, good: np.ndarray, value: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians of up to SIDE good readings before and after each position p, in its tile; NaN if there is none."""
    j = np.searchsorted(good, p, "left")
    after = j + (np.take(good, np.minimum(j, len(good) - 1)) == p if len(good) else 0)
    both = []
    for at in (j[:, None] - 1 - np.arange(SIDE), after[:, None] + np.arange(SIDE)):
        ok = (at >= 0) & (at < len(good))
        pos = good[np.clip(at, 0, len(good) - 1)] if len(good) else np.zeros_like(at)
        both.append(row_median(np.where(ok & (tile[pos] == tile[p][:, None]), value[pos], np.nan)))
    return both[0], both[1]


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    n_tiles = len(pdf)
    sizes = np.array([len(x) for x in pdf["ts"]])
    tile = np.repeat(np.arange(n_tiles), sizes)
    flat = {c: np.concatenate([np.asarray(x) for x in pdf[c]]) for c in ("ts", "seq", "value", "ok", "copies", "finite", "home")}
    order = np.lexsort((flat["ts"], tile))
    pg = tile[order]
    pt, seq, pv, pok, copies, finite, home = (flat[c][order] for c in ("ts", "seq", "value", "ok", "copies", "finite", "home"))
    pv, pok, home = pv.astype(float), pok.astype(bool), home.astype(bool)
    counter = pdf["counter"].to_numpy(bool)

    # Stuck runs: equal values at successive times; anything out of range breaks a run.
    same = np.r_[False, (pv[1:] == pv[:-1]) & (pg[1:] == pg[:-1]) & pok[1:] & pok[:-1]] if len(pv) else np.array([], bool)
    stuck = _runs(np.cumsum(~same)) >= RUN

    # Deviations of the readings in range from their running median, in spreads of the tile.
    good = np.flatnonzero(pok)
    gv, gg = pv[good], pg[good]
    off = gv - running_median(gv, gg, HALF)
    spread = group_spread(np.where(stuck[good], np.nan, off), gg, n_tiles)
    step = np.r_[np.nan, np.diff(gv)] if len(gv) else gv
    step = np.where(np.r_[False, gg[1:] == gg[:-1]] if len(gg) else np.array([], bool), step, np.nan)
    usual = np.nan_to_num(group_median(np.where(step > 0, step, np.nan), gg, n_tiles))
    least = np.full(n_tiles, np.inf)
    np.fmin.at(least, gg, np.where(np.abs(step) > 0, np.abs(step), np.nan))
    least = np.where(np.isinf(least), 0, least)
    unit = np.where(counter, np.maximum(usual, least), np.maximum(spread, least / 2))
    unit = np.where(unit > 0, unit, 1e-9)

    per_day, width, blocks, step_ms = (pdf[c].to_numpy(np.int64) for c in ("per_day", "width", "blocks", "step_ms"))
    slot = pt[good] // step_ms[gg]
    day = np.where(per_day[gg] > 0, slot // np.maximum(per_day, 1)[gg], 0)
    col = slot - day * per_day[gg]
    # A margin that reaches over midnight belongs to the day whose block it adjoins.
    low_col = np.full(n_tiles, np.iinfo(np.int64).max)
    core = home[good]
    block = np.full(n_tiles, -1)
    block[gg[core]] = (col // width[gg])[core]
    wide = blocks > 1
    wrap = wide[gg] & (block[gg] >= 0)
    over = wrap & (col - block[gg] * width[gg] > per_day[gg] // 2)
    under = wrap & (col - block[gg] * width[gg] < -(per_day[gg] // 2))
    day = day + over - under
    col = col + per_day[gg] * (under.astype(int) - over)
    np.minimum.at(low_col, gg, col)
    low_day = np.full(n_tiles, np.iinfo(np.int64).max)
    np.minimum.at(low_day, gg, day)
    # The day's level: the median of its readings in the tile.
    day = day - low_day[gg]
    of_day = np.cumsum(np.r_[True, (gg[1:] != gg[:-1]) | (day[1:] != day[:-1])]) - 1 if len(gg) else gg
    level = group_median(gv, of_day, int(of_day[-1]) + 1 if len(gg) else 0)[of_day]
    with np.errstate(over="ignore", invalid="ignore"):
        u, apart = (np.clip(np.nan_to_num(x / unit[gg]), -MOST, MOST) for x in (gv - level, off))
    rest = u - low_rank(u, apart, gg, day, col - low_col[gg], n_tiles)
    # Stretches of more than BURST readings off the same way are changes of behaviour, not sparse.
    way = np.where(np.abs(rest) >= CANDIDATE, np.sign(rest), 0)
    sparse = (way != 0) & (_runs(gg * 4 + way.astype(np.int64)) <= BURST)

    # Exact check of the candidates against both sides, in two rounds: what fails is unaffected in the second.
    hit = sparse.copy()
    spot = np.arange(len(gv))
    dev = np.zeros(len(gv))
    for _ in range(3):
        c = np.flatnonzero(sparse)
        if not len(c):
            break
        left, right = _side_levels(c, spot[~hit], gv, gg)
        above, below = gv[c] - np.fmax(left, right), np.fmin(left, right) - gv[c]
        d = np.where(np.isnan(left) | np.isnan(right), 0, np.maximum(above, below))
        dev[c] = np.maximum(d, 0)
        now = np.zeros(len(gv), bool)
        now[c] = dev[c] >= np.where(counter[gg[c]], JUMP, SPIKE) * 0.5 * unit[gg[c]]
        if (now == hit).all():
            break
        hit = now
    # The spread that counts: deviations of unaffected readings from the level of their neighbours.
    calm = spot[~hit]
    cg, cv = gg[calm], gv[calm]
    shifts = np.r_[-np.arange(1, SIDE + 1), np.arange(1, SIDE + 1)]
    level = np.empty(len(calm))
    for a in range(0, len(calm), 200_000):
        lo, hi = max(0, a - SIDE), min(len(calm), a + 200_000 + SIDE)
        b = min(len(calm), a + 200_000)
        level[a:b] = row_median(windows(cv[lo:hi], cg[lo:hi], shifts)[a - lo : b - lo])
    fine = group_spread(np.where(stuck[good][calm], np.nan, cv - level), cg, n_tiles)
    final = np.where(counter, np.maximum(usual, least), np.maximum(fine, least / 2))

    # Bursts of more than BURST successive hits are no spikes.
    strong = hit & (dev >= np.where(counter[gg], JUMP, SPIKE) * 0.5 * np.where(final > 0, final, 1e-9)[gg])
    strong &= _runs(gg * 2 + strong) <= BURST

    spike_dev = np.zeros(len(pv))
    spike_dev[good[strong]] = dev[strong]
    spike, held = home & (spike_dev > 0), home & stuck
    name = pdf["entity"].to_numpy(object)
    frames = [
        pd.DataFrame({"entity": name[pg[at]], "seq": seq[at], "ts": pt[at], "value": pv[at], "kind": kind, "dev": spike_dev[at], "spread": final[pg[at]], "n": copies[at]})
        for at, kind in ((spike & ~counter[pg], "spike"), (spike & counter[pg], "jump"), (held, "run"))
    ]
    whole = np.bincount(pg, np.where(home, finite, 0), n_tiles).astype(np.int64)
    frames.append(pd.DataFrame({"entity": name, "seq": 0, "ts": 0, "value": np.nan, "kind": "tile", "dev": np.nan, "spread": final, "n": whole}))
    return pd.concat(frames, ignore_index=True)


def implausible(rows: DataFrame) -> DataFrame:
    """(entity, seq, kind) with kind 'range', 'spike' or 'run'; a reading may be of several kinds.

    rows: entity, seq, ts (ms), value, step_ms (nominal step), lo, hi (limits, null for none), counter (only grows,
    but may restart), held (keeps its values by nature). Rows with a null entity, ts, value or step are left out.
    range: NaN, infinite, below lo or above hi. spike: one of at most BURST successive readings that lie above, or
    below, the levels on both sides by SPIKE times the source's spread; of a counter by JUMP usual increases. run: one
    of RUN or more successive equal values. Readings of one time count as one, the first to be in range; a repeat that
    deviates alike is flagged with it. No spikes or runs for held sources and those with fewer than FEWEST finite
    readings, nor a spike without readings on both sides. No rows, no result."""
    v = F.col("value")
    out_of = F.isnan(v) | (F.abs(v) == float("inf")) | F.coalesce(v < F.col("lo"), F.lit(False)) | F.coalesce(v > F.col("hi"), F.lit(False))
    live = rows.where(F.col("entity").isNotNull() & F.col("ts").isNotNull() & v.isNotNull() & (F.col("step_ms") > 0))
    live = cut(live.select("entity", "seq", "ts", "value", F.col("step_ms").cast("bigint").alias("step_ms"), F.coalesce("counter", F.lit(False)).alias("counter"), F.coalesce("held", F.lit(False)).alias("held"), (~out_of).alias("ok")), "rows")
    live = live.where(F.col("entity").isNotNull() & F.col("ts").isNotNull())  # as the joins below say, so that shuffles are shared
    ranged = live.where(~F.col("ok")).select("entity", "seq", F.lit("range").alias("kind"))
    # Rows of one time are one reading, that of the first one to be in range, so that a tile doesn't grow with them.
    tested = live.where(~F.col("held")).drop("held")
    # A time with none in range has no seq and value of its own, as it is never a spike or part of a run.
    seq = F.when(F.col("ok"), F.col("seq"))
    once = tested.groupBy("entity", "ts").agg(F.min(seq).alias("s"), F.min_by("value", seq).alias("v"), F.count(F.lit(1)).alias("copies"), F.count(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), 1)).alias("finite"), F.min("step_ms").alias("step_ms"), F.max("counter").alias("counter"))
    once = once.select("entity", F.coalesce("s", F.lit(0)).alias("seq"), "ts", F.coalesce("v", F.lit(float("nan"))).alias("value"), F.col("s").isNotNull().alias("ok"), "copies", "finite", "step_ms", "counter")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield _judge(pdf)

    flags = cut(tiles(once, tested).mapInPandas(judge, FLAGS).where((F.col("kind") != "tile") | (F.col("n") > 0)), "flags")
    whole = flags.where(F.col("kind") == "tile").groupBy("entity").agg((F.sum(F.col("spread") * F.col("n")) / F.sum("n")).alias("usual"), F.sum("n").alias("readings"))
    factor = F.when(F.col("kind") == "jump", F.lit(JUMP)).otherwise(F.lit(SPIKE))
    judged = flags.where(F.col("kind") != "tile").join(whole, "entity").where((F.col("readings") >= FEWEST) & ((F.col("kind") == "run") | (F.col("dev") >= factor * F.col("usual"))))
    # A repeat with another value is a case only if it is off as well.
    near = F.when(F.col("kind") == "run", SPIKE * F.col("spread")).otherwise(0.5 * F.col("dev"))
    sure = judged.select("entity", "seq", "ts", "value", F.when(F.col("kind") == "run", "run").otherwise("spike").alias("kind"), near.alias("near"), "n")
    several = cut(sure.where(F.col("n") > 1).select("entity", "ts", F.col("value").alias("point"), "kind", "near"), "copied")
    copied = several.join(tested.where("ok").select("entity", "ts", "value", "seq"), ["entity", "ts"]).where(F.abs(F.col("value") - F.col("point")) <= F.col("near"))
    columns = ("entity", "seq", "kind")
    return ranged.unionByName(sure.where(F.col("n") == 1).select(*columns)).unionByName(copied.select(*columns))
