"""Flow, drawing and token counts."""

import os
import random
import time
from collections import Counter

import pytest

from seriesloom.llm import mix as M


def cheapest(patterns, shares, repeats, total, before):
    """Cost of the cheapest flow, by Bellman-Ford paths of one unit at a time on a network of its own."""
    arcs, out = [], {}

    def arc(a, b, room, cost=0):
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out.setdefault(x, []).append(len(arcs))
            arcs.append([x, y, r, c])

    for p, (n, w) in patterns.items():
        first = before.get(p, 0) * sum(repeats[s] for s in n if n[s])
        for k in range(sum(n[s] * repeats[s] for s in n)):
            arc("from", ("p", p), w, M.cost(first + k))
        for s in n:
            arc(("p", p), ("s", s), w * n[s] * repeats[s])
    for s, x in shares.items():
        arc(("s", s), "to", int(total * x))
    spent = 0
    while True:
        far, via = {"from": 0}, {}
        for _ in range(len(out)):
            for i, (a, b, r, c) in enumerate(arcs):
                if r > 0 and a in far and far[a] + c < far.get(b, 10**9):
                    far[b], via[b] = far[a] + c, i
        if "to" not in via:
            return spent
        x = "to"
        while x != "from":
            arcs[via[x]][2] -= 1
            arcs[via[x] ^ 1][2] += 1
            x = arcs[via[x]][0]
        spent += far["to"]


@pytest.mark.parametrize("seed", range(8))
def test_route_is_cheapest(seed):
    rng = random.Random(seed)
    sources = "abcd"[: rng.randrange(2, 5)]
    repeats = {s: rng.randrange(1, 4) for s in sources}
    shares = {s: 1 / 4 if len(sources) == 4 else 1 / 2 if s == "a" else 0.5 / (len(sources) - 1) for s in sources}
    patterns, before = {}, {}
    for i in range(6):
        some = rng.sample(sources, rng.randrange(1, len(sources) + 1))
        patterns[f"p{i}"], before[f"p{i}"] = ({s: 2 ** rng.randrange(3) for s in some}, rng.randrange(1, 6)), rng.choice([0, 0, 1, 4])
    flows, total = M.route(patterns, shares, repeats, rng.randrange(20, 60), before)
    for s, x in shares.items():
        assert sum(f for (_, t), f in flows.items() if t == s) == int(total * x)
    spent = 0
    for p, (n, w) in patterns.items():
        used = [f for (q, _), f in flows.items() if q == p]
        assert all(flows.get((p, s), 0) <= w * n[s] * repeats[s] for s in n)
        left, k = sum(used), before[p] * sum(repeats[s] for s in n)
        while left > 0:
            spent += min(left, w) * M.cost(k)
            left, k = left - w, k + 1
    assert spent == cheapest(patterns, shares, repeats, total, before)


def test_many_patterns_take_seconds():
    rng = random.Random(3)
    sources = "abcdef"
    patterns = {i: ({s: 2 ** rng.randrange(20) for s in rng.sample(sources, rng.randrange(1, 7))}, rng.randrange(1, 10**6)) for i in range(15_000)}
    begin = time.perf_counter()
    flows, total = M.route(patterns, dict.fromkeys(sources, 1 / 6), dict.fromkeys(sources, 3), None, {i: rng.choice([0, 1, 2, 64]) for i in patterns})
    assert time.perf_counter() - begin < 20
    assert all(abs(sum(x for (_, t), x in flows.items() if t == s) - total / 6) < 2 for s in sources)


def test_route_spreads_before_it_repeats():
    patterns = {"1,0": ({"a": 1}, 100), "1,1": ({"a": 1, "b": 1}, 100), "0,1": ({"b": 1}, 10)}
    flows, total = M.route(patterns, {"a": 0.5, "b": 0.5}, {"a": 3, "b": 3}, 220)
    assert total == 220 and sum(x for (_, s), x in flows.items() if s == "a") == 110 and sum(x for (_, s), x in flows.items() if s == "b") == 110
    used = Counter()
    for (p, _), x in flows.items():
        used[p] += x
    assert used["1,1"] <= 110 and used["0,1"] <= 20  # b needs the shared texts, a stays off them
    assert M.route(patterns, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1})[1] == 220
    assert M.route(patterns, {"a": 0.5, "c": 0.5}, {"a": 1, "c": 9}) == ({}, 0)


COUNTS = "doc_id bigint, source string, digest binary, tokens bigint, repeats string"
TARGETS = "source string, target_share double, max_repeats int, tokens int"


def draw(spark, docs, targets, **kw):
    df = spark.createDataFrame([(i, s, d.encode(), n, "x") for i, s, d, n in docs], COUNTS).repartition(3)
    return df, [tuple(r) for r in M.mix(df, spark.createDataFrame([(*t, 1) for t in targets], TARGETS), **kw).collect()]


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["a"] * 6 + ["b", "c", "z"]), f"t{rng.randrange(500)}" if i % 3 else "hot", 0 if i == 9 else 20 if i % 3 == 0 else 10 + i % 7) for i in range(900)]
    sizes = {d: n for _, _, d, n in docs}
    docs = [(i, s, d, 0 if i == 9 else sizes[d]) for i, s, d, _ in docs]
    targets = [("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("none", 0.0, 5), (None, 0.1, 5)]
    df, got = draw(spark, docs, targets)
    by = {i: (s, n) for i, s, _, n in docs}
    cap = {s: r for s, _, r in targets}
    assert len({g[0] for g in got}) == len(got) and all(by[g[0]] == (g[1], g[2]) and 1 <= g[3] <= cap[g[1]] for g in got)
    size = Counter()
    for _, s, n, r in got:
        size[s] += n * r
    whole = sum(size.values())
    assert all(abs(size[s] / whole - x) < 0.03 for s, x in (("a", 0.6), ("b", 0.3), ("c", 0.1)))
    assert sorted(draw(spark, docs, targets)[1]) == sorted(got) and sorted(draw(spark, docs, targets, seed=3)[1]) != sorted(got)
    half = draw(spark, docs, targets, total=whole // 2)[1]
    assert abs(sum(n * r for _, _, n, r in half) - whole // 2) < 200
    uses = Counter()
    for i, s, n, r in half:
        uses[next(d for j, _, d, _ in docs if j == i)] += r
    assert max(uses.values()) <= 3  # repetition spreads over texts
    wanted = spark.createDataFrame([(*t, 1) for t in targets[:3]], TARGETS)
    shares = {r["source"]: r["reached_share"] for r in M.reached(M.mix(df, wanted), wanted).collect()}
    assert sum(shares.values()) == pytest.approx(1)
    assert draw(spark, docs, [("a", 0.5, 1), ("missing", 0.5, 1)])[1] == []
    assert draw(spark, docs, [])[1] == [] and draw(spark, [], targets)[1] == []


def test_every_copy_can_be_drawn(spark):
    """A text with 50 copies in one source offers all of them, but only once its other texts are used as often."""
    hot = [(i, "a", "hot", 10) for i in range(50)]
    other = [(i, "b", f"b{i}", 10) for i in range(50, 100)]
    assert sorted(draw(spark, hot, [("a", 1.0, 1)])[1]) == [(i, "a", 10, 1) for i in range(50)]
    assert sorted(draw(spark, hot, [("a", 1.0, 3)])[1]) == [(i, "a", 10, 3) for i in range(50)]
    assert sorted(draw(spark, hot + other, [("a", 0.5, 1), ("b", 0.5, 1)])[1]) == [(i, s, n, 1) for i, s, _, n in hot + other]
    single = [(i, "a", f"a{i}", 10) for i in range(50, 100)]
    few = draw(spark, hot + single, [("a", 1.0, 1)], total=510)[1]
    assert len(few) == 51 and sum(i < 50 for i, *_ in few) == 1


def test_many_copies_go_over_many_tasks(spark):
    """Copies of one text are numbered in parts; all of them, and no more, are dealt the text's uses."""
    from pyspark.sql import functions as F

    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20_000, "a").otherwise("b").alias("source"), F.unhex(F.md5(F.when(F.col("id") < 21_000, F.lit("hot")).otherwise(F.col("id").cast("string")))).alias("digest"), F.lit(10).cast("bigint").alias("tokens"))
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = M.mix(docs, targets).toPandas()
    assert got.groupby("source")["repeats"].sum().to_dict() == {"a": 10_000, "b": 10_000} and got["repeats"].max() == 1 and got["doc_id"].is_unique
    full = M.mix(docs.where("source = 'a'"), targets.where("source = 'a'")).toPandas()
    assert len(full) == 20_000 and (full["repeats"] == 2).all()
    odd = M.mix(docs.where("source = 'a'"), spark.createDataFrame([("a", 1.0, 2)], targets.schema), total=300_010).toPandas()
    assert len(odd) == 20_000 and odd["repeats"].sum() == 30_001


def test_entries_hold_every_copy(spark):
    texts = spark.createDataFrame([(b"x", 7, 5, 0), (b"y", 3, 1, 3), (b"z", 2, 0, 4)], "digest binary, w bigint, n_0 bigint, n_1 bigint")
    got = sorted((bytes(r["digest"]).decode(), r["w"], r["j"], r["pattern"]) for r in M.entries(texts, ["a", "b"]).collect())
    assert got == [("x", 7, 0, "1@0@0"), ("x", 7, 2, "1@2@1"), ("y", 3, 0, "3@0@0"), ("y", 3, 1, "2@1@1"), ("z", 2, 2, "2@2@0")]


def test_token_counts(spark):
    if not os.path.exists(M.VOCABULARY):
        pytest.skip("no vocabulary")
    rows = [(1, "a", "hello world", "x"), (2, "a", "", "x"), (3, None, "text", "x"), (4, "b", None, "x"), (5, "b", "ab " * 50_000, "x"), (1, "a", "hello world", "x"), (6, "a", "<|endoftext|>", "x")]
    got = M.token_counts(spark.createDataFrame(rows, "doc_id bigint, source string, text string, digest string")).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 5, 6]
    assert {r["tokens"] for r in got if r["doc_id"] == 1} == {2} and next(r["tokens"] for r in got if r["doc_id"] == 6) > 1
    e = M.encoder(M.VOCABULARY)
    assert e.decode(e.encode_ordinary("ab " * 99 + "né\n")) == "ab " * 99 + "né\n"
