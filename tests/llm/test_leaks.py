"""The search against brute force."""

import pickle
import random
import re

import pytest

from seriesloom.llm import leaks as L


def brute(docs, items, words):
    def grams(text):
        w = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}

    per = [(i, grams(t)) for i, t in items]
    return sorted({(d, i) for d, t in docs for i, g in per if d is not None and i is not None and g & grams(t)})


@pytest.mark.parametrize("words", [1, 3, 15])
def test_search_equals_brute_force(words, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 64)
    rng = random.Random(words)
    vocabulary = ["a", "b2", "Crate", "LEVER", "x", "tin", "é", "on-off", "9"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", ", "]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 40))) for i in range(12)] + [(12, ""), (13, "a"), (14, "a " * 60)]
    docs = [(i, text(rng.randrange(0, 300))) for i in range(60)] + [(60, items[3][1].upper().replace(" ", "_*_")), (61, ""), (62, "é"), (63, "a " * 9), (64, items[5][1] + "zz")]
    p = L.Patterns(items, words)
    at, item = p.search([L.normal(t) for _, t in docs])
    assert [(docs[a][0], int(i)) for a, i in zip(at, item)] == brute(docs, items, words)


def test_operator_edges(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(20))
    docs = [(1, "x " + long.upper() + " y", "e"), (2, None, "e"), (3, "", "e"), (4, "w1 w2", "e"), (5, "q " * 200_000 + " ".join(long.split()[5:]), "e"), (1, long, "e"), (None, long, "e"), (6, " ".join(long.split()[6:]) + ": MORE", "e")]
    items = [(7, long, "x"), (8, None, "x"), (9, "short", "x"), (7, long, "x"), (None, long, "x"), (10, long + " more", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    ef = spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    want = [(1, 7), (1, 10), (5, 7), (5, 10), (6, 10)]
    assert sorted(map(tuple, L.leaks(df, ef).collect())) == want
    monkeypatch.setattr(L, "LOTS", 2)
    assert sorted(map(tuple, L.leaks(df, ef, lot_bytes=10).collect())) == want  # one item a lot, two lots a pass
    assert L.leaks(df, ef.limit(0)).collect() == [] and L.leaks(df.limit(0), ef).collect() == []


def test_many_items_in_one_lot():
    """A lot of a megabyte takes a few megabytes, repeated passages once, and its tables still let windows move on."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(5000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(500)] + [(500, "tick tock " * 30_000)]
    p = L.Patterns(items)
    assert len(pickle.dumps(p)) < 20 * sum(len(t) for _, t in items) and (p.item == 500).sum() == 2
    other = L.normal(" ".join(rng.choice(words)[::-1] for _ in range(20_000)))
    docs = [other, other[:5000] + L.normal(" ".join(items[77][1].split()[100:120])) + other[5000:], L.normal("tock tick " * 8)]
    at, item = p.search(docs)
    assert list(zip(at.tolist(), item.tolist())) == [(1, 77), (2, 500)]
    assert (p.shift > 1).mean() > 0.5
