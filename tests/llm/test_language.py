"""Models, segments and corrections."""

import random

import numpy as np
import pytest

from seriesloom.llm import kn
from seriesloom.llm import language as L

WORDS = {
    "en": "the crate is kept in store until next week and then we wait for more of them because it was written",
    "de": "der kasten wird im lager bis zur nächsten woche aufbewahrt und dann warten wir auf mehr davon weil es so ist",
    "python": "def store(crate): return crate + 1 import os for n in range(crate): print(n) if crate > 4: pass",
}


def text(lang, rng, lines=12):
    words = WORDS[lang].split()
    return "\n".join(" ".join(rng.choice(words) for _ in range(8)) for _ in range(lines)) + "\n"


@pytest.fixture(scope="module")
def me():
    rng = random.Random(1)
    sample = [(lang, text(lang, rng)) for lang in WORDS for _ in range(40)]
    wrong = [("en", text("de", rng)) for _ in range(4)] + [("python", text("python", rng) + text("en", rng, 6)) for _ in range(4)]
    return L.Identifier(sample + wrong)


def test_probabilities_sum_to_one(me):
    """Over the next class, given contexts that were seen or not, for each language."""
    for ctx in ("the ", "zzzz", "\n\n\n\n", "ret "):
        head = [c for c in np.frombuffer(kn.encode(ctx), np.uint8)][-4:]
        code = np.array([sum(int(c) << (kn.BITS * (4 - i)) for i, c in enumerate([*head, k])) for k in range(kn.CLASSES)], np.uint64)
        assert np.allclose(np.exp(me.model._rows(code, kn.ORDER)).sum(0), 1, atol=1e-3)


def test_hashes_find():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 2**35, 5000).astype(np.uint64))
    h = kn.Hashes(codes[::2])
    found = h.find(codes)
    assert (found[::2] >= 0).all() and (found[1::2] < 0).all()
    assert (h.hashes[found[::2]] == codes[::2] * kn.MIX).all()
    assert (kn.Hashes(codes[:0]).find(codes) == -1).all()


def test_held_out_accuracy(me):
    rng = random.Random(9)
    texts = [(lang, text(lang, rng, 6)) for lang in WORDS for _ in range(50)]
    s = me.segments([t for _, t in texts])
    right = [texts[t][0] == me.languages[lang] for t, lang in zip(s["text"], s["lang"])]
    assert len(right) == len(texts) and np.mean(right) > 0.99 and np.nanmin(s["confidence"]) > 0.5


def test_confidence_is_calibrated(me):
    """Of short texts that were not learnt, as many are right as their confidences say, in each range of confidence."""
    rng = random.Random(12)
    texts = [(lang, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(1, 4))) + "\n") for lang in WORDS for _ in range(600)]
    texts = [(lang, t) for lang, t in texts if sum(map(str.isalpha, t)) >= kn.TELLING]
    s = me.segments([t for _, t in texts])
    keep = s["lang"] >= 0
    sure = s["confidence"][keep]
    right = np.array([texts[t][0] == me.languages[lang] for t, lang in zip(s["text"][keep], s["lang"][keep])])
    assert len(sure) > 1000 and abs(sure.mean() - right.mean()) < 0.05
    for lo, hi in ((0, 0.8), (0.8, 0.95), (0.95, 1.01)):
        some = (sure >= lo) & (sure < hi)
        assert some.sum() < 30 or abs(sure[some].mean() - right[some].mean()) < 0.15


def test_other_languages_are_refused(me):
    texts = ["Коробка хранится на складе до следующей недели, потому что её ждут.\n" * 8, "zzyx qwqw 0x vvkk xjxj qqq wkwk zpzp\n" * 8]
    s = me.segments(texts)
    assert (s["lang"] == -1).all() and np.isnan(s["confidence"]).all()


def test_segments(me):
    rng = random.Random(5)
    mixed = text("en", rng, 10) + "\n```\n" + text("python", rng, 10) + "```\n" + text("de", rng, 9)
    s = me.segments([mixed, "", "qqq\x00", "\n\n", mixed.replace("\n", "\r\n")])
    first = s["text"] == 0
    assert [me.languages[x] for x in s["lang"][first]] == ["en", "python", "de"]
    assert abs(s["first"][first][1] - 11) <= 1 and s["last"][first][-1] == 31 and s["share"][first].sum() == pytest.approx(1)
    assert (s["lang"][s["text"] == 1] == -1).all() and (s["lang"][s["text"] == 3] == -1).all()
    assert s["lang"][s["text"] == 4].tolist() == s["lang"][first].tolist()


def test_comments_and_data_belong_to_their_surroundings(me):
    rng = random.Random(6)
    code = text("python", rng, 8) + "# " + text("en", rng, 3).replace("\n", "\n# ") + "\n" + "0x1f, 0x2e,\n" * 20 + text("python", rng, 4)
    s = me.segments([code])
    assert [me.languages[x] for x in s["lang"]] == ["python"]


def test_pieces_dont_matter(me, monkeypatch):
    rng = random.Random(7)
    texts = [kn.encode(text(lang, rng, n)) for lang in WORDS for n in (1, 5, 30)] + [b"", b"x", b"\n"]
    a = me.model.line_scores(texts)
    monkeypatch.setattr(kn, "PIECE", 37)
    b = me.model.line_scores(texts)
    assert np.allclose(a[0], b[0], rtol=1e-4, atol=1e-3) and (a[1] == b[1]).all() and (a[2] == b[2]).all() and a[2].tolist()[-3:] == [1, 1, 1]


def test_operator(spark, me):
    rng = random.Random(8)
    en, de, py = (text(k, rng, 20) for k in ("en", "de", "python"))
    docs = [(1, en, "en"), (2, en, "de"), (3, de, None), (4, en + py, "en"), (5, en + text("de", rng, 2), "EN"), (6, "hi", "de"), (7, None, "en"), (8, "", None), (9, py * 300, "klingon"), (2, en, "de")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, lang string, label string")
    names = spark.createDataFrame([("en", "en", 1), ("de", "de", 2), ("py", "python", 3)], "alias string, lang string, text int")
    rows = L.labelled(df, names)
    got = L.corrections(L.language_segments(rows, me))
    assert sorted({(r["doc_id"], r["lang_found"]) for r in got.collect()}) == [(2, "en"), (3, "de"), (4, "en"), (4, "python"), (9, "python")]
    assert L.language_segments(rows.limit(0), me).collect() == []
    trained = L.train(rows)
    assert trained.languages == ["de", "en"]
