"""Scores against a search without an automaton, learned exceptions, and recall on held-out rows."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from platehouse.llm import toxicity

WORDS = ["grum", "grumbo", "grumboes", "zot", "zotty", "can", "a", "b", "ZOTTY", "gr0m", "zоtty"]
MODEL = toxicity.Model({"grum": 0.5, "grumbo ": 0.75, "zotty ": 1.0}, ("grumbo can", "a zotty"), 2.0, -1.0)


def _naive(text: str) -> float:
    """Weight per 100 words by comparing every word with every entry and every window with every exception."""
    words, total = toxicity.fold(text).split(), 0.0
    excused = set()
    for phrase in MODEL.exceptions:
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                excused.update(range(i, i + len(parts)))
    for i, w in enumerate(words):
        for entry, weight in MODEL.entries.items():
            hit = w == entry[:-1] if entry.endswith(" ") else w.startswith(entry) and w != entry
            total += weight * (hit and i not in excused)
    return 100 * total / (toxicity.fold(text).count(" ") + toxicity.SMOOTHING_WORDS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=30))
def test_density_is_that_of_a_plain_search(words):
    text = " ".join(words)
    assert abs(MODEL.density(text, MODEL.automaton()) - _naive(text)) < 1e-9


def test_marks_hide_nothing_and_make_nothing_longer():
    a = MODEL.automaton()
    plain = MODEL.density("you zotty grum", a)
    assert plain > 0
    for text in ("you zotty grum" + "!" * 1000, "... " * 1000 + "you, zotty; grum", "you - zotty - grum \u2014 \u2026", "y\u200bou z\u00adotty g\u0301rum", "YOU ZÖTTÝ GRÜM", "you zøttỹ grūm", "you zᴏtty ɢrum", "ｙｏｕ ｚｏｔｔｙ ｇｒｕｍ", "you 𝐳𝐨𝐭𝐭𝐲 𝓰𝓻𝓾𝓶", "you z0т7y gruм"):
        assert MODEL.density(text, a) == plain, text
    assert MODEL.density("! " * 50, a) == MODEL.density("", a) == MODEL.density(None, a) == 0


def test_exceptions_are_learned(spark):
    rng = random.Random(5)
    clean = [f"w{i}" for i in range(150)]
    rows, labels = [], []
    for i in range(800):
        words = [rng.choice(clean) for _ in range(30)]
        at = rng.randrange(28)
        toxic = i % 4 == 0
        if toxic:
            words[at] = "grumbo"
        elif i % 20 == 1:
            words[at : at + 2] = ["grumbo", "fish"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "grumbo fish" in model.exceptions and "grumbo " in model.entries
    a = model.automaton()
    assert model.density("the grumbo fish swims", a) == 0 < model.density("you grumbo", a)


def test_held_out_recall(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where("held_out").groupBy("toxic").agg({"predicted": "avg"}).collect()
    rate = {r[0]: r[1] for r in got}
    assert rate[1] >= 0.92 and rate[0] <= 0.005
