"""Fingerprints of short and long texts, as the result returns them, and the table of all anchors."""

import random

import pytest
from pyspark.sql import functions as F

from platehouse.llm import syncmers

SCHEMA = "doc_id long, text string"


def _near(one, two):
    a, b = syncmers._points(one), syncmers._points(two)
    return syncmers.likeness(*(syncmers.from_text(syncmers.as_text(*syncmers.sketch(*syncmers.anchors(p)))) for p in (a, b)))


@pytest.mark.parametrize("n", range(58, 70))
def test_near_copies_of_any_length_are_alike(n):
    rng = random.Random(n)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    for other in (text + "z", text[:-1], text[1:]):
        assert _near(text, other) > 0.5 and _near(text, other) == _near(other, text)
    assert _near(text, text) == 1 and _near(text, "") == 0


def test_short_tail_after_the_cut(spark):
    rng = random.Random(3)
    rows = [(2 * i, "".join(rng.choice("abcdefghijklmnop ") for _ in range(64 + i))) for i in range(21)]
    rows += [(2 * i + 1, "ab"[: i % 3]) for i in range(21)]
    got = {r["doc_id"]: r for r in syncmers.fingerprint_edits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[2 * i]["near_edited"] > 0.4 for i in range(21)), [got[2 * i]["near_edited"] for i in range(21)]


def test_anchor_table_finds_a_passage_of_long_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(50))
    texts = [" ".join(word() for _ in range(9000)) + f" {passage} " + " ".join(word() for _ in range(9000 + 500 * i)) for i in range(2)]
    rows = [(0, texts[0]), (1, texts[1]), (None, "short"), (None, None), (3, "")]
    table = syncmers.anchor_table(spark.createDataFrame(rows, SCHEMA))
    inner = syncmers.syncmers(syncmers._points(passage), syncmers.K, syncmers.S)
    assert len(inner[0]) > 20
    for i in (0, 1):
        mine = {(r["hash"] % 2**64, r["place"]) for r in table.where(F.col("doc_id") == i).collect()}
        h, p = syncmers.anchors(syncmers._points(texts[i]))
        start = texts[i].index(passage)
        assert mine == set(zip(h.tolist(), p.tolist())) and len(mine) > 5000
        assert {(v, a + start) for v, a in zip(inner[0].tolist(), inner[1].tolist())} <= mine
    assert [(r["doc_id"], r["place"]) for r in table.where("doc_id IS NULL OR doc_id = 3").collect()] == [(None, 0)]
    assert table.where("doc_id = 0").count() == len(syncmers.anchors(syncmers._points(texts[0]))[0])


def test_a_text_and_its_beginning_share_anchors_at_every_length(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(200))
    rows = [(n, text[:n]) for n in range(16, 200)]
    got = {r["doc_id"]: syncmers.from_text(r["fingerprint"]) for r in syncmers.fingerprint_edits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert min(syncmers.likeness(got[n], got[n + 1]) for n in range(16, 199)) > 0.5
    assert len(set(got[63][0]) & set(got[64][0])) >= 10
