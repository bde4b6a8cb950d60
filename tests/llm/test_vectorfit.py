"""Vector best fit: plans against one piece at a time, every limit, and packed tables against the tokenizer."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from platehouse.llm import vectorfit
from platehouse.llm.tokens import encoder, vocabulary
from platehouse.llm.vectorfit import RULES, Capacity, best_plan, plan


def _bins(made):
    bins = defaultdict(list)
    for length, low, high, first, each, base in made.rows.tolist():
        for rank in range(low, high):
            q, slot = divmod(rank - low, each)
            bins[first + q].append((base + slot * length, length))
    return bins


@pytest.mark.parametrize("rule", RULES)
def test_plans_hold_every_limit_and_every_piece(rule):
    rng = random.Random(12)
    for _ in range(200):
        tokens = rng.choice((8, 16, 64))
        counts = {rng.randrange(1, tokens + 1): rng.randrange(1, 60) for _ in range(rng.randrange(1, 20))}
        capacity = Capacity(tokens, rng.choice((None, 2, 5)), rng.choice((None, tokens**2, 2 * tokens**2)))
        made, limits, seen = plan(counts, capacity, *rule), capacity.limits(), defaultdict(int)
        bins = _bins(made)
        assert sorted(bins) == list(range(made.sequences))
        for pieces in bins.values():
            at = 0
            for start, n in sorted(pieces):
                assert start == at
                at, seen[n] = at + n, seen[n] + 1
            assert (np.array([at, len(pieces), sum(n * n for _, n in pieces)]) <= limits).all()
        assert seen == counts


def _one_by_one(counts, tokens):
    """Best fit decreasing, a piece at a time."""
    bins = []
    for n in sorted((x for x, c in counts.items() for _ in range(c)), reverse=True):
        fit = [i for i, used in enumerate(bins) if used + n <= tokens]
        if fit:
            bins[max(fit, key=lambda i: (bins[i], -i))] += n
        else:
            bins.append(n)
    return len(bins)


def test_counts_of_lengths_are_packed_as_single_pieces_are():
    rng = random.Random(3)
    for _ in range(100):
        counts = {rng.randrange(1, 65): rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))}
        assert plan(counts, Capacity(64), *RULES[0]).sequences == _one_by_one(counts, 64)
        assert best_plan(counts, Capacity(64)).sequences >= -(-sum(n * c for n, c in counts.items()) // 64)


def test_rules_choose_by_their_own_score():
    # Two bins are open, one nearly full of tokens; a short piece makes the first fuller, and suits the emptier by direction.
    counts = {60: 1, 40: 1, 3: 1}
    assert [sorted(n for _, n in b) for b in _bins(plan(counts, Capacity(64), "norm", (1, 0, 0))).values()] == [[3, 60], [40]]
    assert [sorted(n for _, n in b) for b in _bins(plan(counts, Capacity(64), "dot", (1, 0, 0))).values()] == [[60], [3, 40]]


def test_capacities_that_hold_no_piece_are_refused():
    for bad in (Capacity(0), Capacity(8, -1), Capacity(8, None, 63), Capacity(1 << 20)):
        with pytest.raises(ValueError):
            plan({1: 1}, bad, *RULES[0])


def _rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma,", "Ünïcode", "日本語", "1234567", "\n", "x"]
    texts = [None, "", " ", "one", *[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 700))) for _ in range(60)], "alpha " * 9_000]
    texts += ["equal words"] * 40
    return [*enumerate(texts), (None, "no number"), (None, None), (4, "equal number"), (4, "equal number")]


def _pack(spark, rows, capacity):
    df = spark.createDataFrame([(d, t, 1, 2, "x", None) for d, t in rows], "doc_id long, text string, part int, nth int, length string, before long").repartition(3)
    return [r.asDict() for r in vectorfit.pack(df, vocabulary("byte_bpe_50k.json"), 2, capacity).collect()]


@pytest.mark.parametrize("capacity", [Capacity(), Capacity(64, 3, 64 * 64)])
def test_packed_pieces_are_the_tokenizers_ids(spark, capacity):
    rows = _rows()
    made = _pack(spark, rows, capacity)
    tokenizer = encoder(vocabulary("byte_bpe_50k.json")).tokenizer
    expected = []
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        ends = [len(ids) - capacity.tokens * k for k in range(-(-len(ids) // capacity.tokens))][::-1]
        for piece, (start, end) in enumerate(zip([0, *ends], ends)):
            expected.append((doc, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in made), key=key) == sorted(expected, key=key)
    bins = defaultdict(list)
    for r in made:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(bins) == list(range(len(bins)))
    for pieces in bins.values():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at <= capacity.tokens and len(pieces) <= (capacity.documents or capacity.tokens)
        assert sum(n * n for _, n in pieces) <= (capacity.attention or capacity.tokens**2)


def test_empty_table(spark):
    assert _pack(spark, [], Capacity()) == []
