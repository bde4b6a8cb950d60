"""Shards are cut evenly under the smallest capacity, and a group above an even part has one for itself."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platehouse.llm import sharding


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(1, 8))
def test_even_cuts_of_single_groups(sizes, shards):
    cells = [(i, 0, n, 1) for i, n in enumerate(sizes)]
    shards = min(shards, len(sizes))
    total, ends = 0, []
    for n in sizes:
        total += n
        ends.append(total)
    best = sharding.smallest_capacity(ends, shards, max(sizes))
    cuts, unsure = sharding._even_cuts(cells, best, shards)
    bounds = [0, *cuts, len(sizes)]
    held = [sum(sizes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert not unsure and all(b > a for a, b in zip(bounds[:-1], bounds[1:], strict=True)) and max(held) <= best


def _shards(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sharding.shard(docs, 24).collect()


def test_one_heavy_group_leaves_the_others_even(spark):
    rows = [(i, "x" * 5000) for i in range(20)] + [(100 + i, f"{i:03d}" + "y" * 200) for i in range(200)]
    held, texts = Counter(), Counter()
    for r in _shards(spark, rows):
        held[r["shard"]] += r["size"]
        texts[r["shard"]] += 1
    assert sorted(held) == list(range(24)) and held[0] == 20 * 5008
    assert max(texts[s] for s in range(1, 24)) - min(texts[s] for s in range(1, 24)) <= 1


def test_fewer_groups_than_shards(spark):
    got = _shards(spark, [(i, f"text {i % 5}") for i in range(50)])
    assert Counter(Counter(r["shard"] for r in got).values()) == {10: 5} and {r["shard"] for r in got} == set(range(5))


@pytest.mark.parametrize("heavy", [0, 1, 3])
def test_many_groups_differ_by_one_group_at_most(spark, heavy):
    rows = [(i, f"{i:05d}" + "z" * (i * 7919 % 90)) for i in range(9000)] + [(20_000 + 300 * h + i, f"h{h}" * 100) for h in range(heavy) for i in range(300)]
    held = Counter()
    for r in _shards(spark, rows):
        held[r["shard"]] += r["size"]
    rest = [held[s] for s in range(heavy, 24)]
    assert len(held) == 24 and max(rest) - min(rest) <= 103 + 8
