"""Wavelet files answer lookups from a few chunks; null and repeated ids are dealt over ranges; step groups are even."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platehouse.llm import mixing, packing, syncmers, tokens, wavelet


def test_a_lookup_unpacks_a_few_chunks():
    ids = np.random.default_rng(1).integers(0, 60_000, 400_000).astype(np.uint32)
    data = wavelet.WaveletMatrix.build(ids, 16).to_bytes()
    m = wavelet.WaveletMatrix.from_bytes(data)
    assert m.access(399_999) == ids[-1] and len(m._held) <= 16 < m.width * m.chunks
    value = int(ids[7])
    places = np.flatnonzero(ids == value)
    assert m.count(value) == len(places) and m.select(value, 1) == places[1] and m.rank(value, 200_000) == (places < 200_000).sum()
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(b"x" * 40)


def test_occurrences_are_those_of_the_ids(spark):
    texts = [f"one # two {i} $" * (i % 5) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    name = tokens.vocabulary("byte_bpe_50k.json")
    shards = wavelet.write_shards(docs, name, 2, shard_tokens=100)
    flat = Counter(int(x) for ids in tokens.encoder(name)(texts, 2) for x in ids)
    got = {r["token_id"]: r["n"] for r in wavelet.occurrences(shards, [2, 3, 505, 60_000]).groupBy("token_id").agg(F.sum("n").alias("n")).collect()}
    assert got == {t: flat[t] for t in (2, 3, 505, 60_000) if flat[t]}


@pytest.fixture(scope="module")
def hot(spark):
    """A third without id, a third of one id, the rest with ids on both sides of it."""
    rows = [(None, f"none {i} " + "ab" * (i % 40)) for i in range(300)] + [(50, f"hot {i} " + "cd" * (i % 50)) for i in range(300)] + [(i if i < 50 else i + 1, f"text {i} " + "ef" * (i % 60)) for i in range(300)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_hot_and_null_ids_are_dealt_over_shards(spark, hot):
    rows, docs = hot
    got = pd.DataFrame([r.asDict() for r in wavelet.read_shards(wavelet.write_shards(docs, tokens.vocabulary("byte_bpe_50k.json"), 2, shard_tokens=400)).collect()])
    got = got.sort_values("start")
    assert len(got) == 900 and got["start"].tolist() == [0, *got["n_tokens"].cumsum().tolist()[:-1]]
    ids = got["doc_id"].tolist()
    known = [i for i in ids if not pd.isna(i)]
    assert all(pd.isna(i) for i in ids[:300]) and known == sorted(known)
    assert got[got["doc_id"].isna()]["part"].nunique() > 1 and got[got["doc_id"] == 50]["part"].nunique() > 1


def test_neighbours_of_hot_and_null_ids(spark, hot):
    import hashlib

    rows, docs = hot
    got = [r.asDict() for r in syncmers.fingerprint_edits(docs).collect()]
    assert len(got) == 900
    tie = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = [t for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: (r[0], tie[r[1]]))]
    expect = Counter()
    for text, after in zip(order, [*order[1:], order[0]], strict=True):
        n = len(text)
        expect[hashlib.sha256((text[: n - n // 4] + after[: n // 4]).encode()).hexdigest()] += 1
    assert Counter(r["edited_sha256"] for r in got if r["doc_id"] is not None) == expect


def test_step_groups_of_a_tier_differ_by_one_window(spark):
    docs = spark.createDataFrame([(i, "word " * (50 + 37 * i % 900)) for i in range(400)], "doc_id long, text string").coalesce(1)
    rows = pd.DataFrame([r.asDict() for r in packing.pack(docs, tokens.vocabulary("word_bpe_49k.json"), 2, step_tokens=8192).collect()])
    windows = rows.groupby("sequence_id").agg(tier=("tier", "first"), group=("step_group", "first"), groups=("step_group", "nunique"))
    assert (windows["groups"] == 1).all()
    for tier, g in windows.groupby("tier"):
        held = g.groupby("group").size()
        assert held.max() - held.min() <= 1 and held.max() * tier <= max(8192, tier)


def test_of_rows_alike_in_id_and_text_one_always_stands_for_all(spark):
    rows = [(1, "a b c", "en", f"s{i % 2}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    seen = {tuple(sorted(r["source"] for r in mixing.mix(docs.repartition(n)).collect())) for n in (1, 3, 7)}
    assert len(seen) == 1 and len(set(next(iter(seen)))) == 1


def test_a_document_taken_very_often_is_dealt_over_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "one two three four five", "a")] * 3000 + [(1, "six seven", "b"), (2, "", "b")], "doc_id long, text string, source string")
    expected = sorted((r["doc_id"] or 0, r["text"], r["source"]) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "CHUNK", 64)
    mixed = mixing.mix(docs)
    got = mixed.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["source"]) for r in got) == expected
    sizes = Counter(r["task"] for r in got if r["doc_id"] is None)
    assert len(sizes) > 1 and max(sizes.values()) < len(got) * 0.7


def test_files_reach_a_worker_a_few_at_a_time(spark):
    """Batches hold 8 MB at most and a worker's cache of chunks about 285 MB, so that neither grows with the table."""
    from pyspark.sql import functions as F

    from platehouse.functions.batches import small_batches
    from platehouse.llm import tokens

    settings = [f"spark.sql.execution.arrow.{s}" for s in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {s: spark.conf.get(s) for s in settings}
    try:
        for s in settings:
            spark.conf.unset(s)
        small_batches(spark)
        sizes = spark.range(40).coalesce(1).select(F.encode(F.repeat(F.lit("y"), F.lit(1_000_000)), "utf-8").alias("payload")).mapInPandas(lambda batches: (b.assign(n=len(b))[["n"]] for b in batches), "n long")
        assert sizes.agg(F.max("n")).first()[0] <= 9
    finally:
        for s, v in before.items():
            spark.conf.set(s, v)
    assert tokens.KEPT_CHUNKS * 285 < 300_000_000
