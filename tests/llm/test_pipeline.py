"""The pipeline's stages against brute force, each judged on its own input."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from platehouse.llm import repetition, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows, labels = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, "too short", "en", None, 9)], []
    for i in range(3, 300):
        text = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        toxic = i % 6 == 0
        for _ in range(4 if toxic else 0):
            text[rng.randrange(len(text))] = "grumbo"
        if i % 17 == 0:
            text = text[:10] * 8
        text = " ".join(text)
        rows.append((i, text, "en", ["a", "b", "c", None][i % 4], len(text)))
        if i % 5 == 0:
            near = text.split()
            near[1] = "other"
            rows.append((i + 1000, " ".join(near), "en", "b", len(text)))
        labels.append((i, 1, int(toxic)))
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).withColumn("_words", F.lit(7)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, functions = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("quality rules", "toxicity", "near duplicates", "mixing", "packing")

    before = docs.collect()
    judged = repetition.judge(pd.DataFrame([repetition.measure(r["text"]) for r in before], columns=repetition.COLUMNS))
    quality = functions[0](spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in quality.collect()) == sorted(r["doc_id"] for r, k in zip(before, judged["kept"], strict=True) if k) and quality.columns == docs.columns

    model = toxicity.learn(quality, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    a = model.automaton()
    clean = functions[1](spark, quality, sf_dir)
    expect = [r["doc_id"] for r in quality.collect() if model.score(np.array([model.density(r["text"], a)]))[0] < toxicity.THRESHOLD]
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(expect) and all("grumbo" not in r["text"] for r in clean.collect())

    rows = {r["doc_id"]: r["text"] for r in clean.collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows.items()}
    dropped = {b for a in rows for b in rows if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    single = functions[2](spark, clean, sf_dir)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(rows.keys() - dropped) and dropped

    mixed = functions[3](spark, single, sf_dir).collect()
    total = sum(len(WORD.findall(r["text"])) for r in single.collect())
    assert sum(len(WORD.findall(r["text"])) for r in mixed) == pytest.approx(total, abs=4)
    assert all(r["_words"] == 7 and r["n_chars"] == len(r["text"]) for r in mixed)
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3

    pieces = corpus_pipeline.run(spark, sf_dir)
    t = tokens.encoder(tokens.vocabulary("word_bpe_49k.json")).tokenizer
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_tables(spark, sf_dir):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a " * 60, None, None, 1), (5, " ".join(f"w{i}" for i in range(90)), None, None, None), (5, " ".join(f"w{i}" for i in range(90)), None, None, None)], SCHEMA)
    for table in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, sf_dir).count() <= 4 * 3


def test_one_of_each_with_null_and_repeated_ids(spark, sf_dir):
    a, b = [f"a{i}" for i in range(90)], [f"b{i}" for i in range(90)]
    near = lambda words, i: " ".join([*words[:-1], f"n{i}"])
    c, d, e = (" ".join(f"{x}{i}" for i in range(90)) for x in "cde")
    texts = [
        (None, " ".join(a)), (None, " ".join(a)), (7, near(a, 1)), (8, near(a, 2)),  # an id goes before none
        (None, c), (None, c), (None, c + " more"),  # no ids at all
        (1, " ".join(b)), (1, " ".join(b)), (1, near(b, 1)), (2, near(b, 2)),  # rows alike, and another text of the id
        (3, d), (4, e), (4, near(d.split(), 1)), (4, e),  # an id kept for one text, not for its other
        (5, d.upper()), (6, ""), (6, ""), (None, None),
    ]
    table = spark.createDataFrame([(i, t, str(n), None, n) for n, (i, t) in enumerate(texts)], SCHEMA).repartition(3)
    sets = [frozenset(tuple((t or "").lower().split()[k : k + 5]) for k in range(max(0, len((t or "").split()) - 4))) for _, t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for x, one in enumerate(sets):
            for y, two in enumerate(sets):
                if one and two and 100 * len(one & two) >= 80 * len(one | two):
                    root[x] = root[y] = min(root[x], root[y])
    got = corpus_pipeline.one_of_each(spark, table, sf_dir)
    rows = [(r["n_chars"], r["doc_id"], r["text"]) for r in got.collect()]
    assert got.columns == table.columns and all(texts[n] == (i, t) for n, i, t in rows)
    assert sorted(root[n] for n, _, _ in rows) == sorted(set(root))
    for n, i, _ in rows:
        ids = [texts[m][0] for m in range(len(texts)) if root[m] == root[n]]
        assert i == min((x for x in ids if x is not None), default=None)
