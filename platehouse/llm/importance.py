"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k sampling.

A text's log weight is the sum, over its words and word pairs, of the log ratio of their buckets' probabilities under the
target's and under all raw text. Adding independent Gumbel noise and taking the k largest draws k documents without
replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platehouse.llm.shared import in_order, offsets, staged

#: Buckets of hashed n-grams, which bound what the driver gets; target rows that are learned from at most.
BUCKETS, TARGET_ROWS = 1 << 14, 20_000
#: Share of all documents that is drawn.
SHARE = 0.85
_KEPT_WORDS = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 3)
        return value


_WORD_HASHES = _WordHashes()


def buckets_of(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's words and of its pairs of neighbouring words, in lower case (ASCII)."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * _MULTIPLIER + h[1:]) * _MULTIPLIER
    return (np.concatenate((h, pairs ^ pairs >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, chosen in zip(batch["text"], batch["target"], strict=True):
            n = np.bincount(buckets_of(text), minlength=BUCKETS)
            raw += n
            if chosen:
                target += n
    yield pd.DataFrame({"bucket": np.arange(BUCKETS), "raw": raw, "target": target})


def log_ratios(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS) -> np.ndarray:
    """For each bucket: log of its probability in target text over that in all text (one is added to each count).

    Target text: documents labelled quality 1, at most `rows` of them, those of least hash of doc_id. All documents count
    as raw text. Without target rows every ratio is that of even buckets to raw text.
    """
    good = labels.where("doc_id IS NOT NULL AND quality = 1").select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string"))).limit(rows)
    marked = docs.select("doc_id", "text").join(F.broadcast(good.withColumn("_good", F.lit(True))), "doc_id", "left").select("text", F.coalesce("_good", F.lit(False)).alias("target"))
    found = marked.mapInPandas(_counts, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in found:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = 11) -> DataFrame:
    """doc_id, log_weight, key (with noise), place (0 is the largest key) and selected (place < share of all rows).

    Null and empty texts have log weight 0. The noise comes from a hash of doc_id and text, so runs agree and rows alike
    in both have equal keys; which of them comes first cannot be told from outside. Columns besides doc_id and text
    are not read.
    """
    ratios = log_ratios(docs, labels)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weight, noise = [], []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                weight.append(float(ratios[buckets_of(text)].sum()))
                u = (xxhash.xxh64_intdigest(f"{'' if pd.isna(doc) else int(doc)}\x00{text or ''}", seed) + 0.5) / 2**64
                noise.append(-np.log(-np.log(min(u, 1 - 1e-16))))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "log_weight": weight, "key": np.add(weight, noise)})

    keyed = staged(docs.select("doc_id", "text").mapInPandas(weigh, "doc_id long, log_weight double, key double"), "weights")
    n = keyed.count()
    ordered = in_order(keyed.withColumn("_down", -F.col("key")), ["_down", "doc_id", "log_weight"], "drawn")
    ahead = offsets(ordered.withColumn("_one", F.lit(1)), [], "_one")
    place = F.col("pos") + F.col("before")
    return ordered.join(ahead, "part").select("doc_id", "log_weight", "key", place.alias("place"), (place < round(share * n)).alias("selected"))
