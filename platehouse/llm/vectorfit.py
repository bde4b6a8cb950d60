"""Vector best-fit packing: pieces of documents go, the longest first, to the bin that suits them best among those that have
room for their tokens, for one more document and for their attention cost.

Pieces of one length are alike, so the bins are chosen for counts of lengths, of which there are at most as many as a
sequence has tokens: a histogram goes to the driver, and ranges of ranks within a length come back. Every document is
encoded once, and only small rows (a number, a length, a checksum for each piece) are written or shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platehouse.llm.shared import joined, staged
from platehouse.llm.tokens import encoder

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
_RANK_BITS = 42


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most. Attention costs the square of a piece's length, as documents do not see each other.

    The last two are as wide as `tokens` allows unless given: a sequence then holds as many documents as fit.
    """

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None

    def limits(self) -> np.ndarray:
        wide = (self.tokens, self.documents or self.tokens, self.attention or self.tokens**2)
        if min(wide) < 1 or wide[2] < self.tokens**2 or self.tokens >= 1 << 20:
            raise ValueError("a sequence must hold a piece of its own length, of less than 2**20 tokens")
        return np.array(wide, np.int64)


#: (rule, weights of tokens, documents and attention) that are tried; the plan with the fewest sequences is taken.
RULES = (("norm", (1.0, 0.0, 0.0)), ("norm", (1.0, 0.1, 0.1)), ("dot", (1.0, 0.1, 0.1)))


@dataclass
class Plan:
    """Rows (length, from, to, first, each, base): of the pieces of a length, those of rank from..to go to bins from `first`
    on, `each` to a bin, where `base` tokens lie before them."""

    rows: np.ndarray
    sequences: int


def plan(counts: dict[int, int], capacity: Capacity, rule: str, weights: tuple[float, float, float]) -> Plan:
    """Best fit for `counts` pieces of each length, the longest first.

    A piece goes to the bin, of those with room under every limit, whose residual has the least weighted norm after it
    ("norm": such a bin takes as many as it can) or the greatest weighted dot-product with the piece ("dot"); a bin is
    opened only if none has room. Bins in the same state are held together, and so moved together.
    """
    limits, w = capacity.limits(), np.array(weights)
    used, first, many = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows: list[tuple[int, ...]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        need, at, total = np.array([length, 1, length**2], np.int64), 0, counts[length]
        while at < total:
            room = (limits - used) // need
            open_ = np.flatnonzero(room.min(axis=1) > 0)
            if not len(open_):
                each, state = int((limits // need).min()), np.zeros(3, np.int64)
                start, bins = opened, -(-(total - at) // each)
                opened += bins
            else:
                left = (limits - used[open_]) / limits
                score = (w * (left - need / limits) ** 2).sum(axis=1) if rule == "norm" else -(w * left * (need / limits)).sum(axis=1)
                best = open_[np.lexsort((first[open_], score))[0]]
                each, state, start, bins = int(room[best].min()) if rule == "norm" else 1, used[best].copy(), int(first[best]), int(many[best])
            full = min(bins, (total - at) // each)
            taken, each = (full, each) if full else (1, total - at)
            if len(open_):  # the chosen bins leave their group
                first[best] += taken
                many[best] -= taken
                if not many[best]:
                    used, first, many = (np.delete(x, best, axis=0) for x in (used, first, many))
            elif taken < bins:  # of the bins opened, one holds fewer
                opened -= bins - taken
            rows.append((length, at, at + taken * each, start, each, int(state[0])))
            at += taken * each
            state = state + each * need
            if ((limits - state) >= 1).all():
                used, first, many = np.vstack((used, state)), np.append(first, start), np.append(many, taken)
    return Plan(np.array(rows, np.int64).reshape(-1, 6), opened)


def best_plan(counts: dict[int, int], capacity: Capacity, rules=RULES) -> Plan:
    """The plan of the fewest sequences; of equals the first rule's."""
    return min((plan(counts, capacity, *r) for r in rules), key=lambda p: p.sequences)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, tokens: int) -> DataFrame:
    """Each document's pieces: those of more than `tokens` ids are cut so that the first piece alone is shorter.

    part is the task that encoded a piece, nth how many of its length that task had before it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, encode, seen = TaskContext.get().partitionId(), encoder(tokenizer), np.zeros(tokens + 1, np.int64)
        for batch in batches:
            for i in range(0, len(batch), 500):
                some, rows = batch.iloc[i : i + 500], []
                for doc, ids in zip(some["doc_id"], encode(["" if t is None else t for t in some["text"]], end_id), strict=True):
                    data, n = ids.astype("<u4").tobytes(), len(ids)
                    doc, end = None if pd.isna(doc) else int(doc), (n - 1) % tokens + 1
                    for piece, stop in enumerate(range(end, n + 1, tokens)):
                        start = max(0, stop - tokens)
                        rows.append((doc, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop]), part, int(seen[stop - start])))
                        seen[stop - start] += 1
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
                yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, _PIECES)


def place(cut: DataFrame, capacity: Capacity) -> DataFrame:
    """Sequences and offsets of staged pieces: their rank among all of their length, looked up in the plan."""
    counts = staged(cut.groupBy("part", "length").agg(F.count("*").alias("_n")), "lengths")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity.tokens rows at most
    found = best_plan(histogram, capacity)
    rows = found.rows[np.lexsort((found.rows[:, 1], found.rows[:, 0]))]
    keys = (rows[:, 0] << _RANK_BITS) + rows[:, 1]
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("part", "length", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), (batch["before"] + batch["nth"]).to_numpy(np.int64)
            row = rows[np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1] if len(rows) else np.zeros((0, 6), np.int64)
            bin_, slot = np.divmod(rank - row[:, 1], np.maximum(row[:, 4], 1))
            yield batch[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(doc_id=batch["doc_id"].astype("Int64"), sequence_id=row[:, 3] + bin_, offset=row[:, 5] + slot * length)

    return joined(cut, ahead, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "before", "nth").mapInPandas(run, SCHEMA)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: Capacity = Capacity()) -> DataFrame:
    """Every document's pieces with their sequence and the place there.

    Per piece: doc_id, piece, start (its document's ids before it), length, ids_crc32, sequence_id (gapless from 0), offset.
    Null text is the empty text, whose only id is end_id; null doc_ids and repeated rows are packed as any others; other
    columns are not read; an empty table has no sequences. doc_id must be a long without nulls only if callers need it so.
    """
    return place(staged(pieces(docs, tokenizer, end_id, capacity.tokens), "pieces"), capacity)
