"""Document fingerprints from closed syncmers: k-mers whose least inner s-mer stands at their first or last place.

Whether a k-mer is chosen depends on its own characters only, so texts that share a passage choose the same anchors in
it wherever it stands. A fingerprint keeps the anchors of least hash with their places; two fingerprints are alike as far
as the least anchors of both together are common to both and stand at a steady distance. For passages shared by long texts,
of whose anchors a fingerprint keeps few, anchor_table gives every anchor of every text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platehouse.llm.shared import number_below, partitions, quantiles, staged

#: k-mers and s-mers of all texts, however long, so that any two fingerprints can be compared; anchors that one keeps.
K, S, KEPT = 8, 3, 96
#: Places may shift by so many characters beside the usual shift, and by this share of the place.
SLACK, SLACK_SHARE = 64, 1 / 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _B
    return x ^ (x >> np.uint64(29))


def anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers of an array of code points; a text shorter than K is one anchor."""
    return syncmers(points, K, S)


def syncmers(points: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(points)
    x = points.astype(np.uint64) + np.uint64(1)
    if n < k:
        whole = n
        for v in x.tolist():
            whole = (whole * int(_A) + v) % (1 << 64)
        return _mix(np.array([whole] * bool(n), np.uint64)), np.zeros(min(n, 1), np.int64)
    small = np.zeros(n - s + 1, np.uint64)
    for i in range(s):
        small = small * _A + x[i : n - s + 1 + i]
    small = _mix(small)
    inner = k - s + 1  # s-mers in a k-mer
    low, width = small, 1
    while width < inner:  # the least of ever wider stretches
        step = min(width, inner - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    at = np.flatnonzero((small[: len(low)] == low) | (small[inner - 1 :] == low))
    # a k-mer is told by the s-mers that cover it
    h = small[at] * _A
    for i in range(s, inner, s):
        h = (h + small[at + i]) * _A
    return _mix(h + small[at + inner - 1]), at


def sketch(hashes: np.ndarray, places: np.ndarray, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of least hash, each hash at its first place, in order of hash."""
    if len(hashes) > 4 * kept:
        near = np.partition(hashes, 4 * kept)[4 * kept]
        some = np.flatnonzero(hashes <= near)
        if len(np.unique(hashes[some])) >= kept:
            hashes, places = hashes[some], places[some]
    values, first = np.unique(hashes, return_index=True)
    return values[:kept], places[first[:kept]]


def as_text(values: np.ndarray, places: np.ndarray) -> str:
    """Sixteen hexadecimal digits of hash and the place, for each anchor."""
    return " ".join(f"{v:016x}@{p}" for v, p in zip(values.tolist(), places.tolist(), strict=True))


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = [x.split("@") for x in fingerprint.split()]
    return np.array([int(v, 16) for v, _ in pairs], np.uint64), np.array([int(p) for _, p in pairs], np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], kept: int = KEPT) -> float:
    """0 to 1: of the least anchors of both together, how many both have, their places shifted about as the median is.

    Two empty fingerprints are alike (1), an empty one and another are not (0).
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    least = np.union1d(a[0], b[0])[:kept]
    common, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    chosen = common <= least[-1]
    if not chosen.any():
        return 0.0
    places, shift = a[1][in_a][chosen], b[1][in_b][chosen] - a[1][in_a][chosen]
    steady = np.abs(shift - np.median(shift)) <= SLACK + SLACK_SHARE * places
    return float(np.count_nonzero(steady) / len(least))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _edited(points: np.ndarray, following: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The edited text and its anchors. Anchors that end before the cut are the text's own: only the rest is new."""
    n = len(points)
    cut = n - n // 4
    edited = np.concatenate((points[:cut], following[: n // 4]))
    if cut < 2 * K:
        return edited, anchors(edited)
    hashes, places = own
    kept, back = places <= cut - K, cut - K + 1
    if len(edited) - back < K:
        return edited, (hashes[kept], places[kept])
    late_hashes, late_places = anchors(edited[back:])
    return edited, (np.concatenate((hashes[kept], late_hashes)), np.concatenate((places[kept], late_places + back)))


#: Rows of the result that go to Spark at once.
_ROWS = 1_000


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (block, copy, doc_id, text) in order of block, own documents before a copy of the next block's first: each own
    document against the one that follows it. Without a copy a block is a ring. Only a block's first document and the one
    before the row at hand are held."""
    block = first = held = None
    rows: list[tuple] = []

    def done(following: tuple) -> None:
        doc, points, found, print_ = held
        edited, fresh = _edited(points, following[1], found)
        after = sketch(*fresh)
        rows.append((doc, len(points), hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest(), as_text(*print_), as_text(*after), likeness(print_, after), likeness(print_, following[3])))

    def table() -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        rows.clear()
        return out.astype({"doc_id": "Int64"})

    for batch in batches:
        for this, copy, doc, text in zip(batch["block"], batch["copy"], batch["doc_id"], batch["text"], strict=True):
            if this != block:
                if held is not None:
                    done(first)
                block, first, held = this, None, None
            if copy and held is None:
                continue  # a copy that stands several times counts once
            points = _points(text)
            found = anchors(points)
            now = (None if pd.isna(doc) else int(doc), points, found, sketch(*found))
            if held is not None:
                done(now)
            first, held = first or now, None if copy else now
            if len(rows) >= _ROWS:
                yield table()
    if held is not None:
        done(first)
    if rows:
        yield table()


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    The edited text has its last floor(n / 4) characters replaced by the first as many, or all, of the next document's
    text in order of doc_id (of one doc_id: in order of the text's hash); after the last comes the first. Neighbours meet
    because documents are dealt into blocks of neighbours, each with a copy of the next block's first document. A doc_id
    that fills several blocks is cut by its texts' hashes. Likeness is that of the fingerprints as returned, so anybody can
    compare two rows of the result; anchor_table gives all anchors. Null text is the empty text. A task walks its blocks row
    by row and holds two texts. Documents with a null doc_id follow one another, in rings dealt by hash, as many as their share of all
    rows has blocks. Other columns are not read. The text is shuffled once.
    """
    n = 4 * partitions(docs.sparkSession)
    starts, rings = quantiles(docs, "doc_id", n)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    below, upto = (number_below(F.col("doc_id"), starts, or_equal) for or_equal in (False, True))
    share = F.col("tie") / F.lit(2.0**64) + 0.5  # 0 to 1 in order of the hash
    own = F.when(upto - below > 1, below + F.least(upto - below - 1, F.floor((upto - below) * share))).otherwise(upto - 1)
    rows = rows.withColumn("block", F.when(F.col("doc_id").isNull(), -1 - F.pmod("tie", F.lit(max(rings, 1)))).otherwise(own).cast("int"))
    # a row for each block: its first document goes to the block before it, too
    firsts = rows.where("block >= 0").groupBy("block").agg(F.min(F.struct("doc_id", "tie")).alias("_f"))
    ring = Window.orderBy("block")
    before = F.coalesce(F.lag("block").over(ring), F.max("block").over(Window.partitionBy()))
    firsts = staged(firsts.select("block", "_f.doc_id", "_f.tie", before.alias("_before")), "firsts")
    marked = rows.join(F.broadcast(firsts), ["block", "doc_id", "tie"], "left")  # at most 4 * partitions rows
    own, copy = F.struct(F.col("block"), F.lit(False).alias("copy")), F.struct(F.col("_before").alias("block"), F.lit(True).alias("copy"))
    dealt = marked.select("doc_id", "text", "tie", F.inline(F.when(F.col("_before").isNotNull(), F.array(own, copy)).otherwise(F.array(own))))
    walked = dealt.repartition("block").sortWithinPartitions("block", "copy", "doc_id", "tie").select("block", "copy", "doc_id", "text")
    return walked.mapInPandas(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


#: Anchors that go to Spark at once, about.
_TABLE_ROWS = 200_000


def anchor_table(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, hash and place of every anchor of every text, all texts cut by one k and s.

    A hash is the 64 bits of a fingerprint's sixteen digits as a signed number. A text shorter than k is one anchor; null
    and empty texts have none, and texts of less than 2 k - s - 1 characters may have none. Each row of docs gives its
    own anchors, repeated and null doc_ids too. Rows grow as the characters, 2 / (k - s + 1) for each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table() -> pd.DataFrame:
            n = [len(h) for _, h, _ in held]
            ids = pd.array([None if pd.isna(d) else int(d) for d, _, _ in held], dtype="Int64")
            return pd.DataFrame({"doc_id": ids.repeat(n), "hash": np.concatenate([h for _, h, _ in held]).view(np.int64), "place": np.concatenate([p for _, _, p in held])})

        held, rows = [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                hashes, places = syncmers(_points(text or ""), k, s)
                held.append((doc, hashes, places))
                rows += len(hashes)
                if rows >= _TABLE_ROWS:
                    yield table()
                    held, rows = [], 0
        if held:
            yield table()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, hash long, place long")
