"""Hierarchical packing: documents are routed to context-size tiers, each tier is packed, gaps in long windows are
filled from shorter tiers, and windows are gathered into step groups of equal tokens."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from itertools import cycle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from platehouse.llm.tokens import encoder

#: Context sizes, all powers of two: a full window needs no padding; the longest is the one that others are padded to.
TIERS = (4096, 2048, 1024, 512, 256)
#: Windows are packed within so many tokens of neighbouring documents, which bounds memory and padding.
BLOCK_TOKENS = 1 << 21
#: Chunks whose ids a worker keeps: few, since the pipeline's workers hold other stages' words too.
KEPT_CHUNKS = 500_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

Piece = tuple[int, int, int]  # document, first id, ids


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows (tier, pieces) for documents of so many ids; every id lies in one piece.

    A document is routed to the longest tier that it fills at least once, or else the shortest, and waits there. Each
    tier, the longest first, lays its documents end to end, cutting at window borders. A gap at the end of the tier's
    last window is filled from shorter tiers, the longest pieces first; where even those run out, what lies in the
    unfinished window goes down to the next tier. Only ids that fill no shortest window are left: they form one last
    window, which is padded to the longest size.
    """
    waiting: dict[int, deque[Piece]] = {t: deque() for t in tiers}
    for doc, n in enumerate(lengths):
        if n:
            waiting[next((t for t in tiers if n >= t), tiers[-1])].append((doc, 0, n))
    out: list[tuple[int, list[Piece]]] = []
    for i, tier in enumerate(tiers):
        queue, window, room = waiting[tier], [], tier
        while True:
            while queue:
                doc, start, n = queue.popleft()
                take = min(n, room)
                window.append((doc, start, take))
                room -= take
                if not room:
                    out.append((tier, window))
                    window, room = [], tier
                if n > take:
                    queue.appendleft((doc, start + take, n - take))
            if not window:
                break
            filler = next((waiting[t] for t in tiers[i + 1 :] if waiting[t]), None)
            if filler is not None:
                queue.append(filler.popleft())
                continue
            if i + 1 < len(tiers):
                waiting[tiers[i + 1]].extend(window)
            else:
                out.append((tiers[0], window))
            break
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = 8 * 4096) -> DataFrame:
    """Pieces of all documents in packed sequences, in one pass without a shuffle.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; tier is the size that its sequence is
    padded to, step_group a set of windows of one tier and at most step_tokens tokens in all; the groups of a block's tier
    differ by one window at most. A task packs blocks of neighbouring rows, so sequence_id is its partition, its block and the window's number;
    each block pads one sequence at most. Null text is the empty text, whose only id is end_id. Repeated rows and null
    doc_ids are packed as any others; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, first, group = encoder(tokenizer, KEPT_CHUNKS), TaskContext.get().partitionId() << 36, TaskContext.get().partitionId() << 36
        held: list[tuple[object, np.ndarray]] = []
        tokens = 0

        def packed() -> pd.DataFrame:
            nonlocal first, group, tokens
            data = [ids.astype("<u4").tobytes() for _, ids in held]
            windows = pack_lengths([len(ids) for _, ids in held], tiers)
            rows, fresh, steps = [], group, {}
            for t in tiers:  # a tier's windows go round its groups, which differ by one window at most
                n = sum(tier == t for tier, _ in windows)
                groups = -(-n * t // step_tokens)
                steps[t] = cycle(range(fresh, fresh + groups)) if groups else None
                fresh += groups
            for number, (tier, pieces) in enumerate(windows):
                step = next(steps[tier])
                at = 0
                for doc, start, n in pieces:
                    rows.append((doc, start, n, zlib.crc32(data[doc][4 * start : 4 * (start + n)]), len(data[doc]) // 4, first + number, at, tier, step))
                    at += n
            out = pd.DataFrame(rows, columns=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])
            out["doc_id"] = pd.array([held[d][0] for d in out.pop("doc")], "Int64")
            first, group, tokens = int(out["sequence_id"].max()) + 1, fresh, 0
            held.clear()
            return out

        for batch in batches:
            for i in range(0, len(batch), 500):
                some = batch.iloc[i : i + 500]
                for doc, ids in zip(some["doc_id"], encode(["" if t is None else t for t in some["text"]], end_id), strict=True):
                    held.append((None if pd.isna(doc) else int(doc), ids))
                    tokens += len(ids)
                    if tokens >= BLOCK_TOKENS:
                        yield packed()
        if held:
            yield packed()

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
