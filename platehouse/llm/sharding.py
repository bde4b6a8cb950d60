"""Sharding: the smallest capacity for which ordered atomic groups fit into so many contiguous shards.

Groups are documents of equal text, ordered by the hash of the text; a group that outweighs an even part comes before all
others and has a shard of its own. A capacity is feasible if the greedy fill, each shard taking groups until the next would
not fit, needs no more shards than there are; binary search finds the smallest. Under it the shards are cut as evenly as
groups allow: each aims at its part of what is left, as far as the rest still fits into the shards behind it.
The driver never sees all groups: it starts from sums over equal slices of the hash's range (cells) and asks only for
the insides of cells in which a cut can lie, until those hold one group each.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platehouse.llm.shared import in_order, offsets, staged

#: A cell is split into 2**STEP parts each time; the first cells are 2**FIRST slices. Both bound what the driver gets.
FIRST, STEP = 12, 6
_LOW, _BITS = -(1 << 63), 64

Cell = tuple[int, int, int, int]  # first key, bits of width, bytes, groups


def _ends(cells: list[Cell]) -> list[int]:
    total, out = 0, []
    for cell in cells:
        total += cell[2]
        out.append(total)
    return out


def _cuts(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Numbers of cells before each cut of the greedy fill; None if the shards don't hold all."""
    at, cuts = 0, []
    for _ in range(shards):
        if at == len(ends):
            break
        after = bisect_right(ends, (ends[at - 1] if at else 0) + capacity, at)
        if after == at:
            return None
        at = after
        cuts.append(at)
    return cuts if at == len(ends) else None


def smallest_capacity(sizes_so_far: list[int], shards: int, low: int) -> int:
    """The smallest feasible capacity from `low` on, for the running sums of ordered atomic sizes."""
    high = max(sizes_so_far[-1], low)
    while low < high:
        middle = (low + high) // 2
        if _cuts(sizes_so_far, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return high


def _active(cells: list[Cell], ends: list[int], low: int, high: int, shards: int) -> list[int]:
    """Cells of several groups in which a cut may lie for a capacity between low and high."""
    out: set[int] = set()
    behind = ahead = 0  # bytes before the earliest and the latest place of a cut
    for _ in range(shards):
        first = bisect_right(ends, behind + low)  # a cell is taken whole or not at all: the cut can't lie earlier
        behind = max(behind, ends[first - 1] if first else 0)
        ahead = min(ahead + high, ends[-1])
        last = bisect_right(ends, ahead)
        out.update(i for i in range(first, min(last, len(cells) - 1) + 1) if cells[i][3] > 1 and cells[i][1] > 0)
    return sorted(out)


def _within(key: str, cells: list[Cell]) -> Column:
    """Is the key in one of the cells? Neighbours are joined into stretches first."""
    stretches: list[list[int]] = []
    for first, bits, _, _ in cells:
        if stretches and stretches[-1][1] == first - 1:
            stretches[-1][1] = first + (1 << bits) - 1
        else:
            stretches.append([first, first + (1 << bits) - 1])
    return F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in stretches]), lambda x: F.col(key).between(x["a"], x["b"]))


def _split(groups: DataFrame, bits: int) -> list[Cell]:
    """Cells of 2**bits keys: their bytes and groups. At most as many rows as the caller's cells have parts."""
    rows = groups.groupBy(F.shiftright("key", bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).orderBy("cell").collect()
    return [(r["cell"] << bits, bits, r["bytes"], r["n"]) for r in rows]


def _refined(groups: DataFrame, cells: list[Cell], active: list[int]) -> list[Cell]:
    """The cells with the active ones split."""
    inner: dict[int, list[Cell]] = {}
    for b in sorted({cells[i][1] for i in active}):
        of_width = [cells[i] for i in active if cells[i][1] == b]
        for cell in _split(groups.where(_within("key", of_width)), max(0, b - STEP)):
            inner.setdefault(cell[0] >> b << b, []).append(cell)
    chosen = {cells[i][0] for i in active}
    return [x for c in cells for x in (inner[c[0]] if c[0] in chosen else [c])]


def _even_cuts(cells: list[Cell], capacity: int, shards: int) -> tuple[list[int], list[int]]:
    """Numbers of cells before each cut, and the cells of several groups that must be split before the cuts are sure.

    Each shard takes one cell at least and ends at the cut nearest to its part of the bytes that are left, but not before
    the rest fits into the shards that are left, and not beyond the capacity.
    """
    ends, n = _ends(cells), len(cells)
    several = lambda i: i < n and cells[i][3] > 1 and cells[i][1] > 0
    earliest, at = [(n, n)], n  # for so many last shards: the earliest place where they can begin, and the cell before it
    for _ in range(shards):
        start = (ends[at - 1] if at else 0) - capacity
        first = bisect_left(ends, start) + 1 if start > 0 else 0
        at = min(first, at)
        earliest.append((at, at - 1 if at and ends[at - 1] > start else n))
    cuts, unsure, at = [], set(), 0
    for left in range(shards - 1, 0, -1):
        behind = ends[at - 1] if at else 0
        target = behind + (ends[-1] - behind) // (left + 1)
        over = min(bisect_left(ends, target), n - 1)
        near = over + 1 if over < at or 2 * target >= ends[over] + (ends[over - 1] if over else 0) else over
        if ends[over] != target and several(over):
            unsure.add(over)
        most, (least, before) = bisect_right(ends, behind + capacity), earliest[left]
        if max(near, at + 1) > most and several(most):
            unsure.add(most)
        if near < least and several(before):
            unsure.add(before)
        at = max(min(max(near, least, at + 1), max(most, at + 1), n - left), at)
        cuts.append(at)
    return cuts, sorted(unsure)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """The first key of each shard but the first, and the smallest capacity. groups has key (long, unique) and bytes.

    Fewer groups than shards leave the last shards empty.
    """
    cells = _split(groups, _BITS - FIRST)
    if not cells:
        return [], 0
    while sum(c[3] for c in cells) <= 1 << FIRST and (wide := [i for i, c in enumerate(cells) if c[3] > 1 and c[1] > 0]):
        cells = _refined(groups, cells, wide)  # so few groups are looked at one by one
    largest = groups.agg(F.max("bytes")).first()[0]
    while True:
        ends = _ends(cells)
        floor = max(largest, -(-ends[-1] // shards))
        high = smallest_capacity(ends, shards, max(floor, max(c[2] for c in cells)) if len(cells) == 1 else floor)
        wide = max((c[2] for c in cells if c[3] > 1), default=0)
        active = _active(cells, ends, max(floor, high - wide), high, shards)
        if not active:
            break
        cells = _refined(groups, cells, active)
    while True:
        cuts, unsure = _even_cuts(cells, high, min(shards, len(cells)))
        if not unsure:
            return [cells[i][0] for i in cuts], high
        cells = _refined(groups, cells, unsure)


def _outweighing(groups: DataFrame, shards: int) -> dict[int, int]:
    """Key -> bytes of the groups that outweigh an even part of what is left beside larger ones; fewer than shards, or all."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    out: dict[int, int] = {}
    for key, size in groups.orderBy(F.desc("bytes"), "key").limit(shards).select("key", "bytes").collect():
        if len(out) < shards and size * (shards - len(out)) > total:
            out[key] = size
            total -= size
        else:
            break
    return out


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Put every document into a shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A document's size is its text's UTF-8 bytes (null: none) plus 8. Documents of equal text stay together (null is a
    text of its own); one text that outweighs a shard's even part has a shard for itself, and the others share the rest
    evenly. Slots follow the order of hash,
    doc_id and size; rows alike in all of these may swap slots, which no reader can tell. Null doc_ids come first within
    their text. Fewer groups than shards leave the last shards empty. No column besides doc_id and text is read.
    """
    spark = docs.sparkSession
    base = staged(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.when(F.col("text").isNull(), F.lit(_LOW)).otherwise(F.xxhash64("text")).alias("key")), "sizes")
    groups = staged(base.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    heavy = _outweighing(groups, shards)
    others = groups.where(~F.col("key").isin(*heavy)) if heavy else groups
    cuts, capacity = minimax_cuts(others, shards - len(heavy)) if len(heavy) < shards else ([], 0)
    capacity = max([capacity, *heavy.values()])
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    number = number + len(heavy)
    for i, key in enumerate(sorted(heavy)):
        number = F.when(F.col("key") == key, i).otherwise(number)
    ordered = in_order(base.withColumn("shard", number.cast("int")), ["shard", "key", "doc_id", "size"], "shards")
    ahead = offsets(ordered.withColumn("one", F.lit(1)), ["shard"], "one")  # a row for each partition and shard
    return ordered.join(ahead, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("pos") - F.col("first") + F.col("before")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"))
