"""Folds of a state over each key's rows in order, dealt by ranges: a key may fill many ranges, and each is a task.

Every range is walked at once from a guessed entry state, the one that a key begins with. Only its end state comes to the
driver, one row for each range. Where a key goes on from one range to the next, the end of the first is the entry of the
second; ranges whose entry was guessed wrong are walked again, until all entries hold. A machine that forgets how a range
began, as claims and leases do, settles in two or three rounds; one that never does takes a round for each range that a
single key fills, each of which walks that range alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platehouse.functions.scratch import staged

State = tuple
#: (state, row) -> (state, output or None); a row is a tuple of all columns in order.
Step = Callable[[State, tuple], tuple[State, tuple | None]]
FLUSH_ROWS = 20_000


@dataclass(frozen=True)
class Machine:
    """A state that a key begins with, what a row does to it, and what is returned of a key's last state (if anything).

    A step may change its state in place if thaw makes one anew from what JSON carries, and freeze turns it into that.
    """

    start: State
    step: Step
    schema: str
    end: Callable[[tuple, State], tuple] | None = None
    thaw: Callable = lambda state: state
    freeze: Callable = lambda state: state


def _walk(batches: Iterator[pd.DataFrame], machine: Machine, width: int, entry: State, goes_on: bool, emit: bool) -> Iterator[tuple | None]:
    """Outputs of one range; last of all (first key, last key, end state) unless outputs are emitted."""
    first = key = None
    state = machine.thaw(entry)
    for batch in batches:
        for row in zip(*[batch[c].astype(object).where(batch[c].notna(), None) for c in batch.columns], strict=True):
            if row[:width] != key:
                if key is not None:
                    if emit and machine.end:
                        yield machine.end(key, state)
                    state = machine.thaw(machine.start)
                key = row[:width]
                first = key if first is None else first
            state, out = machine.step(state, row)
            if emit and out is not None:
                yield out
    if key is not None and not emit:
        yield first, key, machine.freeze(state)
    elif key is not None and machine.end and not goes_on:
        yield machine.end(key, state)


def fold(rows: DataFrame, keys: list[str], order: list[str], machine: Machine, ranges: int | None = None) -> DataFrame:
    """The machine's outputs over rows, whose columns it takes as keys, order and then the others.

    Keys are not null. Rows alike in keys and order follow each other by a hash of all columns, so a rerun returns the
    same. Columns must be numbers, texts, booleans or times; a state must be one that JSON can carry.
    """
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in rows.columns if c not in {*keys, *order}]
    tie = F.xxhash64(*rows.columns)
    dealt = rows.select(*keys, *order, *rest).repartitionByRange(n, *keys, *order, tie).sortWithinPartitions(*keys, *order, tie)
    dealt = staged(dealt.withColumn("_n", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_n", 33).cast("int")), "ranges")
    width, columns = len(keys), [c for c in dealt.columns if c not in ("_n", "_part")]
    sorted_ = lambda some: some.repartitionById(n, F.col("_part")).sortWithinPartitions("_n").select("_part", *columns)

    def ends(batches: Iterator[pd.DataFrame], entries: dict[int, State]) -> Iterator[pd.DataFrame]:
        part, batches = _peeked(batches)
        if part is not None:
            first, last, state = next(x for x in _walk(batches, machine, width, entries.get(part, machine.start), False, False))
            yield pd.DataFrame({"part": [part], "first": [json.dumps(first, default=str)], "last": [json.dumps(last, default=str)], "state": [json.dumps(state)]})

    found: dict[int, tuple] = {}
    entries: dict[int, State] = {}
    todo: list[int] | None = None
    while todo is None or todo:
        some = dealt if todo is None else dealt.where(F.col("_part").isin(todo))
        now = dict(entries)
        for r in sorted_(some).mapInPandas(lambda b, now=now: ends(b, now), "part int, first string, last string, state string").collect():  # a row for each range
            found[r["part"]] = (r["first"], r["last"], _tuple(json.loads(r["state"])))
        parts = sorted(found)
        goes_on = {a for a, b in zip(parts, parts[1:], strict=False) if found[a][1] == found[b][0]}
        wanted = {b: found[a][2] for a, b in zip(parts, parts[1:], strict=False) if a in goes_on}
        # A new entry changes what a range ends with only if one key fills it.
        todo = [p for p, state in wanted.items() if entries.get(p, machine.start) != state and found[p][0] == found[p][1]]
        entries = wanted

    def outputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, batches = _peeked(batches)
        held: list[tuple] = []
        names = [c.split()[0] for c in machine.schema.split(", ")]
        whole = {c.split()[0]: "Int64" for c in machine.schema.split(", ") if c.split()[1] in ("int", "long", "bigint")}
        table = lambda: pd.DataFrame(held, columns=names, dtype=object).astype(whole)
        if part is not None:
            for out in _walk(batches, machine, width, entries.get(part, machine.start), part in goes_on, True):
                held.append(out)
                if len(held) >= FLUSH_ROWS:
                    yield table()
                    held.clear()
        if held:
            yield table()

    return sorted_(dealt).mapInPandas(outputs, machine.schema)


def _peeked(batches: Iterator[pd.DataFrame]) -> tuple[int | None, Iterator[pd.DataFrame]]:
    """The range that a task has, and its batches without that column."""
    first = next((b for b in batches if len(b)), None)
    if first is None:
        return None, iter(())

    def rest() -> Iterator[pd.DataFrame]:
        yield first.drop(columns="_part")
        for batch in batches:
            yield batch.drop(columns="_part")

    return int(first["_part"].iloc[0]), rest()


def _tuple(x):
    return tuple(map(_tuple, x)) if isinstance(x, list) else x
