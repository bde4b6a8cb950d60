"""Many small groups in few Python calls: Spark deals and sorts the rows, a task walks through its groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Group = dict[str, list]


def parts_for(spark: SparkSession, rows: int, each: int = 2_000_000) -> int:
    """Parts of at most `each` rows on average, and no fewer than the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, Group]]:
    """(key, columns) of each run of rows with equal keys; a run may go on in the next batch."""
    held_key, held = None, None
    for batch in batches:
        if batch.empty:
            continue
        columns = {c: batch[c].tolist() for c in batch.columns}
        at = list(zip(*[columns[k] for k in keys], strict=True))
        start = 0
        for end in range(1, len(at) + 1):
            if end < len(at) and at[end] == at[start]:
                continue
            part = {c: v[start:end] for c, v in columns.items()}
            if held is not None and held_key == at[start]:
                for c, v in part.items():
                    held[c] += v
            else:
                if held is not None:
                    yield held_key, held
                held_key, held = at[start], part
            start = end
    if held is not None:
        yield held_key, held


def map_groups(df: DataFrame, keys: list[str], order: list, function: Callable[[tuple, Group], list[tuple]], schema: str, flush: int = 20_000) -> DataFrame:
    """function(key, columns) -> rows, for each group of keys with its rows in order. Only one group is held at a time."""
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    whole = {c.split()[0].strip("`") for c in schema.split(", ") if c.split()[1] in ("int", "long", "bigint")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []

        def table() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names, dtype=object)
            return out.astype({c: "Int64" for c in whole})

        for key, columns in runs(batches, keys):
            rows += function(key, columns)
            if len(rows) >= flush:
                yield table()
                rows.clear()
        if rows:
            yield table()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """For each row but the first, whether its keys differ from those before it; null is like null."""
    out = np.zeros(max(0, rows.num_rows - 1), bool)
    for k in keys:
        at = rows[k].combine_chunks().dictionary_encode("encode")
        at = (at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at).indices.to_numpy()
        out |= at[1:] != at[:-1]
    return out


def map_arrays(df: DataFrame, keys: list[str], order: list, function: Callable[[np.ndarray, pa.Table], pa.Table], schema: str) -> DataFrame:
    """function(number of each row's group, rows) -> rows, for many whole groups at once, with their rows in order.

    A task takes all groups that end in a batch as columns, and holds the last one until the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            yield from function(np.append(0, np.cumsum(_starts(rows, keys))), rows).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            seam = [held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch]
            at = np.flatnonzero(_starts(pa.Table.from_batches(seam), keys)) + (0 if held else 1)
            if not len(at):
                held.append(batch)
                continue
            held.append(batch.slice(0, at[-1]))
            yield from done()
            held = [batch.slice(at[-1])]
        if held:
            yield from done()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
