"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A row x becomes (x, sqrt(M^2 - |x|^2)), M the greatest norm, and a query q becomes (q, 0); then |q' - x'|^2 is
|q|^2 + M^2 - 2 q.x. High scores are short distances, a window of scores is an annulus about the query, and a tree over
distances finds the rows of the annulus nearest first. The top of the tree, learned on a bounded sample, deals rows to
leaves; leaves are written as blocks, each with a tree of its own. Scores are integers and exact; distances only prune,
with a slack that their rounding can't pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platehouse.llm.shared import joined, small_batches, staged

SCALE, MOST_NORM2 = 256, float(1 << 56)
#: Rows that the top tree is learned on, its leaves at most, and rows that a leaf of it should have.
SAMPLE_ROWS, MOST_LEAVES, LEAF_ROWS = 16_384, 1024, 8_192
#: Rows of a block, and of a leaf of its tree.
BLOCK_ROWS, INNER_ROWS = 2_048, 128
#: Queries that a task matches with a block at once.
QUERY_ROWS = 1_024
POSITIVES, NEGATIVES = 5, 3
_LEAST, _MOST = -(1 << 62), 1 << 62


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v: each component times 256, rounded down; labels of ids divisible by 7 changed.

    Left out are rows with a null id, label, vector or component, one that is not finite, or a vector whose scores, times
    100, don't fit in a long (norm of 2^28 or more). Rows that share a vec_id are one: the least by label and vector.
    """
    x = F.transform("embedding", lambda c: c.cast("double") * SCALE)
    rows = embeddings.select("vec_id", "label", x.alias("x")).where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c)))
    rows = rows.where(F.aggregate("x", F.lit(0.0), lambda s, c: s + F.floor(F.greatest(F.lit(-3e9), F.least(F.lit(3e9), c))).cast("double") ** 2) < MOST_NORM2)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = rows.select("vec_id", F.struct(label.alias("label"), F.transform("x", lambda c: F.floor(c)).alias("v")).alias("_r"))
    return rows.groupBy("vec_id").agg(F.min("_r").alias("_r")).select("vec_id", "_r.label", "_r.v")


@dataclass
class Tree:
    """Vantage points over points of one norm. A node splits by a radius; children and leaves are numbers (leaf k is ~k).

    shells holds, for both children, the least and greatest distance of what lies there.
    """

    points: np.ndarray
    most_leaves: int
    leaf_rows: int
    closed: bool = True  # whether shells hold for all rows, or only the radius does, as where the points are a sample
    centres: list[int] = field(default_factory=list)
    radii: list[float] = field(default_factory=list)
    shells: list[list[tuple[float, float]]] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.root = self._split(np.arange(len(self.points)), self.most_leaves)

    def _split(self, rows: np.ndarray, leaves: int) -> int:
        near = _distances(self.points[rows], self.points[rows[:1]])[:, 0] if len(rows) else np.zeros(0)
        if leaves < 2 or len(rows) <= self.leaf_rows or near.max() <= near.min() + 1e-9:
            self.leaves.append(rows)
            return ~(len(self.leaves) - 1)
        centre = int(rows[np.argmax(near)])  # far from one row, so its shells cut well
        d = _distances(self.points[rows], self.points[[centre]])[:, 0]
        radius = float(np.median(d))
        if radius >= d.max():
            radius = float(d[d < d.max()].max())
        inside, node = d <= radius, len(self.centres)
        self.centres.append(centre)
        self.radii.append(radius)
        self.shells.append([(d[inside].min(), d[inside].max()), (d[~inside].min(), d[~inside].max())] if self.closed else [(0.0, radius), (radius, np.inf)])
        self.children.append([0, 0])
        self.children[node] = [self._split(rows[inside], leaves - leaves // 2), self._split(rows[~inside], leaves // 2)]
        return node

    def bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point and leaf: no row of the leaf is nearer than the first, none farther than the second."""
        low, high = np.zeros((len(points), len(self.leaves))), np.full((len(points), len(self.leaves)), np.inf)
        d = _distances(points, self.points[self.centres]) if self.centres else None
        todo = [(self.root, np.zeros(len(points)), np.full(len(points), np.inf))]
        while todo:
            node, lo, hi = todo.pop()
            if node < 0:
                low[:, ~node], high[:, ~node] = lo, hi
                continue
            for child, (least, most) in zip(self.children[node], self.shells[node], strict=True):
                todo.append((child, np.maximum(lo, np.maximum(d[:, node] - most, least - d[:, node])), np.minimum(hi, d[:, node] + most)))
        return low, high

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls in."""
        out, todo = np.zeros(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                inside = _distances(points[rows], self.points[[self.centres[node]]])[:, 0] <= self.radii[node]
                todo += [(self.children[node][0], rows[inside]), (self.children[node][1], rows[~inside])]
        return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T), 0))


@dataclass(frozen=True)
class Space:
    """The numbers of a vector and the greatest squared norm of all rows."""

    size: int
    norm2: int

    @property
    def slack(self) -> float:
        """Distances are computed to about 1e-8 of the greatest norm; pruning allows for a hundred times that."""
        return 1e-6 * (1 + self.norm2**0.5)

    def matrix(self, vectors) -> np.ndarray:
        """Vectors as rows; shorter ones end in zeros."""
        out = np.zeros((len(vectors), self.size), np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def numbers(self, x: np.ndarray) -> np.ndarray:
        """Doubles where all scores are whole numbers below 2^53, so that BLAS is exact, else long integers."""
        return x.astype(float) if self.norm2 < 1 << 53 else x

    def augmented(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x.astype(float)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(float(self.norm2) - (x**2).sum(axis=1), 0))
        return np.column_stack((x, last))

    def distance(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from a query rows of a score lie."""
        return np.sqrt(np.maximum((x.astype(float) ** 2).sum(axis=1) + float(self.norm2) - 2.0 * score, 0))


class Block:
    """Rows with a tree over them; `search` walks its leaves nearest first."""

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.space, self.tree = space, Tree(space.augmented(x, False), 1 << 30, INNER_ROWS)
        self.leaves = [(ids[r], labels[r], space.numbers(x[r])) for r in self.tree.leaves]

    def search(self, x: np.ndarray, labels: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of the first k rows of each query, by score and then the smaller id, among those with a score
        of lo to hi and the query's label (`same`) or another. A query is done when the next leaf lies beyond its annulus,
        whose outer edge draws in to the k-th row found."""
        space, n = self.space, len(x)
        low, high = self.tree.bounds(space.augmented(x, True))
        near, lo, numbers = space.distance(x, hi), lo.copy(), space.numbers(x)
        low = np.where(high < near[:, None] - space.slack, np.inf, np.maximum(low, near[:, None]))
        order = np.argsort(low, axis=1, kind="stable")
        found = (np.zeros(0, np.int64),) * 3
        for step in range(order.shape[1]):
            leaf = order[:, step]
            open_ = np.flatnonzero(low[np.arange(n), leaf] <= space.distance(x, lo) + space.slack)
            if not len(open_):
                break
            parts = [found]
            for this in np.unique(leaf[open_]):
                q, (ids, kinds, rows) = open_[leaf[open_] == this], self.leaves[this]
                score = (numbers[q] @ rows.T).astype(np.int64)
                i, j = np.nonzero((score >= lo[q][:, None]) & (score <= hi[q][:, None]) & ((kinds == labels[q][:, None]) == same))
                parts.append((q[i], score[i, j], ids[j]))
            found = _first(*(np.concatenate(c) for c in zip(*parts, strict=True)), k)
            full = np.flatnonzero(np.bincount(found[0], minlength=n) == k)
            last = np.searchsorted(found[0], full, "right") - 1
            lo[full] = np.maximum(lo[full], found[1][last])
        return found


def _first(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    place = np.arange(len(query)) - np.searchsorted(query, query, "left")
    return query[place < k], score[place < k], ids[place < k]


class Index:
    """Blocks of rows by leaf of the top tree, staged."""

    def __init__(self, rows: DataFrame):
        """rows: vec_id, label, v, staged. Of equal vectors of one label only the first ids can ever be returned, six for an
        anchor's positives (one may be itself) and three for negatives, so only those are kept."""
        first = Window.partitionBy("label", "v").orderBy("vec_id")
        kept = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= POSITIVES + 1).drop("_n")
        kept = staged(kept, "vectors")
        norm2 = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
        n, size, most = kept.agg(F.count("*"), F.max(F.size("v")), F.max(norm2)).first()
        self.space = space = Space(size or 0, most or 0)
        sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toPandas()["v"]  # a bounded sample, whatever n is
        leaves = max(1, min(MOST_LEAVES, n // LEAF_ROWS))
        self.tree = tree = Tree(space.augmented(space.matrix(list(sample)), False), leaves, 1, closed=False)
        parts = max(1, -(-n // (len(tree.leaves) * LEAF_ROWS)))

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = space.matrix(list(batch["v"]))
                yield pd.DataFrame({"leaf": tree.leaf_of(space.augmented(x, False)), "vec_id": batch["vec_id"], "label": batch["label"], "x": [r.astype("<i4").tobytes() for r in x]})

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            block, held = TaskContext.get().partitionId() << 32, []

            def packed() -> pd.DataFrame:
                nonlocal block
                some = pd.concat(held)
                held.clear()
                block += 1
                return pd.DataFrame({"leaf": [some["leaf"].iloc[0]], "block": [block], "ids": [some["vec_id"].to_numpy("<i8").tobytes()], "labels": [some["label"].to_numpy("<i8").tobytes()], "x": [b"".join(some["x"])]})

            for batch in batches:
                for leaf, some in batch.groupby("leaf", sort=True):
                    if held and held[0]["leaf"].iloc[0] != leaf:
                        yield packed()
                    while len(some):
                        room = BLOCK_ROWS - sum(map(len, held))
                        held.append(some.iloc[:room])
                        some = some.iloc[room:]
                        if sum(map(len, held)) == BLOCK_ROWS:
                            yield packed()
            if held:
                yield packed()

        dealt = kept.mapInPandas(deal, "leaf int, vec_id long, label long, x binary").withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
        dealt = dealt.repartition("leaf", "_part").sortWithinPartitions("leaf", "_part").drop("_part")
        self.blocks = staged(dealt.mapInPandas(pack, "leaf int, block long, ids binary, labels binary, x binary"), "blocks")

    def _visits(self, queries: DataFrame, home: bool) -> DataFrame:
        """queries with the leaf whose annulus begins nearest (`home`), or all others that may hold a row from lo to hi."""
        space, tree = self.space, self.tree

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x, n = space.matrix(list(batch["v"])), len(batch)
                low, high = tree.bounds(space.augmented(x, True))
                near, far = space.distance(x, batch["hi"].to_numpy()), space.distance(x, batch["lo"].to_numpy())
                low = np.where(high < near[:, None] - space.slack, np.inf, np.maximum(low, near[:, None]))
                low[np.arange(n), tree.leaf_of(space.augmented(x, True))] *= 1 - 1e-9  # of equal ones its own leaf
                first = np.argmin(low, axis=1)
                open_ = low <= far[:, None] + space.slack
                open_[np.arange(n), first] = home & open_[np.arange(n), first]
                if home:
                    open_ &= np.arange(low.shape[1]) == first[:, None]
                i, leaf = np.nonzero(open_)
                yield batch.iloc[i].assign(leaf=leaf)

        return queries.mapInPandas(run, "qid long, label long, v array<long>, lo long, hi long, leaf int")

    def _met(self, queries: DataFrame, k: int, same: bool, home: bool) -> DataFrame:
        """(qid, score, vec_id): the first k rows of each block that a query visits. Each block is read once and held
        while its queries pass by in batches."""
        space = self.space
        visits = self._visits(queries, home).join(self.blocks.select("leaf", "block"), "leaf").select("block", F.lit(1).alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in ("ids", "labels", "x")], "qid", "label", "v", "lo", "hi")
        blocks = self.blocks.select("block", F.lit(0).alias("kind"), "ids", "labels", "x", *[F.lit(None).cast(t).alias(c) for c, t in (("qid", "long"), ("label", "long"), ("v", "array<long>"), ("lo", "long"), ("hi", "long"))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block = payload = None
            for batch in batches:
                runs = (batch["block"].ne(batch["block"].shift()) | batch["kind"].eq(0)).cumsum()
                for _, some in batch.groupby(runs, sort=False):
                    if some["kind"].iloc[0] == 0:
                        payload, block = some.iloc[0], None
                        some = some.iloc[1:]
                    for at in range(0, len(some), QUERY_ROWS):
                        asked = some.iloc[at : at + QUERY_ROWS]
                        if block is None:
                            ids = np.frombuffer(payload["ids"], "<i8")
                            block = Block(space, ids, np.frombuffer(payload["labels"], "<i8"), np.frombuffer(payload["x"], "<i4").reshape(len(ids), space.size))
                        q, score, ids = block.search(space.matrix(list(asked["v"])), *(asked[c].to_numpy(np.int64) for c in ("label", "lo", "hi")), k, same)
                        yield pd.DataFrame({"qid": asked["qid"].to_numpy(np.int64)[q], "score": score, "vec_id": ids})

        met = blocks.unionByName(visits).repartition("block").sortWithinPartitions("block", "kind")
        return met.mapInPandas(run, "qid long, score long, vec_id long")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(qid, found): the first k rows of each staged query (qid, label, v, lo, hi) as an array of (rank key, id, score).

        Two waves: the nearest leaf, whose k-th row draws the outer edge in, then all leaves that still reach inside.
        """
        # In qid order the rows of a task are dealt anew: queries may be few and lie in few partitions.
        queries = queries.repartition("qid")
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
        top = lambda rows: rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
        found = staged(top(self._met(queries, k, same, True)), "found")
        if len(self.tree.leaves) > 1:
            edge = found.where(F.col("_n") == k).select("qid", F.col("score").alias("_edge"))
            rest = queries.join(edge, "qid", "left").withColumn("lo", F.greatest("lo", F.coalesce("_edge", "lo"))).drop("_edge")
            found = top(found.drop("_n").unionByName(self._met(rest, k, same, False)))
        return found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("below"), "vec_id", "score"))).alias("found"))


def mine(embeddings: DataFrame, anchor: Column | None = None, least: int = 50, most: int = 95) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors (by default ids divisible by 50) take as positives the first POSITIVES other rows of their label; each pair
    takes the first NEGATIVES rows of other labels whose score is least to most hundredths of the positive's. Higher
    scores come first, then smaller ids. Anchors of one vector and label share one search, and so do windows of one
    vector, label and score. A pair whose window holds no row has none in the result; an empty table has none at all. See
    prepared for nulls, repeats and vectors too long; vectors of unequal size are compared as if the shorter ended in zeros.
    Other columns are not read.
    """
    small_batches(embeddings.sparkSession)
    rows = staged(prepared(embeddings), "rows")
    index = Index(rows)
    anchors = rows.where((F.col("vec_id") % 50 == 0) if anchor is None else anchor)
    asked = staged(anchors.groupBy("label", "v").agg(F.count("*").alias("_n")).withColumns({"qid": F.monotonically_increasing_id(), "lo": F.lit(_LEAST), "hi": F.lit(_MOST)}), "asked")
    positives = staged(index.search(asked.select("qid", "label", "v", "lo", "hi"), POSITIVES + 1, True), "positives")

    scores = positives.select("qid", F.explode(F.array_distinct("found.score")).alias("positive_score")).where("positive_score >= 0")
    windows = scores.join(asked.select("qid", "label", "v"), "qid").withColumnsRenamed({"qid": "asked_by"}).withColumn("qid", F.monotonically_increasing_id())
    windows = staged(windows.withColumns({"lo": F.expr(f"(positive_score * {least} + 99) DIV 100"), "hi": F.expr(f"(positive_score * {most}) DIV 100")}), "windows")
    negatives = windows.select("qid", "asked_by", "positive_score").join(index.search(windows.select("qid", "label", "v", "lo", "hi"), NEGATIVES, False), "qid")
    negatives = negatives.select(F.col("asked_by").alias("qid"), "positive_score", F.col("found").alias("negatives"))

    each = positives.select("qid", F.posexplode("found").alias("_place", "_p")).select("qid", "_place", F.col("_p.vec_id").alias("positive_id"), F.col("_p.score").alias("positive_score"))
    each = each.join(negatives, ["qid", "positive_score"], "left")
    pairs = each.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("_place", "positive_id", "positive_score", "negatives"))).alias("_pairs"))
    facts = asked.select("qid", "label", "v", "_n").join(pairs, "qid").drop("qid")

    mined = joined(anchors.select("vec_id", "label", "v"), facts, ["label", "v"]).select("vec_id", "_pairs")
    other = F.slice(F.filter("_pairs", lambda p: p["positive_id"] != F.col("vec_id")), 1, POSITIVES)
    mined = mined.select(F.col("vec_id").alias("anchor_id"), F.explode(other).alias("_p")).select("anchor_id", "_p.positive_id", "_p.positive_score", F.posexplode("_p.negatives").alias("_place", "_n"))
    return mined.select("anchor_id", "positive_id", (F.col("_place") + 1).alias("rank"), F.col("_n.vec_id").alias("negative_id"), "positive_score", F.col("_n.score").alias("negative_score"))
