"""N-gram Jaccard join by prefix filters under several global orders, and the components of its links.

Any order of all shingles that every document shares gives an exact filter: under one order, let a document of n shingles
keep its first p(n) as prefix. If two documents have an overlap of o, then at least o - max(n - p(n), m - p(m)) common
shingles lie in both prefixes. Three orders are used, and a candidate must pass all of them before whole sets are compared:

1. by frequency, rarest first. All shingles are dealt by hash, in packed blocks, to count in how many documents each
   occurs. A shingle that only one document has is shared with none: a document of n shingles with u such ones has an
   overlap of n - u at most, which ends most documents and most pairs. The others meet in the rest of their prefix.
2. and 3. by two hashes: a pair needs enough common shingles in both its prefixes under each of them.

No group emits all its pairs. Documents that meet in a shingle are compared with three hubs of that group first; links so
found are joined to components, and only pairs across components are compared after that. A pair within one component
needs no link of its own there, so the components are those of all links. linked() then compares the sets within each
component too and returns every link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platehouse.functions.grouping import runs
from platehouse.llm.shared import components, hot_ends, joined, partitions, spread_join, staged

#: Words in a shingle; two documents link where 100 * intersection >= 80 * union.
WORDS = 5
#: Shingles and documents in a packed block at most (a document's number in its block takes 16 bits).
BLOCK_TOKENS, BLOCK_DOCS = 600_000, 60_000
#: Up to so many documents, the texts to compare are found by broadcasting their ids (16 bytes each).
BROADCAST_IDS = 1_000_000
#: Numbers of 64 bits in a document's bitmap.
BITMAP = 4
_KEPT_WORDS = 100_000
_ODD = np.random.default_rng(20_240_601).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORD_HASHES = _WordHashes()


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers: the order that it gives is as good as random."""
    x = (x ^ _ODD[seed]) * _ODD[seed + 1]
    x ^= x >> np.uint64(32)
    x = x * _ODD[seed + 2]
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes: A-Z lowered, words at ASCII white space.

    Fewer words than a shingle has make one shingle together; null and texts without words have none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(len(words), WORDS)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * _ODD[6 + i]
    return np.unique(_mix(out, 12))


def prefix_size(n):
    """Under the hash orders: the first three tenths, and one shingle more than a linked document may lack."""
    return np.minimum(n, np.maximum(n - -(-4 * n // 5) + 1, -(-3 * n // 10)))


def _needed_column(n: str, m: str) -> Column:
    def rest(x: str) -> Column:
        x = F.col(x)
        return x - F.least(x, F.greatest(x - F.ceil(x * 4 / 5) + 1, F.ceil(x * 3 / 10)))

    # two shingles of one document may be packed alike: allow for it
    return F.ceil((F.col(n) + F.col(m)) * 4 / 9) - F.greatest(rest(n), rest(m)) - 1 - F.floor(F.greatest(n, m) / 4096)


_DOC = np.dtype([("doc", "i8"), ("null", "?"), ("n", "i4"), ("node", "i4"), ("d1", "i8"), ("d2", "i8"), ("x", "u8"), ("y", "u8")])


def _orders(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of packed shingles under the two hash orders."""
    return _mix(tokens, 0), _mix(tokens, 3)


def _packed(s: np.ndarray, buckets: int) -> np.ndarray:
    """Packed shingles: their bucket and 32 bits of hash. Two that fall together only weaken a filter."""
    dealt = _mix(s, 9)
    return (dealt >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) << np.uint64(32) | dealt & np.uint64(0xFFFFFFFF)


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed blocks: for each bucket, 32 bits of a block's distinct shingles and how many of its sets have each.

    The block itself goes under a negative bucket of its own: its documents with the ends of their prefixes under the hash
    orders, and the sets that have each distinct shingle, in the buckets' order. Of equal sets in a block one gives shingles.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, held, seen, found, tokens = TaskContext.get().partitionId() << 32, [], {}, [], 0

        def closed() -> pd.DataFrame:
            nonlocal block, tokens
            who, counts, rows = np.zeros(0, np.uint16), np.zeros(0, np.uint16), []
            if tokens:
                flat = np.concatenate(found)
                by = np.argsort(flat, kind="stable")
                who = np.repeat(np.arange(len(found), dtype=np.uint16), [len(f) for f in found])[by]
                distinct, first = np.unique(flat[by], return_index=True)
                counts = np.diff(np.append(first, len(flat))).astype(np.uint16)
                cut = np.searchsorted(distinct >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                small = distinct.astype(np.uint32)
                rows = [(b, block, b"", b"", counts[i:j].tobytes(), small[i:j].tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            rows.append((-1 - block, block, np.array(held, _DOC).tobytes(), who.tobytes(), counts.tobytes(), b""))
            block, tokens = block + 1, 0
            held.clear()
            found.clear()
            seen.clear()
            return pd.DataFrame(rows, columns=["bucket", "block", "docs", "who", "counts", "tokens"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingles(text)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                node = seen.setdefault(digest, len(seen))
                ends = (0, 0)
                if node == len(found):
                    found.append(_packed(s, buckets))
                    tokens += len(s)
                    if len(s):
                        p = int(prefix_size(len(s)))
                        ends = [np.partition(k, p - 1)[p - 1] for k in _orders(found[-1])]
                held.append((0 if pd.isna(doc) else int(doc), pd.isna(doc), len(s), node, *np.frombuffer(digest, np.int64), *ends))
                if tokens >= BLOCK_TOKENS or len(held) >= BLOCK_DOCS:
                    yield closed()
        if held:
            yield closed()

    return docs.select("doc_id", "text").mapInPandas(run, f"bucket long, {_BLOCK}, tokens binary")


_BLOCK = "block long, docs binary, who binary, counts binary"


def _frequencies(bucket: pd.DataFrame) -> pd.DataFrame:
    """For one bucket: in how many sets each shingle of a block occurs (16 bits, clamped), and those shared by two or more.

    A block counts its own sets first, so a shingle that very many documents have is one number a block.
    """
    number = int(bucket["bucket"].iloc[0])
    names = ["bucket", "block", "docs", "who", "counts", "tokens", "freq"]
    if number < 0:
        return bucket.assign(freq=b"")[names]
    tokens = [np.frombuffer(t, np.uint32) for t in bucket["tokens"]]
    counts = np.concatenate([np.frombuffer(c, np.uint16) for c in bucket["counts"]])
    distinct, at = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct))
    freq = np.minimum(total, 65_535).astype(np.uint16)[at]
    rows, end = [], 0
    for block, t in zip(bucket["block"], tokens, strict=True):
        f = freq[end : end + len(t)]
        end += len(t)
        rows.append((number, block, b"", b"", b"", t[f > 1].tobytes(), f.tobytes()))
    return pd.DataFrame(rows, columns=names)


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """Which of 64 * BITMAP places the tokens' hashes take. Places that another's bitmap lacks are so many misses."""
    places = (_mix(tokens, 11) >> np.uint64(40)) % np.uint64(64 * BITMAP)
    out = np.zeros(BITMAP, np.uint64)
    np.bitwise_or.at(out, (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
    return out.astype(np.int64)


def _documents(block: pd.DataFrame) -> pd.DataFrame:
    """For one block: its documents; those that may have a link also with their prefixes under the three orders.

    shared is the number of shingles that others have. A document may have a link if it shares four fifths.
    """
    own = block.loc[block["bucket"] < 0].iloc[0]
    info, who, counts = np.frombuffer(own["docs"], _DOC), np.frombuffer(own["who"], np.uint16).astype(np.int64), np.frombuffer(own["counts"], np.uint16)
    rows = block[block["bucket"] >= 0].sort_values("bucket")
    freq = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["freq"]] or [np.zeros(0, np.uint16)])
    token = np.concatenate([np.uint64(int(b) << 32) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(rows["bucket"], rows["tokens"], strict=True)] or [np.zeros(0, np.uint64)])
    common = freq > 1
    who, token, freq = who[np.repeat(common, counts)], np.repeat(token, counts[common]), np.repeat(freq[common], counts[common])
    by = np.lexsort((token, freq, who))
    who, token = who[by], token[by]
    cut = np.searchsorted(who, np.arange(int(info["node"].max()) + 2))
    shared = np.diff(cut)
    out = {k: [None] * len(info) for k in ("rarest", "x", "y", "bits", "shared")}
    done = set()
    for i, (node, n, x, y) in enumerate(info[["node", "n", "x", "y"]].tolist()):
        c = int(shared[node])
        if n and 5 * c >= 4 * n and node not in done:
            done.add(node)
            t = token[cut[node] : cut[node + 1]]
            kx, ky = _orders(t)
            rarest = max(0, n - -(-4 * n // 5) + 1 - (n - c))  # what is left of the prefix after shingles of its own
            out["bits"][i] = _bitmap(t)
            out["rarest"][i], out["x"][i], out["y"][i], out["shared"][i] = t[:rarest].astype(np.int64), t[kx <= x].astype(np.int64), t[ky <= y].astype(np.int64), c
    docs = pd.Series(info["doc"]).astype("Int64").mask(info["null"])
    return pd.DataFrame({"doc_id": docs, "n": info["n"].astype(np.int64), "d1": info["d1"], "d2": info["d2"], **out}).astype({"shared": "Int64"})


def _may_link() -> Column:
    """By sizes n and m and the shingles that others share with them, can the overlap reach 4/9 of both sizes?"""
    return 9 * F.least("shared", "others_shared") >= 4 * (F.col("n") + F.col("m"))


def _met_hubs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of each document with three hubs of every group that shares one of its rarest shingles.

    Hubs are the members with the largest share of shingles that others have (often what the rest was copied from), the
    longest and the shortest of them, and the one of least hash.
    """
    share = F.round(F.col("shared") / F.col("n"), 3)
    member = F.struct(F.col("node").alias("id"), F.col("n").alias("m"), F.col("shared").alias("others_shared"))
    tokens = nodes.select("node", "n", "shared", share.alias("share"), F.explode("rarest").alias("token"))
    hubs = tokens.groupBy("token").agg(F.count("*").alias("_n"), F.max_by(member, F.struct("share", "n", "node")).alias("x"), F.max_by(member, F.struct("share", -F.col("n"), "node")).alias("y"), F.min_by(member, F.struct(F.xxhash64("node"), "node")).alias("z")).where("_n > 1")
    met = tokens.join(hubs.select("token", F.array_distinct(F.array("x", "y", "z")).alias("hubs")), "token").select("node", "n", "shared", F.inline("hubs"))
    return met.where(F.col("node") != F.col("id")).where(_may_link()).select(F.least("node", "id").alias("a"), F.greatest("node", "id").alias("b")).distinct()


def _across(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a rarest shingle and lie in different components (a node without one is its own).

    Of two linked sets the smaller shares eight ninths of its shingles at least (its overlap is 4/9 of both sizes), so
    sets that share less, such as a common passage with words of their own, only meet smaller ones.
    """
    tokens = nodes.select("node", "n", "shared", "bits", F.explode("rarest").alias("token")).join(parts, "node", "left").withColumn("component", F.coalesce("component", F.col("node")))
    mixed = tokens.groupBy("token").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("token")
    both = tokens.join(mixed, "token")
    left = both.where("9 * shared >= 8 * n")
    right = both.select("token", F.col("node").alias("id"), F.col("n").alias("m"), F.col("shared").alias("others_shared"), F.col("component").alias("other"), F.col("bits").alias("others_bits"))
    lacks = lambda one, two: sum((F.bit_count(F.col(one)[i].bitwiseAND(F.bitwise_not(F.col(two)[i]))) for i in range(BITMAP)), F.lit(0))
    most = F.least(F.col("shared") - lacks("bits", "others_bits"), F.col("others_shared") - lacks("others_bits", "bits"))
    met = left.join(right, "token").where((F.struct("n", "node") < F.struct("m", "id")) & (F.col("component") != F.col("other"))).where(_may_link()).where(9 * most >= 4 * (F.col("n") + F.col("m")))
    return met.select(F.least("node", "id").alias("a"), F.greatest("node", "id").alias("b")).distinct()


def _passing(pairs: DataFrame, nodes: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs whose prefixes under both hash orders have enough in common."""
    one = nodes.select("node", "n", F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    two = nodes.select("node", F.col("n").alias("m"), F.col("x").alias("_bx"), F.col("y").alias("_by"))
    enough = [F.size(F.array_intersect(f"_a{o}", f"_b{o}")) >= _needed_column("n", "m") for o in "xy"]
    return spread_join(spread_join(pairs, _ENDS, "a", one, hot, "node"), _ENDS, "b", two, hot, "node").where(enough[0] & enough[1]).select("a", "b")


_ENDS = ["a", "b"]
_SETS = "d1 long, d2 long, set array<long>"


def _whole_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every text's set of shingles and its digest."""
    for batch in batches:
        for i in range(0, len(batch), 500):
            found = [shingles(t) for t in batch["text"].iloc[i : i + 500]]
            ends = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in found]).reshape(-1, 2)
            yield pd.DataFrame({"d1": ends[:, 0], "d2": ends[:, 1], "set": [s.astype(np.int64) for s in found]})


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs that pass the filters and whose whole sets of shingles are alike enough."""
    pairs = staged(pairs, "met")
    hot = hot_ends(pairs, _ENDS, "node")  # a hub meets all the rest of its group
    passing = staged(_passing(pairs, nodes, hot), "candidates")
    wanted = nodes.join(passing.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("doc").alias("doc_id"))
    wanted = staged(wanted, "compared")
    # a doc_id that names one of the sets finds its text; where several have one, or none has any, digests do
    odd = staged(wanted.groupBy("doc_id").agg(F.count("*").alias("_n")).where("doc_id IS NULL OR _n > 1").select(F.col("doc_id").alias("_odd")), "repeated")
    plain = wanted.where("doc_id IS NOT NULL").join(odd, F.col("doc_id") == F.col("_odd"), "left_anti")
    few = F.broadcast if wanted.count() <= BROADCAST_IDS else (lambda df: df)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                rows = []
                for node, d1, d2, text in batch.iloc[i : i + 500][["node", "_d1", "_d2", "text"]].itertuples(index=False):
                    s = shingles(text)
                    if np.array_equal(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64), (d1, d2)):  # not another text of that doc_id
                        rows.append((node, s.astype(np.int64)))
                yield pd.DataFrame(rows, columns=["node", "set"])

    texts = docs.select("doc_id", "text").join(few(plain), "doc_id").select("node", "_d1", "_d2", "text")
    whole = texts.mapInPandas(sets, "node long, set array<long>")
    if not odd.isEmpty():
        others = docs.select("doc_id", "text").join(few(odd), F.col("doc_id").eqNullSafe(F.col("_odd")), "left_semi").select("text").mapInPandas(_whole_sets, _SETS)
        named = wanted.join(odd, F.col("doc_id").eqNullSafe(F.col("_odd")), "left_semi").select("node", F.col("_d1").alias("d1"), F.col("_d2").alias("d2"))
        whole = whole.union(others.join(few(named), ["d1", "d2"]).groupBy("node").agg(F.any_value("set").alias("set")))
    both = spread_join(passing, _ENDS, "a", whole.select("node", F.col("set").alias("_x")), hot, "node")
    both = spread_join(both, _ENDS, "b", whole.select("node", F.col("set").alias("_y")), hot, "node")
    overlap = F.size(F.array_intersect("_x", "_y"))
    return both.where(9 * overlap >= 4 * (F.size("_x") + F.size("_y"))).select("a", "b").distinct()


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every document with its set's digest and its component's name (_group, null without shingles); the sets that may
    have links; the components of those that have."""
    buckets = 2 * partitions(docs.sparkSession)  # a bucket's shingles are sorted in memory
    dealt = _blocks(docs, buckets).groupBy("bucket").applyInPandas(lambda b: _frequencies(b), f"bucket long, {_BLOCK}, tokens binary, freq binary")
    rows = dealt.groupBy("block").applyInPandas(lambda b: _documents(b), "doc_id long, n long, d1 long, d2 long, rarest array<long>, x array<long>, y array<long>, bits array<long>, shared long")
    rows = staged(rows, "shingled")
    alike = rows.where("rarest IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc"), F.any_value("n").alias("n"), F.any_value("shared").alias("shared"), *[F.any_value(c).alias(c) for c in ("x", "y", "bits", "rarest")])
    nodes = staged(alike.withColumn("node", F.monotonically_increasing_id()), "nodes")
    first = staged(_links(_met_hubs(nodes), nodes, docs), "links")
    second = _links(_across(nodes, components(first)), nodes, docs)
    parts = nodes.select("node", "d1", "d2").join(components(first.union(second)), "node").select("d1", "d2", "component")
    # a set that links with none is a component of its own copies
    group = F.coalesce(F.concat(F.lit("c"), F.col("component").cast("string")), F.concat_ws(":", "d1", "d2"))
    sets = rows.where("n > 0").groupBy("d1", "d2").agg(F.count("*").alias("_n")).join(parts, ["d1", "d2"], "left").select("d1", "d2", "_n", group.alias("_group"))
    few = rows.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2")
    labelled = joined(few.where("n_shingles > 0"), sets, ["d1", "d2"]).select(*few.columns, "_group").union(few.where("n_shingles = 0").withColumn("_group", F.lit(None).cast("string")))
    return staged(labelled, "labelled"), nodes, parts


def _with_component(labelled: DataFrame) -> DataFrame:
    linked = labelled.where("_group IS NOT NULL")
    least = linked.groupBy("_group").agg(F.count("*").alias("_n"), F.min("doc_id").alias("component_id"))
    alone = labelled.where("_group IS NULL").withColumn("component_id", F.col("doc_id"))
    return joined(linked, least, ["_group"]).select(*alone.columns).union(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach, its own included) of every document.

    Null texts and texts without words have no shingles and no links: component_id is their own doc_id. A null doc_id
    takes part like any other but is never a component's id, unless it is alone (null). Repeated doc_ids are documents
    of their own. Columns besides doc_id and text are not read.
    """
    return _with_component(_labelled(docs)[0]).select("doc_id", "n_shingles", "component_id")


#: Sets and shingles in a chunk of a component at most, about.
CHUNK_SETS, CHUNK_SHINGLES = 256, 500_000
_CHUNKS = ["component", "low", "i", "high", "j"]
_PAIR = ["a1", "a2", "b1", "b2", "n_a", "n_b", "overlap"]


def _chunks(linked: DataFrame) -> DataFrame:
    """Sets (d1, d2, n, component) dealt to the pairs of chunks in which they are compared, with their side (2: both).

    The sets of a component are cut by size, so that linked ones are in one class or in neighbouring ones (their sizes
    differ by a quarter at most, a class spans three tenths), and a large class by hash. Any two sets that may link meet
    in exactly one pair of chunks; a small component is one chunk.
    """
    sets = linked.withColumn("size_class", F.floor(F.log("n") / F.log(F.lit(1.3))).cast("int"))
    parts = lambda count, total: F.ceil(F.greatest(F.col(count) / CHUNK_SETS, F.col(total) / CHUNK_SHINGLES)).cast("int")
    classes = sets.groupBy("component", "size_class").agg(F.count("*").alias("_n"), F.sum("n").alias("_total"))
    of = classes.groupBy("component").agg(F.sum("_n").alias("_n"), F.sum("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("size_class", parts("_n", "_total")))).alias("_classes"))
    sets = sets.join(of, "component")
    whole = parts("_n", "_total") == 1
    c, k = F.col("size_class"), lambda step: F.try_element_at("_classes", F.col("size_class") + step)
    own = F.pmod(F.xxhash64("d1", "d2"), k(0)).cast("int")
    zero = F.lit(0)
    place = lambda low, i, high, j, side: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), side.cast("int").alias("side"))
    none = F.array_remove(F.array(place(zero, zero, zero, zero, F.lit(2))), place(zero, zero, zero, zero, F.lit(2)))
    each = lambda n, f: F.coalesce(F.transform(F.sequence(zero, n - 1), f), none)
    alike = each(k(0), lambda j: place(c, F.least(own, j), c, F.greatest(own, j), F.when(own == j, 2).when(own < j, 0).otherwise(1)))
    above, below = each(k(1), lambda j: place(c, own, c + 1, j, zero)), each(k(-1), lambda j: place(c - 1, j, c, own, F.lit(1)))
    return sets.select("d1", "d2", "component", F.inline(F.when(whole, F.array(place(zero, zero, zero, zero, F.lit(2)))).otherwise(F.concat(alike, above, below))))


def _overlaps(one: list[np.ndarray], two: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of linked sets in one and in two and their overlap; of the same sets each pair once."""
    m = np.array([len(t) for t in two])
    flat = np.concatenate(two)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], np.repeat(np.arange(len(two)), m)[order]
    found = []
    for i, s in enumerate(one):
        start, end = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
        n = end - start
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        overlap = np.bincount(who[at], minlength=len(two))
        j = np.flatnonzero((9 * overlap >= 4 * (len(s) + m)) & ((np.arange(len(two)) > i) | (not same)))
        found.append((np.full(len(j), i), j, overlap[j]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The linked pairs of sets of each pair of chunks; rows come sorted by chunks, one pair of chunks is held at a time."""
    held, rows = [], 0
    for _, g in runs(batches, _CHUNKS):
        side, digests = np.array(g["side"]), np.array([g["d1"], g["d2"]], np.int64)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right) or len(side) < 2:
            continue
        i, j, overlap = _overlaps([g["set"][x] for x in left], [g["set"][x] for x in right], bool((side == 2).all()))
        if not len(i):
            continue
        n = np.array([len(s) for s in g["set"]])
        i, j = left[i], right[j]
        one, two = digests.view(np.uint64)  # in the order of set ids
        swap = (one[i] > one[j]) | ((one[i] == one[j]) & (two[i] > two[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        held.append(np.array([digests[0][i], digests[1][i], digests[0][j], digests[1][j], n[i], n[j], overlap], np.int64))
        rows += len(i)
        if rows >= 20_000:
            yield pd.DataFrame(np.concatenate(held, axis=1).T, columns=_PAIR)
            held, rows = [], 0
    if held:
        yield pd.DataFrame(np.concatenate(held, axis=1).T, columns=_PAIR)


def _set_id(one: str, two: str) -> Column:
    return F.concat(F.lpad(F.hex(one), 16, "0"), F.lpad(F.hex(two), 16, "0"))


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole join: every document with its set and its number of links, and every linked pair of different sets.

    The first has doc_id, n_shingles, component_id (as near_duplicates), set_id (equal sets of shingles have the same;
    null without shingles) and n_links, the number of other documents that it links with, copies included. The second
    has set_a < set_b, n_a, n_b and overlap: each pair of sets once, inside components too. Pairs of documents are those of
    the members of set_a and set_b, and the pairs within one set; there may be as many as the square of a hot group.
    A link never leaves a component, so all sets of a component are compared, in chunks of bounded size.
    """
    labelled, nodes, parts = _labelled(docs)
    linked_sets = staged(parts.join(nodes.select("d1", "d2", "n", F.col("doc").alias("_doc")), ["d1", "d2"]), "linked")
    wanted = linked_sets.select("_doc").distinct()
    texts = docs.select("doc_id", "text").join(wanted, docs["doc_id"].eqNullSafe(wanted["_doc"]), "left_semi").select("text")

    whole = texts.mapInPandas(_whole_sets, _SETS).join(linked_sets.select("d1", "d2"), ["d1", "d2"], "left_semi")
    whole = staged(whole.groupBy("d1", "d2").agg(F.any_value("set").alias("set")), "sets")
    dealt = _chunks(linked_sets).join(whole, ["d1", "d2"]).repartition(*_CHUNKS).sortWithinPartitions(*_CHUNKS)
    pairs = staged(dealt.select(*_CHUNKS, "side", "d1", "d2", "set").mapInPandas(_compared, ", ".join(f"{c} long" for c in _PAIR)), "pairs")
    copies = labelled.where("n_shingles > 0").groupBy("d1", "d2").agg(F.count("*").alias("_copies"))
    ends = pairs.select(F.inline(F.array(F.struct(F.col("a1").alias("d1"), F.col("a2").alias("d2"), F.col("b1").alias("_o1"), F.col("b2").alias("_o2")), F.struct(F.col("b1").alias("d1"), F.col("b2").alias("d2"), F.col("a1").alias("_o1"), F.col("a2").alias("_o2")))))
    others = copies.select(F.col("d1").alias("_o1"), F.col("d2").alias("_o2"), F.col("_copies").alias("_others"))
    counts = copies.join(ends.join(others, ["_o1", "_o2"]).groupBy("d1", "d2").agg(F.sum("_others").alias("_others")), ["d1", "d2"], "left")
    counts = counts.select("d1", "d2", F.col("_copies").alias("_n"), (F.col("_copies") - 1 + F.coalesce("_others", F.lit(0))).alias("_links"))
    members = _with_component(labelled)
    columns = [*members.columns, "_links"]
    members = joined(members.where("n_shingles > 0"), counts, ["d1", "d2"]).select(*columns).union(members.where("n_shingles = 0").withColumn("_links", F.lit(0)).select(*columns))
    set_id = F.when(F.col("n_shingles") > 0, _set_id("d1", "d2"))
    return members.select("doc_id", "n_shingles", "component_id", set_id.alias("set_id"), F.coalesce("_links", F.lit(0)).alias("n_links")), pairs.select(_set_id("a1", "a2").alias("set_a"), _set_id("b1", "b2").alias("set_b"), "n_a", "n_b", "overlap")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each component: the row of the smallest doc_id, nulls last, which names the component.

    Among rows of one doc_id in a component, that of the least set and then text hash stays; of equal rows, one. Rows
    without shingles link with none, so each of them stays. Texts are only read again where doc_ids are null or repeat.
    """
    labelled = _labelled(docs)[0]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_kept"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2")))
    chosen = staged(labelled.where("_group IS NOT NULL").groupBy("_group").agg(least.alias("_row")).select("_row.*"), "chosen")
    odd = staged(labelled.groupBy("doc_id").agg(F.count("*").alias("_n")).where("doc_id IS NULL OR _n > 1").select(F.col("doc_id").alias("_odd")), "repeated")
    # a doc_id of one row tells the row
    kept = chosen.select("_kept").union(labelled.where("_group IS NULL").select("doc_id")).where("_kept IS NOT NULL").join(odd, F.col("_kept") == F.col("_odd"), "left_anti")
    plain = docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi")
    if odd.isEmpty():
        return plain

    @F.pandas_udf("d1 long, d2 long, n long")
    def digests(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingles(t)
            rows.append((*np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist(), len(s)))
        return pd.DataFrame(rows, columns=["d1", "d2", "n"])

    rows = docs.join(odd, docs["doc_id"].eqNullSafe(odd["_odd"]), "left_semi").withColumns({"_set": digests("text"), "_place": F.monotonically_increasing_id()})
    rows = staged(rows, "repeated-rows")
    found = rows.where("_set.n > 0").select("doc_id", F.col("_set.d1").alias("d1"), F.col("_set.d2").alias("d2"), F.xxhash64("text").alias("_hash"), "_place")
    met = found.join(chosen, (found["d1"] == chosen["_d1"]) & (found["d2"] == chosen["_d2"]) & found["doc_id"].eqNullSafe(chosen["_kept"]))
    places = met.groupBy("d1", "d2").agg(F.min(F.struct("_hash", "_place")).alias("_first")).select("_first._place")
    places = places.union(rows.where("_set.n = 0").select("_place"))
    return plain.unionByName(rows.join(places, "_place", "left_semi").select(*docs.columns))
