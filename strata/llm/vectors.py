"""Embedding near duplicates by a forest of random-projection trees.

A tree splits recursively by random directions at medians, and rows near one of the first splits go down both sides (spill).
Depth follows from the number of rows, so leaves stay small on the average, and the number of trees from the depth, so that
close pairs meet in some leaf. A node whose rows are about as close as the links asked for isn't split: a split would only
part links. Medians are taken from a sample that grows with the leaves, one tree a task; what is broadcast is a threshold a
node, bounded by MAX_DEPTH, beyond which leaves grow instead.

Every row is sent down every tree. Rows are compared within leaves, in blocks: a large leaf is cut into chunks whose pairs
are tasks of their own, so none is capped and none fills a task. Blocks give counts and the edges of a spanning forest, never
pairs. Two rows that meet in several leaves are counted in the first one only: each carries the numbers of its leaves, about
one a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import components, spanning, stage, unit_hash

SIMILARITY = 0.95
#: Rows of a leaf on the average, the deepest tree, rows of a chunk.
LEAF, MAX_DEPTH, CHUNK = 512, 15, 2048
#: Rows of the sample for each leaf, and at least.
SAMPLE_A_LEAF, LEAST_SAMPLE = 16, 20_000
#: The share of rows around a split's median that goes down both sides, and the levels from the root on that spill.
SPILL, SPILL_LEVELS = 0.12, 4
#: The chances that a pair at SIMILARITY stays together at a split with spill and at one without, and that of missing it in all trees.
TOGETHER_SPILLED, TOGETHER, MISS = 0.97, 0.9, 0.01
#: A node isn't split if the variance of its rows is at most this multiple of 1 - similarity, told from as many sample rows.
TIGHT, LEAST_ROWS = 1.5, 8


def depth_and_trees(rows: int, leaf: int = LEAF) -> tuple[int, int]:
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, rows) / leaf))))
    if not depth:
        return 0, 1
    together = TOGETHER_SPILLED ** min(depth, SPILL_LEVELS) * TOGETHER ** max(0, depth - SPILL_LEVELS)
    return depth, max(2, math.ceil(math.log(MISS) / math.log(1 - together)))


def directions(depth: int, trees: int, size: int, seed: int) -> np.ndarray:
    """A random direction for each tree and level, as columns."""
    return np.random.default_rng(seed).standard_normal((size, trees * depth))


def grown(at: np.ndarray, similarity: float, spill: float = SPILL) -> tuple[np.ndarray, np.ndarray]:
    """The thresholds of a tree's nodes, level after level, from the projections [row, level] of a sample: rows up to the
    second go left, rows above the first right.
    """
    lows, highs, node = [], [], np.zeros(len(at), np.int64)
    for d in range(at.shape[1]):
        order = np.lexsort((at[:, d], node))
        starts = np.searchsorted(node[order], np.arange((1 << d) + 1))
        n, sorted_ = np.diff(starts), np.append(at[order, d], np.float32(0))

        def level(share: float) -> np.ndarray:
            return np.where(n > 0, sorted_[np.minimum(starts[:-1] + (share * n).astype(np.int64), len(at))], np.float32(0))

        # The share below a threshold is its place less one, so a node of two rows is halved.
        width = spill if d < SPILL_LEVELS else 0.0
        middle = level(0.5 - 1e-9)
        low, high = level(0.5 - width / 2 - 1e-9), level(0.5 + width / 2 - 1e-9)
        sums = np.stack([np.bincount(node, x.sum(axis=1, dtype=np.float64), 1 << d) for x in (at, at * at)]) / at.shape[1]
        spread = np.zeros(1 << d)
        for k in range(at.shape[1]):
            spread += (np.bincount(node, at[:, k], 1 << d) / np.maximum(n, 1)) ** 2
        tight = (n >= LEAST_ROWS) & (sums[1] / np.maximum(n, 1) - spread / at.shape[1] <= TIGHT * (1 - similarity))
        for x in (low, middle, high):
            x[tight] = np.inf
        lows.append(low)
        highs.append(high)
        node = 2 * node + (at[:, d] > middle[node])
    return np.concatenate(lows), np.concatenate(highs)


@dataclass
class Forest:
    """Directions, and for each tree the thresholds of its nodes, those of level d from place 2 ** d - 1 on."""

    directions: np.ndarray
    depth: int
    low: list[np.ndarray]
    high: list[np.ndarray]

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every place of every row, in order; leaves are numbered through all trees."""
        at = (vectors @ self.directions).astype(np.float32)
        rows, found = [], []
        for t, (low, high) in enumerate(zip(self.low, self.high)):
            row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
            for d in range(self.depth):
                own, place = at[row, t * self.depth + d], node + ((1 << d) - 1)
                left = own <= high[place]
                right = (own > low[place]) | ~left
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            found.append(node + (t << self.depth))
        row, leaf = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order].astype(np.int32)


def grow(classes: DataFrame, n: int, size: int, similarity: float, leaf: int, seed: int) -> Forest | None:
    """The forest of n vectors (rep, embedding) of one length; None where one leaf holds all. A task grows a tree."""
    depth, trees = depth_and_trees(n, leaf)
    if not depth:
        return None
    ways = directions(depth, trees, size, seed)
    rate = max(LEAST_SAMPLE, SAMPLE_A_LEAF << depth) / n

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = (unit_vectors(batch.column(1)) @ ways).astype(np.float32).reshape(batch.num_rows, trees, depth)
                for t in range(trees):
                    own = pa.FixedSizeListArray.from_arrays(pa.array(at[:, t].ravel()), depth).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), batch.column(0), own], ["tree", "rep", "at"])

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        low, high = grown(table["at"].combine_chunks().flatten().to_numpy().reshape(-1, depth), similarity)
        return pa.table({"tree": table["tree"][:1], "low": pa.array([low.astype("<f4").tobytes()]), "high": pa.array([high.astype("<f4").tobytes()])})

    sample = classes.filter(unit_hash(seed, F.col("rep")) < rate).select("rep", "embedding")
    rows = sample.mapInArrow(project, "tree int, rep long, at array<float>").groupBy("tree").applyInArrow(build, "tree int, low binary, high binary")
    found = {r["tree"]: r for r in rows.collect()}  # a row a tree, of 2 ** depth thresholds
    blank = np.zeros((1 << depth) - 1, np.float32)
    low, high = ([np.frombuffer(found[t][k], "<f4") if t in found else blank for t in range(trees)] for k in ("low", "high"))
    return Forest(ways, depth, low, high)


def unit_vectors(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column, at length 1 in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _blocks(batches: Iterator[pa.RecordBatch], similarity: float) -> pa.Table | None:
    """One leaf's chunk, or two: for each row how many different rows it meets here first (with their copies), and an edge to
    the first row of its part of the links."""
    table = pa.Table.from_batches(batches).combine_chunks()
    if table.num_rows < 2:
        return None
    side, leaf = table["side"].to_numpy(), table["leaf"][0].as_py()
    order = np.lexsort((table["vec_id"].to_numpy(), side))
    table, side = table.take(pa.array(order)), side[order]
    ids, copies = table["vec_id"].to_numpy(), table["copies"].to_numpy()
    units = unit_vectors(table["embedding"].combine_chunks())
    all_leaves = table["leaves"].combine_chunks()
    lengths = all_leaves.value_lengths().to_numpy()
    values = all_leaves.flatten().to_numpy()
    width = int(lengths.max())
    earlier = np.full((len(ids), width), -1, np.int32)
    earlier[np.arange(width) < lengths[:, None]] = values
    earlier[earlier >= leaf] = -1
    two = side[0] != side[-1]
    cut = int((side == side[0]).sum()) if two else len(ids)
    n, joined = np.zeros(len(ids), np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for a in range(0, cut, 256):
        rows = np.arange(a, min(a + 256, cut))
        others = np.arange(cut, len(ids)) if two else np.arange(a, len(ids))
        close = units[rows] @ units[others].T >= similarity
        if not two:
            close &= others[None, :] > rows[:, None]
        i, j = np.nonzero(close)
        i, j = rows[i], others[j]
        before = np.zeros(len(i), bool)
        mine, theirs = earlier[i], earlier[j]
        for k in range(width):
            own = mine[:, k]
            if (own >= 0).any():
                before |= ((theirs == own[:, None]) & (own >= 0)[:, None]).any(axis=1)
        n += np.bincount(i[~before], copies[j[~before]], len(ids)).astype(np.int64) + np.bincount(j[~before], copies[i[~before]], len(ids)).astype(np.int64)
        joined = spanning(np.append(joined[0], i), np.append(joined[1], j), len(ids))
    least = np.arange(len(ids))
    least[joined[0]] = joined[1]
    # Ids stand in order on each side only, so the least id of each part is taken by value.
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, least, ids)
    keep = (n > 0) | (low[least] != ids)
    return pa.table({"vec_id": ids[keep], "n": n[keep], "least": low[least][keep]})


def near_vectors(table: DataFrame, similarity: float = SIMILARITY, leaf: int = LEAF, seed: int = 10) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of table (vec_id, embedding).

    n_links: other rows whose cosine with this one is at least `similarity`, of those that the forest finds; equal vectors
    are found always. component_id: the smallest vec_id reachable by links; kept: whether it is this row's. Vectors that are
    null, empty, zero or hold null or non-finite numbers link with nothing, and none links with one of another length:
    each length has a forest of its own. Rows that repeat a vec_id are copies of each other if their vectors are equal,
    and count as rows. An empty table gives no rows.
    """
    kind = table.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    sound = F.coalesce(
        F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0.0), F.lit(False)
    )
    # -0.0 and 0.0 are one number.
    rows = stage(rows.withColumn("embedding", F.when(sound, F.transform("embedding", lambda x: (x + F.lit(0.0)).cast(kind)))), "vectors")
    good = rows.filter("embedding is not null").withColumn("digest", F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), 256))
    good = stage(good.select("vec_id", "digest", "embedding"), "digests")
    classes = good.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("embedding").alias("embedding"))
    classes = stage(classes, "classes")
    sizes = {r["size"]: r["n"] for r in classes.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [_links(classes.filter(F.size("embedding") == size), n, size, similarity, leaf, seed) for size, n in sorted(sizes.items()) if n > 1]
    members = good.select("vec_id", "digest").join(classes.select("digest", "rep", "copies"), "digest")
    n, least = F.lit(0).cast("long"), F.col("rep")
    if parts:
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        found = stage(found, "links")
        counts = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n").alias("_n"))
        reached = components(found.filter("vec_id <> least").select(F.col("vec_id").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("rep"), "component")
        members = members.join(counts, "rep", "left").join(reached, "rep", "left")
        n, least = F.coalesce("_n", F.lit(0)), F.coalesce("component", "rep")
    linked = members.select("vec_id", (n + F.col("copies") - 1).cast("long").alias("n_links"), least.alias("component_id"))
    alone = rows.filter("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(classes: DataFrame, n: int, size: int, similarity: float, leaf: int, seed: int) -> DataFrame:
    """(vec_id, n, least): for each class and block the copies it links to there first, and the least id of its part."""
    shared = classes.sparkSession.sparkContext.broadcast(grow(classes, n, size, similarity, leaf, seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 2048) for k in range(0, whole.num_rows, 2048)):
                if shared.value is None:
                    row, found = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32)
                else:
                    row, found = shared.value.leaves(unit_vectors(batch.column(2)))
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found))], ["vec_id", "copies", "embedding", "leaves"])

    placed = classes.select(F.col("rep").alias("vec_id"), "copies", "embedding").mapInArrow(place, f"vec_id long, copies long, embedding {classes.schema['embedding'].dataType.simpleString()}, leaves array<int>")
    placed = stage(placed, "placed")
    crowd = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("_n"))
    crowded = crowd.filter(F.col("_n") > CHUNK).select("leaf", F.ceil(F.col("_n") / CHUNK).cast("int").alias("_chunks"))
    dealt = placed.withColumn("leaf", F.explode("leaves")).join(crowded, "leaf", "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("_chunks")).cast("int"))
    # Each row of chunk c is in the block of c with itself and in those of c with every other chunk of its leaf.
    blocks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    blocks = blocks.select("leaf", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), F.col("own").alias("side"), "vec_id", "copies", "embedding", "leaves")

    def compare(table: pa.Table) -> pa.Table:
        if table.num_rows and table["first"][0].as_py() != table["second"][0].as_py() and len(set(table["side"].to_pylist())) < 2:
            found = None
        else:
            found = _blocks(table.to_batches(), similarity)
        return found if found is not None else pa.table({k: pa.array([], pa.int64()) for k in ("vec_id", "n", "least")})

    return blocks.groupBy("leaf", "first", "second").applyInArrow(compare, "vec_id long, n long, least long")
