"""Graph operators over symbols (id, file, ...) and edges (source, target, weight, kind, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as texts
from strata.scratch import cut


#: Nodes whose ranks, 16 bytes each, are broadcast in a round of PageRank; of more, the edges' shares travel.
FEW_NODES = 4_000_000


@dataclass(frozen=True)
class Blocks:
    """Edges of one kind from each source (source, block) to each target (target, block) of its block, kept as these two tables,
    as the edges are their product. A target has one block and rows don't repeat, so neither do edges."""

    sources: DataFrame
    targets: DataFrame
    kind: str
    weight: float
    confidence: float
    provenance_rank: int

    def side(self, end: str) -> DataFrame:
        return self.sources if end == "source" else self.targets

    def sized(self) -> DataFrame:
        """(block, n_source, n_target) of blocks with both."""
        counts = [self.side(x).groupBy("block").agg(F.count(F.lit(1)).alias(f"n_{x}")) for x in ("source", "target")]
        return counts[0].join(counts[1], "block")

    def degrees(self, end: str) -> DataFrame:
        """(id, n): how many edges each node has that is their source, or target."""
        n = self.sized().select("block", F.col("n_target" if end == "source" else "n_source").alias("n"))
        return self.side(end).join(F.broadcast(n), "block").select(F.col(end).alias("id"), "n")

    def edges(self, ids: DataFrame | None = None, near: str = "source", first: int | None = None) -> DataFrame:
        """The edges one by one: all, or those whose `near` end is one of ids (id), with the first far ends of a block only."""
        far = "target" if near == "source" else "source"
        here, there = self.side(near), self.side(far)
        if ids is not None:
            here = here.join(ids.select(F.col("id").alias(near)), near, "left_semi")
        if first is not None:
            there = there.withColumn("_k", F.row_number().over(Window.partitionBy("block").orderBy(far))).filter(F.col("_k") <= first).drop("_k")
        rest = [F.lit(v).alias(c) for c, v in (("kind", self.kind), ("weight", self.weight), ("confidence", self.confidence), ("provenance_rank", self.provenance_rank))]
        return here.join(there, "block").select("source", "target", *rest)

    def pairs(self, sources: DataFrame, targets: DataFrame, lists: int = 16) -> DataFrame:
        """Each row of sources (source, block, ...) with each of targets (target, block, ...) of its block, without the block: a
        block's targets come as `lists` lists, so that a source meets few rows, and sources are dealt evenly to tasks first."""
        parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        kept = [c for c in targets.columns if c != "block"]
        listed = targets.groupBy("block", F.pmod(F.xxhash64("target"), F.lit(lists)).alias("_list")).agg(F.collect_list(F.struct(*kept)).alias("_rows"))
        met = sources.repartition(4 * parts, "source").join(listed, "block")
        return met.select(*[c for c in sources.columns if c != "block"], F.inline("_rows"))


def edges_of(edges: DataFrame, ids: DataFrame, near: str, blocks: Blocks | None = None, first: int | None = None) -> DataFrame:
    """Edges whose `near` end is one of ids (id); of blocks only the `first` far ends, where given, of each."""
    own = edges.join(ids.select(F.col("id").alias(near)), near, "left_semi")
    return own if blocks is None else own.unionByName(blocks.edges(ids, near, first).select(edges.columns))


def neighbours(edges: DataFrame, ids: DataFrame, direction: str = "out", blocks: Blocks | None = None) -> DataFrame:
    """(id) of nodes that an edge from ids (id) leads to or, with direction "in", comes from; they may repeat."""
    here, there = ("source", "target") if direction == "out" else ("target", "source")
    own = ids.select(F.col("id").alias(here))
    met = edges.join(own, here, "left_semi").select(F.col(there).alias("id"))
    if blocks is None:
        return met
    hit = blocks.side(here).join(own, here, "left_semi").select("block").distinct()
    return met.union(blocks.side(there).join(hit, "block", "left_semi").select(F.col(there).alias("id")))


def kind_counts(edges: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """(kind, n, weight): the edges of each kind and their sum of weights; those of blocks are counted as products."""
    own = edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    if blocks is None:
        return own
    n = blocks.sized().agg(F.sum(F.col("n_source") * F.col("n_target")).alias("n")).filter("n > 0")
    both = own.union(n.select(F.lit(blocks.kind), "n", F.col("n") * blocks.weight))
    return both.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6, blocks: Blocks | None = None) -> DataFrame:
    """(id, pagerank) of nodes (id) over weighted edges (source, target, weight) and those of blocks.

    Each round a node passes its rank on by weight; the rank of nodes without outgoing weight goes to all alike, and ranks
    are scaled to sum to 1, as what is sent to targets outside nodes is lost. Ends after `rounds` or once no rank moves by
    `tolerance`. Nodes get numbers first; edges are laid out once. A round is written; of many nodes (FEW_NODES) it shuffles a
    number and a sum for each target, combined before they travel. What a block's sources send is summed once for all its targets.
    Where nodes bring numbers (n, one an id), edges and blocks name these in place of ids.
    """
    own_numbers = "n" in nodes.columns
    numbered = cut(nodes.select("id", "n" if own_numbers else F.monotonically_increasing_id().alias("n")), "nodes")
    n = numbered.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def placed(rows: DataFrame, end: str, name: str, how: str = "inner") -> DataFrame:
        if own_numbers:
            return rows.withColumnRenamed(end, name)
        return rows.join(numbered.select(F.col("id").alias(end), F.col("n").alias(name)), end, how)

    shares = placed(placed(edges.select("source", "target", "weight"), "source", "s"), "target", "t", "left")
    shares = shares.select("s", "t", F.col("weight").cast("double").alias("w"))
    shares = shares if own_numbers else cut(shares, "shares")
    out = shares.groupBy("s").agg(F.sum("w").alias("out"))
    if blocks is not None:
        sizes = blocks.targets.groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
        givers = cut(placed(blocks.sources, "source", "s").join(F.broadcast(sizes), "block").select("s", "block", (F.col("_n") * blocks.weight).alias("w")), "givers")
        takers = cut(placed(blocks.targets, "target", "n").select("n", "block"), "takers")
        out = out.union(givers.select("s", "w")).groupBy("s").agg(F.sum("out").alias("out"))
    # Laid out once, by target where ranks are few enough for each task to have all of them, else by source; what an
    # executor loses of it is read again from the written table.
    few = n <= FEW_NODES
    shares = shares.filter("t is not null").repartition(parts, "t" if few else "s")
    shares = (shares if few else shares.sortWithinPartitions("s")).persist()
    ranks = numbered.select("n").join(out.filter("out > 0").withColumnRenamed("s", "n"), "n", "left")
    ranks = cut(ranks.select("n", "out", F.lit(1.0 / n).alias("rank")), "ranks")
    stuck = F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0))
    lost, scale = ranks.agg(stuck).first()[0], 1.0
    for _ in range(rounds):
        gives = ranks.filter("out is not null").select(F.col("n").alias("s"), (F.col("rank") * scale / F.col("out")).alias("_give"))
        sent = shares.join(F.broadcast(gives) if few else gives, "s").groupBy(F.col("t").alias("n")).agg(F.sum(F.col("_give") * F.col("w")).alias("_in"))
        if blocks is not None:
            sums = givers.join(gives, "s").groupBy("block").agg((F.sum("_give") * blocks.weight).alias("_in"))
            sent = sent.union(takers.join(sums, "block").select("n", "_in")).groupBy("n").agg(F.sum("_in").alias("_in"))
        base = (1 - damping) / n + damping * lost / n
        new = ranks.join(sent, "n", "left").select("n", "out", (F.col("rank") * scale).alias("before"), (F.lit(base) + damping * F.coalesce("_in", F.lit(0.0))).alias("rank"))
        ranks = cut(new, "ranks")
        total, held = ranks.agg(F.sum("rank"), stuck).first()
        lost, scale = held / total, 1 / total
        if tolerance > 0 and ranks.agg(F.max(F.abs(F.col("rank") * scale - F.col("before")))).first()[0] < tolerance:
            break
    shares.unpersist()
    return numbered.distinct().join(ranks, "n").select("id", (F.col("rank") * scale).alias("pagerank"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", blocked: DataFrame | None = None, blocks: Blocks | None = None) -> DataFrame:
    """(id, level) of nodes first met at each level, 1 to depth, from seeds (id) along edges or, with direction "in", against them.

    Seeds and blocked nodes (id) are neither reported nor passed through. Each level joins the frontier to the edges and
    takes away what was met before; it ends early where nothing new is met.
    """
    seen = cut(seeds.select("id").distinct().withColumn("level", F.lit(0)))
    frontier = seen.select("id")
    for level in range(1, depth + 1):
        met = neighbours(edges, frontier, direction, blocks).distinct()
        met = met.join(seen, "id", "left_anti")
        if blocked is not None:
            met = met.join(blocked.select("id"), "id", "left_anti")
        met = cut(met.withColumn("level", F.lit(level)))
        if met.isEmpty():
            break
        seen, frontier = cut(seen.union(met)), met.select("id")
    return seen.filter("level > 0")


def call_chain(edges: DataFrame, start: str, depth: int = 3, direction: str = "in", blocks: Blocks | None = None) -> DataFrame:
    """(level, id, via, kind) of nodes first met from `start`, with the least edge (by met node, then kind) that met each.

    depth is clamped to 1 .. 10.
    """
    depth = max(1, min(10, depth))
    here, there = ("source", "target") if direction == "out" else ("target", "source")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(0, start, None, None)], "level int, id string, via string, kind string")
    frontier = seen.select("id")
    for level in range(1, depth + 1):
        own = frontier.withColumnRenamed("id", here)
        step = edges.join(own, here).groupBy(F.col(there).alias("id")).agg(F.min(F.struct(F.col(here).alias("via"), "kind")).alias("_first"))
        if blocks is not None:
            least = blocks.side(here).join(own, here).groupBy("block").agg(F.min(F.struct(F.col(here).alias("via"), F.lit(blocks.kind).alias("kind"))).alias("_first"))
            step = step.union(blocks.side(there).join(least, "block").select(F.col(there), "_first")).groupBy("id").agg(F.min("_first").alias("_first"))
        step = cut(step.join(seen.select("id"), "id", "left_anti").select(F.lit(level).alias("level"), "id", "_first.via", "_first.kind"))
        if step.isEmpty():
            break
        seen, frontier = seen.union(step), step.select("id")
    return seen.filter("level > 0")


def degrees(edges: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """(id, n_out, n_in)."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target", F.lit(0), F.lit(1)))
    if blocks is not None:
        ends = ends.union(blocks.degrees("source").select("id", "n", F.lit(0))).union(blocks.degrees("target").select("id", F.lit(0), "n"))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def file_stats(symbols: DataFrame, ranks: DataFrame, edges: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """(file, n_symbols, rank, top_symbol, n_in, n_out): the top symbol has the highest rank, the least id of equals."""
    joined = symbols.join(ranks, "id").join(degrees(edges, blocks), "id", "left")
    return joined.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.sum("pagerank").alias("rank"), F.min_by("id", F.struct(-F.round("pagerank", 12), "id")).alias("top_symbol"),
        F.coalesce(F.sum("n_in"), F.lit(0)).alias("n_in"), F.coalesce(F.sum("n_out"), F.lit(0)).alias("n_out"),
    )


def impact(symbols: DataFrame, edges: DataFrame, files: DataFrame, depth: int, blocked: Column, blocks: Blocks | None = None) -> DataFrame:
    """(id, file, direction, level): symbols reached upstream (callers) and downstream of all symbols of files (file).

    Symbols of the files themselves and those whose file is `blocked` are neither reported nor passed through.
    """
    seeds = symbols.join(files.select("file"), "file", "left_semi").select("id")
    stop = symbols.filter(blocked).select("id")
    up = reach(edges, seeds, depth, "in", stop, blocks).withColumn("direction", F.lit("upstream"))
    down = reach(edges, seeds, depth, "out", stop, blocks).withColumn("direction", F.lit("downstream"))
    return up.union(down).join(symbols.select("id", "file"), "id").select("id", "file", "direction", "level")


def flat_references(symbols: DataFrame, edges: DataFrame, names: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """(name, file, line) of the neighbours, one hop either way, of all symbols of some names (name); each once."""
    own = symbols.join(names.select("name"), "name", "left_semi").select("id")
    ends = neighbours(edges, own, "in", blocks).union(neighbours(edges, own, "out", blocks))
    return symbols.join(ends, "id", "left_semi").select("name", "file", "line").distinct()


def edge_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key and change_type: added or removed rows between two sets of edges, compared on the whole key."""
    added = after.select(key).subtract(before.select(key)).withColumn("change_type", F.lit("added"))
    return added.union(before.select(key).subtract(after.select(key)).withColumn("change_type", F.lit("removed")))


def symbol_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, name, kind, change_type, severity): symbols added, removed, moved or modified between two snapshots.

    Symbols match by id. What is left is matched again by file, name and kind, the first of each side with the first of the
    other by line, which absorbs shifted lines. A changed signature is high severity, any other change low.
    """
    both = before.select("id", "signature", "visibility").join(after.select("id", "file", "name", "kind", F.col("signature").alias("_sig"), F.col("visibility").alias("_vis")), "id")
    changed = both.filter(~F.col("signature").eqNullSafe(F.col("_sig")) | ~F.col("visibility").eqNullSafe(F.col("_vis")))
    severity = F.when(~F.col("signature").eqNullSafe(F.col("_sig")), "HIGH").otherwise("LOW").alias("severity")
    modified = changed.select("file", "name", "kind", F.lit("modified").alias("change_type"), severity)
    order = Window.partitionBy("file", "name", "kind").orderBy("line", "id")
    gone = before.join(after.select("id"), "id", "left_anti").withColumn("_k", F.row_number().over(order))
    come = after.join(before.select("id"), "id", "left_anti").withColumn("_k", F.row_number().over(order))
    key = ["file", "name", "kind", "_k"]
    pair = gone.select(*key, F.col("signature").alias("_old"), F.lit(True).alias("_was")).join(come.select(*key, F.col("signature").alias("_new"), F.lit(True).alias("_is")), key, "full_outer")
    kind = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "moved").otherwise("modified")
    return modified.union(pair.select("file", "name", "kind", kind, F.when(kind == "modified", "HIGH").otherwise("LOW")))


def mermaid(targets: DataFrame, source: str, most: int = 30) -> DataFrame:
    """(mermaid): a flow chart of targets (target, p: rank of the best provenance) of one symbol, which is one of `most` nodes."""
    first = targets.orderBy("target").limit(most - 1)
    arrow = F.when(F.col("p").isin(1, 3), " -.-> ").otherwise(" --> ")
    line = F.concat(F.lit("  "), texts.mermaid_id(F.lit(source)), arrow, texts.mermaid_id(F.col("target")))
    body = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    more = targets.agg((F.count(F.lit(1)) - (most - 1)).alias("more"))
    note = F.when(F.col("more") > 0, F.concat(F.lit("\n%% "), F.col("more").cast("string"), F.lit(" more"))).otherwise("")
    return body.crossJoin(more).select(F.concat(F.lit("flowchart TD\n"), "body", note).alias("mermaid"))  # a row by a row
