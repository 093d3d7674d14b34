"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions.

A water level is raised over all sources: a source's target is level * weight, but never above `epochs` times its size.
What a clamped source can't take is reshared among the others by weight, until none is above its cap. A source that takes
r times its size gives every document floor(r) times, and once more a part of its documents that has the remaining
share of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import salted_join, stage, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: The top bits of a document's hash name one of 4096 slices of its source.
SLICE_BITS = 12


def targets(sources: DataFrame, budget: float, epochs: float = 2.0) -> DataFrame:
    """sources (source_size, weight and more) with `target`: their shares of budget * all sizes under the caps.

    The sources stay a table; the driver sees three sums a round. A round clamps at least one more source or ends, and
    clamping raises the level, so a source once clamped stays clamped. Where the caps hold less than the budget, all
    sources are at their caps. Sources of size 0 get 0.
    """
    cap = epochs * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        over = level * F.col("weight") >= cap
        n, held, weight = sources.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == clamped or not weight:
            break
        clamped, level = n, max(level, (budget * total - held) / weight)
    target = F.least(cap, F.lit(level) * F.col("weight")) if weight else cap
    return sources.withColumn("target", target.cast("double"))


def weigh(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources with `weight`: the weights in turn over the sources by code point, a null source last.

    The sources are sorted in ranges, not in one task; each range starts where those before it end.
    """
    n = max(1, min(64, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = stage(sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "sources")
    before, starts = 0, []
    for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():  # a row per range: 64 at most
        starts.append((r["_range"], before))
        before += r["n"]
    starts = sources.sparkSession.createDataFrame(starts, "_range int, _start long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    ranked = dealt.withColumn("_own", own).join(F.broadcast(starts), "_range")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    at = (F.col("_start") + F.col("_own") - 1) % len(weights)
    return ranked.withColumn("weight", F.element_at(cycle, (at + 1).cast("int"))).drop("_range", "_start", "_own")


def mix_plan(docs: DataFrame, seed: int = 17, budget: float = 1.5, epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", size: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats) of each row of docs: how often the mix takes it.

    The documents of a source are ordered by a seeded hash. The fractional epoch takes them from the front while they
    fit; what the next one, too long, leaves open is filled by the largest ones that fit, one of each power of two.
    So a source misses its target by less than its smallest untaken documents, and by whole documents only. Rows that
    repeat a doc_id are taken alike. Size is the number of words of the text; a null text has 0, a null source is a
    source of its own. Empty tables give no rows.
    """
    size = word_count(F.col("text")) if size is None else size
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), size.cast("long").alias("size"), order.alias("_h"))
    rows = stage(rows.withColumn("_slice", F.shiftrightunsigned("_h", 64 - SLICE_BITS)), "sizes")

    slices = stage(rows.groupBy("source", "_slice").agg(F.sum("size").alias("_mass")), "slices")
    sources = targets(stage(weigh(slices.groupBy("source").agg(F.sum("_mass").alias("source_size"))), "weights"), budget, epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("_whole", F.floor(ratio).cast("int")).withColumn("_part", F.round(F.col("target") - F.floor(ratio) * F.col("source_size")).cast("long"))
    sources = stage(sources, "targets")

    # The slice of each source in which its fractional epoch ends, and the words of the slices before it.
    by_slice = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    begun = slices.withColumn("_before", F.coalesce(F.sum("_mass").over(by_slice), F.lit(0)))
    begun = _with_source(begun, sources.select("source", "_part")).filter("_before < _part")
    ends = begun.groupBy("source").agg(F.max(F.struct("_slice", "_before")).alias("_at")).select("source", F.col("_at._slice").alias("_last"), F.col("_at._before").alias("_before"))
    sources = stage(_with_source(sources, ends, "left"), "ends")

    # A source may hold any share of the rows: its few numbers are dealt to all of them by salt.
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    whole = salted_join(rows.withColumn("_key", key), sources.withColumn("_key", key).drop("source"), "_key", "_h").drop("_key")
    last = F.col("_slice") == F.col("_last")
    in_order = Window.partitionBy("source").orderBy(F.struct("_h", "doc_id")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = whole.filter(last).withColumn("_upto", F.col("_before") + F.sum("size").over(in_order))
    edge = edge.withColumn("_more", F.col("_upto") <= F.col("_part")).drop("_upto")
    rest = whole.filter(F.col("_last").isNull() | ~last).withColumn("_more", F.coalesce(F.col("_slice") < F.col("_last"), F.lit(False)))
    chosen = stage(rest.unionByName(edge), "chosen")

    taken = chosen.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("_more"), F.col("size"))), F.lit(0)).alias("_have"))
    room = _with_source(sources.select("source", "_part"), taken).select("source", (F.col("_part") - F.col("_have")).alias("_room"))
    open_ = _with_source(chosen.filter(~F.col("_more") & (F.col("size") > 0)).select("source", "doc_id", "size"), room).filter("size <= _room")
    # One document of each power of two: at most 63 of a source, taken in order of falling size while they fit.
    best = open_.groupBy("source", "_room", F.floor(F.log2("size")).alias("_class")).agg(F.max(F.struct("size", "doc_id")).alias("_best"))
    listed = best.groupBy("source", "_room").agg(F.sort_array(F.collect_list("_best"), asc=False).alias("_list"))
    fill = F.aggregate(
        "_list",
        F.struct(F.col("_room").alias("room"), F.array().cast("array<bigint>").alias("ids")),
        lambda acc, x: F.when(x["size"] <= acc["room"], F.struct((acc["room"] - x["size"]).alias("room"), F.concat(acc["ids"], F.array(x["doc_id"])).alias("ids"))).otherwise(acc),
    )
    added = listed.select(F.col("source").alias("_s"), F.explode(fill["ids"]).alias("_id"))
    out = chosen.join(added, F.col("source").eqNullSafe(F.col("_s")) & (F.col("doc_id") == F.col("_id")), "left")
    repeats = F.col("_whole") + F.when(F.col("_more") | F.col("_id").isNotNull(), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", repeats.cast("int").alias("repeats"))


def _with_source(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on the source, where null equals null; which side is small is left to the planner."""
    other = sources.withColumnRenamed("source", "_of")
    return rows.join(other, F.col("source").eqNullSafe(F.col("_of")), how).drop("_of")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """docs with each row as often as the mix takes it, its columns unchanged.

    Rows are matched by id and source with equality of nulls; a repeated row is repeated as often as each of its like.
    """
    # Columns go by their places, whatever their names.
    place = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    plan = mix_plan(docs, **parameters).groupBy(F.col("doc_id").alias("doc"), F.col("source").alias("of")).agg(F.max("repeats").alias("repeats"))
    rows = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in place.items()])
    same = F.col(place[parameters.get("id_col", "doc_id")]).eqNullSafe(F.col("doc")) & F.col(place["source"]).cast("string").eqNullSafe(F.col("of"))
    out = rows.join(plan, same).filter("repeats > 0")
    out = out.select(*place.values(), F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy"))
    return out.select(*[F.col(p).alias(c) for c, p in place.items()])
