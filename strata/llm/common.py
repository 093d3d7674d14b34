"""What the operators share: words, scratch tables in the cluster's shared folder, gapless numbering, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.scratch import cut as stage

__all__ = ["components", "number_within", "packed", "salted_join", "schema_with", "spanning", "stage", "unit_hash", "unpacked", "unstage", "word_count", "words_of"]

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
#: `bytes.split()` cuts a UTF-8 text at just these.
WORD = r"[^\x20\x09-\x0D]+"


def packed(table: pa.Table) -> bytes:
    """A table as a compressed stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def schema_with(df: DataFrame, columns: list[str], added: str) -> T.StructType:
    """The types of some columns of df, then those of a schema in words; all may be null."""
    own = df.select(*columns).schema.fields + T.StructType.fromDDL(added).fields
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in own])


def unstage(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def word_count(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: int, *columns: Column) -> Column:
    """A seeded 64-bit hash as a number from 0 (included) to 1 (excluded), in steps of 2**-53."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") / float(1 << 53)


def number_within(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int = 512) -> DataFrame:
    """df with `name`: 0, 1, 2 ... within each group, without gaps.

    A group, however large, is dealt to `buckets` by a hash of its order columns; each bucket is numbered by itself
    and starts where the buckets before it end. Rows equal in all order columns are numbered arbitrarily.
    group columns must not be null; df is read twice, so stage it if it is dear.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)))
    return own.join(starts, [*group, "_bucket"]).withColumn(name, F.col("_start") + F.col("_row") - 1).drop("_bucket", "_row", "_start")


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 8) -> DataFrame:
    """left with right's columns (null where it has none): a left join on key that deals the rows of a key, however many,
    to `salts` tasks by a hash of their `spread` column; right has a row a key and goes to each.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    return dealt.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [key, "_salt"], "left").drop("_salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches; both columns of one orderable type.

    Alternates large-star and small-star steps, each a grouped minimum joined back, until no edge changes; every round
    is staged. Self-links are kept as nodes. Rounds grow with the logarithm of the longest path.
    """
    links = stage(edges.select("a", "b").distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    links = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        starred = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = stage(starred.filter("a <> b").distinct(), "links")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstage(links)
        links = new
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(links.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def spanning(i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges than i - j with the same components over 0 .. size - 1: each node to the least of its component."""
    label = np.arange(size)
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(size))
    return moved, label[moved]
