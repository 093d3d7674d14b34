"""Best-fit decreasing packing of token sequences.

Documents are tokenised where they lie; only piece lengths travel. There are at most `capacity` different lengths, so the
whole corpus packs from its histogram of lengths: the driver runs best-fit decreasing over runs of equal pieces, asking a
segment tree over remaining capacities for the tightest open bin, and the plan that comes out has a bounded number of
rows whatever the corpus holds. The plan places exactly what a piece-by-piece best fit in order of falling length would.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import number_within, stage

CAPACITY = 2048
END_ID = 0


class CapacityTree:
    """Counts of open bins by remaining capacity, with the smallest sufficient capacity found in logarithmic time."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        at = self.size + remaining
        while at:
            self.sums[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least `need` that an open bin has."""
        at = self.size + need
        if self.sums[at]:
            return need
        while at > 1:
            if not at & 1 and self.sums[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.size:
            at = 2 * at if self.sums[2 * at] else 2 * at + 1
        return at - self.size


@dataclass(frozen=True)
class Placement:
    """Pieces of `length` with ranks in [first_rank, end_rank) fill bins from first_bin on, per_bin in each, from `offset`."""

    length: int
    first_rank: int
    end_rank: int
    first_bin: int
    per_bin: int
    offset: int


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Best-fit decreasing for counts[length] pieces of each length, as placements of whole runs.

    The tightest bin for a length stays the tightest while more of that length fit into it, so a run of bins with the
    same room takes room // length pieces each before the next run is asked for.
    """
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    tree, runs, plan, bins = CapacityTree(capacity), defaultdict(list), [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            runs[room].append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                opened = -(-left // (capacity // length))
                put(capacity, bins, opened)
                bins += opened
                continue
            first, n = runs[room].pop()
            tree.add(room, -n)
            fit = room // length
            full = min(n, left // fit)
            if full:
                plan.append(Placement(length, rank, rank + full * fit, first, fit, capacity - room))
                put(room - fit * length, first, full)
                rank, left = rank + full * fit, left - full * fit
            if left and full < n:
                plan.append(Placement(length, rank, rank + left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                left, full = 0, full + 1
            put(room, first + full, n - full)
    return plan


@functools.cache
def _encoders(path: str):
    """The tokenizer of a `tokenizers` file and, if the same vocabulary lies beside it as ranks, a faster encoder of the same ids."""
    import os

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    marks = [t.content for t in whole.get_added_tokens_decoder().values()]
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return whole, marks, None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return whole, marks, tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a text (null: none), then the end id, as little-endian unsigned 32-bit numbers."""
    if not text:
        return np.array([END_ID], "<u4")
    whole, marks, fast = _encoders(path)
    if fast is None or any(m in text for m in marks):
        ids = whole.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_to_numpy(text, disallowed_special=())
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1], out[-1] = ids, END_ID
    return out


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole capacities, after a shorter first piece if they don't come out even."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def tokenized_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document; a null text is an empty one: only its end id."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * keep_ids]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py(), tokenizer)
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    own = ids[start : start + length]
                    for column, value in zip(columns, (doc, k, start, length, zlib.crc32(own.tobytes()), own)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a staged table with doc_id, piece, length and more) with sequence_id and offset.

    Equal pieces are numbered in buckets, so a length that a third of all pieces have lands in no single task. The plan
    has at most some rows for each of the `capacity` lengths; that bound, not the corpus, sizes the broadcast.
    Repeated rows are pieces of their own. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = [(p.length, p.first_rank, p.end_rank, p.first_bin, p.per_bin, p.offset) for p in best_fit_plan(counts, capacity)]
    steps = spark.createDataFrame(plan, "length long, _first long, _end long, _bin long, _per long, _offset long")
    order = ["doc_id", "piece", *(["ids_crc32"] if "ids_crc32" in pieces.columns else [])]
    ranked = number_within(pieces, ["length"], order, "_rank")
    on = (ranked["length"] == steps["length"]) & (ranked["_rank"] >= steps["_first"]) & (ranked["_rank"] < steps["_end"])
    at = F.col("_rank") - F.col("_first")
    return ranked.join(F.broadcast(steps), on).select(
        *[ranked[c] for c in pieces.columns],
        (F.col("_bin") + F.floor(at / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_per") * ranked["length"]).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document with its sequence and place; see tokenized_pieces and place."""
    return place(stage(tokenized_pieces(docs, tokenizer, id_col, text_col, capacity), "pieces"), capacity)
