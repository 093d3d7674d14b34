"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Covering masks (Pagh, 2016): every bit position gets a nonzero vector of radius + 1 bits, and every nonzero vector v of as
many bits gives a mask, the positions whose vector has an odd product with v. Positions that differ between two
fingerprints, at most `radius` of them, span less than the whole space, so some v is orthogonal to all of them: under its
mask the two are equal. The guarantee is certain, not likely.

Within a table's bucket no pairs are formed at radius 2: two fingerprints are within 2 bits exactly if they share a
fingerprint within 1 bit of both, so each one names all values within 1 bit of itself under the unmasked bits, and those
naming the same value are linked to the least of them. At a larger radius a bucket is compared in blocks, a crowded one in
chunks that are tasks of their own, and a block gives the edges of a spanning forest only.

keep_one() takes as candidates what fingerprints link and what shares a band of least shingle hashes, which misses a pair alike
by s with a probability of (1 - s ** ROWS) ** BANDS at most, and lets the shingle sets of their texts decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import components, salted_join, spanning, stage

BITS = 64
SEED = 42
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 14
#: The least bytes of a content word, and fingerprints of a bucket that are compared in one block.
CONTENT_BYTES, CHUNK = 5, 1024
#: Words of a shingle and the share of common shingles that the exact check asks for; words of a chunk of a group it compares.
WIDTH, ALIKE, CHUNK_WORDS = 5, 0.8, 1 << 19
#: Bands of least hashes of a shingle set and hashes in each: a pair alike by 0.8 shares no band with a probability of 0.0017.
BANDS, ROWS = 16, 5
_MIXERS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[1], [0]], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, as an unsigned number: those set in over half of the hashes of the text's word shingles.

    A to Z are lower-cased. A text of fewer words has its whole sequence as its one shingle; of none (or null), 0.
    """
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    total, ones, digest = len(words) - width + 1, np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        part = words[at : min(total, at + BLOCK) + width - 1]
        runs = zip(*[part[k:] for k in range(width)])
        hashes = np.fromiter([digest(x, SEED) for x in map(b" ".join, runs)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def content_fingerprint(text: str | None, least: int = CONTENT_BYTES) -> int:
    """As fingerprint(), of the set of words of `least` bytes or more; of all words where there are none.

    Each word counts once, so common words don't draw all texts together, and a changed word moves a few bits only.
    """
    words = set() if text is None else set(text.encode("utf-8", "surrogatepass").lower().split())
    words = {w for w in words if len(w) >= least} or words
    return _majority(sorted(words)) if words else 0


def _majority(features: list[bytes]) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(features), BLOCK):
        hashes = np.fromiter([xxhash.xxh64_intdigest(x, SEED) for x in features[at : at + BLOCK]], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(features), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int | None = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number; of word shingles or, where shingle is None, of content words."""
    own = content_fingerprint if shingle is None else (lambda text: fingerprint(text, shingle))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((own(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2 ** (radius + 1) - 1 masks; any two values that differ in at most `radius` bits are equal under one of them."""
    span = (1 << (radius + 1)) - 1

    def built(step: int) -> list[int]:
        vectors = [1 + i * step % span for i in range(bits)]
        return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, span + 1)]

    # Any vectors cover; of some steps through them the one whose weakest mask has most bits keeps all buckets small.
    return max((built(step) for step in range(1, min(span, 64) + 1)), key=lambda masks: min(m.bit_count() for m in masks))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within `radius` bits.

    Nothing is dropped from a crowded bucket, and the rows that come out grow with the fingerprints, not with pairs.
    """
    return _named(distinct) if radius == 2 else _compared(distinct, radius)


def label_links(labelled: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between different labels of distinct fingerprints (fp, label), those of one label being linked already:
    the components of labels are those of all pairs within `radius` bits, and what a label holds gives no edge.
    """
    return _compared(labelled.select("fp"), radius, labelled.filter("fp <> label"))


def _named(distinct: DataFrame) -> DataFrame:
    """Links at radius 2 through the values within 1 bit."""
    masks = covering_masks(2)
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(tables).alias("_k")).select("fp", "_k.table", "_k.key")
    crowded = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    met = keyed.join(crowded, ["table", "key"])
    flips = [F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not mask >> i & 1]) for mask in masks]
    around = F.element_at(F.array(*flips), F.col("table") + 1)
    near = met.select("table", "fp", F.explode(around).alias("_flip")).select("table", "fp", F.col("fp").bitwiseXOR(F.col("_flip")).alias("value"))
    stars = near.groupBy("table", "value").agg(F.min("fp").alias("b"), F.max("fp").alias("_most")).filter("b < _most").select("table", "value", "b")
    return near.join(stars, ["table", "value"]).filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def _compared(distinct: DataFrame, radius: int, labels: DataFrame | None = None) -> DataFrame:
    """Links at any radius by comparing within blocks: first each bucket, or each of the chunks that a crowded one is dealt
    to, then two chunks of a bucket, whose fingerprints bring the label that the first pass gave them, so that a pair of
    chunks gives an edge for each two labels that it joins and not for each fingerprint. Where fingerprints have labels
    (fp, label) beforehand, edges are between these; a fingerprint that has none is its own.

    A bucket's number mixes the table with what its mask leaves; two buckets of one number are compared in vain, no more.
    """
    masks = np.array(covering_masks(radius), np.uint64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 4096) for k in range(0, whole.num_rows, 4096)):
                prints = batch.column(0).to_numpy().view(np.uint64)
                number = (prints[:, None] & masks) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, len(masks) + 1, dtype=np.uint64)
                number = (number ^ number >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
                yield pa.RecordBatch.from_arrays([pa.array(number.view(np.int64).ravel()), pa.array(np.repeat(prints.view(np.int64), len(masks)))], ["bucket", "fp"])

    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select("fp").repartition(tasks).mapInArrow(scatter, "bucket long, fp long")
    met = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).filter("_n > 1")
    chunks = F.ceil(F.col("_n") / CHUNK).cast("long").alias("chunks")
    dealt = met.select("bucket", chunks, "fp").select("bucket", "chunks", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("own"), "fp")
    dealt = dealt.withColumn("was", F.col("fp")) if labels is None else dealt.join(labels, "fp", "left").withColumn("was", F.coalesce("label", "fp"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, 3):
            names, at = np.unique(rows[:, 4], return_inverse=True)
            i, j = _near(rows[:, :3], rows[:, 3], radius)
            i, j = spanning(at[i], at[j], len(names))
            least = names.copy()
            least[i] = names[j]
            label = least[at]
            kept = (rows[:, 1] > 1) | (label != rows[:, 4])
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[kept, k]) for k in range(5)), pa.array(label[kept])], ["bucket", "chunks", "own", "fp", "was", "label"])

    own = dealt.repartition("bucket", "own").sortWithinPartitions("bucket", "own").select("bucket", "chunks", "own", "fp", "was")
    own = stage(own.mapInArrow(within, "bucket long, chunks long, own long, fp long, was long, label long"), "buckets")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, 3):
            i, j = _near(rows[:, :3], rows[:, 3], radius)
            names, at = np.unique(rows[:, 4], return_inverse=True)
            i, j = spanning(at[i], at[j], len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j])], ["a", "b"])

    pairs = own.filter("chunks > 1").withColumn("_other", F.explode(F.expr("filter(sequence(0L, chunks - 1), x -> x <> own)")))
    pairs = pairs.select("bucket", F.least("own", "_other").alias("first"), F.greatest("own", "_other").alias("second"), "fp", "label")
    pairs = pairs.repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")
    edges = own.filter("was <> label").select(F.col("was").alias("a"), F.col("label").alias("b"))
    return edges.union(pairs.mapInArrow(between, "a long, b long")).distinct()


def _blocks(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[np.ndarray]:
    """Sorted rows of whole numbers as arrays that end where a block, rows alike in the first `key` columns, does."""
    kept = None
    for batch in batches:
        rows = np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])
        rows = rows if kept is None else np.concatenate([kept, rows])
        if not len(rows):
            continue
        # The last block may go on in the next batch.
        open_ = np.flatnonzero((rows[:, :key] != rows[-1, :key]).any(axis=1))
        cut = int(open_[-1]) + 1 if len(open_) else 0
        if cut:
            yield rows[:cut]
        kept = rows[cut:]
    if kept is not None and len(kept):
        yield kept


def _near(blocks: np.ndarray, signed: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges i - j of the fingerprints within `radius` bits in each run of rows of equal blocks."""
    block = np.zeros(len(blocks), np.int64)
    block[1:] = np.cumsum((blocks[1:] != blocks[:-1]).any(axis=1))
    prints, found_i, found_j, held = signed.copy().view(np.uint64), [], [], 0
    at = np.arange(len(blocks))
    for step in range(1, len(blocks)):
        at = at[: np.searchsorted(at, len(blocks) - step)]
        at = at[block[at] == block[at + step]]
        if not len(at):
            break
        close = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= radius]
        found_i.append(close)
        found_j.append(close + step)
        held += len(close)
        if held > 2_000_000:
            i, j = spanning(np.concatenate(found_i), np.concatenate(found_j), len(blocks))
            found_i, found_j, held = [i], [j], len(i)
    return spanning(np.concatenate([*found_i, at[:0]]), np.concatenate([*found_j, at[:0]]), len(blocks))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int | None = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that a document reaches over links of at most `radius` bits.

    Equal fingerprints are one node, so copies cost a row each and never a pair. Null, empty and wordless texts have
    fingerprint 0 and are linked like any other. Rows that repeat a doc_id each get a row. Empty tables give none.
    """
    prints = stage(fingerprints(docs, shingle, id_col, text_col), "prints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp"), radius))
    joined = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = stage(joined, "joined")
    # A component may hold any share of the fingerprints: its id is dealt to all of them by salt.
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("component", "component_id")
    named = salted_join(joined, ids, "component", "fp").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different hashes, in order, of the text's shingles of `width` words, A to Z lower-cased.

    A text of fewer words has its whole sequence as its one shingle; of none (or null), no shingle.
    """
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    width = min(width, len(words))
    runs = zip(*[words[k : len(words) - width + 1 + k] for k in range(width)])
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, runs)), np.uint64))


def bands(shingles: np.ndarray) -> np.ndarray:
    """BANDS numbers of a shingle set, each a hash of ROWS least values under hash functions of its own; none of no shingles."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK // 16):
        mixed = (shingles[at : at + BLOCK // 16, None] ^ _MIXERS[1]) * _MIXERS[0]
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, mixed.min(axis=0))
    return np.fromiter((xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, ROWS))), np.uint64, BANDS)


def band_links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints of classes (fp, bands): each of those that share a band to the least of them."""
    rows = classes.select(F.explode("bands").alias("band"), "fp").distinct()
    least = rows.groupBy("band").agg(F.min("fp").alias("b"), F.max("fp").alias("_most")).filter("b < _most").select("band", "b")
    return rows.join(least, "band").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def candidates(classes: DataFrame, radius: int) -> DataFrame:
    """classes (fp, bands, digest ...) with component, the least fp that theirs reaches over shared bands and fingerprints
    within `radius` bits. Bands come first and label the fingerprints; these then link labels only, so that a group of like
    texts, found under one band as under many masks, isn't linked once for each mask again.
    """
    banded = components(band_links(classes)).select(F.col("node").alias("fp"), F.col("component").alias("label"))
    labels = classes.select("fp").distinct().join(banded, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
    labels = stage(labels, "labels")
    found = components(label_links(labels, radius)).withColumnRenamed("node", "label")
    # A label, as a component, may hold any share of the rows.
    joined = salted_join(classes.join(labels, "fp"), found, "label", "digest")
    return joined.withColumn("component", F.coalesce("component", "label")).drop("label")


def alike(sets: list[np.ndarray], side: np.ndarray, least: float = ALIKE, label: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Edges i - j, fewer than sets, with the components of all pairs of sets that share `least` of their union or more.

    Where side has two values, only pairs between the sides count. A pair that edges, or labels that are equal, connect
    already isn't compared.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends, owner, two = np.cumsum(sizes), np.repeat(np.arange(len(sets)), sizes), side.min() != side.max()
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked, group, found_i, found_j = np.zeros(len(flat) + 1, bool), np.arange(len(sets)) if label is None else label.copy(), [], []
    for p in range(len(sets) - 1):
        open_ = (group != group[p]) & (np.minimum(sizes, sizes[p]) >= least * 0.999 * np.maximum(sizes, sizes[p])) & (sizes > 0)
        open_[: p + 1] = False
        if two:
            open_ &= side != side[p]
        if not open_.any():
            continue
        own = flat[ends[p] - sizes[p] : ends[p]]
        marked[own] = True
        shared = np.bincount(owner[marked[flat]], minlength=len(sets))
        marked[own] = False
        close = np.flatnonzero(open_)
        close = close[shared[close] / (sizes[close] + sizes[p] - shared[close]) >= least]
        if len(close):
            joined, one = np.unique(group[close], return_index=True)
            found_i += [p] * len(one)
            found_j += close[one].tolist()
            group[np.isin(group, joined)] = group[p]
    return found_i, found_j


def verified(docs: DataFrame, members: DataFrame, width: int = WIDTH, least: float = ALIKE) -> DataFrame:
    """Edges (a, b) between the digests of members (digest, component, n, doc_id, print) of one component whose texts in
    docs (doc_id, print, text) have shingle sets alike by `least`; their components are those of all such pairs.

    Only texts of components with several digests are read. A component is compared whole, or, where it is large by rows or
    words, dealt to chunks: first each by itself, which labels its rows, then two chunks at a time, which give an edge for
    each two labels that they join.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_words")).filter("_rows > 1")
    sizes = sizes.select("component", F.ceil(F.greatest(F.col("_rows") / CHUNK, F.col("_words") / CHUNK_WORDS)).cast("int").alias("chunks"))
    own = salted_join(members, sizes, "component", "digest").filter("chunks is not null")
    own = own.select("digest", "component", "chunks", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int").alias("side"), F.col("doc_id").alias("_id"), F.col("print").alias("_print"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                names, rows = batch.column(0).to_pylist(), []
                for k, name in enumerate(names):
                    if name != last:  # rows that repeat stand together
                        rows.append(k)
                    last = name
                sets = [shingle_set(batch.column(5)[k].as_py(), width).view(np.int64) for k in rows]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns[:5]), pa.array(sets, pa.list_(pa.int64()))], ["digest", "label", "component", "chunks", "side", "shingles"])

    def shingled(rows: DataFrame) -> DataFrame:
        """rows (digest, label, component, chunks, side, _id, _print) with the shingle sets of their texts."""
        texts = docs.join(rows, (F.col("print") == F.col("_print")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("digest", "label", "component", "chunks", "side", "text")
        return texts.mapInArrow(cut, "digest string, label string, component long, chunks int, side int, shingles array<long>")

    def sets_of(table: pa.Table) -> list[np.ndarray]:
        lists = table["shingles"].combine_chunks()
        return np.split(lists.flatten().to_numpy().view(np.uint64), np.cumsum(lists.value_lengths().to_numpy())[:-1])

    def within(table: pa.Table) -> pa.Table:
        names, i = table["digest"].to_pylist(), np.arange(table.num_rows)
        found = spanning(*(np.array(x, np.int64) for x in alike(sets_of(table), np.zeros(len(names)), least)), len(names))
        i[found[0]] = found[1]
        whole = table["chunks"][0].as_py() == 1
        rows = {(a, names[k]) for a, k in zip(names, i) if a != names[k] or not whole}
        return pa.table({"a": pa.array([a for a, _ in rows], pa.string()), "b": pa.array([b for _, b in rows], pa.string()), "whole": pa.array([whole] * len(rows), pa.bool_())})

    def between(table: pa.Table) -> pa.Table:
        names, label = np.unique(table["label"].to_pylist(), return_inverse=True)
        side = table["side"].to_numpy()
        i, j = alike(sets_of(table), side, least, label) if side.min() != side.max() else ([], [])
        edges = {(str(names[label[x]]), str(names[label[y]])) for x, y in zip(i, j)}
        return pa.table({"a": pa.array([a for a, _ in edges], pa.string()), "b": pa.array([b for _, b in edges], pa.string())})

    first = shingled(own.withColumn("label", F.col("digest"))).groupBy("component", "side").applyInArrow(within, "a string, b string, whole boolean")
    first = stage(first, "within")
    labels = first.filter("not whole").select(F.col("a").alias("digest"), F.col("b").alias("label")).distinct()
    again = shingled(own.filter("chunks > 1").join(labels, "digest")).withColumn("_other", F.explode(F.expr("filter(sequence(0, chunks - 1), x -> x <> side)")))
    again = again.select("component", F.least("side", "_other").alias("first"), F.greatest("side", "_other").alias("second"), "side", "label", "shingles")
    second = again.groupBy("component", "first", "second").applyInArrow(between, "a string, b string")
    return first.select("a", "b").filter("a <> b").union(second)


def keep_one(docs: DataFrame, radius: int = 6, width: int = WIDTH, least: float = ALIKE) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest doc_id; the columns stay.

    Candidates are the texts that share one of BANDS bands of least hashes of their five-word shingles, which any two
    alike by 0.8 do but for 0.2 %, whatever was changed, and besides those with fingerprints of content words within
    `radius` bits. Then the candidates' shingle sets decide: texts are linked if alike by `least`, or if their words are the same. Texts without
    words (null or empty) are the same. A null doc_id comes after all others. Of rows that repeat one stays; rows that
    repeat a doc_id only are held apart by their texts. Empty tables give no rows.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, digests, n, banded = np.zeros(batch.num_rows, np.uint64), [], [], []
            for k, text in enumerate(batch.column(2)):
                text = text.as_py()
                words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
                prints[k] = content_fingerprint(text)
                digests.append(xxhash.xxh128_hexdigest(b" ".join(words), SEED))
                n.append(len(words))
                banded.append(bands(shingle_set(text, width)).view(np.int64))
            columns = [*batch.columns[:2], pa.array(prints.view(np.int64)), pa.array(digests, pa.string()), pa.array(n, pa.int64()), pa.array(banded, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "fp", "digest", "n", "bands"])

    # A row's key: its id and a hash of its text, never null.
    row_print = F.xxhash64(F.col("text"), F.col("doc_id").isNull())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_print.alias("print"), "text")
    prints = texts.mapInArrow(hashed, "doc_id long, print long, fp long, digest string, n long, bands array<long>")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", "print"))
    classes = stage(prints.groupBy("digest").agg(F.min("fp").alias("fp"), F.max("n").alias("n"), F.first("bands").alias("bands"), first.alias("first")), "classes")
    members = stage(candidates(classes, radius).select("digest", "component", "n", "first.doc_id", "first.print", "first"), "members")
    groups = components(verified(texts, members.drop("first"), width, least)).select(F.col("node").alias("digest"), F.col("component").alias("group"))
    kept = members.join(groups, "digest", "left").groupBy(F.coalesce("group", "digest").alias("group")).agg(F.min("first").alias("first"))
    kept = kept.select(F.coalesce("first.doc_id", F.lit(0)).alias("_kept_id"), F.col("first.print").alias("_kept_print"))
    names = [f"_{k}" for k in range(len(docs.columns))]
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("row_id"), row_print.alias("row_print"), *[F.col(f"`{c}`").alias(x) for x, c in zip(names, docs.columns)])
    own = keyed.join(kept, (F.col("row_id") == F.col("_kept_id")) & (F.col("row_print") == F.col("_kept_print")), "left_semi").dropDuplicates(["row_id", "row_print"])
    return own.select(*[F.col(x).alias(c) for x, c in zip(names, docs.columns)])
