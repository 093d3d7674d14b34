"""Scores of texts under a log-bilinear language model, with an add-one unigram model beside it.

The model's vocabulary is bounded: each of the TOP most frequent words is an entry, the others go by their last two bytes, the
TAILS most frequent such endings and a rest. An entry has a context vector and an output vector; the vectors of the two entries
before a token, each turned by a matrix of its distance, are added and compared with the output vectors of all entries. The
vectors start from the leading directions of the corpus's counted pairs and are trained by noise-contrastive estimation over
the training texts in rounds: each task moves a copy over its own texts, and the copies are averaged by their tokens, so the
steps grow with the corpus. As the two contexts add up, the sum that normalises any pair of them is an entry of one batched
matrix product, made once. An entry that stands for many words gives each an add-one share of their training counts.

Counts of all words are gathered from the whole corpus. They are looked up block by block: a block of documents asks for the
counts of its own distinct words outside the vocabulary only, so neither all words nor all texts are ever in one place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import packed, schema_with, stage, unpacked

TOP, TAILS, WIDTH = 1280, 255, 32
#: UTF-8 bytes of text in a block, about.
BLOCK_BYTES = 12_000_000
#: The token that ends a text; no word has a space.
END = b" "
#: Training: rounds, into how many parts the texts are dealt, one of them a round, so that two rounds over two parts train on each
#: text once; tokens in a step, noise entries in a step, first step size, and the counts by which seldom pairs are drawn to the
#: mean at the start.
ROUNDS, EACH, BATCH, NOISE, RATE, PRIOR = 2, 2, 1024, 64, 0.03, 50.0


def tokens(text: str | None) -> list[bytes]:
    """The words of a text (null: none), A to Z lower-cased, then the end."""
    return [*(b"" if text is None else text.encode("utf-8", "surrogatepass")).lower().split(), END]


@dataclass
class Classes:
    """The class of a word: its own, or its ending's, or the rest. The last number stands before the first token."""

    words: dict[bytes, int]
    tails: dict[bytes, int]

    @property
    def n(self) -> int:
        return len(self.words) + len(self.tails) + 1

    def of(self, word: bytes) -> int:
        at = self.words.get(word)
        return at if at is not None else self.tails.get(word[-2:], self.n - 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all tokens of docs (text): counted in each task, then by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(tokens(text.as_py()))
            if len(found) > 1_000_000:
                yield from _rows(found)
                found = Counter()
        yield from _rows(found)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _rows(found: Counter) -> Iterator[pa.RecordBatch]:
    words, n = list(found), list(found.values())
    for k in range(0, len(words), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 50_000], pa.binary()), pa.array(n[k : k + 50_000], pa.int64())], ["word", "n"])


def choose_classes(counts: DataFrame, top: int = TOP, tails: int = TAILS) -> Classes:
    """The classes of a corpus: the driver sees only the `top` words and `tails` endings."""
    first = [bytes(r["word"]) for r in counts.orderBy(F.desc("c"), "word").limit(top).collect()]
    size = F.length("word")
    ending = F.substring("word", F.greatest(size - 1, F.lit(1)), F.lit(2)).alias("tail")
    others = counts.filter(~F.col("word").isin(first)) if first else counts
    last = [bytes(r["tail"]) for r in others.groupBy(ending).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "tail").limit(tails).collect()]
    return Classes({w: k for k, w in enumerate(first)}, {t: len(first) + k for k, t in enumerate(last)})


def pair_counts(docs: DataFrame, classes: Classes) -> DataFrame:
    """(pair, n): how often a class follows another in docs (text), as before * (classes + 1) + after."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        width = own.n + 1
        total = np.zeros(width * width, np.int64)
        cache: dict[bytes, int] = dict(own.words)
        for batch in batches:
            for text in batch.column(0):
                ids = class_ids(tokens(text.as_py()), own, cache)
                np.add.at(total, np.append(own.n, ids[:-1]) * width + ids, 1)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pair", "n"])

    return docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def class_ids(words: list[bytes], classes: Classes, cache: dict[bytes, int]) -> np.ndarray:
    if len(cache) > 500_000:
        cache.clear()
    try:
        return np.array([cache[w] for w in words], np.int64)
    except KeyError:
        for w in words:
            if w not in cache:
                cache[w] = classes.of(w)
        return np.array([cache[w] for w in words], np.int64)


Parameters = dict[str, np.ndarray]


def start(pairs: np.ndarray, counts: np.ndarray, n: int, width: int = WIDTH, seed: int = 8) -> Parameters:
    """Vectors whose products are nearest to the logarithms of how much oftener than by chance an entry follows another.

    A randomised singular value decomposition, rows weighed by their counts; the farther context starts at a weaker turn.
    """
    before, after = np.divmod(pairs, n + 1)
    table = np.zeros((n + 1, n))
    table[before, after] = counts
    q = table.sum(axis=0) + 0.5
    q /= q.sum()
    rows = table.sum(axis=1, keepdims=True)
    weight = np.sqrt(rows + 1)
    table += PRIOR * q
    table /= (rows + PRIOR) * q
    np.log(table, out=table)
    table *= weight
    basis = np.random.default_rng(seed).standard_normal((n, min(n, width + 16)))
    for _ in range(3):
        basis = np.linalg.qr(table.T @ (table @ basis))[0]
    u, s, v = np.linalg.svd(table @ basis, full_matrices=False)
    kept = min(width, len(s))
    inputs, outputs = np.zeros((n + 1, width)), np.zeros((n, width))
    inputs[:, :kept] = u[:, :kept] * np.sqrt(s[:kept]) / weight
    outputs[:, :kept] = (basis @ v.T)[:, :kept] * np.sqrt(s[:kept])
    scale = np.sqrt((np.square(outputs).mean() + 1e-12) / (np.square(inputs).mean() + 1e-12)) ** 0.5
    return {"inputs": inputs * scale, "outputs": outputs / scale, "near": 0.6 * np.eye(width), "far": 0.4 * np.eye(width), "bias": np.log(q)}


def contrast(m: Parameters, c1: np.ndarray, c2: np.ndarray, t: np.ndarray, z: np.ndarray, log_q: np.ndarray) -> tuple[np.ndarray, np.ndarray, Parameters]:
    """Telling the entries t after contexts c1 and c2 from noise entries z: the log odds of the true ones and of the noise to
    be true, and the slopes of the log likelihood by token.
    """
    near, far = m["inputs"][c1], m["inputs"][c2]
    context = near @ m["near"] + far @ m["far"]
    odds = m["bias"] - log_q - m["bias"].dtype.type(np.log(len(z)))
    true = np.einsum("ij,ij->i", context, m["outputs"][t]) + odds[t]
    false = context @ m["outputs"][z].T + odds[z]
    share = np.float32(1 / len(t))
    up, down = share / (1 + np.exp(np.minimum(true, 50))), -share / (1 + np.exp(np.minimum(-false, 50)))
    slope = up[:, None] * m["outputs"][t] + down @ m["outputs"][z]
    outputs, inputs = np.zeros_like(m["outputs"]), np.zeros_like(m["inputs"])
    _add(outputs, t, up[:, None] * context)
    _add(outputs, z, down.T @ context)
    _add(inputs, c1, slope @ m["near"].T)
    _add(inputs, c2, slope @ m["far"].T)
    n = len(m["bias"])
    return true, false, {"inputs": inputs, "outputs": outputs, "near": near.T @ slope, "far": far.T @ slope, "bias": np.bincount(t, up, n) + np.bincount(z, down.sum(axis=0), n)}


def _add(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to table at places that may repeat."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    table[at[order][first]] += np.add.reduceat(rows[order], first, axis=0)


class Trainer:
    """A copy of the parameters that moves by AdaGrad; what is left of a step stays for the next call."""

    def __init__(self, m: Parameters, rate: float, seed: int) -> None:
        self.m, self.rate, self.rng, self.tokens = {k: v.astype(np.float32) for k, v in m.items()}, np.float32(rate), np.random.default_rng(seed), 0
        self.sums = {k: np.full_like(v, 4e-6) for k, v in self.m.items()}
        log_q = m["bias"] - np.log(np.exp(m["bias"]).sum())
        self.log_q, self.ends = log_q.astype(np.float32), np.cumsum(np.exp(log_q))
        self.rest: list[np.ndarray] = []

    def feed(self, ids: np.ndarray) -> None:
        """The entries of a text."""
        n = len(self.m["bias"])
        self.rest.append(np.stack([np.append(n, ids[:-1]), np.append([n, n], ids[:-2])[: len(ids)], ids]))
        if sum(x.shape[1] for x in self.rest) >= 16 * BATCH:
            self.step()

    def step(self) -> None:
        """Moves over all tokens that wait, in a drawn order."""
        if not self.rest:
            return
        rows = np.concatenate(self.rest, axis=1)
        rows, self.rest = rows[:, self.rng.permutation(rows.shape[1])], []
        for at in range(0, rows.shape[1], BATCH):
            c1, c2, t = rows[:, at : at + BATCH]
            z = np.minimum(np.searchsorted(self.ends, self.rng.random(NOISE)), len(self.ends) - 1)
            for k, slope in contrast(self.m, c1, c2, t, z, self.log_q)[2].items():
                slope = slope.astype(np.float32, copy=False)
                self.sums[k] += slope * slope
                self.m[k] += self.rate * slope / np.sqrt(self.sums[k])
        self.tokens += rows.shape[1]


def trained(docs: DataFrame, classes: Classes, m: Parameters, rounds: int = ROUNDS, each: int = EACH, rate: float = RATE, seed: int = 8) -> Parameters:
    """The parameters after rounds of training on docs (text), one part of `each` a round, to which a hash deals the texts: as
    many rounds as parts, or more, train on all texts.
    """
    spark, own_classes = docs.sparkSession, docs.sparkSession.sparkContext.broadcast(classes)
    for round_ in range(rounds):
        shared, step = spark.sparkContext.broadcast(m), rate / (1 + round_)

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get()
            own = Trainer(shared.value, step, seed + (task.partitionId() if task else 0))
            cache = dict(own_classes.value.words)
            for batch in batches:
                for text in batch.column(0):
                    own.feed(class_ids(tokens(text.as_py()), own_classes.value, cache))
            own.step()
            if own.tokens:
                for name, value in own.m.items():
                    rows = value.reshape(len(value), -1).astype(np.float64) * own.tokens
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), own.tokens)), flat], ["name", "row", "tokens", "sums"])

        def average(table: pa.Table) -> pa.Table:
            sums = table["sums"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0) / table["tokens"].to_numpy().sum()
            return pa.table({"name": table["name"][:1], "row": table["row"][:1], "value": pa.array([sums.tolist()], pa.list_(pa.float64()))})

        drawn = docs.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(each)) == round_ % each)).select("text")
        moved = drawn.mapInArrow(train, "name string, row long, tokens long, sums array<double>").groupBy("name", "row").applyInArrow(average, "name string, row long, value array<double>").toArrow()
        m = {k: v.copy() for k, v in m.items()}  # as many rows as parameters have
        for name, row, value in zip(*(moved[k].to_pylist() for k in ("name", "row", "value"))):
            m[name][row] = value if m[name].ndim > 1 else value[0]
    return m


def normalised(m: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables near, far and total: the natural log probability of t after c1 and c2 is near[c1, t] + far[c2, t] - total[c1, c2]."""
    near, far = m["inputs"] @ m["near"] @ m["outputs"].T + m["bias"], m["inputs"] @ m["far"] @ m["outputs"].T
    near -= near.max(axis=1, keepdims=True)
    far -= far.max(axis=1, keepdims=True)
    total = np.exp(near) @ np.exp(far).T
    return near, far, np.log(total, out=total)


@dataclass
class Model:
    """The vocabulary, the tables of normalised() in log10, and by entry the log10 of what a count plus one is a share of.

    counts are those of the vocabulary's words; tokens is the number of training tokens, types of distinct ones.
    """

    classes: Classes
    near: np.ndarray
    far: np.ndarray
    total: np.ndarray
    shares: np.ndarray
    counts: dict[bytes, int]
    tokens: int
    types: int

    def log10(self, ids: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
        """The log10 probabilities of the entries of texts that begin at `starts`, each after the two before it in its text."""
        n, starts = self.classes.n, np.zeros(1, np.int64) if starts is None else starts
        c1, c2 = np.append(n, ids[:-1]), np.append([n, n], ids[:-2])[: len(ids)]
        c1[starts] = n
        c2[starts] = n
        c2[np.minimum(starts + 1, len(ids) - 1)] = n
        return self.near[c1, ids].astype(np.float64) + self.far[c2, ids] - self.total[c1, c2]


def fit(docs: DataFrame, top: int = TOP, tails: int = TAILS, **parameters) -> tuple[Model, DataFrame]:
    """A Model and the word counts (word, c; a staged table) of training documents (text)."""
    counts = stage(word_counts(docs), "words")
    n_tokens, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    classes = choose_classes(counts, top, tails)
    pairs = pair_counts(docs, classes).toArrow()  # at most entries squared, 16 bytes each; rows of Python's would be 500
    begun = start(pairs["pair"].to_numpy(), pairs["n"].to_numpy(), classes.n)
    del pairs
    m = trained(docs, classes, begun, **parameters)
    near, far, total = ((x / np.log(10)).astype(np.float32) for x in normalised(m))
    size = F.length("word")
    own = F.substring("word", F.greatest(size - 1, F.lit(1)), F.lit(2)).alias("tail")
    mass, kinds = np.zeros(classes.n), np.zeros(classes.n)
    known = counts.filter(F.col("word").isin(list(classes.words))).collect() if classes.words else []  # `top` rows
    others = counts.filter(~F.col("word").isin(list(classes.words))) if classes.words else counts
    tail = F.when(own.isin(list(classes.tails)), own).alias("tail") if classes.tails else F.lit(None).cast("binary").alias("tail")
    for r in others.groupBy(tail).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # tails + 1 rows at most
        at = classes.tails[bytes(r["tail"])] if r["tail"] is not None else classes.n - 1
        mass[at], kinds[at] = r["c"], r["v"]
    shares = np.log10(mass + kinds + 1)
    return Model(classes, near, far, total, shares, {bytes(r["word"]): r["c"] for r in known}, n_tokens, n_types), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, carried: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """carried columns, n_tokens, n_known, train_tokens, base_score, score of each row's whole text.

    base_score: the sum of log10((c + 1) / (N + V + 1)) of its tokens; score: its log10 probability under the model. A null
    text is an empty one: only its end. Rows that lie together are a block: their tokens as numbers, compressed, and apart
    from them the words outside the vocabulary in their order; the words meet their counts, and the counts meet the block.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = schema_with(docs, carried, "n_tokens long, n_known long, train_tokens long, base_score double, score double")
    rows = docs.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(carried)], F.col("text").alias("_text"))
    names = [f"_{k}" for k in range(len(carried))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get(), 0, [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = [tokens(t.as_py()) for t in table["_text"]]
            own = sorted(set().union(*lists) - known.keys())
            at = known | {w: len(known) + k for k, w in enumerate(own)}
            ids = np.fromiter((at[w] for x in lists for w in x), np.int32)
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            table = table.drop_columns("_text").append_column("_ids", pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
            kinds = np.fromiter(map(classes.of, own), np.int16, len(own))
            blobs = [packed(table), packed(pa.table({"kind": kinds})), packed(pa.table({"word": pa.array(own, pa.binary())}))]
            number = ((task.partitionId() if task else 0) << 32) + made
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in blobs)], ["block", "rows", "kinds", "words"])

        classes = shared.value.classes
        known = {w: k for k, w in enumerate(classes.words)}
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                held.append(batch)
                size += pc.sum(pc.binary_length(batch.column(len(names)))).as_py() or 0
                if size >= block_bytes:
                    yield block()
                    made, held, size = made + 1, [], 0
        if held:
            yield block()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                asked = 0
                for part in unpacked(blob.as_py()).combine_chunks().to_batches(max_chunksize=50_000):
                    at = np.arange(len(part), dtype=np.int32) + asked
                    asked += len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(at), part.column(0)], ["block", "at", "word"])

    blocks = stage(rows.mapInArrow(pack, "block long, rows binary, kinds binary, words binary"), "blocks")
    answered = blocks.select("block", "words").mapInArrow(ask, "block long, at int, word binary").join(counts, "word").select("block", "at", "c")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        m, out = shared.value, []
        for blob, kinds in zip(left["rows"], left["kinds"]):
            table = unpacked(blob.as_py()).combine_chunks()
            kinds = unpacked(kinds.as_py())["kind"].to_numpy()
            top = len(m.classes.words)
            c = np.zeros(top + len(kinds), np.int64)
            c[:top] = [m.counts.get(w, 0) for w in m.classes.words]
            c[top + right["at"].to_numpy()] = right["c"].to_numpy()
            classes = np.append(np.arange(top), kinds).astype(np.int64)
            base = np.log10((c + 1) / (m.tokens + m.types + 1))
            inner = np.where(classes < top, 0.0, np.log10(c + 1) - m.shares[classes])
            lists = table["_ids"].combine_chunks() if isinstance(table["_ids"], pa.ChunkedArray) else table["_ids"]
            n = lists.value_lengths().to_numpy().astype(np.int64)
            ids, starts = lists.flatten().to_numpy(), np.cumsum(n) - n
            model = inner[ids] + m.log10(classes[ids], starts)
            sums = [n, np.add.reduceat((c > 0)[ids].astype(np.int64), starts), np.full(len(n), m.tokens), np.add.reduceat(base[ids], starts), np.add.reduceat(model, starts)]
            out.append(pa.table([*(table[k] for k in names), *map(pa.array, sums)], [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    plain = schema_with(rows, names, "n_tokens long, n_known long, train_tokens long, base_score double, score double")
    found = blocks.select("block", "rows", "kinds").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(judge, plain)
    return found.select(*[F.col(x).alias(f.name) for x, f in zip(found.columns, schema.fields)])
