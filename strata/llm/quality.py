"""Quality filter: the perplexity of a text under an interpolated modified Kneser-Ney model of trusted text.

The model predicts the bytes of a word from the bytes before them, ORDER - 1 at most; a word that repeats the word before
it is one symbol, SAME, and one that goes on repeating it another, STILL, which trusted text hardly ever has. So a document's perplexity depends on its words and counts
alone: each task scores a distinct word once. A model for each language is trained on one half of all trusted (labelled good)
documents, whose n-grams are counted in shards and joined to their contexts and lower orders. The model alone is broadcast: the
different n-grams within words, which grow far slower than the text. A language's threshold is an exact quantile of the
surprises of the other half, all of it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import schema_with, stage, unit_hash, word_count, words_of

ORDER = 5
#: Documents of a language below which the pooled model and threshold serve it.
LEAST_DOCS = 20
#: Where a caller bounds the labelled documents: good, or bad, ones of a language that are used before its share limits them.
LANGUAGE_DOCS = 8 * LEAST_DOCS
QUANTILE = 0.998
#: Byte values that no word holds.
BEGIN, END, SAME, STILL = b" ", b"\n", b"\t", b"\v"
#: Bytes of average surprise that are added to each document, so that a few words alone say little.
PRIOR_BYTES = 30
#: Stands for a language where there is none; no label has it.
POOLED = "\0"
SYMBOLS = 256
#: Words scored together, and documents whose words are held at a time.
CACHE, DOCS = 400_000, 128
#: Bits, as a power of two, of the filter that keeps most unlabelled texts from travelling.
FILTER_BITS = 26
#: Values that quantiles() sees in one place, and the bins by which it narrows down more of them.
SEEN, BINS = 200_000, 4096


def symbols(text: str | None) -> list[bytes]:
    """The words of a text; one equal to the word before it, in any case of A to Z, is SAME; the next such one STILL."""
    words = words_of(text)
    folded = [b"", b"", *(w.lower() for w in words)]
    return [w if c != b else STILL if b == a else SAME for w, a, b, c in zip(words, folded, folded[1:], folded[2:])]


def grams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram of `order` bytes that ends at each byte of the words and at their ends, and the word it is of."""
    pad = BEGIN * (order - 1)
    raw = np.frombuffer(b"".join([pad + w + END for w in words]), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + order
    codes = np.zeros(len(raw), np.int64)
    for k in range(order):
        codes[order - 1 :] = codes[order - 1 :] << 8 | raw[k : len(raw) - order + 1 + k]
    word = np.repeat(np.arange(len(words)), lengths)
    inside = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= order - 1
    return codes[inside], word[inside]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n): counts of packed n-grams of ORDER bytes in docs (lang, text), summed in each task, then in shards."""

    def counted(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in words.items():
            if own:
                codes, word = grams(list(own))
                found, at = np.unique(codes, return_inverse=True)
                n = np.bincount(at, np.fromiter(own.values(), np.float64)[word]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                for lang, text in zip(batch.column(0)[at : at + DOCS].to_pylist(), batch.column(1)[at : at + DOCS]):
                    words[lang].update(symbols(text.as_py()))
                if sum(map(len, words.values())) > CACHE:
                    yield from counted(words)
                    words.clear()
        yield from counted(words)

    return docs.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, size, code, log_p, log_back) from gram_counts: the interpolated probability of each n-gram's last symbol
    after the ones before it, and the weight that these, its context, leave to the next lower order.

    Orders below the highest count the different symbols before an n-gram, unless it starts at the beginning of a word.
    The discounts for counts of one, two and more come from each language's and order's counts of counts. Each order's
    counts are joined to their contexts and to the order below in shards, and written before the next one reads them.
    """
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        longer = levels[n + 1].withColumn("_short", F.col("code").bitwiseAND(F.lit((1 << 8 * n) - 1)))
        at_start = F.shiftright("_short", 8 * (n - 1)) == BEGIN[0]
        level = longer.groupBy("lang", F.col("_short").alias("code")).agg(F.sum("n").alias("_raw"), F.count(F.lit(1)).alias("_kinds"), F.max(at_start).alias("_start"))
        levels[n] = stage(level.select("lang", "code", F.when(F.col("_start"), F.col("_raw")).otherwise(F.col("_kinds")).alias("n")), f"counts{n}")
    whole = None
    for n in range(1, order + 1):
        level = levels[n]
        ones, twos, threes, fours = (F.greatest(F.count_if(F.col("n") == k), F.lit(1)).cast("double") for k in (1, 2, 3, 4))
        y = ones / (ones + 2 * twos)
        held = [F.greatest(F.lit(0.1), F.least(F.lit(k - 0.05), k - (k + 1) * y * more / less)) for k, less, more in ((1, ones, twos), (2, twos, threes), (3, threes, fours))]
        discounts = level.groupBy("lang").agg(*[h.alias(f"_d{k}") for k, h in enumerate(held, 1)])
        own = F.when(F.col("n") == 1, F.col("_d1")).when(F.col("n") == 2, F.col("_d2")).otherwise(F.col("_d3"))
        level = level.join(F.broadcast(discounts), "lang").select("lang", "code", "n", own.alias("_held"), F.shiftright("code", 8).alias("_context"))
        context = level.groupBy("lang", "_context").agg(F.sum("n").alias("_total"), F.sum("_held").alias("_left"))
        level = level.join(context, ["lang", "_context"])
        below = F.lit(1 / SYMBOLS)
        if n > 1:
            level = level.withColumn("_short", F.col("code").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
            level = level.join(lower.select("lang", F.col("code").alias("_short"), F.exp("log_p").alias("_lower")), ["lang", "_short"])
            below = F.col("_lower")
        back = F.col("_left") / F.col("_total")
        p = (F.col("n") - F.col("_held")) / F.col("_total") + back * below
        lower = stage(level.select("lang", F.lit(n).alias("size"), "code", F.log(p).alias("log_p"), F.log(back).alias("log_back")), f"order{n}")
        whole = lower if whole is None else whole.unionByName(lower)
    return whole


class Model:
    """Sorted tables of one language: log probabilities by n-gram and back-off weights by context, for each size."""

    def __init__(self, size: np.ndarray, code: np.ndarray, log_p: np.ndarray, log_back: np.ndarray, order: int = ORDER) -> None:
        self.order = order
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.backs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, order + 1):
            rows = np.flatnonzero(size == n)
            rows = rows[np.argsort(code[rows])]
            context, first = np.unique(code[rows] >> 8, return_index=True)
            # A last entry that no code equals takes the searches that run past the end.
            self.grams[n] = np.append(code[rows], -1), np.append(log_p[rows], np.nan)
            self.backs[n - 1] = np.append(context, -1), np.append(log_back[rows][first], np.nan)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
        """The values of codes; NaN where there is none."""
        known, values = table
        at = np.searchsorted(known[:-1], codes)
        return np.where(known[at] == codes, values[at], np.nan)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """The natural logarithm of each word's probability, its end included."""
        codes, word = grams(words, self.order)
        total, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for n in range(self.order, 0, -1):
            short = codes[open_] & ((1 << 8 * n) - 1)
            found = self._find(self.grams[n], short)
            known = ~np.isnan(found)
            total[open_[known]] += found[known]
            open_ = open_[~known]
            total[open_] += np.nan_to_num(self._find(self.backs[n - 1], short[~known] >> 8))
        total[open_] -= np.log(SYMBOLS)
        return np.bincount(word, total, len(words))


@dataclass
class Filter:
    """By language: the models, the thresholds of the surprise in nats per byte, and its median over trusted text."""

    models: dict[str, Model]
    thresholds: dict[str, float]
    centers: dict[str, float]


def surprises(docs: DataFrame, models, carried: list[str]) -> DataFrame:
    """docs (carried columns, lang, text) -> carried, lang, n_words, n_bytes, nats (null without words).

    models is a broadcast of Model by language. Each task keeps the values of up to CACHE distinct words.
    """
    schema = schema_with(docs, carried, "lang string, n_words long, n_bytes long, nats double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches: dict[str, dict[bytes, float]] = {k: {} for k in models.value}
        for batch in batches:
            langs, texts = batch.column(len(carried)).to_pylist(), batch.column(len(carried) + 1)
            n_words, n_bytes, nats = [], [], []
            for at in range(0, len(langs), DOCS):
                keys = [k if k in caches else POOLED for k in langs[at : at + DOCS]]
                lists = [symbols(t.as_py()) for t in texts[at : at + DOCS]]
                new = defaultdict(set)
                for key, words in zip(keys, lists):
                    new[key].update(words)
                for key, words in new.items():
                    cache = caches[key]
                    if len(cache) > CACHE:
                        cache.clear()
                    if words := [w for w in words if w not in cache]:
                        cache.update(zip(words, models.value[key].log_probabilities(words).tolist()))
                for key, words in zip(keys, lists):
                    n_words.append(len(words))
                    n_bytes.append(sum(map(len, words)) + len(words))
                    nats.append(-sum(map(caches[key].__getitem__, words)) if words else None)
            columns = [*batch.columns[: len(carried) + 1], pa.array(n_words, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(nats, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "lang", "n_words", "n_bytes", "nats"])

    return docs.select(*carried, F.col("lang").cast("string").alias("lang"), F.col("text")).mapInArrow(score, schema)


def joined_by_id(text: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of text (doc_id ...) whose doc_id is one of ids (doc_id, each once), joined by shuffling both.

    Before, a filter of FILTER_BITS bits, all that is broadcast, takes rows away that no id's bit names; the join is exact. It is
    an inner one: Spark moves a semi join below the filter, so that all texts travel.
    """
    if text.schema["doc_id"].dataType != ids.schema["doc_id"].dataType:  # no filter, and different ids may be equal to one
        return text.join(ids.hint("merge"), "doc_id", "left_semi")
    bits = F.xxhash64(F.lit(5), "doc_id")
    word, bit = F.shiftrightunsigned(bits, 64 - FILTER_BITS + 6), F.expr("shiftleft(1L, int(_bits & 63))")
    words = ids.filter("doc_id is not null").withColumn("_bits", bits).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_set"))
    near = text.withColumn("_bits", bits).withColumn("_word", word).join(F.broadcast(words), "_word")
    near = near.filter(F.col("_set").bitwiseAND(bit) != 0).select(text.columns)
    return near.join(ids.hint("merge"), "doc_id").select(text.columns)


def quantiles(rows: DataFrame, share: float) -> dict[str, float]:
    """By key the exact quantile, linear between two values, of rows (key, value): as numpy's of all values of a key.

    While a key has more than SEEN values, they are counted in BINS, and what lies between the bins of the two values asked for is
    counted again, so that few are ever in one place.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    # By key: the range that holds both values, how many are in it, and the places of both in it.
    open_ = {r["key"]: (r["low"], r["high"], r["n"], int((r["n"] - 1) * share), min(int((r["n"] - 1) * share) + 1, r["n"] - 1)) for r in sizes}
    parts = {r["key"]: (r["n"] - 1) * share % 1 for r in sizes}
    found: dict[str, float] = {}

    def within(ranges: dict) -> DataFrame:
        frame = rows.sparkSession.createDataFrame([(k, float(x[0]), float(x[1])) for k, x in ranges.items()], "key string, low double, high double")
        return rows.join(F.broadcast(frame), "key").filter((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))

    while wide := {k: x for k, x in open_.items() if x[2] > SEEN and x[0] < x[1]}:
        at = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        bins = within(wide).groupBy("key", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        for key, own in bins.orderBy("key", "bin").toPandas().groupby("key"):
            ends = own.n.cumsum().to_numpy()
            first, last = (int(np.searchsorted(ends, k, side="right")) for k in wide[key][3:])
            if first != last:  # neighbours in order: the last of a bin, the first of the next one
                least, most = own.high.iloc[first], own.low.iloc[last]
                found[key] = float(least + (most - least) * parts[key])
                del open_[key]
                continue
            before = int(ends[first] - own.n.iloc[first])
            open_[key] = (own.low.iloc[first], own.high.iloc[last], int(ends[last]) - before, wide[key][3] - before, wide[key][4] - before)
    for key, (least, most, _, first, last) in open_.items():
        if least < most:
            values = np.sort(within({key: open_[key]}).select("value").toArrow()["value"].to_numpy())
            least, most = values[first], values[last]
        found[key] = float(least + (most - least) * parts[key])
    return found


def fit(docs: DataFrame, labels: DataFrame, train_docs: int | None = None, quantile: float = QUANTILE, seed: int = 3) -> Filter:
    """A Filter from docs (doc_id, lang, text) and labels (doc_id, quality 1 or 0).

    Of all trusted documents, those of quality 1, one half by a seeded hash trains and the other gives the thresholds. Only where a
    caller asks for train_docs are labelled ids drawn, at a rate of each language's good and bad ones, train_docs of them in
    expectation (more only if LANGUAGE_DOCS for each take more). Without any trusted document nothing can be judged: no models.
    """
    spark = docs.sparkSession
    known = labels.filter("quality is not null").select("doc_id", (F.col("quality") > 0).alias("good")).groupBy("doc_id").agg(F.min("good").alias("good"))
    text = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit(POOLED)).alias("lang"), "text").filter("text is not null")
    if train_docs is not None and known.count() > train_docs:
        ids = stage(text.select("doc_id", "lang").distinct().join(known, "doc_id"), "ids")
        sizes = {(r["lang"], r["good"]): r["count"] for r in ids.groupBy("lang", "good").count().collect()}
        level = max(LANGUAGE_DOCS, even_share(list(sizes.values()), train_docs))
        rates = spark.createDataFrame([(*k, min(1.0, level / n)) for k, n in sizes.items()], "lang string, good boolean, _rate double")
        drawn = ids.join(F.broadcast(rates), ["lang", "good"]).filter(unit_hash(seed, F.col("doc_id")) < F.col("_rate")).select("doc_id", "lang", "good")
        trusted = text.join(drawn.filter("good"), ["doc_id", "lang"])
    else:
        trusted = joined_by_id(text, known.filter("good").select("doc_id"))
    trusted = stage(trusted.select("lang", "text", (unit_hash(seed + 1, F.col("doc_id")) < 0.5).alias("trains")), "trusted")
    train = trusted.filter("trains")
    enough = {r["lang"] for r in train.groupBy("lang").count().filter(F.col("count") >= LEAST_DOCS).collect()} - {POOLED}
    counts = stage(gram_counts(train), "grams")
    pooled = counts.groupBy(F.lit(POOLED).alias("lang"), "code").agg(F.sum("n").alias("n"))
    rows = kneser_ney(stage(counts.filter(F.col("lang").isin(list(enough))).union(pooled), "counts"))
    models = {}
    for k in sorted(enough | {POOLED}):
        own = rows.filter(F.col("lang") == k).select("size", "code", "log_p", "log_back").toArrow()  # different n-grams within words
        if own.num_rows:
            models[k] = Model(*(c.to_numpy() for c in own.columns))
    if not models:
        return Filter({}, {}, {})
    judged = surprises(trusted.filter("not trains"), spark.sparkContext.broadcast(models), []).filter("nats is not null")
    judged = stage(judged.select("lang", "nats", "n_bytes"), "judged")
    sizes = {r["lang"]: r["count"] for r in judged.groupBy("lang").count().collect()}
    # A language with few documents to judge has the pooled threshold.
    own = [k for k in models if k != POOLED and sizes.get(k, 0) >= LEAST_DOCS]
    keyed = judged.withColumn("key", F.lit(POOLED)).union(judged.filter(F.col("lang").isin(own)).withColumn("key", F.col("lang")))
    middle = quantiles(keyed.select("key", (F.col("nats") / F.col("n_bytes")).alias("value")), 0.5)
    centers = {k: middle.get(k, middle.get(POOLED, 0.0)) for k in models}
    center = F.element_at(F.create_map(*[F.lit(x) for kv in centers.items() for x in kv]), F.col("key"))
    upper = quantiles(keyed.select("key", ((F.col("nats") + PRIOR_BYTES * center) / (F.col("n_bytes") + PRIOR_BYTES)).alias("value")), quantile)
    return Filter(models, {k: upper.get(k, upper.get(POOLED, float("inf"))) for k in models}, centers)


def even_share(sizes: list[int], total: float) -> float:
    """The most that each may take so that all together take `total` (or all there is)."""
    sizes = sorted(sizes)
    for k, n in enumerate(sizes):
        if n * (len(sizes) - k) >= total:
            return total / (len(sizes) - k)
        total -= n
    return float(sizes[-1]) if sizes else 0.0


def judge(docs: DataFrame, filter_: Filter, carried: list[str] | None = None) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, surprise, threshold, kept) of each row.

    perplexity: of the text's bytes, ends of words included; surprise: its logarithm, drawn to the language's median as by
    PRIOR_BYTES more bytes; kept: whether the surprise is the language's threshold at most. A text without words (null or
    empty) has neither and isn't kept; without any model all others are. Null and rare languages are judged by the pooled
    model. Rows that repeat are judged alike.
    """
    spark, carried = docs.sparkSession, carried or ["doc_id"]
    limits = filter_.thresholds
    if not filter_.models:
        n = word_count(F.col("text"))
        blanks = [F.lit(None).cast("double").alias(c) for c in ("perplexity", "surprise", "threshold")]
        return docs.select(*carried, F.col("lang").cast("string").alias("lang"), n.alias("n_words"), *blanks, (n > 0).alias("kept"))
    rows = surprises(docs, spark.sparkContext.broadcast(filter_.models), carried)

    def by_language(values: dict[str, float]):
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("lang")), F.lit(values[POOLED]))

    limit = by_language(limits)
    rows = rows.withColumn("surprise", (F.col("nats") + PRIOR_BYTES * by_language(filter_.centers)) / (F.col("n_bytes") + PRIOR_BYTES))
    kept = F.coalesce(F.col("surprise") <= limit, F.lit(False))
    return rows.select(*carried, "lang", "n_words", F.exp(F.col("nats") / F.col("n_bytes")).alias("perplexity"), "surprise", limit.alias("threshold"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """docs without those whose perplexity is above their language's threshold; the columns stay.

    Judged and kept in one pass over the rows: every column of docs rides along.
    """
    found = fit(docs, labels, **parameters)
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)], "lang", "text")
    kept = judge(renamed, found, [f"_{k}" for k in range(len(docs.columns))]).filter("kept")
    return kept.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])
