"""Language identification by word-first backoff.

A known word adds its log frequency in each language; an unseen one adds the mean log frequencies of its longest known
character n-grams, of ever shorter ones until some are known. The tables come from a bounded sample of the labelled
documents of each language, DOCS_A_LANGUAGE in expectation and WORDS and GRAMS entries at most, so they can be broadcast.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import schema_with, unit_hash

DOCS_A_LANGUAGE = 1500
#: Languages that can be told apart at most; a corpus with more label values is refused, not cut.
LANGUAGES = 1000
#: Words, and n-grams of each length, of each language by frequency, kept at most; how often a word of the sample must occur to
#: teach. Other words are scored by their n-grams, others of these by shorter ones, so nothing goes unscored.
WORDS, GRAMS, LEAST = 60_000, 30_000, 2
LONGEST = 5
#: What is added to each count, and tokens whose values a task keeps.
ADDED, CACHE = 0.5, 300_000
UNKNOWN = "und"


def runs(token: str) -> list[str]:
    """The runs of letters in a token, in lower case."""
    token = token.lower()
    if token.isalpha():
        return [token]
    return "".join(c if c.isalpha() else " " for c in token).split()


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between its marks ^ and $."""
    padded = f"^{word}$"
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


@dataclass
class Tables:
    """Rows of log frequencies (a column for each language) by word and, for each length, by n-gram."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    rows: np.ndarray
    prior: np.ndarray


class Scorer:
    """Scores texts with Tables; remembers the row of each token it has met, CACHE of them at most."""

    def __init__(self, tables: Tables) -> None:
        self.tables, self.width = tables, len(tables.languages)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((4096, self.width))
        self.letters = np.zeros(4096, bool)
        self.n = 0

    def evidence(self, word: str) -> np.ndarray:
        t = self.tables
        if (at := t.words.get(word)) is not None:
            return t.rows[at]
        for n in range(LONGEST, 0, -1):
            known = t.grams[n]
            if found := [known[g] for g in grams(word, n) if g in known]:
                return t.rows[found].mean(axis=0)
        return np.zeros(self.width)

    def learn(self, token: str) -> int:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        words = runs(token)
        if words:
            self.rows[self.n] = sum(map(self.evidence, words))
            self.letters[self.n] = True
        self.at[token] = self.n
        self.n += 1
        return self.n - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and its share of the posterior; `und` and 0 for a text that is null or has no letter."""
        if not text or not self.width:
            return UNKNOWN, 0.0
        if self.n > CACHE:
            self.clear()
        tokens = text.split()
        at = np.fromiter(map(self.at.get, tokens, [-1] * len(tokens)), np.int64, len(tokens))
        for k in np.flatnonzero(at < 0).tolist():
            token = tokens[k]
            at[k] = self.at[token] if token in self.at else self.learn(token)
        if not self.letters[at].any():
            return UNKNOWN, 0.0
        total = self.rows[at].sum(axis=0) + self.tables.prior
        best = int(total.argmax())
        return self.tables.languages[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE, seed: int = 4) -> Tables:
    """Tables from docs (doc_id, lang, text), of which those with a language and a text teach.

    Documents are drawn by a seeded hash, at a rate of each language of its own, so rare languages are heard in full. Words
    are counted in each task, then by language. Without any document there is no language.
    """
    docs = docs.filter("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} language labels")
    languages = sorted(sizes)
    if not languages:
        return Tables([], {}, {n: {} for n in range(1, LONGEST + 1)}, np.zeros((0, 0)), np.zeros(0))
    rates = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_a_language / n))])
    drawn = docs.filter(unit_hash(seed, F.col("doc_id")) < F.element_at(rates, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[lang].update(text.as_py().split())
        for lang, tokens in found.items():
            words: Counter = Counter()
            for token, n in tokens.items():
                for word in runs(token):
                    words[word] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    counts = drawn.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return tables(languages, counts.filter(F.col("n") >= LEAST).toPandas().itertuples(index=False), sizes)


def tables(languages: list[str], counted, sizes: dict[str, int]) -> Tables:
    """Tables from (lang, word, n) rows: each language's WORDS most frequent words and, of each length, GRAMS n-grams."""
    column = {k: i for i, k in enumerate(languages)}
    by_word: dict[str, np.ndarray] = {}
    for lang, word, n in counted:
        by_word.setdefault(word, np.zeros(len(languages)))[column[lang]] += n
    units: list[tuple[int, dict[str, np.ndarray]]] = [(0, by_word)]
    for size in range(1, LONGEST + 1):
        found: dict[str, np.ndarray] = {}
        for word, n in by_word.items():
            for g in grams(word, size):
                if g in found:
                    found[g] += n
                else:
                    found[g] = n.copy()
        units.append((size, found))
    index: dict[int, dict[str, int]] = {}
    parts, start = [], 0
    for size, found in units:
        names = sorted(found)
        values = np.array([found[x] for x in names]).reshape(-1, len(languages))
        ranks = np.argsort(np.argsort(-values, axis=0, kind="stable"), axis=0)
        kept = ((ranks < (GRAMS if size else WORDS)) & (values > 0)).any(axis=1)
        totals = values.sum(axis=0) + ADDED * max(1, len(names))
        parts.append(np.log((values[kept] + ADDED) / totals))
        index[size] = {x: start + k for k, x in enumerate(np.array(names, object)[kept].tolist())}
        start += int(kept.sum())
    prior = np.log(np.array([sizes[k] for k in languages], float))
    return Tables(languages, index.pop(0), index, np.concatenate(parts), prior)


def identify(docs: DataFrame, model: Tables, carried: list[str] | None = None) -> DataFrame:
    """(carried columns, lang_pred, score) of each row's whole text; nothing else of the row is looked at.

    lang_pred is one of the learned languages, or `und` where the text is null or has no letter; score is the share of
    the posterior, from 0 to 1. Rows that repeat are judged alike; an empty table gives no rows.
    """
    carried = carried or ["doc_id"]
    schema = schema_with(docs, carried, "lang_pred string, score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(len(carried))]
            columns = [*batch.columns[: len(carried)], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "lang_pred", "score"])

    return docs.select(*carried, F.col("text").alias("_text")).mapInArrow(predict, schema)
