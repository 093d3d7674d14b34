"""Each operator against a brute-force form, an exact round trip or held-out accuracy, and on awkward tables."""

import collections
import math
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strata.llm import langid, lm, media, mixing, packing, pii, quality, queries, sharding, simhash, vectors
from strata.llm.common import components, number_within, stage, unit_hash

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
EN = "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split()
#: Columns that clash with names the operators use themselves.
CLASH = {"size": "x", "piece": 1, "shard": 2, "fp": 3, "n": 4, "word": "w", "c": 5, "b": 6, "_text": "t", "_block": 7, "_1": 8, "entities": "e", "_repeats": 9, "score": 0.5}


def prose(words, n, rng):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Plain rows, and null, empty, blank, long, tied and repeated ones, null keys and clashing columns."""
    rng = random.Random(5)
    rows = []
    for k in range(120):
        lang = "de" if k % 3 == 0 else "en"
        rows.append((k, prose(DE if lang == "de" else EN, rng.randrange(5, 90), rng), lang, f"s{k % 4}"))
    long_ = prose(EN, 30_000, rng)
    rows += [(200, None, "en", "s0"), (201, "", "en", None), (202, " \n\t", None, "s1"), (203, long_, "en", "s1"), (204, rows[0][1], "de", "s2"), (205, rows[0][1], "de", "s2")]
    rows += [(206, "123 !!", "en", "s9"), (207, "<|endoftext|> a", "en", "s3"), (208, "é ж 中文 x", None, "é"), (208, "é ж 中文 x", None, "é"), (None, "no id here", None, None)]
    names = list(CLASH)
    data = [(*r, len(r[1] or ""), *CLASH.values()) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} {'string' if isinstance(CLASH[n], str) else 'double' if isinstance(CLASH[n], float) else 'long'}" for n in names)
    return stage(spark.createDataFrame(data, schema).repartition(3))


@pytest.fixture(scope="module")
def labels(spark, docs):
    ids = [r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None]
    return spark.createDataFrame([(i, None if i == 3 else int(i < 110 or i > 150), 0) for i in sorted(set(ids))], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def sf(spark, docs, labels, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{root}/documents.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    docs.limit(0).write.parquet(f"{root}/empty/documents.parquet")
    labels.limit(0).write.parquet(f"{root}/empty/labels.parquet")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    vec.write.parquet(f"{root}/embeddings.parquet")
    vec.limit(0).write.parquet(f"{root}/empty/embeddings.parquet")
    return str(root)


@pytest.mark.parametrize("name", [*queries.queries(), "pipeline"])
def test_awkward_tables_and_empty_ones(spark, sf, docs, name):
    run = corpus_pipeline.run if name == "pipeline" else queries.queries()[name]
    n = run(spark, sf).count()
    assert n > 0
    if name not in ("pipeline", "op2_pack_sequences", "op10_vector_duplicates"):
        assert n == docs.count()
    assert run(spark, f"{sf}/empty").count() == 0


def test_pipeline_columns(spark, sf):
    found = spark.read.parquet(f"{sf}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        found = stage(apply(spark, found, sf), name)
        assert found.columns == corpus_pipeline.COLUMNS


def test_numbering_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    rows = number_within(df, ["g"], ["id"], "k", 7).collect()
    for g in range(3):
        assert sorted(r.k for r in rows if r.g == g) == list(range(len([r for r in rows if r.g == g])))


def test_components_of_a_long_path_and_loose_ends(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (200, 200)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert all(found[k] == 0 for k in range(61)) and found[100] == found[101] == 100 and found[200] == 200


# 1 mixing


def filled(sizes, weights, budget):
    """Water-filling by clamping one source at a time."""
    total, open_, out = budget * sum(sizes.values()), set(sizes), {}
    while open_:
        share = (total - sum(out.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if share * weights[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: share * weights[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


def test_mixing_meets_its_targets(spark, docs):
    rows = mixing.mix_plan(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = filled(sizes, weights, 1.5)
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6) and 0 <= r.repeats <= 2
        taken[r.source] += r.size * r.repeats
    for s in sizes:
        left = [r.size for r in rows if r.source == s and r.repeats < 2 and r.size]
        assert want[s] - taken[s] < max([*left, 1]) and taken[s] <= want[s] + 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(docs.repartition(5)).collect()))


def test_mixed_rows_repeat(docs):
    plan = {r.doc_id: r.repeats for r in mixing.mix_plan(docs).collect()}
    n = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
    there = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert all(n[d] == plan[d] * k for d, k in there.items())


def test_an_id_under_two_sources_meets_both_targets(spark):
    rng = random.Random(8)
    rows = [(k % 60, " ".join("w" * rng.randrange(1, 9)), s) for s in ("a", "b", "c") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {(r.doc_id, r.source): r.repeats for r in mixing.mix_plan(docs).collect()}
    n = collections.Counter((r.doc_id, r.source) for r in mixing.mixed(docs).collect())
    assert all(n[k] == v for k, v in plan.items()) and set(n) <= set(plan)


# 2 packing


def best_fit(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [k for k, room in enumerate(bins) if room >= x]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=150, deadline=None)
def test_plan_is_best_fit_decreasing(lengths):
    plan = packing.best_fit_plan(collections.Counter(lengths), 40)
    used, places = collections.Counter(), collections.defaultdict(list)
    for p in plan:
        for rank in range(p.first_rank, p.end_rank):
            k, at = divmod(rank - p.first_rank, p.per_bin)
            used[p.first_bin + k] += p.length
            places[p.first_bin + k].append((p.offset + at * p.length, p.length))
    assert sorted(40 - x for x in used.values()) == best_fit(lengths, 40)
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
    assert sum(p.end_rank - p.first_rank for p in plan) == len(lengths)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizers(text):
    want = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids if text else []
    assert packing.token_ids(text, TOKENIZER).tolist() == [*want, 0]


def test_ids_are_the_tokenizers_over_whole_documents(spark):
    whole = Tokenizer.from_file(TOKENIZER)
    for r in queries.table(spark, "/root/testdata/sf0.01", "documents").select("text").collect():
        assert packing.token_ids(r.text, TOKENIZER).tolist() == [*(whole.encode(r.text, add_special_tokens=False).ids if r.text else []), 0]


def test_packed_rows(docs):
    rows = packing.pack(docs, TOKENIZER).collect()
    whole = Tokenizer.from_file(TOKENIZER)
    ids = {}
    for r in docs.collect():
        ids[r.doc_id] = np.array([*(whole.encode(r.text, add_special_tokens=False).ids if r.text else []), 0], "<u4")
    by_doc, by_sequence = collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by_doc[r.doc_id].add((r.piece, r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d, own in by_doc.items():
        own = sorted(own)
        assert [p for p, _, _ in own] == list(range(len(own))) and all(n == 2048 for _, _, n in own[1:]) and sum(n for _, _, n in own) == len(ids[d])
    for own in by_sequence.values():
        assert sum(n for _, n in own) <= 2048 and sorted(own)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:]))


# 3 quality


def test_probabilities_sum_to_one_and_junk_goes(spark):
    rng = random.Random(2)
    rows = [(k, prose(EN, rng.randrange(20, 80), rng), "en") for k in range(300)]
    rows += [(1000 + k, " ".join(w.upper() + "!!" if k % 2 else w + "***" for w in prose(EN, 40, rng).split()), "en") for k in range(60)]
    rows += [(2000 + k, f"{rng.choice(EN)} " * 40, "en") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < 1000)) for d, _, _ in rows if d % 2], "doc_id long, quality int")
    found = quality.fit(docs, labels)
    model = found.models["en"]
    for context in (b"", b"t", b"th", b"zzz"):
        total = 0.0
        for byte in range(256):
            # The last symbol's probability: a word less the same word without it.
            codes = 0
            for x in (b"    " + context)[-4:] + bytes([byte]):
                codes = codes << 8 | x
            total += math.exp(_one(model, codes))
        assert abs(total - 1) < 1e-6
    kept = {r.doc_id for r in quality.judge(docs, found).collect() if r.kept}
    assert sum(d < 1000 for d in kept) >= 295 and not any(d >= 1000 for d in kept)
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == kept


def by_recursion(words, order):
    """Interpolated modified Kneser-Ney over dictionaries: log_p(symbols) of the last one after those before it."""
    raw = collections.Counter()
    for w, n in words.items():
        padded = quality.BEGIN * (order - 1) + w + quality.END
        for k in range(len(padded) - order + 1):
            raw[padded[k : k + order]] += n
    levels = {order: raw}
    for n in range(order - 1, 0, -1):
        before = collections.defaultdict(set)
        total = collections.Counter()
        for g, c in levels[n + 1].items():
            before[g[1:]].add(g[:1])
            total[g[1:]] += c
        levels[n] = {g: total[g] if g[:1] == quality.BEGIN else len(before[g]) for g in before}
    discounts = {}
    for n, level in levels.items():
        k = [max(1, sum(c == x for c in level.values())) for x in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        discounts[n] = [max(0.1, min(x - 0.05, x - (x + 1) * y * k[x] / k[x - 1])) for x in (1, 2, 3)]

    def p(g):
        if not g:
            return 1 / 256
        level, d = levels[len(g)], discounts[len(g)]
        own = {x: c for x, c in level.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        left = sum(d[min(c, 3) - 1] for c in own.values())
        c = own.get(g, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total + left / total * p(g[1:])

    return p


def test_kneser_ney_by_recursion(spark):
    texts = ["the cat sat on the mat", "the dog ate a cat that sat", "hat hat hat mat", "é the é", ""]
    rows = quality.kneser_ney(stage(quality.gram_counts(spark.createDataFrame([("x", t) for t in texts], "lang string, text string")))).toPandas()
    model = quality.Model(*(rows[c].to_numpy() for c in ("size", "code", "log_p", "log_back")))
    p = by_recursion(collections.Counter(w for t in texts for w in quality.symbols(t)), quality.ORDER)
    asked = [b"the", b"cat", b"zebra", b"th", b"tat", quality.SAME, "éé".encode(), b"a"]
    for w, got in zip(asked, model.log_probabilities(asked)):
        padded = quality.BEGIN * (quality.ORDER - 1) + w + quality.END
        assert math.isclose(got, sum(math.log(p(padded[k : k + quality.ORDER])) for k in range(len(w) + 1)), rel_tol=1e-9)


def test_perplexity_and_plain_quantiles(spark):
    rng = random.Random(6)
    rows = [(k, prose(EN, 30, rng), "en") for k in range(400)] + [(900, None, "en"), (901, "", None), (902, "the of", None), (903, "the of", "*")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(400)], "doc_id long, quality int")
    found = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.judge(docs, found).collect()}
    words = quality.symbols(rows[0][1])
    nats = -sum(found.models["en"].log_probabilities(words))
    assert math.isclose(got[0].perplexity, math.exp(nats / sum(len(w) + 1 for w in words)), rel_tol=1e-9)
    assert (got[900].n_words, got[901].n_words, got[900].perplexity, got[900].kept) == (0, 0, None, False)
    assert got[902].lang is None and got[903].lang == "*" and got[902].perplexity == got[903].perplexity
    lost = sum(not got[k].kept for k in range(400))
    assert lost <= 0.02 * 400
    bare = {r.doc_id: r for r in quality.judge(docs, quality.fit(docs, labels.limit(0))).collect()}
    assert (bare[900].n_words, bare[901].n_words, bare[0].n_words, bare[0].kept, bare[901].kept) == (0, 0, 30, True, False)
    odd = docs.withColumnRenamed("lang", "lang").withColumn("a.b", F.lit(1))
    assert quality.keep_good(odd, labels).columns == odd.columns


def _one(model, code):
    """The log probability of a packed n-gram's last byte, by the recursion."""
    for n in range(model.order, 0, -1):
        p = model._find(model.grams[n], np.array([code & ((1 << 8 * n) - 1)]))[0]
        back = sum(np.nan_to_num(model._find(model.backs[m - 1], np.array([(code & ((1 << 8 * m) - 1)) >> 8]))[0]) for m in range(model.order, n, -1))
        if not np.isnan(p):
            return p + back
    return back + np.nan_to_num(model._find(model.backs[0], np.array([0]))[0]) - math.log(256)


def test_small_languages_keep_their_models(spark):
    """A language with 1 % of the labels is learned and calibrated by itself, however many others there are."""
    rng = random.Random(4)
    rows = [(k, prose(EN, 12, rng), "en") for k in range(9900)] + [(k, prose(DE, 12, rng), "de") for k in range(9900, 10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    found = quality.fit(docs, labels, train_docs=1000)
    assert set(found.models) == {"de", "en", quality.POOLED} and found.thresholds["de"] != found.thresholds[quality.POOLED]
    assert quality.even_share([5, 100, 1000], 405) == 300 and quality.even_share([5, 6], 100) == 6 and quality.even_share([], 5) == 0


def test_all_trusted_documents_train(spark):
    """10000 documents of a word of their own: the model has the words of one half, the other half is judged, none is left out."""
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.format_string("%04d", "id").alias("text"), F.lit("en").alias("lang"))
    found = quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    want = {r.text for r in docs.filter(unit_hash(4, F.col("doc_id")) < 0.5).collect()}
    for model in found.models.values():
        got = {int(c).to_bytes(5, "big") for c in model.grams[5][0] if c >= 0}
        assert {g[:4].decode() for g in got if g[4:] == quality.END and g[:4].isdigit()} == want
    surprise = np.array([r.surprise for r in quality.judge(docs.filter(unit_hash(4, F.col("doc_id")) >= 0.5), found).collect()])
    assert math.isclose(found.thresholds["en"], np.quantile(surprise, quality.QUANTILE), rel_tol=1e-12)


def test_ids_find_all_their_rows_and_no_others(spark, monkeypatch):
    monkeypatch.setattr(quality, "FILTER_BITS", 9)
    rows = spark.range(600).selectExpr("id % 300 - 20 AS doc_id", "string(id) AS text").union(spark.sql("SELECT CAST(NULL AS BIGINT), 'x'"))
    for ids in (spark.range(0, 400, 3).selectExpr("id AS doc_id"), spark.range(0, 90, 7).selectExpr("int(id) AS doc_id"), spark.range(0).selectExpr("id AS doc_id")):
        own = {r.doc_id for r in ids.collect()}
        assert sorted(r.text for r in quality.joined_by_id(rows, ids).collect()) == sorted(r.text for r in rows.collect() if r.doc_id in own)


def test_unlabelled_texts_are_filtered_before_they_travel(spark):
    text = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    ids = spark.range(0, 3000, 30).select(F.col("id").alias("doc_id"))
    found = quality.joined_by_id(text, ids)
    assert sorted(r.doc_id for r in found.collect()) == list(range(0, 1000, 30))
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert "doc_id" in joins[0] and "_word" in joins[1]  # from the last join to the first one
    words = ids.select(F.col("doc_id").cast("string").alias("doc_id"))
    again = words.union(words.select(F.concat(F.lit("0"), "doc_id")))
    assert sorted(r.doc_id for r in quality.joined_by_id(text, again).collect()) == list(range(0, 1000, 30))


def test_quantiles_are_those_of_all_values(spark, monkeypatch):
    monkeypatch.setattr(quality, "SEEN", 10)
    monkeypatch.setattr(quality, "BINS", 8)
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(size=1000), "b": np.repeat([0.0, 1.0], 50), "c": np.full(80, 2.5), "d": np.exp(rng.normal(size=333) * 9), "e": np.array([7.0]), "f": rng.integers(0, 5, 200) * 1.0}
    frame = spark.createDataFrame([(k, float(x)) for k, own in values.items() for x in own], "key string, value double")
    for share in (0.0, 0.5, 0.77, 0.998, 1.0):
        got = quality.quantiles(frame, share)
        assert got.keys() == values.keys() and all(math.isclose(got[k], np.quantile(own, share), rel_tol=1e-12, abs_tol=1e-12) for k, own in values.items())


def test_repeats_are_symbols():
    assert quality.symbols("a A a b b c") == [b"a", quality.SAME, quality.STILL, b"b", quality.SAME, b"c"]
    assert quality.symbols(None) == []


# 4 language


def test_languages_are_told_apart(docs):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    table = docs.withColumn("held", held)
    model = langid.fit(table.filter("not held"))
    rows = langid.identify(table, model, ["doc_id", "held", "lang", "text"]).collect()
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred == "und"
        else:
            assert r.lang_pred in ("en", "de") and 0 <= r.score <= 1
    told = [r.lang == r.lang_pred for r in rows if r.held and r.doc_id is not None and r.doc_id < 120]
    assert sum(told) >= 0.97 * len(told)


def test_unseen_words_back_off():
    t = langid.tables(["x", "y"], [("x", "schiff", 5), ("x", "schule", 5), ("y", "houses", 5), ("y", "mouse", 5)], {"x": 1, "y": 1})
    s = langid.Scorer(t)
    assert s.predict("schal")[0] == "x" and s.predict("ouse")[0] == "y" and s.predict("  12 ")[0] == "und"


def test_scores_by_brute_force():
    """Words by their frequencies, others by the mean of their longest known n-grams, over plain dictionaries."""
    rng = random.Random(12)
    langs, sizes = ["x", "y", "z"], {"x": 3, "y": 5, "z": 2}
    letters = {"x": "abcd", "y": "cdef", "z": "efgh"}
    counted = [(k, w, rng.randrange(1, 9)) for k in langs for w in sorted({"".join(rng.choice(letters[k]) for _ in range(rng.randrange(1, 6))) for _ in range(30)})]
    own = [collections.defaultdict(lambda: dict.fromkeys(langs, 0)) for _ in range(6)]
    for k, w, n in counted:
        own[0][w][k] += n
        for size in range(1, 6):
            marked = f"^{w}$"
            for at in range(len(marked) - size + 1):
                own[size][marked[at : at + size]][k] += n

    def logs(size, key):
        table = own[size]
        return [math.log((table[key][k] + 0.5) / (sum(c[k] for c in table.values()) + 0.5 * len(table))) for k in langs]

    def evidence(word):
        if word in own[0]:
            return logs(0, word)
        for size in range(5, 0, -1):
            marked = f"^{word}$"
            known = [logs(size, g) for g in (marked[at : at + size] for at in range(len(marked) - size + 1)) if g in own[size]]
            if known:
                return [sum(x) / len(known) for x in zip(*known)]
        return [0.0] * 3

    scorer = langid.Scorer(langid.tables(langs, counted, sizes))
    for _ in range(60):
        words = ["".join(rng.choice("abcdefghq") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 6))]
        total = [math.log(sizes[k]) + sum(x) for k, *x in zip(langs, *map(evidence, words))]
        lang, score = scorer.predict(" ".join(words))
        assert lang == langs[total.index(max(total))] and math.isclose(score, 1 / sum(math.exp(t - max(total)) for t in total), rel_tol=1e-9)


# 5 sharding


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=40), st.integers(1, 60))
def test_jump_hash(keys, n):
    got, more = sharding.jump_hash(np.array(keys, np.int64), n).tolist(), sharding.jump_hash(np.array(keys, np.int64), n + 1).tolist()
    assert got == [jump(k, n) for k in keys]
    assert all(a == b or b == n for a, b in zip(got, more))


def test_slots_and_written_shards(spark, docs, tmp_path):
    rows = sharding.assign_shards(docs, 5).collect()
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {(r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()} == {(r.doc_id, r.shard) for r in rows}


# 6 near duplicates


def print_of(text, k):
    import xxhash

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aB \n\x0b\x1cé", max_size=30))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == print_of(text, 3)


@pytest.mark.parametrize("radius", [1, 2, 3, 6])
def test_masks_cover(radius):
    rng, masks = random.Random(1), simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not diff & m for m in masks)


@pytest.mark.parametrize("radius", [2, 6])
def test_links_have_the_components_of_all_pairs(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:12]:
        q = p
        for _ in range(12):
            for b in rng.sample(range(64), rng.randrange(1, radius + 2)):
                q ^= 1 << b
            prints.add(q)
    prints = [x - 2**64 if x >> 63 else x for x in prints]
    found = components(simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), radius))
    got = {r.node: r.component for r in found.collect()}
    label = {x: x for x in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= radius and label[a] > label[b]:
                    label[a], changed = label[b], True
    assert all(got.get(x, x) == label[x] for x in prints)


@pytest.mark.parametrize("chunk", [4, 16, 50])
def test_alike_rows_give_few_edges(spark, chunk, monkeypatch):
    """n rows that are all alike are linked by fewer than 2 n edges, however many chunks they are compared in."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    n = 100
    prints = spark.createDataFrame([(k,) for k in range(64)], "fp long")
    edges = simhash.links(prints, 6)
    # 64 values of the last 6 bits meet in many buckets; one edge for each value, bucket and two chunks at most.
    assert {r.component for r in components(edges).collect()} == {0}
    words = [f"w{k}" for k in range(200)]
    frame = spark.createDataFrame([(k, " ".join([*words[:199], f"x{k}"])) for k in range(n)], "doc_id long, text string").withColumn("print", F.col("doc_id"))
    members = frame.select(F.col("doc_id").cast("string").alias("digest"), F.lit(0).cast("long").alias("component"), F.lit(200).alias("n"), "doc_id", "print")
    found = simhash.verified(frame, members)
    chunks = -(-n // chunk)
    assert found.count() <= n + chunks * (chunks - 1) // 2 and {r.component for r in components(found).collect()} == {"0"}


def test_labels_are_linked_not_what_they_hold(spark):
    """Fingerprints of few labels give edges between labels only; the components are those without labels."""
    rng = random.Random(9)
    prints = [rng.getrandbits(40) << 6 | rng.getrandbits(6) for _ in range(40)]
    prints += [p ^ 1 << rng.randrange(46) for p in prints for _ in range(10)]
    frame = spark.createDataFrame([(p, p % 3) for p in set(prints)], "fp long, label long")
    edges = {tuple(r) for r in simhash.label_links(frame, 6).collect()}
    assert all(a != b and {a, b} <= {0, 1, 2} for a, b in edges) and edges
    assert not simhash.label_links(frame.withColumn("label", F.lit(7).cast("long")), 6).collect()
    alone = frame.withColumn("label", F.col("fp"))
    got, want = ({r.node: r.component for r in components(e).collect()} for e in (simhash.label_links(alone, 6), simhash.links(frame.select("fp"), 6)))
    assert got == want and len(set(got.values())) > 5


def test_a_group_of_near_copies_has_few_candidate_edges(spark, monkeypatch):
    """Each text differs from all others in one word of 200: bands link them, so masks needn't link them again."""
    words = [f"word{k}" for k in range(200)]
    texts = [" ".join([*words[: k % 200], f"other{k}", *words[k % 200 + 1 :]]) for k in range(400)]
    seen = []
    monkeypatch.setattr(simhash, "components", lambda edges: (seen.append(edges.count()), components(edges))[1])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(frame).collect()] == [0]
    assert sum(seen) < 10 * len(texts), seen


def test_hidden_names_stay(spark):
    rows = spark.createDataFrame([(1, "a b", 7, "x"), (2, "A  b", 8, "y"), (3, "c", 9, "z")], "doc_id long, text string, _row_id long, `odd.name` string")
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns and sorted(map(tuple, kept.collect())) == [(1, "a b", 7, "x"), (3, "c", 9, "z")]


def shingles_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@given(st.lists(st.sets(st.integers(0, 12)), min_size=2, max_size=12), st.booleans())
def test_alike_has_the_components_of_all_pairs(sets, two):
    side = np.arange(len(sets)) % 2 if two else np.zeros(len(sets), int)
    i, j = simhash.alike([np.array(sorted(s), np.uint64) for s in sets], side, 0.5)
    want = [(a, b) for a in range(len(sets)) for b in range(a) if (side[a] != side[b] or not two) and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5]

    def parts(edges):
        label = list(range(len(sets)))
        for _ in sets:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert parts(list(zip(i, j))) == parts(want) and len(i) < len(sets)


def test_one_of_each_group_stays(docs):
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) and 0 in kept and 204 not in kept and 205 not in kept and kept.count(208) == 1
    # Null, empty and blank texts are one group; a null id is no reason to go.
    assert 200 in kept and not {201, 202} & set(kept) and None in kept and kept.count(203) == 1


def test_shingles_decide_what_stays(spark, monkeypatch):
    """Chains of ever more changed texts: candidates are all within reach, so the groups are those of all pairs."""
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(8)) for _ in range(3000)]
    texts = []
    for _ in range(6):
        words = rng.sample(vocabulary, 150)
        for _ in range(10):
            texts.append(" ".join(words))
            for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 6])):
                words[at] = rng.choice(vocabulary)
    texts += ["few words", "Few  words", "few other words", texts[0].upper()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    # All candidates in one group: every link of shingles must be found, through all chunks.
    members = frame.select(F.col("doc_id").cast("string").alias("digest"), F.lit(0).cast("long").alias("component"), F.lit(150).alias("n"), "doc_id", F.col("doc_id").alias("print"))
    edges = simhash.verified(frame.withColumn("print", F.col("doc_id")), members)
    got = {int(r.node): int(r.component) for r in components(edges.selectExpr("cast(a as long) a", "cast(b as long) b")).collect()}
    sets, label = [shingles_of(t) for t in texts], list(range(len(texts)))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    for _ in texts:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert [got.get(k, k) for k in range(len(texts))] == label
    # Through fingerprints nothing stays or goes that the shingles don't ask for.
    kept = {r.doc_id for r in simhash.keep_one(frame).collect()}
    assert kept >= set(label) and {label[k] for k in kept} == set(label)


def test_extended_copies_are_found(spark):
    """Copies that go on for more words or hold foreign ones, alike by 0.8 or more: far apart in fingerprints, one stays."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(8)) for _ in range(3000)]
    texts = []
    for k in range(60):
        words = rng.sample(vocabulary, 240)
        texts += [" ".join(words[:200]), " ".join(words[:230] if k % 2 else [*words[:200], *rng.sample(vocabulary, 40)])]
    assert all(len(shingles_of(a) & shingles_of(b)) / len(shingles_of(a) | shingles_of(b)) >= 0.8 for a, b in zip(texts[::2], texts[1::2]))
    assert sum((simhash.content_fingerprint(a) ^ simhash.content_fingerprint(b)).bit_count() > 6 for a, b in zip(texts[::2], texts[1::2])) > 10
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.keep_one(frame).collect()} == set(range(0, 120, 2))


# 7 media


@given(st.binary(max_size=3000), st.integers(1, 900))
@settings(deadline=None)
def test_transport_stream_round_trip(data, chunk):
    stored = media.mux(data, chunk)
    found = media.demux(stored)
    assert b"".join(p.data for p in found.packets) == data and len(stored) % 188 == 0
    assert not found.continuity_errors and not found.crc_errors and not found.sync_losses
    assert all(p.random_access and p.complete for p in found.packets) and [p.pts for p in found.packets] == [k * media.STEP for k in range(len(found.packets))]
    assert found.programs == {media.PROGRAM: {media.DATA_PID: media.PRIVATE_DATA}}


def ts_packet(pid, counter, body, start=False, adaptation=None):
    """A packet by the standard's layout, written apart from the module; a short body is stuffed."""
    room = 184 - len(body)
    if adaptation is None and room:
        adaptation = b"" if room == 1 else b"\x00"
    if adaptation is not None:
        adaptation = bytes([room - 1]) + adaptation.ljust(room - 1, b"\xff")
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if adaptation is not None else 0x10) | counter & 15])
    out = head + (adaptation or b"") + body
    assert len(out) == 188
    return out


def crc32_mpeg(data):
    value = 0xFFFFFFFF
    for bit in (byte >> k & 1 for byte in data for k in range(7, -1, -1)):
        value = (value << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if (value >> 31) ^ bit else 0)
    return value.to_bytes(4, "big")


def psi(table, number, body):
    raw = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return raw + crc32_mpeg(raw)


def clock_bytes(mark, ticks):
    bits = f"{mark:04b}" + f"{ticks:033b}"
    return int(bits[:7] + "1" + bits[7:22] + "1" + bits[22:37] + "1", 2).to_bytes(5, "big")


def test_a_hand_made_stream_of_two_programs():
    """A program table over two packets, two programs, decoding times, a clock that wraps, a repeated packet, null packets."""
    streams = lambda pid, kind, pad=b"": (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(pad)).to_bytes(2, "big") + pad + bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\0"
    # Forty programs that don't occur fill the first packet, so the table ends in a second one.
    rows = b"".join(n.to_bytes(2, "big") + (0xE000 | 0x1F00 + n).to_bytes(2, "big") for n in range(50, 95))
    pat = b"\0" + psi(0, 1, b"\0\7\xe1\x00" + b"\0\x09\xe2\x00" + rows)
    out = [ts_packet(0, 0, pat[:184], True), ts_packet(0, 1, pat[184:].ljust(184, b"\xff"))]
    out += [ts_packet(0x100, 0, b"\0" + psi(2, 7, streams(0x101, 0x1B, b"\x05\x02ab")), True), ts_packet(0x200, 0, b"\0" + psi(2, 9, streams(0x201, 0x0F)), True)]
    top = (1 << 33) - 100
    one = b"\0\0\1\xe0\0\0\x84\xc0\x0a" + clock_bytes(3, top) + clock_bytes(1, top - 50) + bytes(range(150))
    two = b"\0\0\1\xe0\0\0\x84\x80\x05" + clock_bytes(2, 20) + b"after the wrap"
    sound = b"\0\0\1\xc0" + (8 + 5).to_bytes(2, "big") + b"\x80\x80\x05" + clock_bytes(2, 90_000) + b"sound"
    out += [ts_packet(0x101, 3, one, True, b"\x40"), ts_packet(0x201, 15, sound, True), ts_packet(0x1FFF, 0, bytes(184)), ts_packet(0x101, 4, b"more", False), ts_packet(0x101, 4, b"more", False)]
    out += [ts_packet(0x101, 5, two, True), ts_packet(0x201, 0, sound, True, b"\x40")]
    found = media.demux(b"".join(out))
    assert found.programs == {7: {0x101: 0x1B}, 9: {0x201: 0x0F}} and not found.crc_errors and not found.continuity_errors and not found.sync_losses
    got = sorted((p.pid, p.pts, p.dts, p.random_access, p.offset // 188, p.data) for p in found.packets)
    assert got == sorted([
        (0x101, top, top - 50, True, 4, bytes(range(150)) + b"more"), (0x101, 20, None, False, 9, b"after the wrap"),
        (0x201, 90_000, None, False, 5, b"sound"), (0x201, 90_000, None, True, 10, b"sound"),
    ])


def test_damage_is_counted():
    stored = media.mux(bytes(range(256)) * 100)
    lost = media.demux(stored[: 188 * 10] + stored[188 * 11 :])
    assert lost.continuity_errors == 1 and sum(not p.complete for p in lost.packets) == 1
    assert media.demux(b"junk" + stored).sync_losses == 1 and media.demux(b"").n_packets == 0
    broken = bytearray(stored)
    broken[20] ^= 1
    assert media.demux(bytes(broken)).crc_errors + media.demux(bytes(broken)).sync_losses >= 1 or not media.demux(bytes(broken)).packets


def test_stored_texts(docs):
    import hashlib

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in media.describe(media.store(docs)).collect():
        n, raw = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert [(p.pts, p.random_access) for p in r.points] == [(k * media.STEP, True) for k in range(-(-len(raw) // media.CHUNK))]
        assert r.media_bytes == len(media.mux(raw)) and r.media_sha256 == hashlib.sha256(media.mux(raw)).hexdigest()


# 8 language model


def log10_of(model, kinds):
    """The log10 probabilities of entries after the two before, each normalised over all entries by itself."""
    n = model.classes.n
    near, far = model.near.astype(float), model.far.astype(float)
    out = []
    for k, t in enumerate(kinds):
        scores = near[kinds[k - 1] if k else n] + far[kinds[k - 2] if k > 1 else n]
        out.append(scores[t] - math.log10((10**scores).sum()))
    return out


def test_scores(spark, docs):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    table = docs.withColumn("held", held).select("doc_id", "held", "text")
    model, counts = lm.fit(table.filter("not held").select("text"), top=20, tails=10)
    c = collections.Counter(w for r in table.filter("not held").collect() for w in lm.tokens(r.text))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.types) == (n, v) and model.counts == {w: c[w] for w in model.classes.words}
    texts = {r.doc_id: r.text for r in table.collect()}
    # Within an entry the shares of all words and of an unseen one sum to 1.
    mass = collections.Counter()
    for w, k in c.items():
        if w not in model.classes.words:
            mass[model.classes.of(w)] += k + 1
    assert all(abs(math.log10(m + 1) - model.shares[k]) < 1e-9 for k, m in mass.items())
    rows = lm.score(table, model, counts, ["doc_id", "held"], 20_000).collect()
    assert len(rows) == table.count()
    for r in rows:
        words = lm.tokens(texts[r.doc_id])
        assert r.n_tokens == len(words) and r.n_known == sum(c[w] > 0 for w in words) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        kinds = [model.classes.of(w) for w in words]
        inner = sum(0 if w in model.classes.words else math.log10(c[w] + 1) - model.shares[k] for w, k in zip(words, kinds))
        assert math.isclose(r.score, inner + sum(log10_of(model, kinds)), rel_tol=1e-4)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_contrast_has_the_slopes_of_its_likelihood():
    rng = np.random.default_rng(4)
    n, width = 7, 3
    m = {"inputs": rng.normal(size=(n + 1, width)), "outputs": rng.normal(size=(n, width)), "near": rng.normal(size=(width, width)), "far": rng.normal(size=(width, width)), "bias": rng.normal(size=n)}
    c1, c2, t, z = rng.integers(0, n + 1, 20), rng.integers(0, n + 1, 20), rng.integers(0, n, 20), rng.integers(0, n, 9)
    log_q = np.log(np.full(n, 1 / n))

    def gain(m):
        true, false, _ = lm.contrast(m, c1, c2, t, z, log_q)
        return -(np.logaddexp(0, -true).sum() + np.logaddexp(0, false).sum()) / 20

    for name, slope in lm.contrast(m, c1, c2, t, z, log_q)[2].items():
        for at in np.ndindex(slope.shape):
            moved = {k: v.copy() for k, v in m.items()}
            moved[name][at] += 1e-5
            up = gain(moved)
            moved[name][at] -= 2e-5
            assert abs((up - gain(moved)) / 2e-5 - slope[at]) < 1e-5


def test_each_text_trains_once(spark, monkeypatch):
    """The rounds together feed every training text, those with no other text's words too, and feed it once."""
    texts = [f"alone{k} word" for k in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    parts = []
    wide = lambda frame, ids: parts.append([r.text for r in frame.collect()])
    select = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: (wide(self, f) if f.__name__ == "train" else None, select(self, f, *a, **k))[1])
    lm.fit(docs, top=5, tails=5)
    assert len(parts) == lm.ROUNDS and sorted(t for p in parts for t in p) == sorted(texts)


def test_many_pairs_are_few_bytes_in_the_driver(spark, monkeypatch):
    """All pairs of the vocabulary's entries, as a large corpus has them, are no rows of Python's."""
    texts = spark.createDataFrame([(" ".join(f"word{k}" for k in range(700)),)], "text string")
    every = lambda docs, classes: spark.range((classes.n + 1) * classes.n).selectExpr("(id DIV %d) * %d + id %% %d AS pair" % (classes.n, classes.n + 1, classes.n), "id % 9 + 1 AS n")
    monkeypatch.setattr(lm, "pair_counts", every)
    tracemalloc.start()
    try:
        model, _ = lm.fit(texts, top=600, tails=5, rounds=0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.classes.n == 606 and model.near.shape == (607, 606)
    assert peak < 40e6


def test_the_trained_model_beats_counted_pairs_on_held_out_texts(spark):
    """In log10 a token, on texts it hasn't seen: better than its start, than counted pairs of entries and single entries."""
    table = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").withColumn("held", queries.fold("doc_id", 7, 2))
    train, held = table.filter("not held").select("text"), table.filter("held").select("text")
    model, _ = lm.fit(train)
    plain, _ = lm.fit(train, rounds=0)
    n, cache = model.classes.n, {}
    seen, new = ([lm.class_ids(lm.tokens(r.text), model.classes, cache) for r in t.collect()] for t in (train, held))
    pairs = np.zeros((n + 1, n))
    for ids in seen:
        np.add.at(pairs, (np.append(n, ids[:-1]), ids), 1)
    single = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * n)
    counted = np.log10((pairs + 100 * single) / (pairs.sum(axis=1, keepdims=True) + 100))
    total = sum(map(len, new))
    own = sum(model.log10(ids).sum() for ids in new) / total
    assert own > sum(plain.log10(ids).sum() for ids in new) / total + 0.02
    assert own > sum(counted[np.append(n, ids[:-1]), ids].sum() for ids in new) / total + 0.01
    assert own > sum(np.log10(single[ids]).sum() for ids in new) / total + 0.2


# 9 surrogates


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_derangement(size):
    moved = [pii.derange(k, size, pii.KEY, b"t") for k in range(size)]
    assert sorted(moved) == list(range(size)) and (size == 1 or all(a != k for k, a in enumerate(moved)))


FOUND = [
    ("email", "und.34@mail7.example.com"), ("phone", "+1 (017) 555-7713"), ("ip", "97.51.17.173"), ("ip", "10.0.0.8"), ("card", "4845168114407329"), ("card", "4845-1681-1440-7329"),
    ("ssn", "123-45-6789"), ("iban", "DE89370400440532013000"), ("secret", "04dbebab91ab85687d33"),
]


@pytest.mark.parametrize(("kind", "value"), FOUND)
def test_entities_are_replaced_in_kind(kind, value):
    text = f'seen: token = "{value}"!' if kind == "secret" else f"see {value}, or {value}."
    out, found = pii.replaced(text)
    assert {e.kind for e, _ in found} == {kind} and value not in out and len({s for _, s in found}) == 1
    s = found[0][1]
    assert len(s) == len(value) and [c.isdigit() for c in s] == [c.isdigit() for c in value] or kind in ("ip", "secret")
    again = pii.entities(text.replace(value, s))
    assert [e.kind for e in again] == [kind] * len(found)


@pytest.mark.parametrize("digits", ["0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-."])
@pytest.mark.parametrize("n", [256, 257, 1000, 200_000])
def test_long_secrets_go_whole(digits, n):
    rng = random.Random(n)
    value = "1" + "".join(rng.choice(digits) for _ in range(n - 1))
    out, found = pii.replaced(f"api_key={value} ends")
    assert [(e.kind, e.value) for e, _ in found] == [("secret", value)] and len(out) == n + 13
    assert not any(value[at : at + 20] in out for at in range(0, min(n, 3000) - 20)) and value[-20:] not in out
    other = value[:-1] + ("1" if value[-1] != "1" else "2")
    assert pii.surrogate("secret", other) != found[0][1] == pii.surrogate("secret", value)


def test_names_keep_script_gender_and_identity():
    out, found = pii.replaced("Frau Anna Schmidt met Mr. Jones. Г-жа Иванова and Mrs. Anna Schmidt; Herr Braun.")
    new = dict((e.value, s) for e, s in found)
    assert len(found) == 5 and new["Anna Schmidt"].split()[0][0].isupper() and len(set(new.values())) == len(new)
    assert all(0x400 <= ord(c) < 0x500 for c in new["Иванова"]) and new["Иванова"].endswith("а")


def test_names_agree_by_part_and_in_later_mentions():
    text = "Smith? Mr John Smith met Dr Alex Brown-Jones. Mr Smith's car; SMITH and John Smith, Mrs. Brown, Mr Alex Jones. Smithson, brown bread, Johnny."
    out, found = pii.replaced(text)
    word = {w: pii.surrogate("name", w) for w in ("John", "Smith", "Alex", "Brown", "Jones")}
    want = text.replace("Smithson", "#").replace("Johnny", "%").replace("SMITH", word["Smith"].upper())
    for old, new in word.items():
        want = want.replace(old, new)
    assert out == want.replace("#", "Smithson").replace("%", "Johnny") and len(set(word.values())) == 5
    assert all(old != new and old[-1:] == new[-1:] for old, new in word.items() if old[-1] in pii.MARKS)
    assert [(e.value, text[e.start : e.end]) for e, _ in found] == [(e.value,) * 2 for e, _ in found] and len(found) == 8


def test_titles_do_not_part_names():
    out, found = pii.replaced("Dr. Smith met Mr. Smith and Mrs. Smith.")
    assert len(found) == 3 and len({x for _, x in found}) == 1


def test_a_phone_number_is_one_however_it_is_written():
    ways = ["+1 415-555-2671", "415-555-2671", "+14155552671", "+1 (415) 555-2671", "(415) 555-2671"]
    moved = ["".join(c for c in pii.surrogate("phone", w) if c.isdigit())[-10:] for w in ways]
    assert len(set(moved)) == 1 and moved[0] != "4155552671" and moved[0][3:6] == "555"
    for way in ("+442079460958", "+49 30 1234567", "+7 495 123-45-67", "+380 44 123 4567"):
        new = pii.replaced(f"call {way}.")[0]
        assert way not in new and new.startswith(f"call {way[:2]}")


def test_every_letter_of_a_name_moves():
    """Whatever the script: all letters of the ranges have an alphabet, and no name stays."""
    for low, high in pii.RANGES:
        for c in map(chr, range(low, high)):
            if c.islower() and len(c.upper()) == 1 and c.upper().lower() == c != c.upper():
                assert len(pii.CLASS[c]) > 1 and len(pii.CLASS[c.upper()]) > 1
    names = ["Øß", "Ødegård", "Łukasz", "Żółć", "Çelik", "Ёжиков", "Ángel", "Œuvre", "Þór", "Παπαδόπουλος", "Їжак", "Ősz"]
    moved = [pii.replaced(f"Mr. {n} came")[1][0][1] for n in names]
    for old, new in zip(names, moved):
        assert len(old) == len(new) and new[0].isupper() and new[1:].islower() and sum(a == b for a, b in zip(old, new)) < len(old)
        assert pii.surrogate("name", old.upper()).lower() == new.lower() or "ß" in old
    assert len(set(moved)) == len(names)


@given(st.lists(st.text(alphabet="abcdeøåßñжюαω", min_size=2, max_size=5), min_size=2, max_size=30, unique=True))
@settings(max_examples=60, deadline=None)
def test_no_two_names_share_a_surrogate_and_none_stays(names):
    names = sorted({n.capitalize() for n in names if len(n.capitalize()) == len(n)})
    moved = [pii.surrogate("name", n) for n in names]
    assert len(set(moved)) == len(names) and not any(a == b for a, b in zip(names, moved))


def test_short_names_do_not_meet():
    names = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]
    moved = {(n, pii.replaced(f"{title} {n} ")[1][0][1]) for n in names for title in ("Mr", "Mrs", "Dr")}
    assert len(moved) == len({new for _, new in moved}) == len(names) and all(old != new for old, new in moved)


def test_collisions_stop_the_query(spark, docs, monkeypatch):
    rows = spark.createDataFrame([(1, "Mr Ab and Mrs Cd"), (2, "write to a@b.org")], "doc_id long, text string")
    assert pii.anonymize(rows).count() == 2
    met = spark.createDataFrame([("name", "Xy", 2)], "kind string, surrogate string, n_values long")
    monkeypatch.setattr(pii, "collisions", lambda *_: met)
    with pytest.raises(ValueError, match="share a surrogate"):
        pii.anonymize(rows)


def test_clean_texts_stay(spark, docs):
    for text in ("plain words only", "version 4.0. of 2024-01-02", "9807915762804490 isn't a card", "a token of thanks", None, ""):
        assert pii.replaced(text) == (text, [])
    rows = spark.createDataFrame([(k, f"mail a{k}@x{k}.org and 4.4.{k // 250}.{k % 250}") for k in range(600)], "doc_id long, text string")
    done = pii.anonymize(rows).collect()
    assert len({r.text for r in done}) == 600 and all(r.n_entities == 2 for r in done)
    assert pii.collisions(rows).count() == 0
    same = pii.anonymize(docs)
    assert same.columns == [*(c for c in docs.columns if c != "entities"), "n_entities", "entities"]
    assert stage(same).count() == docs.count()


# 10 vectors


def test_vector_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 40)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 16))
    near = base[:30].repeat(6, axis=0) + 0.05 * rng.standard_normal((180, 16))
    dense = base[40] + 0.03 * rng.standard_normal((90, 16))
    all_ = np.concatenate([base, near, dense, base[50:60], 2 * base[60:65]]).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(all_)]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [None] + [1.0] * 15), (9004, []), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (9007, [float("inf")] + [0.0] * 15)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectors.near_vectors(table, leaf=32).collect()}
    units = all_.astype(float) / np.linalg.norm(all_.astype(float), axis=1, keepdims=True)
    close = units @ units.T >= 0.95
    np.fill_diagonal(close, False)
    want = close.sum(axis=1)
    n = np.array([got[k].n_links for k in range(len(all_))])
    assert (n <= want).all() and n.sum() >= 0.9 * want.sum()
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in (9000, 9001, 9002, 9003, 9004, 9007))
    assert got[9005].n_links == got[9006].n_links == 1 and got[9006].component_id == 9005
    assert all(got[k].kept == (got[k].component_id == k) for k in got)


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "dense"])
def test_forest_meets_nine_of_ten_close_pairs_at_any_depth(kind):
    """Pairs at the limit share a leaf of trees of depth 7 to 15, and places a row grow no faster than depth to the 1.5."""
    rng = np.random.default_rng(1)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def rows(n):
        centres = unit(rng.standard_normal((200, 64)))
        wide = {"clustered": 0.8, "dense": 0.2}.get(kind)
        return unit(rng.standard_normal((n, 64))) if wide is None else unit(centres[rng.integers(0, 200, n)] + wide / 8 * rng.standard_normal((n, 64)))

    for n in (51_000, 2_600_000):
        depth, trees = vectors.depth_and_trees(n)
        ways, sample = vectors.directions(depth, trees, 64, 10), rows(max(vectors.LEAST_SAMPLE, vectors.SAMPLE_A_LEAF << depth))
        at = (sample @ ways).astype(np.float32).reshape(-1, trees, depth)
        forest = vectors.Forest(ways, depth, *map(list, zip(*[vectors.grown(at[:, t], 0.95) for t in range(trees)])))
        own, away = sample[:500], rng.standard_normal((500, 64))
        away = unit(away - (away * own).sum(axis=1, keepdims=True) * own)
        met = [set(zip(*(x.tolist() for x in forest.leaves(v)))) for v in (own, 0.9501 * own + math.sqrt(1 - 0.9501**2) * away)]
        assert len({row for row, _ in met[0] & met[1]}) >= 0.93 * 500
        assert len(met[0]) / 500 <= 0.6 * depth**1.5 and max(map(len, forest.low)) < 1 << vectors.MAX_DEPTH


def test_a_tight_cluster_is_one_leaf():
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(64)
    x = centre + 0.1 * np.linalg.norm(centre) / 8 * rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ways = vectors.directions(4, 1, 64, 10)
    low, high = vectors.grown((x @ ways).astype(np.float32), 0.95)
    assert np.unique(vectors.Forest(ways, 4, [low], [high]).leaves(x)[1]).size == 1
