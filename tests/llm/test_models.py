"""Models against plain computations, planted structure and held-out labels."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import empty, messy  # noqa: F401
from kittally.llm import classlm, language, quality, toxicity

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_statistics():
    got = dict(zip(quality.STATISTICS, quality.statistics("AB ab ab!\nx9 é|")))
    assert (got["n_words"], got["n_lines"], got["distinct_words"], got["n_bytes"]) == (5, 2, 1.0, 16)
    assert got["upper"] == 2 / 12 and got["bang"] == 1 / 12 and got["bar"] == 1 / 12 and got["digit"] == 1 / 12 and got["repeated_next"] == 0
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.STATISTICS)
    assert quality.statistics(" \n")[0] == 2


def test_rules_compile_to_what_they_say(spark):
    rng = np.random.default_rng(0)
    rows = rng.random((300, len(quality.STATISTICS)))
    label = (((rows[:, 3] > 0.5) & (rows[:, 7] <= 0.4)) | (rows[:, 0] > 0.9)).astype(int)
    frame = spark.createDataFrame([(int(y), *map(float, x)) for y, x in zip(label, rows)], ["label", *quality.STATISTICS])
    model = quality.fit(frame)
    assert 0 < len(model.rules) < 300
    z = np.full(300, model.intercept)
    for rule, w in zip(model.rules, model.weights):
        holds = np.ones(300, bool)
        for c in rule:
            x = rows[:, quality.STATISTICS.index(c.statistic)]
            holds &= x > c.bound if c.above else x <= c.bound
        z += w * holds
    got = [r[0] for r in frame.select(model.score()).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z)), atol=1e-9)
    assert ((np.array(got) > 0.5) == label).mean() > 0.9


def test_quality_odd_rows(spark, messy, empty):
    rows, frame = messy
    labels = spark.createDataFrame([(k, i % 2) for i, (k, *_) in enumerate(rows)] + [(1, None)], "doc_id long, quality int")
    for some in (labels, labels.where("quality = 1"), labels.limit(0)):
        got = quality.quality_scores(frame, some).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert quality.quality_scores(empty, labels).count() == 0


@tables
def test_quality_held_out(spark):
    got = quality.quality_scores(read(spark, "documents"), read(spark, "labels")).join(read(spark, "labels"), "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right / n > 0.93


def test_mixture_finds_shares():
    rng = np.random.default_rng(1)
    model = rng.dirichlet(np.full(400, 0.05), 3)
    counts = np.bincount(np.concatenate((rng.choice(400, 700, p=model[0]), rng.choice(400, 300, p=model[2]))), minlength=400)
    shares = language.proportions(counts, np.maximum(model, 1e-9))
    assert abs(shares[0] - 0.7) < 0.05 and shares[1] == 0 and abs(shares.sum() - 1) < 1e-9
    one = language.proportions(np.bincount(rng.choice(400, 500, p=model[1]), minlength=400), np.maximum(model, 1e-9))
    assert one.tolist() == [0, 1, 0]


def test_grams():
    rng = random.Random(1)
    text = "".join(rng.choice("ab cd éf. 9") for _ in range(3000))
    whole = language.gram_counts(text)
    assert language.gram_counts(None) is None and language.gram_counts("12 !") is None
    assert whole.sum() > 2000


def test_language_odd_rows(spark, messy, empty):
    rows, frame = messy
    got = language.languages(frame).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "fr", "und"} and all(0 <= r.score <= 1 for r in got)
    silent = {k for k, t, *_ in rows if not any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == silent
    assert {r.lang_pred for r in language.languages(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.languages(empty).count() == 0


@tables
def test_language_held_out_and_mixed(spark):
    docs = read(spark, "documents")
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right / n > 0.97
    long = {r.lang: r.text for r in docs.where("n_chars > 800").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = docs.unionByName(spark.createDataFrame([(10**9, long["en"][:800] + " " + long["de"][:400], None, None, 1)], docs.schema))
    row = language.languages(mixed).where("doc_id = 1000000000").first()
    assert row.lang_pred == "en" and {"en", "de"} <= set(row.shares) and row.shares["de"] > 0.2


def plain_base(rows, fold=7, held=2):
    words = {i: (t or "").encode().lower().split() + [None] for i, (k, t, *_) in enumerate(rows)}
    out = {i: zlib.crc32(str("" if k is None else k).encode()) % fold == held for i, (k, *_) in enumerate(rows)}
    counts = Counter(w for i, ws in words.items() if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted((repr(k), out[i], len(words[i]), sum(w in counts for w in words[i]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[i]), 6)) for i, (k, *_) in enumerate(rows))


def test_class_model_counts(messy, empty, monkeypatch):
    rows, frame = messy
    got = classlm.perplexity(frame, sweeps=2).collect()
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == plain_base(rows)
    assert all(math.isfinite(r.score) and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in got)
    assert classlm.perplexity(empty, sweeps=1).count() == 0
    unseen = classlm.perplexity(frame.where("doc_id = 6"), folds=1, held_fold=0, sweeps=1).first()
    assert unseen.held_out and unseen.n_known == 0 and unseen.train_tokens == 0 and unseen.base_score == 0


def test_class_model_is_a_distribution():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 50, (classlm.WIDTH, classlm.WIDTH)).astype(float)
    counts = rng.integers(1, 9, 500)
    kinds = rng.integers(0, classlm.CLASSES, 500)
    total = np.bincount(kinds, counts, classlm.WIDTH)
    types = np.bincount(kinds, minlength=classlm.WIDTH)
    share = (total + 1) / (total.sum() + classlm.WIDTH)
    step = np.log10((pairs + classlm.WIDTH * share) / (pairs.sum(1, keepdims=True) + classlm.WIDTH))
    model = classlm.ClassModel(np.arange(3), step, total, types, 1, 1, 1)
    assert np.allclose((10**step).sum(1), 1)
    for c in range(classlm.CLASSES):
        mine = counts[kinds == c]
        known = 10 ** model.emission(mine, np.full(len(mine), c))
        assert math.isclose(known.sum() + 10 ** model.emission(np.array([0]), np.array([c]))[0], 1)


def test_exchange_raises_the_likelihood(spark):
    rng = random.Random(4)
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    texts = [" ".join(rng.choice(left if i % 2 else right) for i in range(60)) for _ in range(120)]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").withColumn("held_out", F.lit(False)).repartition(4)
    texts, _ = classlm.encode(frame)
    classes, pairs = classlm.cluster(texts, 5)
    start = classlm.cluster(texts, 0)[1]
    assert classlm.likelihood(pairs) > classlm.likelihood(start) + 1000
    assert pairs.sum() == start.sum() == 120 * 61


def plain_neighbours(texts, classes):
    import xxhash

    out = np.zeros((classlm.BUCKETS + 1, 2, classlm.WIDTH), int)
    for t in texts:
        flow = [classlm.END, *(xxhash.xxh32_intdigest(w.encode()) & (classlm.BUCKETS - 1) for w in t.split()), classlm.END]
        for a, b in zip(flow, flow[1:]):
            out[b, 0, classes[a]] += 1
            out[a, 1, classes[b]] += 1
    return out


def test_neighbours(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))) for _ in range(50)]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").withColumn("held_out", F.lit(False)).repartition(3)
    classes = np.arange(classlm.BUCKETS + 1) % classlm.CLASSES
    classes[classlm.END] = classlm.CLASSES
    assert (classlm.neighbours(classlm.encode(frame)[0], classes) == plain_neighbours(texts, classes)).all()


def test_linear_fit_and_chain():
    rng = np.random.default_rng(5)
    found = [sorted(rng.choice(30, rng.integers(1, 6), replace=False).tolist()) for _ in range(800)]
    second = np.array([float(3 in f or 4 in f) for f in found])
    first = np.array([float(3 in f) for f in found])
    chain = toxicity.fit_chain({str(i): i for i in range(30)}, found, np.column_stack((first, first, second)), rng.integers(0, 3, 800))
    got = chain.predict(chain.design(found))
    assert ((got[:, 2] > 0.5) == second).mean() > 0.98 and ((got[:, 0] > 0.5) == first).mean() > 0.98
    assert [len(w) for w in chain.weights] == [31, 32, 33]


def test_toxicity_odd_rows(spark, messy, empty):
    rows, frame = messy
    labels = spark.createDataFrame([(k, i % 2) for i, (k, *_) in enumerate(rows)] + [(2, None)], "doc_id long, toxic int")
    for some in (labels, labels.where("toxic = 0"), labels.limit(0)):
        got = toxicity.toxicity(frame, some).collect()
        assert len(got) == len(rows) and all(0 <= p <= 1 for r in got for p in (r.dense, r.repeated, r.score))
    assert toxicity.toxicity(empty, labels).count() == 0


@tables
def test_toxicity_held_out(spark):
    got = toxicity.toxicity(read(spark, "documents"), read(spark, "labels")).join(read(spark, "labels").withColumnRenamed("toxic", "y"), "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("toxic").cast("int") == F.col("y")).cast("int")), F.count("*")).first()
    assert right / n > 0.93
