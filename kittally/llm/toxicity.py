"""Toxicity by a classifier chain: linear models in sequence, trained on out-of-fold predictions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kittally.llm.common import id_text, remainder, values
from kittally.session import cut

#: From the special to the general; the last is the label itself.
CATEGORIES = ["dense", "repeated", "toxic"]
FEATURES, SAMPLE, FOLDS, STEMS, FLUSH, MARKS = 1500, 40_000, 3, (4, 5), 1 << 20, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SURE, OFTEN, SHARE = 0.9, 3, 0.02


def features(text: str | None) -> Counter:
    """Words in lower case without marks at their ends, and stems of 4 and 5 letters, with their counts."""
    found: Counter = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        word = word.strip(MARKS)
        if word:
            found[word] += n
            for k in STEMS:
                if len(word) > k:
                    found[word[:k] + "-"] += n
    return found


def feature_table(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, clean): the number of documents with each feature, by label, from rows (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            toxic, clean = zip(*counts.values())
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], ["feature", "toxic", "clean"])
            counts.clear()
            return out

        for batch in batches:
            for text, label in values(batch, "text", "label"):
                for f in features(text):
                    pair = counts.get(f)
                    if pair is None:
                        pair = counts[f] = [0, 0]
                    pair[1 - label] += 1
                if len(counts) >= FLUSH:
                    yield flush()
        if counts:
            yield flush()

    rows = labelled.select("text", "label").mapInArrow(run, "feature string, toxic long, clean long")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lift(toxic: int, clean: int) -> Column:
    """How many standard errors a feature's toxic documents differ from their expected number."""
    n = F.col("toxic") + F.col("clean")
    share = toxic / (toxic + clean)
    return (F.col("toxic") - n * share) / F.sqrt(n * (share * (1 - share)) + 1.0)


@dataclass
class Rows:
    """Documents as lists of (feature number, weight), flattened, plus dense columns."""

    row: np.ndarray
    column: np.ndarray
    n: int
    dense: np.ndarray

    def dot(self, w: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n) + self.dense @ w[size:]

    def back(self, e: np.ndarray, size: int) -> np.ndarray:
        return np.concatenate((np.bincount(self.column, e[self.row], size), self.dense.T @ e))

    def take(self, keep: np.ndarray) -> Rows:
        new = np.cumsum(keep) - 1
        inside = keep[self.row]
        return Rows(new[self.row[inside]], self.column[inside], int(keep.sum()), self.dense[keep])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(rows: Rows, y: np.ndarray, size: int, penalty: float = 1.0, steps: int = 300) -> np.ndarray:
    """Ridge logistic weights by accelerated gradient steps, scaled per column."""
    w = look = np.zeros(size + rows.dense.shape[1])
    squares = np.concatenate((np.bincount(rows.column, minlength=size).astype(float), (rows.dense**2).sum(0)))
    width = max(1.0, (np.bincount(rows.row, minlength=rows.n).max() if rows.n else 0) + rows.dense.shape[1])
    rate = 1.0 / (0.25 * squares * min(width, 12.0) + penalty)
    for t in range(1, steps + 1):
        slope = rows.back(sigmoid(rows.dot(look, size)) - y, size) + penalty * look
        new = look - rate * slope
        look, w = new + (t - 1) / (t + 2) * (new - w), new
    return w


@dataclass
class Chain:
    numbers: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)

    def design(self, found: list[list[int]]) -> Rows:
        sizes = [len(f) for f in found]
        column = np.fromiter((c for f in found for c in f), np.int64, sum(sizes))
        return Rows(np.repeat(np.arange(len(found)), sizes), column, len(found), np.ones((len(found), 1)))

    def numbered(self, text: str | None) -> list[int]:
        get = self.numbers.get
        return [i for i in map(get, features(text)) if i is not None]

    def predict(self, rows: Rows) -> np.ndarray:
        """Probabilities, one column per category; each model sees those before it."""
        out = []
        for w in self.weights:
            p = sigmoid(rows.dot(w, len(self.numbers)))
            out.append(p)
            rows = Rows(rows.row, rows.column, rows.n, np.column_stack((rows.dense, p)))
        return np.column_stack(out)


def fit_chain(numbers: dict[str, int], found: list[list[int]], targets: np.ndarray, folds: np.ndarray) -> Chain:
    """Fits the models in order; the inputs from earlier ones are predictions of folds they did not see."""
    chain = Chain(numbers)
    rows = chain.design(found)
    for k in range(targets.shape[1]):
        y, unseen = targets[:, k], np.zeros(rows.n)
        for fold in range(FOLDS):
            train = folds != fold
            w = fit_linear(rows.take(train), y[train], len(numbers))
            unseen[~train] = sigmoid(rows.take(~train).dot(w, len(numbers)))
        chain.weights.append(fit_linear(rows, y, len(numbers)))
        rows = Rows(rows.row, rows.column, rows.n, np.column_stack((rows.dense, unseen)))
    return chain


def learn(labelled: DataFrame) -> Chain:
    """A chain from a bounded sample of rows (doc_id, text, label).

    The features are the FEATURES whose documents differ most between the labels. A toxic document is `repeated` if OFTEN or more of
    its word counts, `dense` if a SHARE of its words, fall on features that are toxic in SURE of all cases.
    """
    rows = cut(labelled.where("label in (0, 1)"))
    toxic, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    share = (toxic + 1) / (n + 2)
    if toxic in (0, n):
        return Chain({}, [np.array([np.log(share / (1 - share)), *[0.0] * k]) for k in range(len(CATEGORIES))])
    table = feature_table(rows).withColumn("lift", lift(toxic, n - toxic))
    chosen = table.orderBy(F.abs("lift").desc(), "feature").limit(FEATURES).collect()
    numbers = {r["feature"]: i for i, r in enumerate(chosen)}
    sure = {i for i, r in enumerate(chosen) if r["lift"] > 3 and r["toxic"] >= SURE * (r["toxic"] + r["clean"])}
    chain = Chain(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, hits, share = [], [], []
            for (text,) in values(batch, "text"):
                counts = features(text)
                mine = [i for i in map(numbers.get, counts) if i is not None]
                hit = max([0, *(sum(n for f, n in counts.items() if numbers.get(f) in sure and (len(f) == k + 1) == (f[-1:] == "-" and k in STEMS)) for k in (0, *STEMS))])
                found.append(mine)
                hits.append(hit)
                share.append(hit / max(1, len((text or "").split())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32())), pa.array(hits, pa.int64()), pa.array(share, pa.float64())],
                ["label", "fold", "found", "hits", "share"],
            )

    some = rows.select("label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    got = some.mapInArrow(run, "label int, fold int, found array<int>, hits long, share double").toArrow().to_pydict()
    y, hits = np.array(got["label"], float), np.array(got["hits"])
    targets = np.column_stack((y * (np.array(got["share"]) >= SHARE), y * (hits >= OFTEN), y))
    return fit_chain(numbers, got["found"], targets, np.array(got["fold"]))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
             folds: int = 5, held_fold: int = 0, threshold: float = 0.4, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, dense, repeated, score, toxic): a probability per category for every row.

    ``score`` is the probability of the label, ``toxic`` marks scores of at least ``threshold``. Learns from
    at most ``sample`` labels outside the held-out fold, those with the least hash of the key; so few are
    broadcast to pick their documents without a shuffle of texts. All documents are scored. Null and empty texts have no features and get the score of
    that; null labels are ignored. With labels of one kind only, all scores are their smoothed share.
    """
    marked = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    marked = marked.where(remainder("doc_id", folds) != held_fold).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    shared = docs.sparkSession.sparkContext.broadcast(learn(id_text(docs, key, text).join(F.broadcast(marked), "doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            found = chain.predict(chain.design([chain.numbered(t) for (t,) in values(batch, "text")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T.copy())], ["doc_id", "dense", "repeated", "score"])

    scored = id_text(docs, key, text).mapInArrow(run, "doc_id long, dense double, repeated double, score double")
    return scored.select("doc_id", (remainder("doc_id", folds) == held_fold).alias("held_out"), "dense", "repeated", "score", (F.col("score") >= threshold).alias("toxic"))
