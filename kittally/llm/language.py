"""Language of a text as a mixture: n-gram likelihoods, expectation-maximisation, penalised selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from kittally.llm.common import id_text, remainder, values

BUCKETS, SLICE, ROUNDS = 1 << 16, 1 << 18, 12
_LETTER = regex.compile(r"\p{L}")


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of character trigrams, hashed to BUCKETS; None without a letter.

    Lower case; every run of characters that are no letters is one blank, so that digits and marks of
    any language weigh nothing. Long texts are counted slice by slice.
    """
    if not text or not _LETTER.search(text):
        return None
    counts = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(text), SLICE):
        clean = " " + regex.sub(r"\P{L}+", " ", text[max(0, i - 2) : i + SLICE].lower()) + " "
        points = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32)
        mixed = (points[:-2] * np.uint32(0x9E3779B1)) ^ (points[1:-1] * np.uint32(0x85EBCA6B)) ^ (points[2:] * np.uint32(0xC2B2AE35))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        counts += np.bincount(mixed >> np.uint32(16), minlength=BUCKETS)
    return counts


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and per language the smoothed gram probabilities (languages x BUCKETS).

    Every labelled text counts whole. Tasks add up their own grams first; what reaches the driver is at
    most BUCKETS numbers per language, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in values(batch, "text", "lang"):
                if (counts := gram_counts(t)) is not None:
                    sums[name] = sums[name] + counts if name in sums else counts
        for name, counts in sums.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(counts[found], pa.int64())], ["lang", "gram", "n"]
            )

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, which = np.unique(np.array(sums["lang"].to_pylist(), object).astype(str), return_inverse=True)
    counts = np.full((len(names), BUCKETS), 0.5)
    counts[which, sums["gram"].to_numpy()] += sums["n"].to_numpy()
    return [str(n) for n in names], counts / counts.sum(axis=1, keepdims=True)


def mixture(grams: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares and log-likelihood of a mixture of the rows' columns, by expectation-maximisation."""
    n, k = weights.sum(), grams.shape[1]
    shares = np.full(k, 1.0 / k)
    for _ in range(rounds if k > 1 else 0):
        parts = grams * shares
        new = (weights / parts.sum(axis=1)) @ parts / n
        done = np.abs(new - shares).max() < 1e-4
        shares = new
        if done:
            break
    return shares, float(weights @ np.log(grams @ shares))


def proportions(counts: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Share of every language in one text (zeros for those left out).

    Starts from the mixture of all languages and takes the weakest out while that lowers
    ``languages * log(grams) - 2 * log-likelihood`` or keeps it equal.
    """
    found = np.flatnonzero(counts)
    weights, grams = counts[found].astype(float), model[:, found].T
    alive = np.arange(grams.shape[1])
    shares, fit = mixture(grams, weights)
    price = np.log(max(weights.sum(), 2.0))
    while len(alive) > 1:
        rest = np.delete(np.arange(len(alive)), np.argmin(shares))
        fewer, worse = mixture(grams[:, alive[rest]], weights)
        if price - 2 * (fit - worse) < 0:
            break
        alive, shares, fit = alive[rest], fewer, worse
    out = np.zeros(grams.shape[1])
    out[alive] = shares
    return out


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, shares) for every row, from the text alone.

    Learns from rows outside the held-out fold with a language. ``shares`` maps each language of the
    selected set to its proportion, ``lang_pred`` is the largest (ties: first in the alphabet) and
    ``score`` its proportion. Null texts and texts without a letter give `und`, score 0 and no shares;
    so does everything if no row has a language.
    """
    names, model = learn(docs.where(remainder(key, folds) != held_fold), text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = "doc_id long, lang_pred string, score double, shares map<string, double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, scores, all_shares = [], [], []
            for (t,) in values(batch, "text"):
                counts = gram_counts(t) if names else None
                if counts is None:
                    best.append("und")
                    scores.append(0.0)
                    all_shares.append({})
                    continue
                shares = proportions(counts, shared.value)
                best.append(names[int(np.argmax(shares))])
                scores.append(float(min(1.0, shares.max())))
                all_shares.append({n: float(s) for n, s in zip(names, shares) if s > 0})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array([[*s.items()] for s in all_shares], pa.map_(pa.string(), pa.float64()))],
                ["doc_id", "lang_pred", "score", "shares"],
            )

    found = id_text(docs, key, text).mapInArrow(run, shape)
    return found.select("doc_id", (remainder("doc_id", folds) == held_fold).alias("held_out"), "lang_pred", "score", "shares")
