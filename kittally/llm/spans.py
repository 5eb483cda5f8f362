"""Repeated passages by compacting the de Bruijn graph of word windows.

A window of ``span`` words is an edge of the graph, from its first to its last ``span - 1`` words. Edges are
kept packed: neighbouring windows of a document that have the same least k-mer (minimizer) form one piece of
a path. As the minimizer depends on the window alone, equal windows lie in pieces with equal minimizers, at
equal distance from it. A minimizer with one piece in the whole corpus is a nonbranching path: all its
occurrences are equal, and the piece stays packed. Where a minimizer has several pieces, the path branches,
and each different piece, not each occurrence, is unpacked into its edges, read at its source coordinates.
Joins find for pieces and edges the first document that has them, and the spans of a document join up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kittally.llm.common import id_text, values, words
from kittally.session import cut

SPAN, KMER, REMEMBERED = 50, 10, 1 << 17
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
PIECE = ["anchor", "off", "n", "h1", "h2"]


class _Memory(dict):
    """Hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit hashes of any stretch of a word sequence, from sums over powers of an odd base."""

    def __init__(self, hashes: np.ndarray, which: int):
        n, base = len(hashes), _BASES[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base))))
        self.back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(hashes ^ base) * power[:n])))

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.back[start])


def hashed(memory: _Memory, tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, tokens), np.uint64, len(tokens))


def pieces(hashes: np.ndarray, span: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Start, windows, offset of the minimizer, minimizer and both hashes of every piece of one document."""
    first, second = Rolling(hashes, 0), Rolling(hashes, 1)
    windows = len(hashes) - span + 1
    mers = first.of(np.arange(len(hashes) - kmer + 1), kmer)
    at = np.empty(windows, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(mers, span - kmer + 1)
    for i in range(0, windows, 1 << 16):
        at[i : i + (1 << 16)] = view[i : i + (1 << 16)].argmin(axis=1)
    at += np.arange(windows)
    start = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    n = np.diff(np.append(start, windows))
    length = n + span - 1
    return start, n, at[start] - start, mers[at[start]], first.of(start, length), second.of(start, length)


def _cut_pieces(docs: DataFrame, span: int, kmer: int) -> DataFrame:
    """One row per piece of every document with at least ``span`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory()
        for batch in batches:
            held, size = [], 0
            for key, twin, text in values(batch, "doc_id", "twin", "text"):
                tokens = words(text)
                if len(tokens) >= span:
                    found = pieces(hashed(memory, tokens), span, kmer)
                    held.append((key, twin, found))
                    size += len(found[0])
                if size >= 1 << 16:
                    yield _rows(held)
                    held, size = [], 0
            if held:
                yield _rows(held)

    return docs.mapInArrow(run, "doc_id long, twin int, start int, n int, off int, anchor long, h1 long, h2 long")


def _rows(held: list) -> pa.RecordBatch:
    sizes = [len(f[0]) for _, _, f in held]
    which = pa.array(np.repeat(np.arange(len(held)), sizes))
    keys, twins = pa.array([k for k, _, _ in held], pa.int64()).take(which), pa.array([t for _, t, _ in held], pa.int32()).take(which)
    start, n, off, anchor, h1, h2 = (np.concatenate(c) for c in zip(*(f for _, _, f in held)))
    small, large = (lambda x: pa.array(x.astype(np.int32))), (lambda x: pa.array(x.view(np.int64)))
    return pa.RecordBatch.from_arrays(
        [keys, twins, small(start), small(n), small(off), large(anchor), large(h1), large(h2)],
        ["doc_id", "twin", "start", "n", "off", "anchor", "h1", "h2"],
    )


def _edges(docs: DataFrame, sources: DataFrame, span: int) -> DataFrame:
    """The windows of the given pieces, read from the texts at (doc_id, twin, start)."""
    wanted = sources.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", *PIECE)).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory()
        names = ["doc_id", *PIECE, "j", "w1", "w2"]
        for batch in batches:
            out, size = [], 0
            for key, text, rows in values(batch, "doc_id", "text", "wanted"):
                found = hashed(memory, words(text))
                first, second = Rolling(found, 0), Rolling(found, 1)
                n = np.array([r["n"] for r in rows])
                which, j = np.repeat(np.arange(len(rows)), n), np.concatenate([np.arange(x) for x in n])
                start = np.array([r["start"] for r in rows])[which] + j
                piece = [np.array([r[c] for r in rows])[which] for c in PIECE]
                out.append([np.full(len(j), key), *piece, j, first.of(start, span).view(np.int64), second.of(start, span).view(np.int64)])
                size += len(j)
                if size >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*out), KINDS)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*out), KINDS)], names)

    rows = docs.join(wanted, ["doc_id", "twin"]).select("doc_id", "text", "wanted")
    return rows.mapInArrow(run, "doc_id long, anchor long, off int, n int, h1 long, h2 long, j int, w1 long, w2 long")


KINDS = [np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int32, np.int64, np.int64]


def repeated_spans(docs: DataFrame, span: int = SPAN, kmer: int = KMER) -> DataFrame:
    """(doc_id, twin, start, stop): words from start up to stop lie in windows that an earlier document has.

    docs has doc_id, twin, text. Spans of one document may overlap.
    """
    found = cut(_cut_pieces(docs.where("doc_id is not null"), span, kmer))
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    shared = cut(shared)  # as a table, so that the join below can split a hot anchor
    found = cut(found.join(shared, "anchor", "left_semi"))
    least = F.min(F.struct("doc_id", "twin", "start"))
    paths = cut(found.groupBy(*PIECE).agg(least.alias("source")).select(*PIECE, "source.*"))
    whole = (
        found.join(paths.select(*PIECE, F.col("doc_id").alias("first")), PIECE)
        .where("doc_id > first")
        .select("doc_id", "twin", "start", (F.col("start") + F.col("n") + (span - 1)).alias("stop"))
    )
    branching = paths.groupBy("anchor").agg(F.count("*").alias("paths"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    branching = branching.where("paths > 1 and a < b").select("anchor")
    edges = cut(_edges(docs, paths.join(branching, "anchor", "left_semi"), span))
    place = ["anchor", (F.col("off") - F.col("j")).alias("rel"), "w1", "w2"]
    firsts = edges.groupBy(*place).agg(F.min("doc_id").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    later = edges.select("doc_id", *PIECE, "j", *place[1:]).join(firsts, ["anchor", "rel", "w1", "w2"]).where("doc_id > first")
    single = (
        found.join(later.select("doc_id", *PIECE, "j"), ["doc_id", *PIECE])
        .select("doc_id", "twin", (F.col("start") + F.col("j")).alias("start"), (F.col("start") + F.col("j") + span).alias("stop"))
    )
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, kmer: int = KMER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): one row per input row.

    Takes out every word that lies in a window of ``span`` words which also starts in a document with a
    smaller key; ``kept`` joins the rest by one blank. Null texts have no words. Rows with a null key are
    neither sources nor cut. Repeated rows get equal results; two texts under one key are told apart by
    their hash. Windows are judged on the input alone.
    """
    rows = id_text(docs, key, text).withColumn("twin", F.hash("text"))
    found = repeated_spans(rows, span, kmer)
    found = found.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, cuts in values(batch, "text", "spans"):
                tokens = words(t)
                kept = tokens
                if cuts:
                    depth = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(depth, [c["start"] for c in cuts], 1)
                    np.add.at(depth, [c["stop"] for c in cuts], -1)
                    kept = [tokens[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
                out.append((len(tokens), len(tokens) - len(kept), b" ".join(kept).decode()))
            n, removed, texts = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = rows.join(found, ["doc_id", "twin"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
