"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

Words are hashed to BUCKETS and the buckets are clustered, so that the class map has a fixed size for any
vocabulary; the words of one bucket share its class. Word counts stay exact: they are counted and looked
up through joins, never held whole in one place.
"""

from __future__ import annotations

import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from kittally.llm.common import id_text, lower_words, remainder, values
from kittally.session import checkpoint_dir, cut

BUCKETS, CLASSES, SWEEPS, DISCOUNT = 1 << 15, 32, 6, 0.75
BLOCK, GROUP, SLAB, FAN_IN = 12 << 20, 1 << 20, 512, 256
END = BUCKETS  # the end of a text: a bucket and a class of its own
WIDTH = CLASSES + 1


def encode(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts as numbers, and the dictionaries of their blocks.

    docs has doc_id, text, held_out. A block is about BLOCK bytes of text of one task; a word in it is known
    by its bucket and its ordinal among the block's words of that bucket. Returns (block, doc_id, held_out,
    size, buckets, ordinals), one row per GROUP bytes of text with arrays of the first three and packed
    numbers, and (block, bucket, ordinal, word, n), one row per word and block, n counting training texts.
    Both are written once to the shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        held: list[tuple[int, bool, array]] = []
        groups: list[list] = []
        size = whole = made = 0

        def flush() -> Iterator[pa.RecordBatch]:
            block = (TaskContext.get().partitionId() << 24) + made
            names = list(numbers)
            bucket = np.array([xxhash.xxh32_intdigest(w) & (BUCKETS - 1) for w in names], np.int64)
            order = np.argsort(bucket, kind="stable")
            starts = np.searchsorted(bucket[order], bucket[order])
            ordinal = np.empty(len(names), np.int64)
            ordinal[order] = np.arange(len(names)) - starts
            counts = np.zeros(len(names), np.int64)
            for group in groups:
                ids = np.concatenate([np.frombuffer(g, np.int32) for _, _, g in group])
                sizes = [len(g) for _, _, g in group]
                train = np.repeat([not h for _, h, _ in group], sizes)
                counts += np.bincount(ids[train], minlength=len(names))
                row = {"kind": "text", "block": block, "doc_id": [k for k, _, _ in group], "held_out": [h for _, h, _ in group], "size": sizes,
                       "buckets": _pack(bucket[ids], "<u2"), "ordinals": _pack(ordinal[ids], "<u4")}
                yield pa.RecordBatch.from_pylist([row], LAYOUT)
            for i in range(0, len(names), 1 << 17):
                part = slice(i, i + (1 << 17))
                k = len(names[part])
                found = {"kind": pa.array(["word"] * k), "block": pa.array(np.full(k, block)), "bucket": pa.array(bucket[part].astype(np.int32)),
                         "ordinal": pa.array(ordinal[part].astype(np.int32)), "word": pa.array(names[part], pa.binary()), "n": pa.array(counts[part])}
                yield pa.RecordBatch.from_arrays([found.get(f.name, pa.nulls(k, f.type)) for f in LAYOUT], schema=LAYOUT)

        for batch in batches:
            for key, text, out in values(batch, "doc_id", "text", "held_out"):
                held.append((key, out, array("i", map(numbers.__getitem__, lower_words(text)))))
                size += len(text or "") + 64
                if size >= GROUP:
                    groups.append(held)
                    whole += size
                    held, size = [], 0
                if whole >= BLOCK:
                    yield from flush()
                    numbers.clear()
                    groups, whole, made = [], 0, made + 1
        if held:
            groups.append(held)
        if groups:
            yield from flush()

    path = f"{checkpoint_dir(docs.sparkSession)}/kittally-{uuid.uuid4().hex}"
    docs.mapInArrow(run, SCHEMA).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    whole = docs.sparkSession.read.schema(SCHEMA).parquet(path)
    texts = whole.where("kind = 'text'").select("block", "doc_id", "held_out", "size", "buckets", "ordinals")
    return texts, whole.where("kind = 'word'").select("block", "bucket", "ordinal", "word", "n")


LAYOUT = pa.schema([
    ("kind", pa.string()), ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("size", pa.list_(pa.int32())),
    ("buckets", pa.binary()), ("ordinals", pa.binary()), ("bucket", pa.int32()), ("ordinal", pa.int32()), ("word", pa.binary()), ("n", pa.int64()),
])
SCHEMA = (
    "kind string, block long, doc_id array<long>, held_out array<boolean>, size array<int>, buckets binary, ordinals binary, "
    "bucket int, ordinal int, word binary, n long"
)


def _pack(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers as bytes, all low ones first, compressed."""
    planes = numbers.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(packed: bytes, kind: str, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=n * np.dtype(kind).itemsize)
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, n).T.copy().view(kind).ravel().astype(np.int64)


def neighbours(texts: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often each bucket follows and precedes each class in the training texts: (BUCKETS + 1, 2, WIDTH).

    Tasks add up their own tokens and send the cells that are not zero, packed by slabs of SLAB buckets;
    slabs are summed over FAN_IN tasks each and then over all. The result has a fixed size.
    """
    shared = texts.sparkSession.sparkContext.broadcast(classes)
    cells = (BUCKETS + 1) * 2 * WIDTH
    step = SLAB * 2 * WIDTH

    def pack(total: np.ndarray, first: int, salt: int) -> pa.RecordBatch | None:
        found = np.flatnonzero(total)
        if not len(found):
            return None
        gaps = _pack(np.diff(found, prepend=0), "<u4")
        return pa.RecordBatch.from_arrays(
            [pa.array([first // step], pa.int32()), pa.array([salt], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([gaps], pa.binary()), pa.array([_pack(total[found], "<i8")], pa.binary())],
            ["slab", "salt", "size", "cells", "n"],
        )

    def unpack(size: int, gaps: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(_unpack(gaps, "<u4", size)), _unpack(n, "<i8", size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros(cells, np.int64), shared.value
        for batch in batches:
            for out, sizes, packed in values(batch, "held_out", "size", "buckets"):
                flow = _unpack(packed, "<u2", sum(sizes))
                train = ~np.array(out)
                if not train.any():
                    continue
                sizes = np.array(sizes)
                flow = flow[np.repeat(train, sizes)]  # END before, between and behind texts
                flow = np.concatenate(([END], np.insert(flow, np.cumsum(sizes[train]), END)))
                kind, here = of[flow], flow * (2 * WIDTH)
                total += np.bincount(np.concatenate((here[1:] + kind[:-1], here[:-1] + WIDTH + kind[1:])), minlength=cells)
        salt = TaskContext.get().partitionId() // FAN_IN
        for first in range(0, cells, step):
            if (part := pack(total[first : first + step], first, salt)) is not None:
                yield part

    def summed(part: pa.Table) -> pa.Table:
        total = np.zeros(step, np.int64)
        for row in part.select(["size", "cells", "n"]).to_pylist():
            where, n = unpack(row["size"], row["cells"], row["n"])
            total[where] += n
        return pa.Table.from_batches([pack(total, part["slab"][0].as_py() * step, 0)])

    shape = "slab int, salt int, size long, cells binary, n binary"
    parts = texts.select("held_out", "size", "buckets").mapInArrow(count, shape)
    slabs = parts.groupBy("slab", "salt").applyInArrow(summed, shape).groupBy("slab").applyInArrow(summed, shape).toArrow()
    out = np.zeros((-(-cells // step)) * step, np.int64)
    for row in slabs.to_pylist():
        where, n = unpack(row["size"], row["cells"], row["n"])
        out[row["slab"] * step + where] = n
    return out[:cells].reshape(BUCKETS + 1, 2, WIDTH)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def transitions(near: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class bigram counts (before, after) under a class map."""
    out = np.zeros((WIDTH, WIDTH))
    np.add.at(out, classes, near[:, 0, :].astype(float))
    return out.T


def likelihood(pairs: np.ndarray) -> float:
    """The part of the class bigram log-likelihood that depends on the classes."""
    return float(_f(pairs).sum() - _f(pairs.sum(0)).sum() - _f(pairs.sum(1)).sum())


def exchange(near: np.ndarray, classes: np.ndarray, turn: int) -> np.ndarray:
    """One sweep: every other bucket moves to the class that raises the likelihood most, if any does.

    Only half of the buckets move at a time, since all are judged by the same counts. END stays alone.
    """
    pairs = transitions(near, classes)
    sizes = pairs.sum(0)
    new = classes.copy()
    for first in range(0, BUCKETS, SLAB):
        who = np.arange(first, first + SLAB)
        who = who[(who + turn) % 2 == 0]
        before, after = near[who, 0].astype(float), near[who, 1].astype(float)
        n, own = before.sum(1), classes[who]
        joins = (_f(pairs.T[None] + before[:, None]) - _f(pairs.T)[None]).sum(2) + (_f(pairs[None] + after[:, None]) - _f(pairs)[None]).sum(2)
        joins -= 2 * (_f(sizes[None] + n[:, None]) - _f(sizes)[None])
        left_in, left_out = np.maximum(pairs.T[own] - before, 0), np.maximum(pairs[own] - after, 0)
        leaves = (_f(left_in) - _f(pairs.T[own])).sum(1) + (_f(left_out) - _f(pairs[own])).sum(1) - 2 * (_f(np.maximum(sizes[own] - n, 0)) - _f(sizes[own]))
        gain = joins + leaves[:, None]
        gain[np.arange(len(who)), own] = 0.0
        gain[:, CLASSES] = -np.inf
        best = gain.argmax(1)
        moves = (gain[np.arange(len(who)), best] > 1e-9) & (n > 0)
        new[who[moves]] = best[moves]
    return new


def cluster(texts: DataFrame, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each bucket and the class bigram counts, from all training texts.

    Starts with buckets dealt to the classes by falling frequency; keeps the best map of all sweeps.
    """
    classes = np.zeros(BUCKETS + 1, np.int64)
    classes[END] = CLASSES
    near = neighbours(texts, classes)
    order = np.argsort(-near[:BUCKETS, 0].sum(1), kind="stable")
    classes[order] = np.arange(BUCKETS) % CLASSES
    best = None
    for turn in range(sweeps + 1):
        near = neighbours(texts, classes)
        pairs = transitions(near, classes)
        value = likelihood(pairs)
        if best is None or value > best[0]:
            best = (value, classes, pairs)
        classes = exchange(near, classes, turn)
    return best[1], best[2]


@dataclass
class ClassModel:
    classes: np.ndarray  # of each bucket
    step: np.ndarray  # log10 of a class after a class
    total: np.ndarray  # training tokens by class
    types: np.ndarray  # distinct training words by class
    tokens: int
    vocabulary: int
    ends: int

    def emission(self, counts: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """log10 of a word within its class: absolute discounting, the discount goes to one unknown word."""
        of = np.where(counts > 0, counts - DISCOUNT, DISCOUNT * self.types[kind] + 1)
        return np.where(kind == CLASSES, 0.0, np.log10(of / (self.total[kind] + 1)))

    def base(self, counts: np.ndarray) -> float:
        return float(np.log10((counts + 1) / (self.tokens + self.vocabulary + 1)).sum())


def perplexity(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held_fold: int = 2, sweeps: int = SWEEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row.

    Tokens are words with A-Z in lower case and one end per text; a null text is empty. ``base_score`` is
    add-one unigrams, ``score`` the class model's log10 probability, ``perplexity`` 10 ** (-score / n_tokens).
    Learns from the rows outside the held-out fold; without any, every class is as likely as another.
    """
    spark = docs.sparkSession
    source = id_text(docs, key, text).withColumn("held_out", remainder("doc_id", folds) == held_fold)
    texts, dictionary = encode(source)
    classes, pairs = cluster(texts, sweeps)
    same = W.partitionBy("word")
    counted = dictionary.select(
        "block", "bucket", "ordinal", F.sum("n").over(same).alias("c"), (F.row_number().over(same.orderBy("block")) == 1).alias("first")
    )
    counted = cut(counted)
    by_bucket = counted.where("first and c > 0").groupBy("bucket").agg(F.count("*").alias("words")).toArrow()
    types = np.bincount(classes[by_bucket["bucket"].to_numpy()], by_bucket["words"].to_numpy(), WIDTH)
    total = pairs.sum(0)
    ends = int(total[CLASSES])
    share = (total + 1) / (total.sum() + WIDTH)
    step = np.log10((pairs + WIDTH * share) / (pairs.sum(1, keepdims=True) + WIDTH))
    model = ClassModel(classes, step, total, types, int(total.sum()), int(types.sum()) + (ends > 0), ends)
    shared = spark.sparkContext.broadcast(model)

    def judge(rows: pa.Table, names: pa.Table) -> pa.Table:
        m = shared.value
        bucket = names["bucket"].to_numpy()
        starts = np.searchsorted(np.sort(bucket), np.arange(BUCKETS))
        count = np.zeros(len(names), np.int64)
        count[starts[bucket] + names["ordinal"].to_numpy()] = names["c"].to_numpy()
        out = []
        for row in rows.to_pylist():
            n = sum(row["size"])
            flow = _unpack(row["buckets"], "<u2", n)
            counts, kinds = count[starts[flow] + _unpack(row["ordinals"], "<u4", n)], m.classes[flow]
            begin = 0
            for key, held, size in zip(row["doc_id"], row["held_out"], row["size"]):
                c = np.append(counts[begin : begin + size], m.ends)
                k = np.concatenate(([CLASSES], kinds[begin : begin + size], [CLASSES]))
                begin += size
                score = m.step[k[:-1], k[1:]].sum() + m.emission(c, k[1:]).sum()
                out.append((key, held, len(c), int((c > 0).sum()), m.tokens, m.base(c), float(score), float(10 ** (-score / len(c)))))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return texts.groupBy("block").cogroup(counted.select("block", "bucket", "ordinal", "c").groupBy("block")).applyInArrow(judge, shape)
