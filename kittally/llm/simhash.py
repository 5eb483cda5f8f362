"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kittally.llm.common import id_text, lower_words, values
from kittally.llm.graph import components
from kittally.session import cut

BITS, SEED, SLICE = 64, 42, 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash over shingles of ``width`` words, repeats included; no words: zero.

    A-Z are lower-cased. A bit is 1 if it is set in over half the shingles' XXH64 (seed 42). Long texts
    are counted slice by slice.
    """
    tokens = lower_words(text)
    if not tokens:
        return 0
    count = max(1, len(tokens) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, count, SLICE):
        part = tokens[start : min(start + SLICE, count) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)))) if len(tokens) >= width else [b" ".join(tokens)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > count).tolist())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, print): the fingerprint of every row as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for (t,) in values(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])

    return id_text(docs, key, text).mapInArrow(run, "doc_id long, print long")


def _masks(radius: int) -> list[int]:
    """All bit masks with up to ``radius`` ones, as signed longs."""
    found = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def close_prints(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints at most ``distance`` bits apart.

    Every fingerprint emits the ball of half the radius around it. Two fingerprints within the radius
    share a point of their balls, so the join on points finds all pairs. As fingerprints are distinct, a
    point is shared by no more of them than one ball holds (65 for two bits), whatever the data. Unfolding
    the balls does not raise Spark's estimate of their size, so the join is told never to send one side out whole.
    """
    balls = prints.select("print").distinct().select("print", F.explode(F.array(*map(F.lit, _masks((distance + 1) // 2)))).alias("mask"))
    points = balls.select("print", F.col("print").bitwiseXOR(F.col("mask")).alias("point"))
    a, b = points.select(F.col("print").alias("a"), "point"), points.select(F.col("print").alias("b"), "point")
    return a.join(b.hint("merge"), "point").where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept): one row per input row.

    ``fingerprint`` is 16 hex digits; ``component_id`` the smallest key reachable over links of at most
    ``distance`` differing bits; ``kept`` marks the row whose key that is. Equal texts have equal
    fingerprints and meet in one class before any pair is made. Null and wordless texts have
    fingerprint zero and link as any other. A row with a null key gets the component of its class and
    is never kept unless the whole component has null keys (then component_id is null and kept true);
    rows that repeat a kept key are all kept. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, key, text, width))
    classes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    pairs = close_prints(classes, distance)
    numbered = components(pairs, "a", "b").withColumnsRenamed({"node": "print", "component": "part"})
    classes = classes.join(numbered, "print", "left").select("print", "first", F.coalesce("part", "print").alias("part"))
    classes = cut(classes)
    parts = classes.groupBy("part").agg(F.min("first").alias("component_id"))
    classes = cut(classes.join(parts, "part").select("print", "component_id"))
    return prints.join(classes, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )
