"""Near-duplicate vectors by NN-descent: refine neighbour lists, enlarge full ones, audit, keep close links."""

from __future__ import annotations

import functools
import itertools
import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from kittally.llm.common import values
from kittally.llm.graph import components
from kittally.session import cut

log = logging.getLogger(__name__)
THRESHOLD, SLACK = 0.95, 1e-4
LEAF, TREES, NEIGHBOURS, SAMPLE, CHUNK, AUDIT, RECALL, TRIES = 128, 8, 10, 16, 512, 768, 0.98, 3


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): each vector at length one as packed doubles; null for those that link with nothing."""

    def unit(x: list | None) -> bytes | None:
        if not x or any(c is None for c in x):
            return None
        v = np.array(x, np.float64)
        if not np.isfinite(v).all() or not v.any():
            return None
        v = v / np.abs(v).max()
        return (v / np.linalg.norm(v)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unit(x) for (x,) in values(batch, "v")], pa.binary())], ["vec_id", "v"])

    picked = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return picked.mapInArrow(run, "vec_id long, v binary")


def _matrix(packed, kind=np.float64) -> np.ndarray:
    raw = b"".join(x if isinstance(x, bytes) else x.as_py() for x in packed)
    return np.frombuffer(raw, np.float64).reshape(len(packed), -1).astype(kind)


def _entries(node: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.Table:
    return pa.table([pa.array(node), pa.array(other), pa.array(sim.astype(np.float64))], ["node", "other", "sim"])


ENTRY = "node long, other long, sim double"


def first_lists(nodes: DataFrame, seed: int, trees: int, threshold: float) -> DataFrame:
    """First neighbour entries: the closest within the leaves of random-hyperplane trees.

    A tree's depth follows the number of vectors; a leaf of more than LEAF is dealt into parts of about
    that size, so that no task compares more than a part with itself. Besides the closest, an entry with
    the smallest linked neighbour keeps dense groups in one piece.
    """
    depth = max(1, math.ceil(math.log2(max(2, nodes.count() / LEAF))))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), np.array([len(x) // 8 for (x,) in values(batch, "v")])
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                x = _matrix([batch.column(1)[int(i)] for i in mine])
                for tree in range(trees):
                    planes = np.random.default_rng([seed, tree, dim]).standard_normal((dim, depth))
                    code = ((x @ planes) > 0) @ (1 << np.arange(depth, dtype=np.int64))
                    n = len(mine)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.array([tree] * n, pa.int32()), pa.array([dim] * n, pa.int32()), pa.array(code)], ["node", "tree", "dim", "code"])

    def compare(part: pa.Table) -> pa.Table:
        ids, x = part["node"].to_numpy(), _matrix(part["v"])
        n = len(ids)
        sim = x @ x.T
        np.fill_diagonal(sim, -2.0)
        k = min(NEIGHBOURS, n - 1)
        if k < 1:
            return _entries(ids[:0], ids[:0], np.empty(0))
        best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        row = np.repeat(np.arange(n), k)
        linked = sim >= threshold - SLACK
        least = np.where(linked, ids[None, :], np.iinfo(np.int64).max).argmin(axis=1)
        some = np.flatnonzero(linked.any(axis=1))
        row, column = np.concatenate((row, some)), np.concatenate((best.ravel(), least[some]))
        return _entries(ids[row], ids[column], sim[row, column])

    tree = cut(nodes.select("node", "v").mapInArrow(leaves, "node long, tree int, dim int, code long"))
    by = ["tree", "dim", "code"]
    sizes = cut(tree.groupBy(*by).agg(F.ceil(F.count("*") / LEAF).alias("parts")))
    dealt = tree.join(sizes, by).select("node", *by, F.pmod(F.xxhash64("node", "tree"), F.col("parts")).alias("part"))
    return dealt.join(nodes.select("node", "v"), "node").groupBy(*by, "part").applyInArrow(compare, ENTRY)


def closest(entries: DataFrame, k: int) -> DataFrame:
    """The k closest different neighbours of each node."""
    order = W.partitionBy("node").orderBy(F.col("sim").desc(), "other")
    one = entries.groupBy("node", "other").agg(F.max("sim").alias("sim"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def refine(nodes: DataFrame, lists: DataFrame, turn: int, threshold: float) -> DataFrame:
    """Neighbours of neighbours: entries between nodes that share a neighbour, in either direction.

    Each node looks at up to SAMPLE of the nodes on its list or with it on theirs, another choice each
    turn, and compares them with one another. Only entries that better a list, or links, are given.
    """
    around = lists.select("node", "other").unionByName(lists.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    chance = W.partitionBy("node").orderBy(F.xxhash64("node", "other", F.lit(turn)), "other")
    around = around.withColumn("rank", F.row_number().over(chance)).where(F.col("rank") <= SAMPLE).drop("rank")
    worst = lists.groupBy("node").agg(F.min("sim").alias("worst"))
    looked = nodes.select("node", "v").join(worst, "node").withColumnRenamed("node", "other")
    met = around.join(looked, "other").groupBy("node").agg(F.collect_list(F.struct("other", "v", "worst")).alias("met"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (rows,) in values(batch, "met"):
                by_size: dict[int, list] = {}
                for r in rows:
                    by_size.setdefault(len(r["v"]), []).append(r)
                for same in by_size.values():
                    ids, worst, x = np.array([r["other"] for r in same]), np.array([r["worst"] for r in same]), _matrix([r["v"] for r in same])
                    i, j = np.triu_indices(len(ids), 1)
                    sim = (x @ x.T)[i, j]
                    good = (sim > np.minimum(worst[i], worst[j])) | (sim >= threshold - SLACK)
                    out.append((ids[i[good]], ids[j[good]], sim[good]))
            if out:
                a, b, s = (np.concatenate(c) for c in zip(*out))
                yield from _entries(np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((s, s))).to_batches()

    return met.select("met").mapInArrow(compare, ENTRY)


def close_links(nodes: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: the entries whose cosine in double precision reaches the threshold."""
    pairs = entries.where(F.col("sim") >= threshold - SLACK).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sim = np.array([np.frombuffer(x) @ np.frombuffer(y) for x, y in values(batch, "va", "vb")])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(sim >= threshold))

    side = lambda n: nodes.select(F.col("node").alias(n), F.col("v").alias(f"v{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb").mapInArrow(check, "a long, b long")


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): exact links within each group of (group, node, v, weight), never listing them.

    A group is dealt into chunks of about CHUNK vectors and every two chunks meet in one task, which only
    gives a number per vector. This is how a full neighbour list is enlarged to all it could hold.
    """
    sizes = cut(members.groupBy("group").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")))
    dealt = members.join(sizes, "group").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("group", "node", "v", "weight", "mine", F.least("mine", "theirs").alias("i"), F.greatest("mine", "theirs").alias("j"))

    def compare(part: pa.Table) -> pa.Table:
        ids, weight, x, mine = part["node"].to_numpy(), part["weight"].to_numpy(), _matrix(part["v"]), part["mine"].to_numpy()
        i, j = part["i"][0].as_py(), part["j"][0].as_py()
        a, b = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        close = (x[a] @ x[b].T) >= threshold
        if i == j:
            np.fill_diagonal(close, False)
            return pa.table([pa.array(ids[a]), pa.array((close @ weight[b]).astype(np.int64))], ["node", "links"])
        return pa.table([pa.array(np.concatenate((ids[a], ids[b]))), pa.array(np.concatenate((close @ weight[b], weight[a] @ close)).astype(np.int64))], ["node", "links"])

    return dealt.groupBy("group", "i", "j").applyInArrow(compare, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def true_links(nodes: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """(node, links) by brute force for at most AUDIT stated nodes against all, as sums per task."""
    shared = nodes.sparkSession.sparkContext.broadcast([(r["node"], bytes(r["v"])) for r in asked.select("node", "v").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, total = shared.value, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            ids, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            sizes = np.array([len(x) for (x,) in values(batch, "v")])
            for size in set(sizes.tolist()):
                mine, q = np.flatnonzero(sizes == size), [i for i, (_, v) in enumerate(asked) if len(v) == size]
                if q:
                    close = _matrix([asked[i][1] for i in q]) @ _matrix([batch.column(1)[int(i)] for i in mine]).T >= threshold
                    close &= np.array([asked[i][0] for i in q])[:, None] != ids[mine][None, :]
                    total[q] += (close @ weight[mine]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in asked], pa.int64()), pa.array(total)], ["node", "links"])

    return nodes.select("node", "v", "weight").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def open_links(links: DataFrame) -> int:
    """Links by node, each node's counted up to a full list: it stands still when no node with room gains one."""
    return links.groupBy("node").agg(F.least(F.count("*"), F.lit(NEIGHBOURS)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def audit(nodes: DataFrame, counts: DataFrame, members: DataFrame, threshold: float) -> dict[str, float]:
    """Mean share of its true links that a node has, for components counted exactly ("big") and for all others ("small").

    Nodes come in three kinds, of which a third of AUDIT each is counted by brute force: those of big
    components, others with links, and those without any found. What the last kind has lost counts with the
    small ones, at its share of the nodes, so lost pairs weigh as much as pairs found.
    """
    kinds = nodes.join(members.select("node", F.lit("big").alias("big")), "node", "left").join(counts.withColumnRenamed("links", "found"), "node", "left")
    kinds = cut(kinds.select("node", "v", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("big", F.when(F.col("found") > 0, "small").otherwise("alone")).alias("kind")))
    sizes = dict(kinds.groupBy("kind").count().collect())
    asked = [kinds.where(F.col("kind") == k).orderBy(F.xxhash64("node")).limit(AUDIT // 3) for k in sorted(sizes)]
    if not asked:
        return {"big": 1.0, "small": 1.0}
    asked = cut(functools.reduce(DataFrame.unionByName, asked))
    truth = asked.join(true_links(nodes, asked, threshold), "node").groupBy("kind").agg(
        F.count("*").alias("n"), F.sum((F.col("links") > 0).cast("long")).alias("linked"),
        F.sum(F.when(F.col("links") > 0, F.least("links", "found") / F.col("links")).otherwise(0.0)).alias("had"),
    )
    had = {"big": [0.0, 0.0], "small": [0.0, 0.0]}
    for r in truth.collect():
        mine, weight = had["big" if r["kind"] == "big" else "small"], sizes[r["kind"]] / r["n"]
        mine[0] += weight * r["had"]
        mine[1] += weight * r["linked"]
    return {k: a / b if b else 1.0 for k, (a, b) in had.items()}


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Links have cosine >= ``threshold`` in double precision. Equal vectors meet in one class first. Lists of
    NEIGHBOURS start in random trees and are refined round by round until no node whose list has room gains
    a link. A list full of links is saturated: its component is counted exactly. An audit compares the links
    of AUDIT nodes with brute force; while big components or the others are below RECALL, more trees and
    rounds follow. RuntimeError if TRIES times in a row that brought no link. Vectors that are null, empty, zero, hold null or non-finite components, or have a null key
    link with nothing: no links, component their own key, kept. Only vectors of one length are compared.
    """
    given = cut(unit_vectors(rows, key, vector))
    nodes = cut(given.where("v is not null and vec_id is not null").groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")).select("node", "v", "weight"))
    close = F.col("sim") >= threshold - SLACK
    lists = links = None
    known = idle = turn = 0
    for attempt in itertools.count():
        entries = cut(first_lists(nodes, seed + attempt, TREES, threshold))
        links = cut((entries.where(close) if links is None else links.unionByName(entries.where(close))).groupBy("node", "other").agg(F.max("sim").alias("sim")))
        lists = cut(closest(entries if lists is None else lists.unionByName(entries), NEIGHBOURS))
        start, known = known, open_links(links)
        while True:
            entries = cut(refine(nodes, lists, turn, threshold))
            links = cut(links.unionByName(entries.where(close)).groupBy("node", "other").agg(F.max("sim").alias("sim")))
            lists = cut(closest(lists.unionByName(entries), NEIGHBOURS))
            turn, before, known = turn + 1, known, open_links(links)
            if known == before:
                break
        pairs = cut(close_links(nodes, links, threshold))
        parts = cut(components(pairs, "a", "b"))
        both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
        weighed = both.join(nodes.select(F.col("node").alias("other"), "weight"), "other")
        counts = cut(weighed.groupBy("node").agg(F.sum("weight").alias("links"), F.count("*").alias("entries")))
        full = counts.where(F.col("entries") >= NEIGHBOURS).join(parts, "node").select("component").distinct()
        members = cut(parts.join(full, "component", "left_semi").join(nodes, "node").select(F.col("component").alias("group"), "node", "v", "weight"))
        exact = count_links(members, threshold)
        counts = cut(counts.select("node", "links").join(members.select("node"), "node", "left_anti").unionByName(exact))
        recall = audit(nodes, counts, members, threshold)
        log.info("recall of links after try %d: big components %.4f, others %.4f", attempt + 1, recall["big"], recall["small"])
        if min(recall.values()) >= RECALL:
            break
        idle = 0 if known > start else idle + 1
        if idle >= TRIES:
            raise RuntimeError(f"recall of links is {recall} after {attempt + 1} tries, {RECALL} is asked for")
    done = nodes.join(parts, "node", "left").join(counts, "node", "left").select(
        "v", F.coalesce("component", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    out = given.join(cut(done), "v", "left").select("vec_id", "n_links", "component_id")
    linked = F.col("vec_id").isNotNull() & F.col("component_id").isNotNull()
    return out.select(
        "vec_id", F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
        F.when(linked, F.col("vec_id") == F.col("component_id")).otherwise(F.lit(True)).alias("kept"),
    )
