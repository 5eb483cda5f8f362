"""Merkle manifest of a dataset, its levels kept as strings of hex digests.

A run (all rows of one group, in order of their keys) is cut into aligned blocks of ``BLOCK`` leaves. A block
keeps a level as one string of 64 hex digits a node, so its parents are hashes of fixed-width substrings of
128 digits (64 where a last node stands alone), and the sibling of a node is the substring beside it. What a block
comes to is one node of the next round, in which blocks are the leaves; rounds go on until each run is one
node, its subroot. The subroots, in order of their groups, are the leaves of the last tree.

Readers hold some thousand rows of a table at once, so a row must stay small: blocks are written with their levels
and without the paths of their members, which are put together where rows unfold.

Rows without a key come first in their run and rows of one key stand in order of their leaves, so repeated
rows are leaves of their own. A null group is a run and the first one. An empty table has no root and no rows.
Digests are all that is moved: texts are hashed where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kittally.session import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK, STEPS = 64, 6


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def _steps(n: str) -> str:
    """Levels that a block of a run of n nodes goes up: to one node, or to the top of a full block."""
    return f"CASE WHEN {n} > 1 THEN least({STEPS}, length(bin({n} - 1))) ELSE 0 END"


def _up_to(n: str) -> str:
    """[0, n-1], empty for n = 0."""
    return f"slice(sequence(0, 62), 1, {n})"


_PARENTS = "array_join(transform(sequence(0, (length({0}) - 1) DIV 128), i -> sha2(substring({0}, CAST(i AS int) * 128 + 1, 128), 256)), '')"
#: All levels of a block, lowest first.
_LEVELS = (
    "aggregate({steps}, CAST(array(array_join(transform(members, m -> m.digest), '')) AS array<string>), "
    "(all, k) -> CAST(concat(all, array({parents})) AS array<string>))"
).format(steps=_up_to("steps"), parents=_PARENTS.format("element_at(all, -1)"))
_DIGEST = "substring(element_at(levels, 1), m.slot * 64 + 1, 64)"
#: Per level the side on which the sibling of a node stands, and its digest; ``R`` alone where there is none.
_PATH = (
    "transform({steps}, k -> concat("
    "CASE WHEN shiftright(m.slot, k) % 2 = 1 THEN 'L' ELSE 'R' END, "
    "substring(element_at(levels, k + 1), (shiftright(m.slot, k) ^ 1) * 64 + 1, 64)))"
).format(steps=_up_to("steps"))


def fold(start: str, path: str) -> Column:
    """The root that a digest comes to with the siblings of a path."""
    left = "CASE WHEN s LIKE 'L%' THEN substring(s, 2) ELSE '' END"
    right = "CASE WHEN s LIKE 'R%' THEN substring(s, 2) ELSE '' END"
    return F.expr(f"aggregate({path}, {start}, (h, s) -> sha2(concat({left}, h, {right}), 256))")


def siblings(path: str) -> Column:
    return F.expr(f"array_join(transform({path}, s -> substring(s, 2)), '')")


def place(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their place in their run (``at``, from 0) and its number of rows (``n``).

    One range shuffle over (run, order): places inside a written partition come from its own row numbers, and
    what stands before it from one count per partition and run, so that a run may hold all rows.
    """
    spread = nodes.withColumn("row", F.monotonically_increasing_id())
    keys = ["run", *order, "row"]
    ranged = spread.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(ranged.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)))
    before = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("run", "part").agg(F.min("row").alias("low"), F.count("*").alias("rows"))
    starts = counts.select(
        "run",
        "part",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("low")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("run")).alias("n"),
    )
    return placed.join(cut(starts), ["run", "part"]).withColumn("at", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(run, at, n, digest, steps, levels, members): one row per block; a member is its slot in the block and its payload."""
    members = F.struct((F.col("at") % BLOCK).cast("int").alias("slot"), "digest", *payload)
    packed = (
        nodes.groupBy("run", "n", F.floor(F.col("at") / BLOCK).alias("block"))
        .agg(F.array_sort(F.collect_list(members)).alias("members"))
        .withColumn("steps", F.expr(_steps("n")).cast("int"))
        .withColumn("levels", F.expr(_LEVELS))
    )
    kept = ", ".join(f"m.{c} AS {c}" for c in ["slot", *payload])
    return packed.select(
        "run",
        F.col("block").alias("at"),
        F.ceil(F.col("n") / BLOCK).alias("n"),
        F.expr("element_at(levels, -1)").alias("digest"),
        "steps",
        "levels",
        F.expr(f"transform(members, m -> struct({kept}))").alias("members"),
    )


def climb(nodes: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks of placed nodes (run, at, n, digest), and (run, at, top, up): their paths to the top of their run."""
    blocks = cut(_blocks(nodes, payload))
    if (blocks.agg(F.max("n")).first()[0] or 1) == 1:
        return blocks, blocks.select("run", "at", F.col("digest").alias("top"), F.array().cast("array<string>").alias("up"))
    above = unfold(*climb(blocks.select("run", "at", "n", "digest"), []), [])
    return blocks, cut(above.select("run", "at", "top", F.col("path").alias("up")))


def unfold(blocks: DataFrame, tops: DataFrame, payload: list[str]) -> DataFrame:
    """The nodes of the blocks with the other columns of ``tops``, their payload and ``path``, to the top."""
    kept = ", ".join([f"at * {BLOCK} + m.slot AS at", f"{_DIGEST} AS digest", *(f"m.{c} AS {c}" for c in payload)])
    members = F.expr(f"inline(transform(members, m -> struct({kept}, concat({_PATH}, up) AS path)))")
    joined = blocks.select("run", "at", "steps", "levels", "members").join(tops, ["run", "at"])
    return joined.select(*(c for c in tops.columns if c not in ("at", "up")), members)


def manifest(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    altered: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: key, group, leaf, subroot, root and path (siblings up to the root, see ``fold``).

    ``altered`` holds other values of some fields; ``claimed`` is the leaf that a row has with them.
    """
    changed = leaf(*((altered or {}).get(f, F.col(f)) for f in fields))
    leaves = docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("run"),
        leaf(*(F.col(f) for f in fields)).alias("digest"),
        *([changed.alias("claimed")] if altered else []),
    )
    if altered:
        leaves = leaves.withColumn("claimed", F.when(F.col("claimed") != F.col("digest"), F.col("claimed")))
    payload = ["id", "claimed"] if altered else ["id"]
    blocks, tops = climb(place(leaves, ["id", "digest"]), payload)
    subroots = tops.groupBy("run").agg(F.max("top").alias("digest"))
    crown = place(subroots.select(F.lit("").alias("run"), F.col("run").alias("of"), "digest"), ["of"])
    crown = unfold(*climb(crown, ["of"]), ["of"])
    crown = cut(crown.select(F.col("of").alias("run"), F.col("top").alias("root"), F.col("path").alias("beyond")))
    tops = tops.join(crown, "run").withColumn("up", F.concat("up", "beyond")).drop("beyond")
    return unfold(blocks, tops, payload).select(
        F.col("id").alias(key),
        F.when(F.col("run") != "0", F.expr("substring(run, 2)")).alias("group"),
        F.col("digest").alias("leaf"),
        *([F.coalesce("claimed", "digest").alias("claimed")] if altered else []),
        F.col("top").alias("subroot"),
        "root",
        "path",
    )


def verify(proofs: DataFrame, leaf_column: str = "leaf") -> DataFrame:
    """Rows of a manifest with ``proof_sha256``, the root that ``leaf_column`` folds to and whether it is the root."""
    folded = proofs.withColumn("folded_root", fold(leaf_column, "path"))
    return folded.withColumn("proof_sha256", F.sha2(siblings("path"), 256)).withColumn("verified", F.col("folded_root") == F.col("root"))
