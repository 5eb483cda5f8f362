"""Ordered look-ahead and look-back that never sorts a whole sheet in one task.

A sheet is cut into blocks of consecutive rows. Windows run inside a block; what lies
beyond it comes from a table with one row per block, which is smaller by the block size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BLOCK = 1024
SHEET = ["file_id", "sheet_idx"]


def _directional(df: DataFrame, marks: dict[str, Column], keys: list[str], row: str, ahead: bool) -> DataFrame:
    # frames that grow from one end cost one step per row; looking ahead is looking back downwards
    way = F.desc if ahead else F.asc
    inner = Window.partitionBy(*keys, "_block").orderBy(way(row)).rangeBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(way("_block")).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min if ahead else F.max
    flagged = df.withColumns(
        {"_block": F.floor(F.col(row) / BLOCK)}
        | {f"_at_{n}": F.when(c, F.col(row)) for n, c in marks.items()}
    )
    # one exchange serves both the windows and the block table
    flagged = flagged.repartition(*keys, "_block")
    blocks = flagged.groupBy(*keys, "_block").agg(*[pick(f"_at_{n}").alias(f"_b_{n}") for n in marks])
    beyond = blocks.select(
        *keys, "_block", *[pick(f"_b_{n}").over(outer).alias(f"_o_{n}") for n in marks]
    )
    return (
        flagged.join(beyond, [*keys, "_block"])
        .withColumns({n: F.coalesce(pick(f"_at_{n}").over(inner), F.col(f"_o_{n}")) for n in marks})
        .drop("_block", *[f"_at_{n}" for n in marks], *[f"_o_{n}" for n in marks])
    )


def next_row(df: DataFrame, marks: dict[str, Column], keys: list[str] = SHEET, row: str = "row") -> DataFrame:
    """For each mark, the first later row carrying it (null if none)."""
    return _directional(df, marks, keys, row, ahead=True)


def prev_row(df: DataFrame, marks: dict[str, Column], keys: list[str] = SHEET, row: str = "row") -> DataFrame:
    """For each mark, the last earlier row carrying it (null if none)."""
    return _directional(df, marks, keys, row, ahead=False)


def run_ends(df: DataFrame, flag: Column, n: int, keys: list[str] = SHEET, row: str = "row") -> DataFrame:
    """Rows that complete ``n`` consecutive flagged rows.

    Every flagged row votes for itself and the n-1 rows after it; n votes make a run end.
    """
    votes = df.filter(flag).select(
        *keys, F.explode(F.sequence(F.col(row), F.col(row) + (n - 1))).alias(row)
    )
    return votes.groupBy(*keys, row).count().filter(F.col("count") == n).drop("count")


def upper_median(hist: DataFrame, keys: list[str], value: str, count: str = "n") -> DataFrame:
    """``sorted(values)[len // 2]`` per key, from a histogram of the values."""
    w = Window.partitionBy(*keys)
    running = F.sum(count).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return (
        hist.withColumns({"_run": running, "_total": F.sum(count).over(w)})
        .filter(F.col("_run") > F.floor(F.col("_total") / 2))
        .groupBy(*keys)
        .agg(F.min(value).alias("median"), F.first("_total").alias("total"))
    )


def number_by(df: DataFrame, order: str, keys: list[str], out: str) -> DataFrame:
    """1-based position of each row in its key, counted per block of rows."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    sizes = blocked.groupBy(*keys, "_block").count()
    before = sizes.select(
        *keys,
        "_block",
        F.coalesce(
            F.sum("count").over(
                Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        blocked.join(before, [*keys, "_block"])
        .withColumn(out, F.col("_before") + F.row_number().over(inner))
        .drop("_block", "_before")
    )


def running_sum(df: DataFrame, order: str, keys: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of a key up to each row, counted per block of ``order``."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = before.select(*keys, "_block", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.join(before, [*keys, "_block"])
        .withColumn(out, F.col("_before") + F.sum(value).over(inner))
        .drop("_block", "_before")
    )


def first_from(asked: DataFrame, at: str, rows: DataFrame, marks: dict[str, Column], keys: list[str] = SHEET, row: str = "row") -> DataFrame:
    """For each asked place, the first row at or after it that carries each mark (null if none).

    Places and rows stand in one line, a place just before the row it names.
    """
    flags = rows.select(*keys, (F.col(row) * 2 + 1).alias("_pos"), *[m.alias(f"_is_{n}") for n, m in marks.items()])
    line = union_all([flags.withColumn("_asked", F.lit(False)), asked.withColumns({"_pos": F.col(at) * 2, "_asked": F.lit(True)})])
    seen = next_row(line, {n: F.col(f"_is_{n}") for n in marks}, keys, "_pos").filter("_asked")
    return seen.withColumns({n: ((F.col(n) - 1) / 2).cast("int") for n in marks}).select(*asked.columns, *marks)


def chain(nodes: DataFrame, keys: list[str], at: str, jump: str, first: Column) -> DataFrame:
    """The nodes (keys, at) reached from the first one of each key by following ``jump``, which only leads on.

    Pointer doubling: after r rounds a table of jumps leads 2^r nodes ahead and that many are found, so the
    rounds are the logarithm of the longest chain, whatever the length of a sheet.
    """
    step = cut(nodes.filter(F.col(jump).isNotNull()).select(*keys, at, jump))
    found = cut(nodes.filter(first).select(*keys, at))
    while True:
        new = cut(found.join(step, [*keys, at]).select(*keys, F.col(jump).alias(at)))
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        onward = step.select(*keys, F.col(at).alias(jump), F.col(jump).alias("_next"))
        step = cut(step.join(onward, [*keys, jump]).select(*keys, at, F.col("_next").alias(jump)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
