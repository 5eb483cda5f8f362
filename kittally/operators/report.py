"""Report tables over discrepancies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import text as X
from .reconcile import TYPE_RANK, WORD, type_rank


def levels(summary: DataFrame) -> DataFrame:
    """Discrepancy counts at every level in one pass over the summary: (config, outcome, n, level).

    ``level`` is 0 for a configuration and type, 1 for a configuration, 2 for a type, 3 for all. The summary counts
    surplus parts without listing them, so nothing of the size configurations times cards is made.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("outcome"), F.col(k).alias("n")) for k in TYPE_RANK])).alias("p")
    cells = summary.select("config", pairs).select("config", "p.outcome", "p.n")
    config, outcome = F.col("config"), F.col("outcome")
    sets = cells.groupingSets([[config, outcome], [config], [outcome], []], config, outcome)
    return sets.agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("level"))


def totals_of(levels: DataFrame) -> DataFrame:
    """Number of discrepancies by type (P1), types without any left out."""
    return levels.filter("level = 2 AND n > 0").select("outcome", "n")


def matrix_rows(bom_qty: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts by configurations in long form (P5): number as written, names, short label, quantity."""
    return bom_qty.filter("qty > 0").join(parts, "part_key").select(
        "part_key", "original", "name_cn", "name_en", "config", X.short_label("config", 25).alias("config_label"), "qty"
    )


def per_config(summary: DataFrame) -> DataFrame:
    """Summary table, one row per configuration."""
    return summary.select(
        X.short_label("config", 52).alias("config_label"),
        "config",
        "total_bom_parts",
        "total_cards_parts",
        "matched",
        "discrepancies",
        "only_in_bom",
        "only_in_cards",
        "qty_mismatch",
    )


def first_cards(card_numbers: DataFrame, k: int = 5, part: str = "part_key") -> DataFrame:
    """First ``k`` cards of each part joined by comma.

    The rank filter is pushed below the shuffle as a group limit, so a part on millions of
    cards sends only ``k`` rows per task.
    """
    w = Window.partitionBy(part).orderBy("ord", "card_no")
    return (
        card_numbers.withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= k)
        .groupBy(part)
        .agg(F.array_sort(F.collect_list(F.struct("_n", "card_no"))).alias("_c"))
        .select(part, F.array_join(F.transform("_c", lambda c: c["card_no"]), ", ").alias("card_list"))
    )


def _label(c: str = "outcome"):
    mapping = F.create_map(*[F.lit(v) for kv in K.DISCREPANCY_LABEL.items() for v in kv])
    return mapping[F.col(c)]


def detail(disc: DataFrame, card_numbers: DataFrame) -> DataFrame:
    """Discrepancy sheet (P3): Russian name else English, a short label beside the configuration, first five cards."""
    cards = first_cards(card_numbers, 5, "part_key").withColumnRenamed("part_key", "card_part")
    return disc.join(cards, "card_part", "left").select(
        "part_number",
        "name_cn",
        F.coalesce(F.nullif("name_ru", F.lit("")), "name_en").alias("name_ru"),
        "config",
        F.substring("config", 1, 70).alias("config_label"),
        "qty_bom",
        "qty_cards",
        F.coalesce("card_list", F.lit("")).alias("card_list"),
        _label().alias("kind"),
    )


def format_sheet(disc: DataFrame) -> DataFrame:
    """Format mismatches with both spellings."""
    return disc.filter(F.col("outcome") == "fuzzy_match").select(
        "card_part", "bom_part", "qty_bom", "qty_cards", "config", F.substring("config", 1, 70).alias("config_label")
    )


def bom_matrix(bom_qty: DataFrame, names: DataFrame, configs: list[str]) -> DataFrame:
    """Parts by configurations, null where absent (P5). The columns are the caller's list."""
    wide = (
        bom_qty.filter("qty > 0")
        .groupBy("part_key")
        .pivot("config", configs)
        .agg(F.sum("qty"))
    )
    return names.join(wide, "part_key", "right")


def file_errors(detailed: DataFrame, legacy: DataFrame) -> DataFrame:
    """Detailed errors, then listed paths whose name is not among them."""
    named = detailed.select(
        F.coalesce("file", F.lit("")).alias("file"), "folder", "error", "phase"
    )
    split = legacy.select(
        X.basename("path").alias("file"),
        F.regexp_replace("path", r"(?s)/?[^/]*\z", "").alias("folder"),
        F.lit("").alias("error"),
        F.lit("split").alias("phase"),
    )
    return named.unionByName(split.join(named.select("file").distinct(), "file", "left_anti"))


def digest(disc: DataFrame, surplus: DataFrame, configs: DataFrame, k: int = 30) -> DataFrame:
    """First ``k`` parts per type with first-seen quantities and config numbers.

    ``disc`` lists BOM parts with their details; ``surplus`` has card parts with bits of the configurations that lack
    them (``reconcile.split_outcomes``), dealt by the order of ``configs(config, config_no)``, numbered from 1 without
    gaps. Surplus is counted by its bits; numbers are listed once a part is among the first ``k``.
    """
    listed = disc.filter(F.col("outcome").isin(TYPE_RANK[:2])).join(configs, "config")
    number = F.col("word") * WORD
    low = F.bit_count(F.expr("(lacking & -lacking) - 1L"))
    seen = listed.select("outcome", "part_number", "bom_part", "card_part", "qty_bom", "qty_cards", F.col("config_no").cast("long").alias("at"), F.lit(1).cast("long").alias("n"))
    bits = surplus.select(
        "outcome", "part_number", "bom_part", "card_part", "qty_bom", "qty_cards", (number + low + 1).cast("long").alias("at"), F.bit_count("lacking").cast("long").alias("n")
    )
    # part_number as last tie-break keeps the choice fixed when one number has two spellings
    first = seen.unionByName(bits).groupBy("outcome", "part_number").agg(
        F.min_by(F.struct("qty_bom", "qty_cards"), F.struct("at", "bom_part", "card_part")).alias("q"), F.sum("n").alias("n_entries")
    )
    sizes = first.groupBy("outcome").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_entries").alias("entries"))
    w = Window.partitionBy("outcome").orderBy("part_number")
    top = first.drop("n_entries").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    chosen = top.select("outcome", "part_number")
    unfolded = F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), i -> (shiftright(lacking, i) & 1L) = 1L)"))
    numbers = (
        listed.join(chosen, ["outcome", "part_number"], "left_semi")
        .select("outcome", "part_number", F.col("config_no").cast("int").alias("config_no"))
        .unionByName(
            surplus.join(chosen, ["outcome", "part_number"], "left_semi")
            .select("outcome", "part_number", "word", unfolded.alias("_bit"))
            .select("outcome", "part_number", (number + F.col("_bit") + 1).cast("int").alias("config_no"))
        )
        .groupBy("outcome", "part_number")
        .agg(F.array_join(F.array_sort(F.collect_set("config_no")), ",").alias("config_nos"))
    )
    return (
        top.join(numbers, ["outcome", "part_number"])
        .join(sizes, "outcome")
        .select(
            "outcome",
            "n",
            "part_number",
            F.col("q.qty_bom").alias("qty_bom"),
            F.col("q.qty_cards").alias("qty_cards"),
            "config_nos",
            "entries",
            F.greatest(F.col("parts") - k, F.lit(0)).alias("more"),
        )
    )


def config_digest(summary: DataFrame, configs: DataFrame) -> DataFrame:
    """Compact numbered list of configurations."""
    return summary.join(configs, "config").select(
        "config_no", "matched", "discrepancies", X.short_label("config", 53).alias("config_label")
    )


def single_config_digest(disc: DataFrame, config: str) -> DataFrame:
    """Lines of one configuration's digest, in report order."""
    return (
        disc.filter((F.col("config") == config) & F.col("outcome").isin(TYPE_RANK[:3]))
        .select("outcome", type_rank().alias("rank"), "part_number", "qty_bom", "qty_cards")
    )
