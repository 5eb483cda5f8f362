"""Quantity totals on both sides: configuration matrices and operational cards.

BOM lines:  file_id, sheet_idx, sheet, ord, raw, part_key, name_cn, name_en, config, marker,
            qty_cell, has_qty
Card lines: card_no, sheet, ord, raw, part_key, name_ru, qty
``ord`` is any sortable value giving sheet order then row order; first and last refer to it.
Lists per part are kept in long form with their order value, so that a part used by a third
of all cards never becomes one array in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import text as X


def valid_bom_rows(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows with a usable part cell, judged on the text as written (F2)."""
    cleaned = X.clean_cell(raw)
    return (
        rows.withColumn(raw, cleaned)
        .filter((F.col(raw) != "") & ~F.startswith(F.col(raw), F.lit("~$")) & X.is_part(raw))
        .withColumn("part_key", X.part_key(raw))
    )


def valid_card_rows(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows with a usable part cell, judged on the cleaned key (F2, card rule)."""
    return (
        rows.withColumn(raw, X.strip(raw))
        .withColumn("part_key", X.part_key(raw))
        .filter((F.col(raw) != "") & X.is_part("part_key"))
    )


def positive_qty(rows: DataFrame, qty: str = "qty") -> DataFrame:
    return rows.filter(F.col(qty) > 0)


def clamp_qty(rows: DataFrame, qty: str = "qty") -> DataFrame:
    return rows.withColumn(qty, F.greatest(F.col(qty), F.lit(0.0)))


def drop_struck(rows: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a struck-through cell in any of the named column-index columns (F1).

    ``rows`` carries file_id, sheet_idx, row and the column indexes to look at.
    """
    struck = cells.filter("strike").select("file_id", "sheet_idx", "row", F.col("col").alias("_c"))
    for name in columns:
        rows = rows.join(
            struck.withColumnRenamed("_c", name), ["file_id", "sheet_idx", "row", name], "left_anti"
        )
    return rows


def config_key(sheet: Column | str, has_columns: Column, header: Column | str) -> Column:
    """Configuration a cell belongs to: its header, else its sheet, pooled for sub-lists (A2)."""
    sheet = F.col(sheet) if isinstance(sheet, str) else sheet
    header = F.col(header) if isinstance(header, str) else header
    return (
        F.when(has_columns, header)
        .when(X.has_any(F.lower(sheet), K.POOLED_SHEET), F.lit(K.POOLED_CONFIG))
        .otherwise(sheet)
    )


def decoded(lines: DataFrame) -> DataFrame:
    """Lines with a positive quantity in ``qty``."""
    qty = X.decode_config_cell("marker", "qty_cell", F.col("has_qty"))
    return positive_qty(lines.withColumn("qty", qty))


def bom_quantities(lines: DataFrame) -> DataFrame:
    """Quantity of each part in each configuration, over rows and sheets (A1)."""
    return decoded(lines).groupBy("config", "part_key").agg(F.sum("qty").alias("qty"))


def sheet_configs(lines: DataFrame) -> DataFrame:
    """Same total for sheets with a quantity column only; the sheet names the config (A2)."""
    qty = X.quantity("qty_cell")
    keyed = lines.withColumns(
        {"config": config_key("sheet", F.lit(False), F.lit(None)), "qty": qty}
    )
    return positive_qty(keyed).groupBy("config", "part_key").agg(F.sum("qty").alias("qty"))


def first_original(lines: DataFrame) -> DataFrame:
    """Part number as first written (A3)."""
    return lines.groupBy("part_key").agg(F.min_by("raw", "ord").alias("original"))


def part_names(lines: DataFrame) -> DataFrame:
    """First non-empty name per language, independently (A4)."""

    def first(name: str) -> Column:
        text = X.clean_cell(name)
        return F.coalesce(
            F.min_by(text, F.when(text != "", F.col("ord"))), F.lit("")
        ).alias(name)

    return lines.groupBy("part_key").agg(first("name_cn"), first("name_en"))


def applicable(lines: DataFrame) -> DataFrame:
    """Configurations using each part, with the place of first use (A5)."""
    return decoded(lines).groupBy("part_key", "config").agg(F.min("ord").alias("ord"))


def config_order(lines: DataFrame) -> DataFrame:
    """Configurations and where each first shows a positive quantity."""
    return decoded(lines).groupBy("config").agg(F.min("ord").alias("ord"))


def prune_parts(parts: DataFrame, bom_qty: DataFrame) -> DataFrame:
    """Parts with a positive quantity somewhere."""
    used = bom_qty.filter("qty > 0").select("part_key")
    return parts.join(used, "part_key", "left_semi")


def backfill_names(parts: DataFrame, names: DataFrame) -> DataFrame:
    """Global names for parts that have neither name."""
    g = names.select("part_key", F.col("name_cn").alias("_cn"), F.col("name_en").alias("_en"))
    bare = (F.coalesce("name_cn", F.lit("")) == "") & (F.coalesce("name_en", F.lit("")) == "")
    return (
        parts.join(g, "part_key", "left")
        .withColumns(
            {
                "name_cn": F.coalesce(F.when(bare, F.col("_cn")).otherwise(F.col("name_cn")), F.lit("")),
                "name_en": F.coalesce(F.when(bare, F.col("_en")).otherwise(F.col("name_en")), F.lit("")),
            }
        )
        .drop("_cn", "_en")
    )


def card_part_totals(lines: DataFrame) -> DataFrame:
    """Quantity of each part on each card."""
    return lines.groupBy("card_no", "part_key").agg(F.sum("qty").alias("qty"))


def card_totals(lines: DataFrame) -> DataFrame:
    """Quantity of each part over all cards (A10), with first original and last name."""
    return lines.groupBy("part_key").agg(
        F.sum("qty").alias("qty"),
        F.min_by("raw", "ord").alias("original"),
        F.coalesce(
            F.max_by("name_ru", F.when(F.col("name_ru") != "", F.col("ord"))), F.lit("")
        ).alias("name_ru"),
    )


def last_name_ru(lines: DataFrame) -> DataFrame:
    return card_totals(lines).select("part_key", "name_ru")


def part_sources(lines: DataFrame) -> DataFrame:
    """Where each part is used: one row per line."""
    return lines.select("part_key", "ord", "card_no", "sheet", "qty")


def card_numbers(lines: DataFrame) -> DataFrame:
    """Distinct cards per part with the place of first use."""
    return lines.groupBy("part_key", "card_no").agg(F.min("ord").alias("ord"))


def load_metrics(lines: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Counts of a load: cards, sheets, lines, parts and failed files."""
    got = lines.agg(
        F.count_distinct("card_no").alias("cards"),
        F.count_distinct("card_no", "sheet").alias("sheets"),
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("part_key").alias("unique_parts"),
    )
    if errors is None:
        return got.withColumn("failed", F.lit(0).cast("long"))
    failed = errors.agg(F.count(F.lit(1)).alias("failed"))
    return got.withColumn("failed", failed.select("failed").scalar())


def translate(rows: DataFrame, dictionary: DataFrame, text: str = "name_cn", out: str = "name_ru") -> DataFrame:
    """Dictionary lookup of each text, falling back to the text itself.

    ``dictionary(source, target)`` is reduced to one target per source before the join.
    """
    lookup = dictionary.groupBy(F.col("source").alias(text)).agg(F.min("target").alias("_target"))
    return (
        rows.join(lookup, text, "left")
        .withColumn(out, F.coalesce(F.col("_target"), F.col(text)))
        .drop("_target")
    )


def select_configs(bom_qty: DataFrame, selected: DataFrame) -> DataFrame:
    """Only the chosen configurations; an empty choice keeps all."""
    none_chosen = selected.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") == 0).alias("e")).scalar()
    chosen = selected.select("config").distinct().withColumn("_chosen", F.lit(True))
    return (
        bom_qty.join(chosen, "config", "left")
        .filter(F.col("_chosen") | none_chosen)
        .drop("_chosen")
    )
