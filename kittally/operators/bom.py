"""Configuration matrices read from exploded parts-list sheets.

``sheets`` has one row per parts list: file_id, sheet_idx, sheet, header_row, data_start,
part_col, name_cn_col, name_en_col, qty_col (0 where missing) and config_columns, an array of
(col_index, header). It comes from a mapping or from detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .grid import bom_candidates, detect_configs, detect_roles, pick_headers, score_headers, truthy
from .mapping import bom_sheet_configs
from .scan import SHEET
from .totals import config_key, config_order, valid_bom_rows

LAYOUT = ["part_col", "name_cn_col", "name_en_col", "qty_col"]


def mapped_sheets(cells: DataFrame, mapped: DataFrame) -> DataFrame:
    """Parts lists named by a mapping, found in the workbooks by sheet name.

    ``mapped(file_id, mapping)`` gives each workbook its mapping.
    """
    present = cells.select(*SHEET, "sheet").distinct()
    return present.join(bom_sheet_configs(mapped, ["file_id"]), ["file_id", "sheet"])


def detected_sheets(cells: DataFrame, min_configs: int = 2) -> DataFrame:
    """Parts lists found by their headers and contents."""
    headers = pick_headers(score_headers(cells))
    configs = (
        detect_configs(cells, headers, detect_roles(cells, headers))
        .groupBy(*SHEET)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("col").alias("col_index"), F.lit(None).cast("string").alias("header")))).alias("config_columns"))
    )
    found = bom_candidates(cells, min_configs)
    zero = F.lit(0)
    return found.drop("configs").join(configs, SHEET, "left").select(
        *SHEET,
        "sheet",
        "header_row",
        "data_start",
        F.coalesce("part_no", zero).alias("part_col"),
        F.coalesce("name_cn", zero).alias("name_cn_col"),
        F.coalesce("name_en", zero).alias("name_en_col"),
        F.coalesce("qty", zero).alias("qty_col"),
        F.coalesce("config_columns", F.array().cast("array<struct<col_index:int,header:string>>")).alias("config_columns"),
    )


def bom_rows(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Valid part rows of all parts lists, with names and the quantity cell (F1, F2).

    One pass picks the layout cells of each row; struck part or quantity cells drop the row.
    """
    at = sheets.select(*SHEET, "data_start", *LAYOUT, (F.size("config_columns") > 0).alias("matrix"))
    cell = F.struct("value", "strike")

    def pick(which: str) -> Column:
        return F.max(F.when(F.col("col") == F.col(which), cell))

    rows = (
        cells.join(at.filter("part_col > 0"), SHEET)
        .filter((F.col("row") >= F.col("data_start")) & F.col("col").isin(*[F.col(c) for c in LAYOUT]))
        .groupBy(*SHEET, "sheet", "row", "matrix", (F.col("qty_col") > 0).alias("has_qty"))
        .agg(*[pick(c).alias(c) for c in LAYOUT])
    )
    struck = F.coalesce("part_col.strike", F.lit(False)) | F.coalesce("qty_col.strike", F.lit(False))
    return valid_bom_rows(
        rows.filter(F.col("part_col").isNotNull() & ~struck).select(
            *SHEET,
            "sheet",
            "row",
            "matrix",
            "has_qty",
            F.col("part_col.value").alias("raw"),
            F.col("name_cn_col.value").alias("name_cn"),
            F.col("name_en_col.value").alias("name_en"),
            F.col("qty_col.value").alias("qty_cell"),
            F.struct("file_id", "sheet_idx", "row", F.lit(0).alias("col")).alias("ord"),
        )
    )


def config_columns(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Configuration columns with their names: given, else the header cell, else Config_n."""
    named = sheets.select(*SHEET, F.col("header_row").alias("row"), F.explode("config_columns").alias("c")).select(
        *SHEET, "row", F.col("c.col_index").alias("col"), F.col("c.header").alias("header")
    ).filter("col > 0")
    shown = cells.select(*SHEET, "row", "col", F.col("value").alias("_v"))
    name = F.coalesce(F.nullif("header", F.lit("")), "_v", F.lit(""))
    name = X.strip(F.regexp_replace(F.translate(name, "\n", " "), "\r", ""))
    return named.join(shown, [*SHEET, "row", "col"], "left").select(
        *SHEET,
        "col",
        F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Config_"), F.col("col").cast("string"))).alias("config"),
    )


def bom_lines(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """BOM lines: each configuration cell of each valid row, or the row's own quantity (A1, A2)."""
    rows = bom_rows(cells, sheets)
    base = [*SHEET, "sheet", "raw", "part_key", "name_cn", "name_en", "qty_cell", "has_qty"]
    marks = (
        cells.filter(~F.col("strike") & truthy())
        .join(config_columns(cells, sheets), [*SHEET, "col"])
        .select(*SHEET, "row", F.col("col").alias("_c"), "config", F.col("value").alias("marker"))
    )
    matrix = rows.filter("matrix").join(marks, [*SHEET, "row"]).select(
        *base,
        "config",
        "marker",
        F.struct("file_id", "sheet_idx", "row", F.col("_c").alias("col")).alias("ord"),
    )
    single = rows.filter("NOT matrix AND has_qty").select(
        *base,
        config_key("sheet", F.lit(False), F.lit(None)).alias("config"),
        F.lit("S").alias("marker"),
        "ord",
    )
    return matrix.unionByName(single)


def config_names(lines: DataFrame, sheets: DataFrame) -> DataFrame:
    """All configurations in order of first use; a plain sheet counts even when empty."""
    plain = sheets.filter((F.size("config_columns") == 0) & (F.col("qty_col") > 0) & (F.col("part_col") > 0)).select(
        config_key("sheet", F.lit(False), F.lit(None)).alias("config"),
        F.struct("file_id", "sheet_idx", F.lit(0).alias("row"), F.lit(0).alias("col")).alias("ord"),
    )
    return config_order(lines).unionByName(plain).groupBy("config").agg(F.min("ord").alias("ord"))
