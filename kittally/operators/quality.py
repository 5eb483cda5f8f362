"""Quality rules over workbook packages, as issue rows.

entries(file_id, name, size, crc_ok, row_count, has_data) holds one row per package member;
refs(file_id, rel_name, target) the drawing references with resolved targets;
files(file_id, size) one row per package. Issues: file_id, level, severity, message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keywords as K

LEVELS = ["structural", "schema", "content", "semantic", "split-quality"]
ISSUE = ["file_id", "level", "severity", "message"]


def _issues(df: DataFrame, level: str, severity: str | Column, message: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("file_id", F.lit(level).alias("level"), severity.alias("severity"), message.alias("message"))


def is_sheet_entry(name: str = "name") -> Column:
    n = F.col(name)
    return (
        F.endswith(n, F.lit(".xml"))
        & F.contains(F.lower(n), F.lit("sheet"))
        & ~F.contains(n, F.lit("_rels"))
    )


def check_structural(files: DataFrame, entries: DataFrame, max_mb: float = 50.0) -> DataFrame:
    """Missing members, no sheet, oversize, checksum (Q1).

    One pass per file counts its required members; nothing is multiplied by the list.
    """
    seen = entries.groupBy("file_id").agg(
        F.collect_set(F.when(F.col("name").isin(K.REQUIRED_ENTRY), F.col("name"))).alias("got"),
        F.bool_or(is_sheet_entry()).alias("has_sheet"),
    )
    wanted = F.array(*[F.lit(n) for n in K.REQUIRED_ENTRY])
    none = F.array().cast("array<string>")
    state = files.join(seen, "file_id", "left")
    absent = state.select("file_id", F.explode(F.array_except(wanted, F.coalesce("got", none))).alias("n"))
    mb = F.col("size") / (1024 * 1024)
    return (
        _issues(absent, "structural", "error", F.concat(F.lit("Missing required file: "), "n"))
        .unionByName(
            _issues(
                state.filter(~F.coalesce("has_sheet", F.lit(False))),
                "structural",
                "error",
                F.lit("No sheet XML files found"),
            )
        )
        .unionByName(
            _issues(
                files.filter(mb > max_mb),
                "structural",
                "warning",
                F.format_string(f"File too large: %.1f MB > {max_mb} MB", F.bround(mb, 1)),
            )
        )
        .unionByName(
            _issues(
                entries.filter(~F.col("crc_ok")),
                "structural",
                "warning",
                F.concat(F.lit("CRC error (non-critical): "), "name"),
            )
        )
    )


def check_schema(entries: DataFrame) -> DataFrame:
    """Sheets without a data element (error) or without rows (warning) (Q2)."""
    sheets = entries.filter(is_sheet_entry())
    bad = sheets.filter(~F.col("has_data") | (F.col("row_count") == 0))
    return _issues(
        bad,
        "schema",
        F.when(~F.col("has_data"), "error").otherwise("warning"),
        F.when(~F.col("has_data"), F.concat(F.lit("No sheetData in "), "name")).otherwise(
            F.concat(F.lit("Empty sheetData (0 rows) in "), "name")
        ),
    )


def check_content(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """Empty media, and media references that lead nowhere (Q3)."""
    empty = entries.filter(F.startswith("name", F.lit("xl/media/")) & (F.col("size") == 0))
    broken = (
        refs.filter(F.contains(F.lower("target"), F.lit("media")))
        .withColumn("name", F.regexp_replace("target", "^/", ""))
        .join(entries.select("file_id", "name").distinct(), ["file_id", "name"], "left_anti")
    )
    return _issues(empty, "content", "warning", F.concat(F.lit("Empty media file: "), "name")).unionByName(
        _issues(
            broken,
            "content",
            "warning",
            F.concat(F.lit("Broken media reference in "), "rel_name", F.lit(": "), "target"),
        )
    )


def check_semantic(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """Sheets with nothing in their first 10 x 10 cells (Q4)."""
    filled = cells.filter((F.col("row") <= 10) & (F.col("col") <= 10) & F.col("value").isNotNull())
    blank = sheets.join(filled, ["file_id", "sheet_idx"], "left_anti")
    return _issues(
        blank, "semantic", "warning", F.concat(F.lit("Sheet '"), "sheet", F.lit("' contains no data"))
    )


def check_split(
    files: DataFrame,
    entries: DataFrame,
    min_rows: int = 0,
    max_rows: int = 0,
    had_images: bool = False,
    min_bytes: int = 1024,
) -> DataFrame:
    """Lost images, implausible row counts, tiny files (Q5). The first sheet entry by name counts."""
    state = files.join(
        entries.groupBy("file_id").agg(
            F.bool_or(F.startswith("name", F.lit("xl/media/"))).alias("media"),
            F.min_by("row_count", F.when(is_sheet_entry(), F.col("name"))).alias("rows"),
        ),
        "file_id",
        "left",
    )
    found = [
        _issues(
            state.filter(F.col("size") < min_bytes),
            "split-quality",
            "warning",
            F.concat(F.lit("File is very small: "), F.col("size").cast("string"), F.lit(" bytes")),
        )
    ]
    if had_images:
        found.append(
            _issues(
                state.filter(~F.coalesce("media", F.lit(False))),
                "split-quality",
                "warning",
                F.lit("No images in split file (originals had images)"),
            )
        )
    rows = F.col("rows").cast("string")
    if min_rows > 0:
        found.append(
            _issues(
                state.filter(F.col("rows") < min_rows),
                "split-quality",
                "warning",
                F.concat(F.lit("Too few rows: "), rows, F.lit(f" < {min_rows}")),
            )
        )
    if max_rows > 0:
        found.append(
            _issues(
                state.filter(F.col("rows") > max_rows * 1.5),
                "split-quality",
                "warning",
                F.concat(F.lit("Too many rows: "), rows, F.lit(f" > {max_rows * 1.5:.0f}")),
            )
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roll_up(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Validity per file; a structural error leaves out what later levels found (Q6)."""
    level = F.col("level")
    error = F.col("severity") == "error"
    counts = issues.groupBy("file_id").agg(
        F.count(F.when(error & (level == "structural"), 1)).alias("_se"),
        F.count(F.when(~error & (level == "structural"), 1)).alias("_sw"),
        F.count(F.when(error & (level != "structural"), 1)).alias("_le"),
        F.count(F.when(~error & (level != "structural"), 1)).alias("_lw"),
    )
    halted = F.col("_se") > 0
    return files.select("file_id").join(counts, "file_id", "left").fillna(0).select(
        "file_id",
        (F.col("_se") + F.when(halted, 0).otherwise(F.col("_le"))).alias("errors"),
        (F.col("_sw") + F.when(halted, 0).otherwise(F.col("_lw"))).alias("warnings"),
        ((F.col("_se") == 0) & (F.col("_le") == 0)).alias("is_valid"),
    )


def quarantine(files: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid files, and the errors of the others in long form (Q7)."""
    errors = issues.filter(F.col("severity") == "error")
    halted = errors.filter(F.col("level") == "structural").select("file_id").distinct().withColumn("_h", F.lit(True))
    shown = (
        errors.join(halted, "file_id", "left")
        .filter(F.col("_h").isNull() | (F.col("level") == "structural"))
        .select(
            "file_id",
            F.concat(F.lit("["), "level", F.lit("] "), "message").alias("error"),
        )
    )
    return files.join(errors.select("file_id"), "file_id", "left_anti"), files.join(shown, "file_id")
