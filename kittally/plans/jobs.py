"""Whole jobs: workbooks in, report tables out. Two ways in, one comparison.

By mapping: column positions come from a mapping configuration. By detection: they are found in
the sheets. Both produce BOM lines and card lines; :func:`compare` does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import text as X
from ..operators import bom as BM
from ..operators import classify as C
from ..operators import grid as G
from ..operators import mapping as M
from ..operators import reconcile as R
from ..operators import report as P
from ..operators import tables as T
from ..operators import totals as A
from ..operators.scan import SHEET, union_all
from ..session import cut

CARD_FIELDS = ["file_id", "card_no", "sheet", "row", "raw", "part_key", "name_cn", "name_ru", "qty", "ord"]


def bom_side(cells: DataFrame, sheets: DataFrame, merges: DataFrame | None = None) -> dict[str, DataFrame]:
    """Normalised parts list: quantities, parts with names, global names, configurations.

    With ``merges`` the empty cells of merged rectangles are filled first, once. A part is written as in
    its first valid row; on a sheet without configuration columns, in its first row with a quantity.
    """
    if merges is not None:
        cells = cut(G.fill_merged(cells, merges))
    lines = cut(BM.bom_lines(cells, sheets))
    rows = cut(BM.bom_rows(cells, sheets))
    names = A.part_names(rows)
    qty = cut(A.bom_quantities(lines))
    plain = A.decoded(lines.join(rows.filter("NOT matrix").select(*SHEET).distinct(), SHEET, "left_semi"))
    written = rows.filter("matrix").select("part_key", "raw", "ord").unionByName(plain.select("part_key", "raw", "ord"))
    parts = A.prune_parts(A.first_original(written), qty).withColumns({"name_cn": F.lit(""), "name_en": F.lit("")})
    return {
        "qty": qty,
        "parts": A.backfill_names(parts, names),
        "names": names,
        "configs": BM.config_names(lines, sheets),
    }


def with_fallback(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Parts lists as mapped, or, of workbooks in which the mapping finds no part with a quantity, as their headers show.

    The second try takes any sheet whose first rows name a part and a quantity column (G21).
    """
    read = A.decoded(BM.bom_lines(cells, sheets)).select("file_id").distinct()
    other = cells.join(read, "file_id", "left_anti")
    shown = G.auto_bom_sheets(other).drop("data_rows").withColumn("config_columns", F.array().cast("array<struct<col_index:int,header:string>>"))
    return sheets.join(read, "file_id", "left_semi").unionByName(shown, allowMissingColumns=True)


def with_card_fields(lines: DataFrame, card_no: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """Card lines with card number, order and translated name."""
    numbered = lines.join(card_no, "file_id").withColumn("ord", F.struct("file_id", "sheet_idx", "row"))
    if "part_no" in lines.columns:
        numbered = numbered.withColumn(
            "card_no",
            F.when(F.col("part_no").isNotNull(), F.concat("card_no", F.lit("_part"), F.col("part_no").cast("string"))).otherwise(F.col("card_no")),
        )
    if dictionary is None:
        numbered = numbered.withColumn("name_ru", F.col("name_cn"))
    else:
        numbered = A.translate(numbered, dictionary)
    return numbered.select(*CARD_FIELDS)


def card_units(cells: DataFrame) -> DataFrame:
    """Sheets as they are read: workbooks of several cards fall into one unit per sheet.

    A workbook with more than one sheet that is not a service sheet is split and its service
    sheets are left out; other workbooks stay whole. Output: sheet, unit, unit_name, split.
    """
    sheets = cells.select(*SHEET, "sheet").distinct().withColumn("_s", X.has_any(F.lower("sheet"), K.SERVICE_FILE))
    counted = sheets.groupBy("file_id").agg(F.count(F.when(~F.col("_s"), 1)).alias("_n"))
    split = F.col("_n") > 1
    name = F.concat(
        F.substring(X.safe_filename(X.stem("file_id")), 1, 50), F.lit("_"), F.substring(X.safe_filename("sheet"), 1, 50), F.lit(".xlsx")
    )
    return sheets.join(counted, "file_id").filter(~split | ~F.col("_s")).select(
        *SHEET,
        F.when(split, F.concat("file_id", F.lit("#"), F.col("sheet_idx").cast("string"))).otherwise(F.col("file_id")).alias("unit"),
        F.when(split, name).otherwise(F.col("file_id")).alias("unit_name"),
        split.alias("split"),
    )


def lines_from_materials(records: DataFrame) -> DataFrame:
    """Card lines of material records as read back from disk."""
    return records.select(
        "card_no",
        F.col("sheet_name").alias("sheet"),
        F.col("row_index").alias("row"),
        F.col("part_no").alias("raw"),
        X.part_key("part_no").alias("part_key"),
        "name_cn",
        "name_ru",
        "qty",
        "ord",
    )


def _classified(cells: DataFrame, names: DataFrame, rules: dict | DataFrame, keys: list[str]) -> DataFrame:
    """Type and format group of files or units. ``names(file_id, name)`` with the keys of the rules where these are data."""
    shown = names.join(C.content_digest(cells), "file_id", "left")
    if isinstance(rules, dict):
        return C.classify_rules(shown, rules, "name", "content").drop("content")
    return C.classify_by_rules(shown, rules, keys, "name", "content").drop("content")


def cards_by_mapping(cells: DataFrame, mapping: DataFrame, rules: dict | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """Card lines of operational files by their format's layout; detection where that fails.

    ``mapping`` is one parsed mapping row, or with a ``file_id`` column one per card file. Files are classified by the
    rules that their mapping holds, or by ``rules`` for all of them. Only operational
    files are read. Stacked formats number their cards _part1, _part2, ... where a workbook that
    is read whole holds several.
    """
    keys = ["source"] if "file_id" in mapping.columns else []
    mapping = mapping.withColumnRenamed("file_id", "source")
    judged = M.classification_rules(mapping, keys) if rules is None else rules
    named = cells.select("file_id").distinct().withColumns({"name": F.col("file_id"), "source": F.col("file_id")})
    wanted = _classified(cells, named, judged, keys).filter("file_type = 'operational_card'").select("file_id")
    units = cut(card_units(cells).join(wanted, "file_id", "left_semi"))
    read = cut(
        cells.join(units, SHEET).select(
            F.col("unit").alias("file_id"),
            F.when(F.col("split"), 0).otherwise(F.col("sheet_idx")).alias("sheet_idx"),
            *[c for c in cells.columns if c not in SHEET],
        )
    )
    whole = units.select(F.col("unit").alias("file_id"), F.col("file_id").alias("source"), F.col("unit_name").alias("name"), "split").distinct()
    typed = cut(_classified(read, whole, judged, keys))
    formats = M.card_formats(mapping, keys)
    layout = cut(
        M.resolve_format(typed.filter("file_type = 'operational_card'"), formats, keys)
        .filter("part_col > 0")
        .withColumn("end_markers", F.coalesce("end_markers", F.array().cast("array<string>")))
        .withColumn("stacked", F.coalesce((F.col("layout_type") == "multi_card") & F.col("multi_card").isNotNull(), F.lit(False)))
    )
    plain = T.extract_table(read, layout.filter("NOT stacked").select("file_id", *T.LAYOUT, "end_markers"))
    deck = layout.filter("stacked").select(
        "file_id",
        *T.LAYOUT,
        F.coalesce("multi_card.empty_rows_separator", F.lit(1)).alias("empty_rows"),
        F.coalesce("multi_card.parts_data_start_row", F.lit(0)).alias("parts_data_start"),
        F.coalesce("multi_card.parts_header_row", F.lit(0)).alias("parts_header"),
        F.coalesce("multi_card.max_cards", F.lit(0)).alias("max_cards"),
        F.coalesce("multi_card.card_end_markers", F.array().cast("array<string>")).alias("card_end_markers"),
    )
    bounds = cut(T.split_stacked(read, deck))
    parts = T.number_cards(bounds).join(typed.filter("NOT split").select("file_id"), "file_id", "left_semi").filter("parts > 1")
    stacked = T.stacked_lines(read, deck, bounds).join(parts.select(*SHEET, "card_idx", "part_no"), [*SHEET, "card_idx"], "left")
    found = cut(union_all([plain, stacked.drop("card_idx")]))
    failed = T.extraction_errors(read, layout, found).select("file_id")
    retry = typed.filter("file_type = 'unknown'").select("file_id").unionByName(failed)
    auto = G.auto_card_cols(read).join(retry, "file_id", "left_semi").withColumn("end_markers", F.array().cast("array<string>"))
    lines = union_all([found, T.extract_table(read, auto)])
    return with_card_fields(lines, typed.select("file_id", X.card_number("name").alias("card_no")), dictionary)


def cards_by_detection(cells: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Card lines of all files that are not service files, layouts found in the sheets."""
    kept = C.classify_legacy(cells.select("file_id").distinct(), path="file_id").filter("file_type <> 'service'")
    auto = G.auto_card_cols(cells).join(kept, "file_id", "left_semi").withColumn("end_markers", F.array().cast("array<string>"))
    # the first sheet that shows a number of its own, else the file name's
    shown = F.struct(F.col("card_no").eqNullSafe(X.card_number("file_id")), "sheet_idx")
    numbers = G.sheet_card_number(cells).groupBy("file_id").agg(F.min_by("card_no", shown).alias("card_no"))
    return with_card_fields(T.extract_table(cells, auto), numbers, dictionary)


def compare(
    bom: dict[str, DataFrame],
    cards: DataFrame,
    selected: DataFrame | None = None,
    errors: DataFrame | None = None,
    damaged: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Report tables of a job from its BOM side and card lines; each is worked out only when asked for.

    Counts come from the summary, which lists nothing of the size configurations times cards; only
    ``detail`` and ``format_sheet`` list discrepancies. ``errors(file, folder, error, phase)``
    are the files that could not be read, ``damaged(path)`` those that could not be split; the table ``file_errors`` has both.
    """
    qty, configs = bom["qty"], bom["configs"]
    if selected is not None:
        qty, configs = A.select_configs(qty, selected), A.select_configs(configs, selected)
    bom_qty = qty.withColumnRenamed("part_key", "part")
    totals = cut(A.card_totals(cards)).withColumnRenamed("part_key", "part")
    summary = R.summarise(bom_qty, totals, configs)
    # one row per configuration, numbered in order of first use
    numbered = configs.select("config", F.row_number().over(Window.orderBy("ord", "config")).alias("config_no"))
    words = R.config_words(numbered)
    listed, bits = R.split_outcomes(bom_qty, totals, words)
    reported = F.col("valid") & F.col("outcome").isin(R.TYPE_RANK)
    disc = listed.unionByName(R.unfold(bits, words).select(*listed.columns)).filter(reported)
    names = bom["names"].withColumnRenamed("part_key", "part")
    originals = bom["parts"].select(F.col("part_key").alias("part"), "original")
    detailed = R.with_details(disc, names, totals, originals)
    direct = R.with_details(listed.filter(reported), names, totals, originals)
    surplus = R.with_details(bits.filter("valid"), names, totals, originals, carry=("word", "lacking"))
    levels = P.levels(summary)
    return {
        "totals": P.totals_of(levels),
        "per_config": P.per_config(summary),
        "detail": P.detail(detailed, A.card_numbers(cards)),
        "format_sheet": P.format_sheet(disc),
        "bom_parts": bom["parts"],
        "bom_quantities": qty,
        "bom_matrix": P.matrix_rows(qty, bom["parts"]),
        "digest": P.digest(direct, surplus, numbered),
        "config_digest": P.config_digest(summary, numbered),
        "integrity": R.integrity(summary),
        "integrity_global": R.integrity_global(P.totals_of(levels), R.count_discrepancies(listed, bits)),
        "load_metrics": A.load_metrics(cards, errors),
    } | _file_errors(errors, damaged)


def _file_errors(errors: DataFrame | None, damaged: DataFrame | None) -> dict[str, DataFrame]:
    given = errors if errors is not None else damaged
    if given is None:
        return {}
    none = given.sparkSession.createDataFrame([], "file string, folder string, error string, phase string, path string")
    return {"file_errors": P.file_errors(none.drop("path") if errors is None else errors, none if damaged is None else damaged)}


def run_by_detection(
    bom_cells: DataFrame,
    card_cells: DataFrame,
    selected: DataFrame | None = None,
    merges: DataFrame | None = None,
    errors: DataFrame | None = None,
    damaged: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Detection job: parts lists and cards without any configuration."""
    side = bom_side(bom_cells, cut(BM.detected_sheets(bom_cells)), merges)
    return compare(side, cut(cards_by_detection(card_cells)), selected, errors, damaged)


def run_by_mapping(
    bom_cells: DataFrame,
    card_cells: DataFrame,
    mapped: DataFrame,
    rules: dict | None = None,
    dictionary: DataFrame | None = None,
    selected: DataFrame | None = None,
    merges: DataFrame | None = None,
    errors: DataFrame | None = None,
    card_mapped: DataFrame | None = None,
    damaged: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Mapping job. ``mapped(file_id, mapping)`` for the parts lists; ``rules`` stand in for those of the mappings.

    ``card_mapped(file_id, mapping)`` gives each card file its own mapping; without it all cards are read
    by the mapping of the first parts list in order of file_id.
    """
    if merges is not None:
        bom_cells = cut(G.fill_merged(bom_cells, merges))
    sheets = cut(with_fallback(bom_cells, BM.mapped_sheets(bom_cells, mapped)))
    if card_mapped is None:
        card_mapped = mapped.agg(F.min_by("mapping", "file_id").alias("mapping"))
    cards = cut(cards_by_mapping(card_cells, card_mapped, rules, dictionary))
    return compare(bom_side(bom_cells, sheets), cards, selected, errors, damaged)
