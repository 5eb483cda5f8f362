"""Typed view of mapping configurations held as JSON text.

Column positions may be flat (``"qty": 5``) or nested (``"qty": {"col_index": 5}``), so column
maps are read as text values and resolved afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SHEET_SCHEMA = (
    "struct<sheet_name:string,sheet_type:string,header_rows:array<int>,data_start_row:int,"
    "columns:map<string,string>,layout:struct<type:string,blocks:array<map<string,string>>>>"
)
MULTI_CARD = (
    "struct<empty_rows_separator:int,parts_data_start_row:int,parts_header_row:int,"
    "card_end_markers:array<string>,max_cards:int>"
)
BOUNDARIES = (
    f"struct<type:string,header_rows:array<int>,header_row:int,data_start_row:int,"
    f"end_markers:array<string>,multi_card:{MULTI_CARD}>"
)
CARD_SHEET = (
    f"struct<columns:map<string,string>,table_boundaries:{BOUNDARIES},"
    "header_rows:array<int>,data_start_row:int>"
)
MAPPING_SCHEMA = (
    f"struct<bom:struct<sheets:array<{SHEET_SCHEMA}>>,"
    f"cards:struct<formats:map<string,struct<sheets:array<{CARD_SHEET}>,end_markers:array<string>>>,"
    f"table_boundaries:{BOUNDARIES},columns:map<string,string>,"
    "file_classification_rules:string>>"
)


RULE = "struct<type:string,pattern:string,keywords:array<string>,format_group:string>"
RULES_SCHEMA = (
    f"struct<service_file_patterns:array<{RULE}>,operational_card_patterns:array<{RULE}>,"
    "service_keywords:array<string>,operational_keywords:array<string>>"
)


def classification_rules(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """The file classification rules of each mapping as one struct, null where it has none.

    A mapping's rules are few; they stay together in their order, as a first match is looked for in them.
    """
    return mapped.select(*keys, F.from_json("mapping.cards.file_classification_rules", RULES_SCHEMA).alias("rules"))


def column_index(value: Column) -> Column:
    """Position from a flat or nested column entry, 0 if there is none."""
    nested = F.get_json_object(value, "$.col_index")
    return F.coalesce(nested.try_cast("int"), value.try_cast("int"), F.lit(0))


def read_mapping(df: DataFrame, column: str = "mapping_config") -> DataFrame:
    """Rows with the parsed ``mapping`` struct beside their other columns."""
    return df.withColumn("mapping", F.from_json(column, MAPPING_SCHEMA)).drop(column)


def _position(columns: Column, name: str) -> Column:
    return column_index(F.try_element_at(columns, F.lit(name)))


def _name_position(columns: Column) -> Column:
    """``name``, for which ``name_cn`` stands in."""
    keys = F.map_keys(columns)
    return F.when(F.array_contains(keys, "name"), _position(columns, "name")).otherwise(
        _position(columns, "name_cn")
    )


def bom_sheet_configs(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """One row per BOM sheet with a part column (F5), positions resolved."""
    cols = F.col("s.columns")
    header = F.coalesce(F.try_element_at("s.header_rows", F.lit(1)), F.lit(1))
    return (
        mapped.select(*keys, F.explode("mapping.bom.sheets").alias("s"))
        .select(
            *keys,
            F.col("s.sheet_name").alias("sheet"),
            header.alias("header_row"),
            F.coalesce("s.data_start_row", header + 1).alias("data_start"),
            _position(cols, "part_no").alias("part_col"),
            _position(cols, "name_cn").alias("name_cn_col"),
            _position(cols, "name_en").alias("name_en_col"),
            _position(cols, "qty").alias("qty_col"),
            F.from_json(
                F.coalesce(F.try_element_at(cols, F.lit("config_columns")), F.lit("[]")),
                "array<struct<col_index:int,header:string>>",
            ).alias("config_columns"),
            F.col("s.layout.type").alias("layout_type"),
            F.col("s.sheet_type").alias("sheet_type"),
        )
        .filter((F.col("sheet_type") == "bom_data") & (F.col("part_col") > 0))
        .drop("sheet_type")
    )


def card_formats(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """One row per card format; the flat configuration has a null format_group."""

    def resolved(df: DataFrame, group: Column, tb: Column, columns: Column, sheet: Column | None, fmt_end: Column | None) -> DataFrame:
        rows = F.coalesce(tb["header_rows"], sheet["header_rows"]) if sheet is not None else tb["header_rows"]
        header = F.coalesce(F.try_element_at(rows, F.lit(1)), tb["header_row"], F.lit(1))
        start = F.coalesce(tb["data_start_row"], sheet["data_start_row"]) if sheet is not None else tb["data_start_row"]
        ends = tb["end_markers"]
        if fmt_end is not None:
            ends = F.when(F.size(F.coalesce(ends, F.array().cast("array<string>"))) > 0, ends).otherwise(fmt_end)
        return df.select(
            *keys,
            group.alias("format_group"),
            _position(columns, "part_no").alias("part_col"),
            _position(columns, "qty").alias("qty_col"),
            _name_position(columns).alias("name_col"),
            header.alias("header_row"),
            F.coalesce(start, header + 1).alias("data_start"),
            F.coalesce(ends, F.array().cast("array<string>")).alias("end_markers"),
            tb["type"].alias("layout_type"),
            tb["multi_card"].alias("multi_card"),
        )

    named = (
        mapped.select(*keys, F.explode("mapping.cards.formats").alias("g", "f"))
        .withColumn("s", F.try_element_at("f.sheets", F.lit(1)))
        .filter(F.col("s").isNotNull())
    )
    flat = mapped.filter(F.col("mapping.cards.formats").isNull() & F.col("mapping.cards").isNotNull())
    return resolved(
        named, F.col("g"), F.col("s.table_boundaries"), F.col("s.columns"), F.col("s"), F.col("f.end_markers")
    ).unionByName(
        resolved(
            flat,
            F.lit(None).cast("string"),
            F.col("mapping.cards.table_boundaries"),
            F.coalesce(
                F.col("mapping.cards.columns"), F.create_map().cast("map<string,string>")
            ),
            None,
            None,
        )
    )


def resolve_format(files: DataFrame, formats: DataFrame, keys: list[str]) -> DataFrame:
    """Each file with its format's layout; the flat one serves files without a match."""
    own = formats.filter(F.col("format_group").isNotNull())
    flat = formats.filter(F.col("format_group").isNull()).drop("format_group")
    fields = [c for c in formats.columns if c not in (*keys, "format_group")]
    joined = files.join(own, [*keys, "format_group"], "left")
    if not keys:
        one = flat.agg(F.first(F.struct(*fields)).alias("f")).scalar()  # a mapping has at most one flat format
        joined = joined.withColumn("_flat", one).select("*", *[F.col("_flat")[c].alias(f"_f_{c}") for c in fields]).drop("_flat")
    else:
        keys_flat = flat.select(*keys, *[F.col(c).alias(f"_f_{c}") for c in fields])
        joined = joined.join(keys_flat, keys, "left")
    return joined.withColumns({c: F.coalesce(c, f"_f_{c}") for c in fields}).drop(*[f"_f_{c}" for c in fields])


def selected_configs(jobs: DataFrame, column: str = "selected_config") -> DataFrame:
    """One row per chosen configuration: JSON array, or one name as written."""
    value = F.col(column)
    chosen = F.when(
        F.startswith(value, F.lit("[")), F.from_json(value, "array<string>")
    ).otherwise(F.array(value))
    others = [c for c in jobs.columns if c != column]
    return jobs.filter(value.isNotNull() & (value != "")).select(*others, F.explode(chosen).alias("config"))
