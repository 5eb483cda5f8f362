"""Exploded workbooks derived from the benchmark tables, and the same in SQL.

part-N    500 parts each: titles, header in row 3, matrix of configurations by part type
cust-N    200 customers each: Russian header in row 2
supp-N    20 suppliers each: a header without known words
ord-N     300 orders each: stacked card tables with repeated headers, titles, marks and blanks
Row numbers are positions inside a workbook, so workbooks grow in number, not in size.
"""

from __future__ import annotations

import io
import zipfile
from functools import cache
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..session import cut
from .bindings import table

TYPES = ["ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL", "STANDARD"]
PART_HEADER = ["序号", "零件号", "零件名称(中文)", "Part name(EN)", "用量", "供应商", *[f"LX {t}" for t in TYPES], "1.5T LHD"]
PART = 500_000  # cells a task unfolds
SCHEMA = ["file_id", "sheet_idx", "sheet", "row", "col", "value", "num", "kind", "strike"]


def _cell(col: int, value: Column, kind: str = "s", num: Column | None = None, strike: Column | None = None) -> Column:
    return F.struct(
        F.lit(col).alias("col"),
        value.cast("string").alias("value"),
        (F.lit(None).cast("double") if num is None else num.cast("double")).alias("num"),
        F.lit(kind).alias("kind"),
        (F.lit(False) if strike is None else F.coalesce(strike, F.lit(False))).alias("strike"),
    )


def _number(col: int, num: Column, text: Column | None = None) -> Column:
    return _cell(col, num if text is None else text, "n", num)


def _dealt(rows: DataFrame, width: int) -> DataFrame:
    """Rows of ``width`` cells dealt by workbook, so that each task unfolds about PART of them.

    A scan cannot split a row group, and one of narrow rows is a few megabytes that unfold into millions of cells.
    """
    return rows.repartition(1 + rows.count() * width // PART, "file_id")


def _unfold(df: DataFrame, cells: list[Column]) -> DataFrame:
    return (
        _dealt(df, len(cells)).select("file_id", F.lit(0).alias("sheet_idx"), "sheet", "row", F.explode(F.array(*cells)).alias("c"))
        .select("file_id", "sheet_idx", "sheet", "row", "c.col", "c.value", "c.num", "c.kind", "c.strike")
        .filter("value IS NOT NULL")
    )


def _headed(rows: DataFrame, header: dict[int, list[tuple[int, str]]]) -> DataFrame:
    """The same fixed cells on top of every workbook."""
    fixed = [(r, c, v) for r, cells in header.items() for c, v in cells]
    entries = F.array(
        *[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in fixed]
    )
    return (
        rows.select("file_id", "sheet")
        .distinct()
        .select("file_id", F.lit(0).alias("sheet_idx"), "sheet", F.explode(entries).alias("e"))
        .select(
            "file_id", "sheet_idx", "sheet", "e.row", "e.col", "e.value",
            F.lit(None).cast("double").alias("num"), F.lit("s").alias("kind"), F.lit(False).alias("strike"),
        )
    )


def _place(df: DataFrame, key: str, size: int, first: int, prefix: str, sheet: str) -> DataFrame:
    return df.withColumns(
        {
            "file_id": F.concat(F.lit(prefix), F.floor(F.col(key) / size).cast("string")),
            "row": (F.col(key) - F.floor(F.col(key) / size) * size + first).cast("int"),
            "sheet": F.lit(sheet),
        }
    )


def part_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = _place(table(spark, sf, "part"), "p_partkey", 500, 4, "part-", "总装BOM")
    size = F.col("p_size")
    marks = [
        _cell(7 + i, F.when(F.col("p_type") == t, "S").otherwise("-"), strike=(size == 49) if i == 0 else None)
        for i, t in enumerate(TYPES)
    ]
    body = _unfold(
        rows,
        [
            _number(1, F.col("p_partkey")),
            _cell(2, F.concat(F.lit("P-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("-A")), strike=size == 50),
            _cell(3, F.concat("p_name", F.lit("板"))),
            _cell(4, F.col("p_name")),
            _number(5, size),
            _cell(6, F.col("p_brand")),
            *marks,
            _number(13, F.when(size > 10, size)),
            _cell(14, F.when(size > 25, F.concat(size.cast("string"), F.lit("-"), (size + 10).cast("string")))),
            _number(17, F.round(F.col("p_retailprice") * 10).cast("long") + 0.5),
        ],
    )
    header = {
        1: [(1, "文件编号"), (3, "SSQRT1L-17-AS-00042 总装")],
        2: [(2, "作业要素"), (3, "装配工序 一号线")],
        3: [(i + 1, h) for i, h in enumerate(PART_HEADER)],
    }
    return body.unionByName(_headed(rows, header))


def customer_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = _place(table(spark, sf, "customer"), "c_custkey", 200, 3, "cust/A", "Лист1").withColumn(
        "file_id", F.concat("file_id", F.lit("01 карта.xlsx"))
    )
    body = _unfold(
        rows,
        [
            _cell(1, F.col("c_name")),
            _cell(2, F.initcap(F.lower("c_mktsegment"))),
            _number(3, F.floor("c_acctbal")),
            _cell(4, F.concat(F.lit("NATION"), F.col("c_nationkey").cast("string"))),
        ],
    )
    return body.unionByName(
        _headed(rows, {1: [(2, "Перечень")], 2: [(1, "Код детали"), (2, "Наименование"), (3, "Кол-во"), (4, "Завод")]})
    )


def supplier_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = _place(table(spark, sf, "supplier"), "s_suppkey", 20, 2, "supp-", "список деталей")
    key = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    body = _unfold(
        rows,
        [
            _cell(1, F.concat(F.lit("2024-01-"), (F.col("s_nationkey") + 1).cast("string"))),
            _cell(2, F.concat(F.lit("SU-"), key)),
            _number(3, F.floor(F.col("s_acctbal") / 100)),
            _cell(4, F.concat(F.lit("Болт крепёжный "), F.translate(key, "0123456789", "abcdefghij"))),
            _cell(5, F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("OP"), F.col("s_nationkey").cast("string")))),
        ],
    )
    return body.unionByName(_headed(rows, {1: [(1, "第一"), (2, "Ref"), (3, "第三 норма"), (4, "Text"), (6, "Qty")]}))


def order_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = _place(table(spark, sf, "orders"), "o_orderkey", 300, 1, "ord-", "Cards")
    status, rank = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    key = F.lpad(F.col("o_orderkey").cast("string"), 6, "0")
    pending = status == "P"
    kind = (
        F.when(pending, F.concat(F.lit("p"), rank))
        .when(status == "F", "part")
        .when(F.col("o_totalprice") > 100000, "blank")
        .otherwise("loose")
    )
    rows = rows.withColumn("k", kind)
    k = F.col("k")
    return _unfold(
        rows,
        [
            _cell(
                1,
                F.when(k == "p1", "零件号").when(k == "p3", F.concat(F.lit("鑫源汽车 "), key))
                .when(k == "part", F.concat(F.lit(" P-"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit("-A")))
                .when((k == "loose") & (rank == "1"), "  ").when(k == "loose", F.concat(F.lit("O"), key)),
                strike=(k == "part") & (rank == "5") & (F.col("o_totalprice") > 300000),
            ),
            _cell(
                2,
                F.when(k == "p1", "零件名称").when(k == "p2", F.concat(F.lit("焊接总成 "), key)).when(k == "p3", "签字")
                .when(k == "p5", "检验项目").when(k == "part", F.concat(F.lit("опора "), rank)),
            ),
            F.when(k == "part", _number(3, rank.cast("int"))).otherwise(
                _cell(3, F.when(k == "p1", "数量").when(k == "loose", F.concat(rank, F.lit(",5"))))
            ),
            _cell(4, F.when(k == "p5", F.concat(F.lit("检验作业 "), key)).when(k == "p2", "作业指导书")),
            F.when(k == "part", _number(5, F.col("o_custkey"))).otherwise(_number(5, F.lit(None).cast("long"))),
        ],
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return (
        part_cells(spark, sf)
        .unionByName(customer_cells(spark, sf))
        .unionByName(supplier_cells(spark, sf))
        .unionByName(order_cells(spark, sf))
    )


def stored_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cells as ingested: written once, read by every pass of an operator."""
    return cut(cells(spark, sf))


def merges(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles to the right of column 14 where it is filled."""
    rows = _place(table(spark, sf, "part"), "p_partkey", 500, 4, "part-", "总装BOM").filter("p_size > 25")
    return rows.select(
        "file_id", F.lit(0).alias("sheet_idx"), F.col("row").alias("min_row"), F.col("row").alias("max_row"),
        F.lit(14).alias("min_col"), F.lit(17).alias("max_col"),
    )


MAIN_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


@cache
def _letters(col: int) -> str:
    letters = ""
    while col:
        col, rest = divmod(col - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def _ref(row: int, col: int) -> str:
    return f"{_letters(col)}{row}"


def _sheet_data(cells: pd.DataFrame) -> str:
    """Rows of a sheet as XML, in one pass over its cells in order; a cell without a row number has no place."""
    ordered = cells.sort_values(["row", "col"])
    parts, at = [], None
    for row, col, value, kind, strike in zip(*(ordered[c].tolist() for c in ("row", "col", "value", "kind", "strike"))):
        if row is None or row != row:
            continue
        if row != at:
            parts.append(f'<row r="{row}">' if at is None else f'</row><row r="{row}">')
            at = row
        style = ' s="1"' if strike else ""
        if kind == "n":
            parts.append(f'<c r="{_ref(row, col)}"{style}><v>{value}</v></c>')
        else:
            parts.append(f'<c r="{_ref(row, col)}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>')
    return "".join(parts) + ("" if at is None else "</row>")


def package(sheets: list[tuple[str, pd.DataFrame, list[tuple[int, int, int, int]]]]) -> bytes:
    """Workbook bytes from (name, cells, merged rectangles) per sheet."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(K.REQUIRED_ENTRY[0], "<Types/>")
        book.writestr(K.REQUIRED_ENTRY[3], "<Relationships/>")
        tags = "".join(
            f'<sheet name="{escape(name)}" sheetId="{i}" r:id="r{i}"/>' for i, (name, _, _) in enumerate(sheets, 1)
        )
        book.writestr(K.REQUIRED_ENTRY[1], f'<workbook xmlns="{MAIN_NS}" xmlns:r="{REL_NS}"><sheets>{tags}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr(K.REQUIRED_ENTRY[2], f"<Relationships>{rels}</Relationships>")
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{MAIN_NS}"><fonts><font/><font><strike/></font></fonts>'
            '<cellXfs><xf fontId="0"/><xf fontId="1"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        )
        for i, (_, cells, merged) in enumerate(sheets, 1):
            merges = "".join(f'<mergeCell ref="{_ref(a, c)}:{_ref(b, d)}"/>' for a, b, c, d in merged)
            tail = f"<mergeCells>{merges}</mergeCells>" if merged else ""
            body = _sheet_data(cells)
            book.writestr(
                f"xl/worksheets/sheet{i}.xml",
                f'<worksheet xmlns="{MAIN_NS}"><sheetData>{body}</sheetData>{tail}</worksheet>',
            )
    return out.getvalue()


def _pack(file: pd.DataFrame) -> pd.DataFrame:
    name = f"{file['file_id'].iloc[0]}.xlsx"
    sheets = [(n, part, []) for (_, n), part in file.groupby(["sheet_idx", "sheet"])]
    return pd.DataFrame({"path": [name], "content": [package(sheets)]})


def packages(spark: SparkSession, sf: str) -> DataFrame:
    """The workbooks as files: (path, content). One workbook holds a fixed number of rows."""
    return cells(spark, sf).groupBy("file_id").applyInPandas(_pack, "path string, content binary")


def _sql_rows(src: str, key: str, size: int, first: int, prefix: str, sheet: str, name: str, extra: str = "") -> str:
    return (
        f"{name} AS (SELECT *, '{prefix}' || ({key} // {size})::VARCHAR || '{extra}' AS file_id, "
        f"({key} % {size} + {first})::INT AS row, '{sheet}' AS sheet FROM {src})"
    )


def _sql_cell(rows: str, col: int, value: str, kind: str = "s", num: str = "NULL", strike: str = "false") -> str:
    return (
        f"SELECT file_id, 0 AS sheet_idx, sheet, row, {col} AS col, ({value})::VARCHAR AS value, ({num})::DOUBLE AS num, "
        f"'{kind}' AS kind, coalesce({strike}, false) AS strike FROM {rows}"
    )


def _sql_head(rows: str, header: dict[int, list[tuple[int, str]]]) -> str:
    values = ", ".join(f"({r}, {c}, '{v}')" for r, cells in header.items() for c, v in cells)
    return (
        f"SELECT file_id, 0, sheet, h.row, h.col, h.value, NULL, 's', false FROM (SELECT DISTINCT file_id, sheet FROM {rows}) "
        f"CROSS JOIN (VALUES {values}) h(row, col, value)"
    )


def sql() -> str:
    """``cells`` and ``merges`` as common table expressions."""
    marks = [
        _sql_cell("pr", 7 + i, f"CASE WHEN p_type = '{t}' THEN 'S' ELSE '-' END", strike="p_size = 49" if i == 0 else "false")
        for i, t in enumerate(TYPES)
    ]
    key = "lpad(o_orderkey::VARCHAR, 6, '0')"
    rank = "substr(o_orderpriority, 1, 1)"
    skey = "lpad(s_suppkey::VARCHAR, 6, '0')"
    selects = [
        _sql_cell("pr", 1, "p_partkey", "n", "p_partkey"),
        _sql_cell("pr", 2, "'P-' || lpad(p_partkey::VARCHAR, 6, '0') || '-A'", strike="p_size = 50"),
        _sql_cell("pr", 3, "p_name || '板'"),
        _sql_cell("pr", 4, "p_name"),
        _sql_cell("pr", 5, "p_size", "n", "p_size"),
        _sql_cell("pr", 6, "p_brand"),
        *marks,
        _sql_cell("pr", 13, "CASE WHEN p_size > 10 THEN p_size END", "n", "CASE WHEN p_size > 10 THEN p_size END"),
        _sql_cell("pr", 14, "CASE WHEN p_size > 25 THEN p_size::VARCHAR || '-' || (p_size + 10)::VARCHAR END"),
        _sql_cell("pr", 17, "round(p_retailprice * 10)::BIGINT::VARCHAR || '.5'", "n", "round(p_retailprice * 10)::BIGINT + 0.5::DOUBLE"),
        _sql_head(
            "pr",
            {
                1: [(1, "文件编号"), (3, "SSQRT1L-17-AS-00042 总装")],
                2: [(2, "作业要素"), (3, "装配工序 一号线")],
                3: [(i + 1, h) for i, h in enumerate(PART_HEADER)],
            },
        ),
        _sql_cell("cr", 1, "c_name"),
        _sql_cell("cr", 2, "upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))"),
        _sql_cell("cr", 3, "floor(c_acctbal)::BIGINT", "n", "floor(c_acctbal)"),
        _sql_cell("cr", 4, "'NATION' || c_nationkey::VARCHAR"),
        _sql_head("cr", {1: [(2, "Перечень")], 2: [(1, "Код детали"), (2, "Наименование"), (3, "Кол-во"), (4, "Завод")]}),
        _sql_cell("sr", 1, "'2024-01-' || (s_nationkey + 1)::VARCHAR"),
        _sql_cell("sr", 2, f"'SU-' || {skey}"),
        _sql_cell("sr", 3, "floor(s_acctbal / 100)::BIGINT", "n", "floor(s_acctbal / 100)"),
        _sql_cell("sr", 4, f"'Болт крепёжный ' || translate({skey}, '0123456789', 'abcdefghij')"),
        _sql_cell("sr", 5, "CASE WHEN s_acctbal > 5000 THEN 'OP' || s_nationkey::VARCHAR END"),
        _sql_head("sr", {1: [(1, "第一"), (2, "Ref"), (3, "第三 норма"), (4, "Text"), (6, "Qty")]}),
        _sql_cell(
            "ok", 1,
            f"CASE WHEN k = 'p1' THEN '零件号' WHEN k = 'p3' THEN '鑫源汽车 ' || {key} WHEN k = 'part' THEN ' P-' || lpad(o_custkey::VARCHAR, 6, '0') || '-A' "
            f"WHEN k = 'loose' AND {rank} = '1' THEN '  ' WHEN k = 'loose' THEN 'O' || {key} END",
            strike=f"k = 'part' AND {rank} = '5' AND o_totalprice > 300000",
        ),
        _sql_cell(
            "ok", 2,
            f"CASE k WHEN 'p1' THEN '零件名称' WHEN 'p2' THEN '焊接总成 ' || {key} WHEN 'p3' THEN '签字' WHEN 'p5' THEN '检验项目' "
            f"WHEN 'part' THEN 'опора ' || {rank} END",
        ),
        _sql_cell("ok", 3, f"CASE k WHEN 'p1' THEN '数量' WHEN 'loose' THEN {rank} || ',5' END"),
        _sql_cell("ok", 3, f"CASE k WHEN 'part' THEN {rank} END", "n", f"CASE k WHEN 'part' THEN {rank}::INT END"),
        _sql_cell("ok", 4, f"CASE k WHEN 'p5' THEN '检验作业 ' || {key} WHEN 'p2' THEN '作业指导书' END"),
        _sql_cell("ok", 5, "CASE WHEN k = 'part' THEN o_custkey END", "n", "CASE WHEN k = 'part' THEN o_custkey END"),
    ]
    kind = (
        f"CASE WHEN o_orderstatus = 'P' THEN 'p' || {rank} WHEN o_orderstatus = 'F' THEN 'part' "
        "WHEN o_totalprice > 100000 THEN 'blank' ELSE 'loose' END AS k"
    )
    return ",\n".join(
        [
            _sql_rows("part", "p_partkey", 500, 4, "part-", "总装BOM", "pr"),
            _sql_rows("customer", "c_custkey", 200, 3, "cust/A", "Лист1", "cr", "01 карта.xlsx"),
            _sql_rows("supplier", "s_suppkey", 20, 2, "supp-", "список деталей", "sr"),
            _sql_rows("orders", "o_orderkey", 300, 1, "ord-", "Cards", "orow"),
            f"ok AS (SELECT *, {kind} FROM orow)",
            "cells AS (SELECT * FROM (" + " UNION ALL ".join(selects) + ") WHERE value IS NOT NULL)",
            "merges AS (SELECT file_id, 0 AS sheet_idx, row AS min_row, row AS max_row, 14 AS min_col, 17 AS max_col FROM pr WHERE p_size > 25)",
            "extent AS (SELECT file_id, sheet_idx, sheet, max(row) AS max_row, max(col) AS max_col FROM cells GROUP BY ALL)",
        ]
    )
