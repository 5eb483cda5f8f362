import random

from conftest import grid
from pyspark.sql import functions as F

from kittally.operators import bom as BM
from kittally.operators import grid as G
from kittally.operators import totals as A

WIDE_HEADER = {
    1: "修订", 2: "序号\nSerial NO.", 3: "CPAC编码\nCPAC Code", 4: "标识", 5: "发运", 6: "采购", 7: "零件号\nPartNo.",
    8: "零件名称(中文）\nPart Name(CN)", 9: "零件名称(英文）\nPart Name(EN)", 10: "用量\nQty", 11: "度量单位\nUOM", 17: "层级\nLevel", 28: "整车物料号",
}


def wide_sheet():
    """Seventy-eight configurations: 24 with numbers, three empty columns, 54 with marks."""
    cells = {(3, c): v for c, v in WIDE_HEADER.items()}
    cells |= {(3, 29 + i): f"UB版内饰C{i + 1:02d}座CKDUBCKD" for i in range(24)}
    cells |= {(3, 56 + i): f"S版舒适型{i + 1:02d}航空银内饰KM两驱1180" for i in range(54)}
    for row in range(4, 54):
        n = row - 3
        cells |= {(row, 1): n, (row, 7): f"P{n:08d}", (row, 8): f"Деталь {n} CN", (row, 9): f"Part {n} EN", (row, 10): 1 + n % 5, (row, 11): "EA"}
        cells |= {(row, 29 + i): (n + i) % 6 for i in range(24) if (n + i) % 6}
        cells |= {(row, 56 + i): "S" if (n + i) % 3 == 0 else "-" for i in range(54) if (n + i) % 3 < 2}
    return cells


def test_wide_matrix(make_cells):
    cells = make_cells({("wide.xlsx", "BOM"): wide_sheet()}).cache()
    headers = G.pick_headers(G.score_headers(cells))
    assert headers.filter("pos = 1").first().row == 3
    roles = G.detect_roles(cells, headers)
    assert tuple(roles.first())[2:] == (7, 8, 9, 10)
    configs = G.detect_configs(cells, headers, roles).collect()
    assert sorted(c.col for c in configs) == [*range(29, 53), *range(56, 110)]
    assert {c.zone for c in configs if c.col < 53} == {"numeric"}
    sheets = BM.detected_sheets(cells)
    lines = BM.bom_lines(cells, sheets)
    qty = A.bom_quantities(lines)
    assert qty.select("config").distinct().count() == 78
    want = sum((n + i) % 6 for n in range(1, 51) for i in range(24)) + sum(
        1 + n % 5 for n in range(1, 51) for i in range(54) if (n + i) % 3 == 0
    )
    assert qty.agg(F.sum("qty")).first()[0] == want


def test_quantity_only_and_pooled_sheets(make_cells, spark):
    rows = [["零件号", "零件名称", "English Name", "数量"], ["P001", "板", "plate", 10], ["P002", "栓", "bolt", 20], ["P003", None, None, "–"]]
    struck = {**grid(rows), (2, 1): ("P001", "strike")}
    cells = make_cells(
        {("a.xlsx", "BOM"): grid(rows), ("a.xlsx", "总装BOM"): grid(rows), ("a.xlsx", "焊装BOM list"): struck}
    )
    sheets = cells.select("file_id", "sheet_idx", "sheet").distinct().withColumns(
        {"header_row": F.lit(1), "data_start": F.lit(2), "part_col": F.lit(1), "name_cn_col": F.lit(2), "name_en_col": F.lit(3), "qty_col": F.lit(4),
         "config_columns": F.array().cast("array<struct<col_index:int,header:string>>")}
    )
    lines = BM.bom_lines(cells, sheets)
    got = {tuple(r) for r in A.bom_quantities(lines).collect()}
    assert got == {("BOM", "P001", 10.0), ("BOM", "P002", 20.0), ("MULTI_SHEET_COMBINED", "P001", 10.0), ("MULTI_SHEET_COMBINED", "P002", 40.0)}
    assert {r.part_key for r in BM.bom_rows(cells, sheets).collect()} == {"P001", "P002", "P003"}
    assert [r.config for r in BM.config_names(lines, sheets).orderBy("ord").collect()] == ["BOM", "MULTI_SHEET_COMBINED"]


def test_merged_cells_and_snapshot(make_cells, spark):
    cells = make_cells({("m.xlsx", "S"): {(1, 1): "top", (2, 2): "own", (4, 3): 5}})
    merges = spark.createDataFrame([("m.xlsx", 0, 1, 3, 1, 2)], "file_id string, sheet_idx int, min_row int, max_row int, min_col int, max_col int")
    got = {(r.row, r.col): r.value for r in G.fill_merged(cells, merges).collect()}
    assert got == {(1, 1): "top", (1, 2): "top", (2, 1): "top", (2, 2): "own", (3, 1): "top", (3, 2): "top", (4, 3): "5"}
    assert {r.row: r["values"] for r in G.snapshot(cells).collect()} == {1: ["top"], 2: [None, "own"], 4: [None, None, "5"]}
    assert G.row_spine(cells).count() == 4


MERGE = "file_id string, sheet_idx int, min_row int, max_row int, min_col int, max_col int"


def test_whole_columns_end_with_the_sheet(make_cells, spark, monkeypatch):
    monkeypatch.setattr(G, "ROW_BLOCK", 4)
    cells = make_cells({("m.xlsx", "S"): {(1, 1): "all", (9, 3): "own", (2, 5): "pair"}})
    merges = spark.createDataFrame([("m.xlsx", 0, 1, G.LAST_ROW, 1, 2), ("m.xlsx", 0, 2, 11, 5, 6), ("m.xlsx", 0, 9, 9, 3, G.LAST_COL)], MERGE)
    got = {(r.row, r.col): r.value for r in G.fill_merged(cells, merges).collect()}
    want = {(r, c): "all" for r in range(1, 12) for c in (1, 2)} | {(r, c): "pair" for r in range(2, 12) for c in (5, 6)} | {(9, 3): "own", (9, 4): "own"}
    overlap = {(9, 5), (9, 6)}  # two rectangles there
    assert {k: v for k, v in got.items() if k not in overlap} == {k: v for k, v in want.items() if k not in overlap}
    assert G.clip_merges(cells, merges).agg(F.max("max_row"), F.max("max_col")).first()[:] == (11, 6)


def test_asked_rows_only(make_cells, spark, monkeypatch):
    """Rows met by blocks give what the exploded rectangles give, on random rectangles."""
    monkeypatch.setattr(G, "ROW_BLOCK", 3)
    rnd = random.Random(2)
    tops = {(r * 10 + 1, c * 4 + 1): f"v{r}{c}" for r in range(4) for c in range(3)}
    cells = make_cells({("m.xlsx", "S"): tops | {(44, 14): "end"}})
    merges = spark.createDataFrame([("m.xlsx", 0, r, r + rnd.randint(0, 9), c, c + rnd.randint(0, 3)) for r, c in tops], MERGE)
    rows = [("m.xlsx", 0, r) for r in range(1, 45, 2)]
    asked = spark.createDataFrame(rows, "file_id string, sheet_idx int, row int")
    full = {(r.row, r.col): r.value for r in G.fill_merged(cells, merges).collect()}
    got = {(r.row, r.col): r.value for r in G.fill_merged(cells, merges, asked).collect()}
    own = set(tops) | {(44, 14)}
    assert got == {k: v for k, v in full.items() if k in own or k[0] % 2}


def test_side_by_side_blocks(make_cells):
    header = ["零件号", "名称", "数量", None, "零件号", "名称", "数量", "零件号"]
    cells = make_cells({("b.xlsx", "S"): grid([header])})
    heads = G.sheet_extent(cells).select("file_id", "sheet_idx", F.lit(1).alias("header_row"), F.lit(1).alias("part_col"))
    assert [tuple(r)[2:] for r in G.detect_blocks(cells, heads).collect()] == [(5, 6, 7)]


def test_auto_layouts(make_cells):
    cells = make_cells(
        {
            ("x.xlsx", "S"): grid([["表头"], ["零件号", "零件名称(英文)", "名称"], ["数量", None, "english"], ["P1", 1]]),
            ("y.xlsx", "S"): grid([[None], ["Part No", "Name", "Qty", "数量"], ["P1", "a", 1, 2]]),
            ("z.xlsx", "S"): grid([["a", "b"], ["c", "d"]]),
        }
    )
    # the second row brings two roles, so the row below it, with the quantity, is not read
    assert {r.file_id for r in G.auto_bom_sheets(cells).collect()} == set()
    (card,) = G.auto_card_cols(cells.filter("file_id <> 'x.xlsx'")).collect()
    assert (card.file_id, card.header_row, card.part_col, card.qty_col, card.name_col) == ("y.xlsx", 2, 1, 4, 2)


def test_english_column_with_cyrillic_data_becomes_main_name(make_cells):
    rows = [["Код детали", "Наименование", "Кол-во"]] + [[f"AB-{i:04d}", "Болт крепёжный", i] for i in range(1, 8)]
    cells = make_cells({("r.xlsx", "Лист"): grid(rows)})
    role = G.detect_roles(cells, G.pick_headers(G.score_headers(cells))).first()
    assert (role.part_no, role.name_cn, role.name_en, role.qty) == (1, 2, None, 3)


def test_card_number_and_operation_name(make_cells):
    cells = make_cells(
        {
            ("038-дверь.xlsx", "S"): grid([["文件编号"], ["作业要素", "装配工序 一号线"], ["零件号", "数量"]]),
            ("q.xlsx", "S"): grid([["no"], ["Номер SSQRT1L-17-AS-04001\nлист"], ["零件号", "数量"]]),
        }
    )
    assert {r.file_id: r.card_no for r in G.sheet_card_number(cells).collect()} == {"038-дверь.xlsx": "038", "q.xlsx": "SQRT1L-17-AS-04001"}
    heads = G.sheet_extent(cells).select("file_id", "sheet_idx", F.lit(3).alias("header_row"))
    names = {r.file_id: r.operation_name for r in G.operation_name(cells, heads).collect()}
    assert names == {"038-дверь.xlsx": "装配工序 一号线", "q.xlsx": ""}


def test_uncached_formulas(make_cells, spark):
    cells = make_cells({("f.xlsx", "S"): {(1, 1): "head"}, ("g.xlsx", "S"): {(1, 1): "head", (5, 2): 1}})
    sheets = spark.createDataFrame([("f.xlsx", 0, 9), ("g.xlsx", 0, 9)], "file_id string, sheet_idx int, max_row int")
    assert [r.file_id for r in G.flag_uncached(cells, sheets).collect()] == ["f.xlsx"]
