"""Boundary rules against plain loops on small random sheets, with blocks cut very short."""

import random
import re

import pytest
from conftest import grid
from pyspark.sql import functions as F

from kittally.functions import keywords as K
from kittally.operators import grid as G
from kittally.operators import scan
from kittally.operators import tables as T

HAN = re.compile("[一-鿿㐀-䶿]")


@pytest.fixture(autouse=True)
def short_blocks(monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 5)


def random_sheets(seed, n=12):
    rnd = random.Random(seed)
    sheets = {}
    for k in range(n):
        cells = {}
        for row in range(1, rnd.randint(3, 70)):
            kind = rnd.choice(["part"] * 4 + ["blank"] * 4 + ["head", "title", "mark", "name", "space"])
            if kind == "part":
                cells[row, 1], cells[row, 3] = f"P{row:03d}", rnd.randint(1, 9)
            elif kind == "head":
                cells |= {(row, 1): "零件号", (row, 2): "零件名称", (row, 3): "数量"}
            elif kind == "title":
                cells[row, 2] = "焊接总成工位"
            elif kind == "mark":
                cells[row, rnd.choice([1, 2])] = "签字"
            elif kind == "name":
                cells[row, 2] = "bolt"
            elif kind == "space":
                cells[row, 1] = "  "
        cells[1, 4] = "top"
        sheets[f"f{k:02d}.xlsx", "S"] = cells
    return sheets


def size(cells):
    return max(r for r, _ in cells), max(c for _, c in cells)


def blank(v):
    return v is None or str(v).strip() == ""


def by_file(df, *fields):
    out = {}
    for r in df.collect():
        out.setdefault(r.file_id, []).append(tuple(r[f] for f in fields))
    return {k: sorted(v) for k, v in out.items()}


def test_look_ahead_and_behind(spark):
    rnd = random.Random(3)
    rows = [(f"k{k}", 0, r, rnd.random() < 0.2) for k in range(3) for r in sorted(rnd.sample(range(100), 40))]
    df = spark.createDataFrame(rows, "file_id string, sheet_idx int, row int, m boolean")
    ahead = {(r.file_id, r.row): r.n for r in scan.next_row(df, {"n": F.col("m")}).collect()}
    behind = {(r.file_id, r.row): r.p for r in scan.prev_row(df, {"p": F.col("m")}).collect()}
    for key, _, row, _ in rows:
        marks = [r for k, _, r, m in rows if k == key and m]
        assert ahead[key, row] == min((r for r in marks if r > row), default=None)
        assert behind[key, row] == max((r for r in marks if r < row), default=None)


def test_upper_median_and_numbering(spark):
    values = [5, 1, 1, 9, 9, 2]
    hist = spark.createDataFrame([("a", v, values.count(v)) for v in set(values)], "k string, v int, n int")
    assert scan.upper_median(hist, ["k"], "v", "n").first().median == sorted(values)[len(values) // 2]
    df = spark.createDataFrame([("a", r) for r in range(3, 40, 3)], "k string, row int")
    assert sorted((r.row, r.no) for r in scan.number_by(df, "row", ["k"], "no").collect()) == [(r, i) for i, r in enumerate(range(3, 40, 3), 1)]


def test_stop_rule(make_cells, spark):
    sheets = random_sheets(1)
    cells = make_cells(sheets)
    layout = cells.select("file_id").distinct().withColumns(
        {"part_col": F.lit(1), "qty_col": F.lit(3), "name_col": F.lit(2), "data_start": F.lit(2), "end_markers": F.array(F.lit("签字"))}
    )
    got = by_file(T.extract_table(cells, layout), "row")
    for (file, _), c in sheets.items():
        if size(c)[0] < 2:
            continue
        empty, want = 0, []
        for row in range(2, size(c)[0] + 1):
            part, name = c.get((row, 1)), c.get((row, 2))
            if "签字" in str(part if part is not None else name or ""):
                break
            if part is None:
                empty += 1
                if empty == 3:
                    break
                continue
            empty = 0
            if re.fullmatch("P[0-9]+", part):
                want.append((row,))
        assert got.get(file, []) == want, file


def naive_end(c, head, part_col):
    last, _ = size(c)
    empty = 0
    for r in range(head + 1, min(last, head + 500) + 1):
        values = [v for (row, _), v in c.items() if row == r]
        if len(values) >= 2 and any(w in str(v).strip().lower() for v in values for w in K.PART_NO):
            return r - 1
        if blank(c.get((r, part_col))) and any(HAN.search(str(v)) for v in values):
            if (r < last and blank(c.get((r + 1, part_col)))) or r - head > 3:
                return r - 1
        empty = 0 if values else empty + 1
        if empty == 5:
            return r - 5
    return min(last, head + 500)


def test_table_ends(make_cells):
    sheets = random_sheets(2, 20)
    cells = make_cells(sheets)
    tables = T.table_candidates(cells)
    got = by_file(T.table_end(cells, tables), "header_row", "part_col", "data_end")
    assert sum(map(len, got.values())) > 20
    for (file, _), c in sheets.items():
        for head, col, end in got.get(file, []):
            assert end == naive_end(c, head, col), (file, head)


def test_data_runs(make_cells):
    sheets = {k: v for k, v in random_sheets(4, 30).items()}
    cells = make_cells(sheets)
    got = by_file(T.block_bounds(cells), "data_start", "data_end")
    for (file, _), c in sheets.items():
        last, _ = size(c)
        runs, start, idle = [], None, 0
        for r in range(1, last + 1):
            title = any(HAN.search(str(c.get((r, k), ""))) for k in (1, 2, 3))
            if any(not blank(c.get((r, k))) for k in range(1, 9)) and not title:
                start, idle = (r if start is None else start), 0
            elif start is not None:
                idle += 1
                if idle == 5 or title:
                    runs.append((start, r - idle))
                    start, idle = None, 0
        if start is not None:
            runs.append((start, last))
        want = [b for b in runs if b[1] - b[0] >= 2] if last >= 20 else []
        assert got.get(file, []) == want, file


def naive_stack(c, start, gap, marks):
    last, _ = size(c)

    def empty(r):
        return blank(c.get((r, 1))) and blank(c.get((r, 2)))

    def marked(v):
        return v is not None and any(m in str(v) for m in marks)

    found, row = [], start
    while True:
        while row <= last and empty(row):
            row += 1
        if row > last:
            return found
        head = next((r for r in range(row, min(row + 50, last + 1)) if str(c.get((r, 1), "")).strip() in K.STACKED_HEADER), None)
        data = row + 1 if head is None else head + 1
        end, idle = last, 0
        for r in range(data, last + 1):
            if marked(c.get((r, 1))) or marked(c.get((r, 2))):
                end = r - 1
                break
            idle = idle + 1 if empty(r) else 0
            if idle == gap:
                end = r - gap
                break
        found.append((row, data, end))
        row = max(end + 1, row + 1)
        if marked(c.get((row, 1))):
            row += 1


@pytest.mark.parametrize("gap", [1, 2, 3])
def test_stacked_cards(make_cells, gap):
    sheets = random_sheets(5 + gap, 15)
    cells = make_cells(sheets)
    layout = cells.select("file_id").distinct().withColumns(
        {"part_col": F.lit(1), "qty_col": F.lit(3), "name_col": F.lit(2), "data_start": F.lit(2)}
    )
    bounds = T.split_stacked(cells, layout.withColumns({"empty_rows": F.lit(gap), "card_end_markers": F.array(F.lit("签字"))}))
    got = by_file(bounds, "start_row", "data_start", "end_row")
    for (file, _), c in sheets.items():
        if size(c)[0] >= 2 and size(c)[1] >= 3:
            assert got.get(file, []) == naive_stack(c, 2, gap, ["签字"]), file


STACK = [["Part No", "Name", "Qty"], ["P001", "Bolt", 2], ["P002", "Nut", 4], [None] * 3, ["Part No", "Name", "Qty"], ["P003", "Washer", 6], ["P004", "Screw", 1]]


def test_two_stacked_cards(make_cells):
    cells = make_cells({("001.xlsx", "S"): grid(STACK)})
    layout = cells.select("file_id").distinct().withColumns(
        {"part_col": F.lit(1), "qty_col": F.lit(3), "name_col": F.lit(2), "data_start": F.lit(2)}
    )
    ends = F.array(F.lit("签字"), F.lit("审核"))
    bounds = T.split_stacked(cells, layout.withColumns({"parts_data_start": F.lit(1), "parts_header": F.lit(1), "card_end_markers": ends}))
    assert by_file(bounds, "card_idx", "start_row", "end_row") == {"001.xlsx": [(1, 2, 3), (2, 5, 7)]}
    lines = T.stacked_lines(cells, layout, bounds)
    assert sorted((r.raw, r.card_idx, r.qty) for r in lines.collect()) == [("P001", 1, 2.0), ("P002", 1, 4.0), ("P003", 2, 6.0), ("P004", 2, 1.0)]


def test_lines_outside_cards_go_to_the_last(make_cells, spark):
    bounds = spark.createDataFrame([("a", 0, 1, 3, 3, 5), ("a", 0, 2, 8, 8, 9)], T.BOUND_SCHEMA)
    lines = spark.createDataFrame([("a", 0, r) for r in (1, 3, 5, 6, 8, 12)], "file_id string, sheet_idx int, row int")
    got = {r.row: r.card_idx for r in T.assign_cards(lines, bounds).collect()}
    assert got == {1: 2, 3: 1, 5: 1, 6: 2, 8: 2, 12: 2}


def test_marked_cards(make_cells):
    cells = make_cells({("m.xlsx", "S"): {(r, 1): "鑫源汽车" if r in (2, 12, 22, 33) else "x" for r in range(1, 41)} | {(12, 3): "焊接工序"},
                        ("n.xlsx", "S"): {(r, 1): "鑫源汽车" if r in (1, 2, 30, 100) else "x" for r in range(1, 121)}})
    got = by_file(T.marker_bounds(cells), "header_row", "data_end", "operation_name")
    assert got == {"m.xlsx": [(2, 11, ""), (12, 21, "焊接工序"), (22, 32, ""), (33, 40, "")]}


def test_tables_have_names_and_labels(make_cells):
    marked = {(r, 1): "鑫源汽车" if r in (2, 12, 22, 33) else "x" for r in range(1, 41)} | {(12, 3): "焊接/工序"}
    titled = {(2, 1): "前门总成焊接"} | {(4, c): v for c, v in enumerate(("零件号", "零件名称", "数量"), 1)}
    titled |= {(r, c): v for r in range(5, 12) for c, v in enumerate((f"P{r:03d}", "bolt", 2), 1)}
    got = by_file(T.find_bounds(make_cells({("m.xlsx", "S"): marked, ("t.xlsx", "S"): titled})), "header_row", "operation_name", "card_label", "method")
    assert got == {
        "m.xlsx": [(2, "", "Op001", "marker"), (12, "焊接/工序", "002_" + "焊接_工序", "marker"), (22, "", "Op003", "marker"), (33, "", "Op004", "marker")],
        "t.xlsx": [(4, "前门总成焊接", "001_前门总成焊接", "chain")],
    }


def test_refused_headers_count_in_labels(spark):
    tables = spark.createDataFrame([("a", 0, 2, 5, 0.9), ("a", 0, 4, 6, 0.9), ("a", 0, 7, 9, 0.1), ("a", 0, 12, 15, 0.5), ("a", 0, 20, 21, 0.9)], "file_id string, sheet_idx int, header_row int, data_end int, confidence double")
    extent = spark.createDataFrame([("a", 0, 18)], "file_id string, sheet_idx int, max_row int")
    looked = T.looked_headers(tables, extent).collect()
    assert sorted((r.nth, r.header_row, r.kept) for r in looked) == [(1, 2, True), (2, 7, False), (3, 12, True), (4, 20, True)]
    assert by_file(T.table_chain(tables, extent, limit=2), "header_row") == {"a": [(2,)]}


def test_irregular_boundaries_are_dropped(spark):
    rows = [("a", 0, h, h + 1) for h in (1, 11, 21, 31)] + [("b", 0, h, h + 1) for h in (1, 2, 12, 92, 122)] + [("c", 0, 1, 2), ("c", 0, 90, 95)]
    bounds = spark.createDataFrame(rows, "file_id string, sheet_idx int, header_row int, data_end int")
    assert sorted({r.file_id for r in T.reject_unstable(bounds).collect()}) == ["a", "c"]
    assert by_file(T.snap_bounds(bounds.filter("file_id = 'a'")), "data_end") == {"a": [(10,), (20,), (30,), (32,)]}


def test_no_parts_is_reported(make_cells):
    cells = make_cells({("e.xlsx", "S"): {(r, 2): "x" for r in range(1, 15)}, ("n.xlsx", "S"): {(r, 2): "x" for r in range(1, 5)}})
    layout = cells.select("file_id").distinct().withColumns(
        {"part_col": F.lit(1), "qty_col": F.lit(0), "name_col": F.lit(2), "data_start": F.lit(2), "end_markers": F.array().cast("array<string>")}
    )
    got = T.extraction_errors(cells, layout, T.extract_table(cells, layout)).collect()
    assert [r.file_id for r in got] == ["e.xlsx"]
    wide = layout.withColumn("qty_col", F.lit(9))
    assert T.guard_sheets(G.sheet_extent(cells), wide).filter("skipped").count() == 2
