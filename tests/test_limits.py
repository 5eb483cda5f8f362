"""Nothing is cut off: long sheets, late sheets, empty configurations, any alphabet."""

import json

import pytest
from pyspark.sql import functions as F
from conftest import grid

from __spark_entry__ import queries
from kittally.operators import classify as C
from kittally.operators import grid as G
from kittally.operators import mapping as M
from kittally.operators import reconcile as R
from kittally.operators import tables as T
from kittally.plans import jobs as J
from kittally.plans import workbooks as W
from kittally.session import cut

HEAD = ["零件号", "零件名称", "数量"]


def test_all_tables_of_a_sheet(make_cells):
    rows = []
    for t in range(700):
        rows += [HEAD, *[[f"P{t:04d}{i}", "bolt", 1] for i in range(4)]] + [[]] * 6
    cells = make_cells({("a.xlsx", "S"): grid(rows)})
    tables = T.bound_confidence(cells, T.table_end(cells, T.table_candidates(cells)))
    assert T.table_chain(tables, G.sheet_extent(cells)).count() == 700
    assert T.table_chain(tables, G.sheet_extent(cells), limit=500).count() == 500


def test_long_table_ends_at_its_last_row(make_cells):
    cells = make_cells({("a.xlsx", "S"): grid([HEAD, *[[f"P{i:05d}", "bolt", 1] for i in range(900)]])})
    tables = T.table_candidates(cells)
    assert [r.data_end for r in T.table_end(cells, tables).collect()] == [901]
    assert [r.data_end for r in T.table_end(cells, tables, reach=500).collect()] == [501]


def test_configurations_start_at_the_first_column(make_cells):
    rows = [["LX A", "名称", "LX B", "数量"], *[[i % 3 + 1, f"Болт крепления {i}", i % 2 + 1, 2.5 + i] for i in range(12)]]
    cells = make_cells({("a.xlsx", "S"): grid(rows)})
    headers = G.pick_headers(G.score_headers(cells))
    roles = G.detect_roles(cells, headers)
    assert [r.part_no for r in roles.collect()] in ([None], [])
    got = G.detect_configs(cells, headers, roles).collect()
    assert 1 in {r.col for r in got}


@pytest.mark.parametrize("name,kind", [("焊装线-12", "operational_card"), ("Кузов-7", "operational_card"), ("two words-7", "unknown")])
def test_rules_read_any_alphabet(spark, name, kind):
    rules = {"operational_card_patterns": [{"type": "filename_regex", "pattern": r"^\w+-\d+$", "format_group": "a"}]}
    files = spark.createDataFrame([(f"x/{name}.xlsx",)], "path string")
    assert [r.file_type for r in C.classify_rules(files, rules).collect()] == [kind]


def test_summary_keeps_configurations_without_rows(spark):
    bom = spark.createDataFrame([("A", "P001", 2.0)], "config string, part string, qty double")
    cards = spark.createDataFrame([], "part string, qty double")
    configs = spark.createDataFrame([("A",), ("B",)], "config string")
    listed = R.config_summary(R.outcomes(bom, cards, configs), cards, configs)
    short = R.summarise(bom, cards, configs)
    want = {("A", 1, 1), ("B", 0, 0)}
    for got in (listed, short):
        assert {(r.config, r.total_bom_parts, r.only_in_bom) for r in got.collect()} == want


def test_layout_on_a_later_sheet(make_cells):
    cells = make_cells({("a.xlsx", "cover"): {(1, 1): "Содержание"}, ("a.xlsx", "data"): grid([["x"], HEAD, ["P1", "bolt", 1]])})
    assert [(r.header_row, r.part_col, r.qty_col) for r in G.auto_card_cols(cells).collect()] == [(2, 1, 3)]


SHEETS = [{"sheet_name": "BOM", "sheet_type": "bom_data", "header_rows": [1], "columns": {"part_no": 1, "qty": 2, "config_columns": [{"col_index": 3}, {"col_index": 4}]}}]


def card_mapping(**columns):
    return {"bom": {"sheets": SHEETS}, "cards": {"formats": {"g": {"sheets": [{"columns": columns, "data_start_row": 2}]}}}}


def mapped(spark, files):
    rows = [(f, json.dumps(m)) for f, m in files.items()]
    return M.read_mapping(spark.createDataFrame(rows, "file_id string, mapping_config string"))


RULES = {"operational_card_patterns": [{"type": "filename_keyword", "keywords": ["card"], "format_group": "g"}]}


def test_job_by_mapping(make_cells, spark):
    parts = [["No", "Qty", "LX A", "LX B"], ["A-100", 2, None, None], ["A100", 2, "S", "S"], ["B-200", 3, "S", None], [None, 1, "S", "S"]]
    bom = make_cells({("bom.xlsx", "BOM"): grid(parts)})
    merges = spark.createDataFrame([("bom.xlsx", 0, 4, 5, 1, 1)], "file_id string, sheet_idx int, min_row int, max_row int, min_col int, max_col int")
    left = grid([["part", "name", "n"], ["A100", "bolt", 2], ["B200", "nut", 9]])
    right = grid([["n", "name", "part"], [1, "washer", "C300"]])
    cards = make_cells({("card-1.xlsx", "S"): left, ("card-2.xlsx", "S"): right})
    maps = {"card-1.xlsx": card_mapping(part_no=1, name=2, qty=3), "card-2.xlsx": card_mapping(part_no=3, name=2, qty=1)}
    errors = spark.createDataFrame([("card-3.xlsx", "in", "not a workbook", "read")], "file string, folder string, error string, phase string")
    out = J.run_by_mapping(bom, cards, mapped(spark, {"bom.xlsx": maps["card-1.xlsx"]}), RULES, merges=merges, errors=errors, card_mapped=mapped(spark, maps))
    originals = {r.part_key: r.original for r in out["bom_parts"].collect()}
    assert originals["A100"] == "A-100"
    qty = {(r.config, r.part_key): r.qty for r in out["bom_quantities"].collect()}
    assert qty["LX A", "B200"] == 4 and qty["LX B", "B200"] == 1  # the merged cell names the last row's part
    assert {r.outcome: r.n for r in out["totals"].collect()} == {"qty_mismatch": 2, "only_in_cards": 2}
    assert {(r.config, r.part_number) for r in out["detail"].select("config", "part_number").collect()} == {("LX A", "B-200"), ("LX B", "B-200"), ("LX A", "C300"), ("LX B", "C300")}
    assert out["load_metrics"].first().failed == 1 and out["file_errors"].first().error == "not a workbook"
    assert {(r.original, r.config_label) for r in out["bom_matrix"].collect()} == {("A-100", "LX A"), ("A-100", "LX B"), ("B-200", "LX A"), ("B-200", "LX B")}


def test_unfolded_cells_are_not_broadcast_by_file_size(spark, tmp_path):
    """Parquet of like rows is small and Spark does not count unfolding: only measured sides may be broadcast."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    rows = [(i, f"bolt {i}", "Brand#1", "SMALL", i % 50, 1.5 * i) for i in range(1200)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    session.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/part.parquet")
    lines = queries()["bom_matrix_lines"](session, str(tmp_path))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert lines.select("file_id").distinct().count() == 3


def test_results_keep_their_sizes_when_the_caller_puts_settings_back(spark, tmp_path):
    """A plan is made when rows are asked for: by then the caller may have its own settings again."""
    session = spark.newSession()
    rows = [(i, f"bolt {i}", "Brand#1", "SMALL", i % 50, 1.5 * i) for i in range(1200)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    session.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/part.parquet")
    own = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.shuffle.partitions": "5"}
    for key, value in own.items():
        session.conf.set(key, value)
    found = [queries()[name](session, str(tmp_path)) for name in ("bom_matrix_lines", "bom_from_workbooks", "config_names")]
    assert {key: session.conf.get(key) for key in own} == own
    for key, value in own.items():
        session.conf.set(key, value)
    for result in found:
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        assert result.sparkSession.conf.get("spark.sql.shuffle.partitions") == "5"
        assert result.count() > 0


def test_card_numbers_sort_hits_only(make_cells):
    """Cells without a number are reduced by hash before anything is sorted."""
    rows = [[f"cell {r} {c}" for c in range(5)] for r in range(40)]
    rows[3][2], rows[7][1], rows[20][0] = "SQRT1L-17-AS-04001", "SQRT1L-17-AS-04002", "SQRT1L-17-AS-04003"
    cells = make_cells({("a.xlsx", "S"): grid(rows), ("038-b.xlsx", "S"): grid(rows[8:20])})
    found = G.sheet_card_number(cells)
    assert {r.file_id: r.card_no for r in found.collect()} == {"a.xlsx": "SQRT1L-17-AS-04001", "038-b.xlsx": "038"}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    kinds = [line.split("(")[0].strip(" +-:") for line in plan.splitlines() if "Aggregate(" in line]
    assert kinds[-2:] == ["HashAggregate", "HashAggregate"]  # the two nearest to the cells


def test_expressions_run_once_per_word(spark, tmp_path):
    text = "bolt nut 12 " * 50
    spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("http://a",)], "url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1.5,)], "value double").write.parquet(f"{tmp_path}/events.parquet")
    part = "p_partkey long, p_name string, p_size int, p_type string"
    spark.createDataFrame([(1, "bolt", 5, "SMALL")], part).write.parquet(f"{tmp_path}/part.parquet")
    from collections import Counter

    from kittally.plans import bindings as B

    counted = B.counted_texts(spark, str(tmp_path)).collect()
    assert sum(r.v == "bolt" for r in counted) == 1
    seen = Counter()
    for r in counted:
        seen[r.v] += r.n
    assert seen == Counter(r.v for r in B.texts(spark, str(tmp_path)).collect())
    got = queries()["valid_bom_rows"](spark, str(tmp_path))
    assert {r.raw: r.n for r in got.collect()}.get("12") in (None, 1000)


def test_listed_summary_deals_no_rows_by_configuration(spark):
    """F8: a few configurations hold all listed rows; a join on them would put these into a few tasks."""
    bom = spark.createDataFrame([("A", "P001", 2.0), ("A", "P002", 1.0), (None, "P003", 1.0)], "config string, part string, qty double")
    cards = spark.createDataFrame([("P001", 2.0)], "part string, qty double")
    listed = spark.createDataFrame([("A", "matched", True), ("A", "only_in_bom", True)], "config string, outcome string, valid boolean")
    got = R.config_summary(listed, cards, bom)
    assert "Join" not in got._jdf.queryExecution().sparkPlan().toString()
    assert {(r.config, r.total_bom_parts, r.matched) for r in got.collect()} == {("A", 2, 1), (None, 0, 0)}


def test_comparison_reads_written_parts(spark):
    """Keys and pairs are worked out once, not by every join that reads them."""
    bom = cut(spark.createDataFrame([("A", "P-001", 2.0), ("B", "P002", 1.0), ("A", None, 1.0)], "config string, part string, qty double"))
    cards = cut(spark.createDataFrame([("P001", 2.0), ("P002", 1.0), (None, 3.0)], "part string, qty double"))
    _, paired, loose = R._compared(bom, cards, True, None, R.TOLERANCE)
    assert not set(loose.inputFiles()) & set(cards.inputFiles())
    assert not set(paired.inputFiles()) & {*cards.inputFiles(), *bom.inputFiles()}
    assert [(r.card_part, r.bom_part) for r in paired.collect()] == [("P001", "P-001")]
    assert {r.part for r in loose.collect()} == {"P002", None}


def test_narrow_rows_are_dealt_before_they_unfold(spark, tmp_path, monkeypatch):
    """F16: a scan cannot split a row group, so its rows are dealt by the cells they unfold into."""
    rows = [(i, f"bolt {i}", "Brand#1", "SMALL", i % 50, 1.5 * i) for i in range(4000)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(W, "PART", 5000, raising=False)
    body = W.part_cells(spark, str(tmp_path)).filter("row >= 4 AND col = 1")
    assert body.select(F.spark_partition_id()).distinct().count() > 3
    assert body.count() == 4000 and body.select("file_id").distinct().count() == 8


def test_candidates_go_through_the_cells_once(make_cells):
    """Cells are reduced by hash to rows that can count, and these are written once."""
    cells = cut(make_cells({("a.xlsx", "S"): grid([["x", "y"], HEAD, ["P1", "bolt", 1]])}))
    found = T.table_candidates(cells)
    assert not set(found.inputFiles()) & set(cells.inputFiles())
    assert [(r.header_row, r.part_col, r.qty_col, r.name_col) for r in found.collect()] == [(2, 1, 3, 2)]


def test_confidence_meets_the_cells_once(make_cells):
    """header and body of a table are read in one join."""
    cells = make_cells({("a.xlsx", "S"): grid([HEAD, *[[f"P{i:04d}", "bolt", 1] for i in range(60)]])})
    tables = cut(T.table_end(cells, T.table_candidates(cells)))
    got = T.bound_confidence(cells, tables)
    assert got._jdf.queryExecution().sparkPlan().toString().count("Join") == 2
    assert [r.confidence for r in got.collect()] == [1.0]


def test_extraction_reads_picked_rows_once(make_cells, spark):
    """rows of the layout are picked once, not by each rule that reads them."""
    cells = cut(make_cells({("a.xlsx", "S"): grid([HEAD, ["P0001", "bolt", 1], ["P0002", "nut", 2], ["签字"], ["P0003", "nut", 2]])}))
    schema = "file_id string, part_col int, qty_col int, name_col int, data_start int, end_markers array<string>"
    got = T.extract_table(cells, spark.createDataFrame([("a.xlsx", 1, 3, 2, 2, ["签字"])], schema))
    assert not set(got.inputFiles()) & set(cells.inputFiles())
    assert {(r.raw, r.qty) for r in got.collect()} == {("P0001", 1.0), ("P0002", 2.0)}


@pytest.mark.parametrize("name", ["check_split", "check_structural", "quality_roll_up", "quarantine"])
def test_size_of_a_long_page(spark, tmp_path, name):
    """20,000 bytes a character of a page of 120,000 characters are more than an int holds."""
    link = '<a href="/a.png">'
    pages = [(1, "https://a/en/long", link + "x" * (120_000 - len(link))), (2, "https://a/en/", "<p>" * 9), (3, "http://a/#top", "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries()[name](spark, str(tmp_path))
    rows = {tuple(r) for r in got.collect() if r.file_id == 1}
    assert rows == {
        "check_split": {(1, "split-quality", "warning", "Too few rows: 0 < 6")},
        "check_structural": {(1, "structural", "warning", "File too large: 2288.8 MB > 50.0 MB")},
        "quality_roll_up": {(1, 0, 2, True)},
        "quarantine": {(1, 2_400_000_000, None)},
    }[name]
