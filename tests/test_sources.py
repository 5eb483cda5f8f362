import json
import random
import time
import zipfile
from io import BytesIO

import pandas as pd
import pytest
from conftest import grid
from pyspark.sql import functions as F

from kittally.operators import bom as BM
from kittally.operators import classify as C
from kittally.operators import mapping as M
from kittally.operators import quality as Q
from kittally.operators import scan
from kittally.plans import jobs as J
from kittally.plans.workbooks import SCHEMA, package
from kittally.sources import materials as MT
from kittally.sources import workbook as WB


def sheet(rows):
    columns = ["row", "col", "value", "kind", "strike"]
    return pd.DataFrame([(r, c, str(v), "n" if isinstance(v, (int, float)) else "s", False) for r, line in enumerate(rows, 1) for c, v in enumerate(line, 1) if v is not None], columns=columns)


BOM = [["序号", "零件号", "零件名称", "零件名称(英文)", "用量"], [1, "P-001", "板", "plate", 10], [2, "P-002", "栓", "bolt", 20], [3, "P-003", "垫", "shim", "–"]]
CARD = [["Part No", "Name", "Qty"], ["P001", "Plate", 4], ["P002", "Bolt", 20], ["P009", "Other", 1], ["签字"], ["P010", "hidden", 1]]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "cards" / "__MACOSX").mkdir(parents=True)
    (tmp_path / "bom.xlsx").write_bytes(package([("总装BOM", sheet(BOM), [(1, 1, 1, 2)])]))
    (tmp_path / "cards" / "A001 card.xlsx").write_bytes(package([("S", sheet(CARD), [])]))
    (tmp_path / "cards" / "A002 card.XLSX").write_bytes(package([("S", sheet(CARD[:2]), [])]))
    (tmp_path / "cards" / "cover.xlsx").write_bytes(package([("S", sheet(CARD), [])]))
    (tmp_path / "cards" / "broken.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "cards" / ".hidden.xlsx").write_bytes(b"")
    (tmp_path / "cards" / "__MACOSX" / "x.xlsx").write_bytes(b"")
    (tmp_path / "cards" / "notes.txt").write_text("x")
    return tmp_path


def test_ingest_folder(spark, folder):
    assert WB.manifest(spark, str(folder)).count() == 5
    out = str(folder / "facts")
    WB.write_ingest(spark, str(folder / "cards"), out)
    t = WB.tables(spark.read.parquet(out))
    assert t["errors"].count() == 1 and "BadZipFile" in t["errors"].first().error
    first = t["cells"].filter(F.col("file_id").endswith("A001%20card.xlsx") | F.col("file_id").endswith("A001 card.xlsx"))
    assert {(r.row, r.col): (r.value, r.num, r.kind) for r in first.collect()}[2, 3] == ("4", 4.0, "n")
    assert t["entries"].filter("name = 'xl/worksheets/sheet1.xml'").count() == 3


def workbook(styles, body, strings=""):
    out = BytesIO()
    base = package([("S", sheet([["x"]]), [])])
    with zipfile.ZipFile(BytesIO(base)) as src, zipfile.ZipFile(out, "w") as dst:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        for name in src.namelist():
            if name == "xl/styles.xml":
                dst.writestr(name, f"<styleSheet {ns}>{styles}</styleSheet>")
            elif name.endswith("sheet1.xml"):
                dst.writestr(name, f"<worksheet {ns}>{body}</worksheet>")
            else:
                dst.writestr(name, src.read(name))
        dst.writestr("xl/sharedStrings.xml", f"<sst {ns}>{strings}</sst>")
    return out.getvalue()


def test_cell_kinds():
    styles = '<fonts><font/><font><strike/></font><font><strike val="0"/></font></fonts><cellXfs><xf fontId="0"/><xf fontId="1"/><xf numFmtId="14"/><xf fontId="2"/></cellXfs>'
    body = (
        '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" s="1"><v>5.0</v></c><c r="C1" s="2"><v>45292</v></c><c r="D1" t="b"><v>1</v></c>'
        '<c r="E1"><f>1+1</f></c><c r="F1"><v>NaN</v></c><c r="AA1" s="3"><v>2.5</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells>'
    )
    rows = list(WB.explode("f.xlsx", workbook(styles, body, "<si><r><t>零件</t></r><r><t>号</t></r></si>")))
    cells = {(r["row"], r["col"]): (r["value"], r["num"], r["kind"], r["strike"]) for r in rows if r["entity"] == "cell"}
    assert cells == {
        (1, 1): ("零件号", None, "s", False), (1, 2): ("5", 5.0, "n", True), (1, 3): ("2024-01-01 00:00:00", None, "d", False),
        (1, 4): ("True", 1.0, "b", False), (1, 27): ("2.5", 2.5, "n", False),
    }
    assert [(r["row"], r["col"], r["max_row"], r["max_col"]) for r in rows if r["entity"] == "merge"] == [(1, 1, 2, 2)]
    assert [(r["max_row"], r["max_col"]) for r in rows if r["entity"] == "sheet"] == [(1, 27)]


def test_package_quality(spark):
    good = package([("S", sheet(CARD), [])])
    out = BytesIO()
    with zipfile.ZipFile(BytesIO(good)) as src, zipfile.ZipFile(out, "w") as dst:
        for name in src.namelist():
            if name != "_rels/.rels":
                dst.writestr(name, src.read(name))
        dst.writestr("xl/media/image1.png", b"")
        dst.writestr("xl/drawings/_rels/drawing1.xml.rels", '<Relationships><Relationship Target="../media/image9.png"/></Relationships>')
    files = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(out.getvalue()))], "path string, content binary")
    t = WB.tables(WB.explode_files(files).cache())
    sizes = files.select(F.col("path").alias("file_id"), F.length("content").alias("size"))
    issues = Q.check_structural(sizes, t["entries"]).unionByName(Q.check_schema(t["entries"])).unionByName(Q.check_content(t["entries"], t["refs"]))
    messages = {(r.file_id, r.message) for r in issues.collect()}
    assert messages == {
        ("bad", "Missing required file: _rels/.rels"), ("bad", "Empty media file: xl/media/image1.png"),
        ("bad", "Broken media reference in xl/drawings/_rels/drawing1.xml.rels: xl/media/image9.png"),
    }
    state = {r.file_id: (r.errors, r.warnings, r.is_valid) for r in Q.roll_up(sizes, issues).collect()}
    assert state == {"good": (0, 0, True), "bad": (1, 0, False)}
    valid, invalid = Q.quarantine(sizes, issues)
    assert [r.file_id for r in valid.collect()] == ["good"]
    assert [r.error for r in invalid.collect()] == ["[structural] Missing required file: _rels/.rels"]


def test_materials(spark, tmp_path):
    record = {"card_no": "C1", "sheet_name": "S", "row_index": 2, "part_no": "P-1", "name_cn": "板", "name_ru": "", "qty": 2.0}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "one.json").write_text(json.dumps([record, record | {"row_index": 3, "part_no": "p.1", "name_ru": "плита"}]))
    (tmp_path / "two.json").write_text(json.dumps([record | {"card_no": "C2", "qty": 5.0}]))
    (tmp_path / "x_error.json").write_text(json.dumps({"card_path": "x", "error": "boom"}))
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "bad.json").write_text("[{")
    records = MT.read_materials(spark, str(tmp_path))
    assert records.count() == 3
    (total,) = J.A.card_totals(J.lines_from_materials(records)).collect()
    assert (total.part_key, total.qty, total.original, total.name_ru) == ("P1", 9.0, "P-1", "плита")
    MT.write_materials(records.drop("path", "ord"), str(tmp_path / "out"))
    assert MT.read_materials(spark, str(tmp_path / "out"), arrays=False).count() == 3


MAPPING = {
    "bom": {"sheets": [{"sheet_name": "总装BOM", "sheet_type": "bom_data", "header_rows": [1], "columns": {"part_no": {"col_index": 2}, "name_cn": 3, "name_en": {"col_index": 4}, "qty": 5}}]},
    "cards": {"formats": {"plain": {"sheets": [{"columns": {"part_no": 1, "name_cn": {"col_index": 2}, "qty": 3}, "header_rows": [1]}], "end_markers": ["签字"]}}},
}
RULES = {
    "service_file_patterns": [{"type": "filename_keyword", "keywords": ["cover"]}],
    "operational_card_patterns": [{"type": "filename_regex", "pattern": "^a\\d+", "format_group": "plain"}],
}


def test_jobs_from_files(spark, folder):
    facts = WB.ingest(spark, str(folder)).cache()
    cells = WB.tables(facts)["cells"]
    bom_cells = cells.filter(F.col("file_id").contains("bom.xlsx"))
    card_cells = cells.filter(~F.col("file_id").contains("bom.xlsx"))
    mapped = M.read_mapping(bom_cells.select("file_id").distinct().withColumn("mapping_config", F.lit(json.dumps(MAPPING))))
    words = spark.createDataFrame([("Plate", "плита")], "source string, target string")
    report = J.run_by_mapping(bom_cells, card_cells, mapped, RULES, words)
    rows = {r.part_number: r for r in report["detail"].collect()}
    # two cards use P001 four times each, one uses P002 twenty times; lines below the mark are left out
    assert set(rows) == {"P-001", "P009"}
    assert (rows["P-001"].qty_bom, rows["P-001"].qty_cards, rows["P-001"].name_ru, rows["P-001"].card_list) == (10.0, 8.0, "плита", "A001, A002")
    assert rows["P-001"].name_cn == "板" and rows["P009"].kind == "Есть в операционных картах, нет в BOM"
    (summary,) = report["per_config"].collect()
    assert (summary.config, summary.matched, summary.total_bom_parts, summary.total_cards_parts) == ("MULTI_SHEET_COMBINED", 1, 2, 3)
    assert report["integrity"].first().is_ok and report["integrity_global"].first().is_ok
    found = J.run_by_detection(bom_cells, card_cells)
    # without a mapping there are no end marks, so the line below is read as well
    assert {r.part_number for r in found["detail"].collect()} == {"P-001", "P009", "P010"}
    MT.write_report({"totals": report["totals"]}, str(folder / "report"), "csv")
    assert spark.read.option("header", "true").csv(str(folder / "report" / "totals")).count() == 2


def test_split_and_stacked_cards(spark, tmp_path):
    part = ["Part No", "Name", "Qty"]
    stack = [part, ["P001", "Bolt", 2], [None], part, ["P002", "Nut", 4]]
    (tmp_path / "b7 deck.xlsx").write_bytes(package([("S", sheet(stack), [])]))
    (tmp_path / "a55 many.xlsx").write_bytes(package([("封面", sheet([["P900", "x", 1]] * 3), []), ("one", sheet([part, ["P003", "a", 1]]), []), ("two", sheet([part, ["P004", "b", 1]]), [])]))
    (tmp_path / "unknown.xlsx").write_bytes(package([("S", sheet([part, ["P999", "x", 1]]), [])]))
    cells = WB.tables(WB.ingest(spark, str(tmp_path)).cache())["cells"]
    columns = {"part_no": 1, "name": 2, "qty": 3}
    mapping = {"cards": {"formats": {
        "plain": {"sheets": [{"columns": columns, "header_rows": [1]}]},
        "deck": {"sheets": [{"columns": columns, "table_boundaries": {"type": "multi_card", "data_start_row": 2, "multi_card": {"empty_rows_separator": 1, "parts_data_start_row": 1}}}]},
    }}}
    rules = {"operational_card_patterns": [
        {"type": "filename_regex", "pattern": "^a\\d", "format_group": "plain"}, {"type": "filename_regex", "pattern": "^b\\d", "format_group": "deck"}]}
    mapped = M.read_mapping(spark.createDataFrame([(json.dumps(mapping),)], "mapping_config string"))
    lines = J.cards_by_mapping(cells, mapped.select("mapping"), rules).collect()
    assert sorted((r.card_no, r.sheet, r.raw) for r in lines) == [
        ("a55", "one", "P003"), ("a55", "two", "P004"), ("b7 deck_part1", "S", "P001"), ("b7 deck_part2", "S", "P002")]


def test_format_resolution(spark):
    mapped = M.read_mapping(spark.createDataFrame([(json.dumps(MAPPING),), ], "mapping_config string"))
    files = spark.createDataFrame([("a", "plain"), ("b", None)], "file_id string, format_group string")
    got = {r.file_id: (r.part_col, r.name_col, r.data_start, r.end_markers) for r in M.resolve_format(files, M.card_formats(mapped, []), []).collect()}
    assert got == {"a": (1, 2, 2, ["签字"]), "b": (None, None, None, None)}
    jobs = spark.createDataFrame([(1, '["A","B"]'), (2, "C"), (3, ""), (4, None)], "job_id int, selected_config string")
    assert sorted((r.job_id, r.config) for r in M.selected_configs(jobs).collect()) == [(1, "A"), (1, "B"), (2, "C")]


def test_classification(spark):
    names = ["封面.xlsx", "工序卡 焊接.xlsx", "A12-x.xlsx", "M1-A-AS-001.xlsx", "заметки.xlsx", "toc 12.xlsx"]
    files = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "path string, ord int")
    kinds = [r.file_type for r in C.classify_legacy(files).orderBy("ord").collect()]
    assert kinds == ["service", "operational_card", "operational_card", "operational_card", "unknown", "service"]
    only_service = C.classify_rules(files, {"service_file_patterns": [{"type": "filename_keyword", "keywords": ["封面"]}]})
    assert [r.file_type for r in only_service.orderBy("ord").collect()] == ["service", "unknown", "operational_card", "operational_card", "unknown", "unknown"]


def test_names_are_unique_under_clashes(spark):
    tasks = [("s1", "x", "a"), ("s2", "x", "a"), ("s3", "x_1", "a"), ("s4", "x_1", "a"), ("s5", "x", "a"), ("s6", "y", None), ("s7", "y", "")]
    got = {r.source: r.name for r in C.allocate_names(spark.createDataFrame(tasks, "source string, sheet string, label string")).collect()}
    assert got == {"s1": "a_x.xlsx", "s2": "a_x_1.xlsx", "s3": "a_x_1_1.xlsx", "s4": "a_x_1_2.xlsx", "s5": "a_x_2.xlsx", "s6": "y.xlsx", "s7": "y_1.xlsx"}


def names_one_by_one(tasks):
    taken, following, out = set(), {}, []
    for source, sheet, label in sorted(tasks, key=lambda t: (t[0], t[1], t[2] is not None, t[2] or "")):
        base = f"{label}_{sheet}" if label else sheet
        name, n = base, following.get(base, 1)
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        following[base] = n
        taken.add(name)
        out.append((source, sheet, label, f"{name}.xlsx"))
    return sorted(out, key=repr)


def allocated(spark, tasks):
    df = spark.createDataFrame(tasks, "source string, sheet string, label string").repartition(4)
    return sorted(map(tuple, C.allocate_names(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_names_like_one_by_one(spark, monkeypatch, seed):
    """Suffixes of suffixes, suffixes that are none (_0, _01), and pieces far smaller than a family."""
    monkeypatch.setattr(scan, "BLOCK", 4)
    monkeypatch.setattr(C, "_CHUNK", 3)
    monkeypatch.setattr(C, "CLASHES", 6)
    rnd = random.Random(seed)
    sheets = ["x", "x_1", "x_2", "x_1_1", "x_3", "x_10", "x_01", "x_0", "y", "x_1_1_1"]
    tasks = [(f"s{rnd.randint(0, 60):03d}", rnd.choice(sheets), rnd.choice([None, "", "a"])) for _ in range(250)]
    assert allocated(spark, tasks) == names_one_by_one(tasks)


def test_names_of_one_large_family(spark):
    """Half of the sheets have one name, the other half each have a name that this one runs into, early or late."""
    rnd = random.Random(3)
    n = 50_000
    tasks = [(f"s{rnd.randint(0, 10**6):07d}", "sheet", None) for _ in range(n)]
    tasks += [(f"s{rnd.randint(0, 10**6):07d}", f"sheet_{i}", None) for i in range(1, n + 1)]
    assert allocated(spark, tasks) == names_one_by_one(tasks)
    assert "Pandas" not in C.allocate_names(spark.createDataFrame(tasks[:9], "source string, sheet string, label string"))._jdf.queryExecution().toString()


def test_no_names(spark):
    assert allocated(spark, []) == []


def test_manifest_over_runs(spark, tmp_path):
    path, given = str(tmp_path / "m"), lambda *rows: spark.createDataFrame(list(rows), "source string, name string")
    assert MT.read_manifest(spark, path).count() == 0
    read = lambda v=None: {r.source: r.names for r in MT.read_manifest(spark, path, v).collect()}
    MT.merge_manifest(given(("in/a.xlsx", "a_2"), ("in/a.xlsx", "a_1"), ("b.xlsx", "b_1")), path, "r1")
    MT.merge_manifest(given(("other/a.xlsx", "a_3"), ("c.xlsx", "c_1")), path, "r2")
    both = {"a.xlsx": ["a_1", "a_2", "a_3"], "b.xlsx": ["b_1"], "c.xlsx": ["c_1"]}
    assert read() == both
    MT.merge_manifest(given(("in/a.xlsx", "a_2"), ("in/a.xlsx", "a_1"), ("b.xlsx", "b_1")), path, "r1")  # replayed
    assert read() == both
    (tmp_path / "m" / "version=3").mkdir()  # a run that died while it wrote
    spark.createDataFrame([("x", "half", "r3")], MT.MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/version=3")
    (tmp_path / "m" / "version=3" / "_SUCCESS").unlink()
    assert read() == both
    MT.merge_manifest(given(("d.xlsx", "d_1")), path, "r3")
    assert read() == both | {"d.xlsx": ["d_1"]} and read(0) == {"a.xlsx": ["a_1", "a_2"], "b.xlsx": ["b_1"]}


RULE_SETS = [
    {"service_file_patterns": [{"type": "filename_keyword", "keywords": ["封面"]}]},
    {"operational_card_patterns": [{"type": "filename_regex", "pattern": "^a\\d", "format_group": "x"}, {"type": "sheet_keyword", "keywords": ["WELD"], "format_group": "y"}]},
    {"service_keywords": ["заметки"], "operational_keywords": ["toc"]},
    {"service_file_patterns": [{"type": "filename_regex", "pattern": ""}, {"type": "other", "keywords": ["a"]}], "operational_card_patterns": [{"type": "filename_keyword", "keywords": []}]},
    None,
]


def test_rules_as_data_like_rules_in_the_plan(spark):
    names = ["封面.xlsx", "工序卡 焊接.xlsx", "A12-x.xlsx", "M1-A-AS-001.xlsx", "заметки.xlsx", "toc 12.xlsx", "weld.xlsx"]
    files = spark.createDataFrame([(j, n, c) for j in range(len(RULE_SETS)) for n in names for c in (None, "", "the weld shop")], "job int, path string, content string")
    texts = [(j, json.dumps({"cards": {} if r is None else {"file_classification_rules": r}})) for j, r in enumerate(RULE_SETS)]
    rules = M.classification_rules(M.read_mapping(spark.createDataFrame(texts, "job int, mapping_config string")), ["job"])
    got = sorted(map(tuple, C.classify_by_rules(files, rules, ["job"], content="content").select("job", "path", "content", "file_type", "format_group").collect()), key=repr)
    want = []
    for j, r in enumerate(RULE_SETS):
        one = C.classify_rules(files.filter(F.col("job") == j), r or {}, content="content")
        want += map(tuple, one.select("job", "path", "content", "file_type", "format_group").collect())
    assert got == sorted(want, key=repr) and len({g[3] for g in got}) == 3
    single = C.classify_by_rules(files.filter("job = 1"), rules.filter("job = 1").drop("job"), [], content="content")
    assert sorted(map(tuple, single.select("path", "content", "file_type").collect()), key=repr) == sorted([(g[1], g[2], g[3]) for g in got if g[0] == 1], key=repr)


def test_a_mapping_brings_its_own_rules(spark, make_cells):
    rows = [["Part No", "Name", "Qty"], ["P001", "Plate", 4]]
    cells = make_cells({("a1.xlsx", "S"): grid(rows), ("b1.xlsx", "S"): grid(rows)})
    layout = {"columns": {"part_no": 1, "name": 2, "qty": 3}, "table_boundaries": {"header_row": 1, "data_start_row": 2}}
    mapping = {"cards": {"formats": {"f": {"sheets": [layout]}}, "file_classification_rules": {
        "service_file_patterns": [{"type": "filename_regex", "pattern": "^b"}],
        "operational_card_patterns": [{"type": "filename_regex", "pattern": "^a", "format_group": "f"}]}}}
    mapped = M.read_mapping(spark.createDataFrame([(json.dumps(mapping),)], "mapping_config string"))
    assert [r.file_id for r in J.cards_by_mapping(cells, mapped).collect()] == ["a1.xlsx"]
    turned = json.loads(json.dumps(mapping).replace('"^b"', '"^z"').replace('"^a"', '"^b"'))
    per_file = M.read_mapping(spark.createDataFrame([("a1.xlsx", json.dumps(mapping)), ("b1.xlsx", json.dumps(turned))], "file_id string, mapping_config string"))
    assert sorted(r.file_id for r in J.cards_by_mapping(cells, per_file).collect()) == ["a1.xlsx", "b1.xlsx"]


def test_a_mapping_that_does_not_fit_falls_back(spark, make_cells):
    rows = [["序号", "零件号", "零件名称", "用量"], [1, "P001", "板", 10], [2, "P002", "栓", 20]]
    cells = make_cells({("fits.xlsx", "BOM"): grid(rows), ("other.xlsx", "Sheet9"): grid(rows), ("none.xlsx", "S"): grid([["x", "y"], ["z", 1]])})
    sheet = {"sheet_name": "BOM", "sheet_type": "bom_data", "header_rows": [1], "columns": {"part_no": 2, "name_cn": 3, "qty": 4}}
    mapped = M.read_mapping(spark.createDataFrame([(f, json.dumps({"bom": {"sheets": [sheet]}})) for f in ("fits.xlsx", "other.xlsx", "none.xlsx")], "file_id string, mapping_config string"))
    sheets = J.with_fallback(cells, BM.mapped_sheets(cells, mapped))
    assert sorted((r.file_id, r.sheet, r.part_col, r.qty_col) for r in sheets.collect()) == [("fits.xlsx", "BOM", 2, 4), ("other.xlsx", "Sheet9", 2, 4)]
    side = J.bom_side(cells, sheets)
    assert sorted((r.config, r.part_key, r.qty) for r in side["qty"].collect()) == [("BOM", "P001", 10.0), ("BOM", "P002", 20.0), ("Sheet9", "P001", 10.0), ("Sheet9", "P002", 20.0)]


def test_a_job_reports_all_damaged_files(spark):
    bom = {"qty": spark.createDataFrame([("A", "P001", 1.0)], "config string, part_key string, qty double"),
           "configs": spark.createDataFrame([("A", 1)], "config string, ord int"),
           "names": spark.createDataFrame([], "part_key string, name_cn string, name_en string"),
           "parts": spark.createDataFrame([("P001", "P-001", "", "")], "part_key string, original string, name_cn string, name_en string")}
    cards = spark.createDataFrame([], "file_id string, card_no string, sheet string, row int, raw string, part_key string, name_cn string, name_ru string, qty double, ord struct<file_id: string, sheet_idx: int, row: int>")
    errors = spark.createDataFrame([("a.xlsx", "in", "not a zip", "parse")], "file string, folder string, error string, phase string")
    damaged = spark.createDataFrame([("in/a.xlsx",), ("in/deep/b.xlsx",)], "path string")
    both = J.compare(bom, cards, errors=errors, damaged=damaged)["file_errors"].collect()
    assert sorted(map(tuple, both)) == [("a.xlsx", "in", "not a zip", "parse"), ("b.xlsx", "in/deep", "", "split")]
    assert [r.file for r in J.compare(bom, cards, damaged=damaged)["file_errors"].orderBy("file").collect()] == ["a.xlsx", "b.xlsx"]
    assert "file_errors" not in J.compare(bom, cards)


def test_packing_a_long_sheet_is_one_pass():
    """Cells in any order, struck and numeric ones; rows are not grouped one by one, which took seconds."""
    cells = pd.DataFrame(
        [("f", 0, "S", r, c, f"<{r}>" if c == 1 else str(r), None if c == 1 else float(r), "s" if c == 1 else "n", r == 2) for r in range(1, 6001) for c in (2, 1)],
        columns=SCHEMA,
    ).sample(frac=1, random_state=3)
    began = time.process_time()
    content = package([("S", cells, [])])
    assert time.process_time() - began < 2
    found = [r for r in WB.explode("f.xlsx", content) if r["entity"] == "cell"]
    assert [(r["row"], r["col"], r["value"]) for r in found[:4]] == [(1, 1, "<1>"), (1, 2, "1"), (2, 1, "<2>"), (2, 2, "2")]
    assert len(found) == 12000 and [r["strike"] for r in found[:4]] == [False, False, True, True]


def test_cells_without_a_row_have_no_place():
    cells = pd.DataFrame([("f", 0, "S", None, 1, "lost", None, "s", False), ("f", 0, "S", 2, 1, "kept", None, "s", False)], columns=SCHEMA)
    xml = zipfile.ZipFile(BytesIO(package([("S", cells, [])]))).read("xl/worksheets/sheet1.xml").decode()
    assert "kept" in xml and "lost" not in xml
