import pytest
from pyspark.sql import functions as F

from kittally.functions import text as X


def column(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", fn("v").alias("out")).orderBy("i").collect()]


def check(spark, fn, cases):
    assert column(spark, fn, list(cases)) == list(cases.values())


def test_part_key(spark):
    check(
        spark,
        X.part_key,
        {
            "5306200-ED001-AC00000": "5306200ED001AC00000",
            " A.1/B_2 ": "A1B2",
            "ABC—123": "ABC123",
            "A-B-C---123": "ABC123",
            "ABC(123)DEF": "ABC123DEF",
            "\nP-1\n中文": "P1",
            "P-1_x000D_second": "P1",
            "p 1|\\{}": "P1",
            "　P1　": "P1",
            "": "",
            None: "",
        },
    )


def test_quantity(spark):
    check(
        spark,
        X.quantity,
        {
            "42": 42.0, "S": 0.0, "–": 0.0, "—": 0.0, "– –": 0.0, "2.5": 2.5, "3,14": 3.14, "-3": -3.0, "": 0.0,
            "   ": 0.0, "1,234": 1.234, "1e5": 0.0, "7\nпояснение": 7.0, "abc": 0.0, "１２": 12.0, None: 0.0,
        },
    )
    assert column(spark, lambda c: X.quantity(c, 1.0), [None, "x", "-"]) == [1.0, 1.0, 0.0]


def test_cell_quantity_rejects_dates_and_booleans(spark):
    rows = spark.createDataFrame(
        [("42", 42.0, "n"), ("True", 1.0, "b"), ("2024-01-01", None, "d"), ("3,5", None, "s")], "value string, num double, kind string"
    )
    got = [r[0] for r in rows.select(X.cell_quantity("value", "num", "kind")).collect()]
    assert got == [42.0, 0.0, 0.0, 3.5]


def test_part_validity(spark):
    check(
        spark,
        X.is_part,
        {"AB1": True, "A1": False, "1234": True, "123": False, "n/a": False, "ABC": False, "零件1": False, "Болт12": False, " A-1 ": True, None: False},
    )
    check(
        spark,
        X.is_part_lenient,
        {"ABC": True, "123": True, "12": False, "none": False, "a*b": False, "A B": True, "12-3": False, None: False},
    )


def test_key_and_raw_validity_differ(spark):
    # the BOM judges the text as written, cards judge the key
    assert column(spark, X.is_part, ["A-1", "12.5"]) == [True, True]
    assert column(spark, lambda c: X.is_part(X.part_key(c)), ["A-1", "12.5"]) == [False, False]


def test_names_and_cells(spark):
    check(spark, X.clean_name, {"Line\nHarness": "Line Harness", "  a \t b ": "a b", "a\rb": "ab", None: ""})
    check(spark, X.clean_cell, {" 板\nplate ": "板", "a_x000D_b": "a", None: ""})
    check(spark, X.norm_text, {"A_x000d_B\r\n C": "ab c"})


def test_scores(spark):
    check(spark, X.score_part, {"AB-12": 0.8, "AB12": 0.6, "123456": 0.3, "零件号": 0.1, "板A1-": 0.5, "ab": 0.0, None: 0.0})
    check(spark, X.score_name, {"零件名称": 0.5, "Болт крепёжный": 0.6, "AB12": 0.1, "bolt": 0.3, "x": 0.0})
    check(spark, X.score_qty, {"2": 0.9, "2,5": 0.9, "2pcs": 0.85, "S": 0.2, "-": 0.2, "abc": 0.0, "1e3": 0.9})


def test_card_number(spark):
    check(
        spark,
        X.card_number,
        {
            "SQRT1L-17-AS-04001 20点扫描.xlsx": "SQRT1L-17-AS-04001",
            "/path/to/SSQRT1L-17-AS-04001.xlsx": "SQRT1L-17-AS-04001",
            "TP-0123.xlsx": "TP-0123",
            "A123.xlsx": "A123",
            "038-Установка двери.xlsx": "038",
            "процесс.xlsx": "процесс",
            "процесс 5 - сборка.xlsx": "процесс 5",
            "card 123.xlsx": "card 123",
            "AB12-something.xlsx": "AB12",
            "CD34_test.xlsx": "CD34",
        },
    )
    check(spark, X.format_group, {"ABC-AS-001.xlsx": "ABC-AS-", "card12.xlsx": "card", "123.xlsx": "123", "x.xlsx": "x"})


def test_file_names(spark):
    check(
        spark,
        X.safe_filename,
        {'a<b>:"c': "a_b_c", "★ a ..b ": "a_b", "操作/1": "操作_1", "__x__": "x"},
    )
    long = "操" * 80 + ".xlsx"
    (got,) = column(spark, X.safe_name, [long])
    assert len(got.encode()) <= 200 and got.endswith(".xlsx") and got.startswith("操")
    assert column(spark, X.safe_name, ["short.xlsx"]) == ["short.xlsx"]


def test_labels_and_percent(spark):
    check(spark, lambda c: X.short_label(c, 52), {"a" * 52: "a" * 52, "b" * 53: "b" * 49 + "..."})
    row = spark.range(1).select(
        X.percent(F.lit(1), F.lit(0), F.lit(8)).alias("a"), X.percent(F.lit(0), F.lit(0), F.lit(0)).alias("b"), X.percent(F.lit(1), F.lit(1), F.lit(3)).alias("c")
    ).first()
    assert (row.a, row.b, row.c) == (12.5, 0.0, 66.7)


@pytest.mark.parametrize(
    "marker,qty,has,want",
    [("S", "4", True, 4.0), (" s ", "4", True, 4.0), ("S", "4", False, 0.0), ("-", "4", True, None), ("", "4", True, None), ("2,5", "4", True, 2.5), (None, "4", True, None)],
)
def test_decode(spark, marker, qty, has, want):
    row = spark.createDataFrame([(marker, qty)], "m string, q string").select(X.decode_config_cell("m", "q", has)).first()
    assert row[0] == want


def test_false_part_header(spark):
    check(spark, X.false_part_header, {"更改文件号件号": True, "件号": False, "件号更改": False, "零件": False})
