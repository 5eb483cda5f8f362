import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from kittally.session import build_session

    session = build_session(
        "local[8]",
        "kittally-tests",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


CELL = "file_id string, sheet_idx int, sheet string, row int, col int, value string, num double, kind string, strike boolean"


@pytest.fixture(scope="session")
def make_cells(spark):
    """Cells from {(file, sheet name): {(row, col): value}}; a value may be (value, 'strike')."""

    def build(sheets):
        order = {}
        rows = []
        for (file, sheet), grid in sheets.items():
            idx = order.setdefault(file, [])
            idx.append(sheet)
            for (r, c), v in grid.items():
                struck = isinstance(v, tuple)
                v = v[0] if struck else v
                if v is None:
                    continue
                if isinstance(v, bool):
                    text, num, kind = str(v), float(v), "b"
                elif isinstance(v, (int, float)):
                    text, num, kind = str(v), float(v), "n"
                else:
                    text, num, kind = v, None, "s"
                rows.append((file, len(idx) - 1, sheet, r, c, text, num, kind, struck))
        return spark.createDataFrame(rows, CELL)

    return build


def grid(rows, first=1):
    """{(row, col): value} from lists of row values."""
    return {(r, c): v for r, row in enumerate(rows, first) for c, v in enumerate(row, 1) if v is not None}
