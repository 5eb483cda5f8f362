"""Queries: reading workbooks, whole jobs, sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..operators import bom as BM
from ..operators import mapping as M
from ..operators import totals as A
from ..session import checkpoint_dir, cut
from ..sources import materials as MT
from ..sources import workbook as WB
from . import bindings as B
from . import jobs as J
from . import oracle as O
from . import workbooks as W
from .queries_grid import BASE, CONFIGS, MOVED
from .queries_tables import EXTRACT
from .registry import query

CELLS = W.sql()
SH = "file_id, sheet_idx"


def _scratch(spark):
    return f"{checkpoint_dir(spark)}/kittally-{uuid.uuid4().hex}"


@query("ingest_cells", f"WITH {CELLS} SELECT file_id || '.xlsx' AS file_id, sheet_idx, sheet, row, col, value, num, kind, strike FROM cells")
def ingest_cells(spark, sf):
    """Cells of workbooks packed as files and read back."""
    return WB.tables(WB.explode_files(W.packages(spark, sf)))["cells"]


@query("ingest_sheets", f"WITH {CELLS} SELECT file_id || '.xlsx' AS file_id, sheet_idx, sheet, max_row, max_col FROM extent")
def ingest_sheets(spark, sf):
    return WB.tables(WB.explode_files(W.packages(spark, sf)))["sheets"]


@query(
    "ingest_errors",
    f"""WITH {CELLS}, f AS (SELECT DISTINCT file_id || '.xlsx' AS file_id FROM cells) SELECT file_id AS card_path, 'BadZipFile' AS error FROM f""",
)
def ingest_errors(spark, sf):
    """Cut-off files give one error row each and fail nothing."""
    cut_off = W.packages(spark, sf).withColumn("content", F.substring("content", 1, 100))
    errors = WB.tables(WB.explode_files(cut_off))["errors"]
    return errors.withColumn("error", F.substring_index("error", ":", 1))


def _part_sheets(spark, sf):
    """Layout of the part workbooks, as a mapping gives it."""
    columns = F.from_json(
        F.lit(json.dumps([{"col_index": 7 + i, "header": None} for i in range(len(W.TYPES))] + [{"col_index": 13, "header": "LHD\n1.5"}, {"col_index": 14}])),
        "array<struct<col_index:int,header:string>>",
    )
    return W.part_cells(spark, sf).select("file_id", "sheet_idx", "sheet").distinct().withColumns(
        {
            "header_row": F.lit(3), "data_start": F.lit(4), "part_col": F.lit(2), "name_cn_col": F.lit(3),
            "name_en_col": F.lit(4), "qty_col": F.lit(5), "config_columns": columns,
        }
    )


_rows = f"""c2 AS (SELECT * FROM cells WHERE file_id LIKE 'part-%' AND row >= 4),
  prow AS (SELECT p.file_id, p.sheet_idx, p.row, {O.clean_cell('p.value')} AS raw, n.value AS name_cn, e.value AS name_en, q.value AS qty_cell FROM c2 p
    LEFT JOIN c2 q ON q.file_id = p.file_id AND q.row = p.row AND q.col = 5 LEFT JOIN c2 n ON n.file_id = p.file_id AND n.row = p.row AND n.col = 3
    LEFT JOIN c2 e ON e.file_id = p.file_id AND e.row = p.row AND e.col = 4 WHERE p.col = 2 AND NOT p.strike AND NOT coalesce(q.strike, false)),
  brow AS (SELECT *, {O.part_key('raw')} AS part_key FROM prow WHERE {O.is_part('raw')})"""
_blines = f"""{_rows}, bline AS (SELECT b.*, m.col, CASE WHEN m.col = 13 THEN 'LHD 1.5' WHEN m.col = 14 THEN 'Config_14' ELSE h.value END AS config,
    m.value AS marker FROM brow b JOIN c2 m ON m.file_id = b.file_id AND m.row = b.row AND m.col BETWEEN 7 AND 14 AND NOT m.strike
    LEFT JOIN (SELECT file_id, col, value FROM cells WHERE file_id LIKE 'part-%' AND row = 3) h ON h.file_id = m.file_id AND h.col = m.col),
  bdec AS (SELECT *, {O.decode('marker', 'qty_cell', 'true')} AS qty FROM bline)"""


@query("bom_rows", f"WITH {CELLS}, {_rows} SELECT {SH}, row, raw, part_key, name_cn, name_en, qty_cell FROM brow")
def bom_rows(spark, sf):
    rows = BM.bom_rows(W.part_cells(spark, sf), _part_sheets(spark, sf))
    return rows.select("file_id", "sheet_idx", "row", "raw", "part_key", "name_cn", "name_en", "qty_cell")


@query("bom_matrix_lines", f"WITH {CELLS}, {_blines} SELECT {SH}, row, col, config, marker, part_key FROM bdec")
def bom_matrix_lines(spark, sf):
    lines = BM.bom_lines(W.part_cells(spark, sf), _part_sheets(spark, sf))
    return lines.select("file_id", "sheet_idx", "ord.row", "ord.col", "config", "marker", "part_key")


@query("bom_from_workbooks", f"WITH {CELLS}, {_blines} SELECT config, part_key, sum(qty) AS qty FROM bdec WHERE qty > 0 GROUP BY ALL")
def bom_from_workbooks(spark, sf):
    return A.bom_quantities(BM.bom_lines(W.part_cells(spark, sf), _part_sheets(spark, sf)))


@query(
    "config_names",
    f"WITH {CELLS}, {_blines} SELECT config, arg_min(row, row * 1000 + col) AS row, arg_min(col, row * 1000 + col) AS col FROM bdec WHERE qty > 0 AND file_id = (SELECT min(file_id) FROM bdec d WHERE d.config = bdec.config AND d.qty > 0) GROUP BY 1",
)
def config_names(spark, sf):
    cells, sheets = W.part_cells(spark, sf), _part_sheets(spark, sf)
    return BM.config_names(BM.bom_lines(cells, sheets), sheets).select("config", "ord.row", "ord.col")


JOB_RULES = {"operational_card_patterns": [{"type": "filename_regex", "pattern": "^ord", "format_group": "orders"}]}
JOB_MAPPING = {
    "bom": {
        "sheets": [
            {
                "sheet_name": "总装BOM", "sheet_type": "bom_data", "header_rows": [3],
                "columns": {
                    "part_no": {"col_index": 2}, "name_cn": 3, "name_en": {"col_index": 4}, "qty": 5,
                    "config_columns": [{"col_index": 7 + i} for i in range(6)] + [{"col_index": 13, "header": "LHD 1.5"}],
                },
                "layout": {"type": "single_table"},
            }
        ]
    },
    "cards": {"formats": {"orders": {"sheets": [{"columns": {"part_no": 1, "name_cn": 2, "qty": 3}, "data_start_row": 1}], "end_markers": ["签字"]}}},
}


def _mapping_job(spark, sf):
    bom_cells, card_cells = cut(W.part_cells(spark, sf)), cut(W.order_cells(spark, sf))
    mapped = M.read_mapping(bom_cells.select("file_id").distinct().withColumn("mapping_config", F.lit(json.dumps(JOB_MAPPING))))
    return J.run_by_mapping(bom_cells, card_cells, mapped, JOB_RULES)


_joblines = f"""{_blines}, jq AS (SELECT config, part_key AS part, sum(qty) AS qty FROM bdec WHERE qty > 0 AND col < 14 GROUP BY ALL),
  jm AS (SELECT * FROM cells WHERE file_id LIKE 'ord-%'),
  jstop AS (SELECT file_id, min(row) AS stop FROM (SELECT file_id, row FROM jm WHERE col = 1 AND contains(value, '签字') UNION ALL
      SELECT file_id, row FROM jm WHERE col = 2 AND contains(value, '签字') AND (file_id, row) NOT IN (SELECT (file_id, row) FROM jm WHERE col = 1)
      UNION ALL SELECT file_id, row FROM (SELECT s.file_id, s.row, count(*) FILTER (p.row IS NULL) OVER (PARTITION BY s.file_id ORDER BY s.row ROWS 2 PRECEDING) AS k
        FROM (SELECT file_id, unnest(range(1, max_row + 1))::INT AS row FROM extent WHERE file_id LIKE 'ord-%') s LEFT JOIN (SELECT file_id, row FROM jm WHERE col = 1) p ON p.file_id = s.file_id AND p.row = s.row) WHERE k = 3) GROUP BY 1),
  jl AS (SELECT p.file_id, {O.part_key('p.value')} AS part, greatest(coalesce(CASE q.kind WHEN 'n' THEN q.num WHEN 's' THEN {O.quantity('q.value')} END, 0), 0)::DOUBLE AS qty FROM jm p
    LEFT JOIN jm q ON q.file_id = p.file_id AND q.row = p.row AND q.col = 3 LEFT JOIN jstop s ON s.file_id = p.file_id WHERE p.col = 1 AND (stop IS NULL OR p.row < stop) AND NOT p.strike),
  {EXTRACT.replace("contains(value, '签字')", "false")},
  jall AS (SELECT part, qty FROM jl WHERE {O.is_part('part')} UNION ALL SELECT part_key, qty FROM extracted WHERE file_id LIKE 'ord-%' AND file_id NOT IN (SELECT file_id FROM jl WHERE {O.is_part('part')})),
  bom AS (SELECT config, part, qty FROM jq), cards AS (SELECT part, sum(qty) AS qty FROM jall GROUP BY 1), configs AS (SELECT DISTINCT config FROM bom)"""


@query(
    "mapping_job",
    f"WITH {CELLS}, {_joblines}, {O.outcomes(fuzzy=False)} SELECT outcome, count(*) AS n FROM outcomes WHERE outcome <> 'matched' GROUP BY 1",
)
def mapping_job(spark, sf):
    """Mapping job over part and order workbooks, discrepancies by type."""
    return _mapping_job(spark, sf)["totals"]


@query(
    "mapping_job_integrity",
    f"""WITH {CELLS}, {_joblines}, {O.outcomes(fuzzy=False)}, {O.SUMMARY} SELECT config, total_bom_parts, matched + only_in_bom + qty_mismatch AS accounted, 0::BIGINT AS diff, true AS is_ok,
    matched, only_in_bom, qty_mismatch, fuzzy_match FROM summary""",
)
def mapping_job_integrity(spark, sf):
    return _mapping_job(spark, sf)["integrity"]


@query(
    "detection_job_cards",
    f"""WITH {CELLS}, {EXTRACT.replace("contains(value, '签字')", "false")} SELECT part_key, sum(qty) AS qty FROM extracted WHERE file_id LIKE 'ord-%' GROUP BY 1""",
)
def detection_job_cards(spark, sf):
    """Card totals of the detection job over the order workbooks."""
    return A.card_totals(J.cards_by_detection(cut(W.order_cells(spark, sf)))).select("part_key", "qty")


_detected = f"""{CONFIGS}, bcol AS (SELECT c.file_id, c.col, coalesce(nullif({O.strip("replace(h.value, chr(10), ' ')")}, ''), 'Config_' || c.col::VARCHAR) AS config
    FROM configs c JOIN span s ON s.file_id = c.file_id LEFT JOIN cells h ON h.file_id = c.file_id AND h.row = s.header_row AND h.col = c.col WHERE c.file_id LIKE 'part-%'),
  bl AS (SELECT p.file_id, b.config, {O.part_key(O.clean_cell('p.value'))} AS part, {O.decode('m.value', 'q.value', 'true')} AS qty
    FROM cells p JOIN roles r ON r.file_id = p.file_id AND p.col = r.part_no JOIN span s ON s.file_id = p.file_id AND p.row >= s.data_start
    LEFT JOIN cells q ON q.file_id = p.file_id AND q.row = p.row AND q.col = r.qty
    JOIN bcol b ON b.file_id = p.file_id JOIN cells m ON m.file_id = p.file_id AND m.row = p.row AND m.col = b.col AND NOT m.strike
    WHERE p.file_id LIKE 'part-%' AND NOT p.strike AND NOT coalesce(q.strike, false) AND {O.is_part(O.clean_cell('p.value'))}),
  {EXTRACT.replace("contains(value, '签字')", "false")},
  bom AS (SELECT config, part, sum(qty) AS qty FROM bl WHERE qty > 0 GROUP BY 1, 2),
  cards AS (SELECT part_key AS part, sum(qty) AS qty FROM extracted WHERE file_id LIKE 'ord-%' GROUP BY 1), configs_j AS (SELECT DISTINCT config FROM bom)"""


@query(
    "detection_job",
    f"""{BASE}, {MOVED}, {_detected}, {O.outcomes(fuzzy=False).replace("FROM configs f", "FROM configs_j f")}, {O.SUMMARY}
    SELECT {O.short_label('config', 52)} AS config_label, config, total_bom_parts, total_cards_parts, matched, discrepancies, only_in_bom, only_in_cards, qty_mismatch FROM summary""",
)
def detection_job(spark, sf):
    """Detection job over part and order workbooks, summary per configuration."""
    return J.run_by_detection(cut(W.part_cells(spark, sf)), cut(W.order_cells(spark, sf)))["per_config"]


MATERIALS = f"""WITH {O.CARD_LINES} SELECT card_no, sheet AS sheet_name, substr(ord, 10, 12)::INT AS row_index, raw AS part_no, name_ru AS name_cn, name_ru, quantity AS qty FROM card_lines"""


def _materials(spark, sf):
    lines = B.card_lines(spark, sf).drop("qty").withColumnsRenamed({"quantity": "qty"})
    return MT.materials(lines.withColumns({"row": F.substring("ord", 10, 12).cast("int"), "name_cn": F.col("name_ru")}))


@query("materials_round_trip", MATERIALS)
def materials_round_trip(spark, sf):
    """Part lines written as material records and read back."""
    path = f"{_scratch(spark)}/materials"
    MT.write_materials(_materials(spark, sf), path)
    return MT.read_materials(spark, path, arrays=False).drop("path", "ord")


@query("errors_round_trip", "SELECT url AS card_path, 'unclosed tag' AS error FROM pages")
def errors_round_trip(spark, sf):
    path = f"{_scratch(spark)}/errors"
    pages = B.table(spark, sf, "pages")
    MT.write_errors(pages.select(F.col("url").alias("card_path"), F.lit("unclosed tag").alias("error")), path)
    return spark.read.schema("card_path string, error string").json(path)


@query("report_round_trip", f"WITH {O.CARD_LINES} SELECT card_no, part_key, sum(quantity) AS qty FROM card_lines GROUP BY 1, 2")
def report_round_trip(spark, sf):
    path = f"{_scratch(spark)}/report"
    totals = A.card_part_totals(B.card_lines(spark, sf).drop("qty").withColumnRenamed("quantity", "qty"))
    MT.write_report({"card_totals": totals}, path)
    return spark.read.parquet(f"{path}/card_totals")
