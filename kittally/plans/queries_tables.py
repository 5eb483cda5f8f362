"""Queries: table extraction and boundaries, classification, mappings, quality, progress."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import text as X
from ..operators import classify as C
from ..operators import grid as G
from ..operators import mapping as M
from ..operators import quality as Q
from ..operators import tables as T
from ..session import checkpoint_dir, cut
from ..sources import materials as MT
from ..streaming import jobs_state as JS
from ..streaming import progress as S
from ..streaming import snapshot as SN
from . import bindings as B
from . import oracle as O
from . import workbooks as W
from .queries_grid import AUTO_CARD, OFFERED
from .registry import query

SH = "file_id, sheet_idx"
CELLS = W.sql()
_v = f"lower({O.strip('value')})"
_hit = f"({O.any_of('v', [w for w in K.PART_NO if w != K.FALSE_PART_WORD])} OR (contains(v, '{K.FALSE_PART_WORD}') AND NOT {O.false_part('v')}))"
_rank = "CASE " + " ".join(
    f"WHEN contains(v, {O.lit(w)}){' AND NOT ' + O.false_part('v') if w == K.FALSE_PART_WORD else ''} THEN {i}" for i, w in enumerate(K.PART_NO)
) + " END"

# --- headers of parts tables -------------------------------------------------

CANDIDATES = f"""tv AS (SELECT *, {_v} AS v FROM cells WHERE col <= 200),
  tk AS (SELECT *, {_hit} AS hit, CASE WHEN length(v) < 50 THEN {_rank} END AS rnk, {O.any_of('v', K.QTY)} AS q, {O.any_of('v', K.NAME)} AS n,
    {O.any_of('v', K.QTY_ANTI)} AS qa, {O.any_of('v', K.NAME_ANTI)} AS na FROM tv WHERE v <> ''),
  tr AS (SELECT {SH}, row, count(*) AS filled, bool_or(hit) AS has_part, arg_min(col, rnk * 1000 + col) FILTER (rnk IS NOT NULL) AS part_col,
    min(col) FILTER (q AND NOT qa) AS qh, min(col) FILTER (n AND NOT na) AS nh, min(col) FILTER (q AND col < 200) AS qn, min(col) FILTER (n AND col < 200) AS nn FROM tk GROUP BY {SH}, row),
  heads AS (SELECT * FROM tr WHERE filled >= 2 AND has_part AND part_col IS NOT NULL),
  near AS (SELECT h.file_id, h.sheet_idx, h.row AS header_row, r.row - h.row AS off, r.has_part, r.qn, r.nn FROM heads h JOIN tr r ON r.file_id = h.file_id AND r.sheet_idx = h.sheet_idx
    AND r.row BETWEEN h.row - 5 AND h.row + 10 AND r.row <> h.row),
  barrier AS (SELECT {SH}, header_row, coalesce(min(off) FILTER (off > 0 AND has_part), 11) AS stop FROM near GROUP BY ALL),
  far AS (SELECT {SH}, header_row, coalesce(arg_min(qn, off) FILTER (off > 0 AND off < stop AND qn IS NOT NULL), arg_max(qn, off) FILTER (off < 0 AND NOT has_part AND qn IS NOT NULL)) AS qf,
    coalesce(arg_min(nn, off) FILTER (off > 0 AND off < stop AND nn IS NOT NULL), arg_max(nn, off) FILTER (off < 0 AND NOT has_part AND nn IS NOT NULL)) AS nf
    FROM near JOIN barrier USING (file_id, sheet_idx, header_row) GROUP BY ALL),
  candidates AS (SELECT h.file_id, h.sheet_idx, h.row AS header_row, part_col, coalesce(qh, qf, 0) AS qty_col, coalesce(nh, nf, 0) AS name_col
    FROM heads h LEFT JOIN far f ON f.file_id = h.file_id AND f.sheet_idx = h.sheet_idx AND f.header_row = h.row)"""


@query("table_candidates", f"WITH {CELLS}, {CANDIDATES} SELECT * FROM candidates")
def table_candidates(spark, sf):
    return T.table_candidates(W.stored_cells(spark, sf))


@query(
    "locate_table",
    f"WITH {CELLS}, {CANDIDATES} SELECT * FROM candidates c WHERE header_row = (SELECT min(header_row) FROM candidates d WHERE d.file_id = c.file_id AND d.sheet_idx = c.sheet_idx)",
)
def locate_table(spark, sf):
    return T.locate_table(W.stored_cells(spark, sf))


# --- plain card sheets -------------------------------------------------------

GUARDED = f"""{AUTO_CARD}, guarded AS (SELECT e.*, a.data_start, a.part_col, a.qty_col, a.name_col, greatest(part_col, qty_col, name_col) > max_col AS skipped
  FROM extent e JOIN auto_card a USING (file_id) WHERE max_row >= 2 AND max_col >= 2)"""
EXTRACT = f"""{GUARDED}, g AS (SELECT * FROM guarded WHERE NOT skipped),
  pc AS (SELECT c.* FROM cells c JOIN g ON c.file_id = g.file_id AND c.sheet_idx = g.sheet_idx AND c.col = g.part_col AND c.row >= g.data_start),
  qc AS (SELECT c.* FROM cells c JOIN g ON c.file_id = g.file_id AND c.sheet_idx = g.sheet_idx AND c.col = g.qty_col AND c.row >= g.data_start),
  nc AS (SELECT c.* FROM cells c JOIN g ON c.file_id = g.file_id AND c.sheet_idx = g.sheet_idx AND c.col = g.name_col AND c.row >= g.data_start),
  marks AS (SELECT {SH}, row FROM pc WHERE contains(value, '签字')
    UNION ALL SELECT {SH}, row FROM nc WHERE contains(value, '签字') AND (file_id, sheet_idx, row) NOT IN (SELECT (file_id, sheet_idx, row) FROM pc)),
  spine AS (SELECT {SH}, unnest(range(data_start, max_row + 1))::INT AS row FROM g),
  filledflag AS (SELECT s.*, p.row IS NOT NULL AS has FROM spine s LEFT JOIN (SELECT DISTINCT {SH}, row FROM pc) p USING (file_id, sheet_idx, row)),
  runs AS (SELECT {SH}, row FROM (SELECT {SH}, row, count(*) FILTER (NOT has) OVER (PARTITION BY {SH} ORDER BY row ROWS 2 PRECEDING) AS k FROM filledflag) WHERE k = 3),
  stops AS (SELECT {SH}, min(row) AS stop FROM (SELECT * FROM marks UNION ALL SELECT * FROM runs) GROUP BY ALL),
  lines AS (SELECT p.file_id, p.sheet_idx, p.sheet, p.row, {O.strip('p.value')} AS raw, {O.part_key(O.strip('p.value'))} AS part_key,
    greatest(coalesce(CASE q.kind WHEN 'n' THEN q.num WHEN 's' THEN {O.quantity('q.value')} END, 0.0), 0.0)::DOUBLE AS qty, coalesce({O.strip('n.value')}, '') AS name_cn
    FROM pc p LEFT JOIN qc q USING (file_id, sheet_idx, row) LEFT JOIN nc n USING (file_id, sheet_idx, row) LEFT JOIN stops s USING (file_id, sheet_idx)
    WHERE (stop IS NULL OR p.row < stop) AND NOT p.strike AND NOT coalesce(q.strike, false)),
  extracted AS (SELECT * FROM lines WHERE raw <> '' AND {O.is_part('part_key')})"""


def _layout(spark, sf):
    cells = W.stored_cells(spark, sf)
    return cells, G.auto_card_cols(cells).withColumn("end_markers", F.array(F.lit("签字")))


@query("guard_sheets", f"WITH {CELLS}, {GUARDED} SELECT {SH}, skipped, part_col, max_row FROM guarded")
def guard_sheets(spark, sf):
    cells, layout = _layout(spark, sf)
    return T.guard_sheets(G.sheet_extent(cells), layout).select("file_id", "sheet_idx", "skipped", "part_col", "max_row")


@query("stop_rows", f"WITH {CELLS}, {EXTRACT} SELECT * FROM stops")
def stop_rows(spark, sf):
    cells, layout = _layout(spark, sf)
    guarded = cut(T.guard_sheets(G.sheet_extent(cells), layout))
    return T.stop_rows(cut(T.layout_rows(cells, guarded)), guarded)


@query("extract_table", f"WITH {CELLS}, {EXTRACT} SELECT * FROM extracted")
def extract_table(spark, sf):
    return T.extract_table(*_layout(spark, sf))


@query(
    "extraction_errors",
    f"""WITH {CELLS}, {EXTRACT}, f AS (SELECT file_id, max(n) AS n FROM (SELECT {SH}, count(DISTINCT row) AS n FROM cells
      WHERE row <= 100 AND col <= 20 AND (kind <> 's' OR {O.strip('value')} <> '') GROUP BY ALL) GROUP BY 1),
    s AS (SELECT file_id, bool_or(skipped) AS sk FROM guarded GROUP BY 1)
    SELECT * FROM (SELECT file_id, CASE WHEN coalesce(sk, false) THEN 'Column indices out of range for some sheets, trying auto-detect'
      WHEN n >= 10 THEN 'No parts extracted from non-empty worksheet. Check mapping config columns.' END AS error
    FROM auto_card LEFT JOIN s USING (file_id) LEFT JOIN f USING (file_id) WHERE file_id NOT IN (SELECT file_id FROM extracted)) WHERE error IS NOT NULL""",
)
def extraction_errors(spark, sf):
    cells, layout = _layout(spark, sf)
    return T.extraction_errors(cells, layout, T.extract_table(cells, layout))


# --- stacked cards -----------------------------------------------------------

_heads = ", ".join(O.lit(h) for h in K.STACKED_HEADER)
STACKED = f"""{GUARDED}, sf AS (SELECT c.file_id, c.sheet_idx, c.row, g.data_start, g.max_row,
    bool_or({O.strip('value')} <> '') AS filled, bool_or(col = part_col AND {O.strip('value')} IN ({_heads})) AS head,
    bool_or(contains(value, '签字')) AS mark, bool_or(col = part_col AND contains(value, '签字')) AS pmark
    FROM cells c JOIN guarded g ON c.file_id = g.file_id AND c.sheet_idx = g.sheet_idx AND c.col IN (g.part_col, g.name_col) AND NOT g.skipped AND c.row >= g.data_start GROUP BY ALL),
  fl AS (SELECT * FROM sf WHERE filled),
  gp AS (SELECT g.file_id, g.sheet_idx, r.row, NOT EXISTS (SELECT 1 FROM fl WHERE fl.file_id = g.file_id AND fl.sheet_idx = g.sheet_idx AND fl.row = r.row) AS empty
    FROM guarded g, LATERAL (SELECT unnest(range(g.data_start, g.max_row + 1))::INT AS row) r WHERE NOT g.skipped),
  e2 AS (SELECT a.file_id, a.sheet_idx, a.row AS first_empty FROM gp a JOIN gp b ON a.file_id = b.file_id AND a.sheet_idx = b.sheet_idx AND b.row = a.row + 1 WHERE a.empty AND b.empty),
  step AS (SELECT f.file_id, f.sheet_idx, f.row AS start_row, f.max_row,
    coalesce((SELECT min(h.row) FROM fl h WHERE h.head AND h.file_id = f.file_id AND h.sheet_idx = f.sheet_idx AND h.row BETWEEN f.row AND f.row + 49), f.row) + 1 AS data_start FROM fl f),
  ended AS (SELECT s.*, least(coalesce((SELECT min(m.row) - 1 FROM fl m WHERE m.mark AND m.file_id = s.file_id AND m.sheet_idx = s.sheet_idx AND m.row >= s.data_start), max_row),
    coalesce((SELECT min(e.first_empty) - 1 FROM e2 e WHERE e.file_id = s.file_id AND e.sheet_idx = s.sheet_idx AND e.first_empty >= s.data_start), max_row)) AS end_row FROM step s),
  links AS (SELECT e.*, greatest(end_row + 1, start_row + 1) + CASE WHEN EXISTS (SELECT 1 FROM fl p WHERE p.pmark AND p.file_id = e.file_id AND p.sheet_idx = e.sheet_idx
      AND p.row = greatest(end_row + 1, start_row + 1)) THEN 1 ELSE 0 END AS at_row FROM ended e),
  nxt AS (SELECT l.*, (SELECT min(f.row) FROM fl f WHERE f.file_id = l.file_id AND f.sheet_idx = l.sheet_idx AND f.row >= l.at_row) AS next_start FROM links l),
  walk AS (SELECT n.*, 1 AS card_idx FROM nxt n WHERE start_row = (SELECT min(row) FROM fl f WHERE f.file_id = n.file_id AND f.sheet_idx = n.sheet_idx)
    UNION ALL SELECT n.*, w.card_idx + 1 FROM walk w JOIN nxt n ON n.file_id = w.file_id AND n.sheet_idx = w.sheet_idx AND n.start_row = w.next_start),
  bounds AS (SELECT {SH}, card_idx, start_row, data_start, end_row FROM walk)"""


def _bounds(spark, sf):
    cells, layout = _layout(spark, sf)
    return cells, layout, T.split_stacked(
        cells, layout.withColumns({"empty_rows": F.lit(2), "card_end_markers": F.array(F.lit("签字"))})
    )


@query("split_stacked", f"WITH RECURSIVE {CELLS}, {STACKED} SELECT * FROM bounds")
def split_stacked(spark, sf):
    return _bounds(spark, sf)[2]


STACKED_LINES = f"""all_lines AS (SELECT p.file_id, p.sheet_idx, p.sheet, p.row, {O.strip('p.value')} AS raw, {O.part_key(O.strip('p.value'))} AS part_key,
    greatest(coalesce(CASE q.kind WHEN 'n' THEN q.num WHEN 's' THEN {O.quantity('q.value')} END, 0.0), 0.0)::DOUBLE AS qty, coalesce({O.strip('n.value')}, '') AS name_cn
    FROM guarded g JOIN cells p ON p.file_id = g.file_id AND p.sheet_idx = g.sheet_idx AND p.col = g.part_col AND p.row >= g.data_start AND NOT g.skipped AND NOT p.strike
    LEFT JOIN cells q ON q.file_id = p.file_id AND q.sheet_idx = p.sheet_idx AND q.row = p.row AND q.col = g.qty_col
    LEFT JOIN cells n ON n.file_id = p.file_id AND n.sheet_idx = p.sheet_idx AND n.row = p.row AND n.col = g.name_col WHERE NOT coalesce(q.strike, false)),
  usable AS (SELECT * FROM all_lines WHERE raw <> '' AND {O.is_part('part_key')})"""


@query(
    "assign_cards",
    f"""WITH RECURSIVE {CELLS}, {STACKED}, {STACKED_LINES}
    SELECT {SH}, row, raw, coalesce((SELECT min(card_idx) FROM bounds b WHERE b.file_id = u.file_id AND b.sheet_idx = u.sheet_idx AND u.row BETWEEN start_row AND end_row),
      (SELECT max(card_idx) FROM bounds b WHERE b.file_id = u.file_id)) AS card_idx FROM usable u""",
)
def assign_cards(spark, sf):
    cells, layout, bounds = _bounds(spark, sf)
    rows = T.layout_rows(cells, T.guard_sheets(G.sheet_extent(cells), layout))
    return T.assign_cards(T.part_lines(rows), cut(bounds)).select("file_id", "sheet_idx", "row", "raw", "card_idx")


@query(
    "stacked_lines",
    f"""WITH RECURSIVE {CELLS}, {STACKED}, {STACKED_LINES} SELECT u.*, b.card_idx FROM usable u JOIN bounds b ON b.file_id = u.file_id AND b.sheet_idx = u.sheet_idx AND u.row BETWEEN b.data_start AND b.end_row""",
)
def stacked_lines(spark, sf):
    cells, layout, bounds = _bounds(spark, sf)
    return T.stacked_lines(cells, layout, cut(bounds))


# --- boundaries --------------------------------------------------------------


def _steady(marks: str, tolerance: str, share: float, name: str) -> str:
    return f"""{name}_g AS (SELECT {SH}, following - row AS gap FROM {marks} WHERE following IS NOT NULL),
  {name}_m AS (SELECT {SH}, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS median FROM {name}_g GROUP BY ALL),
  {name} AS (SELECT {SH} FROM {name}_g JOIN {name}_m USING (file_id, sheet_idx) GROUP BY ALL HAVING count(*) FILTER (abs(gap - median) <= {tolerance}) >= count(*) * {share})"""


MARKER = f"""mm AS (SELECT *, lead(row) OVER (PARTITION BY {SH} ORDER BY row) AS following FROM (SELECT DISTINCT {SH}, row, max_row FROM cells
    JOIN extent USING (file_id, sheet_idx) WHERE max_row >= 10 AND col <= 9 AND contains(value, '{K.MAKER_MARK}'))),
  {_steady('mm', '5', 0.6, 'msteady')},
  mname AS (SELECT {SH}, row, arg_min({O.strip('value')}, col) AS operation_name FROM cells WHERE col BETWEEN 2 AND 9 AND length({O.strip('value')}) > 2
    AND {O.rx('value', r'[\x{4e00}-\x{9fff}]')} GROUP BY ALL),
  marker AS (SELECT {SH}, row AS header_row, row + 1 AS data_start, coalesce(following - 1, max_row) AS data_end, coalesce(operation_name, '') AS operation_name
    FROM mm JOIN msteady USING (file_id, sheet_idx) LEFT JOIN mname USING (file_id, sheet_idx, row))"""
INSPECTION = f"""im AS (SELECT *, lead(row) OVER (PARTITION BY {SH} ORDER BY row) AS following FROM (SELECT DISTINCT {SH}, row, max_row FROM cells
    JOIN extent USING (file_id, sheet_idx) WHERE max_row >= 3 AND col = 2 AND contains(value, '{K.INSPECTION_HEADER}'))),
  {_steady('im', '3', 0.5, 'isteady')},
  ib AS (SELECT im.*, coalesce((SELECT min(t.row) FROM cells t WHERE t.file_id = im.file_id AND t.sheet_idx = im.sheet_idx AND t.col = 4 AND t.row BETWEEN im.row - 5 AND im.row - 1
    AND {O.any_of('t.value', K.INSPECTION_TITLE)}), im.row) AS title FROM im JOIN isteady USING (file_id, sheet_idx)),
  inspection AS (SELECT b.file_id, b.sheet_idx, title AS header_row, b.row AS data_start, coalesce(lead(title) OVER (PARTITION BY b.file_id, b.sheet_idx ORDER BY b.row) - 1, max_row) AS data_end,
    coalesce({O.strip('d.value')}, '') AS operation_name FROM ib b LEFT JOIN cells d ON d.file_id = b.file_id AND d.sheet_idx = b.sheet_idx AND d.row = b.row AND d.col = 4)"""
_same = "s.file_id = c.file_id AND s.sheet_idx = c.sheet_idx"
TABLE_END = f"""rs AS (SELECT {SH}, row, count(*) AS filled, bool_or(length({_v}) < 50 AND {O.any_of(_v, K.PART_NO)}) AS keyed, bool_or({O.rx('value', X.CJK)}) AS cjk FROM cells WHERE col < 200 GROUP BY ALL),
  pf AS (SELECT {SH}, col AS part_col, row FROM cells WHERE kind <> 's' OR {O.strip('value')} <> ''),
  gaps AS (SELECT {SH}, row, coalesce(lead(row) OVER (PARTITION BY {SH} ORDER BY row), max_row + 1) AS nf FROM rs JOIN extent USING (file_id, sheet_idx)),
  tstop AS (SELECT c.*, e.max_row, e.max_row AS lim,
    (SELECT min(s.row) FROM rs s WHERE {_same} AND s.row > c.header_row AND s.filled >= 2 AND s.keyed) AS a,
    (SELECT min(s.row) FROM rs s WHERE {_same} AND s.row > c.header_row AND s.cjk AND NOT EXISTS (SELECT 1 FROM pf p WHERE p.file_id = c.file_id AND p.sheet_idx = c.sheet_idx AND p.part_col = c.part_col AND p.row = s.row)
      AND ((s.row < e.max_row AND NOT EXISTS (SELECT 1 FROM pf p WHERE p.file_id = c.file_id AND p.sheet_idx = c.sheet_idx AND p.part_col = c.part_col AND p.row = s.row + 1)) OR s.row - c.header_row > 3)) AS b,
    (SELECT min(s.row) FROM gaps s WHERE {_same} AND s.row >= c.header_row AND s.nf - s.row >= 6) AS g
    FROM candidates c JOIN extent e ON e.file_id = c.file_id AND e.sheet_idx = c.sheet_idx),
  ended_t AS (SELECT {SH}, header_row, part_col, qty_col, name_col,
    CASE WHEN least(coalesce(a, 1000000000), coalesce(b, 1000000000), coalesce(g + 5, 1000000000)) > lim THEN lim
         WHEN least(coalesce(a, 1000000000), coalesce(b, 1000000000)) - 1 <= coalesce(g, 1000000000) AND least(coalesce(a, 1000000000), coalesce(b, 1000000000)) <= coalesce(g + 5, 1000000000) THEN least(coalesce(a, 1000000000), coalesce(b, 1000000000)) - 1
         WHEN least(coalesce(a, 1000000000), coalesce(b, 1000000000)) <= coalesce(g + 5, 1000000000) THEN CASE WHEN least(coalesce(a, 1000000000), coalesce(b, 1000000000)) = g + 5 THEN g ELSE least(coalesce(a, 1000000000), coalesce(b, 1000000000)) - 1 END
         ELSE g END::INT AS data_end FROM tstop)"""
CONFIDENCE = f"""ch AS (SELECT t.file_id, t.sheet_idx, t.header_row, count(*) AS hf, sum(CASE WHEN {O.any_of(_v, K.PART_NO)} THEN 1 ELSE 0 END + CASE WHEN qty_col > 0 AND {O.any_of(_v, K.QTY)} THEN 1 ELSE 0 END
      + CASE WHEN name_col > 0 AND {O.any_of(_v, K.NAME)} THEN 1 ELSE 0 END) AS hk FROM ended_t t JOIN cells c ON c.file_id = t.file_id AND c.sheet_idx = t.sheet_idx AND c.row = t.header_row AND c.col < 50
      AND (c.kind <> 's' OR {O.strip('c.value')} <> '') GROUP BY ALL),
  cb AS (SELECT t.file_id, t.sheet_idx, t.header_row, count(*) FILTER (kind <> 's' OR {O.strip('value')} <> '') AS parts, count(*) FILTER (row - t.header_row <= 29) AS seen,
      count(*) FILTER (row - t.header_row <= 29 AND {O.is_part('value')}) AS valid
      FROM ended_t t JOIN cells c ON c.file_id = t.file_id AND c.sheet_idx = t.sheet_idx AND c.col = t.part_col AND c.row BETWEEN t.header_row + 1 AND least(t.data_end, t.header_row + 49) GROUP BY ALL),
  confident AS (SELECT t.*, round(least(CASE WHEN coalesce(hf, 0) >= 3 THEN 0.2 WHEN coalesce(hf, 0) >= 2 THEN 0.1 ELSE 0.0 END::DOUBLE + least(coalesce(hk, 0) * 0.1::DOUBLE, 0.2::DOUBLE)
      + CASE WHEN t.data_end > t.header_row THEN coalesce(parts, 0)::DOUBLE / least(t.data_end - t.header_row, 49) * 0.3::DOUBLE ELSE 0 END
      + CASE WHEN coalesce(seen, 0) > 0 THEN valid::DOUBLE / seen * 0.3::DOUBLE ELSE 0 END, 1.0::DOUBLE), 6) AS confidence
    FROM ended_t t LEFT JOIN ch USING (file_id, sheet_idx, header_row) LEFT JOIN cb USING (file_id, sheet_idx, header_row))"""
BLOCKS = f"""bm AS (SELECT {SH}, row, max_row, bool_or(col <= 3 AND {O.rx('value', X.CJK)}) AS title, bool_or({O.strip('value')} <> '') AS data
    FROM cells JOIN extent USING (file_id, sheet_idx) WHERE col <= 8 AND max_row >= 20 GROUP BY ALL),
  bd AS (SELECT *, max(row) FILTER (NOT title) OVER w AS pd, max(row) FILTER (title) OVER w AS pt FROM bm WHERE title OR data
    WINDOW w AS (PARTITION BY {SH} ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  bi AS (SELECT *, sum(CASE WHEN pd IS NULL OR row - pd > 5 OR coalesce(pt > pd, false) THEN 1 ELSE 0 END) OVER (PARTITION BY {SH} ORDER BY row) AS island FROM bd WHERE NOT title),
  bg AS (SELECT {SH}, island, min(row) AS s, max(row) AS e, any_value(max_row) AS max_row FROM bi GROUP BY {SH}, island),
  bl AS (SELECT {SH}, max(island) AS li FROM bg GROUP BY ALL), bt AS (SELECT {SH}, max(row) FILTER (title) AS lt FROM bm GROUP BY ALL),
  bk AS (SELECT {SH}, s, CASE WHEN island = li AND NOT (coalesce(lt > e, false) OR max_row - e >= 5) THEN max_row ELSE e END AS e, row_number() OVER (PARTITION BY {SH} ORDER BY s)::INT AS nth FROM bg JOIN bl USING (file_id, sheet_idx) JOIN bt USING (file_id, sheet_idx)),
  bh AS (SELECT b.*, coalesce((SELECT min(c.row) FROM cells c WHERE c.file_id = b.file_id AND c.sheet_idx = b.sheet_idx AND c.col <= 11 AND c.row BETWEEN b.s - 5 AND b.s - 1 AND {O.any_of(f"lower({O.strip('c.value')})", K.PART_NO)}), b.s) AS header_row FROM bk b WHERE e - s >= 2),
  bn AS (SELECT {SH}, row, coalesce(arg_min({O.strip('value')}, col) FILTER (length({O.strip('value')}) > 3), arg_max({O.strip('value')}, col)) AS t FROM cells WHERE col <= 7 AND {O.rx('value', X.CJK)} GROUP BY ALL),
  blocks AS (SELECT {SH}, header_row, s AS data_start, e AS data_end, coalesce((SELECT arg_min(n.t, n.row) FROM bn n WHERE n.file_id = bh.file_id AND n.sheet_idx = bh.sheet_idx AND n.row BETWEEN bh.header_row - 3 AND bh.header_row - 1), '') AS operation_name, nth FROM bh)"""


@query("marker_bounds", f"WITH {CELLS}, {MARKER} SELECT * FROM marker")
def marker_bounds(spark, sf):
    return T.marker_bounds(W.stored_cells(spark, sf))


@query("inspection_bounds", f"WITH {CELLS}, {INSPECTION} SELECT * FROM inspection")
def inspection_bounds(spark, sf):
    return T.inspection_bounds(W.stored_cells(spark, sf))


@query("table_end", f"WITH {CELLS}, {CANDIDATES}, {TABLE_END} SELECT * FROM ended_t")
def table_end(spark, sf):
    cells = W.stored_cells(spark, sf)
    return T.table_end(cells, T.table_candidates(cells))


@query("bound_confidence", f"WITH {CELLS}, {CANDIDATES}, {TABLE_END}, {CONFIDENCE} SELECT * FROM confident")
def bound_confidence(spark, sf):
    cells = W.stored_cells(spark, sf)
    return T.bound_confidence(cells, cut(T.table_end(cells, T.table_candidates(cells))))


@query("block_bounds", f"WITH {CELLS}, {BLOCKS} SELECT * FROM blocks")
def block_bounds(spark, sf):
    return T.block_bounds(W.stored_cells(spark, sf))


@query(
    "snap_bounds",
    f"""WITH {CELLS}, {BLOCKS} SELECT {SH}, header_row, data_start, greatest(data_end, coalesce((SELECT min(n.header_row) - 1 FROM blocks n WHERE n.file_id = b.file_id AND n.sheet_idx = b.sheet_idx
    AND n.header_row > b.header_row), data_end)) AS data_end, operation_name FROM blocks b""",
)
def snap_bounds(spark, sf):
    return T.snap_bounds(T.block_bounds(W.stored_cells(spark, sf))).drop("nth")


UNSTABLE = f"""bmk AS (SELECT {SH}, header_row AS row, lead(header_row) OVER (PARTITION BY {SH} ORDER BY header_row) AS following FROM blocks),
  {_steady('bmk', 'median * 0.5', 0.5, 'bsteady')}"""


@query(
    "reject_unstable",
    f"""WITH {CELLS}, {BLOCKS}, {UNSTABLE} SELECT b.* FROM blocks b WHERE (file_id, sheet_idx) IN (SELECT (file_id, sheet_idx) FROM bsteady)
    OR (SELECT count(*) FROM blocks n WHERE n.file_id = b.file_id AND n.sheet_idx = b.sheet_idx) < 3""",
)
def reject_unstable(spark, sf):
    return T.reject_unstable(T.block_bounds(W.stored_cells(spark, sf)))


CHAIN = f"""fit AS (SELECT * FROM confident WHERE confidence >= 0.35),
  rchain AS (SELECT f.file_id, f.sheet_idx, f.header_row, f.data_end FROM fit f JOIN extent e USING (file_id, sheet_idx) WHERE f.header_row = (SELECT min(header_row) FROM fit m WHERE m.file_id = f.file_id AND m.sheet_idx = f.sheet_idx)
    UNION ALL SELECT f.file_id, f.sheet_idx, f.header_row, f.data_end FROM rchain r JOIN extent e ON e.file_id = r.file_id AND e.sheet_idx = r.sheet_idx JOIN fit f ON f.file_id = r.file_id AND f.sheet_idx = r.sheet_idx
      WHERE r.data_end + 1 < e.max_row AND f.header_row = (SELECT min(header_row) FROM fit m WHERE m.file_id = r.file_id AND m.sheet_idx = r.sheet_idx AND m.header_row > r.data_end))"""


@query(
    "table_chain",
    f"WITH RECURSIVE {CELLS}, {CANDIDATES}, {TABLE_END}, {CONFIDENCE}, {CHAIN} SELECT DISTINCT * FROM rchain",
)
def table_chain(spark, sf):
    cells = W.stored_cells(spark, sf)
    tables = T.bound_confidence(cells, cut(T.table_end(cells, T.table_candidates(cells))))
    return T.table_chain(tables, G.sheet_extent(cells).filter("max_row >= 3"))


@query(
    "find_bounds",
    f"""WITH RECURSIVE {CELLS}, {CANDIDATES}, {TABLE_END}, {CONFIDENCE}, {CHAIN}, {MARKER}, {INSPECTION}, {BLOCKS}, {OFFERED},
    chain AS (SELECT DISTINCT * FROM rchain), plain AS (SELECT {SH}, max_row FROM extent WHERE max_row >= 3 AND (file_id, sheet_idx) NOT IN (SELECT (file_id, sheet_idx) FROM marker)),
    cname AS (SELECT c.file_id, c.sheet_idx, c.header_row, c.data_end, coalesce(arg_min(name, o.row * 1000 + o.col) FILTER (name IS NOT NULL AND o.row < least(c.header_row, 15)), '') AS operation_name
      FROM chain c LEFT JOIN op_offered o ON o.file_id = c.file_id AND o.sheet_idx = c.sheet_idx GROUP BY ALL),
    cnth AS (SELECT c.*, (SELECT count(*) FROM confident t WHERE t.file_id = c.file_id AND t.sheet_idx = c.sheet_idx AND t.header_row <= c.header_row
      AND NOT EXISTS (SELECT 1 FROM chain k WHERE k.file_id = t.file_id AND k.sheet_idx = t.sheet_idx AND k.header_row < t.header_row AND t.header_row <= k.data_end)) AS nth FROM cname c),
    opts AS (SELECT {SH}, header_row, header_row + 1 AS data_start, data_end, 'chain' AS method, operation_name, nth FROM cnth
      UNION ALL SELECT {SH}, header_row, data_start, data_end, 'inspection', operation_name, row_number() OVER (PARTITION BY {SH} ORDER BY data_start) FROM inspection
      UNION ALL SELECT {SH}, header_row, data_start, data_end, 'runs', operation_name, nth FROM blocks),
    cnt AS (SELECT {SH}, max_row, count(*) FILTER (method = 'chain') AS nc, count(*) FILTER (method = 'inspection') AS ni, count(*) FILTER (method = 'runs') AS nr,
      coalesce(sum(data_end - header_row) FILTER (method = 'chain'), 0) AS cc, coalesce(sum(data_end - header_row) FILTER (method = 'inspection'), 0) AS ci, coalesce(sum(data_end - header_row) FILTER (method = 'runs'), 0) AS cr
      FROM plain JOIN opts USING (file_id, sheet_idx) GROUP BY ALL),
    fst AS (SELECT *, CASE WHEN nc > 0 THEN 'chain' WHEN ni > 0 THEN 'inspection' WHEN nr > 0 AND max_row > 100 THEN 'runs' END AS f FROM cnt),
    sz AS (SELECT *, CASE f WHEN 'chain' THEN nc WHEN 'inspection' THEN ni ELSE nr END AS n, CASE f WHEN 'chain' THEN cc WHEN 'inspection' THEN ci ELSE cr END::DOUBLE / max_row AS cover FROM fst WHERE f IS NOT NULL),
    choice AS (SELECT {SH}, CASE WHEN max_row > 200 AND (cover < 0.3 OR n < 3) AND nr > n THEN 'runs' ELSE f END AS method FROM sz),
    picked AS (SELECT o.* FROM opts o JOIN choice USING (file_id, sheet_idx, method)),
    snapped AS (SELECT {SH}, header_row, data_start, greatest(data_end, coalesce((SELECT min(n.header_row) - 1 FROM picked n WHERE n.file_id = p.file_id AND n.sheet_idx = p.sheet_idx AND n.header_row > p.header_row), data_end)) AS data_end, method, operation_name, nth FROM picked p),
    smk AS (SELECT {SH}, header_row AS row, lead(header_row) OVER (PARTITION BY {SH} ORDER BY header_row) AS following FROM snapped), {_steady('smk', 'median * 0.5', 0.5, 'ssteady')},
    named AS (SELECT * FROM snapped s WHERE (file_id, sheet_idx) IN (SELECT (file_id, sheet_idx) FROM ssteady) OR (SELECT count(*) FROM snapped n WHERE n.file_id = s.file_id AND n.sheet_idx = s.sheet_idx) < 3
    UNION ALL SELECT {SH}, header_row, data_start, data_end, 'marker', operation_name, row_number() OVER (PARTITION BY {SH} ORDER BY header_row) FROM marker)
    SELECT * EXCLUDE (nth), CASE WHEN operation_name <> '' THEN printf('%03d', nth) || '_' || substr({O.safe_filename('operation_name')}, 1, 30) ELSE 'Op' || printf('%03d', nth) END AS card_label FROM named""",
)
def find_bounds(spark, sf):
    return T.find_bounds(W.stored_cells(spark, sf))


# --- classification ----------------------------------------------------------


@query(
    "list_cards",
    f"""WITH {O.FILES} SELECT * FROM files WHERE path NOT LIKE '%/' AND NOT starts_with(path, '.') AND NOT contains(path, '__MACOSX')
    AND NOT starts_with({O.basename('path')}, '.') AND {O.rx('path', r'(?i)\.xlsx?\z')}""",
)
def list_cards(spark, sf):
    return C.list_cards(B.files(spark, sf))


_lname = f"lower({O.stem('path')})"
_numbered = f"({O.rx(_lname, C.LEADING_NUMBER)} OR {O.rx(_lname, C.MODEL_AS)})"


@query(
    "classify_legacy",
    f"""WITH {O.FILES} SELECT path, ord, CASE WHEN {O.any_of(_lname, K.SERVICE_FILE)} THEN 'service' WHEN {O.any_of(_lname, K.OPERATIONAL_FILE)} THEN 'operational_card'
    WHEN {_numbered} THEN 'operational_card' ELSE 'unknown' END AS file_type FROM files""",
)
def classify_legacy(spark, sf):
    return C.classify_legacy(B.files(spark, sf))


RULES = {
    "service_file_patterns": [
        {"type": "filename_keyword", "keywords": ["Cover", "обложка"]},
        {"type": "sheet_keyword", "keywords": ["spam"]},
    ],
    "operational_card_patterns": [
        {"type": "filename_regex", "pattern": r"^SSQRT\w+-\d+", "format_group": "card_format_A"},
        {"type": "filename_keyword", "keywords": ["作业指导书"], "format_group": "card_format_B"},
        {"type": "sheet_keyword", "keywords": ["bolt", "gear"], "format_group": "card_format_C"},
    ],
}


@query(
    "classify_rules",
    f"""WITH {O.FILES}, f AS (SELECT *, CASE WHEN contains(path, 'example.org') THEN 'SPAM page' ELSE '' END AS content, {_lname} AS nm FROM files)
    SELECT path, ord, content, CASE WHEN regexp_matches(nm, 'cover|обложка') THEN 'service' WHEN contains(CASE WHEN content <> '' THEN lower(content) ELSE nm END, 'spam') THEN 'service'
      WHEN regexp_matches(nm, '(?i)^SSQRT[a-z0-9_]+-[0-9]+') OR contains(nm, '作业指导书') OR regexp_matches(CASE WHEN content <> '' THEN lower(content) ELSE nm END, 'bolt|gear') THEN 'operational_card' ELSE 'unknown' END AS file_type,
    CASE WHEN regexp_matches(nm, 'cover|обложка') OR contains(CASE WHEN content <> '' THEN lower(content) ELSE nm END, 'spam') THEN NULL WHEN regexp_matches(nm, '(?i)^SSQRT[a-z0-9_]+-[0-9]+') THEN 'card_format_A'
      WHEN contains(nm, '作业指导书') THEN 'card_format_B' WHEN regexp_matches(CASE WHEN content <> '' THEN lower(content) ELSE nm END, 'bolt|gear') THEN 'card_format_C' END AS format_group FROM f""",
)
def classify_rules(spark, sf):
    files = B.files(spark, sf).withColumn("content", F.when(F.contains("path", F.lit("example.org")), "SPAM page").otherwise(""))
    return C.classify_rules(files, RULES, content="content")


@query(
    "representatives",
    f"WITH {O.FILES} SELECT {O.format_group('path')} AS format_group, arg_min(path, ord) AS path, count(*) AS files FROM files GROUP BY 1",
)
def representatives(spark, sf):
    return C.representatives(B.files(spark, sf))


@query(
    "splittable",
    """WITH s AS (SELECT o_custkey AS file_id, CASE o_orderpriority WHEN '1-URGENT' THEN '封面 ' WHEN '5-LOW' THEN 'Cover ' ELSE 'Лист ' END || o_orderkey::VARCHAR AS sheet FROM orders),
    k AS (SELECT * FROM s WHERE NOT contains(lower(sheet), 'cover') AND NOT contains(sheet, '封面'))
    SELECT * FROM k WHERE file_id IN (SELECT file_id FROM k GROUP BY 1 HAVING count(*) > 1)""",
)
def splittable(spark, sf):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "封面 ").when(F.col("o_orderpriority") == "5-LOW", "Cover ").otherwise("Лист ")
    return C.splittable(
        B.table(spark, sf, "orders").select(F.col("o_custkey").alias("file_id"), F.concat(kind, F.col("o_orderkey").cast("string")).alias("sheet"))
    )


@query(
    "allocate_names",
    f"""WITH n AS (SELECT o_custkey::VARCHAR AS source, o_orderpriority AS sheet, o_orderstatus || ':' AS label, o_orderkey FROM orders),
    b AS (SELECT *, substr({O.safe_filename('label')}, 1, 50) || '_' || substr({O.safe_filename('sheet')}, 1, 50) AS base FROM n),
    k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY source, sheet, label) - 1 AS k FROM b)
    SELECT source, sheet, label, CASE WHEN k = 0 THEN base ELSE base || '_' || k::VARCHAR END || '.xlsx' AS name FROM k""",
)
def allocate_names(spark, sf):
    sheets = B.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("source"), F.col("o_orderpriority").alias("sheet"), F.concat("o_orderstatus", F.lit(":")).alias("label")
    )
    return C.allocate_names(sheets)


@query(
    "allocate_names_clash",
    """WITH RECURSIVE n AS (SELECT o_orderkey::VARCHAR AS source, 'Sheet ' || o_custkey::VARCHAR || CASE o_orderkey % 5 WHEN 1 THEN '_1' WHEN 2 THEN '_2' WHEN 3 THEN '_1_1' ELSE '' END AS sheet, o_custkey AS family FROM orders),
    k AS (SELECT *, sheet AS base, row_number() OVER (PARTITION BY family ORDER BY source, sheet) AS k, count(*) OVER (PARTITION BY family) AS n FROM n),
    walk(family, k, source, sheet, name, taken) AS (
      SELECT family, 1::BIGINT, source, sheet, base, [base] FROM k WHERE k = 1
      UNION ALL SELECT family, k, source, sheet, name, list_append(taken, name) FROM (
        SELECT k.family, k.k, k.source, k.sheet, w.taken, list_filter(list_concat([base], list_transform(range(1, n + 1), lambda i: base || '_' || i)), lambda x: NOT list_contains(w.taken, x))[1] AS name
        FROM walk w JOIN k ON k.family = w.family AND k.k = w.k + 1))
    SELECT source, sheet, NULL::VARCHAR AS label, name || '.xlsx' AS name FROM walk""",
)
def allocate_names_clash(spark, sf):
    """Sheets of one customer are one family: its plain name, names with suffixes, and suffixes of these."""
    tail = F.when(F.col("o_orderkey") % 5 == 1, "_1").when(F.col("o_orderkey") % 5 == 2, "_2").when(F.col("o_orderkey") % 5 == 3, "_1_1").otherwise("")
    orders = B.table(spark, sf, "orders")
    return C.allocate_names(
        orders.select(
            F.col("o_orderkey").cast("string").alias("source"),
            F.concat(F.lit("Sheet "), F.col("o_custkey").cast("string"), tail).alias("sheet"),
            F.lit(None).cast("string").alias("label"),
        )
    )


@query(
    "split_manifest",
    f"WITH {O.FILES} SELECT {O.format_group('path')} AS source, array_to_string(list_sort(list(DISTINCT {O.basename('path')})), '|') AS names FROM files GROUP BY 1",
)
def split_manifest(spark, sf):
    files = B.files(spark, sf)
    produced = files.select(X.format_group("path").alias("source"), X.basename("path").alias("name"))
    return C.split_manifest(produced).withColumn("names", F.array_join("names", "|"))


@query(
    "merge_manifest",
    f"""WITH {O.FILES}, runs AS (SELECT {O.basename('path')} AS source, CASE WHEN ord % 3 = 0 THEN 'b' ELSE 'a' END || '_' || ord::VARCHAR AS name, ord FROM files)
    SELECT source, array_to_string(list_sort(list(DISTINCT name)), '|') AS names FROM runs GROUP BY 1""",
)
def merge_manifest(spark, sf):
    """Two runs over all files, the first of them replayed after the second, and after names that it no longer gives."""
    produced = B.files(spark, sf).select(F.col("path").alias("source"), F.concat(F.when(F.col("ord") % 3 == 0, "b").otherwise("a"), F.lit("_"), F.col("ord").cast("string")).alias("name"), "ord")
    path, first, second = f"{_scratch(spark)}/manifest", produced.filter("ord % 3 <> 0"), produced.filter("ord % 3 = 0")
    MT.merge_manifest(first.withColumn("name", F.concat("name", F.lit("_old"))), path, "first")
    MT.merge_manifest(second, path, "second")
    MT.merge_manifest(first, path, "first")
    return MT.read_manifest(spark, path).withColumn("names", F.array_join("names", "|"))


JOB_RULES = [
    RULES,
    {
        "service_file_patterns": [{"type": "filename_keyword", "keywords": ["作业指导书"]}],
        "operational_card_patterns": [
            {"type": "filename_keyword", "keywords": ["Cover"], "format_group": "g1"},
            {"type": "filename_regex", "pattern": "^ssqrt", "format_group": "g2"},
        ],
    },
    None,
]


@query(
    "classify_job_rules",
    f"""WITH {O.FILES}, f AS (SELECT *, ord % 3 AS job_id, {_lname} AS nm FROM files), h AS (SELECT *, regexp_matches(nm, 'cover|обложка') OR contains(nm, 'spam') AS s0,
      CASE WHEN regexp_matches(nm, '(?i)^SSQRT[a-z0-9_]+-[0-9]+') THEN 'card_format_A' WHEN contains(nm, '作业指导书') THEN 'card_format_B' WHEN regexp_matches(nm, 'bolt|gear') THEN 'card_format_C' END AS g0,
      contains(nm, '作业指导书') AS s1, CASE WHEN contains(nm, 'cover') THEN 'g1' WHEN starts_with(nm, 'ssqrt') THEN 'g2' END AS g1 FROM f)
    SELECT job_id, path, CASE job_id WHEN 0 THEN CASE WHEN s0 THEN 'service' WHEN g0 IS NOT NULL THEN 'operational_card' ELSE 'unknown' END
      WHEN 1 THEN CASE WHEN s1 THEN 'service' WHEN g1 IS NOT NULL THEN 'operational_card' ELSE 'unknown' END
      ELSE CASE WHEN {O.any_of('nm', K.SERVICE_FILE)} THEN 'service' WHEN {O.any_of('nm', K.OPERATIONAL_FILE)} OR {_numbered.replace(_lname, 'nm')} THEN 'operational_card' ELSE 'unknown' END END AS file_type,
    CASE WHEN job_id = 0 AND NOT s0 THEN g0 WHEN job_id = 1 AND NOT s1 THEN g1 END AS format_group FROM h""",
)
def classify_job_rules(spark, sf):
    """Files of three jobs in one pass, by rules of their own mappings that disagree; the third job has none."""
    texts = [(i, json.dumps({"cards": {} if rules is None else {"file_classification_rules": rules}})) for i, rules in enumerate(JOB_RULES)]
    mapped = M.read_mapping(spark.createDataFrame(texts, "job_id int, mapping_config string"))
    files = B.files(spark, sf).select((F.col("ord") % 3).cast("int").alias("job_id"), "path")
    return C.classify_by_rules(files, M.classification_rules(mapped, ["job_id"]), ["job_id"])


# --- mappings ----------------------------------------------------------------

MAPPING = """'{"bom":{"sheets":[{"sheet_name":"' || p_brand || '","sheet_type":"' || CASE WHEN p_size > 40 THEN 'other' ELSE 'bom_data' END || '","header_rows":[' || p_size::VARCHAR || '],
"columns":{"part_no":{"col_index":' || (p_size - 1)::VARCHAR || '},"qty":' || p_size::VARCHAR || ',"name_cn":{"col_index":3,"header":"x"}}}]},"cards":{' ||
CASE WHEN p_type = 'SMALL' THEN '"columns":{"part_no":2,"name":5},"table_boundaries":{"header_row":' || p_size::VARCHAR || '}' ELSE
'"formats":{"' || p_type || '":{"sheets":[{"columns":{"part_no":{"col_index":' || p_size::VARCHAR || '},"name_cn":7},"data_start_row":9,"table_boundaries":{"type":"single_table"}}],"end_markers":["签字"]}}' END || '}}'"""


def _mapping_rows(spark, sf):
    size = F.col("p_size").cast("string")
    bom = F.concat(
        F.lit('{"bom":{"sheets":[{"sheet_name":"'), "p_brand", F.lit('","sheet_type":"'), F.when(F.col("p_size") > 40, "other").otherwise("bom_data"),
        F.lit('","header_rows":['), size, F.lit('],"columns":{"part_no":{"col_index":'), (F.col("p_size") - 1).cast("string"), F.lit('},"qty":'), size,
        F.lit(',"name_cn":{"col_index":3,"header":"x"}}}]},"cards":{'),
    )
    flat = F.concat(F.lit('"columns":{"part_no":2,"name":5},"table_boundaries":{"header_row":'), size, F.lit("}"))
    named = F.concat(
        F.lit('"formats":{"'), "p_type", F.lit('":{"sheets":[{"columns":{"part_no":{"col_index":'), size,
        F.lit('},"name_cn":7},"data_start_row":9,"table_boundaries":{"type":"single_table"}}],"end_markers":["签字"]}}'),
    )
    config = F.concat(bom, F.when(F.col("p_type") == "SMALL", flat).otherwise(named), F.lit("}}"))
    return M.read_mapping(B.table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), config.alias("mapping_config")))


@query(
    "bom_sheet_configs",
    """SELECT p_partkey AS job_id, p_brand AS sheet, p_size AS header_row, p_size + 1 AS data_start, p_size - 1 AS part_col, 3 AS name_cn_col, 0 AS name_en_col, p_size AS qty_col
    FROM part WHERE p_size <= 40 AND p_size > 1""",
)
def bom_sheet_configs(spark, sf):
    return M.bom_sheet_configs(_mapping_rows(spark, sf), ["job_id"]).drop("config_columns", "layout_type")


@query(
    "card_formats",
    """SELECT p_partkey AS job_id, CASE WHEN p_type <> 'SMALL' THEN p_type END AS format_group, CASE WHEN p_type = 'SMALL' THEN 2 ELSE p_size END AS part_col, 0 AS qty_col,
    CASE WHEN p_type = 'SMALL' THEN 5 ELSE 7 END AS name_col, CASE WHEN p_type = 'SMALL' THEN p_size ELSE 1 END AS header_row, CASE WHEN p_type = 'SMALL' THEN p_size + 1 ELSE 9 END AS data_start,
    CASE WHEN p_type = 'SMALL' THEN '' ELSE '签字' END AS end_markers FROM part""",
)
def card_formats(spark, sf):
    formats = M.card_formats(_mapping_rows(spark, sf), ["job_id"])
    return formats.drop("layout_type", "multi_card").withColumn("end_markers", F.array_join("end_markers", "|"))


@query(
    "resolve_format",
    """WITH f AS (SELECT p_partkey AS job_id, p_name AS path, CASE WHEN p_size > 25 THEN p_type ELSE 'LARGE' END AS format_group FROM part)
    SELECT job_id, path, format_group, CASE WHEN p_type = 'SMALL' THEN 2 WHEN p_type = format_group THEN p_size END AS part_col,
    CASE WHEN p_type = 'SMALL' THEN p_size + 1 WHEN p_type = format_group THEN 9 END AS data_start FROM f JOIN part ON p_partkey = job_id""",
)
def resolve_format(spark, sf):
    group = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("LARGE")
    files = B.table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("path"), group.alias("format_group"))
    formats = M.card_formats(_mapping_rows(spark, sf), ["job_id"])
    return M.resolve_format(files, formats, ["job_id"]).select("job_id", "path", "format_group", "part_col", "data_start")


@query(
    "selected_configs",
    f"""WITH {O.JOBS} SELECT job_id, unnest(CASE WHEN starts_with(selected_config, '[') THEN json_extract_string(selected_config, '$[*]') ELSE [selected_config] END) AS config
    FROM jobs WHERE selected_config <> ''""",
)
def selected_configs(spark, sf):
    return M.selected_configs(B.jobs(spark, sf).select("job_id", "selected_config"))


@query("read_mapping_props", "SELECT event_id, coalesce((props::JSON->>'$.k')::INT, 0) AS col_index FROM events")
def read_mapping_props(spark, sf):
    events = B.table(spark, sf, "events")
    columns = F.from_json("props", "map<string,string>")
    return events.select("event_id", M.column_index(F.try_element_at(columns, F.lit("k"))).alias("col_index"))


# --- quality -----------------------------------------------------------------

_sheet_entry = "(ends_with(name, '.xml') AND contains(lower(name), 'sheet') AND NOT contains(name, '_rels'))"
_req = ", ".join(f"('{n}')" for n in K.REQUIRED_ENTRY)
STRUCT = f"""structural AS (SELECT f.file_id, 'structural' AS level, 'error' AS severity, 'Missing required file: ' || r.n AS message FROM files f CROSS JOIN (VALUES {_req}) r(n)
      WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.file_id = f.file_id AND e.name = r.n)
    UNION ALL SELECT file_id, 'structural', 'error', 'No sheet XML files found' FROM files f WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.file_id = f.file_id AND {_sheet_entry})
    UNION ALL SELECT file_id, 'structural', 'warning', printf('File too large: %.1f MB > 50.0 MB', size / (1024 * 1024)::DOUBLE) FROM files WHERE size / (1024 * 1024)::DOUBLE > 50
    UNION ALL SELECT file_id, 'structural', 'warning', 'CRC error (non-critical): ' || name FROM entries WHERE NOT crc_ok)"""
SCHEMA = f"""schemas AS (SELECT file_id, 'schema' AS level, CASE WHEN NOT has_data THEN 'error' ELSE 'warning' END AS severity,
      CASE WHEN NOT has_data THEN 'No sheetData in ' || name ELSE 'Empty sheetData (0 rows) in ' || name END AS message FROM entries WHERE {_sheet_entry} AND (NOT has_data OR row_count = 0))"""
CONTENT = """contents AS (SELECT file_id, 'content' AS level, 'warning' AS severity, 'Empty media file: ' || name AS message FROM entries WHERE starts_with(name, 'xl/media/') AND size = 0
    UNION ALL SELECT file_id, 'content', 'warning', 'Broken media reference in ' || rel_name || ': ' || target FROM refs r WHERE contains(lower(target), 'media')
      AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.file_id = r.file_id AND e.name = regexp_replace(r.target, '^/', '')))"""
ISSUES = f"{O.PACKAGE}, {STRUCT}, {SCHEMA}, {CONTENT}, issues AS (SELECT * FROM structural UNION ALL SELECT * FROM schemas UNION ALL SELECT * FROM contents)"


def _issues(spark, sf):
    files, entries, refs = B.package_files(spark, sf), B.package_entries(spark, sf), B.package_refs(spark, sf)
    found = Q.check_structural(files, entries).unionByName(Q.check_schema(entries)).unionByName(Q.check_content(entries, refs))
    return files, found


@query("check_structural", f"WITH {O.PACKAGE}, {STRUCT} SELECT * FROM structural")
def check_structural(spark, sf):
    return Q.check_structural(B.package_files(spark, sf), B.package_entries(spark, sf))


@query("check_schema", f"WITH {O.PACKAGE}, {SCHEMA} SELECT * FROM schemas")
def check_schema(spark, sf):
    return Q.check_schema(B.package_entries(spark, sf))


@query("check_content", f"WITH {O.PACKAGE}, {CONTENT} SELECT * FROM contents")
def check_content(spark, sf):
    return Q.check_content(B.package_entries(spark, sf), B.package_refs(spark, sf))


@query(
    "check_semantic",
    f"""WITH {CELLS}, shown AS (SELECT * REPLACE (row + 8 AS row) FROM cells) SELECT file_id, 'semantic' AS level, 'warning' AS severity, 'Sheet ''' || sheet || ''' contains no data' AS message
    FROM extent e WHERE NOT EXISTS (SELECT 1 FROM shown c WHERE c.file_id = e.file_id AND c.sheet_idx = e.sheet_idx AND row <= 10 AND col <= 10)""",
)
def check_semantic(spark, sf):
    cells = W.stored_cells(spark, sf)
    return Q.check_semantic(G.sheet_extent(cells), cells.withColumn("row", F.col("row") + 8))  # all of a sheet, eight rows lower


@query(
    "check_split",
    f"""WITH {O.PACKAGE}, st AS (SELECT f.file_id, f.size, bool_or(starts_with(name, 'xl/media/')) AS media, arg_min(row_count, name) FILTER ({_sheet_entry}) AS r FROM files f LEFT JOIN entries e USING (file_id) GROUP BY 1, 2)
    SELECT file_id, 'split-quality' AS level, 'warning' AS severity, 'File is very small: ' || size::VARCHAR || ' bytes' AS message FROM st WHERE size < 2048
    UNION ALL SELECT file_id, 'split-quality', 'warning', 'No images in split file (originals had images)' FROM st WHERE NOT coalesce(media, false)
    UNION ALL SELECT file_id, 'split-quality', 'warning', 'Too few rows: ' || r::VARCHAR || ' < 6' FROM st WHERE r < 6
    UNION ALL SELECT file_id, 'split-quality', 'warning', 'Too many rows: ' || r::VARCHAR || ' > 12' FROM st WHERE r > 12""",
)
def check_split(spark, sf):
    return Q.check_split(B.package_files(spark, sf), B.package_entries(spark, sf), 6, 8, True, 2048)


@query(
    "quality_roll_up",
    f"""WITH {ISSUES}, h AS (SELECT DISTINCT file_id FROM issues WHERE level = 'structural' AND severity = 'error'),
    k AS (SELECT i.* FROM issues i LEFT JOIN h ON h.file_id = i.file_id WHERE h.file_id IS NULL OR level = 'structural')
    SELECT f.file_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
    count(*) FILTER (severity = 'error') = 0 AS is_valid FROM files f LEFT JOIN k USING (file_id) GROUP BY 1""",
)
def quality_roll_up(spark, sf):
    return Q.roll_up(*_issues(spark, sf))


@query(
    "quarantine",
    f"""WITH {ISSUES}, e AS (SELECT * FROM issues WHERE severity = 'error'), h AS (SELECT DISTINCT file_id FROM e WHERE level = 'structural')
    SELECT f.file_id, f.size, '[' || level || '] ' || message AS error FROM files f JOIN e USING (file_id) WHERE level = 'structural' OR file_id NOT IN (SELECT file_id FROM h)
    UNION ALL SELECT file_id, size, NULL FROM files WHERE file_id NOT IN (SELECT file_id FROM e)""",
)
def quarantine(spark, sf):
    valid, invalid = Q.quarantine(*_issues(spark, sf))
    return invalid.unionByName(valid.withColumn("error", F.lit(None).cast("string")))


# --- progress ----------------------------------------------------------------

LAST = f"""{O.EVENTS}, last AS (SELECT job_id, card, coalesce(arg_max(status, epoch_us(ts)::HUGEINT * 1000000000000 + event_id) FILTER (status <> 'pending'), 'pending') AS status FROM card_events GROUP BY 1, 2),
  counters AS (SELECT job_id, count(*) FILTER (status = 'success') AS processed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM last GROUP BY 1)"""


@query("register_cards", f"WITH {O.EVENTS} SELECT job_id, count(DISTINCT card) AS total FROM card_events GROUP BY 1")
def register_cards(spark, sf):
    return S.register_cards(B.card_events(spark, sf))


@query("progress", f"WITH {LAST} SELECT * FROM counters")
def progress(spark, sf):
    return S.progress(B.card_events(spark, sf))


@query("completed_jobs", f"WITH {LAST} SELECT job_id FROM counters WHERE processed + failed = total")
def completed_jobs(spark, sf):
    return S.completed_jobs(S.progress(B.card_events(spark, sf)))


@query(
    "progress_messages",
    f"WITH {LAST} SELECT *, CASE WHEN total > 0 THEN round_even((processed + failed)::DOUBLE / total * 100, 1) ELSE 0.0 END AS percent FROM counters",
)
def progress_messages(spark, sf):
    return S.progress_messages(S.progress(B.card_events(spark, sf)))


@query("failed_cards", f"WITH {LAST} SELECT job_id, card FROM last WHERE status = 'failed'")
def failed_cards(spark, sf):
    return S.failed_cards(B.card_events(spark, sf))


@query(
    "stale_jobs",
    f"WITH {O.JOBS} SELECT job_id FROM jobs WHERE created_at < TIMESTAMP '1998-01-02 00:00:00' - INTERVAL 24 HOUR AND status IN ('done', 'error')",
)
def stale_jobs(spark, sf):
    return S.stale_jobs(B.jobs(spark, sf), "1998-01-02 00:00:00", 24)


@query(
    "drop_stale_jobs",
    f"""WITH {O.JOBS} SELECT o_orderkey AS job_id, o_orderpriority FROM orders WHERE o_orderkey NOT IN
    (SELECT job_id FROM jobs WHERE created_at < TIMESTAMP '1998-01-02 00:00:00' - INTERVAL 24 HOUR AND status IN ('done', 'error'))""",
)
def drop_stale_jobs(spark, sf):
    rows = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), "o_orderpriority")
    return S.drop_jobs(rows, S.stale_jobs(B.jobs(spark, sf), "1998-01-02 00:00:00", 24))


@query(
    "final_status",
    f"""WITH {LAST} SELECT job_id, CASE WHEN processed = 0 THEN 'error' WHEN failed = 0 THEN 'done' ELSE 'error' END AS status,
    CASE WHEN processed = 0 OR failed = 0 THEN 'completed' ELSE 'completed_with_errors' END AS stage,
    CASE WHEN processed = 0 THEN 'No translated cards generated. Check mapping_config and card parsing logs.'
      WHEN failed > 0 THEN 'Completed with ' || failed::VARCHAR || ' failed cards' END AS error FROM counters""",
)
def final_status(spark, sf):
    counters = S.progress(B.card_events(spark, sf))
    return S.final_status(counters.withColumn("has_output", F.col("processed") > 0))


@query(
    "valid_transitions",
    f"""WITH {O.JOBS}, r AS (SELECT *, CASE WHEN bom_uploaded THEN 'start' ELSE 'cancel' END AS action FROM jobs UNION ALL SELECT *, CASE WHEN bom_uploaded THEN 'cancel' ELSE 'start' END FROM jobs)
    SELECT job_id, action, CASE WHEN action = 'cancel' THEN 'error' ELSE 'processing' END AS new_status, CASE WHEN action = 'cancel' THEN 'cancelled' ELSE 'unpacking' END AS new_stage,
    action = 'start' AND status IN ('error', 'done') AS reset_counters FROM r
    WHERE (action = 'start' AND ((status = 'awaiting_upload' AND bom_uploaded AND archive_uploaded) OR status IN ('error', 'done'))) OR (action = 'cancel' AND status = 'processing')""",
)
def valid_transitions(spark, sf):
    jobs = B.jobs(spark, sf)
    return S.valid_transitions(jobs.withColumn("action", F.explode(F.array(F.lit("start"), F.lit("cancel")))))


def _scratch(spark):
    return f"{checkpoint_dir(spark)}/kittally-{uuid.uuid4().hex}"


def _event_stream(spark, sf):
    schema = B.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    return B.as_card_events(raw)


@query("progress_stream", f"WITH {LAST} SELECT * FROM counters")
def progress_stream(spark, sf):
    """The same counters from a stream of the events, by a native aggregate per card."""
    return S.progress_of_status(_status_log(spark, sf))


def _status_log(spark, sf):
    scratch, status = _scratch(spark), S.card_status(_event_stream(spark, sf))
    S.publish(status, S.keep_batches(f"{scratch}/out"), f"{scratch}/state").awaitTermination()
    return S.kept(spark, f"{scratch}/out", status.schema)


@query(
    "messages_stream",
    f"WITH {LAST} SELECT *, CASE WHEN total > 0 THEN round_even((processed + failed)::DOUBLE / total * 100, 1) ELSE 0.0 END AS percent FROM counters",
)
def messages_stream(spark, sf):
    """Progress messages from a stream of the events."""
    return S.progress_messages(S.progress_of_status(_status_log(spark, sf)))


@query("completed_stream", f"WITH {LAST} SELECT job_id FROM counters WHERE processed + failed = total")
def completed_stream(spark, sf):
    """Completed jobs, each announced once by a stream of the events."""
    scratch, status = _scratch(spark), S.card_status(_event_stream(spark, sf))
    S.publish(status, S.announce(f"{scratch}/log", f"{scratch}/announced"), f"{scratch}/state").awaitTermination()
    return spark.read.schema("job_id long").parquet(f"{scratch}/announced").select("job_id")


@query("completion_events", f"WITH {LAST} SELECT * FROM counters WHERE processed + failed = total")
def completion_events(spark, sf):
    """Completed jobs with their counters, from state per card and job, without a log."""
    scratch = _scratch(spark)
    done = JS.completion_events(_event_stream(spark, sf), shards=4)
    JS.run_events(done, f"{scratch}/out", f"{scratch}/state")
    return spark.read.schema(JS.DONE).parquet(f"{scratch}/out").drop("ts")


@query("progress_snapshot", f"WITH {LAST} SELECT job_id, card, status FROM last")
def progress_snapshot(spark, sf):
    """Last outcome of each card, from the snapshot into which a stream's updates are merged."""
    scratch, status = _scratch(spark), S.card_status(_event_stream(spark, sf))
    kept = SN.Snapshot(f"{scratch}/kept", ["job_id", "card"], status.schema, every=1)
    S.publish(status, kept.sink, f"{scratch}/state").awaitTermination()
    return kept.rows(spark).select("job_id", "card", F.coalesce("status", F.lit("pending")).alias("status"))


@query("progress_stream_deltas", f"WITH {LAST} SELECT * FROM counters")
def progress_stream_deltas(spark, sf):
    """The same counters as a sum of changes, through custom state per card."""
    scratch = _scratch(spark)
    return S.sum_deltas(S.run_to_table(S.card_deltas(_event_stream(spark, sf)), f"{scratch}/out", f"{scratch}/state"))


@query("streaming_totals", f"WITH {O.CARD_LINES} SELECT part_key, sum(quantity) AS qty, count(*) AS lines FROM card_lines GROUP BY 1")
def streaming_totals(spark, sf):
    """Card totals kept by a stream over the line items."""
    schema = B.table(spark, sf, "lineitem").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/lineitem.parque[t]").filter("l_linestatus = 'F'")
    number = F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.col("l_linenumber").cast("string"))
    totals = S.streaming_totals(raw.select(X.part_key(number).alias("part_key"), F.col("l_quantity").alias("qty")))
    scratch = _scratch(spark)
    S.publish(totals, S.keep_batches(f"{scratch}/out"), f"{scratch}/state").awaitTermination()
    return S.latest_totals(S.kept(spark, f"{scratch}/out", totals.schema))
