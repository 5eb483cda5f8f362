"""Queries: header, role and configuration detection over exploded workbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import text as X
from ..operators import classify as C
from ..operators import grid as G
from ..operators import totals as A
from . import oracle as O
from . import workbooks as W
from .registry import query

S = "file_id, sheet_idx"
CELLS = W.sql()
TRUTHY = "NOT coalesce(kind IN ('n', 'b') AND num = 0, false)"
FILLED = f"(kind <> 's' OR {O.strip('value')} <> '')"


def _by_length(t: str, words: list[str], base: float, squeeze: bool = False) -> str:
    branches = []
    for size in range(6, 0, -1):
        group = [w.lower() for w in words if min(len(w), 6) == size]
        if squeeze:
            group = [w.replace(" ", "").replace("(", "").replace(")", "") for w in group]
        if group:
            branches.append(f"WHEN {O.any_of(t, group)} THEN {round(base + 0.3 * size / 6, 6)}::DOUBLE")
    return f"(CASE {' '.join(branches)} END)"


def _count(words: list[str]) -> str:
    return f"count(*) FILTER ({O.any_of('v', words)})"


SCORES = f"""scores AS (SELECT c.file_id, c.sheet_idx, e.sheet, c.row,
    round(({_count(K.PART_NO)} * 2.0::DOUBLE + {_count(K.NAME)} * 1.5::DOUBLE + {_count(K.QTY)} * 1.5::DOUBLE + {_count(K.META)} * 0.5::DOUBLE
      + count(*)::DOUBLE / least(any_value(max_col), 29) * 0.5::DOUBLE) / (least(any_value(max_col), 29) * 2.0::DOUBLE), 6) AS score
  FROM (SELECT *, {O.norm_text('value')} AS v FROM cells WHERE row <= 30 AND col <= 29 AND {TRUTHY}) c
  JOIN extent e USING (file_id, sheet_idx) WHERE v <> '' GROUP BY c.file_id, c.sheet_idx, e.sheet, c.row)"""
HEADERS = f"""{SCORES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY score DESC, row) AS pos FROM scores),
  lifted AS (SELECT {S}, row, pos, round(score + CASE WHEN pos = 1 AND {O.any_of('lower(sheet)', K.BOM_SHEET_NAME)} THEN 0.05::DOUBLE ELSE 0 END, 6) AS score FROM ranked),
  headers AS (SELECT * FROM lifted l WHERE score >= (SELECT greatest(b.score * 0.4::DOUBLE, 0.18::DOUBLE) FROM lifted b WHERE b.file_id = l.file_id AND b.sheet_idx = l.sheet_idx AND b.pos = 1)),
  span AS (SELECT {S}, arg_min(row, pos) AS header_row, arg_max(row, pos) + 1 AS data_start FROM headers GROUP BY ALL)"""
HTEXT = f"""htext AS (SELECT * FROM (SELECT {S}, col, lower({O.strip("string_agg(value, ' ' ORDER BY pos)")}) AS text
  FROM (SELECT * FROM cells WHERE {TRUTHY}) JOIN headers USING (file_id, sheet_idx, row) GROUP BY {S}, col) WHERE text <> '')"""
_t = "text"
_SQUEEZED = "replace(replace(replace(text, ' ', ''), '(', ''), ')', '')"
_EN = f"({O.rx(_t, X.CYRILLIC)} OR {O.any_of(_t, ['英文', 'en)', '(en'])})"
_CN = f"({O.rx(_t, X.CJK)} OR {O.any_of(_t, K.CN_HINT)})"
_NAMED = _by_length(_t, K.NAME, 0.7)
ROLE_SCORES = f"""named AS (SELECT *, {_NAMED} AS ns, {O.any_of(_t, K.NAME_ANTI)} AS na, {_CN} AS cn, {_EN} AS en, contains(text, 'en）') AS late FROM htext),
  role_scores AS (SELECT {S}, col, 'part_no' AS role, coalesce({_by_length(_t, K.PART_NO, 0.7)}, {_by_length(_SQUEEZED, K.PART_NO, 0.5, True)}) AS score
    FROM htext WHERE NOT {O.any_of(_t, K.PART_NO_ANTI)}
    UNION ALL SELECT {S}, col, CASE WHEN cn AND NOT en THEN 'name_cn' WHEN en OR late THEN 'name_en' ELSE 'name_cn' END,
      CASE WHEN NOT cn AND NOT en AND late THEN 1.0 ELSE ns END FROM named WHERE ns IS NOT NULL AND NOT na
    UNION ALL SELECT {S}, col, 'name_cn', 0.7::DOUBLE FROM named WHERE (ns IS NULL OR na) AND {O.any_of(_t, K.DESCRIPTION_STEM)}
    UNION ALL SELECT {S}, col, 'qty', 1.0::DOUBLE FROM htext WHERE {O.any_of(_t, K.QTY)} AND NOT {O.any_of(_t, K.QTY_ANTI)}),
  column_scores AS (SELECT * FROM role_scores WHERE score IS NOT NULL)"""


def _sample(n: int, name: str) -> str:
    return f"{name} AS (SELECT c.*, {O.strip('value')} AS s FROM cells c JOIN span USING (file_id, sheet_idx) WHERE row >= data_start AND row < data_start + {n})"


_bare = "replace(replace(replace(replace(replace(s, '-', ''), '.', ''), '_', ''), '/', ''), ' ', '')"
_number = f"(CASE WHEN kind IN ('n', 'b') THEN num WHEN {O.numeric_str('s')} THEN TRY_CAST(replace(s, ',', '.') AS DOUBLE) END)"
PROFILE = f"""{_sample(30, 'sample')}, profile AS (SELECT {S}, col, count(*) AS n_all, count(*) FILTER (s <> '') AS n_text,
    count(*) FILTER (kind <> 's' OR s <> '') AS n_filled,
    count(*) FILTER ((kind <> 's' OR s <> '') AND {O.score_part('value', 'kind')} > 0.6) AS part_filled,
    count(*) FILTER ((kind <> 's' OR s <> '') AND {O.score_name('value', 'kind')} > 0.6) AS name_filled,
    count(*) FILTER ((kind <> 's' OR s <> '') AND {O.score_qty('value', 'kind')} > 0.8) AS qty_filled,
    count(*) FILTER (kind = 's' AND {O.rx('value', X.CJK + '|' + X.CYRILLIC)}) AS foreign_text,
    count(*) FILTER (s <> '' AND {O.score_part('s')} > 0.6) AS part_text,
    count(*) FILTER ({O.rx(_bare, X.LATIN)} AND {O.rx(_bare, X.DIGIT)} AND length({_bare}) BETWEEN 8 AND 15
      AND len(list_distinct(string_split({_bare}, ''))) >= 4) AS coded,
    count(*) FILTER ({O.rx('s', G.DATE_TEXT)}) AS dates, count(*) FILTER ({O.rx('s', X.CJK)}) AS cjk,
    count(*) FILTER ({O.score_part('value', 'kind')} > 0.6) AS part_typed,
    count(*) FILTER ({O.score_name('value', 'kind')} > 0.5) AS name_typed,
    count(*) FILTER ({O.score_qty('value', 'kind')} > 0.8) AS qty_typed,
    count(*) FILTER ({_number} = 0) AS zeros, count(*) FILTER ({_number} = 1) AS ones,
    count(*) FILTER ({_number} NOT IN (0, 1)) AS other_numbers,
    count(*) FILTER (kind = 'n' AND num <> floor(num)) AS fractions,
    count(*) FILTER (length(s) >= 2 AND NOT {O.numeric_str('s')} AND {O.rx('s', X.LATIN)} AND {O.rx('s', X.DIGIT)}) AS lettered
  FROM sample GROUP BY ALL)"""
VERIFIED = f"""verified AS (SELECT {S}, col, role, CASE WHEN score >= 0.9 THEN score ELSE greatest(score,
    CASE WHEN role = 'part_no' AND part_filled::DOUBLE / n_filled > 0.3 THEN 0.7 WHEN role = 'name_cn' AND name_filled::DOUBLE / n_filled > 0.3 THEN 0.6
    WHEN role = 'name_en' AND name_filled::DOUBLE / n_filled > 0.2 THEN 0.5 WHEN role = 'qty' AND qty_filled::DOUBLE / n_filled > 0.3 THEN 0.7 ELSE 0.0 END)::DOUBLE END AS score
  FROM column_scores LEFT JOIN profile USING (file_id, sheet_idx, col))"""
PICKED = f"""picked AS (SELECT {S}, role, col FROM (SELECT *, row_number() OVER (PARTITION BY {S}, role ORDER BY score DESC, col) AS k FROM verified) WHERE k = 1 AND score >= 0.3)"""
_meta = O.any_of("coalesce(text, '')", [w.lower() for w in K.STRICT_META + K.META])


def _top(name: str, source: str, score: str, least: float, where: str) -> str:
    return f"""{name} AS (SELECT {S}, col, score FROM (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY score DESC, col) AS k FROM
      (SELECT {S}, col, round({score}, 6) AS score FROM {source} WHERE {where}) WHERE score > {least}) WHERE k = 1)"""


_part_score = "greatest(part_text::DOUBLE / n_text, coded::DOUBLE / n_text) * CASE WHEN cjk::DOUBLE / n_text > 0.3 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END"
_described = "(SELECT * FROM profile LEFT JOIN htext USING (file_id, sheet_idx, col))"
_qty_where = f"""NOT {_meta} AND n_all >= 3 AND NOT (zeros > 0 AND ones > 0 AND other_numbers = 0)
      AND qty_typed::DOUBLE / n_all > 0.3 AND part_typed::DOUBLE / n_all < 0.3 AND name_typed::DOUBLE / n_all < 0.3"""
_qty_score = "qty_typed::DOUBLE / n_all + CASE WHEN fractions > 0 THEN 0.1::DOUBLE ELSE 0 END"
INFERRED = ", ".join(
    [
        _top("c_part", _described, _part_score, 0.3, f"NOT {_meta} AND n_text > 2 AND dates::DOUBLE / n_text <= 0.3"),
        _top(
            "c_name", "profile", "name_typed::DOUBLE / n_all - part_typed::DOUBLE / n_all * 0.5::DOUBLE", 0.2,
            "n_all > 2 AND name_typed::DOUBLE / n_all > 0.3 AND part_typed::DOUBLE / n_all < 0.3",
        ),
    ]
)
BASE = f"WITH {CELLS}, {HEADERS}, {HTEXT}, {ROLE_SCORES}, {PROFILE}, {VERIFIED}, {PICKED}, {INFERRED}"


def _lacks(roles: str, src: str = "picked") -> str:
    return f"(file_id, sheet_idx) NOT IN (SELECT (file_id, sheet_idx) FROM {src} WHERE role IN ({roles}))"


MOVED = f"""with_part AS (SELECT * FROM picked UNION ALL SELECT {S}, 'part_no', col FROM c_part WHERE {_lacks("'part_no'")}),
  with_name AS (SELECT * FROM with_part UNION ALL SELECT {S}, 'name_cn', col FROM c_name WHERE {_lacks("'name_cn', 'name_en'")}),
  {_top('c_qty', f'(SELECT * FROM {_described} WHERE (file_id, sheet_idx, col) NOT IN (SELECT (file_id, sheet_idx, col) FROM with_name))', _qty_score, 0.3, _qty_where)},
  with_qty AS (SELECT * FROM with_name UNION ALL SELECT {S}, 'qty', col FROM c_qty WHERE {_lacks("'qty'", 'with_name')}),
  final AS (SELECT {S}, CASE WHEN role = 'name_en' AND {_lacks("'name_cn'", 'with_qty')} AND NOT {O.any_of("coalesce(text, '')", K.EN_MARK)}
    AND coalesce(foreign_text, 0) > 0 THEN 'name_cn' ELSE role END AS role, col
    FROM with_qty LEFT JOIN htext USING (file_id, sheet_idx, col) LEFT JOIN profile USING (file_id, sheet_idx, col)),
  roles AS (SELECT {S}, max(col) FILTER (role = 'part_no') AS part_no, max(col) FILTER (role = 'name_cn') AS name_cn,
    max(col) FILTER (role = 'name_en') AS name_en, max(col) FILTER (role = 'qty') AS qty FROM final GROUP BY ALL)"""
_torque = O.rx("s", rf"\p{{Nd}}+[{X.WS}]*[±\-][{X.WS}]*\p{{Nd}}+")
_bolt = O.rx("s", r"^[Mm]\p{Nd}")
_positive = f"((kind IN ('n', 'b') AND num > 0) OR (kind = 's' AND NOT {_torque} AND NOT {_bolt} AND coalesce(TRY_CAST(s AS DOUBLE), 0) > 0 AND {O.rx('s', X.FLOAT_TEXT)}))"
_marker = "(kind = 's' AND s IN ('S', 's', 'Y', 'y', '–', '-'))"
_wordy = O.rx("s", rf"[^\p{{Nd}}{X.WS}.,;:]")
CONFIGS = f"""{_sample(50, 'sample50')},
  head1 AS (SELECT c.file_id, c.sheet_idx, c.col, {O.norm_text('value')} AS header FROM cells c JOIN span s ON c.file_id = s.file_id AND c.sheet_idx = s.sheet_idx AND c.row = s.header_row),
  cand AS (SELECT * FROM (SELECT {S}, unnest(range(coalesce(part_no, 0) + 1, max_col + 1))::INT AS col, [part_no, name_cn, name_en, qty] AS taken FROM span LEFT JOIN roles USING (file_id, sheet_idx) JOIN extent USING (file_id, sheet_idx))
    LEFT JOIN head1 USING (file_id, sheet_idx, col) WHERE NOT list_contains(taken, col) AND NOT {O.any_of("coalesce(header, '')", [w.lower() for w in K.STRICT_META + K.META])}),
  filled50 AS (SELECT * FROM sample50 WHERE s <> ''),
  facts AS (SELECT {S}, col, bool_or({_positive} OR {_marker}) AS has_valid, bool_or({_positive}) AS has_number,
    avg(CASE WHEN kind = 's' AND NOT {_marker} AND ({_torque} OR {_bolt} OR (NOT {_positive} AND length(s) > 3 AND {_wordy})) THEN 1.0 ELSE 0.0 END) AS bad FROM filled50 GROUP BY ALL),
  counted AS (SELECT {S}, col, s, count(*) AS n FROM filled50 WHERE length(s) <= 2 OR {O.rx('s', X.DIGIT)} GROUP BY ALL),
  repeated AS (SELECT {S}, col FROM counted GROUP BY ALL HAVING sum(n) >= 5 AND max(n)::DOUBLE / sum(n) > 0.7
    AND NOT arg_max(upper(s) IN ('S', 'Y') OR s IN ('-', '–', '—') OR {O.numeric_str('s')}, n)),
  judged AS (SELECT {S}, col, header, coalesce(has_valid, false) AND coalesce(bad, 0) <= 0.3 AND r.col IS NULL AS valid,
    coalesce(has_number, false) AND coalesce(bad, 0) <= 0.3 AND r.col IS NULL AS number
    FROM cand LEFT JOIN facts USING (file_id, sheet_idx, col) LEFT JOIN (SELECT *, col AS rc FROM repeated) r USING (file_id, sheet_idx, col)),
  firsts AS (SELECT {S}, min(col) FILTER (number) AS f, bool_or(valid) AS found FROM judged GROUP BY ALL),
  edges AS (SELECT {S}, f, found, (SELECT min(col) FROM judged j WHERE j.file_id = firsts.file_id AND j.sheet_idx = firsts.sheet_idx AND NOT j.number AND j.col > f) AS edge FROM firsts),
  configs AS (SELECT {S}, col, CASE WHEN NOT found THEN 'unproven' WHEN edge IS NULL OR col < edge THEN 'numeric' ELSE 'marker' END AS zone, coalesce(header, '') AS header
    FROM judged JOIN edges USING (file_id, sheet_idx) WHERE valid OR NOT found)""".replace("r.col IS NULL", "rc IS NULL")


def _headers(spark, sf):
    cells = W.stored_cells(spark, sf)
    return cells, G.pick_headers(G.score_headers(cells))


@query("cells", f"WITH {CELLS} SELECT * FROM cells")
def cells(spark, sf):
    return W.cells(spark, sf)


@query(
    "fill_merged",
    f"""WITH {CELLS}, covered AS (SELECT m.file_id, m.sheet_idx, min_row, min_col, r.row, c.col FROM merges m, LATERAL (SELECT unnest(range(min_row, max_row + 1))::INT AS row) r,
      LATERAL (SELECT unnest(range(min_col, max_col + 1))::INT AS col) c),
    filled AS (SELECT v.file_id, v.sheet_idx, s.sheet, v.row, v.col, s.value, s.num, s.kind, false AS strike FROM covered v
      JOIN cells s ON s.file_id = v.file_id AND s.sheet_idx = v.sheet_idx AND s.row = v.min_row AND s.col = v.min_col
      WHERE NOT EXISTS (SELECT 1 FROM cells x WHERE x.file_id = v.file_id AND x.sheet_idx = v.sheet_idx AND x.row = v.row AND x.col = v.col))
    SELECT file_id, sheet_idx, sheet, row, col, value, num, kind, strike FROM cells UNION ALL SELECT * FROM filled""",
)
def fill_merged(spark, sf):
    return G.fill_merged(W.stored_cells(spark, sf), W.merges(spark, sf))


@query("row_spine", f"WITH {CELLS} SELECT {S}, max_row, unnest(range(1, max_row + 1))::INT AS row FROM extent")
def row_spine(spark, sf):
    return G.row_spine(W.stored_cells(spark, sf))


@query(
    "snapshot",
    f"""WITH {CELLS}, w AS (SELECT {S}, row, max(col) AS w FROM cells WHERE row <= 300 AND col <= 200 GROUP BY ALL),
    d AS (SELECT {S}, row, unnest(range(1, w + 1))::INT AS col FROM w)
    SELECT {S}, row, string_agg(coalesce(value, '~'), '|' ORDER BY col) AS values FROM d LEFT JOIN cells USING (file_id, sheet_idx, row, col) GROUP BY ALL""",
)
def snapshot(spark, sf):
    rows = G.snapshot(W.stored_cells(spark, sf))
    return rows.withColumn("values", F.array_join("values", "|", "~"))


@query("score_headers", f"WITH {CELLS}, {SCORES} SELECT * FROM scores")
def score_headers(spark, sf):
    return G.score_headers(W.stored_cells(spark, sf))


@query("pick_headers", f"WITH {CELLS}, {HEADERS} SELECT {S}, row, pos, score FROM headers")
def pick_headers(spark, sf):
    return _headers(spark, sf)[1]


@query("header_text", f"WITH {CELLS}, {HEADERS}, {HTEXT} SELECT * FROM htext")
def header_text(spark, sf):
    return G.header_text(*_headers(spark, sf))


@query("score_columns", f"WITH {CELLS}, {HEADERS}, {HTEXT}, {ROLE_SCORES} SELECT * FROM column_scores")
def score_columns(spark, sf):
    return G.score_columns(G.header_text(*_headers(spark, sf)))


@query("profile_columns", f"WITH {CELLS}, {HEADERS}, {PROFILE} SELECT * FROM profile")
def profile_columns(spark, sf):
    cells, headers = _headers(spark, sf)
    return G.profile_columns(cells, G.header_span(headers))


def _verified(spark, sf):
    cells, headers = _headers(spark, sf)
    texts = G.header_text(cells, headers)
    return G.verify_columns(G.score_columns(texts), G.profile_columns(cells, G.header_span(headers)))


@query("verify_columns", f"{BASE} SELECT * FROM verified")
def verify_columns(spark, sf):
    return _verified(spark, sf)


@query("pick_columns", f"{BASE} SELECT * FROM picked")
def pick_columns(spark, sf):
    return G.pick_columns(_verified(spark, sf))


@query("infer_part_col", f"{BASE} SELECT * FROM c_part")
def infer_part_col(spark, sf):
    cells, headers = _headers(spark, sf)
    return G.infer_part_col(G.profile_columns(cells, G.header_span(headers)), G.header_text(cells, headers))


@query("infer_name_col", f"{BASE} SELECT * FROM c_name")
def infer_name_col(spark, sf):
    cells, headers = _headers(spark, sf)
    return G.infer_name_col(G.profile_columns(cells, G.header_span(headers)))


@query(
    "infer_qty_col",
    f"""{BASE}, {_top('q', f'(SELECT * FROM {_described} WHERE (file_id, sheet_idx, col) NOT IN (SELECT (file_id, sheet_idx, col) FROM picked))', _qty_score, 0.3, _qty_where)}
    SELECT * FROM q""",
)
def infer_qty_col(spark, sf):
    cells, headers = _headers(spark, sf)
    texts = G.header_text(cells, headers)
    profile = G.profile_columns(cells, G.header_span(headers))
    return G.infer_qty_col(profile, texts, G.pick_columns(G.verify_columns(G.score_columns(texts), profile)))


@query(
    "reassign_name",
    f"""{BASE} SELECT {S}, CASE WHEN role = 'name_en' AND {_lacks("'name_cn'")} AND NOT {O.any_of("coalesce(text, '')", K.EN_MARK)}
    AND coalesce(foreign_text, 0) > 0 THEN 'name_cn' ELSE role END AS role, col
    FROM picked LEFT JOIN htext USING (file_id, sheet_idx, col) LEFT JOIN profile USING (file_id, sheet_idx, col)""",
)
def reassign_name(spark, sf):
    return G.reassign_name(G.pick_columns(_verified(spark, sf)), G.column_facts(*_headers(spark, sf)))


@query("detect_roles", f"{BASE}, {MOVED} SELECT * FROM roles")
def detect_roles(spark, sf):
    cells, headers = _headers(spark, sf)
    return G.detect_roles(cells, headers, qty_fallback=True).filter("coalesce(part_no, name_cn, name_en, qty) IS NOT NULL")


@query("detect_configs", f"{BASE}, {MOVED}, {CONFIGS} SELECT * FROM configs")
def detect_configs(spark, sf):
    cells, headers = _headers(spark, sf)
    return G.detect_configs(cells, headers, G.detect_roles(cells, headers, qty_fallback=True))


@query(
    "graphic_col",
    f"""{BASE}, {MOVED}, known AS (SELECT {S}, unnest([part_no, name_cn, name_en, qty]) AS col FROM roles),
    named_g AS (SELECT {S}, min(col) AS col FROM cells JOIN (SELECT {S}, row FROM headers) USING (file_id, sheet_idx, row)
      WHERE {O.any_of('lower(value)', [w.lower() for w in K.GRAPHIC_NUMBER])} AND (file_id, sheet_idx, col) NOT IN (SELECT (file_id, sheet_idx, col) FROM known WHERE col IS NOT NULL) GROUP BY ALL),
    content_g AS (SELECT {S}, min(col) AS col FROM profile WHERE n_all > 2 AND lettered::DOUBLE / n_all > 0.3 AND (file_id, sheet_idx, col) NOT IN (SELECT (file_id, sheet_idx, col) FROM known WHERE col IS NOT NULL) GROUP BY ALL)
    SELECT {S}, coalesce(n.col, c.col) AS col FROM named_g n FULL JOIN content_g c USING (file_id, sheet_idx)""",
)
def graphic_col(spark, sf):
    cells, headers = _headers(spark, sf)
    return G.graphic_col(cells, headers, G.detect_roles(cells, headers, qty_fallback=True))


_cleaned = O.strip("replace(replace(regexp_replace(value, '_x[0-9a-fA-F]{4}_', '', 'g'), chr(13), ''), chr(10), ' ')")


@query(
    "sheet_card_number",
    f"""WITH {CELLS}, hits AS (SELECT {S}, row, col, {O.found_card_number(_cleaned)} AS hit FROM cells WHERE row <= 15 AND col <= 20),
    f AS (SELECT {S}, arg_min(hit, row * 1000 + col) AS hit FROM hits WHERE hit IS NOT NULL GROUP BY ALL)
    SELECT {S}, coalesce(hit, {O.card_number('file_id')}) AS card_no FROM extent LEFT JOIN f USING (file_id, sheet_idx)""",
)
def sheet_card_number(spark, sf):
    return G.sheet_card_number(W.cells(spark, sf))


@query(
    "bom_candidates",
    f"""{BASE}, {MOVED.replace("with_qty AS (SELECT * FROM with_name UNION ALL SELECT " + S + ", 'qty', col FROM c_qty WHERE", "with_qty AS (SELECT * FROM with_name UNION ALL SELECT " + S + ", 'qty', col FROM c_qty WHERE false AND")}, {CONFIGS},
    n AS (SELECT {S}, count(*) AS configs FROM configs GROUP BY ALL)
    SELECT {S}, sheet, header_row, data_start, part_no, name_cn, name_en, qty, coalesce(configs, 0) AS configs
    FROM extent JOIN span USING (file_id, sheet_idx) LEFT JOIN roles USING (file_id, sheet_idx) LEFT JOIN n USING (file_id, sheet_idx)
    WHERE NOT {O.any_of('lower(sheet)', K.SERVICE_SHEET)} AND max_row - data_start + 1 >= 3
      AND (coalesce(configs, 0) >= 2 OR (qty IS NOT NULL AND (name_cn IS NOT NULL OR name_en IS NOT NULL OR part_no IS NOT NULL)))""",
)
def bom_candidates(spark, sf):
    return G.bom_candidates(W.stored_cells(spark, sf))


_elem = f"contains(t, '{K.OPERATION_ELEMENT}')"


OFFERED = f"""op_near AS (SELECT {S}, row, col, {O.strip('value')} AS t, {TRUTHY} AS full_cell FROM cells WHERE row < 15 AND col <= 10),
    op_beside AS (SELECT * FROM op_near WHERE full_cell AND length(t) > 1 AND NOT {_elem}),
    op_titles AS (SELECT * FROM op_near WHERE length(t) > 3 AND {O.rx('t', X.CJK)} AND NOT {O.any_of('t', K.OPERATION_SKIP)}),
    op_offered AS (SELECT t.file_id, t.sheet_idx, t.row, t.col, CASE WHEN contains(t.t, '{K.OPERATION_ELEMENT}') THEN coalesce(a.t, b.t) ELSE t.t END AS name FROM op_titles t
      LEFT JOIN op_beside a ON a.file_id = t.file_id AND a.sheet_idx = t.sheet_idx AND a.row = t.row AND a.col = t.col + 1
      LEFT JOIN op_beside b ON b.file_id = t.file_id AND b.sheet_idx = t.sheet_idx AND b.row = t.row AND b.col = t.col + 2)"""


@query(
    "operation_name",
    f"""WITH {CELLS}, {HEADERS}, {OFFERED}
    SELECT s.file_id, s.sheet_idx, s.header_row, coalesce(arg_min(name, o.row * 1000 + o.col) FILTER (name IS NOT NULL AND o.row < least(header_row, 15)), '') AS operation_name
    FROM span s LEFT JOIN op_offered o ON o.file_id = s.file_id AND o.sheet_idx = s.sheet_idx GROUP BY ALL""",
)
def operation_name(spark, sf):
    cells, headers = _headers(spark, sf)
    return G.operation_name(cells, G.header_span(headers))


_low = f"lower({O.strip('value')})"


@query(
    "detect_blocks",
    f"""WITH {CELLS}, {HEADERS}, h AS (SELECT c.file_id, c.sheet_idx, col, {_low} AS v FROM cells c JOIN span s ON c.file_id = s.file_id AND c.sheet_idx = s.sheet_idx AND c.row = s.header_row),
    p AS (SELECT {S}, col AS block_part_col FROM h WHERE {O.any_of('v', K.PART_NO)} AND col <> 2)
    SELECT p.file_id, p.sheet_idx, block_part_col, max(h.col) FILTER ({O.any_of('v', K.NAME)}) AS block_name_col, max(h.col) FILTER ({O.any_of('v', K.QTY)}) AS block_qty_col
    FROM p JOIN h ON h.file_id = p.file_id AND h.sheet_idx = p.sheet_idx AND h.col BETWEEN block_part_col + 1 AND block_part_col + 4
    GROUP BY ALL HAVING block_name_col IS NOT NULL AND block_qty_col IS NOT NULL""",
)
def detect_blocks(spark, sf):
    cells, headers = _headers(spark, sf)
    return G.detect_blocks(cells, G.header_span(headers).withColumn("part_col", F.lit(2)))


_w = K.AUTO_BOM


@query(
    "auto_bom_sheets",
    f"""WITH {CELLS}, t AS (SELECT {S}, row, col, row * 1000 + col AS place, {_low} AS v FROM cells WHERE row <= 5 AND col <= 49),
    k AS (SELECT *, {O.any_of('v', _w['part_no'])} AS p, {O.any_of('v', _w['qty'])} AS q, {O.any_of('v', _w['name_cn'])} AS n, {O.any_of('v', _w['name_en'])} AS e FROM t),
    c AS (SELECT {S}, row, col, place, p, q AND NOT p AS q, n AND NOT p AND NOT q AS n, e AND NOT p AND NOT q AS e FROM k),
    fn AS (SELECT {S}, min(place) FILTER (n) AS fn FROM c GROUP BY ALL),
    d AS (SELECT c.* EXCLUDE (n, e), coalesce(place = fn, false) AS n, e AND NOT coalesce(place = fn, false) AS e FROM c JOIN fn USING (file_id, sheet_idx)),
    st AS (SELECT {S}, list_sort(list_filter([min(row) FILTER (p), min(row) FILTER (q), min(row) FILTER (n), min(row) FILTER (e)], lambda x: x IS NOT NULL))[2] AS header_row FROM d GROUP BY ALL)
    SELECT {S}, any_value(sheet) AS sheet, header_row, header_row + 1 AS data_start, arg_max(col, place) FILTER (p) AS part_col, coalesce(arg_min(col, place) FILTER (n), 0) AS name_cn_col,
      coalesce(arg_min(col, place) FILTER (e), 0) AS name_en_col, arg_max(col, place) FILTER (q) AS qty_col, any_value(max_row) - header_row AS data_rows
    FROM d JOIN st USING (file_id, sheet_idx) JOIN extent USING (file_id, sheet_idx) WHERE row <= header_row AND max_row >= 2
    GROUP BY {S}, header_row HAVING part_col IS NOT NULL AND qty_col IS NOT NULL""",
)
def auto_bom_sheets(spark, sf):
    return G.auto_bom_sheets(W.stored_cells(spark, sf))


_a = K.AUTO_CARD
AUTO_CARD = f"""ac AS (SELECT file_id, sheet_idx, row, col, CASE WHEN {O.any_of(_low, _a['part_no'])} THEN 'p' WHEN {O.any_of(_low, _a['qty'])} THEN 'q' WHEN {O.any_of(_low, _a['name'])} THEN 'n' END AS r
      FROM cells WHERE row <= 31 AND col <= 29),
    ar AS (SELECT file_id, sheet_idx, row, max(col) FILTER (r = 'p') AS p, max(col) FILTER (r = 'q') AS q, max(col) FILTER (r = 'n') AS n FROM ac GROUP BY ALL HAVING count(DISTINCT r) >= 2),
    ah AS (SELECT * FROM ar WHERE row = (SELECT min(row) FROM ar b WHERE b.file_id = ar.file_id AND b.sheet_idx = ar.sheet_idx) AND p IS NOT NULL AND q IS NOT NULL),
    auto_card AS (SELECT file_id, row AS header_row, row + 1 AS data_start, p AS part_col, q AS qty_col, coalesce(n, 0) AS name_col FROM ah
      WHERE sheet_idx = (SELECT min(sheet_idx) FROM ah b WHERE b.file_id = ah.file_id))"""


@query("auto_card_cols", f"WITH {CELLS}, {AUTO_CARD} SELECT * FROM auto_card")
def auto_card_cols(spark, sf):
    return G.auto_card_cols(W.stored_cells(spark, sf))


@query(
    "flag_uncached",
    f"""WITH {CELLS}, shown AS (SELECT * FROM cells WHERE NOT (row > 1 AND col = 2) AND NOT (row > 1 AND file_id LIKE 'ord-%' AND row < 6))
    SELECT DISTINCT file_id FROM extent WHERE max_row >= 2 AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.file_id = extent.file_id AND row BETWEEN 2 AND 3 + 7 AND col <= 20 AND kind = 'n')""",
)
def flag_uncached(spark, sf):
    cells = W.stored_cells(spark, sf)
    shown = cells.filter("NOT (row > 1 AND col = 2) AND NOT (row > 1 AND file_id LIKE 'ord-%' AND row < 6) AND kind = 'n'")
    return G.flag_uncached(shown, G.sheet_extent(cells))


@query(
    "content_digest",
    f"""WITH {CELLS} SELECT file_id, string_agg({O.strip('value')}, ' ' ORDER BY row, col) AS content FROM cells WHERE sheet_idx = 0 AND row <= 30 AND col <= 39 GROUP BY 1""",
)
def content_digest(spark, sf):
    return C.content_digest(W.stored_cells(spark, sf))


@query(
    "drop_struck",
    f"""WITH {CELLS} SELECT file_id, sheet_idx, row, col, value AS raw FROM cells c WHERE NOT EXISTS (
      SELECT 1 FROM cells s WHERE s.strike AND s.file_id = c.file_id AND s.sheet_idx = c.sheet_idx AND s.row = c.row AND s.col IN (c.col, 7, 1))""",
)
def drop_struck(spark, sf):
    cells = W.stored_cells(spark, sf)
    rows = cells.select(
        "file_id", "sheet_idx", "row", "col", F.col("value").alias("raw"), F.col("col").alias("part_col"), F.lit(7).alias("config_col"), F.lit(1).alias("first_col")
    )
    return A.drop_struck(rows, cells, ["part_col", "config_col", "first_col"]).select("file_id", "sheet_idx", "row", "col", "raw")
