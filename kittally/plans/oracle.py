"""Equivalent SQL of the registered queries, for a second engine to run on the same tables."""

from __future__ import annotations

from ..functions import keywords as K
from ..functions import text as X

WS = X.WS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {lit(pattern)})"


def sub(e: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({e}, {lit(pattern)}, {lit(to)}, 'g')"


def ext(e: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({e}, {lit(pattern)}, {group})"


def any_of(e: str, words) -> str:
    return rx(e, X.alternation(list(words)))


def strip(e: str) -> str:
    return sub(e, rf"^[{WS}]+|[{WS}]+\z")


def upper(e: str) -> str:
    return f"upper(replace({e}, 'ß', 'SS'))"


def part_key(e: str) -> str:
    head = sub(sub(e, rf"^[{WS}]+"), X.ARTEFACT_TAIL)
    return f"coalesce({upper(sub(head, X.PART_NOISE))}, '')"


def quantity(e: str, default: str = "0.0") -> str:
    s = strip(sub(strip(e), X.ARTEFACT_TAIL))
    dash = X.DASH
    return (
        f"(CASE WHEN {rx(s, rf'^(?:{dash}{{1,3}}|{dash}[{WS}]*{dash})' + chr(92) + 'z')} THEN 0.0::DOUBLE "
        f"WHEN {rx(s, r'^[-+]?[0-9]+(?:[.,][0-9]+)?' + chr(92) + 'z')} "
        f"THEN CAST(replace({s}, ',', '.') AS DOUBLE) ELSE {default}::DOUBLE END)"
    )


def is_part(e: str) -> str:
    s = strip(e)
    garbage = ", ".join(lit(g) for g in K.GARBAGE)
    return (
        f"coalesce(length({s}) >= 3 AND lower({s}) NOT IN ({garbage}) AND NOT {rx(s, X.CJK + '|' + X.CYRILLIC)} "
        f"AND {rx(s, X.DIGIT)} AND ({rx(s, X.LATIN)} OR length({s}) >= 4), false)"
    )


def is_part_lenient(e: str) -> str:
    s = strip(e)
    garbage = ", ".join(lit(g) for g in K.GARBAGE)
    first = r"^[^\n]*[A-Za-z]"
    return (
        f"coalesce(length({s}) >= 3 AND lower({s}) NOT IN ({garbage}) AND NOT {rx(s, X.CJK + '|' + X.CYRILLIC)} AND "
        f"(({rx(s, first)} AND {rx(s, rf'^[A-Za-z0-9\-./_{WS}]{{3,}}\z')}) OR {rx(s, r'^\p{Nd}{3,}\z')}), false)"
    )


def clean_name(e: str) -> str:
    return f"coalesce(trim({sub(sub(e, chr(92) + 'r'), f'[{WS}]+', ' ')}), '')"


def norm_text(e: str) -> str:
    return f"trim({sub(sub(f'lower({e})', '_x[0-9a-f]{4}_'), f'[{WS}]+', ' ')})"


def clean_cell(e: str) -> str:
    return f"coalesce({strip(sub(strip(e), X.ARTEFACT_TAIL))}, '')"


def numeric_str(e: str) -> str:
    return f"coalesce({rx(strip(f'replace({e}, {lit(chr(44))}, {lit(chr(46))})'), X.FLOAT_TEXT)}, false)"


def _num(kind: str | None) -> str:
    return "false" if kind is None else f"coalesce({kind} IN ('n', 'b'), false)"


def score_part(e: str, kind: str | None = None) -> str:
    s = strip(e)
    return f"""round(CASE WHEN {e} IS NULL THEN 0.0 WHEN {_num(kind)} THEN 0.1 WHEN length({s}) < 3 THEN 0.0
      WHEN {any_of(f'lower({s})', K.VALUE_HEADER_WORD)} THEN 0.1
      ELSE least(greatest(CASE WHEN {rx(s, X.CJK + '|' + X.CYRILLIC)} THEN -0.3 ELSE 0.0 END
        + CASE WHEN {rx(s, X.LATIN)} AND {rx(s, X.DIGIT)} THEN 0.6 WHEN {rx(s, X.DIGIT)} AND length({s}) >= 6 THEN 0.3 ELSE 0.0 END
        + CASE WHEN contains({s}, '-') THEN 0.2 ELSE 0.0 END, 0.0), 1.0) END::DOUBLE, 4)"""


def score_name(e: str, kind: str | None = None) -> str:
    s = strip(e)
    return f"""round(CASE WHEN {e} IS NULL OR {_num(kind)} OR length({s}) < 2 THEN 0.0 WHEN {is_part(e)} THEN 0.1
      ELSE least(greatest(CASE WHEN {rx(s, X.CJK)} THEN 0.5 ELSE 0.0 END + CASE WHEN {rx(s, X.CYRILLIC)} THEN 0.4 ELSE 0.0 END
        + CASE WHEN {rx(s, X.LATIN)} AND NOT {rx(s, X.DIGIT)} THEN 0.3 ELSE 0.0 END
        + CASE WHEN length({s}) > 10 THEN 0.2 ELSE 0.0 END
        - CASE WHEN {rx(s, X.LATIN)} AND {rx(s, X.DIGIT)} THEN 0.1 ELSE 0.0 END, 0.0), 1.0) END::DOUBLE, 4)"""


def score_qty(e: str, kind: str | None = None) -> str:
    s = strip(e)
    started = rf"^\p{{Nd}}+[{WS}]*[^{WS}]"
    return f"""(CASE WHEN {e} IS NULL THEN 0.0 WHEN {_num(kind)} THEN 1.0 WHEN {numeric_str(s)} THEN 0.9
      WHEN {rx(s, started)} THEN 0.85 WHEN upper({s}) = 'S' OR {s} = '-' THEN 0.2 ELSE 0.0 END)::DOUBLE"""


def basename(e: str) -> str:
    return sub(e, r"(?s)^.*/")


def stem(e: str) -> str:
    return sub(basename(e), r"(?s)^(.*[^.].*)\.[^.]*\z", r"\1")


def nul(e: str) -> str:
    return f"nullif({e}, '')"


def fix_prefix(e: str) -> str:
    return f"regexp_replace({e}, '(?i)^SSQRT', 'SQRT')"


def card_number(e: str) -> str:
    b = stem(e)
    digits = rf"^[-_{WS}]?([0-9]{{2,}})(?:[-_{WS}]|\z)"
    full = ext(b, f"(?i)^({X.CARD_NUMBER})")
    with_as = ext(b, f"(?i)^({X.PREFIX_AS})")
    letters = ext(b, "^([A-Za-z]{1,3}[0-9]{2,})")
    return (
        f"coalesce({nul(fix_prefix(f'trim({full}, {lit(chr(45) + chr(32))})'))}, "
        f"{nul(f'trim({with_as}, {lit(chr(45) + chr(32))})')}, {nul(letters)}, {nul(ext(b, digits))}, {b})"
    )


def found_card_number(e: str) -> str:
    hit = ext(e, f"(?i)({X.CARD_NUMBER})")
    return nul(fix_prefix(f"trim({hit}, '- ')"))


def format_group(e: str) -> str:
    b = stem(e)
    return f"coalesce({nul(ext(b, '(?is)^(.*-AS-)'))}, {nul(sub(b, r'[0-9]+' + chr(92) + 'z'))}, {b})"


def decode(marker: str, qty: str, has_qty: str) -> str:
    m = strip(f"coalesce({marker}, '')")
    return (
        f"(CASE WHEN upper({m}) = 'S' AND {has_qty} THEN {quantity(qty)} "
        f"WHEN {m} IN ('-', '–', '—', '') THEN NULL ELSE {quantity(m)} END)"
    )


def false_part(e: str) -> str:
    at = f"instr({e}, {lit(K.FALSE_PART_WORD)})"
    hits = " OR ".join(f"(instr({e}, {lit(p)}) > 0 AND instr({e}, {lit(p)}) < {at})" for p in K.FALSE_PART_PREFIX)
    return f"coalesce({at} > 0 AND ({hits}), false)"


def safe_filename(e: str) -> str:
    s = sub(e, r'[<>:"/\\|?*\x00-\x1f]', "_")
    return f"trim({sub(sub(s, X.DECORATIVE), '[_ .]{2,}', '_')}, '_ .')"


def short_label(e: str, n: int) -> str:
    return f"(CASE WHEN length({e}) > {n} THEN substr({e}, 1, {n - 3}) || '...' ELSE {e} END)"


# --- relations ---------------------------------------------------------------

NUMBER = "lpad(l_partkey::VARCHAR, 8, '0') || '-' || l_linenumber::VARCHAR"
ORD = (
    "concat_ws('-', lpad(l_suppkey::VARCHAR, 8, '0'), lpad(l_orderkey::VARCHAR, 12, '0'), l_linenumber::VARCHAR, "
    "lpad(l_quantity::INT::VARCHAR, 3, '0'), lpad(l_partkey::VARCHAR, 8, '0'), round(l_tax * 100)::INT::VARCHAR)"
)

BOM_LINES = f"""bom_lines AS (
  SELECT *, {part_key('raw')} AS part_key FROM (
  SELECT 'P-' || {NUMBER} AS raw, {ORD} AS ord,
    CASE l_returnflag WHEN 'A' THEN p_name || chr(10) || p_brand WHEN 'N' THEN p_name ELSE '' END AS name_cn,
    CASE WHEN l_discount > 0.02 THEN p_type ELSE '' END AS name_en, l_returnflag AS config,
    'sheet ' || l_linenumber::VARCHAR || CASE WHEN l_linenumber > 4 THEN ' 总装BOM' ELSE '' END AS sheet,
    CASE WHEN l_tax = 0 THEN ' s ' WHEN l_tax < 0.02 THEN '–' WHEN l_tax < 0.03 THEN 'n/a'
      WHEN l_tax < 0.04 THEN l_linenumber::VARCHAR || ',5' ELSE l_linenumber::VARCHAR END AS marker,
    l_quantity::INT::VARCHAR AS qty_cell, l_discount > 0.01 AS has_qty
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O'))"""

CARD_LINES = f"""card_lines AS (
  SELECT *, {part_key('raw')} AS part_key FROM (
  SELECT 'C' || l_suppkey::VARCHAR AS card_no, l_returnflag AS sheet,
    CASE WHEN l_tax > 0.05 THEN 'p_' || replace({NUMBER}, '-', '.') ELSE 'P-' || {NUMBER} END AS raw,
    {ORD} AS ord, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'деталь ' || l_suppkey::VARCHAR END AS name_ru,
    1.0::DOUBLE AS qty, l_quantity AS quantity
  FROM lineitem WHERE l_linestatus = 'F'))"""

DECODED = f"decoded AS (SELECT *, {decode('marker', 'qty_cell', 'has_qty')} AS qty FROM bom_lines)"

RAW = f"""{BOM_LINES}, {CARD_LINES},
bom AS (SELECT config, raw AS part, count(*)::DOUBLE AS qty FROM bom_lines GROUP BY 1, 2),
cards AS (SELECT raw AS part, sum(qty) AS qty, arg_max(name_ru, ord) FILTER (name_ru <> '') AS name_ru FROM card_lines GROUP BY 1),
bom_keys AS (SELECT {part_key('part')} AS k, min(part) AS bom_part FROM bom GROUP BY 1),
card_keys AS (SELECT DISTINCT {part_key('part')} AS k FROM cards),
pairs AS (SELECT c.part AS card_part, b.bom_part FROM cards c JOIN bom_keys b ON {part_key('c.part')} = b.k
          WHERE c.part NOT IN (SELECT part FROM bom)),
configs AS (SELECT DISTINCT config FROM bom)"""


def outcomes(fuzzy: bool = True, strict: bool = False) -> str:
    aside = f"{part_key('b.part')} IN (SELECT k FROM card_keys)" if fuzzy else "false"
    loose = "AND c.part NOT IN (SELECT card_part FROM pairs)" if fuzzy else ""
    sql = f"""outcomes AS (
  SELECT b.config, b.part AS bom_part, c.part AS card_part, b.qty AS qty_bom, coalesce(c.qty, 0.0)::DOUBLE AS qty_cards,
    CASE WHEN c.part IS NULL AND {aside} THEN 'set_aside' WHEN c.part IS NULL THEN 'only_in_bom'
         WHEN abs(b.qty - c.qty) > 0.001 THEN 'qty_mismatch' ELSE 'matched' END AS outcome
  FROM bom b LEFT JOIN cards c ON b.part = c.part
  UNION ALL
  SELECT f.config, NULL, c.part, 0.0::DOUBLE, c.qty, 'only_in_cards' FROM configs f CROSS JOIN cards c
  WHERE NOT EXISTS (SELECT 1 FROM bom b WHERE b.config = f.config AND b.part = c.part) {loose}"""
    if fuzzy:
        sql += """
  UNION ALL
  SELECT b.config, p.bom_part, p.card_part, b.qty, c.qty, 'fuzzy_match'
  FROM pairs p JOIN cards c ON c.part = p.card_part JOIN bom b ON b.part = p.bom_part"""
    if strict:
        sql += """
  UNION ALL
  SELECT f.config, NULL, p.card_part, 0.0::DOUBLE, c.qty, 'only_in_cards'
  FROM pairs p JOIN cards c ON c.part = p.card_part CROSS JOIN configs f
  WHERE NOT EXISTS (SELECT 1 FROM bom b WHERE b.config = f.config AND b.part = p.bom_part)"""
    return sql + ")"


DISC = "disc AS (SELECT config, outcome, bom_part, card_part, qty_bom, qty_cards FROM outcomes WHERE outcome NOT IN ('matched', 'set_aside'))"

SUMMARY = """summary AS (SELECT config, count(*) FILTER (outcome IN ('matched','qty_mismatch','only_in_bom','set_aside')) AS total_bom_parts,
  (SELECT count(*) FROM cards) AS total_cards_parts, count(*) FILTER (outcome = 'matched') AS matched,
  count(*) FILTER (outcome NOT IN ('matched','set_aside')) AS discrepancies,
  count(*) FILTER (outcome = 'only_in_bom') AS only_in_bom, count(*) FILTER (outcome = 'only_in_cards') AS only_in_cards,
  count(*) FILTER (outcome = 'qty_mismatch') AS qty_mismatch, count(*) FILTER (outcome = 'fuzzy_match') AS fuzzy_match
  FROM outcomes GROUP BY config)"""

TEXTS = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
texts AS (SELECT unnest(string_split(line, ' ')) AS v FROM lines UNION ALL SELECT line FROM lines UNION ALL SELECT text FROM documents
  UNION ALL SELECT url FROM pages UNION ALL SELECT replace(value::VARCHAR, '.', ',') FROM events
  UNION ALL SELECT chr(12288) || ' p-' || p_partkey::VARCHAR || '.A_x000D_' || p_name FROM part
  UNION ALL SELECT p_name || '零件 ' || p_size::VARCHAR FROM part UNION ALL SELECT p_size::VARCHAR || 'шт' FROM part
  UNION ALL SELECT '– ' || CASE WHEN p_size > 25 THEN '–' ELSE p_size::VARCHAR END FROM part
  UNION ALL SELECT CASE p_type WHEN 'SMALL' THEN 'S' WHEN 'LARGE' THEN '—' ELSE 'Y' END FROM part)"""

FILES = """files AS (SELECT CASE p_type
   WHEN 'ECONOMY' THEN 'line/SSQRT1L-17-AS-' || k || ' ' || p_name || '.xlsx' WHEN 'MEDIUM' THEN 'A' || k || '-' || p_name || '.xls'
   WHEN 'PROMO' THEN 'shop/' || k || '-作业指导书 ' || p_name || '.XLSX' WHEN 'LARGE' THEN 'cover ' || p_name || '.xlsx'
   WHEN 'SMALL' THEN '__MACOSX/._' || p_name || '.xlsx' ELSE p_brand || '/.hidden ' || k || '.docx' END AS path, p_partkey AS ord
  FROM (SELECT *, lpad(p_partkey::VARCHAR, 5, '0') AS k FROM part)
  UNION ALL SELECT url, -page_id - 1 FROM pages)"""

EVENTS = """card_events AS (SELECT user_id AS job_id, floor((props::JSON->>'$.k')::INT / 10)::BIGINT AS card,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('purchase','signup') THEN 'success' ELSE 'pending' END AS status,
  ts, event_id FROM events)"""

JOBS = """jobs AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'processing'
   WHEN o_orderpriority = '1-URGENT' THEN 'error' ELSE 'awaiting_upload' END AS status, o_orderdate AS created_at,
   o_totalprice > 100000 AS bom_uploaded, o_orderpriority <> '5-LOW' AS archive_uploaded,
   CASE WHEN o_orderpriority = '1-URGENT' THEN '["' || o_orderstatus || '","R"]' WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderstatus END AS selected_config
  FROM orders)"""

PACKAGE = """files AS (SELECT page_id AS file_id, length(html) * CASE WHEN starts_with(url, 'https') THEN 20000 ELSE 1 END AS size FROM pages),
hrefs AS (SELECT DISTINCT page_id AS file_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages),
req AS (SELECT page_id AS file_id, html, url, unnest(['[Content_Types].xml','xl/workbook.xml','xl/_rels/workbook.xml.rels','_rels/.rels','xl/worksheets/sheet1.xml']) AS name FROM pages),
entries AS (SELECT file_id, name, length(html) AS size, true AS crc_ok,
    CASE WHEN contains(name, 'sheet') THEN CASE WHEN p > 5 THEN p ELSE 0 END END AS row_count, p <> 4 AS has_data
  FROM (SELECT *, len(string_split(html, '<p>')) - 1 AS p FROM req)
  WHERE NOT (name = 'xl/_rels/workbook.xml.rels' AND NOT contains(url, '/en/')) AND NOT (name = '_rels/.rels' AND contains(url, 'utm_source'))
    AND NOT (name = 'xl/worksheets/sheet1.xml' AND contains(url, '#top'))
  UNION ALL SELECT file_id, 'xl/media' || h, greatest(length(h) - 4, 0), length(h) <> 9, NULL, true FROM hrefs),
refs AS (SELECT DISTINCT file_id, 'xl/drawings/_rels/drawing1.xml.rels' AS rel_name,
  CASE WHEN length(h) > 8 THEN '/xl/media/copy' || h ELSE 'xl/media' || h END AS target FROM hrefs)"""


def by_value(expr: str) -> str:
    return f"WITH {TEXTS} SELECT {expr} AS out, count(*) AS n FROM texts GROUP BY 1"


def by_path(expr: str) -> str:
    return f"WITH {FILES} SELECT {expr} AS out, count(*) AS n FROM files GROUP BY 1"
