"""Queries: cell expressions, totals, reconciliation, report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import reconcile as R
from ..operators import report as P
from ..operators import totals as A
from ..session import cut
from . import bindings as B
from . import oracle as O
from .registry import query

# --- cell expressions: value histograms over every text ----------------------


def _value_query(name, expr, sql):
    @query(name, O.by_value(sql))
    def run(spark, sf):
        return B.counted_texts(spark, sf).groupBy(expr("v").alias("out")).agg(F.sum("n").alias("n"))


def _path_query(name, expr, sql):
    @query(name, O.by_path(sql))
    def run(spark, sf):
        return B.files(spark, sf).groupBy(expr("path").alias("out")).agg(F.count(F.lit(1)).alias("n"))


_value_query("part_key", X.part_key, O.part_key("v"))
_value_query("quantity", X.quantity, O.quantity("v"))
_value_query("is_part", X.is_part, O.is_part("v"))
_value_query("is_part_lenient", X.is_part_lenient, O.is_part_lenient("v"))
_value_query("clean_name", X.clean_name, O.clean_name("v"))
_value_query("norm_text", X.norm_text, O.norm_text("v"))
_value_query("clean_cell", X.clean_cell, O.clean_cell("v"))
_value_query("score_part", X.score_part, O.score_part("v"))
_value_query("score_name", X.score_name, O.score_name("v"))
_value_query("score_qty", X.score_qty, O.score_qty("v"))
_value_query("is_numeric_str", X.is_numeric_str, O.numeric_str("v"))
_value_query("is_service_sheet", X.is_service_sheet, O.any_of("lower(v)", X.K.SERVICE_SHEET))
_value_query("safe_filename", X.safe_filename, O.safe_filename("v"))
_value_query("short_label", lambda c: X.short_label(c, 52), O.short_label("v", 52))
_value_query(
    "false_part_header",
    lambda c: X.false_part_header(
        F.when(F.contains(F.col(c), F.lit("a")), F.concat(F.lit("更改"), c, F.lit("件号"))).otherwise(F.concat(c, F.lit("件号更改")))
    ),
    O.false_part("(CASE WHEN contains(v, 'a') THEN '更改' || v || '件号' ELSE v || '件号更改' END)"),
)
_path_query("card_number", X.card_number, O.card_number("path"))
_path_query("format_group", X.format_group, O.format_group("path"))
_path_query("fix_card_prefix", lambda c: X.fix_card_prefix(X.basename(c)), O.fix_prefix(O.basename("path")))


@query(
    "safe_name",
    f"""WITH {O.TEXTS}, named AS (SELECT v || '.xlsx' AS s FROM texts WHERE v IS NOT NULL),
    cut AS (SELECT s, left(s, length(s) - 5) AS base, '.xlsx' AS ext FROM named),
    done AS (SELECT CASE WHEN strlen(s) <= 200 THEN s ELSE
      left(base, list_max(list_filter(range(0, 201), lambda i: strlen(left(base, i)) <= 186))::BIGINT) || '_' || left(md5(s), 8) || ext END AS name FROM cut)
    SELECT name AS out, count(*) AS n FROM done GROUP BY 1""",
)
def safe_name(spark, sf):
    named = B.texts(spark, sf).select(F.concat("v", F.lit(".xlsx")).alias("s"))
    return named.groupBy(X.safe_name("s").alias("out")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "decode_config_cell",
    f"WITH {O.BOM_LINES}, {O.DECODED} SELECT marker, has_qty, qty AS decoded, count(*) AS n FROM decoded GROUP BY ALL",
)
def decode_config_cell(spark, sf):
    lines = B.bom_lines(spark, sf)
    return lines.groupBy(
        "marker", "has_qty", X.decode_config_cell("marker", "qty_cell", F.col("has_qty")).alias("decoded")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "formats_equal",
    f"""WITH {O.CARD_LINES} SELECT card_no, count(*) FILTER ({O.part_key('raw')} = {O.part_key("'P-' || substr(raw, 3)")}) AS same,
    count(*) FILTER ({O.part_key('raw')} = {O.part_key("raw || '0'")}) AS other FROM card_lines GROUP BY 1""",
)
def formats_equal(spark, sf):
    other = F.concat(F.lit("P-"), F.substr("raw", F.lit(3)))
    return B.card_lines(spark, sf).groupBy("card_no").agg(
        F.count(F.when(X.formats_equal("raw", other), 1)).alias("same"),
        F.count(F.when(X.formats_equal("raw", F.concat("raw", F.lit("0"))), 1)).alias("other"),
    )


@query(
    "percent",
    """WITH c AS (SELECT user_id AS job_id, count(*) FILTER (event_type = 'purchase') AS p,
    count(*) FILTER (event_type = 'error') AS f, count(*) AS t FROM events GROUP BY 1)
    SELECT job_id, CASE WHEN t > 0 THEN round_even((p + f)::DOUBLE / t * 100, 1) ELSE 0.0 END AS percent FROM c""",
)
def percent(spark, sf):
    e = B.table(spark, sf, "events")
    counts = e.groupBy(F.col("user_id").alias("job_id")).agg(
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("p"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("f"),
        F.count(F.lit(1)).alias("t"),
    )
    return counts.select("job_id", X.percent("p", "f", "t").alias("percent"))


# --- totals ------------------------------------------------------------------


@query(
    "bom_quantities",
    f"WITH {O.BOM_LINES}, {O.DECODED} SELECT config, part_key, sum(qty) AS qty FROM decoded WHERE qty > 0 GROUP BY 1, 2",
)
def bom_quantities(spark, sf):
    return A.bom_quantities(B.bom_lines(spark, sf))


@query(
    "sheet_configs",
    f"""WITH {O.BOM_LINES} SELECT CASE WHEN regexp_matches(lower(sheet), '总装bom|涂装bom|焊装bom') THEN 'MULTI_SHEET_COMBINED' ELSE sheet END AS config,
    part_key, sum({O.quantity('qty_cell')}) AS qty FROM bom_lines WHERE {O.quantity('qty_cell')} > 0 GROUP BY 1, 2""",
)
def sheet_configs(spark, sf):
    return A.sheet_configs(B.bom_lines(spark, sf))


@query("first_original", f"WITH {O.CARD_LINES} SELECT part_key, arg_min(raw, ord) AS original FROM card_lines GROUP BY 1")
def first_original(spark, sf):
    return A.first_original(B.card_lines(spark, sf))


NAMES = f"""names AS (SELECT part_key,
  coalesce(arg_min({O.clean_cell('name_cn')}, ord) FILTER ({O.clean_cell('name_cn')} <> ''), '') AS name_cn,
  coalesce(arg_min({O.clean_cell('name_en')}, ord) FILTER ({O.clean_cell('name_en')} <> ''), '') AS name_en
  FROM bom_lines GROUP BY 1)"""


@query("part_names", f"WITH {O.BOM_LINES}, {NAMES} SELECT * FROM names")
def part_names(spark, sf):
    return A.part_names(B.bom_lines(spark, sf))


@query(
    "applicable",
    f"WITH {O.BOM_LINES}, {O.DECODED} SELECT part_key, config, min(ord) AS ord FROM decoded WHERE qty > 0 GROUP BY 1, 2",
)
def applicable(spark, sf):
    return A.applicable(B.bom_lines(spark, sf))


@query("config_order", f"WITH {O.BOM_LINES}, {O.DECODED} SELECT config, min(ord) AS ord FROM decoded WHERE qty > 0 GROUP BY 1")
def config_order(spark, sf):
    return A.config_order(B.bom_lines(spark, sf))


@query(
    "prune_parts",
    f"""WITH {O.BOM_LINES}, {O.DECODED} SELECT part_key, arg_min(raw, ord) AS original FROM bom_lines
    WHERE part_key IN (SELECT part_key FROM decoded WHERE qty > 0) GROUP BY 1""",
)
def prune_parts(spark, sf):
    lines = B.bom_lines(spark, sf)
    return A.prune_parts(A.first_original(lines), A.bom_quantities(lines))


@query(
    "backfill_names",
    f"""WITH {O.BOM_LINES}, {NAMES}, parts AS (SELECT part_key, max(CASE WHEN config = 'R' THEN name_en ELSE '' END) AS en FROM bom_lines GROUP BY 1)
    SELECT part_key, CASE WHEN en = '' THEN n.name_cn ELSE '' END AS name_cn, CASE WHEN en = '' THEN n.name_en ELSE en END AS name_en
    FROM parts LEFT JOIN names n USING (part_key)""",
)
def backfill_names(spark, sf):
    lines = B.bom_lines(spark, sf)
    own = lines.groupBy("part_key").agg(
        F.lit("").alias("name_cn"),
        F.max(F.when(F.col("config") == "R", F.col("name_en")).otherwise("")).alias("name_en"),
    )
    return A.backfill_names(own, A.part_names(lines))


@query("card_part_totals", f"WITH {O.CARD_LINES} SELECT card_no, part_key, sum(quantity) AS qty FROM card_lines GROUP BY 1, 2")
def card_part_totals(spark, sf):
    return A.card_part_totals(B.card_lines(spark, sf).drop("qty").withColumnRenamed("quantity", "qty"))


@query(
    "card_totals",
    f"""WITH {O.CARD_LINES} SELECT part_key, sum(quantity) AS qty, arg_min(raw, ord) AS original,
    coalesce(arg_max(name_ru, ord) FILTER (name_ru <> ''), '') AS name_ru FROM card_lines GROUP BY 1""",
)
def card_totals(spark, sf):
    return A.card_totals(B.card_lines(spark, sf).drop("qty").withColumnRenamed("quantity", "qty"))


@query(
    "last_name_ru",
    f"WITH {O.CARD_LINES} SELECT part_key, coalesce(arg_max(name_ru, ord) FILTER (name_ru <> ''), '') AS name_ru FROM card_lines GROUP BY 1",
)
def last_name_ru(spark, sf):
    return A.last_name_ru(B.card_lines(spark, sf))


@query("part_sources", f"WITH {O.CARD_LINES} SELECT part_key, ord, card_no, sheet, qty FROM card_lines")
def part_sources(spark, sf):
    return A.part_sources(B.card_lines(spark, sf))


@query("card_numbers", f"WITH {O.CARD_LINES} SELECT part_key, card_no, min(ord) AS ord FROM card_lines GROUP BY 1, 2")
def card_numbers(spark, sf):
    return A.card_numbers(B.card_lines(spark, sf))


@query(
    "load_metrics",
    f"""WITH {O.CARD_LINES} SELECT count(DISTINCT card_no) AS cards, count(DISTINCT (card_no, sheet)) AS sheets, count(*) AS lines,
    count(DISTINCT part_key) AS unique_parts, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed FROM card_lines""",
)
def load_metrics(spark, sf):
    return A.load_metrics(B.card_lines(spark, sf), B.table(spark, sf, "events").filter("event_type = 'error'"))


@query(
    "translate",
    """WITH dict AS (SELECT n_name AS source, min(r_name) AS target FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 2 GROUP BY 1)
    SELECT c_custkey, n_name AS name_cn, coalesce(target, n_name) AS name_ru
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN dict ON source = n_name""",
)
def translate(spark, sf):
    nation, region = B.table(spark, sf, "nation"), B.table(spark, sf, "region")
    words = nation.join(region, nation.n_regionkey == region.r_regionkey).filter("n_regionkey <> 2").select(
        F.col("n_name").alias("source"), F.col("r_name").alias("target")
    )
    rows = B.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return A.translate(rows.select("c_custkey", F.col("n_name").alias("name_cn")), words)


@query(
    "valid_bom_rows",
    f"""WITH {O.TEXTS}, c AS (SELECT {O.clean_cell('v')} AS raw FROM texts)
    SELECT raw, {O.part_key('raw')} AS part_key, count(*) AS n FROM c WHERE raw <> '' AND NOT starts_with(raw, '~$') AND {O.is_part('raw')} GROUP BY ALL""",
)
def valid_bom_rows(spark, sf):
    rows = A.valid_bom_rows(B.counted_texts(spark, sf).withColumnRenamed("v", "raw"))
    return rows.groupBy("raw", "part_key").agg(F.sum("n").alias("n"))


@query(
    "valid_card_rows",
    f"""WITH {O.TEXTS}, c AS (SELECT {O.strip('v')} AS raw FROM texts)
    SELECT raw, {O.part_key('raw')} AS part_key, count(*) AS n FROM c WHERE raw <> '' AND {O.is_part(O.part_key('raw'))} GROUP BY ALL""",
)
def valid_card_rows(spark, sf):
    rows = A.valid_card_rows(B.counted_texts(spark, sf).withColumnRenamed("v", "raw"))
    return rows.groupBy("raw", "part_key").agg(F.sum("n").alias("n"))


@query(
    "positive_qty",
    "SELECT c_custkey, c_acctbal AS qty FROM customer WHERE c_acctbal > 0",
)
def positive_qty(spark, sf):
    return A.positive_qty(B.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("qty")))


@query("clamp_qty", "SELECT c_custkey, greatest(c_acctbal - 5000, 0.0) AS qty FROM customer")
def clamp_qty(spark, sf):
    return A.clamp_qty(
        B.table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") - 5000).alias("qty"))
    )


@query(
    "select_configs",
    f"""WITH {O.BOM_LINES}, {O.DECODED}, q AS (SELECT config, part_key, sum(qty) AS qty FROM decoded WHERE qty > 0 GROUP BY 1, 2)
    SELECT * FROM q WHERE config IN (SELECT DISTINCT upper(substr(o_orderstatus, 1, 1)) FROM orders UNION SELECT l_returnflag FROM lineitem WHERE l_tax > 0.07 AND l_returnflag <> 'N')""",
)
def select_configs(spark, sf):
    chosen = (
        B.table(spark, sf, "lineitem").filter("l_tax > 0.07 AND l_returnflag <> 'N'").select(F.col("l_returnflag").alias("config"))
    )
    return A.select_configs(A.bom_quantities(B.bom_lines(spark, sf)), chosen)


# --- reconciliation ----------------------------------------------------------

CORE = f"WITH {O.RAW}, {O.outcomes()}, {O.DISC}, {O.SUMMARY}"


def _raw(spark, sf):
    """Both sides as tables: a comparison reads them several times."""
    return cut(B.raw_bom_qty(spark, sf)), cut(B.raw_cards(spark, sf))


def _outcomes(spark, sf, **kw):
    return R.outcomes(*_raw(spark, sf), **kw)


def _disc(spark, sf, **kw):
    return R.reconcile(*_raw(spark, sf), **kw).drop("valid")


def _of(spark, sf, kind):
    return _disc(spark, sf).filter(F.col("outcome") == kind)


def _detailed(spark, sf):
    bom, cards = _raw(spark, sf)
    return cut(R.with_details(R.reconcile(bom, cards), B.raw_names(spark, sf), cards))


def _numbered(spark, sf):
    """Configurations numbered by first use; one row per configuration."""
    order = B.bom_lines(spark, sf).groupBy("config").agg(F.min("ord").alias("ord"))
    return order.select("config", F.row_number().over(Window.orderBy("ord", "config")).alias("config_no"))


@query("format_pairs", f"WITH {O.RAW} SELECT * FROM pairs")
def format_pairs(spark, sf):
    bom, cards = _raw(spark, sf)
    return R.format_pairs(bom, cards)


@query("reconcile", f"{CORE} SELECT * FROM disc")
def reconcile(spark, sf):
    return _disc(spark, sf)


for _kind in ("only_in_bom", "only_in_cards", "qty_mismatch", "fuzzy_match"):
    query(_kind if _kind != "fuzzy_match" else "format_mismatch", f"{CORE} SELECT * FROM disc WHERE outcome = '{_kind}'")(
        lambda spark, sf, kind=_kind: _of(spark, sf, kind)
    )


@query("reconcile_exact", f"WITH {O.RAW}, {O.outcomes(fuzzy=False)}, {O.DISC} SELECT * FROM disc")
def reconcile_exact(spark, sf):
    return _disc(spark, sf, fuzzy=False)


@query("reconcile_strict_pairs", f"WITH {O.RAW}, {O.outcomes(strict=True)}, {O.DISC} SELECT * FROM disc")
def reconcile_strict_pairs(spark, sf):
    return _disc(spark, sf, strict_pairs=True)


@query("reconcile_one", f"{CORE} SELECT * FROM disc WHERE config = 'A'")
def reconcile_one(spark, sf):
    bom, cards = _raw(spark, sf)
    return R.reconcile_one(bom, cards, "A").drop("valid")


@query("reconcile_given_pairs", f"{CORE} SELECT * FROM disc")
def reconcile_given_pairs(spark, sf):
    bom, cards = _raw(spark, sf)
    return R.reconcile(bom, cards, pairs=R.format_pairs(bom, cards)).drop("valid")


@query(
    "reconcile_keys",
    f"""WITH {O.BOM_LINES}, {O.CARD_LINES}, bom AS (SELECT config, part_key AS part, count(*)::DOUBLE AS qty FROM bom_lines GROUP BY 1, 2),
    cards AS (SELECT part_key AS part, sum(qty) AS qty FROM card_lines GROUP BY 1), configs AS (SELECT DISTINCT config FROM bom),
    {O.outcomes(fuzzy=False)}, {O.DISC} SELECT * FROM disc""",
)
def reconcile_keys(spark, sf):
    """On part keys, as the pipeline feeds it: a format pair can no longer appear."""
    bom = B.bom_lines(spark, sf).groupBy("config", F.col("part_key").alias("part")).agg(
        F.count(F.lit(1)).cast("double").alias("qty")
    )
    cards = B.card_lines(spark, sf).groupBy(F.col("part_key").alias("part")).agg(F.sum("qty").alias("qty"))
    return R.reconcile(cut(bom), cut(cards)).drop("valid")


@query("config_summary", f"{CORE} SELECT * FROM summary")
def config_summary(spark, sf):
    return R.summarise(*_raw(spark, sf))


@query("config_summary_listed", f"{CORE} SELECT * FROM summary")
def config_summary_listed(spark, sf):
    """The same counts from the listed outcomes."""
    bom, cards = _raw(spark, sf)
    return R.config_summary(R.outcomes(bom, cards), cards, bom)


@query("config_summary_strict_pairs", f"WITH {O.RAW}, {O.outcomes(strict=True)}, {O.SUMMARY} SELECT * FROM summary")
def config_summary_strict_pairs(spark, sf):
    return R.summarise(*_raw(spark, sf), strict_pairs=True)


RAW_NAMES = f"""raw_names AS (SELECT raw AS part,
  coalesce(arg_min({O.clean_cell('name_cn')}, ord) FILTER ({O.clean_cell('name_cn')} <> ''), '') AS name_cn,
  coalesce(arg_min({O.clean_cell('name_en')}, ord) FILTER ({O.clean_cell('name_en')} <> ''), '') AS name_en FROM bom_lines GROUP BY 1)"""
DETAILED = f"""{RAW_NAMES}, detailed AS (SELECT config, outcome, coalesce(card_original, bom_part) AS part_number, bom_part, card_part, coalesce(name_cn, '') AS name_cn,
  coalesce(name_en, '') AS name_en, coalesce(name_ru, '') AS name_ru, qty_bom, qty_cards
  FROM (SELECT d.*, c.part AS card_original, c.name_ru FROM disc d LEFT JOIN cards c ON c.part = d.card_part) d
  LEFT JOIN raw_names n ON n.part = coalesce(d.bom_part, d.card_part))"""


@query("discrepancy_details", f"{CORE}, {DETAILED} SELECT * FROM detailed")
def discrepancy_details(spark, sf):
    return _detailed(spark, sf)


@query(
    "order_discrepancies",
    f"""{CORE}, {DETAILED} SELECT config, outcome, part_number, bom_part, card_part, qty_bom, qty_cards FROM detailed ORDER BY config,
    list_position(['qty_mismatch','only_in_bom','only_in_cards','fuzzy_match'], outcome), part_number""",
)
def order_discrepancies(spark, sf):
    return R.order_discrepancies(_detailed(spark, sf)).drop("name_cn", "name_en", "name_ru")


LOOKUP = f"""WITH {O.BOM_LINES}, {O.DECODED}, {NAMES}, q AS (SELECT config, part_key, sum(qty) AS qty FROM decoded WHERE qty > 0 GROUP BY 1, 2),
  own AS (SELECT part_key, '' AS name_cn, max(name_en) AS name_en FROM bom_lines GROUP BY 1 HAVING bool_or(config = 'R'))"""


def _own_names(spark, sf):
    """Names over all lines of a part, for parts that configuration R has."""
    named = B.bom_lines(spark, sf).groupBy("part_key").agg(F.max("name_en").alias("name_en"), F.bool_or(F.col("config") == "R").alias("own"))
    return named.filter("own").select("part_key", F.lit("").alias("name_cn"), "name_en")


@query(
    "config_parts",
    f"""{LOOKUP} SELECT config, q.part_key, qty, CASE WHEN o.part_key IS NOT NULL THEN o.name_cn ELSE n.name_cn END AS name_cn,
    CASE WHEN o.part_key IS NOT NULL THEN o.name_en ELSE n.name_en END AS name_en FROM q LEFT JOIN own o ON o.part_key = q.part_key LEFT JOIN names n ON n.part_key = q.part_key""",
)
def config_parts(spark, sf):
    lines = B.bom_lines(spark, sf)
    return R.config_parts(A.bom_quantities(lines), _own_names(spark, sf), A.part_names(lines))


@query(
    "lookup_names",
    f"""{LOOKUP}, w AS (SELECT DISTINCT {O.part_key("'P' || lpad(l_partkey::VARCHAR, 8, '0') || l_linenumber::VARCHAR")} AS part_key FROM lineitem)
    SELECT w.part_key, coalesce(CASE WHEN coalesce(o.name_en, '') <> '' THEN o.name_cn ELSE n.name_cn END, '') AS name_cn,
    coalesce(CASE WHEN coalesce(o.name_en, '') <> '' THEN o.name_en ELSE n.name_en END, '') AS name_en
    FROM w LEFT JOIN own o ON o.part_key = w.part_key LEFT JOIN names n ON n.part_key = w.part_key""",
)
def lookup_names(spark, sf):
    number = F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.col("l_linenumber").cast("string"))
    wanted = B.table(spark, sf, "lineitem").select(X.part_key(number).alias("part_key")).distinct()
    return R.lookup_names(wanted, _own_names(spark, sf), A.part_names(B.bom_lines(spark, sf)))


@query("config_catalog", f"WITH {O.RAW} SELECT config, count(*) AS parts FROM bom GROUP BY 1")
def config_catalog(spark, sf):
    return R.config_catalog(B.raw_bom_qty(spark, sf), "part")


@query("part_catalog", f"WITH {O.RAW} SELECT DISTINCT part FROM bom")
def part_catalog(spark, sf):
    return R.part_catalog(B.raw_bom_qty(spark, sf), "part")


@query(
    "integrity",
    f"""{CORE} SELECT config, total_bom_parts, matched + only_in_bom + qty_mismatch + fuzzy_match AS accounted,
    matched + only_in_bom + qty_mismatch + fuzzy_match - total_bom_parts AS diff,
    matched + only_in_bom + qty_mismatch + fuzzy_match = total_bom_parts AS is_ok, matched, only_in_bom, qty_mismatch, fuzzy_match FROM summary""",
)
def integrity(spark, sf):
    bom, cards = _raw(spark, sf)
    return R.integrity(R.summarise(bom, cards))


@query(
    "integrity_global",
    f"""{CORE}, by_type AS (SELECT outcome, sum(n) AS n FROM (SELECT unnest(['only_in_bom', 'only_in_cards', 'qty_mismatch', 'fuzzy_match']) AS outcome,
      unnest([only_in_bom, only_in_cards, qty_mismatch, fuzzy_match]) AS n FROM summary) GROUP BY 1)
    SELECT *, total = typed AS is_ok FROM (SELECT (SELECT count(*) FROM disc) AS total, (SELECT sum(n) FROM by_type)::BIGINT AS typed)""",
)
def integrity_global(spark, sf):
    bom, cards = _raw(spark, sf)
    counted = R.count_discrepancies(*R.split_outcomes(bom, cards, R.config_words(bom)))
    return R.integrity_global(P.totals_of(P.levels(R.summarise(bom, cards))), counted)


@query(
    "run_totals",
    f"WITH {O.RAW} SELECT count(DISTINCT config) AS total_configs, count(DISTINCT part) AS bom_unique_parts, (SELECT count(*) FROM cards) AS cards_unique_parts FROM bom",
)
def run_totals(spark, sf):
    return R.run_totals(*_raw(spark, sf))


# --- report tables -----------------------------------------------------------


@query("report_totals", f"{CORE} SELECT outcome, count(*) AS n FROM disc GROUP BY 1")
def report_totals(spark, sf):
    return P.totals_of(P.levels(R.summarise(*_raw(spark, sf))))


@query(
    "report_levels",
    f"""{CORE}, cells AS (SELECT config, unnest(['only_in_bom', 'only_in_cards', 'qty_mismatch', 'fuzzy_match']) AS outcome,
      unnest([only_in_bom, only_in_cards, qty_mismatch, fuzzy_match]) AS n FROM summary)
    SELECT config, outcome, sum(n)::BIGINT AS n, grouping_id(config, outcome)::INT AS level FROM cells GROUP BY GROUPING SETS ((config, outcome), (config), (outcome), ())""",
)
def report_levels(spark, sf):
    return P.levels(R.summarise(*_raw(spark, sf)))


@query(
    "report_per_config",
    f"""{CORE} SELECT {O.short_label('config', 52)} AS config_label, config, total_bom_parts, total_cards_parts, matched, discrepancies,
    only_in_bom, only_in_cards, qty_mismatch FROM summary""",
)
def report_per_config(spark, sf):
    bom, cards = _raw(spark, sf)
    return P.per_config(R.summarise(bom, cards))


FIRST_CARDS = """first_cards AS (SELECT part, string_agg(card_no, ', ' ORDER BY n) AS card_list FROM (
  SELECT part, card_no, row_number() OVER (PARTITION BY part ORDER BY ord, card_no) AS n FROM
  (SELECT raw AS part, card_no, min(ord) AS ord FROM card_lines GROUP BY 1, 2)) WHERE n <= 5 GROUP BY 1)"""
KIND = """CASE outcome WHEN 'only_in_bom' THEN 'Есть в BOM, нет в операционных картах' WHEN 'only_in_cards' THEN 'Есть в операционных картах, нет в BOM'
  WHEN 'qty_mismatch' THEN 'Разное количество' ELSE 'Разный формат номера' END"""


@query(
    "report_detail",
    f"""{CORE}, {DETAILED}, {FIRST_CARDS} SELECT part_number, name_cn, coalesce(nullif(name_ru, ''), name_en) AS name_ru, config, substr(config, 1, 70) AS config_label,
    qty_bom, qty_cards, coalesce(card_list, '') AS card_list, {KIND} AS kind FROM detailed d LEFT JOIN first_cards f ON f.part = d.card_part""",
)
def report_detail(spark, sf):
    used = B.card_lines(spark, sf).groupBy(F.col("raw").alias("part_key"), "card_no").agg(F.min("ord").alias("ord"))
    return P.detail(_detailed(spark, sf), used)


@query(
    "report_format_sheet",
    f"{CORE} SELECT card_part, bom_part, qty_bom, qty_cards, config, substr(config, 1, 70) AS config_label FROM disc WHERE outcome = 'fuzzy_match'",
)
def report_format_sheet(spark, sf):
    return P.format_sheet(_disc(spark, sf))


@query(
    "report_bom_matrix",
    f"""WITH {O.BOM_LINES}, {O.DECODED}, {NAMES}, q AS (SELECT config, part_key, sum(qty) AS qty FROM decoded WHERE qty > 0 GROUP BY 1, 2)
    SELECT part_key, any_value(name_cn) AS name_cn, any_value(name_en) AS name_en, sum(qty) FILTER (config = 'A') AS "A", sum(qty) FILTER (config = 'N') AS "N", sum(qty) FILTER (config = 'R') AS "R"
    FROM q LEFT JOIN names USING (part_key) GROUP BY 1""",
)
def report_bom_matrix(spark, sf):
    lines = B.bom_lines(spark, sf)
    return P.bom_matrix(A.bom_quantities(lines), A.part_names(lines), ["A", "N", "R"])


@query(
    "report_file_errors",
    f"""WITH d AS (SELECT {O.basename('url')} AS file, {O.sub('url', r'(?s)/?[^/]*' + chr(92) + 'z')} AS folder, 'unclosed tag' AS error, 'parse' AS phase FROM pages WHERE contains(html, '%%%')),
    l AS (SELECT {O.basename('url')} AS file, {O.sub('url', r'(?s)/?[^/]*' + chr(92) + 'z')} AS folder, '' AS error, 'split' AS phase FROM pages)
    SELECT * FROM d UNION ALL SELECT * FROM l WHERE file NOT IN (SELECT file FROM d)""",
)
def report_file_errors(spark, sf):
    pages = B.table(spark, sf, "pages")
    detailed = pages.filter(F.contains("html", F.lit("%%%"))).select(
        X.basename("url").alias("file"),
        F.regexp_replace("url", r"(?s)/?[^/]*\z", "").alias("folder"),
        F.lit("unclosed tag").alias("error"),
        F.lit("parse").alias("phase"),
    )
    return P.file_errors(detailed, pages.select(F.col("url").alias("path")))


NUMBERED = "numbered AS (SELECT config, row_number() OVER (ORDER BY min(ord), config) AS config_no FROM bom_lines GROUP BY config)"


@query(
    "report_matrix_rows",
    f"""WITH {O.BOM_LINES}, {O.DECODED}, q AS (SELECT config, part_key, sum(qty) AS qty FROM decoded WHERE qty > 0 GROUP BY 1, 2),
    p AS (SELECT part_key, arg_min(raw, ord) AS original, coalesce(arg_min({O.clean_cell('name_cn')}, ord) FILTER ({O.clean_cell('name_cn')} <> ''), '') AS name_cn,
      coalesce(arg_min({O.clean_cell('name_en')}, ord) FILTER ({O.clean_cell('name_en')} <> ''), '') AS name_en FROM bom_lines GROUP BY 1)
    SELECT part_key, original, name_cn, name_en, config, {O.short_label('config', 25)} AS config_label, qty FROM q JOIN p USING (part_key)""",
)
def report_matrix_rows(spark, sf):
    """Every part and configuration with its number as written, names and label."""
    lines = cut(B.bom_lines(spark, sf))
    first = lambda n: F.coalesce(F.min_by(X.clean_cell(n), F.when(X.clean_cell(n) != "", F.col("ord"))), F.lit("")).alias(n)
    parts = lines.groupBy("part_key").agg(F.min_by("raw", "ord").alias("original"), first("name_cn"), first("name_en"))
    return P.matrix_rows(A.bom_quantities(lines), parts)


@query(
    "report_digest",
    f"""{CORE}, {DETAILED}, {NUMBERED}, r AS (SELECT * FROM detailed JOIN numbered USING (config) WHERE outcome <> 'fuzzy_match'),
    f AS (SELECT outcome, part_number, qty_bom, qty_cards, row_number() OVER (PARTITION BY outcome, part_number ORDER BY config_no) AS k FROM r),
    c AS (SELECT outcome, part_number, array_to_string(list_sort(list(DISTINCT config_no)), ',') AS config_nos FROM r GROUP BY 1, 2),
    t AS (SELECT outcome, part_number, qty_bom, qty_cards, row_number() OVER (PARTITION BY outcome ORDER BY part_number) AS n, count(*) OVER (PARTITION BY outcome) AS parts FROM f WHERE k = 1),
    e AS (SELECT outcome, count(*) AS entries FROM r GROUP BY 1)
    SELECT outcome, n, part_number, qty_bom, qty_cards, config_nos, entries, greatest(parts - 30, 0) AS more
    FROM t JOIN c USING (outcome, part_number) JOIN e USING (outcome) WHERE n <= 30""",
)
def report_digest(spark, sf):
    bom, cards = _raw(spark, sf)
    numbered, names = cut(_numbered(spark, sf)), B.raw_names(spark, sf)
    listed, bits = R.split_outcomes(bom, cards, R.config_words(numbered))
    direct = R.with_details(listed.filter(F.col("valid") & F.col("outcome").isin(R.TYPE_RANK)), names, cards)
    surplus = R.with_details(bits.filter("valid"), names, cards, carry=("word", "lacking"))
    return P.digest(direct, surplus, numbered)


@query(
    "report_config_digest",
    f"{CORE}, {NUMBERED} SELECT config_no, matched, discrepancies, {O.short_label('config', 53)} AS config_label FROM summary JOIN numbered USING (config)",
)
def report_config_digest(spark, sf):
    bom, cards = _raw(spark, sf)
    return P.config_digest(R.summarise(bom, cards), _numbered(spark, sf))


@query(
    "report_single_config",
    f"""{CORE}, {DETAILED} SELECT outcome, list_position(['qty_mismatch','only_in_bom','only_in_cards','fuzzy_match'], outcome)::INT AS rank, part_number, qty_bom, qty_cards
    FROM detailed WHERE config = 'N' AND outcome <> 'fuzzy_match'""",
)
def report_single_config(spark, sf):
    return P.single_config_digest(_detailed(spark, sf), "N")
