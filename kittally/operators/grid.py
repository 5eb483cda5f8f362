"""Header, column-role and configuration detection over exploded workbooks.

cells(file_id, sheet_idx, sheet, row, col, value, num, kind, strike): one row per non-empty
cell; ``kind`` is n, s, b or d. Every rule is a grouped aggregate per row or per column over
all sheets at once; only headers and column summaries, which are small, are ranked in windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import text as X
from .scan import SHEET

LAST_ROW, LAST_COL = 1_048_576, 16_384  # fixed by the file format
ROW_BLOCK = 1024
ROLES = ["part_no", "name_cn", "name_en", "qty"]
HEADER_ROWS = 30  # headers are looked for in these rows, so samples of data end soon after them


def sheet_extent(cells: DataFrame) -> DataFrame:
    """Used size of each sheet."""
    return cells.groupBy(*SHEET, "sheet").agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"))


def row_spine(cells: DataFrame) -> DataFrame:
    """Every row number of every sheet, empty rows too."""
    return sheet_extent(cells).select(*SHEET, "max_row", F.explode(F.sequence(F.lit(1), "max_row")).alias("row"))


def clip_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges of whole columns or rows cut to the sheet's extent.

    A rectangle that reaches the last row or column of the file format covers whole columns or rows. It is taken as
    far as cells and other merges reach, which is all that anyone reads of it.
    """
    endless_rows, endless_cols = F.col("max_row") >= LAST_ROW, F.col("max_col") >= LAST_COL
    reach = cells.select(*SHEET, F.col("row").alias("_r"), F.col("col").alias("_c")).unionByName(
        merges.select(*SHEET, F.when(endless_rows, F.col("min_row")).otherwise(F.col("max_row")).alias("_r"), F.when(endless_cols, F.col("min_col")).otherwise(F.col("max_col")).alias("_c"))
    )
    extent = reach.groupBy(*SHEET).agg(F.max("_r").alias("_r"), F.max("_c").alias("_c"))
    return merges.join(extent, SHEET).withColumns(
        {"max_row": F.when(endless_rows, F.col("_r")).otherwise(F.col("max_row")), "max_col": F.when(endless_cols, F.col("_c")).otherwise(F.col("max_col"))}
    ).drop("_r", "_c")


def fill_merged(cells: DataFrame, merges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Empty cells of a merged rectangle take its top-left value (G1).

    ``asked(file_id, sheet_idx, row)`` names the rows that are wanted; by default all rows of a rectangle are. Asked rows
    meet rectangles by blocks of rows, so a tall rectangle is there once per block, not once per row.
    """
    clipped = clip_merges(cells, merges)
    if asked is None:
        rows = clipped.withColumn("row", F.explode(F.sequence("min_row", "max_row")))
    else:
        block = lambda c: F.floor(F.col(c) / ROW_BLOCK)
        blocks = clipped.withColumn("_block", F.explode(F.sequence(block("min_row"), block("max_row"))))
        wanted = asked.select(*SHEET, "row").distinct().withColumn("_block", block("row"))
        rows = blocks.join(wanted, [*SHEET, "_block"]).filter(F.col("row").between(F.col("min_row"), F.col("max_row")))
    covered = (
        rows.withColumn("col", F.explode(F.sequence("min_col", "max_col")))
        .filter((F.col("row") != F.col("min_row")) | (F.col("col") != F.col("min_col")))
        .select(*SHEET, "row", "col", "min_row", "min_col")
        .join(cells.select(*SHEET, "row", "col"), [*SHEET, "row", "col"], "left_anti")
    )
    source = cells.select(
        *SHEET, F.col("row").alias("min_row"), F.col("col").alias("min_col"), "sheet", "value", "num", "kind"
    )
    filled = covered.join(source, [*SHEET, "min_row", "min_col"]).select(
        *SHEET, "sheet", "row", "col", "value", "num", "kind", F.lit(False).alias("strike")
    )
    return cells.select(*filled.columns).unionByName(filled)


def snapshot(cells: DataFrame, rows: int = 300, cols: int = 200) -> DataFrame:
    """Top of each sheet as one value array per non-empty row, trailing blanks cut."""
    top = cells.filter((F.col("row") <= rows) & (F.col("col") <= cols))
    packed = top.groupBy(*SHEET, "row").agg(
        F.max("col").alias("_w"),
        F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_m"),
    )
    return packed.select(
        *SHEET,
        "row",
        F.transform(F.sequence(F.lit(1), "_w"), lambda c: F.try_element_at("_m", c)).alias("values"),
    )


def truthy() -> Column:
    """Cells that count as filled when zero and false read as empty."""
    return ~F.coalesce(F.col("kind").isin("n", "b") & (F.col("num") == 0), F.lit(False))


def non_blank() -> Column:
    return (F.col("kind") != "s") | (X.strip("value") != "")


# --- headers -----------------------------------------------------------------


def score_headers(cells: DataFrame, cols: int = 29) -> DataFrame:
    """How much each of the first rows looks like a header."""
    extent = sheet_extent(cells).select(*SHEET, "sheet", F.least("max_col", F.lit(cols)).alias("width"))
    v = F.col("_v")

    def hits(words: list[str]) -> Column:
        return F.count(F.when(X.has_any(v, words), 1))

    top = (
        cells.filter((F.col("row") <= HEADER_ROWS) & (F.col("col") <= cols) & truthy())
        .withColumn("_v", X.norm_text("value"))
        .filter(v != "")
    )
    counted = top.groupBy(*SHEET, "row").agg(
        hits(K.PART_NO).alias("p"),
        hits(K.NAME).alias("n"),
        hits(K.QTY).alias("q"),
        hits(K.META).alias("m"),
        F.count(F.lit(1)).alias("filled"),
    )
    total = (
        F.col("p") * 2.0
        + F.col("n") * 1.5
        + F.col("q") * 1.5
        + F.col("m") * 0.5
        + F.col("filled") / F.col("width") * 0.5
    )
    return counted.join(extent, SHEET).select(
        *SHEET, "sheet", "row", F.round(total / (F.col("width") * 2.0), 6).alias("score")
    )


def pick_headers(scores: DataFrame) -> DataFrame:
    """Header rows of each sheet in falling score (G5); ``pos`` 1 is the best."""
    w = Window.partitionBy(*SHEET)
    ranked = scores.withColumn("pos", F.row_number().over(w.orderBy(F.desc("score"), "row")))
    bonus = F.when((F.col("pos") == 1) & X.has_any(F.lower("sheet"), K.BOM_SHEET_NAME), 0.05).otherwise(0.0)
    lifted = ranked.withColumn("score", F.round(F.col("score") + bonus, 6))
    best = F.max(F.when(F.col("pos") == 1, F.col("score"))).over(w)
    return (
        lifted.withColumn("_best", best)
        .filter(F.col("score") >= F.greatest(F.col("_best") * 0.4, F.lit(0.18)))
        .select(*SHEET, "row", "pos", "score")
    )


def header_span(headers: DataFrame) -> DataFrame:
    """Best header row, and the row after which data starts, per sheet."""
    return headers.groupBy(*SHEET).agg(
        F.min_by("row", "pos").alias("header_row"), (F.max_by("row", "pos") + 1).alias("data_start")
    )


def header_text(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Joined text of all header rows, per column."""
    found = cells.filter((F.col("row") <= HEADER_ROWS) & truthy()).join(headers.select(*SHEET, "row", "pos"), [*SHEET, "row"])
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return (
        found.groupBy(*SHEET, "col")
        .agg(F.lower(X.strip(F.array_join(F.transform(ordered, lambda c: c["value"]), " "))).alias("text"))
        .filter("text <> ''")
    )


def _by_length(text: Column, words: list[str], base: float) -> Column:
    """base + 0.3 * min(len, 6) / 6 of the longest word contained; null without one."""
    branches = []
    for size in range(6, 0, -1):
        group = [w for w in words if min(len(w), 6) == size]
        if group:
            branches.append(F.when(X.has_any(text, group), round(base + 0.3 * size / 6, 6)))
    return F.coalesce(*branches)


def _bare(words: list[str]) -> list[str]:
    return [w.lower().translate(str.maketrans("", "", " ()")) for w in words]


def role_scores(text: Column) -> dict[str, Column]:
    """Score of a header text in each role, null where it does not apply."""
    t = text
    lower = [w.lower() for w in K.PART_NO]
    squeezed = F.translate(t, " ()", "")
    loose = F.coalesce(
        *[
            F.when(X.has_any(squeezed, _bare(group)), round(0.5 + 0.3 * size / 6, 6))
            for size in range(6, 0, -1)
            if (group := [w for w in lower if min(len(w), 6) == size])
        ]
    )
    part = F.when(~X.has_any(t, K.PART_NO_ANTI), F.coalesce(_by_length(t, lower, 0.7), loose))
    named = _by_length(t, K.NAME, 0.7)
    is_name = named.isNotNull() & ~X.has_any(t, K.NAME_ANTI)
    is_en = t.rlike(X.CYRILLIC) | X.has_any(t, ["英文", "en)", "(en"])
    is_cn = (t.rlike(X.CJK) | X.has_any(t, K.CN_HINT)) & ~is_en
    late_en = F.contains(t, F.lit("en）"))
    return {
        "part_no": part,
        "name_cn": F.when(is_name & (is_cn | ~(is_en | late_en)), named).when(
            ~is_name & X.has_any(t, K.DESCRIPTION_STEM), 0.7
        ),
        "name_en": F.when(is_name & is_en, named).when(is_name & ~is_cn & late_en, 1.0),
        "qty": F.when(X.has_any(t, K.QTY) & ~X.has_any(t, K.QTY_ANTI), 1.0),
    }


def score_columns(texts: DataFrame) -> DataFrame:
    """Role scores of each column from its header text (G7): (sheet, col, role, score)."""
    scored = texts.withColumns({f"_{r}": c for r, c in role_scores(F.col("text")).items()})
    entries = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"_{r}").alias("score")) for r in ROLES])
    return (
        scored.select(*SHEET, "col", F.explode(entries).alias("e"))
        .select(*SHEET, "col", "e.role", "e.score")
        .filter("score IS NOT NULL")
    )


def data_sample(cells: DataFrame, span: DataFrame, rows: int) -> DataFrame:
    """Cells of the first ``rows`` data rows of each sheet; the fixed bound reaches the scan."""
    return cells.filter(F.col("row") <= HEADER_ROWS + rows).join(span.select(*SHEET, "data_start"), SHEET).filter(
        (F.col("row") >= F.col("data_start")) & (F.col("row") < F.col("data_start") + rows)
    )


def _floor(role: Column) -> Column:
    """Least score the sampled content grants a column in a role."""
    n = F.col("n_filled")
    return (
        F.when((role == "part_no") & (F.col("part_filled") / n > 0.3), 0.7)
        .when((role == "name_cn") & (F.col("name_filled") / n > 0.3), 0.6)
        .when((role == "name_en") & (F.col("name_filled") / n > 0.2), 0.5)
        .when((role == "qty") & (F.col("qty_filled") / n > 0.3), 0.7)
        .otherwise(0.0)
    )


def _verified(score: Column, role: Column) -> Column:
    return F.when(score >= 0.9, score).otherwise(F.greatest(score, F.when(score.isNotNull(), _floor(role))))


def verify_columns(scores: DataFrame, profile: DataFrame) -> DataFrame:
    """Scores below 0.9 lifted where enough sample values fit the role."""
    return scores.join(profile, [*SHEET, "col"], "left").select(
        *SHEET, "col", "role", _verified(F.col("score"), F.col("role")).alias("score")
    )


def pick_columns(scores: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Best column per role."""
    w = Window.partitionBy(*SHEET, "role").orderBy(F.desc("score"), "col")
    return (
        scores.withColumn("_n", F.row_number().over(w))
        .filter((F.col("_n") == 1) & (F.col("score") >= threshold))
        .select(*SHEET, "role", "col")
    )


# --- content profiles --------------------------------------------------------

DATE_TEXT = (
    r"^(\p{Nd}{1,2}[./\-]\p{Nd}{1,2}[./\-]\p{Nd}{2,4}|\p{Nd}{4}[./\-]\p{Nd}{1,2}[./\-]\p{Nd}{1,2}"
    rf"|\p{{Nd}}{{1,2}}[{X.WS}]*[а-яА-ЯёЁ]{{3,8}}[{X.WS}]*\p{{Nd}}{{2,4}}"
    rf"|\p{{Nd}}{{1,2}}[{X.WS}]+[a-zA-Z]{{3,8}}[{X.WS}]*\p{{Nd}}{{2,4}})\z"
)


def profile_columns(cells: DataFrame, span: DataFrame, rows: int = 30) -> DataFrame:
    """Content counts of each column over the sample rows, in one pass."""
    s = F.col("_s")
    bare = F.translate(s, "-._/ ", "")
    coded = (
        bare.rlike(X.LATIN)
        & bare.rlike(X.DIGIT)
        & F.length(bare).between(8, 15)
        & (F.size(F.array_distinct(F.split(bare, ""))) >= 4)
    )
    number = F.when(F.col("kind").isin("n", "b"), F.col("num")).when(
        X.is_numeric_str(s), F.translate(s, ",_", ".").try_cast("double")
    )
    kind = F.col("kind")
    filled = (kind != "s") | (s != "")

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return (
        data_sample(cells, span, rows)
        .withColumn("_s", X.strip("value"))
        .groupBy(*SHEET, "col")
        .agg(
            F.count(F.lit(1)).alias("n_all"),
            n(s != "").alias("n_text"),
            n(filled).alias("n_filled"),
            n(filled & (X.score_part("value", kind) > 0.6)).alias("part_filled"),
            n(filled & (X.score_name("value", kind) > 0.6)).alias("name_filled"),
            n(filled & (X.score_qty("value", kind) > 0.8)).alias("qty_filled"),
            n((kind == "s") & F.col("value").rlike(f"{X.CJK}|{X.CYRILLIC}")).alias("foreign_text"),
            n((s != "") & (X.score_part(s) > 0.6)).alias("part_text"),
            n(coded).alias("coded"),
            n(s.rlike(DATE_TEXT)).alias("dates"),
            n(s.rlike(X.CJK)).alias("cjk"),
            n(X.score_part("value", kind) > 0.6).alias("part_typed"),
            n(X.score_name("value", kind) > 0.5).alias("name_typed"),
            n(X.score_qty("value", kind) > 0.8).alias("qty_typed"),
            n(number == 0).alias("zeros"),
            n(number == 1).alias("ones"),
            n((number != 0) & (number != 1)).alias("other_numbers"),
            n((kind == "n") & (F.col("num") != F.floor("num"))).alias("fractions"),
            n((F.length(s) >= 2) & ~X.is_numeric_str(s) & s.rlike(X.LATIN) & s.rlike(X.DIGIT)).alias("lettered"),
        )
    )


def is_meta(text: Column) -> Column:
    words = [w.lower() for w in K.STRICT_META + K.META]
    return X.has_any(F.coalesce(text, F.lit("")), words)


def part_content_score() -> Column:
    n = F.col("n_text")
    score = F.greatest(F.col("part_text") / n, F.col("coded") / n) * F.when(F.col("cjk") / n > 0.3, 0.3).otherwise(1.0)
    usable = ~is_meta(F.col("text")) & (n > 2) & (F.col("dates") / n <= 0.3) & (score > 0.3)
    return F.round(F.when(usable, score), 6)


def name_content_score() -> Column:
    n = F.col("n_all")
    score = F.col("name_typed") / n - F.col("part_typed") / n * 0.5
    usable = (n > 2) & (F.col("name_typed") / n > 0.3) & (F.col("part_typed") / n < 0.3) & (score > 0.2)
    return F.round(F.when(usable, score), 6)


def qty_content_score() -> Column:
    n = F.col("n_all")
    flags_only = (F.col("zeros") > 0) & (F.col("ones") > 0) & (F.col("other_numbers") == 0)
    score = F.col("qty_typed") / n + F.when(F.col("fractions") > 0, 0.1).otherwise(0.0)
    usable = (
        ~is_meta(F.col("text"))
        & (n >= 3)
        & ~flags_only
        & (F.col("qty_typed") / n > 0.3)
        & (F.col("part_typed") / n < 0.3)
        & (F.col("name_typed") / n < 0.3)
    )
    return F.round(F.when(usable, score), 6)


def _best(score: Column) -> Column:
    """Column of the highest score, leftmost among equals (grouped)."""
    return F.min_by("col", F.when(score.isNotNull(), F.struct(-score, F.col("col"))))


def _infer(facts: DataFrame, score: Column) -> DataFrame:
    return (
        facts.withColumn("score", score)
        .filter("score IS NOT NULL")
        .groupBy(*SHEET)
        .agg(_best(F.col("score")).alias("col"), F.max("score").alias("score"))
    )


def infer_part_col(profile: DataFrame, texts: DataFrame) -> DataFrame:
    """Part column by content."""
    return _infer(profile.join(texts, [*SHEET, "col"], "left"), part_content_score())


def infer_name_col(profile: DataFrame) -> DataFrame:
    """Name column by content."""
    return _infer(profile, name_content_score())


def infer_qty_col(profile: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """Quantity column by content (G12); ``known`` columns are left out."""
    free = profile.join(known.select(*SHEET, "col").distinct(), [*SHEET, "col"], "left_anti")
    return _infer(free.join(texts, [*SHEET, "col"], "left"), qty_content_score())


def reassign_name(picked: DataFrame, facts: DataFrame) -> DataFrame:
    """An English column without an English header but with CJK or Cyrillic data becomes Chinese.

    ``facts(sheet, col, text, foreign_text)``; ``picked(sheet, role, col)``.
    """
    w = Window.partitionBy(*SHEET)
    has_cn = F.max((F.col("role") == "name_cn").cast("int")).over(w) == 1
    moves = (
        (F.col("role") == "name_en")
        & ~has_cn
        & ~X.has_any(F.coalesce("text", F.lit("")), K.EN_MARK)
        & (F.coalesce("foreign_text", F.lit(0)) > 0)
    )
    known = facts.select(*SHEET, "col", "text", "foreign_text")
    return picked.join(known, [*SHEET, "col"], "left").select(
        *SHEET, F.when(moves, "name_cn").otherwise(F.col("role")).alias("role"), "col"
    )


def column_facts(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Header text and content counts of every column that has either."""
    return header_text(cells, headers).join(
        profile_columns(cells, header_span(headers)), [*SHEET, "col"], "full_outer"
    )


def detect_roles(cells: DataFrame, headers: DataFrame, qty_fallback: bool = False) -> DataFrame:
    """Column of each role per sheet (G7 to G13): part_no, name_cn, name_en, qty; null if none.

    Headers decide, checked on content; content alone decides where headers give nothing. All
    of it is one grouped aggregate over the column facts.
    """
    facts = column_facts(cells, headers)
    t = F.coalesce("text", F.lit(""))
    facts = facts.withColumns({f"h_{r}": c for r, c in role_scores(t).items()}).withColumns(
        {f"h_{r}": _verified(F.col(f"h_{r}"), F.lit(r)) for r in ROLES}
        | {"c_part": part_content_score(), "c_name": name_content_score(), "c_qty": qty_content_score()}
    )
    turned = ~X.has_any(t, K.EN_MARK) & (F.coalesce("foreign_text", F.lit(0)) > 0)
    sure = {r: F.when(F.col(f"h_{r}") >= 0.3, F.col(f"h_{r}")) for r in ROLES}
    ranked = F.when(F.col("c_qty").isNotNull(), F.struct((-F.col("c_qty")).alias("s"), F.col("col").alias("c")))
    one = facts.groupBy(*SHEET).agg(
        *[_best(sure[r]).alias(f"h_{r}") for r in ROLES],
        _best(F.col("c_part")).alias("c_part"),
        _best(F.col("c_name")).alias("c_name"),
        F.slice(F.array_sort(F.collect_list(ranked)), 1, 4).alias("c_qty"),
        F.collect_set(F.when(turned, F.col("col"))).alias("turned"),
    )
    part = F.coalesce("h_part_no", "c_part")
    cn = F.when(F.col("h_name_en").isNull(), F.coalesce("h_name_cn", "c_name")).otherwise(F.col("h_name_cn"))
    named = one.select(*SHEET, part.alias("part_no"), cn.alias("cn"), F.col("h_name_en").alias("en"), "h_qty", "c_qty", "turned")
    taken = F.array("part_no", "cn", "en")
    spare = F.filter("c_qty", lambda q: ~F.coalesce(F.array_contains(F.array_compact(taken), q["c"]), F.lit(False)))
    qty = F.coalesce("h_qty", F.try_element_at(spare, F.lit(1))["c"]) if qty_fallback else F.col("h_qty")
    moved = F.col("cn").isNull() & F.coalesce(F.array_contains("turned", F.col("en")), F.lit(False))
    return named.select(
        *SHEET,
        "part_no",
        F.when(moved, F.col("en")).otherwise(F.col("cn")).alias("name_cn"),
        F.when(~moved, F.col("en")).alias("name_en"),
        qty.alias("qty"),
    )


def _outside_roles(df: DataFrame, roles: DataFrame) -> DataFrame:
    """Rows whose column has no role."""
    taken = F.array_compact(F.array(*ROLES))
    return (
        df.join(roles.select(*SHEET, taken.alias("_taken")), SHEET, "left")
        .filter(~F.coalesce(F.array_contains("_taken", F.col("col")), F.lit(False)))
        .drop("_taken")
    )


def detect_configs(cells: DataFrame, headers: DataFrame, roles: DataFrame, rows: int = 50) -> DataFrame:
    """Configuration columns (G14): (sheet, col, zone, header).

    A column qualifies by its values: positive numbers or presence marks, few foreign texts,
    not one repeated code. ``zone`` is numeric up to the first column without numbers that
    follows one with numbers, marker from there on. Without any, all candidates are given.
    """
    span = header_span(headers)
    head = (
        cells.filter(F.col("row") <= HEADER_ROWS)
        .join(span.select(*SHEET, F.col("header_row").alias("row")), [*SHEET, "row"])
        .select(*SHEET, "col", X.norm_text("value").alias("header"))
    )
    taken = F.array_compact(F.array(*ROLES))
    start = span.join(roles, SHEET, "left").select(
        *SHEET,
        F.coalesce("part_no", F.lit(0)).alias("part_col"),
        F.coalesce(taken, F.array().cast("array<int>")).alias("taken"),
    )
    candidates = (
        start.join(sheet_extent(cells).select(*SHEET, "max_col"), SHEET)
        .filter(F.col("max_col") > F.col("part_col"))
        .select(*SHEET, "taken", F.explode(F.sequence(F.col("part_col") + 1, F.col("max_col"))).alias("col"))
        .filter(~F.array_contains("taken", F.col("col")))
        .join(head, [*SHEET, "col"], "left")
        .filter(~is_meta(F.col("header")))
    )
    s = F.col("_s")
    text = F.col("kind") == "s"
    sample = data_sample(cells, span, rows).withColumn("_s", X.strip("value")).filter(s != "")
    positive = (F.col("kind").isin("n", "b") & (F.col("num") > 0)) | (
        text & ~s.rlike(rf"\p{{Nd}}+[{X.WS}]*[±\-][{X.WS}]*\p{{Nd}}+") & ~s.rlike(r"^[Mm]\p{Nd}")
        & s.rlike(X.FLOAT_TEXT) & (F.coalesce(s.try_cast("double"), F.lit(0.0)) > 0)
    )
    marker = text & s.isin("S", "s", "Y", "y", "–", "-")
    torque = s.rlike(rf"\p{{Nd}}+[{X.WS}]*[±\-][{X.WS}]*\p{{Nd}}+")
    bolt = s.rlike(r"^[Mm]\p{Nd}")
    wordy = (F.length(s) > 3) & s.rlike(rf"[^\p{{Nd}}{X.WS}.,;:]")
    foreign = text & ~marker & (torque | bolt | (~positive & wordy))
    facts = sample.groupBy(*SHEET, "col").agg(
        F.bool_or(positive | marker).alias("has_valid"),
        F.bool_or(positive).alias("has_number"),
        F.avg(foreign.cast("double")).alias("foreign"),
    )
    counted = sample.filter((F.length(s) <= 2) | s.rlike(X.DIGIT)).groupBy(*SHEET, "col", "_s").agg(
        F.count(F.lit(1)).alias("_n")
    )
    mark = F.upper("_s").isin("S", "Y") | F.col("_s").isin("-", "–", "—") | X.is_numeric_str("_s")
    repeated = (
        counted.groupBy(*SHEET, "col")
        .agg(F.sum("_n").alias("_t"), F.max("_n").alias("_m"), F.max_by(mark, "_n").alias("_ok"))
        .select(*SHEET, "col", ((F.col("_t") >= 5) & (F.col("_m") / F.col("_t") > 0.7) & ~F.col("_ok")).alias("repeated"))
    )
    rejected = F.coalesce("repeated", F.lit(False)) | (F.coalesce("foreign", F.lit(0.0)) > 0.3)
    judged = (
        candidates.join(facts, [*SHEET, "col"], "left")
        .join(repeated, [*SHEET, "col"], "left")
        .select(
            *SHEET,
            "col",
            "header",
            (F.coalesce("has_valid", F.lit(False)) & ~rejected).alias("valid"),
            (F.coalesce("has_number", F.lit(False)) & ~rejected).alias("number"),
        )
    )
    w = Window.partitionBy(*SHEET)
    placed = (
        judged.withColumn("_first", F.min(F.when(F.col("number"), F.col("col"))).over(w))
        .withColumn(
            "_edge",
            F.min(F.when(~F.col("number") & (F.col("col") > F.col("_first")), F.col("col"))).over(w),
        )
        .withColumn("_any", F.max(F.col("valid").cast("int")).over(w))
    )
    zone = F.when(F.col("_any") == 0, "unproven").when(F.col("col") < F.coalesce("_edge", F.lit(1 << 30)), "numeric").otherwise("marker")
    return placed.filter(F.col("valid") | (F.col("_any") == 0)).select(
        *SHEET, "col", zone.alias("zone"), F.coalesce("header", F.lit("")).alias("header")
    )


def graphic_col(cells: DataFrame, headers: DataFrame, roles: DataFrame) -> DataFrame:
    """Drawing or operation number column: by header, else by content, leftmost."""
    words = [w.lower() for w in K.GRAPHIC_NUMBER]
    named = (
        _outside_roles(cells.filter(F.col("row") <= HEADER_ROWS).join(headers.select(*SHEET, "row"), [*SHEET, "row"]), roles)
        .filter(X.has_any(F.lower("value"), words))
        .groupBy(*SHEET)
        .agg(F.min("col").alias("named"))
    )
    n = F.col("n_all")
    content = (
        _outside_roles(profile_columns(cells, header_span(headers)), roles)
        .filter((n > 2) & (F.col("lettered") / n > 0.3))
        .groupBy(*SHEET)
        .agg(F.min("col").alias("content"))
    )
    return named.join(content, SHEET, "full_outer").select(*SHEET, F.coalesce("named", "content").alias("col"))


def sheet_card_number(cells: DataFrame, rows: int = 15, cols: int = 20) -> DataFrame:
    """Card number of each sheet: first hit in reading order, else from the file name."""
    text = F.regexp_replace(F.col("value"), "_x[0-9a-fA-F]{4}_", "")
    text = X.strip(F.translate(F.regexp_replace(text, "\r", ""), "\n", " "))
    hit = X.found_card_number(text)
    top = (F.col("row") <= rows) & (F.col("col") <= cols)
    found = cells.withColumn("_hit", F.when(top, hit))
    at = F.when(F.col("_hit").isNotNull(), F.struct("row", "col"))
    # a sheet leaves one row and its hits: only these are kept in order
    return (
        found.select(*SHEET, "_hit", at.alias("_at"))
        .distinct()
        .groupBy(*SHEET)
        .agg(F.min_by("_hit", "_at").alias("_hit"))
        .select(*SHEET, F.coalesce("_hit", X.card_number("file_id")).alias("card_no"))
    )


def bom_candidates(cells: DataFrame, min_configs: int = 2) -> DataFrame:
    """Sheets that hold a parts list (G18), with the facts that decided it."""
    headers = pick_headers(score_headers(cells))
    roles = detect_roles(cells, headers)
    configs = detect_configs(cells, headers, roles).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("configs"))
    enough = (F.coalesce("configs", F.lit(0)) >= min_configs) | (
        F.col("qty").isNotNull()
        & (F.col("name_cn").isNotNull() | F.col("name_en").isNotNull() | F.col("part_no").isNotNull())
    )
    return (
        sheet_extent(cells)
        .filter(~X.is_service_sheet("sheet"))
        .join(header_span(headers), SHEET)
        .filter(F.col("max_row") - F.col("data_start") + 1 >= 3)
        .join(roles, SHEET, "left")
        .join(configs, SHEET, "left")
        .filter(enough)
        .select(*SHEET, "sheet", "header_row", "data_start", *ROLES, F.coalesce("configs", F.lit(0)).alias("configs"))
    )


def operation_name(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Operation title above a table (G19). ``headers(sheet, header_row)``, one row each."""
    text = X.strip("value")
    near = cells.filter((F.col("row") < 15) & (F.col("col") <= 10)).select(
        *SHEET, "row", "col", text.alias("t"), truthy().alias("full")
    )
    element = F.contains("t", F.lit(K.OPERATION_ELEMENT))
    titles = near.filter((F.length("t") > 3) & F.col("t").rlike(X.CJK) & ~X.has_any("t", K.OPERATION_SKIP))
    beside = near.filter(F.col("full") & (F.length("t") > 1) & ~element)
    one = beside.select(*SHEET, "row", (F.col("col") - 1).alias("col"), F.col("t").alias("t1"))
    two = beside.select(*SHEET, "row", (F.col("col") - 2).alias("col"), F.col("t").alias("t2"))
    offered = (
        titles.join(one, [*SHEET, "row", "col"], "left")
        .join(two, [*SHEET, "row", "col"], "left")
        .withColumn("name", F.when(element, F.coalesce("t1", "t2")).otherwise(F.col("t")))
        .filter("name IS NOT NULL")
    )
    return (
        headers.select(*SHEET, "header_row")
        .join(offered, SHEET, "left")
        .groupBy(*SHEET, "header_row")
        .agg(
            F.coalesce(
                F.min_by(
                    "name",
                    F.when(F.col("row") < F.least("header_row", F.lit(15)), F.struct("row", "col")),
                ),
                F.lit(""),
            ).alias("operation_name")
        )
    )


def detect_blocks(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Further part-name-quantity groups beside the main one.

    ``headers(sheet, header_row, part_col)``; the last name and quantity within four columns count.
    """
    v = F.lower(X.strip("value"))
    row = cells.join(headers.select(*SHEET, F.col("header_row").alias("row"), "part_col"), [*SHEET, "row"]).select(
        *SHEET,
        "col",
        "part_col",
        X.has_any(v, K.PART_NO).alias("is_part"),
        F.when(X.has_any(v, K.NAME), F.col("col")).alias("name_at"),
        F.when(X.has_any(v, K.QTY), F.col("col")).alias("qty_at"),
    )
    extra = row.filter(F.col("is_part") & (F.col("col") != F.col("part_col")))
    reach = extra.select(
        *SHEET, F.col("col").alias("block_part_col"), F.explode(F.sequence(F.col("col") + 1, F.col("col") + 4)).alias("col")
    )
    return (
        reach.join(row.select(*SHEET, "col", "name_at", "qty_at"), [*SHEET, "col"])
        .groupBy(*SHEET, "block_part_col")
        .agg(F.max("name_at").alias("block_name_col"), F.max("qty_at").alias("block_qty_col"))
        .filter("block_name_col IS NOT NULL AND block_qty_col IS NOT NULL")
    )


def auto_bom_sheets(cells: DataFrame) -> DataFrame:
    """Parts lists by header words in the first five rows."""
    w = K.AUTO_BOM
    t = F.lower(X.strip("value"))
    part = X.has_any(t, w["part_no"])
    qty = ~part & X.has_any(t, w["qty"])
    at = F.struct("row", "col")
    seen = cells.filter((F.col("row") <= 5) & (F.col("col") <= 49)).select(
        *SHEET,
        "row",
        "col",
        part.alias("p"),
        qty.alias("q"),
        (~part & ~qty & X.has_any(t, w["name_cn"])).alias("n"),
        (~part & ~qty & X.has_any(t, w["name_en"])).alias("e"),
    )
    first_name = seen.groupBy(*SHEET).agg(F.min(F.when(F.col("n"), at)).alias("first_name"))
    flagged = seen.join(first_name, SHEET).withColumns(
        {
            "n": F.coalesce(at == F.col("first_name"), F.lit(False)),
            "e": F.col("e") & ~F.coalesce(at == F.col("first_name"), F.lit(False)),
        }
    )
    starts = flagged.groupBy(*SHEET).agg(*[F.min(F.when(F.col(c), F.col("row"))).alias(f"_{c}") for c in "pqne"])
    second = F.try_element_at(
        F.array_sort(F.array_compact(F.array(*[F.col(f"_{c}") for c in "pqne"]))), F.lit(2)
    )
    stops = starts.select(*SHEET, second.alias("header_row")).filter("header_row IS NOT NULL")
    found = (
        flagged.join(stops, SHEET)
        .filter(F.col("row") <= F.col("header_row"))
        .groupBy(*SHEET, "header_row")
        .agg(
            F.max(F.when(F.col("p"), at))["col"].alias("part_col"),
            F.max(F.when(F.col("q"), at))["col"].alias("qty_col"),
            F.min(F.when(F.col("n"), at))["col"].alias("name_cn_col"),
            F.min(F.when(F.col("e"), at))["col"].alias("name_en_col"),
        )
    )
    sized = sheet_extent(cells).filter("max_row >= 2")
    return (
        found.filter("part_col IS NOT NULL AND qty_col IS NOT NULL")
        .join(sized, SHEET)
        .select(
            *SHEET,
            "sheet",
            "header_row",
            (F.col("header_row") + 1).alias("data_start"),
            "part_col",
            F.coalesce("name_cn_col", F.lit(0)).alias("name_cn_col"),
            F.coalesce("name_en_col", F.lit(0)).alias("name_en_col"),
            "qty_col",
            (F.col("max_row") - F.col("header_row")).alias("data_rows"),
        )
    )


def auto_card_cols(cells: DataFrame) -> DataFrame:
    """Card layout by header words: first row with two roles, on the first sheet where these suffice."""
    w = K.AUTO_CARD
    t = F.lower(X.strip("value"))
    role = F.when(X.has_any(t, w["part_no"]), "p").when(X.has_any(t, w["qty"]), "q").when(X.has_any(t, w["name"]), "n")
    rows = (
        cells.filter((F.col("row") <= 31) & (F.col("col") <= 29))
        .withColumn("_r", role)
        .groupBy(*SHEET, "row")
        .agg(
            *[F.max(F.when(F.col("_r") == r, F.col("col"))).alias(n) for r, n in (("p", "part_col"), ("q", "qty_col"), ("n", "name_col"))]
        )
        .filter(F.size(F.array_compact(F.array("part_col", "qty_col", "name_col"))) >= 2)
    )
    first = rows.groupBy(*SHEET).agg(
        F.min("row").alias("header_row"),
        F.min_by(F.struct("part_col", "qty_col", "name_col"), "row").alias("c"),
    )
    sheets = first.filter("c.part_col IS NOT NULL AND c.qty_col IS NOT NULL")
    files = sheets.groupBy("file_id").agg(F.min_by(F.struct("header_row", "c"), "sheet_idx").alias("s"))
    return files.select("file_id", "s.*").select(
        "file_id",
        "header_row",
        (F.col("header_row") + 1).alias("data_start"),
        F.col("c.part_col").alias("part_col"),
        F.col("c.qty_col").alias("qty_col"),
        F.coalesce("c.name_col", F.lit(0)).alias("name_col"),
    )


def flag_uncached(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Files whose formulas carry no values: an early sheet empty in rows 2-10 (S3).

    ``sheets(file_id, sheet_idx, max_row)`` lists sheets as declared, empty ones too.
    """
    early = sheets.filter((F.col("sheet_idx") < 3) & (F.col("max_row") >= 2)).select(*SHEET)
    filled = cells.filter(F.col("row").between(2, 10) & (F.col("col") <= 20)).select(*SHEET)
    return early.join(filled, SHEET, "left_anti").select("file_id").distinct()
