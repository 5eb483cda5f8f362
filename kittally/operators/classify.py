"""File classification, naming families and deterministic output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import text as X
from ..session import cut
from .scan import number_by, running_sum, union_all

LEADING_NUMBER = r"^(?:[A-Za-z]{1,3})?[0-9]{2,}"
MODEL_AS = r"^[a-z0-9]+-[a-z0-9]*-as-[0-9]+"


def list_cards(files: DataFrame, path: str = "path") -> DataFrame:
    """Workbook members of an archive listing: no folders, hidden or system entries."""
    p = F.col(path)
    return files.filter(
        ~F.endswith(p, F.lit("/"))
        & ~F.startswith(p, F.lit("."))
        & ~F.contains(p, F.lit("__MACOSX"))
        & ~F.startswith(X.basename(p), F.lit("."))
        & p.rlike(r"(?i)\.xlsx?\z")
    )


def splittable(sheets: DataFrame) -> DataFrame:
    """Sheets of workbooks that hold more than one sheet that is not a service sheet."""
    kept = sheets.filter(~X.has_any(F.lower("sheet"), K.SERVICE_FILE))
    several = kept.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return kept.join(several.select("file_id"), "file_id", "left_semi")


def _numbered_name(name: Column) -> Column:
    return name.rlike(LEADING_NUMBER) | name.rlike(MODEL_AS)


def classify_legacy(
    files: DataFrame,
    service: list[str] | None = None,
    operational: list[str] | None = None,
    path: str = "path",
) -> DataFrame:
    """Keyword classification by file name (F8)."""
    name = F.lower(X.stem(path))
    service = K.SERVICE_FILE if service is None else service
    operational = K.OPERATIONAL_FILE if operational is None else operational
    kind = F.when(F.lit(False), F.lit(""))
    if service:
        kind = kind.when(X.has_any(name, [w.lower() for w in service]), "service")
    if operational:
        kind = kind.when(X.has_any(name, [w.lower() for w in operational]), "operational_card")
    return files.withColumn(
        "file_type", kind.when(_numbered_name(name), "operational_card").otherwise("unknown")
    )


def _rule_hit(rule: dict, name: Column, content: Column) -> Column | None:
    words = [w.lower() for w in rule.get("keywords", [])]
    kind = rule.get("type", "")
    if kind == "filename_regex" and rule.get("pattern"):
        return name.rlike("(?iU)" + rule["pattern"])
    if not words:
        return None
    if kind == "filename_keyword":
        return X.has_any(name, words)
    if kind == "sheet_keyword":
        text = F.when(F.coalesce(content, F.lit("")) != "", F.lower(content)).otherwise(name)
        return X.has_any(text, words)
    return None


def classify_rules(files: DataFrame, rules: dict, path: str = "path", content: str | None = None) -> DataFrame:
    """Ordered rule classification (F9): service rules, then card rules with a format group.

    ``rules`` is the classification part of a mapping; each rule becomes one branch of a
    single conditional, so files are read once and never multiplied by rules.
    """
    service = rules.get("service_file_patterns") or []
    cards = rules.get("operational_card_patterns") or []
    if not service and not cards:
        return classify_legacy(
            files, rules.get("service_keywords"), rules.get("operational_keywords"), path
        ).withColumn("format_group", F.lit(None).cast("string"))
    name = F.lower(X.stem(path))
    text = F.lit(None).cast("string") if content is None else F.col(content)
    verdict = F.when(F.lit(False), F.struct(F.lit("").alias("t"), F.lit(None).cast("string").alias("g")))

    def branch(chain: Column, hit: Column | None, kind: str, group: str | None) -> Column:
        if hit is None:
            return chain
        return chain.when(hit, F.struct(F.lit(kind).alias("t"), F.lit(group).cast("string").alias("g")))

    for rule in service:
        verdict = branch(verdict, _rule_hit(rule, name, text), "service", None)
    for rule in cards:
        verdict = branch(verdict, _rule_hit(rule, name, text), "operational_card", rule.get("format_group"))
    if not cards:
        verdict = branch(verdict, _numbered_name(name), "operational_card", None)
    verdict = verdict.otherwise(
        F.struct(F.lit("unknown").alias("t"), F.lit(None).cast("string").alias("g"))
    )
    return (
        files.withColumn("_v", verdict)
        .withColumns({"file_type": F.col("_v.t"), "format_group": F.col("_v.g")})
        .drop("_v")
    )


_HIT = (
    "CASE r.type WHEN 'filename_regex' THEN r.pattern <> '' AND rlike(_name, concat('(?iU)', r.pattern)) "
    "WHEN 'filename_keyword' THEN exists(r.keywords, w -> contains(_name, lower(w))) "
    "WHEN 'sheet_keyword' THEN exists(r.keywords, w -> contains(_text, lower(w))) END"
)


def classify_by_rules(files: DataFrame, rules: DataFrame, keys: list[str], path: str = "path", content: str | None = None) -> DataFrame:
    """:func:`classify_rules` where rules are data: files of many jobs at once, each by the rules of its own job.

    ``rules(*keys, rules)`` as from ``mapping.classification_rules``; a job without rules is classified by keywords
    (F8), its own or the fixed ones. Each name is judged once per job (and content), by the first rule that hits: a
    file meets one row of rules, never a row per rule.
    """
    name = F.lower(X.stem(path))
    text = F.lit(None).cast("string") if content is None else F.col(content)
    own = [*keys, path] + ([content] if content else [])
    named = files.select(*own).distinct().withColumns({"_name": name, "_text": F.when(F.coalesce(text, F.lit("")) != "", F.lower(text)).otherwise(name)})
    if keys:
        judged = named.join(rules.select(*keys, "rules"), keys, "left")
    else:
        judged = named.withColumn("rules", rules.agg(F.first("rules")).scalar())

    def words(field: str, fixed: list[str]) -> Column:
        wanted = F.coalesce(F.col(f"rules.{field}"), F.array(*[F.lit(w) for w in fixed]))
        return F.exists(wanted, lambda w: F.contains(F.col("_name"), F.lower(w)))

    def first(field: str) -> Column:
        return F.get(F.expr(f"filter(rules.{field}, r -> coalesce({_HIT}, false))"), F.lit(0))

    some = lambda field: F.coalesce(F.size(f"rules.{field}") > 0, F.lit(False))
    service, cards = some("service_file_patterns"), some("operational_card_patterns")
    numbered = _numbered_name(F.col("_name"))
    judged = judged.withColumns({"_service": first("service_file_patterns"), "_card": first("operational_card_patterns")})
    kind = (
        F.when(~service & ~cards & words("service_keywords", K.SERVICE_FILE), "service")
        .when(~service & ~cards & words("operational_keywords", K.OPERATIONAL_FILE), "operational_card")
        .when(F.col("_service").isNotNull(), "service")
        .when(F.col("_card").isNotNull(), "operational_card")
        .when(~cards & numbered, "operational_card")
        .otherwise("unknown")
    )
    group = F.when(F.col("_service").isNull(), F.col("_card.format_group"))
    verdicts = judged.select(*own, kind.alias("file_type"), group.alias("format_group"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"v.{c}")) for c in own]
    return files.alias("f").join(verdicts.alias("v"), same, "left").select("f.*", "v.file_type", "v.format_group")


def content_digest(cells: DataFrame, rows: int = 30, cols: int = 39) -> DataFrame:
    """Text of the top of the first sheet of each file (F10); at most rows x cols values."""
    top = cells.filter(
        (F.col("sheet_idx") == 0) & (F.col("row") <= rows) & (F.col("col") <= cols)
    )
    ordered = F.array_sort(F.collect_list(F.struct("row", "col", X.strip("value").alias("v"))))
    return top.groupBy("file_id").agg(
        F.array_join(F.transform(ordered, lambda c: c["v"]), " ").alias("content")
    )


def representatives(files: DataFrame, path: str = "path", order: str = "ord") -> DataFrame:
    """First file of each naming family, with the family's size."""
    return files.groupBy(X.format_group(path).alias("format_group")).agg(
        F.min_by(path, order).alias("path"), F.count(F.lit(1)).alias("files")
    )


def split_manifest(produced: DataFrame) -> DataFrame:
    """Sorted names produced from each source file, one row per source.

    ``produced(source, name)``; sources of one name in different folders share a list, as they do in the manifest.
    """
    return produced.groupBy(X.basename("source").alias("source")).agg(F.array_sort(F.collect_set("name")).alias("names"))


NAME_WIDTH = 50
CLASHES = 1 << 18
_CHUNK = 512


def allocate_names(sheets: DataFrame, width: int = NAME_WIDTH) -> DataFrame:
    """Output file name of each (source, sheet, label) with deterministic suffixes (Q8).

    Rows take names in the order (source, sheet, label): each the first free one of its base, base_1,
    base_2, ... A name ``base_n`` has two claimants only, a row of ``base`` and the first row of the base that is spelled
    like it, and the earlier one has it. So the rows of a base are numbered, the names lost to others are
    found among the bases that extend it (``_lost``), and every row moves on by the lost names before it. ``width``
    is the number of characters kept of label and sheet.
    """
    label = F.substring(X.safe_filename(F.coalesce("label", F.lit(""))), 1, width)
    sheet = F.substring(X.safe_filename("sheet"), 1, width)
    based = sheets.select("source", "sheet", "label").withColumn(
        "base", F.when(label != "", F.concat(label, F.lit("_"), sheet)).otherwise(sheet)
    )
    order = ["source", "sheet", "label"]
    bases = cut(based.groupBy("base").agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("rows")))
    suffix = F.regexp_extract("base", r"(?s)_([1-9][0-9]{0,17})\z", 1)
    longer = bases.filter(suffix != "").select(
        F.col("base").alias("child"), "first", suffix.cast("long").alias("n"), F.expr("substring(base, 1, length(base) - length({0}) - 1)".format(r"regexp_extract(base, '(?s)_([1-9][0-9]{0,17})\\z', 1)")).alias("base")
    )
    longer = cut(longer.join(bases.select("base", "rows"), "base"))
    # first rows of longer bases stand among the rows of the base that they extend, in one global sort
    line = union_all([based.withColumn("_row", F.lit(1)), longer.select("base", "child", "n", "rows", "first.*").withColumn("_row", F.lit(0))])
    by = ["base", *order, "_row"]
    placed = line.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_pos", F.monotonically_increasing_id())
    placed = cut(running_sum(cut(placed), "_pos", ["base"], "_row", "_k"))
    claims = placed.filter("_row = 0").select("base", "child", "n", "rows", F.col("_k").alias("before"))
    lost = _lost(bases, cut(claims))
    rows = placed.filter("_row = 1").select("base", *order, (F.col("_k") * 2 - 1).alias("_at"))
    moved = union_all([rows.withColumn("_lost", F.lit(0).cast("long")), lost.select("base", (F.col("row") * 2).alias("_at"), "_lost").withColumn("_gap", F.lit(True))])
    number = ((F.col("_at") - 1) / 2 + F.col("_moved")).cast("long")
    named = F.when(number == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), number.cast("string")))
    return (
        running_sum(moved, "_at", ["base"], "_lost", "_moved")
        .filter("_gap IS NULL")
        .select(*order, F.concat(named, F.lit(".xlsx")).alias("name"))
    )


def _lost(bases: DataFrame, claims: DataFrame) -> DataFrame:
    """Names that a base loses, as (base, row, _lost): from row number ``row`` on, ``_lost`` more names are skipped.

    ``claims(base, child, n, rows, before)``: ``child`` is spelled ``base_n`` and its first row comes after ``before`` rows
    of the base. The base has lost s names below n, so its row n - s asks for the name: it has it if it is one of
    the ``before`` ones, and then the child loses its own plain name. What a base loses to the one it extends must be known
    first, so bases are taken from the shortest spelling on. The count s runs over the claims of a base in
    pieces of ``CLASHES``; a claim that no row of the base can reach settles nothing and is left out.
    """
    numbers = number_by(cut(_in_order(claims)), "_pos", ["base"], "j")
    claims = cut(numbers.filter(F.col("n") < F.col("rows") + F.col("j")).select("base", "child", "n", "before", (F.col("j") - 1).alias("j")))
    inner = bases.join(claims.select(F.col("child").alias("base")), "base", "left_semi").select("base")
    plain = bases.select("base").join(inner, "base", "left_anti")
    state = cut(plain.withColumn("s", F.lit(0).cast("long")))  # names lost so far, for bases whose turn it is
    gaps = [claims.filter("false").select("base", F.col("j").alias("row"), F.col("j").alias("_lost"))]
    pieces = (claims.agg(F.max("j")).first()[0] or 0) // CLASHES + 1
    while not state.isEmpty():
        of_level = cut(claims.join(state.select("base"), "base", "left_semi"))
        children = []
        for piece in range(pieces):
            part = of_level.filter((F.floor(F.col("j") / CLASHES) == piece)).groupBy("base", F.floor(F.col("j") / _CHUNK).alias("chunk"))
            chunks = part.agg(F.array_sort(F.collect_list(F.struct("n", "before", "child"))).alias("bars"))
            lists = chunks.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("chunk", "bars"))).alias("chunks")).join(state, "base")
            walked = lists.withColumn("walk", F.expr(_WALK))
            done = cut(
                walked.select("base", F.col("walk.s").alias("s_after"), F.explode(F.arrays_zip(F.flatten("chunks.bars").alias("bars"), F.flatten("walk.kept").alias("kept"))).alias("z"))
                .select("base", "s_after", "z.bars.child", F.col("z.kept").alias("row"))
            )
            children.append(done)
            if piece + 1 < pieces:
                after = done.groupBy("base").agg(F.max("s_after").alias("s_after"))
                state = cut(state.join(after, "base", "left").select("base", F.coalesce("s_after", "s").alias("s")))
        settled = union_all(children)
        gaps.append(settled.filter("row IS NOT NULL").groupBy("base", "row").agg(F.count(F.lit(1)).alias("_lost")))
        # a child that lost its plain name skips it from its first row on
        state = cut(settled.select(F.col("child").alias("base"), F.when(F.col("row").isNull(), 1).otherwise(0).cast("long").alias("s")))
        gaps.append(state.filter("s = 1").select("base", F.lit(0).cast("long").alias("row"), F.col("s").alias("_lost")))
    return union_all(gaps).groupBy("base", "row").agg(F.sum("_lost").alias("_lost"))


def _in_order(claims: DataFrame) -> DataFrame:
    return claims.repartitionByRange("base", "n").sortWithinPartitions("base", "n").withColumn("_pos", F.monotonically_increasing_id())


#: Lost names of a base over its claims in order: per claim the row that is turned away, null where the claim fails.
_WALK = (
    "aggregate(chunks, struct(s AS s, CAST(array() AS array<array<bigint>>) AS kept), (all, chunk) -> "
    "aggregate(chunk.bars, struct(all.s AS s, CAST(array() AS array<bigint>) AS kept), (one, bar) -> "
    "struct(one.s + CAST(bar.n - one.s >= bar.before AS bigint) AS s, "
    "concat(one.kept, array(CASE WHEN bar.n - one.s >= bar.before THEN bar.n - one.s END)) AS kept), "
    "one -> struct(one.s AS s, concat(all.kept, array(one.kept)) AS kept)))"
)
