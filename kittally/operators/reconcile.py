"""Reconciliation of configuration quantities with card totals.

Inputs
  bom_qty(config, part, qty)           one row per configuration and part
  cards(part, qty)                     one row per part; extra columns are carried by callers
Keys are whatever the caller compares on: raw part numbers, or part keys. A *format pair* links
a card part to a BOM part of the same part key where no equal BOM part exists anywhere.

Everything is joined on the part: the plan never multiplies configurations by cards except in
the one result that is that product, parts missing from a configuration. Those are kept as bits,
a word per part and 62 configurations, counted as such and unfolded only where rows are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut
from .scan import number_by, union_all

TOLERANCE = 0.001
SALTS = 64
WORD = 62  # bits used of a long: masks stay positive
TYPE_RANK = ["qty_mismatch", "only_in_bom", "only_in_cards", "fuzzy_match"]


def format_pairs(bom_parts: DataFrame, cards: DataFrame) -> DataFrame:
    """Card part to BOM part of another spelling (R1): exact spelling wins, else the least."""
    spelled = bom_parts.select("part").distinct().withColumn("part_key", X.part_key("part"))
    return _spelled_apart(spelled, cards.select("part", X.part_key("part").alias("part_key")))


def _spelled_apart(spelled: DataFrame, cards: DataFrame) -> DataFrame:
    """:func:`format_pairs` of parts that have their ``part_key``, different ones of the BOM."""
    by_key = spelled.groupBy("part_key").agg(F.min("part").alias("bom_part"))
    loose = cards.select(F.col("part").alias("card_part"), "part_key").join(
        spelled.select(F.col("part").alias("card_part")), "card_part", "left_anti"
    )
    return loose.join(by_key, "part_key").select("card_part", "bom_part")


def config_words(configs: DataFrame) -> DataFrame:
    """Distinct configurations dealt to bits of words: (config, word, bit), numbered without gaps.

    The order is that of ``config_no`` where the input has it, so bit ``b`` of word ``w`` is its number
    ``w * WORD + b + 1``; else that of the names.
    """
    order = ["config_no", "config"] if "config_no" in configs.columns else ["config"]
    distinct = configs.select(*order).distinct().withColumn("_all", F.lit(0))
    placed = cut(distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id()))
    at = F.col("_n") - 1
    numbered = number_by(placed, "_pos", ["_all"], "_n")
    return numbered.select("config", F.floor(at / WORD).cast("int").alias("word"), (at % WORD).cast("int").alias("bit"))


def held_bits(parts: DataFrame, bom_qty: DataFrame, words: DataFrame) -> DataFrame:
    """The configurations that have a part, as bits: (part, word, held), no row for a word without any."""
    rows = bom_qty.select("part", "config").join(parts.select("part").distinct(), "part", "left_semi")
    return rows.join(words, "config").groupBy("part", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("held"))


def lacking_bits(parts: DataFrame, bom_qty: DataFrame, words: DataFrame) -> DataFrame:
    """Each row of ``parts`` with the configurations that lack its part, as bits: adds word and lacking.

    One row per part and word of ``WORD`` configurations, so counts and first configurations come from
    arithmetic on a word; only :func:`unfold` makes a row per configuration.
    """
    n = words.agg(F.count("config").alias("n")).select("n").scalar()
    last = F.floor((n - 1) / WORD).cast("int")
    every = F.sequence(F.lit(0), last)
    wanted = parts.withColumn("word", F.explode(F.when(n > 0, every).otherwise(F.array().cast("array<int>"))))
    wanted = wanted.withColumn("_width", F.least(F.lit(WORD).cast("long"), n - F.col("word") * WORD).cast("int"))
    joined = wanted.join(held_bits(parts, bom_qty, words), ["part", "word"], "left")
    lacking = F.expr("(shiftleft(1L, _width) - 1L) & ~coalesce(held, 0L)")
    return joined.withColumn("lacking", lacking).filter("lacking <> 0").select(*parts.columns, "word", "lacking")


def unfold(bits: DataFrame, words: DataFrame) -> DataFrame:
    """One row per set bit: replaces word and lacking by config.

    Names meet the bits a word at a time. The table of names is repeated for SALTS groups of parts, so that
    one word does not meet all parts in one task where it is too large for a broadcast.
    """
    names = words.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("bit", "config"))).alias("_names"))
    salted = names.select("word", "_names", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    kept = [c for c in bits.columns if c not in ("word", "lacking")]
    spread = bits.withColumn("_salt", F.pmod(F.xxhash64(*kept), F.lit(SALTS)).cast("int"))
    set_bits = F.explode(F.expr("transform(filter(_names, c -> (shiftright(lacking, c.bit) & 1L) = 1L), c -> c.config)"))
    return spread.join(salted, ["word", "_salt"]).select(*kept, set_bits.alias("config"))


def missing_configs(parts: DataFrame, bom_qty: DataFrame, configs: DataFrame) -> DataFrame:
    """Each row of ``parts`` once for every configuration that lacks its part: adds config."""
    words = config_words(configs)
    return unfold(lacking_bits(parts, bom_qty, words), words)


def split_outcomes(
    bom_qty: DataFrame,
    cards: DataFrame,
    words: DataFrame,
    fuzzy: bool = True,
    pairs: DataFrame | None = None,
    strict_pairs: bool = False,
    tol: float = TOLERANCE,
) -> tuple[DataFrame, DataFrame]:
    """Outcomes of BOM rows and pairs, a row each, and surplus card parts as bits of configurations.

    The second frame has word and lacking in place of config (see :func:`lacking_bits`).
    """
    rows, paired, loose = _compared(bom_qty, cards, fuzzy, pairs, tol)
    surplus = loose.withColumn("card_part", F.col("part"))
    if strict_pairs and paired is not None:
        surplus = surplus.unionByName(paired.withColumnRenamed("bom_part", "part").select(*surplus.columns))
    bits = lacking_bits(surplus, bom_qty, words).select(
        F.lit(None).cast("string").alias("bom_part"),
        "card_part",
        F.lit(0.0).alias("qty_bom"),
        "qty_cards",
        F.lit("only_in_cards").alias("outcome"),
        F.col("card_ok").alias("valid"),
        "word",
        "lacking",
    )
    return union_all(rows), bits


def outcomes(
    bom_qty: DataFrame,
    cards: DataFrame,
    configs: DataFrame | None = None,
    fuzzy: bool = True,
    pairs: DataFrame | None = None,
    strict_pairs: bool = False,
    tol: float = TOLERANCE,
) -> DataFrame:
    """Every compared row with its outcome.

    outcome is matched, one of the four discrepancy types, or set_aside: a BOM part whose key
    occurs on cards under another spelling. ``valid`` is false where the part number itself is
    unusable; such rows count as parts but are never reported.
    ``strict_pairs`` also reports a paired card part in configurations without its BOM part.
    """
    words = config_words(bom_qty if configs is None else configs)
    listed, bits = split_outcomes(bom_qty, cards, words, fuzzy, pairs, strict_pairs, tol)
    return listed.unionByName(unfold(bits, words).select(*listed.columns))


def _compared(
    bom_qty: DataFrame, cards: DataFrame, fuzzy: bool, pairs: DataFrame | None, tol: float
) -> tuple[list[DataFrame], DataFrame | None, DataFrame]:
    """Rows of BOM parts and of format pairs; the pairs; the card parts that are in no pair."""
    # validity and key are judged once per part, not once per result row; what several joins read is written once
    card = cut(cards.select("part", F.col("qty").alias("qty_cards"), X.is_part("part").alias("card_ok"), X.part_key("part").alias("part_key")))
    bom = bom_qty.select("config", "part", F.col("qty").alias("qty_bom"))
    seen = cut(bom_qty.select("part").distinct().withColumns({"bom_ok": X.is_part("part"), "part_key": X.part_key("part")}))
    if pairs is None and fuzzy:
        pairs = _spelled_apart(seen, card)
    if pairs is not None:
        pairs = cut(pairs)
    if fuzzy:
        keys = card.select("part_key", F.lit(True).alias("on_cards")).distinct()
        seen = seen.join(keys, "part_key", "left").drop("part_key")
    else:
        seen = seen.drop("part_key").withColumn("on_cards", F.lit(False))
    card = card.drop("part_key")

    facts = seen.join(card.drop("card_ok"), "part", "left")
    found = F.col("qty_cards").isNotNull()
    parts = [
        bom.join(facts, "part").select(
            "config",
            F.col("part").alias("bom_part"),
            F.when(found, F.col("part")).alias("card_part"),
            "qty_bom",
            F.coalesce("qty_cards", F.lit(0.0)).alias("qty_cards"),
            F.when(~found & F.col("on_cards"), "set_aside")
            .when(~found, "only_in_bom")
            .when(F.abs(F.col("qty_bom") - F.col("qty_cards")) > tol, "qty_mismatch")
            .otherwise("matched")
            .alias("outcome"),
            F.col("bom_ok").alias("valid"),
        )
    ]

    paired = None
    loose = card
    if pairs is not None:
        linked = pairs.withColumn("pair_ok", X.is_part("bom_part"))
        paired = linked.join(card.withColumnRenamed("part", "card_part"), "card_part")
        parts.append(
            paired.join(bom.withColumnRenamed("part", "bom_part"), "bom_part").select(
                "config",
                "bom_part",
                "card_part",
                "qty_bom",
                "qty_cards",
                F.lit("fuzzy_match").alias("outcome"),
                (F.col("pair_ok") & F.col("card_ok")).alias("valid"),
            )
        )
        loose = cut(card.join(pairs.select(F.col("card_part").alias("part")), "part", "left_anti"))
    return parts, paired, loose


def reconcile(bom_qty: DataFrame, cards: DataFrame, **options) -> DataFrame:
    """Discrepancies of all configurations at once."""
    return outcomes(bom_qty, cards, **options).filter(F.col("valid") & F.col("outcome").isin(TYPE_RANK))


def reconcile_one(bom_qty: DataFrame, cards: DataFrame, config: str, fuzzy: bool = True, **options) -> DataFrame:
    """Discrepancies of one configuration; pairs still look at all BOM parts."""
    pairs = format_pairs(bom_qty.select("part"), cards) if fuzzy else None
    return reconcile(
        bom_qty.filter(F.col("config") == config),
        cards,
        configs=bom_qty.select("config").filter(F.col("config") == config),
        fuzzy=fuzzy,
        pairs=pairs,
        **options,
    )


def config_summary(result: DataFrame, cards: DataFrame, configs: DataFrame) -> DataFrame:
    """Counts per configuration from :func:`outcomes` (R6), also of the ``configs`` without any row."""
    # a row of no outcome per configuration: it keeps those without any other and counts nowhere, and no join
    # deals the listed rows by the few configurations
    none = configs.select("config").distinct()
    result = result.select("config", "outcome", "valid").unionByName(none.withColumns({"outcome": F.lit("none"), "valid": F.lit(False)}))

    def n(cond) -> F.Column:
        return F.count(F.when(cond, 1))

    o, valid = F.col("outcome"), F.col("valid")
    n_cards = cards.agg(F.count("part").alias("n")).select("n")
    return (
        result.groupBy("config")
        .agg(
            n(o.isin("matched", "qty_mismatch", "only_in_bom", "set_aside")).alias("total_bom_parts"),
            n((o == "matched") & valid).alias("matched"),
            n((o == "only_in_bom") & valid).alias("only_in_bom"),
            n((o == "only_in_cards") & valid).alias("only_in_cards"),
            n((o == "qty_mismatch") & valid).alias("qty_mismatch"),
            n((o == "fuzzy_match") & valid).alias("fuzzy_match"),
        )
        .withColumn("total_cards_parts", n_cards.scalar())
        .withColumn(
            "discrepancies",
            F.col("only_in_bom") + F.col("only_in_cards") + F.col("qty_mismatch") + F.col("fuzzy_match"),
        )
    )


def summarise(
    bom_qty: DataFrame,
    cards: DataFrame,
    configs: DataFrame | None = None,
    fuzzy: bool = True,
    pairs: DataFrame | None = None,
    strict_pairs: bool = False,
    tol: float = TOLERANCE,
) -> DataFrame:
    """The summary of :func:`config_summary` without listing the surplus of each configuration.

    Card parts a configuration lacks are counted as all of them less those it has, so nothing
    of the size configurations times cards is ever made.
    """
    configs = bom_qty if configs is None else configs
    rows, paired, loose = _compared(bom_qty, cards, fuzzy, pairs, tol)
    usable = loose.filter("card_ok").select("part")
    held = bom_qty.join(usable, "part", "left_semi").select("config")
    total = usable.agg(F.count("part").alias("n")).select("n").scalar()
    if strict_pairs and paired is not None:
        good = paired.filter("card_ok")
        held = held.unionByName(good.join(bom_qty.withColumnRenamed("part", "bom_part"), "bom_part").select("config"))
        total = total + good.agg(F.count("card_part").alias("n")).select("n").scalar()
    n_cards = cards.agg(F.count("part").alias("n")).select("n").scalar()
    o = F.col("outcome")
    counted = union_all([*rows, held.select("config", F.lit("held").alias("outcome"), F.lit(True).alias("valid"))])

    def n(*kinds: str, judged: bool = True) -> F.Column:
        hit = o.isin(*kinds) & F.col("valid") if judged else o.isin(*kinds)
        return F.count(F.when(hit, 1))

    zero = F.lit(0).cast("long")
    per = counted.groupBy("config").agg(
        n("matched", "qty_mismatch", "only_in_bom", "set_aside", judged=False).alias("total_bom_parts"),
        *[n(k).alias(k) for k in ("matched", "only_in_bom", "qty_mismatch", "fuzzy_match")],
        n("held").alias("_held"),
    )
    filled = configs.select("config").distinct().join(per, "config", "left").select(
        "config",
        *[F.coalesce(c, zero).alias(c) for c in ("total_bom_parts", "matched", "only_in_bom", "qty_mismatch", "fuzzy_match")],
        (total - F.coalesce("_held", zero)).alias("only_in_cards"),
    )
    return filled.withColumn("total_cards_parts", n_cards).withColumn(
        "discrepancies",
        F.col("only_in_bom") + F.col("only_in_cards") + F.col("qty_mismatch") + F.col("fuzzy_match"),
    )


def with_details(
    disc: DataFrame, bom_names: DataFrame, cards: DataFrame, originals: DataFrame | None = None, carry: tuple[str, ...] = ("config",)
) -> DataFrame:
    """Names and original spellings of reported parts; ``carry`` names what else is kept of a row.

    ``bom_names(part, name_cn, name_en)``; ``cards`` may carry ``original`` and ``name_ru``;
    ``originals(part, original)`` gives the BOM spelling where parts are keys.
    """
    shown = disc.withColumn("part", F.coalesce("bom_part", "card_part"))
    carried = [c for c in ("original", "name_ru") if c in cards.columns]
    shown = shown.join(bom_names.select("part", "name_cn", "name_en"), "part", "left").join(
        cards.select(
            F.col("part").alias("card_part"), *[F.col(c).alias(f"card_{c}") for c in carried]
        ),
        "card_part",
        "left",
    )
    spelling = [F.col("card_original")] if "original" in carried else []
    if originals is not None:
        shown = shown.join(
            originals.select(F.col("part").alias("bom_part"), F.col("original").alias("bom_original")),
            "bom_part",
            "left",
        )
        spelling.insert(0, F.col("bom_original"))
    blank = F.lit("")
    return shown.select(
        *carry,
        "outcome",
        F.coalesce(*spelling, F.col("part")).alias("part_number"),
        "bom_part",
        "card_part",
        F.coalesce("name_cn", blank).alias("name_cn"),
        F.coalesce("name_en", blank).alias("name_en"),
        (F.coalesce("card_name_ru", blank) if "name_ru" in carried else blank).alias("name_ru"),
        "qty_bom",
        "qty_cards",
    )


def type_rank(c: str = "outcome"):
    return F.array_position(F.array(*[F.lit(t) for t in TYPE_RANK]), F.col(c)).cast("int")


def order_discrepancies(disc: DataFrame, part: str = "part_number") -> DataFrame:
    """Quantity first, then only-BOM, only-cards, format; by part within."""
    return disc.orderBy("config", type_rank(), part)


def config_parts(bom_qty: DataFrame, parts: DataFrame, names: DataFrame, config: str | None = None) -> DataFrame:
    """Parts of one or all configurations with names, from the part or the global names."""
    rows = bom_qty if config is None else bom_qty.filter(F.col("config") == config)
    own = parts.select("part_key", F.col("name_cn").alias("_cn"), F.col("name_en").alias("_en"), F.lit(1).alias("_own"))
    glob = names.select("part_key", F.col("name_cn").alias("_gcn"), F.col("name_en").alias("_gen"))
    known = F.col("_own").isNotNull()
    return (
        rows.join(own, "part_key", "left")
        .join(glob, "part_key", "left")
        .select(
            "config",
            "part_key",
            "qty",
            F.coalesce(F.when(known, F.col("_cn")).otherwise(F.col("_gcn")), F.lit("")).alias("name_cn"),
            F.coalesce(F.when(known, F.col("_en")).otherwise(F.col("_gen")), F.lit("")).alias("name_en"),
        )
    )


def require_config(configs: DataFrame, config: str) -> None:
    """Raise for a configuration the BOM does not have."""
    if not configs.filter(F.col("config") == config).limit(1).count():
        raise ValueError(f"configuration {config!r} not found")


def lookup_names(wanted: DataFrame, parts: DataFrame, names: DataFrame) -> DataFrame:
    """Names of part numbers: the part's own if it has any, else the global ones."""
    own = parts.select("part_key", F.col("name_cn").alias("_cn"), F.col("name_en").alias("_en"))
    glob = names.select("part_key", F.col("name_cn").alias("_gcn"), F.col("name_en").alias("_gen"))
    named = (F.coalesce("_cn", F.lit("")) != "") | (F.coalesce("_en", F.lit("")) != "")
    return (
        wanted.join(own, "part_key", "left")
        .join(glob, "part_key", "left")
        .withColumns(
            {
                "name_cn": F.coalesce(F.when(named, F.col("_cn")).otherwise(F.col("_gcn")), F.lit("")),
                "name_en": F.coalesce(F.when(named, F.col("_en")).otherwise(F.col("_gen")), F.lit("")),
            }
        )
        .drop("_cn", "_en", "_gcn", "_gen")
    )


def integrity(summary: DataFrame) -> DataFrame:
    """Per configuration: matched and reported BOM parts against all BOM parts."""
    accounted = F.col("matched") + F.col("only_in_bom") + F.col("qty_mismatch") + F.col("fuzzy_match")
    return summary.select(
        "config",
        "total_bom_parts",
        accounted.alias("accounted"),
        (accounted - F.col("total_bom_parts")).alias("diff"),
        (accounted == F.col("total_bom_parts")).alias("is_ok"),
        "matched",
        "only_in_bom",
        "qty_mismatch",
        "fuzzy_match",
    )


def count_discrepancies(listed: DataFrame, bits: DataFrame) -> DataFrame:
    """Number of reported discrepancies of all configurations (one row, ``total``), whatever their type.

    Counts rows and bits of :func:`split_outcomes`; it shares no aggregate with the summary. The type is not
    looked at: what is neither matched nor set aside counts.
    """
    direct = listed.filter(F.col("valid") & ~F.col("outcome").isin("matched", "set_aside")).select(F.lit(1).cast("long").alias("n"))
    surplus = bits.filter("valid").select(F.bit_count("lacking").cast("long").alias("n"))
    return direct.unionByName(surplus).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"))


def integrity_global(by_type: DataFrame, counted: DataFrame) -> DataFrame:
    """Over all: the sum over the four types against an independent count of discrepancies.

    ``by_type(outcome, n)`` comes from the summary (``report.totals_of``), ``counted`` from :func:`count_discrepancies`.
    """
    typed = by_type.filter(F.col("outcome").isin(TYPE_RANK)).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("typed"))
    return counted.withColumn("typed", typed.scalar()).withColumn("is_ok", F.col("total") == F.col("typed"))


def run_totals(bom_qty: DataFrame, cards: DataFrame) -> DataFrame:
    """Configurations, unique BOM parts, unique card parts."""
    n_cards = cards.agg(F.count("part").alias("n")).select("n")
    return bom_qty.agg(
        F.count_distinct("config").alias("total_configs"),
        F.count_distinct("part").alias("bom_unique_parts"),
    ).withColumn("cards_unique_parts", n_cards.scalar())


def config_catalog(bom_qty: DataFrame, part: str = "part_key") -> DataFrame:
    """Configuration names with their part counts."""
    return bom_qty.groupBy("config").agg(F.count(part).alias("parts"))


def part_catalog(bom_qty: DataFrame, part: str = "part_key") -> DataFrame:
    return bom_qty.select(part).distinct()
