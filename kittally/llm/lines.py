"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from kittally.llm.common import id_text
from kittally.session import cut

#: Similarity as a fraction; rarity is known for 2 ** RARITY groups of words; least and most bits of a table of wanted
#: rows, as powers of two; a size class spans WIDTH times the largest ratio of similar sizes; sets of more than WIDE words
#: have 128 bits instead of 64, those of more than LONG a sketch of their own.
SIMILARITY, RARITY, BITS, WIDTH, SKETCH, RAREST, SHARED, WIDE, LONG = (4, 5), 14, (16, 26), 4, 8, 9, 1, 64, 128
TWO = ("low", "high")
_LOW = 64 - RARITY


def _ceil(a: Column, b: int) -> Column:
    """a / b, rounded up, for a whole number a of at least 0."""
    return F.floor((a + (b - 1)) / b).cast("int")


def _bit(number: Column) -> Column:
    """A long with the one bit set that the lowest six bits of a number name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))


def tokens(line: Column) -> Column:
    """Words of a line of ``split_lines``: runs of anything but blanks."""
    return F.array_remove(F.split(line, " "), "")


def _plain_blanks(text: Column) -> Column:
    """The text with 0x09 and 0x0B-0x0D as blanks; texts without them are not gone through."""
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\f")) | F.contains(text, F.lit("\r"))
    return F.when(odd, F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text)


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, line_no, line), one row per line that has a word; null texts have none."""
    lines = docs.select("doc_id", "twin", F.posexplode(F.split(_plain_blanks(F.col("text")), "\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "")


def _rarity(docs: DataFrame) -> Column:
    """Rank of each group of words by its count over all texts, rarest first, as the upper bits of longs in one literal."""
    group = F.shiftrightunsigned(F.xxhash64("word"), _LOW)
    plain = F.replace(_plain_blanks(F.col("text")), F.lit("\n"), F.lit(" "))
    words = docs.select(F.explode(F.split(plain, " ")).alias("word")).where("word <> ''")
    counts = words.groupBy(group.alias("g")).count().collect()
    ranks = [-1 << 63] * (1 << RARITY)
    for rank, row in enumerate(sorted(counts, key=lambda r: (r["count"], r["g"]))):
        ranks[row["g"]] = (rank - (1 << (RARITY - 1))) << _LOW
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")


def _ordered(words: Column, ranks: Column) -> Column:
    """A line's distinct words as longs whose order is their rarity: rank above the rest of the hash."""

    def one(h: Column) -> Column:
        rank = F.coalesce(ranks[F.shiftrightunsigned(h, _LOW)], F.lit(0).cast("long"))
        return rank.bitwiseOR(h.bitwiseAND(F.lit((1 << _LOW) - 1)))

    return F.array_distinct(F.sort_array(F.transform(F.transform(words, lambda w: F.xxhash64(w)), one)))


def _flips(words: str, bits: int, since: int = 0) -> Column:
    """64 of a number of bits, each flipped once per word whose lowest bits name it."""
    table = F.array(*(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") if 0 <= i < 64 else F.lit(0).cast("long") for i in range(-since, bits - since)))
    flip = lambda acc, w: acc.bitwiseXOR(F.coalesce(table[w.bitwiseAND(F.lit(bits - 1).cast("long"))], acc))
    return F.aggregate(words, F.lit(0).cast("long"), flip)


def line_sets(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(id, first, low, high, n, prefix): one row per different set of words among the lines, to be written once.

    ``first`` is the first line with that set; ids rise in the order of these lines. Each word flips one
    bit of 64 in ``low``, in sets of more than WIDE words one of 128 in ``low`` and ``high``: two sets that differ in d
    words differ in at most d bits. ``prefix`` has the rarest words.
    """
    num, den = similarity
    sets = split_lines(docs).select("doc_id", "twin", "line_no", _ordered(tokens(F.col("line")), _rarity(docs)).alias("words"))
    n, rare = F.size("words"), F.size("rare")
    sets = sets.select("*", F.slice("words", 1, n - _ceil(n * num, den) + SHARED).alias("rare"))
    sets = sets.select(
        F.xxhash64("words").alias("h"),
        F.when(n > WIDE, _flips("words", 128)).otherwise(_flips("words", 64)).alias("low"),
        F.when(n > WIDE, _flips("words", 128, 64)).otherwise(F.lit(0).cast("long")).alias("high"),
        n.alias("n"),
        F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "twin").alias("first"),
        F.when(rare > 0, F.transform("rare", lambda w: F.hash(w))).otherwise(F.array().cast("array<int>")).alias("prefix"),
    )
    sets = sets.groupBy("h", *TWO, "n").agg(F.min("first").alias("first"), F.first("prefix").alias("prefix")).drop("h")
    in_order = (F.col("first.doc_id").asc_nulls_last(), "first.line_no", "first.twin")
    return sets.orderBy(*in_order).withColumn("id", F.monotonically_increasing_id())


def _differ(a: str, b: str) -> Column:
    """Differing bits of two sets whose columns end in these marks; 128 bits fold into 64 if the other set has no more."""
    low, high = (F.col(f"{c}_{a}").bitwiseXOR(F.col(f"{c}_{b}")) for c in TWO)
    alike = (F.col(f"n_{a}") > WIDE) == (F.col(f"n_{b}") > WIDE)
    return F.when(alike, F.bit_count(low) + F.bit_count(high)).otherwise(F.bit_count(low.bitwiseXOR(high)))


def stars(sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(late, early): for sets that most likely match an earlier one, one such set; a row per set at most.

    Of all sets that share two of their RAREST words, one next to the other in order, each only meets the first. It
    counts as likely if length and bits allow it. So near copies of one line, however many, give one row each.
    """
    num, den = similarity
    rare = lambda at: F.slice("prefix", at, F.least(F.size("prefix"), F.lit(RAREST)) - 1)
    rows = sets.where(F.col("n") * (den - num) >= num).select("id", F.inline(F.arrays_zip(rare(1).alias("one"), rare(2).alias("two"))).alias("one", "two"))
    rows = rows.select("id", F.shiftleft(F.col("one").cast("long"), 32).bitwiseOR(F.col("two").cast("long").bitwiseAND(F.lit((1 << 32) - 1))).alias("word"))
    first = cut(rows.groupBy("word").agg(F.min("id").alias("early"), F.count("*").alias("sets")).where("sets > 1").drop("sets"))
    rows = _among(rows, F.xxhash64("word"), first.select(F.xxhash64("word").alias("h")))
    met = cut(rows.join(first, "word").where("early < id").select(F.col("id").alias("late"), "early").distinct())
    some = _by_id(sets, met, "late", "early")
    for x in ("late", "early"):
        met = met.join(some.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in (*TWO, "n"))), x)
    total = F.col("n_late") + F.col("n_early")
    met = met.where(F.least("n_late", "n_early") * den >= F.greatest("n_late", "n_early") * num)
    met = met.where(_differ("late", "early") <= total - 2 * _ceil(total * num, num + den))
    return met.groupBy("late").agg(F.min("early").alias("early"))


def candidates(sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Pairs (early, late) of ids of sets that may be similar; loses none whose late set has ``open`` set.

    A set of n words has a similar one of other words only from n / (n + 1) >= similarity on, and one of the
    same size from (n - 1) / (n + 1) >= similarity on; smaller ones are left out.

    Prefix filter: SHARED of the longer set's rarest words must be among the rarest of the shorter one. Length
    and positional filter: behind each of these both must have enough words left. Last, the bits. Sets
    are in classes of size, and the class is part of the join key: a set meets longer ones in its own class
    and, if sets that are similar to it can be so long, in the next.
    """
    num, den = similarity
    step = WIDTH * math.log(den / num)
    need = lambda n, m: _ceil((n + m) * num, num + den)
    rows = sets.where(F.col("n") * (den - num) >= num).select("id", *TWO, "n", "open", "prefix", F.floor(F.log("n") / F.lit(step)).cast("int").alias("class"))
    beyond = F.greatest("n", F.floor(F.exp((F.col("class") + 1) * F.lit(step))).cast("int"))  # sizes from the next class on
    goals = F.array(F.struct("class", F.col("n").alias("m")), F.struct((F.col("class") + 1).alias("class"), beyond.alias("m")))
    short = rows.withColumn("goal", F.explode(goals)).where(F.col("goal.m") * num <= F.col("n") * den)
    short = short.withColumn("class", F.col("goal.class")).withColumn("prefix", F.slice("prefix", 1, F.col("n") - need(F.col("n"), F.col("goal.m")) + SHARED))

    def side(some: DataFrame, mark: str) -> DataFrame:
        some = some.select("id", *TWO, "n", "open", "class", F.posexplode("prefix").alias("at", "word"))
        packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft("at", 1).cast("long")).bitwiseOR(F.col("open").cast("long"))
        return some.select(F.hash("word", "class").alias("key"), *(F.col(c).alias(f"{c}_{mark}") for c in ("id", *TWO)), packed.alias(f"packed_{mark}"))

    def whole(pairs: DataFrame) -> DataFrame:
        for x in ("a", "b"):
            packed = F.col(f"packed_{x}")
            pairs = pairs.withColumns({
                f"n_{x}": F.shiftright(packed, 32).cast("int"),
                f"at_{x}": F.shiftright(packed.bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int"),
                f"open_{x}": packed.bitwiseAND(F.lit(1)) == 1,
            })
        return pairs

    total, least = F.col("n_a") + F.col("n_b"), need(F.col("n_a"), F.col("n_b"))
    return (
        whole(side(rows, "a").join(side(short, "b"), "key"))
        .where("n_b <= n_a")
        .where((F.col("n_b") < F.col("n_a")) | (F.col("n_a") * (den - num) >= num + den))
        .where(F.col("n_b") * den >= F.col("n_a") * num)
        .where(_differ("a", "b") <= total - 2 * least)
        .where(F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= least - (SHARED - 1))
        .where("n_b < n_a or id_b < id_a")
        .where(F.when(F.col("id_a") > F.col("id_b"), F.col("open_a")).otherwise(F.col("open_b")))
        .groupBy(F.least("id_a", "id_b").alias("early"), F.greatest("id_a", "id_b").alias("late"))
        .agg(F.count("*").alias("shared"), F.max(least).alias("least"))
        .where(F.col("shared") >= F.least(F.lit(SHARED), "least"))
        .select("early", "late")
    )


def _seen(rows: DataFrame, of: Column, wanted: DataFrame) -> DataFrame:
    """The rows with ``seen``: whether their hash ``of`` may be one of ``wanted(h)``; it is for all that are, and few others.

    A table of bits, sixteen for each wanted hash up to 2 ** 26 in all (2 ** 20 rows), is sent to all executors. What it
    lets pass is joined exactly afterwards, so its size decides on rows moved and never on results.
    """
    least, most = BITS
    size = 1 << min(most, max(least, (16 * wanted.count()).bit_length()))
    one = _bit(F.col("place"))
    bits = wanted.select(F.pmod("h", F.lit(size)).alias("place")).groupBy(F.shiftright("place", 6).alias("slot")).agg(F.bit_or(one).alias("set"))
    there = rows.withColumn("place", F.pmod(of, F.lit(size))).withColumn("slot", F.shiftright("place", 6))
    there = there.join(F.broadcast(bits), "slot", "left").withColumn("seen", F.coalesce(F.col("set").bitwiseAND(one) != 0, F.lit(False)))
    return there.drop("place", "slot", "set")


def _among(rows: DataFrame, of: Column, wanted: DataFrame) -> DataFrame:
    """The rows whose hash ``of`` may be one of ``wanted(h)``: all that are, and few others."""
    return _seen(rows, of, wanted).where("seen").drop("seen")


def _by_id(sets: DataFrame, wanted: DataFrame, *names: str) -> DataFrame:
    """The sets with ids in these columns of ``wanted``, and few others."""
    return _among(sets, F.xxhash64("id"), wanted.select(F.explode(F.array(*names)).alias("id")).select(F.xxhash64("id").alias("h")))


def _opened(sets: DataFrame, settled: DataFrame) -> DataFrame:
    """The sets with ``open``: whether they are not among ``settled(late)``. Only those that may be settled are moved."""
    seen = _seen(sets, F.xxhash64("id"), settled.select(F.xxhash64("late").alias("h")))
    some = seen.where("seen").join(settled.withColumn("done", F.lit(True)), F.col("id") == F.col("late"), "left")
    return seen.where("not seen").withColumn("open", F.lit(True)).drop("seen").unionByName(some.withColumn("open", F.col("done").isNull()).drop("seen", "late", "done"))


def _marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted lines and few others; only texts with such lines are split."""
    docs = _among(docs, F.xxhash64("doc_id", "twin"), wanted.select(F.xxhash64("doc_id", "twin").alias("h")).distinct())
    place = F.xxhash64("doc_id", "twin", "line_no")
    return _among(split_lines(docs), place, wanted.select(place.alias("h")))


def matched(docs: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(late): the ids of sets that an earlier set matches, each verified word by word.

    One earlier match is enough. Sets with a likely match (a star) are compared with that one first; all sets that are
    not settled by it are compared with all their candidates.
    """
    settled = cut(verified(docs, sets, cut(stars(sets, similarity)), similarity))
    pairs = cut(candidates(_opened(sets, settled), similarity))
    return settled.unionByName(verified(docs, sets, pairs, similarity))


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(late): those of the pairs' late sets that match their early one in one pair or more.

    For sets of more than LONG words, a sketch of 64 * SKETCH bits, flipped once per word, drops most pairs that cannot
    match before any words are moved.
    """
    num, den = similarity
    ids = pairs.select(F.explode(F.array("early", "late")).alias("id")).distinct()
    needed = cut(_by_id(sets.select("id", "n", "first"), pairs, "early", "late").join(ids, "id").select("id", "n", "first.doc_id", "first.twin", "first.line_no"))
    there = _marked(docs, needed).withColumnsRenamed({"doc_id": "d", "twin": "t", "line_no": "l"})
    at = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")) & (F.col("line_no") == F.col("l"))
    found = cut(needed.join(there, at).select("id", "n", "line").dropDuplicates(["id"]))
    hashes = found.where(F.col("n") > LONG).select("id", F.transform(F.array_distinct(tokens(F.col("line"))), lambda w: F.xxhash64(w)).alias("h"))
    part = lambda i: F.filter("h", lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(SKETCH - 1)) == i)
    flips = [F.aggregate(part(i), F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(_bit(w))).alias(f"s{i}") for i in range(SKETCH)]
    sketches = cut(hashes.select("id", F.size("h").alias("n"), *flips))

    def with_both(some: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        for x in ("early", "late"):
            some = some.join(table.select(*(F.col(c).alias(x if c == "id" else f"{c}_{x}") for c in table.columns)), x, how)
        return some

    differ = sum((F.bit_count(F.col(f"s{i}_early").bitwiseXOR(F.col(f"s{i}_late"))) for i in range(SKETCH)), F.lit(0))
    total = F.col("n_early") + F.col("n_late")
    near = with_both(pairs, sketches, "left").where(F.coalesce(differ <= total - 2 * _ceil(total * num, num + den), F.lit(True)))
    joined = with_both(near.select("early", "late"), found.select("id", "line"))
    words = [tokens(F.col(f"line_{x}")) for x in ("early", "late")]
    return joined.where(F.size(F.array_intersect(*words)) * den >= F.size(F.array_union(*words)) * num).select("late").distinct()


def duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, twin, n_lines, removed): for each row the numbers of the lines that an earlier line matches.

    Lines end at line feeds and are compared as sets of words; two match if the Jaccard similarity of
    their sets is at least ``similarity``. Lines are in order of (key, number in the text), null keys last; a
    line goes if any earlier line of the input matches it. Lines without a word stay. A null text has no
    lines. ``twin`` is a hash of the text: rows that repeat key and text count as one document and are
    treated alike.
    """
    rows = id_text(docs, key, text).withColumn("twin", F.hash("text"))
    sets = cut(line_sets(rows, similarity))
    kept = sets.select("id", "first").join(matched(rows, sets, similarity), F.col("id") == F.col("late"), "left_anti").select("first.*")
    kept = kept.groupBy("doc_id", "twin").agg(F.collect_list("line_no").alias("kept")).withColumnsRenamed({"doc_id": "d", "twin": "t"})
    blank = F.transform(F.split(_plain_blanks(F.col("text")), "\n"), lambda x: F.trim(x) == "")
    rows = rows.select("doc_id", "twin", blank.alias("blank"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")), "left")
    numbers = F.transform("blank", lambda x, i: F.when(~x, i))
    removed = F.array_except(F.filter(numbers, lambda i: i.isNotNull()), F.coalesce("kept", F.array().cast("array<int>")))
    return rows.select("doc_id", "twin", F.coalesce(F.size("blank"), F.lit(0)).alias("n_lines"), F.coalesce(removed, F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs with the matched lines taken out of the texts; other columns and rows stay as they are."""
    found = duplicate_lines(docs, key, text, similarity).where("size(removed) > 0").dropDuplicates(["doc_id", "twin"]).drop("n_lines")
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    joined = whole.join(found, F.col("k").eqNullSafe(F.col("doc_id")) & (F.hash("t") == F.col("twin")), "left")
    left = F.array_join(F.filter(F.split("t", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    new = F.when(F.col("removed").isNull(), F.col("t")).otherwise(left)
    return joined.select(*((new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))
