import pytest
from pyspark.sql import functions as F

from kittally.operators import reconcile as R
from kittally.operators import report as P
from kittally.operators import totals as A


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def bom(spark, rows):
    return frame(spark, rows, "config string, part string, qty double")


def cards(spark, rows):
    return frame(spark, rows, "part string, qty double")


def result(df):
    return {(r.config, r.bom_part or r.card_part, r.outcome) for r in df.collect()}


def test_two_configs(spark):
    b = bom(spark, [("舒享版", "P001", 2.0), ("舒享版", "P002", 1.0), ("奢享版", "P001", 1.0), ("奢享版", "P003", 3.0)])
    c = cards(spark, [("P001", 1.0), ("P002", 1.0), ("P004", 3.0)])
    out = R.outcomes(b, c)
    assert result(out) == {
        ("舒享版", "P001", "qty_mismatch"), ("舒享版", "P002", "matched"), ("舒享版", "P004", "only_in_cards"),
        ("奢享版", "P001", "matched"), ("奢享版", "P003", "only_in_bom"), ("奢享版", "P002", "only_in_cards"), ("奢享版", "P004", "only_in_cards"),
    }
    s = {r.config: r for r in R.config_summary(out, c, b).collect()}
    assert (s["舒享版"].total_bom_parts, s["舒享版"].matched, s["舒享版"].discrepancies) == (2, 1, 2)
    assert s["奢享版"].total_cards_parts == 3
    assert all(r.is_ok for r in R.integrity(R.config_summary(out, c, b)).collect())


def test_format_pair_and_exact_wins(spark):
    b = bom(spark, [("A", "AB-12", 1.0), ("A", "CD-34", 2.0), ("B", "CD-34", 2.0)])
    c = cards(spark, [("AB12", 1.0), ("CD-34", 2.0), ("CD.34", 5.0)])
    out = result(R.outcomes(b, c))
    assert ("A", "AB-12", "fuzzy_match") in out
    assert ("A", "CD-34", "matched") in out
    # the pair exists beside the exact match and is reported for each configuration of its BOM part
    assert ("A", "CD-34", "fuzzy_match") in out and ("B", "CD-34", "fuzzy_match") in out
    # the spelling AB12 is known to the BOM, so configuration B does not list it as missing
    assert not any(o == "only_in_cards" for _, _, o in out)
    strict = result(R.outcomes(b, c, strict_pairs=True))
    assert ("B", "AB12", "only_in_cards") in strict


def test_pair_takes_least_spelling(spark):
    b = bom(spark, [("A", "AB 12", 1.0), ("A", "AB-12", 1.0)])
    c = cards(spark, [("AB.12", 1.0)])
    pairs = R.format_pairs(b.select("part"), c).collect()
    assert [(p.card_part, p.bom_part) for p in pairs] == [("AB.12", "AB 12")]
    assert ("A", "AB-12", "set_aside") in result(R.outcomes(b, c))


def test_invalid_parts_count_but_are_not_reported(spark):
    b = bom(spark, [("A", "板", 1.0), ("A", "P001", 1.0)])
    c = cards(spark, [("P001", 1.0), ("无", 2.0)])
    out = R.outcomes(b, c)
    assert R.reconcile(b, c).count() == 0
    (audit,) = R.integrity(R.config_summary(out, c, b)).collect()
    assert (audit.total_bom_parts, audit.accounted, audit.diff, audit.is_ok) == (2, 1, -1, False)


def test_tolerance_is_strict(spark):
    b = bom(spark, [("A", "P001", 1.0), ("A", "P002", 1.0)])
    c = cards(spark, [("P001", 1.0009), ("P002", 1.0011)])
    assert result(R.outcomes(b, c)) == {("A", "P001", "matched"), ("A", "P002", "qty_mismatch")}


def test_many_configs_cross_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "WORD", 4)
    rows = [(f"c{i:03d}", f"P{i % 7:03d}", 1.0) for i in range(50)]
    b, c = bom(spark, rows), cards(spark, [(f"P{i:03d}", 1.0) for i in range(9)])
    got = {(r.config, r.part) for r in R.missing_configs(c, b, b).collect()}
    held = {(x, p) for x, p, _ in rows}
    assert got == {(f"c{i:03d}", f"P{p:03d}") for i in range(50) for p in range(9)} - held


@pytest.mark.parametrize("options", [{}, {"fuzzy": False}, {"strict_pairs": True}])
def test_summary_without_listing(spark, options):
    b = bom(spark, [("A", "AB-12", 1.0), ("A", "板", 1.0), ("B", "P001", 2.0), ("B", "CD-34", 2.0), ("C", "CD 34", 1.0)])
    c = cards(spark, [("AB12", 1.0), ("P001", 2.0), ("无", 1.0), ("CD.34", 5.0), ("P009", 1.0)])
    columns = sorted(R.summarise(b, c, **options).columns)
    listed = R.config_summary(R.outcomes(b, c, **options), c, b).select(columns)
    assert sorted(map(tuple, R.summarise(b, c, **options).select(columns).collect())) == sorted(map(tuple, listed.collect()))


def test_surplus_in_bits(spark, monkeypatch):
    """Counts and lowest bits say what the unfolded rows say, over several words, the last one not full."""
    monkeypatch.setattr(R, "WORD", 4)
    rows = [(f"c{i:02d}", f"P{p:03d}", 1.0) for i in range(11) for p in range(6) if (i * 7 + p * 3) % 4]
    b, c = bom(spark, rows), cards(spark, [(f"P{p:03d}", 1.0) for p in range(8)] + [("无", 1.0)])
    words = R.config_words(b)
    listed, bits = R.split_outcomes(b, c, words)
    out = R.outcomes(b, c)
    surplus = [(r.card_part, r.config) for r in out.filter("outcome = 'only_in_cards'").collect()]
    per_part = {r.card_part: r.n for r in bits.groupBy("card_part").agg(F.sum(F.bit_count("lacking")).alias("n")).collect()}
    assert per_part == {p: sum(1 for q, _ in surplus if q == p) for p, _ in surplus}
    assert R.count_discrepancies(listed, bits).first().total == R.reconcile(b, c).count()
    assert bits.count() <= 9 * 3


def test_bits_of_exactly_full_words(spark):
    rows = [(f"c{i:03d}", "P001", 1.0) for i in range(2 * R.WORD)]
    b, c = bom(spark, rows), cards(spark, [("P001", 1.0), ("P002", 1.0)])
    _, bits = R.split_outcomes(b, c, R.config_words(b))
    assert [r.n for r in bits.select(F.bit_count("lacking").alias("n")).collect()] == [R.WORD, R.WORD]
    assert R.reconcile(b, c).count() == 2 * R.WORD


def test_global_audit_can_fail(spark):
    b = bom(spark, [("A", "P001", 2.0), ("B", "P002", 1.0)])
    c = cards(spark, [("P001", 1.0), ("P003", 1.0)])
    by_type = P.totals_of(P.levels(R.summarise(b, c)))
    listed, bits = R.split_outcomes(b, c, R.config_words(b))
    good = R.integrity_global(by_type, R.count_discrepancies(listed, bits)).first()
    assert (good.total, good.typed, good.is_ok) == (5, 5, True)
    odd = listed.withColumn("outcome", F.when(F.col("outcome") == "matched", "other").otherwise(F.col("outcome"))).unionByName(listed.limit(1).withColumn("outcome", F.lit("other")))
    assert not R.integrity_global(by_type, R.count_discrepancies(odd, bits)).first().is_ok
    assert not R.integrity_global(by_type.filter("outcome <> 'only_in_cards'"), R.count_discrepancies(listed, bits)).first().is_ok


def test_levels_add_up(spark):
    b = bom(spark, [("A", "P001", 2.0), ("B", "P002", 1.0), ("C", "P001", 1.0)])
    c = cards(spark, [("P001", 1.0), ("P003", 1.0)])
    got = {(r.config, r.outcome, r.level): r.n for r in P.levels(R.summarise(b, c)).collect()}
    disc = [(r.config, r.outcome) for r in R.reconcile(b, c).collect()]
    assert got[None, None, 3] == len(disc)
    for config, outcome in set(disc):
        assert got[config, outcome, 0] == disc.count((config, outcome))
        assert got[config, None, 1] == sum(1 for x, _ in disc if x == config)
        assert got[None, outcome, 2] == sum(1 for _, o in disc if o == outcome)


def test_digest_from_bits(spark, monkeypatch):
    monkeypatch.setattr(R, "WORD", 3)
    monkeypatch.setattr(P, "WORD", 3)
    rows = [(f"c{i:02d}", f"P{p:03d}", float(p)) for i in range(8) for p in range(5) if (i + p) % 3]
    b, c = bom(spark, rows), cards(spark, [(f"P{p:03d}", 1.0) for p in range(9)])
    numbered = spark.createDataFrame([(f"c{i:02d}", 8 - i) for i in range(8)], "config string, config_no int")
    names = spark.createDataFrame([], "part string, name_cn string, name_en string")
    listed, bits = R.split_outcomes(b, c, R.config_words(numbered))
    detail = R.with_details(listed.filter("valid AND outcome <> 'matched'"), names, c)
    surplus = R.with_details(bits, names, c, carry=("word", "lacking"))
    got = {(r.outcome, r.part_number): (r.config_nos, r.entries, r.more) for r in P.digest(detail, surplus, numbered, k=4).collect()}
    number = {f"c{i:02d}": 8 - i for i in range(8)}
    want = {}
    for r in R.reconcile(b, c).collect():
        want.setdefault(r.outcome, {}).setdefault(r.bom_part or r.card_part, set()).add(number[r.config])
    for outcome, parts in want.items():
        for part in sorted(parts)[:4]:
            nos = ",".join(map(str, sorted(parts[part])))
            assert got.pop((outcome, part)) == (nos, sum(map(len, parts.values())), max(len(parts) - 4, 0))
    assert not got


def test_one_config_and_unknown(spark):
    b = bom(spark, [("A", "P001", 2.0), ("B", "P002", 1.0)])
    c = cards(spark, [("P001", 1.0), ("P-002", 1.0)])
    assert result(R.reconcile_one(b, c, "A")) == {("A", "P001", "qty_mismatch")}
    assert result(R.reconcile_one(b, c, "A", fuzzy=False)) == {("A", "P001", "qty_mismatch"), ("A", "P-002", "only_in_cards")}
    with pytest.raises(ValueError):
        R.require_config(b, "C")


def test_hot_part_and_order_of_types(spark):
    b = bom(spark, [("A", f"P{i:04d}", float(i % 5 + 1)) for i in range(100)])
    c = cards(spark, [(f"P{i:04d}", float(i % 3 + 1)) for i in range(100)])
    disc = R.with_details(R.reconcile(b, c), frame(spark, [], "part string, name_cn string, name_en string"), c)
    rows = R.order_discrepancies(disc).collect()
    assert rows and [r.part_number for r in rows] == sorted(r.part_number for r in rows)
    assert all(r.qty_bom != r.qty_cards for r in rows)


def test_first_cards_and_file_errors(spark):
    used = frame(spark, [("P1", f"C{i}", i) for i in range(9)], "part_key string, card_no string, ord int")
    assert P.first_cards(used).first().card_list == "C0, C1, C2, C3, C4"
    detailed = frame(spark, [("a.xlsx", "d", "bad zip", "parse")], "file string, folder string, error string, phase string")
    legacy = frame(spark, [("x/a.xlsx",), ("y/z/b.xlsx",)], "path string")
    rows = {tuple(r) for r in P.file_errors(detailed, legacy).collect()}
    assert rows == {("a.xlsx", "d", "bad zip", "parse"), ("b.xlsx", "y/z", "", "split")}


def test_digest_counts_more(spark):
    rows = [("A", "only_in_bom", f"P{i:03d}", f"P{i:03d}", None, 1.0, 0.0) for i in range(40)]
    rows += [("B", "only_in_bom", "P000", "P000", None, 9.0, 0.0)]
    disc = frame(spark, rows, "config string, outcome string, part_number string, bom_part string, card_part string, qty_bom double, qty_cards double")
    configs = frame(spark, [("A", 1), ("B", 2)], "config string, config_no int")
    none = frame(spark, [], "outcome string, part_number string, bom_part string, card_part string, qty_bom double, qty_cards double, word int, lacking long")
    got = {r.part_number: r for r in P.digest(disc, none, configs).collect()}
    assert len(got) == 30 and got["P000"].config_nos == "1,2" and got["P000"].qty_bom == 1.0
    assert (got["P029"].more, got["P029"].entries) == (10, 41)


def test_names_and_selection(spark):
    lines = frame(
        spark,
        [("P1", 1, "", "first"), ("P1", 2, "板\nplate", "second"), ("P2", 3, "", "")],
        "part_key string, ord int, name_cn string, name_en string",
    )
    assert {tuple(r) for r in A.part_names(lines).collect()} == {("P1", "板", "first"), ("P2", "", "")}
    qty = frame(spark, [("A", "P1", 1.0), ("B", "P1", 1.0)], "config string, part_key string, qty double")
    assert A.select_configs(qty, frame(spark, [("B",)], "config string")).count() == 1
    assert A.select_configs(qty, frame(spark, [], "config string")).count() == 2
    metrics = A.load_metrics(
        frame(spark, [("C1", "s", "P1"), ("C1", "s", "P2")], "card_no string, sheet string, part_key string"),
        frame(spark, [("x",)], "card_path string"),
    ).first()
    assert (metrics.cards, metrics.sheets, metrics.unique_parts, metrics.failed) == (1, 1, 2, 1)


def test_backfill_only_where_both_are_empty(spark):
    parts = frame(spark, [("P1", "", ""), ("P2", "", "own")], "part_key string, name_cn string, name_en string")
    names = frame(spark, [("P1", "板", "plate"), ("P2", "板", "plate")], "part_key string, name_cn string, name_en string")
    assert {tuple(r) for r in A.backfill_names(parts, names).collect()} == {("P1", "板", "plate"), ("P2", "", "own")}
