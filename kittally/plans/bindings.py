"""The engine's input relations, derived from the benchmark tables.

Every relation uses the whole of the tables it is derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _number() -> F.Column:
    return F.concat(F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.lit("-"), F.col("l_linenumber"))


def _order() -> F.Column:
    """Sheet and row order of a line item, as sortable text."""
    return F.concat_ws(
        "-",
        F.lpad(F.col("l_suppkey").cast("string"), 8, "0"),
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0"),
        F.col("l_linenumber").cast("string"),
        F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0"),
        F.lpad(F.col("l_partkey").cast("string"), 8, "0"),
        F.round(F.col("l_tax") * 100).cast("int").cast("string"),
    )


def bom_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Open line items: one BOM line each, configuration = return flag."""
    li = table(spark, sf, "lineitem").filter("l_linestatus = 'O'")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
    raw = F.concat(F.lit("P-"), _number())
    return li.join(part, "l_partkey", "left").select(
        raw.alias("raw"),
        X.part_key(raw).alias("part_key"),
        _order().alias("ord"),
        F.when(F.col("l_returnflag") == "A", F.concat("p_name", F.lit("\n"), "p_brand"))
        .when(F.col("l_returnflag") == "N", F.col("p_name"))
        .otherwise("")
        .alias("name_cn"),
        F.when(F.col("l_discount") > 0.02, F.col("p_type")).otherwise("").alias("name_en"),
        F.col("l_returnflag").alias("config"),
        F.concat(F.lit("sheet "), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") > 4, " 总装BOM").otherwise("")).alias("sheet"),
        F.when(F.col("l_tax") == 0, " s ")
        .when(F.col("l_tax") < 0.02, "–")
        .when(F.col("l_tax") < 0.03, "n/a")
        .when(F.col("l_tax") < 0.04, F.concat(F.col("l_linenumber").cast("string"), F.lit(",5")))
        .otherwise(F.col("l_linenumber").cast("string"))
        .alias("marker"),
        F.col("l_quantity").cast("int").cast("string").alias("qty_cell"),
        (F.col("l_discount") > 0.01).alias("has_qty"),
    )


def card_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Finished line items: one card line each, card = supplier; some numbers are spelled apart."""
    li = table(spark, sf, "lineitem").filter("l_linestatus = 'F'")
    raw = F.when(
        F.col("l_tax") > 0.05, F.concat(F.lit("p_"), F.translate(_number(), "-", "."))
    ).otherwise(F.concat(F.lit("P-"), _number()))
    return li.select(
        F.concat(F.lit("C"), F.col("l_suppkey").cast("string")).alias("card_no"),
        F.col("l_returnflag").alias("sheet"),
        raw.alias("raw"),
        X.part_key(raw).alias("part_key"),
        _order().alias("ord"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(
            F.concat(F.lit("деталь "), F.col("l_suppkey").cast("string"))
        ).alias("name_ru"),
        F.lit(1.0).alias("qty"),
        F.col("l_quantity").alias("quantity"),
    )


def raw_bom_qty(spark: SparkSession, sf: str) -> DataFrame:
    """Unit quantities per configuration and part number as written."""
    li = table(spark, sf, "lineitem").filter("l_linestatus = 'O'")
    return li.groupBy(
        F.col("l_returnflag").alias("config"), F.concat(F.lit("P-"), _number()).alias("part")
    ).agg(F.count(F.lit(1)).cast("double").alias("qty"))


def raw_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Unit quantities per card part number as written."""
    return card_lines(spark, sf).groupBy(F.col("raw").alias("part")).agg(
        F.sum("qty").alias("qty"),
        F.min_by("raw", "ord").alias("original"),
        F.coalesce(F.max_by("name_ru", F.when(F.col("name_ru") != "", F.col("ord"))), F.lit("")).alias("name_ru"),
    )


def raw_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names per part number as written."""
    lines = bom_lines(spark, sf)
    return lines.groupBy(F.col("raw").alias("part")).agg(
        *[
            F.coalesce(F.min_by(X.clean_cell(n), F.when(X.clean_cell(n) != "", F.col("ord"))), F.lit("")).alias(n)
            for n in ("name_cn", "name_en")
        ]
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of every document."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", F.explode(F.split("line", " ")).alias("v"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Cell texts of every kind: words, lines, addresses, decimal numbers, part numbers, names."""
    return words(spark, sf).select("v").unionByName(other_texts(spark, sf))


def other_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Cell texts that are not single words."""
    doc = table(spark, sf, "documents")
    part = table(spark, sf, "part")
    frames = [
        doc.select(F.explode(F.split("text", "\n")).alias("v")),
        doc.select(F.col("text").alias("v")),
        table(spark, sf, "pages").select(F.col("url").alias("v")),
        table(spark, sf, "events").select(F.translate(F.col("value").cast("string"), ".", ",").alias("v")),
        part.select(F.concat(F.lit("　 p-"), F.col("p_partkey").cast("string"), F.lit(".A_x000D_"), "p_name").alias("v")),
        part.select(F.concat("p_name", F.lit("零件 "), F.col("p_size").cast("string")).alias("v")),
        part.select(F.concat(F.col("p_size").cast("string"), F.lit("шт")).alias("v")),
        part.select(F.concat(F.lit("– "), F.when(F.col("p_size") > 25, "–").otherwise(F.col("p_size").cast("string"))).alias("v")),
        part.select(F.when(F.col("p_type") == "SMALL", "S").when(F.col("p_type") == "LARGE", "—").otherwise("Y").alias("v")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def counted_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of :func:`texts` with a number ``n`` of occurrences: a word is there once, however often it occurs.

    Words are short and come again, so an expression is worked out once for each; longer texts are seldom
    equal and are not moved.
    """
    counted = words(spark, sf).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(other_texts(spark, sf).withColumn("n", F.lit(1).cast("long")))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Archive members named after parts, in six naming habits, and page addresses."""
    key = F.lpad(F.col("p_partkey").cast("string"), 5, "0")
    path = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("line/"), F.lit("SSQRT1L-17-AS-"), key, F.lit(" "), "p_name", F.lit(".xlsx")))
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("A"), key, F.lit("-"), "p_name", F.lit(".xls")))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("shop/"), key, F.lit("-作业指导书 "), "p_name", F.lit(".XLSX")))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("cover "), "p_name", F.lit(".xlsx")))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("__MACOSX/._"), "p_name", F.lit(".xlsx")))
        .otherwise(F.concat("p_brand", F.lit("/.hidden "), key, F.lit(".docx")))
    )
    listed = table(spark, sf, "part").select(path.alias("path"), F.col("p_partkey").alias("ord"))
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), (-F.col("page_id") - 1).alias("ord"))
    return listed.unionByName(pages)


def card_events(spark: SparkSession, sf: str) -> DataFrame:
    """Status changes of cards: job = user, card = property value."""
    return as_card_events(table(spark, sf, "events"))


def as_card_events(events: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type").isin("purchase", "signup"), "success")
        .otherwise("pending")
    )
    return events.select(
        F.col("user_id").alias("job_id"),
        F.floor(F.get_json_object("props", "$.k").cast("int") / 10).alias("card"),
        status.alias("status"),
        "ts",
        "event_id",
    )


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs from orders: status, stage flags and chosen configurations."""
    status = (
        F.when(F.col("o_orderstatus") == "F", "done")
        .when(F.col("o_orderstatus") == "O", "processing")
        .when(F.col("o_orderpriority") == "1-URGENT", "error")
        .otherwise("awaiting_upload")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_totalprice") > 100000).alias("bom_uploaded"),
        (F.col("o_orderpriority") != "5-LOW").alias("archive_uploaded"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit('["'), "o_orderstatus", F.lit('","R"]')))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit(""))
        .otherwise(F.col("o_orderstatus"))
        .alias("selected_config"),
    )


def package_files(spark: SparkSession, sf: str) -> DataFrame:
    """Workbook packages from pages."""
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("file_id"), (F.length("html").cast("long") * F.when(F.col("url").startswith("https"), 20000).otherwise(1)).alias("size")
    )


def package_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Package members from pages: required parts where the address says so, media per link."""
    pages = table(spark, sf, "pages")
    url = F.col("url")
    none = F.lit(None).cast("string")
    required = pages.select(
        F.col("page_id").alias("file_id"),
        "html",
        F.explode(
            F.array(
                F.lit("[Content_Types].xml"),
                F.lit("xl/workbook.xml"),
                F.when(url.contains("/en/"), F.lit("xl/_rels/workbook.xml.rels")).otherwise(none),
                F.when(~url.contains("utm_source"), F.lit("_rels/.rels")).otherwise(none),
                F.when(~url.contains("#top"), F.lit("xl/worksheets/sheet1.xml")).otherwise(none),
            )
        ).alias("name"),
    ).filter("name IS NOT NULL")
    paragraphs = F.size(F.split("html", "<p>")) - 1
    members = required.select(
        "file_id",
        "name",
        F.length("html").alias("size"),
        F.lit(True).alias("crc_ok"),
        F.when(F.col("name").contains("sheet"), F.when(paragraphs > 5, paragraphs).otherwise(0)).alias("row_count"),
        (paragraphs != 4).alias("has_data"),
    )
    media = pages.select(
        F.col("page_id").alias("file_id"),
        F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h"),
    ).distinct()
    return members.unionByName(
        media.select(
            "file_id",
            F.concat(F.lit("xl/media"), F.col("h")).alias("name"),
            (F.length("h") - 4).alias("size"),
            (F.length("h") != 9).alias("crc_ok"),
            F.lit(None).cast("int").alias("row_count"),
            F.lit(True).alias("has_data"),
        ).withColumn("size", F.greatest("size", F.lit(0)))
    )


def package_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Drawing references: every link of a page, those of long text to a missing copy."""
    return (
        table(spark, sf, "pages")
        .select(
            F.col("page_id").alias("file_id"),
            F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h"),
        )
        .select(
            "file_id",
            F.lit("xl/drawings/_rels/drawing1.xml.rels").alias("rel_name"),
            F.when(F.length("h") > 8, F.concat(F.lit("/xl/media/copy"), "h"))
            .otherwise(F.concat(F.lit("xl/media"), "h"))
            .alias("target"),
        )
        .distinct()
    )
