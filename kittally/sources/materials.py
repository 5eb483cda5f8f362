"""Card materials and report tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import finished

MANIFEST = "source string, name string, run string"
MATERIAL_SCHEMA = (
    "card_no string, sheet_name string, row_index int, part_no string, name_cn string, name_ru string, "
    "qty double, _corrupt string"
)


def read_materials(spark: SparkSession, path: str, arrays: bool = True) -> DataFrame:
    """Part lines of all material files below ``path``.

    ``arrays`` reads one array of records per file; otherwise one record per line, as written by
    :func:`write_materials`. Error files, unreadable records and empty files give no lines. ``ord``
    is the order in which first and last are meant: files by path, records as they stand.
    """
    # a file of one array is read by one task, in record order
    order = F.struct("path", F.monotonically_increasing_id()) if arrays else F.struct("card_no", "sheet_name", "row_index")
    rows = (
        spark.read.schema(MATERIAL_SCHEMA)
        .option("multiLine", arrays)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("path"))
    )
    return (
        rows.filter(~F.endswith("path", F.lit("_error.json")) & F.col("_corrupt").isNull() & F.col("part_no").isNotNull())
        .withColumn("ord", order)
        .drop("_corrupt")
    )


def materials(lines: DataFrame) -> DataFrame:
    """Part lines in the shape of material records."""
    return lines.select(
        "card_no",
        F.col("sheet").alias("sheet_name"),
        F.col("row").alias("row_index"),
        F.col("raw").alias("part_no"),
        "name_cn",
        "name_ru",
        "qty",
    )


def write_materials(records: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """Material records as JSON lines, sorted by card within files of bounded size."""
    (
        records.repartitionByRange("card_no", "sheet_name", "row_index")
        .sortWithinPartitions("card_no", "sheet_name", "row_index")
        .write.option("maxRecordsPerFile", per_file)
        .mode("overwrite")
        .json(path)
    )


def write_errors(errors: DataFrame, path: str) -> None:
    """Error records (card_path, error), added to what is there."""
    errors.select("card_path", "error").write.mode("append").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Produced names in the order of source and name."""
    (
        manifest.repartitionByRange("source", "name")
        .sortWithinPartitions("source", "name")
        .write.mode("overwrite")
        .parquet(path)
    )


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Report tables, one folder each."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", "true")
        writer.format(fmt).save(f"{path}/{name}")


def merge_manifest(produced: DataFrame, path: str, run: str) -> int:
    """Merge the names of one run into the manifest stored under ``path`` (S8); gives the new version.

    A version is a folder that holds all runs and counts once it is finished, so readers see the manifest before or
    after a run. A run given again takes the place of its earlier names: nothing is listed twice.
    """
    spark = produced.sparkSession
    last = _last_version(spark, path)
    rows = produced.select(X.basename("source").alias("source"), "name", F.lit(run).alias("run")).distinct()
    if last is not None:
        rows = rows.unionByName(spark.read.schema(MANIFEST).parquet(f"{path}/version={last}").filter(F.col("run") != run))
    version = 0 if last is None else last + 1
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(source, names) of a version of the manifest, the last one by default; names sorted, each once."""
    version = _last_version(spark, path) if version is None else version
    if version is None:
        return spark.createDataFrame([], "source string, names array<string>")
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/version={version}")
    return rows.groupBy("source").agg(F.array_sort(F.collect_set("name")).alias("names"))


def _last_version(spark: SparkSession, path: str) -> int | None:
    return max(finished(spark, path, "version"), default=None)
