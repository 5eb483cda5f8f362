"""Update rows of a stream kept as a keyed snapshot and a short log.

Every trigger writes its changed rows under its number. After ``every`` triggers they are merged into a
snapshot that has one row per key, cut into buckets of keys; only buckets with changes are written anew, under the
number of the trigger that merged them. A commit, written last, says which number each bucket is read at and
up to which trigger the log is merged. So what is kept grows with the keys, not with the triggers.

A trigger that runs again after a crash overwrites its own rows, its own buckets and its own commit. It
finds what it read before, as only what the commit before the last no longer needs is removed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import file_system, finished, remove


@dataclass
class Snapshot:
    """Where a stream's rows are kept. ``keys`` identify a row; the row of the latest trigger is the current one."""

    path: str
    keys: list[str]
    schema: StructType
    buckets: int = 16
    every: int = 10

    def sink(self, batch: DataFrame, epoch: int) -> None:
        """For ``foreachBatch`` in update mode."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch.select(*self.schema.names, bucket.alias("bucket")).write.mode("overwrite").parquet(f"{self.path}/log/epoch={epoch}")
        if (epoch + 1) % self.every == 0:
            self.compact(batch.sparkSession, epoch)

    def commits(self, spark: SparkSession, below: int | None = None) -> list[int]:
        return [n for n in finished(spark, f"{self.path}/commits", "commit") if below is None or n < below]

    def _versions(self, spark: SparkSession, commit: int | None) -> dict[int, int]:
        """Bucket to the number it is read at; at most ``buckets`` rows."""
        if commit is None:
            return {}
        rows = spark.read.schema("bucket int, version long").parquet(f"{self.path}/commits/commit={commit}").collect()
        return {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields, StructField("bucket", IntegerType())])

    def _log(self, spark: SparkSession, after: int, upto: int | None = None) -> list[DataFrame]:
        numbers = [n for n in finished(spark, f"{self.path}/log", "epoch") if n > after and (upto is None or n <= upto)]
        return [spark.read.schema(self._stored()).parquet(f"{self.path}/log/epoch={n}").withColumn("epoch", F.lit(n).cast("long")) for n in numbers]

    def _merged(self, spark: SparkSession, versions: dict[int, int], log: list[DataFrame]) -> DataFrame:
        """Current row per key from some buckets and some triggers."""
        folders = [spark.read.schema(self.schema).parquet(f"{self.path}/rows/version={v}/bucket={b}").withColumn("bucket", F.lit(b)).withColumn("epoch", F.lit(-1).cast("long")) for b, v in versions.items()]
        empty = spark.createDataFrame([], StructType([*self._stored().fields, StructField("epoch", LongType())]))
        rows = reduce(DataFrame.unionByName, [*folders, *log], empty)
        rest = [c for c in self.schema.names if c not in self.keys]
        last = rows.groupBy("bucket", *self.keys).agg(F.max_by(F.struct(F.lit(1).alias("_one"), *rest), "epoch").alias("_last"))
        return last.select(*[F.col(f"_last.{c}").alias(c) if c in rest else c for c in self.schema.names], "bucket")

    def compact(self, spark: SparkSession, epoch: int) -> None:
        """Merge the log up to a trigger into the snapshot."""
        earlier = self.commits(spark, below=epoch)
        last = earlier[-1] if earlier else None
        versions = self._versions(spark, last)
        log = self._log(spark, -1 if last is None else last, epoch)
        touched = {r["bucket"] for df in log for r in df.select("bucket").distinct().collect()}
        merged = self._merged(spark, {b: v for b, v in versions.items() if b in touched}, log)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={epoch}")
        now = versions | {b: epoch for b in touched}
        commit = spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1)
        commit.write.mode("overwrite").parquet(f"{self.path}/commits/commit={epoch}")
        if last is not None:
            self._clean(spark, last, {*versions.items(), *now.items()})

    def _clean(self, spark: SparkSession, last: int, needed: set[tuple[int, int]]) -> None:
        """Remove triggers merged by the commit before this one, and buckets that neither of the two reads."""
        for n in finished(spark, f"{self.path}/log", "epoch"):
            if n <= last:
                remove(spark, f"{self.path}/log/epoch={n}")
        for version in finished(spark, f"{self.path}/rows", "version"):
            fs, folder = file_system(spark, f"{self.path}/rows/version={version}")
            held = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder) if s.isDirectory()]
            unused = [b for b in held if (b, version) not in needed and version <= last]
            for b in unused:
                remove(spark, f"{self.path}/rows/version={version}/bucket={b}")
            if len(unused) == len(held) and version <= last:
                remove(spark, f"{self.path}/rows/version={version}")
        for n in self.commits(spark, below=last):
            remove(spark, f"{self.path}/commits/commit={n}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The current row of every key."""
        commits = self.commits(spark)
        last = commits[-1] if commits else None
        log = self._log(spark, -1 if last is None else last)
        return self._merged(spark, self._versions(spark, last), log).drop("bucket")

    def size(self, spark: SparkSession) -> int:
        """Rows kept on disk, merged or not."""
        stored = [spark.read.schema("bucket int").parquet(f"{self.path}/{kind}={n}") for folder, kind in (("log", "log/epoch"), ("rows", "rows/version")) for n in finished(spark, f"{self.path}/{folder}", kind.split("/")[1])]
        return sum(df.count() for df in stored)
