"""A small table kept as whole versions: what the registry's cache and the rolling store of conversations are read from and saved to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """Versions are folders of Parquet; a version counts once its line in the manifest is written, last of all, as one file. A reader sees one version whole, and a writer that
    fails halfway leaves the one before in force. Writing a version again replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        try:
            found = self.spark.read.schema("version long").option("recursiveFileLookup", "true").json(f"{self.path}/manifest").select("version").distinct().collect()
        except AnalysisException as error:  # nothing was ever published
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r["version"] for r in found)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest below a number; None if there is none."""
        known = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/versions/{known[-1]}") if known else None

    def publish(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/versions/{version}")
        self.spark.range(version, version + 1).withColumnRenamed("id", "version").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{version}")


def merged_indexes(first: DataFrame, second: DataFrame, key: str, at: str) -> DataFrame:
    """The union of two indexes of entries; of equal keys the one with the newest `at`, entries without a key (known by name only) all once."""
    rows = first.unionByName(second)
    columns = F.struct(*rows.columns)
    keyed = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(columns, F.struct(F.col(at), F.xxhash64(columns))).alias("__row")).select("__row.*")
    return keyed.unionByName(rows.filter(F.col(key).isNull()).distinct())


def rolling_store_sink(path: str, archive_path: str, key: str, order: str, most: int = 300):
    """S15, K2 for foreachBatch: the newest `most` rows as the store's next version, every row also in the archive. Rows that the store was loaded with, and batches that are run
    again, are in the archive once. `order` breaks no ties: equal ones follow the key."""
    from .streaming.pipelines import archive_sink

    keep = archive_sink(archive_path, key, order)

    def write(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, path)
        held = table.read(before=number + 1)
        every = batch if held is None else held.unionByName(batch)
        keep(every.dropDuplicates([key]), number)
        newest = every.dropDuplicates([key]).orderBy(F.desc(order), F.desc(key)).limit(most)
        table.publish(newest, number + 1)

    return write
