"""Profiles that grow with arriving files.

Each micro-batch of files becomes one version of a store: the files that it brought, and the parts
that their columns add to the profile. So a batch counts whole or not at all, and one that the
stream hands over again after a failure is known by its number and counts once.

A file whose content has been seen, in this batch or before, is a copy and adds nothing; one that
is older than the newest seen before is late, which is noted, and counts. A file that can't be
read is noted with its error. Only a row for each file and column is kept, never cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.operators import profile
from gridwright.sources.scratch import written
from gridwright.sources.store import Store
from gridwright.sources.workbook import cells_of
from gridwright.streaming.events import FILE

FILES, PARTS, BATCHES = "files", "parts", "batches"


def named_cells(cells: DataFrame) -> DataFrame:
    """(name, raw) of sheets whose first row names their columns; cells that are blank aren't there."""
    body = cells.where("error is null")
    heads = body.where("row = 0").select("path", "sheet", "col", F.trim("raw").alias("name"))
    return body.where("row > 0").join(heads, ["path", "sheet", "col"]).select("name", "raw")


class GrowingProfile:
    """The profile of all files that have come to a stream, kept in a store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def _held(self, table: str, columns: str) -> DataFrame:
        try:
            return self.store.history(table)
        except KeyError:
            return self.spark.createDataFrame([], columns)

    def absorb(self, files: DataFrame, batch: int) -> None:
        """Count a batch of files (path, modificationTime, content)."""
        if self._held(BATCHES, "batch long").where(F.col("batch") == batch).head(1):
            return
        seen = self._held(FILES, "path string, sha256 string, modified timestamp, is_copy boolean, is_late boolean, error string, batch long")
        newest = seen.agg(F.max("modified").alias("newest")).first()["newest"]
        known = seen.where("not is_copy").select("sha256").distinct().withColumn("old", F.lit(True))
        told = files.select("path", F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))
        first = told.groupBy("sha256").agg(F.min("path").alias("first"))
        marked = told.join(first, "sha256").join(known, "sha256", "left").withColumns({
            "is_copy": F.coalesce("old", F.lit(False)) | (F.col("path") != F.col("first")),
            "is_late": F.coalesce(F.col("modified") < F.lit(newest), F.lit(False)),
        })
        arrived = written(marked.select("path", "sha256", "modified", "is_copy", "is_late"), "arrived-files")
        cells = written(cells_of(files.join(arrived.where("not is_copy").select("path"), "path", "left_semi")), "arrived-cells")
        errors = cells.where("error is not null").select("path", "error")
        self.store.write({
            FILES: arrived.join(errors, "path", "left").withColumn("batch", F.lit(batch).cast("long")),
            PARTS: profile.profile_parts(named_cells(cells)),
            BATCHES: self.spark.createDataFrame([(batch,)], "batch long"),
        })

    def run(self, path: str, checkpoint: str) -> None:
        """Take in all files under `path` that have come since the last run."""
        files = self.spark.readStream.schema(FILE).format("binaryFile").load(path)
        query = files.writeStream.foreachBatch(lambda df, batch: self.absorb(df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    def current(self) -> DataFrame:
        """The profile of all columns so far, as `profile.column_profile` gives it for all cells at once."""
        return profile.profile_of(profile.merged_parts(self.store.history(PARTS).drop("_deleted", "_version")))

    def files(self) -> DataFrame:
        return self.store.history(FILES).drop("_deleted", "_version")
