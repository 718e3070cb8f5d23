"""Whole reports as VARIANT: nested results of any shape in one column, stored as they come and read by paths.

A report is a row (report_id, client, body). Parts that a report lacks, and paths that lead
nowhere, are null; a body that is no JSON is refused as an error row by `parsed`. Spark keeps
the binary form in Parquet, so that a path is read without parsing text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bodies(rows: DataFrame, by: list[str], parts: dict[str, Column]) -> DataFrame:
    """(by, body): one report for each `by`, its parts the aggregates of `parts`, nested as they are."""
    return rows.groupBy(*by).agg(F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])).alias("body"))


def parsed(texts: DataFrame) -> DataFrame:
    """`texts` with `report`, the body as VARIANT, and `error` where it is no JSON."""
    report = F.try_parse_json("body")
    return texts.withColumns({"report": report, "error": F.when(F.col("body").isNotNull() & report.isNull(), F.lit("no JSON"))}).drop("body")


def save(reports: DataFrame, path: str) -> None:
    """Reports without an error, under `path`."""
    reports.where("error is null").drop("error").write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def at(path: str, kind: str = "string") -> Column:
    """The value of a path such as $.totals.balance or $.segments[0].name; null where it leads nowhere or isn't of that kind."""
    return F.try_variant_get(F.col("report"), path, kind)


def outline(reports: DataFrame) -> DataFrame:
    """(n_reports, shape): the schema that all reports together have."""
    return reports.agg(F.count(F.lit(1)).alias("n_reports"), F.schema_of_variant_agg("report").alias("shape"))
