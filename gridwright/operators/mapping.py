"""Roles pinned to series by an analyst, and what a report says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve(mapping: DataFrame, available: DataFrame) -> DataFrame:
    """(role, label, sheet, error): the one series of each pinned role.

    `mapping`: role, label, sheet (may be null). `available`: sheet, label, periods. The label
    must be the same; a sheet decides among several, and where it has none, the label alone
    does if it stands once. All resolved roles must have the same periods.
    """
    named = available.select(F.col("sheet").alias("found"), "label", "periods")
    joined = mapping.join(named, "label", "left").withColumn("exact", F.col("sheet").isNull() | (F.col("sheet") == F.col("found")))
    per = W.partitionBy("role")
    counted = joined.withColumns({"n_exact": F.count_if(F.col("exact") & F.col("found").isNotNull()).over(per), "n_any": F.count("found").over(per)})
    chosen = counted.where((F.col("n_exact") == 0) | F.col("exact"))
    n = F.when(F.col("n_exact") > 0, F.col("n_exact")).otherwise(F.when(F.col("n_any") == 1, 1).otherwise(0))
    one = chosen.withColumn("n", n).groupBy("role").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.min("found").alias("sheet"), F.min("periods").alias("periods"))
    axes = F.size(F.collect_set(F.when(F.col("n") == 1, F.col("periods"))).over(W.partitionBy(F.lit(0).alias("all"))))
    error = F.when(F.col("n") == 0, "no series").when(F.col("n") > 1, "ambiguous").when(axes > 1, "different periods")
    return one.select("role", "label", F.when(F.col("n") == 1, F.col("sheet")).alias("sheet"), error.alias("error"))


def unit_cost_budget(months: DataFrame, budget: DataFrame) -> DataFrame:
    """(year, unit_cost, target, variance_pct): cost per unit of the months that have both, against the year's budget.

    `months`: year, opex, volume. `budget`: year, opex, volume.
    """
    both = months.where("opex is not null and volume is not null").groupBy("year").agg((F.sum("opex") / F.sum("volume")).alias("unit_cost"))
    target = budget.where("volume <> 0").select("year", (F.col("opex") / F.col("volume")).alias("target"))
    joined = both.join(target, "year")
    return joined.select("year", F.round("unit_cost", 4).alias("unit_cost"), F.round("target", 4).alias("target"), F.round(100 * F.try_divide(F.col("unit_cost") - F.col("target"), F.col("target")), 4).alias("variance_pct"))


def supplement(spine: DataFrame, others: DataFrame, least: int = 3) -> DataFrame:
    """(role, sheet, n): for each role that the spine lacks, the first sheet whose series has values on `least` of its periods.

    `spine`: role, period. `others`: sheet_ord, sheet, role, period, value.
    """
    axis = spine.select("period").distinct()
    missing = others.join(spine.select("role").distinct(), "role", "left_anti")
    overlap = missing.where("value is not null").join(axis, "period").groupBy("role", "sheet_ord", "sheet").agg(F.count_distinct("period").alias("n")).where(F.col("n") >= least)
    first = F.row_number().over(W.partitionBy("role").orderBy("sheet_ord"))
    return overlap.withColumn("k", first).where("k = 1").select("role", "sheet", "n")


def inherited(mappings: DataFrame) -> DataFrame:
    """The newest mapping that holds, of (mapping_id, saved_at, ok)."""
    return mappings.where("ok").agg(F.max_by("mapping_id", F.struct("saved_at", "mapping_id")).alias("mapping_id"))
