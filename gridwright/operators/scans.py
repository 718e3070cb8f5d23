"""Scans along an order that many tasks share: what stood above, running sums, places.

A group (a column, a sheet, a journal) may be a third of all rows, so rows are dealt in ranges of
the order and written once. A range is scanned by itself; one row for each group and range says
what it leaves to those behind it, and a window over these few rows gives each range what comes
in. So no task holds a group, and the rows of a range that is lost are read again.

Ties of the order are for the caller to break: rows that are equal in `by` and `order` may swap.
Null orders come first. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.sources.scratch import written

PART = "__part"


def ranged(df: DataFrame, by: list[str], order: list[str], what: str = "ranges") -> DataFrame:
    """`df` in ranges of `by` and `order`, with the number of the range; written once, so that ranges are those of one run."""
    return written(df.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id()), what)


def _inside(by: list[str], order: list[str]):
    return W.partitionBy(*by, PART).orderBy(*order)


def _above(by: list[str]):
    return W.partitionBy(*by).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)


def _with_before(rows: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what comes into their range. Group keys may be null."""
    return rows.join(ends.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(PART).alias("__of"), "__before"), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col(PART) == F.col("__of")], "left").drop("__of", *[f"__{c}" for c in by])


def carried(parts: DataFrame, by: list[str], order: list[str], value: Column, name: str, above: bool = False) -> DataFrame:
    """`parts` (of `ranged`) with `name`: the last `value` that isn't null, of this row or of those above it, or only of these (`above`)."""
    last = F.struct(*order)
    marked = parts.withColumn("__value", value)
    ends = marked.groupBy(*by, PART).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), last)).alias("__end"))
    before = ends.withColumn("__before", F.last("__end", ignorenulls=True).over(_above(by)))
    own = F.last("__value", ignorenulls=True).over(_inside(by, order).rowsBetween(W.unboundedPreceding, -1 if above else W.currentRow))
    return _with_before(marked.withColumn("__own", own), before, by).withColumn(name, F.coalesce("__own", "__before")).drop("__own", "__before", "__value")


def running(parts: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`parts` with `name`: the sum of `value` over all rows above, without this row's."""
    marked = parts.withColumn("__value", value)
    sums = marked.groupBy(*by, PART).agg(F.sum("__value").alias("__sum"))
    before = sums.withColumn("__before", F.sum("__sum").over(_above(by)))
    own = F.sum("__value").over(_inside(by, order).rowsBetween(W.unboundedPreceding, -1))
    zero = F.lit(0)
    return _with_before(marked.withColumn("__own", own), before, by).withColumn(name, F.coalesce("__own", zero) + F.coalesce("__before", zero)).drop("__own", "__before", "__value")


def placed(parts: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """`parts` with `name`: the place of each row in its group, from 0."""
    return running(parts, by, order, F.lit(1).cast("long"), name)


def previous(parts: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`parts` with `name`: `value` of the row above, null for a group's first."""
    marked = parts.withColumn("__value", F.struct(value.alias("v")))
    ends = marked.groupBy(*by, PART).agg(F.max_by("__value", F.struct(*order)).alias("__end"))
    before = ends.withColumn("__before", F.last("__end").over(_above(by)))
    own = F.lag("__value").over(_inside(by, order))
    return _with_before(marked.withColumn("__own", own), before, by).withColumn(name, F.coalesce("__own", "__before")["v"]).drop("__own", "__before", "__value")
