"""Sheets as cells (sheet, row, col, raw): tables as sheets, shapes, inventories and traces. `orient` finds tables on sheets.

Cells that are blank don't exist. Rows and columns keep their place in the sheet throughout, so
any value can be traced to where it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions import vocabulary as V
from gridwright.functions.cells import is_blank, typed
from gridwright.operators import scans
from gridwright.sources.scratch import written


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """`df` with `rec`, from 0, in order: ranges are numbered by themselves and start where those before them end.

    The ranges are written once, so that their sizes and their rows are those of one run.
    """
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("__id", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    # a row for each partition
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return ranged.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("rec", F.col("start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))).drop("__id", "__part", "start")


def encode(df: DataFrame, sheet: str, order: list[str], top: int = 0, left: int = 0) -> DataFrame:
    """A table as the cells of a sheet, its header in row `top`."""
    columns = df.columns
    header = df.sparkSession.createDataFrame([(sheet, top, left + i, c) for i, c in enumerate(columns)], "sheet string, row long, col int, raw string")
    values = F.explode(F.array(*[F.struct(F.lit(left + i).alias("col"), F.col(c).cast("string").alias("raw")) for i, c in enumerate(columns)]))
    body = numbered(df, *order).select((F.col("rec") + top + 1).alias("row"), values.alias("x")).select(F.lit(sheet).alias("sheet"), "row", "x.col", "x.raw")
    return header.unionByName(body).where(~is_blank(F.col("raw")))


def with_kinds(cells: DataFrame) -> DataFrame:
    return typed(cells).where("kind <> 'blank'").drop("num")


def bounding_boxes(cells: DataFrame) -> DataFrame:
    box = [F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count(F.lit(1)).alias("n_cells")]
    return cells.groupBy("sheet").agg(*box)


def header_rows(kinds: DataFrame, scan: int = V.HEADER_SCAN) -> DataFrame:
    """(sheet, header_row): the first row, of those scanned, at least half as full as the fullest and half text."""
    rows = kinds.where(F.col("row") < scan).groupBy("sheet", "row").agg(F.count(F.lit(1)).alias("filled"), F.count_if(F.col("kind") == "text").alias("texts"))
    widest = F.max("filled").over(W.partitionBy("sheet"))
    fits = rows.withColumn("widest", widest).where((F.col("filled") * 2 >= F.col("widest")) & (F.col("texts") * 2 >= F.col("filled")))
    return fits.groupBy("sheet").agg(F.min("row").alias("header_row"))


def inventory(cells: DataFrame) -> DataFrame:
    """Shape, fill and header row of each sheet."""
    kinds = with_kinds(cells)
    shape = kinds.groupBy("sheet").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.count_distinct("row").alias("filled_rows"), F.count_distinct("col").alias("filled_cols"), F.count(F.lit(1)).alias("n_cells"))
    return shape.withColumn("fill", F.round(F.col("n_cells") / (F.col("n_rows") * F.col("n_cols")), 4)).join(header_rows(kinds), "sheet", "left")


def islands(cells: DataFrame, along: str = "col", least: int = 2) -> DataFrame:
    """(sheet, island, first, last): runs of columns (or rows) that aren't blank, as wide as `least`. Columns, rows and islands are placed by ranges, so that a sheet of any length is no one task's."""
    places = cells.select("sheet", F.col(along).cast("long").alias("p")).distinct()
    grouped = scans.placed(scans.ranged(places, ["sheet"], ["p"], "places"), ["sheet"], ["p"], "k")
    runs = grouped.groupBy("sheet", (F.col("p") - F.col("k")).alias("g")).agg(F.min("p").alias("first"), F.max("p").alias("last")).where(F.col("last") - F.col("first") + 1 >= least)
    found = scans.placed(scans.ranged(runs.drop("g"), ["sheet"], ["first"], "islands"), ["sheet"], ["first"], "k")
    return found.select("sheet", (F.col("k") + 1).alias("island"), "first", "last")


def filled_down(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """`value` as the last that stood above it, and whether it is a ghost: not there itself. A column of any length is filled by ranges."""
    filled = scans.carried(scans.ranged(df, [by], [order], "filled-down"), [by], [order], F.col(value), "filled").drop(scans.PART)
    return filled.withColumn("is_ghost", F.col(value).isNull() & F.col("filled").isNotNull())


def trace(cells: DataFrame, refs: DataFrame) -> DataFrame:
    """The cells of references (sheet, ref); a reference that is none, or a blank one, has null."""
    from gridwright.functions.cells import clip, parse_a1

    asked = refs.withColumn("p", parse_a1(F.col("ref"))).select("sheet", "ref", F.col("p.row").cast("long").alias("row"), F.col("p.col").alias("col"))
    return asked.join(cells, ["sheet", "row", "col"], "left").select("sheet", "ref", clip(F.col("raw")).alias("raw"))


def excerpt(cells: DataFrame, row: int, col: int) -> DataFrame:
    """The neighbourhood of a cell: two rows and one column around it, and the first column; so never more than five rows of four cells."""
    near: Column = F.col("row").between(row - 2, row + 2) & (F.col("col").between(col - 1, col + 1) | (F.col("col") == 0))
    return cells.where(near)
