"""Headers of several rows: which rows belong to one, and the names that their layers give together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions import vocabulary as V


def header_blocks(kinds: DataFrame, heads: DataFrame) -> DataFrame:
    """(region, header_row, last_row): a header grows over the next two rows at most.

    A row joins where the one above has blanks, and it is text alone and half as full as the
    fullest, or most of its cells stand under columns that are blank so far. A row of data must
    be left. `kinds`: region, row, col, kind. `heads`: region, header_row.
    """
    placed = kinds.join(heads, "region").withColumn("k", F.col("row") - F.col("header_row"))
    box = placed.groupBy("region").agg(F.min("header_row").alias("header_row"), F.max("row").alias("r1"), (F.max("col") - F.min("col") + 1).alias("width"))
    widest = placed.where(F.col("row") < V.HEADER_SCAN).groupBy("region", "row").agg(F.count(F.lit(1)).alias("n")).groupBy("region").agg(F.max("n").alias("widest"))
    near = placed.where("k between 0 and 2")
    counted = [F.count_if((F.col("k") == k) & cond).alias(f"{name}{k}") for k in range(3) for name, cond in (("n", F.lit(True)), ("text", F.col("kind") == "text"), ("number", F.col("kind") == "number"))]
    rows = near.groupBy("region").agg(*counted)
    by_col = near.groupBy("region", "col").agg(*[F.max(F.col("k") == k).alias(f"h{k}") for k in range(3)])
    gaps = by_col.groupBy("region").agg(F.count_if(F.col("h1") & ~F.col("h0")).alias("gap1"), F.count_if(F.col("h2") & ~F.col("h0") & ~F.col("h1")).alias("gap2"))
    facts = box.join(widest, "region").join(rows, "region").join(gaps, "region")

    def joins(k: int):
        n, text, number = (F.col(f"{c}{k}") for c in ("n", "text", "number"))
        like = (n > 0) & (n * 2 >= F.col("widest")) & (text * 2 >= n) & (number == 0)
        fills = (n >= 2) & (text * 2 >= n) & (F.col(f"gap{k}") >= 0.6 * n)
        return (F.col(f"n{k - 1}") < F.col("width")) & (like | fills)

    span = F.when(~joins(1), 0).when(~joins(2), 1).otherwise(2)
    last = F.col("header_row") + span
    return facts.select("region", "header_row", F.when(last >= F.col("r1"), F.col("header_row")).otherwise(last).alias("last_row"))


def header_names(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """(region, col, name): layers joined by /, group labels spread to the right, banners left out, names made unique."""
    # a region's columns by its header rows, a few; `rows` names them where they aren't one after another
    rows = F.col("rows") if "rows" in blocks.columns else F.sequence("header_row", "last_row")
    layers = blocks.select("region", "last_row", F.explode(rows).alias("row"))
    heads = cells.join(layers.select("region", "row"), ["region", "row"])
    columns = cells.join(blocks.select("region", "header_row"), "region").where(F.col("row") >= F.col("header_row")).select("region", "col").distinct()
    grid = columns.join(layers, "region").join(heads.select("region", "row", "col", F.trim("raw").alias("own")), ["region", "row", "col"], "left")
    right = W.partitionBy("region", "row").orderBy("col").rowsBetween(W.unboundedPreceding, W.currentRow)
    spread = grid.withColumn("label", F.when(F.col("row") < F.col("last_row"), F.last("own", ignorenulls=True).over(right)).otherwise(F.col("own")))
    share = F.count("label").over(W.partitionBy("region", "row", "label")) / F.count(F.lit(1)).over(W.partitionBy("region", "row"))
    kept = spread.withColumn("share", share).withColumn("label", F.when((F.col("row") < F.col("last_row")) & (F.col("share") > V.BANNER_SHARE), None).otherwise(F.col("label")))
    merged = kept.groupBy("region", "col").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("row", "label")))), lambda x: x["label"])), " / ").alias("base"))
    base = merged.withColumn("base", F.when(F.col("base") == "", F.concat(F.lit("col_"), F.col("col") + 1)).otherwise(F.col("base")))
    k = F.row_number().over(W.partitionBy("region", "base").orderBy("col"))
    return base.withColumn("k", k).select("region", "col", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws(".", "base", F.col("k") - 1)).alias("name"))
