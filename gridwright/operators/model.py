"""A business model from series: which sheet leads, what the others add, and what follows by arithmetic.

Series are (chart, ord, sheet, grain, label, period, value): a chart is one table with an axis of
periods, `ord` its place in its book. Where there is a `book`, each has a model of its own, and
nothing of one fills in for another. Series become a row each, with their points, so that after
one aggregation all is decided over the few rows of a book, which are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions import vocabulary as V
from gridwright.functions.cells import FOLD
from gridwright.operators import series as S
from gridwright.operators.orient import cross_tab_facts

ROLES = [name for name, _ in V.ROLES] + ["volume_secondary"]


def book_of(*frames: DataFrame) -> list[str]:
    """The column that names the book, where all frames have it."""
    return ["book"] if all("book" in f.columns for f in frames) else []


def series_of(cells: DataFrame, regions: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """The series of all cross-tabs, from `orient`'s regions and cells: the address space that roles are pinned in.

    `books`: sheet, book. Without it all sheets are of one book.
    """
    tabs = regions.where("orientation = 'matrix'").select("region", "sheet", "axis", "r0", "c0")
    tabs = tabs.join(books, "sheet") if books is not None else tabs
    own = book_of(tabs)
    charts = tabs.withColumn("ord", F.dense_rank().over(W.partitionBy(*own).orderBy("sheet", "r0", "c0")))
    facts = cross_tab_facts(cells, regions)
    grain = F.when(F.col("axis") == "year", "year").otherwise("month")
    return facts.join(charts, "region").select(*own, F.col("region").alias("chart"), "ord", "sheet", grain.alias("grain"), "label", "period", "value")


def pool(sheet: Column) -> Column:
    """plan or actual: a plan's numbers are compared to what happened, never merged into it."""
    return F.when(sheet.rlike(FOLD + V.PLAN_SHEET), "plan").otherwise("actual")


def lines(series: DataFrame) -> DataFrame:
    """A row for each series, by book (`b`, '' where there is none), with its points in order and its role in its chart, null where it has none."""
    b = F.col("book") if book_of(series) else F.lit("")
    points = F.array_sort(F.collect_list(F.struct("period", "value")))
    total = F.sum(F.abs(F.col("value").cast("decimal(18,2)"))).cast("double")
    # from here on a book's rows stay together
    found = series.groupBy(b.alias("b"), "chart", "ord", "sheet", "label").agg(points.alias("points"), total.alias("total")).repartition("b")
    return S.with_roles(found, ["b", "chart"])


def led(found: DataFrame) -> DataFrame:
    """`lines` with the book's leading chart, the one with the most roles, the first of equals; its periods and its roles."""
    chart, whole = W.partitionBy("b", "chart"), W.partitionBy("b")
    counted = found.withColumn("n_roles", F.size(F.collect_set("role").over(chart)))
    named = counted.withColumn("lead", F.min(F.struct((-F.col("n_roles")).alias("n"), "ord", "chart")).over(whole)["chart"]).withColumn("own", F.col("chart") == F.col("lead"))
    periods = F.transform("points", lambda p: p["period"])
    return named.withColumns({
        "axis": F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("own"), periods)).over(whole)))),
        "own_roles": F.collect_set(F.when(F.col("own"), F.col("role"))).over(whole),
    })


def paired(found: DataFrame, least: int = 3) -> DataFrame:
    """`led` with `pair`: the first other volume with a label of its own that shares `least` periods with the leading chart's, and whether it is the larger over these.

    The larger goes in and is the volume, the smaller comes out of it. A leading chart that has both needs no pair.
    """
    whole = W.partitionBy("b")
    volume = F.col("role") == "volume"
    mine = F.max(F.when(F.col("own") & volume, F.struct("points", "label"))).over(whole)
    of = lambda points, period: F.array_max(F.transform(F.filter(points, lambda q: q["period"] == period), lambda q: q["value"]))
    both = F.filter(F.transform("points", lambda p: F.struct(p["value"].alias("v"), of(F.col("mine")["points"], p["period"]).alias("m"))), lambda x: x["v"].isNotNull() & x["m"].isNotNull())
    total = lambda c: F.aggregate(F.transform("both", lambda x: F.abs(x[c])), F.lit(0.0), lambda a, x: a + x)
    fits = ~F.col("own") & volume & (F.trim("label") != F.trim(F.col("mine")["label"])) & (F.size("both") >= least) & ~F.array_contains("own_roles", "volume_secondary")
    shared = found.withColumn("mine", mine).withColumn("both", F.when(volume & ~F.col("own") & F.col("mine").isNotNull(), both))
    return shared.withColumn("pair", F.min(F.when(fits, F.struct("ord", "chart", "label", (total("v") > total("m")).alias("larger")))).over(whole)).drop("mine", "both")


def assembled(series: DataFrame, least: int = 3) -> DataFrame:
    """(role, sheet, label, period, value) on the leading chart's periods, from the series of one grain and pool; with `book`, of each book.

    Roles that it lacks come from the other charts in order, joined by equal periods: from one
    with the same periods, or with values on `least` of them. A period that a series lacks is null.
    """
    found = paired(led(lines(series)), least).where("role is not null")
    on = F.filter("points", lambda p: F.array_contains("axis", p["period"]))
    same = (F.size("points") == F.size("axis")) & (F.size(on) == F.size("axis"))
    lacking = ~F.col("own") & ~F.array_contains("own_roles", F.col("role")) & (F.col("role") != "volume_secondary") & (same | (F.size(F.filter(on, lambda p: p["value"].isNotNull())) >= least))
    first = F.min(F.when(lacking, F.struct("ord", "chart", "label"))).over(W.partitionBy("b", "role"))
    other = F.struct("ord", "chart", "label")
    is_pair = (F.col("pair.chart") == F.col("chart")) & (F.col("pair.label") == F.col("label"))
    role = (
        F.when(F.col("own") & (F.col("role") == "volume") & F.coalesce(F.col("pair.larger"), F.lit(False)), "volume_secondary")
        .when(F.col("own"), F.col("role"))
        .when(F.coalesce(is_pair, F.lit(False)), F.when(F.col("pair.larger"), "volume").otherwise("volume_secondary"))
        .when(lacking & (first == other), F.col("role"))
    )
    chosen = found.withColumn("chosen", role).where("chosen is not null")
    at = chosen.select("b", F.col("chosen").alias("role"), "sheet", "label", "points", F.explode("axis").alias("period"))
    value = F.array_max(F.transform(F.filter("points", lambda p: p["period"] == F.col("period")), lambda p: p["value"]))
    return at.select(*[F.col("b").alias(c) for c in book_of(series)], "role", "sheet", "label", "period", value.alias("value"))


def metrics(roles: DataFrame) -> DataFrame:
    """A row for each period (of each book), a column for each role, and what follows from them."""
    wide = roles.groupBy(*book_of(roles), "period").agg(*[F.max(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in ROLES])
    return S.derived_metrics(wide)


def pinned(series: DataFrame, pins: DataFrame) -> DataFrame:
    """The roles as an analyst pinned them: (role, sheet, label) without an error, instead of the tags."""
    own = book_of(series, pins)
    good = pins.where("error is null").select(*own, "role", "sheet", "label")
    return series.join(good, [*own, "sheet", "label"]).select(*own, "role", "sheet", "label", "period", "value")


def breakdowns(items: DataFrame, most: int = 6) -> DataFrame:
    """The regions whose line items are largest in sum: (region, size, rank), of each book."""
    own = book_of(items)
    size = items.groupBy(*own, "region").agg(F.sum(F.abs(F.col("value").cast("decimal(18,2)"))).cast("double").alias("size"))
    rank = F.row_number().over(W.partitionBy(*own).orderBy(F.desc("size"), "region"))
    few = size if own else size.orderBy(F.desc("size"), "region").limit(most)
    return few.withColumn("rank", rank).where(F.col("rank") <= most)
