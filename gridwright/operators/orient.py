"""From the cells of sheets to the tables on them, in one plan for all sheets.

A sheet is looked at in three ways: as a whole, as panels side by side (runs of columns) and as
bands one above the other (runs of rows). All are candidates for regions, and each is classified:
a cross-tab, a form, a table under one header or under several sparse rows, or unknown. Then a
rule picks one way for each sheet. Cells are typed and written once; what decides is aggregated
by row and by column, so that after two passes over the cells only rows of facts are left. Cells
keep their places in the sheet throughout.

A sheet that is empty has no region. One whose cells can't be read never gets here: its reader
gives an error row (`sources.workbook`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions import vocabulary as V
from gridwright.functions.cells import bare_month, coerce_date, typed, year_value
from gridwright.operators import scans
from gridwright.operators.headers import header_blocks, header_names
from gridwright.operators.layout import islands
from gridwright.sources.scratch import written

#: The one year that a banner of bare months may name.
BANNER_YEAR = r"(?<!\d)((?:19|20)\d\d)(?!\d)"
KEYS = ["sheet", "way", "region", "origin"]


def typed_cells(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, raw, kind, num, year, month, iso) of the cells that aren't blank, written once."""
    kinds = typed(cells.select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("int").alias("col"), "raw")).where("kind <> 'blank'")
    raw = F.col("raw")
    return written(kinds.withColumns({"year": year_value(raw), "month": bare_month(raw), "iso": F.when(F.col("kind") == "date", coerce_date(raw)).cast("string")}), "typed-cells")


def candidates(kinds: DataFrame) -> DataFrame:
    """The cells once for each region that may hold them: (…, way, region, origin)."""
    whole = kinds.withColumns({"way": F.lit("sheet"), "region": F.col("sheet"), "origin": F.lit(0).cast("long")})
    out = whole
    for way, along, mark in (("panel", "col", "#"), ("band", "row", "/")):
        found = islands(kinds, along)
        several = found.withColumn("n", F.max("island").over(W.partitionBy("sheet"))).where("n >= 2").select(F.col("sheet").alias("__s"), "island", "first", "last")
        inside = kinds.join(several, (F.col("sheet") == F.col("__s")) & F.col(along).between(F.col("first"), F.col("last")))
        origin = F.col("first") if way == "band" else F.lit(0)
        out = out.unionByName(inside.withColumns({"way": F.lit(way), "region": F.concat_ws(mark, "sheet", "island"), "origin": origin.cast("long")}).select(*whole.columns))
    return out


def row_facts(placed: DataFrame) -> DataFrame:
    """What each row of each region holds, written once."""
    is_ = lambda k: F.col("kind") == k
    some = F.col("year").isNotNull() | F.col("month").isNotNull() | F.col("iso").isNotNull()
    years = F.when(is_("text"), F.regexp_extract_all("raw", F.lit(BANNER_YEAR), F.lit(1)))
    return written(
        placed.groupBy(*KEYS, "row").agg(
            F.count(F.lit(1)).alias("filled"), F.count_if(is_("text")).alias("texts"), F.count_if(is_("date")).alias("dates"), F.count("year").alias("years"), F.count("month").alias("months"),
            F.count_if(is_("number") & F.col("year").isNull()).alias("plain"), F.min("col").alias("c0"), F.max("col").alias("c1"),
            F.array_sort(F.collect_list(F.when(some, F.struct("col", "year", "month", "iso")))).alias("heads"), F.array_distinct(F.flatten(F.collect_list(years))).alias("banners"),
        ),
        "sheet-rows",
    )


def region_facts(rows: DataFrame) -> DataFrame:
    """A row for each region, written once: its box, and of its first rows what may be an axis, a header, or a stack of header layers."""
    top = F.col("row") - F.col("origin") < V.HEADER_SCAN
    boxes = rows.groupBy(*KEYS).agg(
        F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("c0").alias("x0"), F.max("c1").alias("x1"), F.count(F.lit(1)).alias("n_rows"), F.round(F.avg((F.col("filled") <= 2).cast("double")), 3).alias("form"),
        F.max(F.when(top, F.col("filled"))).alias("widest"), F.min(F.when(F.col("plain") > 0, F.col("row"))).alias("data"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.size("banners") > 0, F.col("banners"))))).alias("banner_years"),
    )
    near = rows.join(boxes, KEYS).where(top | (F.col("row") <= F.col("r0") + V.SCAN_ROWS))
    scanned = F.col("row") < F.col("r0") + V.SCAN_ROWS
    enough = lambda n: scanned & (F.col(n) >= V.DATE_RUN) & (F.col(n) >= V.AXIS_SHARE * F.col("filled"))
    held = lambda field: F.filter("heads", lambda h: h[field].isNotNull())
    in_order = F.transform(held("year"), lambda h: h["year"])
    axis = lambda n, field: F.struct("row", "filled", F.col(n).alias("n"), held(field).alias("heads"))
    headed = top & (F.col("filled") * 2 >= F.col("widest")) & (F.col("texts") * 2 >= F.col("filled"))
    layer = (F.col("row") <= F.col("r0") + V.SCAN_ROWS) & (F.col("filled") >= 2) & (F.col("data").isNull() | (F.col("row") < F.col("data")))
    first = [c for c in boxes.columns if c not in KEYS]
    facts = near.groupBy(*KEYS).agg(
        *[F.first(c).alias(c) for c in first], F.array_sort(F.collect_list("row")).alias("near_rows"),
        F.max_by(axis("dates", "iso"), F.when(enough("dates"), F.struct("dates", -F.col("row")))).alias("dates"),
        F.max_by(axis("years", "year"), F.when(enough("years") & (in_order == F.array_sort(F.array_distinct(in_order))), F.struct("years", -F.col("row")))).alias("years"),
        F.min_by(axis("months", "month"), F.when(scanned & (F.col("months") >= V.DATE_RUN), F.col("row"))).alias("months"),
        F.min_by(F.struct("row", (F.col("texts") / F.col("filled")).alias("text_share")), F.when(headed, F.col("row"))).alias("header"),
        F.array_sort(F.collect_list(F.when(layer, F.col("row")))).alias("layers"),
    )
    return written(facts, "sheet-facts")


def axes(facts: DataFrame) -> DataFrame:
    """(region, rank, axis, axis_row, periods, strength): the rows that may head a cross-tab, dates before years before months under one banner year."""
    month = lambda h: F.concat(F.col("banner_years")[0], F.lit("-"), F.lpad(h["month"].cast("string"), 2, "0"), F.lit("-01"))
    kinds = [("date", "dates", lambda h: h["iso"]), ("year", "years", lambda h: h["year"].cast("string")), ("month", "months", month)]

    def option(rank: int, axis: str, at: str, period):
        a = F.col(at)
        fits = a.isNotNull() & ((a["n"] >= V.AXIS_SHARE * a["filled"]) & (F.size("banner_years") == 1) if axis == "month" else F.lit(True))
        periods = F.transform(a["heads"], lambda h: F.struct(h["col"].alias("col"), period(h).alias("period")))
        strength = a["n"] / a["filled"] * F.least(F.lit(1.0), a["n"] / 5)
        return F.when(fits, F.struct(F.lit(rank).alias("rank"), F.lit(axis).alias("axis"), a["row"].alias("axis_row"), periods.alias("periods"), strength.alias("strength")))

    options = F.array(*[option(i + 1, *k) for i, k in enumerate(kinds)])
    return facts.select("region", F.explode(F.filter(options, lambda o: o.isNotNull())).alias("o")).select("region", "o.*")


def cross_tabs(placed: DataFrame, found: DataFrame) -> DataFrame:
    """Of the axes those under which most cells are numbers, with a column of labels to their left, and years over most columns of numbers."""
    first = F.array_min(F.transform("periods", lambda p: p["col"]))
    joined = placed.join(found.withColumn("first", first), "region").where(F.col("row") >= F.col("axis_row"))
    below = F.col("row") > F.col("axis_row")
    number = F.col("kind") == "number"
    columns = joined.groupBy("region", "rank", "first", "col").agg(
        F.count(F.lit(1)).alias("filled"), F.count_if(F.col("kind") == "text").alias("texts"), F.count_if(below).alias("under"), F.count_if(below & number).alias("numbers"),
        F.max(F.exists("periods", lambda p: p["col"] == F.col("col"))).alias("is_period"),
    )
    period, label = F.col("is_period"), (F.col("col") < F.col("first")) & (F.col("texts") * 2 >= F.col("filled"))
    body = (F.col("col") >= F.col("first")) & (F.col("numbers") > 0)
    facts = columns.groupBy("region", "rank").agg(
        F.coalesce(F.try_divide(F.sum(F.when(period, F.col("numbers"))), F.sum(F.when(period, F.col("under")))), F.lit(0.0)).alias("interior"),
        F.array_sort(F.collect_list(F.when(label, F.col("col")))).alias("label_cols"), F.count_if(body).alias("n_body"), F.count_if(body & period).alias("n_covered"),
    )
    fits = (F.col("interior") >= V.INTERIOR_SHARE) & (F.size("label_cols") > 0) & ((F.col("axis") != "year") | (F.col("n_covered") >= V.YEAR_COVERAGE * F.col("n_body")))
    ok = found.join(facts, ["region", "rank"]).where(fits)
    tab = F.min_by(F.struct("axis", "axis_row", "periods", "strength", "interior", "label_cols"), "rank")
    return ok.groupBy("region").agg(tab.alias("t")).select("region", "t.*")


def classified(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """KEYS, r0, r1, c0, c1, orientation, axis, header_rows, periods, label_cols, confidence, reason of each candidate."""
    regions = region_facts(rows)
    facts = regions.join(cross_tabs(placed, axes(regions)), "region", "left")
    # a header or a stack of layers has rows of data below
    tidy = F.coalesce(F.col("header.row") < F.col("r1"), F.lit(False))
    composite = F.coalesce((F.size("layers") >= 2) & (F.element_at("layers", -1) < F.col("r1")), F.lit(False))
    kind = F.when(F.col("axis").isNotNull(), "matrix").when(F.col("form") >= 0.6, "form").when(tidy, "tidy").when(composite, "composite").otherwise("unknown")
    headers = F.when(F.col("kind") == "matrix", F.array("axis_row")).when(F.col("kind") == "tidy", F.array("header.row")).when(F.col("kind") == "composite", F.col("layers"))
    chosen = facts.withColumn("kind", kind).withColumn("header_rows", headers)
    n = F.col("n_rows") - F.size(F.filter("near_rows", lambda r: r <= F.array_max("header_rows")))
    confidence = (
        F.when(F.col("kind") == "matrix", F.least(F.lit(1.0), 0.5 * F.col("strength") + 0.5 * F.col("interior")))
        .when(F.col("kind") == "form", F.col("form"))
        .when(F.col("kind") == "tidy", F.least(F.lit(1.0), 0.5 * F.col("header.text_share") + 0.5 * F.least(F.lit(1.0), n / 3)))
        .when(F.col("kind") == "composite", F.least(F.lit(1.0), 0.3 + 0.1 * F.size("header_rows") + 0.1 * F.least(n, F.lit(3))))
        .otherwise(0.0)
    )
    reason = (
        F.when(F.col("kind") == "matrix", F.concat(F.col("axis"), F.lit("s across row "), F.col("axis_row")))
        .when(F.col("kind") == "form", F.lit("most rows have two cells at most"))
        .when(F.col("kind") == "tidy", F.concat(F.lit("header in row "), F.col("header.row")))
        .when(F.col("kind") == "composite", F.concat(F.lit("header of rows "), F.array_join(F.col("layers").cast("array<string>"), ", ")))
        .otherwise("nothing fits")
    )
    return chosen.select(
        *KEYS, "r0", "r1", F.col("x0").alias("c0"), F.col("x1").alias("c1"), F.when(F.col("kind") == "composite", "tidy").otherwise(F.col("kind")).alias("orientation"),
        F.when(F.col("axis") == "month", "date").otherwise(F.col("axis")).alias("axis"), "header_rows", "periods", "label_cols", F.round(confidence, 3).alias("confidence"), reason.alias("reason"),
    )


def orient(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions, cells): the regions of each sheet, and the typed cells with the region that they belong to.

    Panels are taken where two of them are recognised. Bands are taken where two are, if the whole
    is not, or if it is no cross-tab but has two rows of bare months. Else a sheet is one region.
    """
    kinds = typed_cells(cells)
    placed = candidates(kinds)
    rows = row_facts(placed)
    every = written(classified(placed, rows), "sheet-regions")
    known = lambda way: F.count_if((F.col("way") == way) & (F.col("orientation") != "unknown"))
    months = rows.where((F.col("way") == "sheet") & (F.col("months") >= V.DATE_RUN)).groupBy("sheet").agg(F.count(F.lit(1)).alias("n_months"))
    whole = F.max(F.when(F.col("way") == "sheet", F.col("orientation")))
    sheets = every.groupBy("sheet").agg(known("panel").alias("n_panels"), known("band").alias("n_bands"), whole.alias("whole")).join(months, "sheet", "left")
    torn = (F.col("whole") == "unknown") | ((F.col("whole") != "matrix") & (F.coalesce("n_months", F.lit(0)) >= 2))
    way = F.when(F.col("n_panels") >= 2, "panel").when(torn & (F.col("n_bands") >= 2), "band").otherwise("sheet")
    regions = written(every.join(sheets.select("sheet", way.alias("way")), ["sheet", "way"]), "sheet-regions-chosen")
    boxes = regions.select(F.col("sheet").alias("__s"), "region", "r0", "r1", "c0", "c1")
    inside = (F.col("sheet") == F.col("__s")) & F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    return regions, kinds.join(boxes, inside).drop("__s", "r0", "r1", "c0", "c1")


def sheet_orientations(regions: DataFrame) -> DataFrame:
    """(sheet, orientation, confidence, n_regions): `multi` where a sheet has several tables, as sure as the least sure of them."""
    sure = F.min(F.when((F.col("way") == "sheet") | (F.col("orientation") != "unknown"), F.col("confidence")))
    return regions.groupBy("sheet").agg(F.when(F.max("way") == "sheet", F.max("orientation")).otherwise("multi").alias("orientation"), sure.alias("confidence"), F.count(F.lit(1)).alias("n_regions"))


def tidy_headers(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, rows, header_row, last_row): a single header row with the rows below that belong to it, or the layers of a stack."""
    tidy = regions.where("orientation = 'tidy'")
    single = header_blocks(cells.select("region", "row", "col", "kind"), tidy.where("size(header_rows) = 1").select("region", F.col("header_rows")[0].alias("header_row")))
    stacks = tidy.where("size(header_rows) > 1").select("region", F.array_min("header_rows").alias("header_row"), F.array_max("header_rows").alias("last_row"), F.col("header_rows").alias("rows"))
    return single.withColumn("rows", F.sequence("header_row", "last_row")).unionByName(stacks)


def tidy_tables(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, row, ord, name, raw, kind, num, iso, is_label, is_ghost) of tables.

    Columns that are mostly text are labels: what they lack is filled from above, as merged
    cells are, and such a value is a ghost. Labels are never numeric series.
    """
    heads = written(tidy_headers(cells, regions), "sheet-headers")
    names = header_names(cells, heads)
    body = cells.join(heads.select("region", "last_row"), "region").where(F.col("row") > F.col("last_row"))
    labels = body.groupBy("region", "col").agg((F.count_if(F.col("kind") == "text") * 2 >= F.count(F.lit(1))).alias("is_label"))
    own = body.select("region", "row", "col", "raw", "kind", "num", "iso")
    # every label column in every row that has a cell
    grid = own.select("region", "row").distinct().join(labels.where("is_label").select("region", "col"), "region")
    value = F.when(F.col("raw").isNotNull(), F.struct("raw", "kind", "num", "iso"))
    parts = scans.ranged(grid.join(own, ["region", "row", "col"], "left"), ["region", "col"], ["row"], "sheet-labels")
    filled = scans.carried(parts, ["region", "col"], ["row"], value, "v").where("v is not null")
    labelled = filled.select("region", "row", "col", "v.*", F.lit(True).alias("is_label"), F.col("raw").isNull().alias("is_ghost"))
    plain = own.join(labels.where("not is_label"), ["region", "col"]).select("region", "row", "col", "raw", "kind", "num", "iso", "is_label", F.lit(False).alias("is_ghost"))
    return plain.unionByName(labelled).join(names, ["region", "col"]).withColumnRenamed("col", "ord")


def cross_tab_facts(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, label, period, value, places) of cross-tabs: labels joined by /, repeated cells summed, and where the numbers stand."""
    tabs = regions.where("orientation = 'matrix'").select("region", F.col("header_rows")[0].alias("axis_row"), "periods", "label_cols")
    body = cells.join(tabs, "region").where(F.col("row") > F.col("axis_row"))
    named = body.where(F.array_contains("label_cols", F.col("col"))).groupBy("region", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.trim("raw").alias("t")))), lambda x: x["t"]), " / ").alias("label"))
    period = F.get(F.filter("periods", lambda p: p["col"] == F.col("col")), F.lit(0))["period"]
    values = body.where("num is not null").withColumn("period", period).where("period is not null").join(named, ["region", "row"], "left")
    label = F.coalesce("label", F.concat(F.lit("series "), F.col("row")))
    return values.groupBy("region", label.alias("label"), "period").agg(F.sum(F.col("num").cast("decimal(18,2)")).cast("double").alias("value"), F.array_sort(F.collect_list(F.struct("row", "col"))).alias("places"))


def form_fields(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, row, field, value) of forms: rows of two cells at most, the first of which names the second."""
    inside = cells.join(regions.where("orientation = 'form'").select("region"), "region", "left_semi")
    pairs = inside.groupBy("region", "row").agg(F.array_sort(F.collect_list(F.struct("col", F.trim("raw").alias("t")))).alias("c")).where("size(c) <= 2")
    return pairs.select("region", "row", F.col("c")[0]["t"].alias("field"), F.get("c", F.lit(1))["t"].alias("value"))


def line_items(facts: DataFrame, target: str, label: str, totals: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(region, label, value, n_items): the largest of a table's values, by their size, with their labels; rows of totals don't count, and fewer than three are none."""
    values = facts.where((F.col("name") == target) & F.col("num").isNotNull()).select("region", "row", F.round("num", 4).alias("value"))
    named = values.join(facts.where(F.col("name") == label).select("region", "row", F.col("raw").alias("label")), ["region", "row"])
    data = named.join(totals.select("region", F.col("rec").alias("row")).distinct(), ["region", "row"], "left_anti") if totals is not None else named
    n = data.groupBy("region").agg(F.count(F.lit(1)).alias("n_items")).where("n_items >= 3")
    rank = F.row_number().over(W.partitionBy("region").orderBy(F.desc(F.abs("value")), "row"))
    return data.withColumn("k", rank).where(F.col("k") <= most).join(n, "region").select("region", "k", "label", "value", "n_items")


def preview(cells: DataFrame, rows: int = 6, cols: int = 12) -> DataFrame:
    """The top left of each sheet."""
    return cells.where((F.col("row") < rows) & (F.col("col") < cols)).select("sheet", "row", "col", "raw")


def wide(facts: DataFrame, region: str, names: list[str]) -> DataFrame:
    """One table with a column for each name: numbers where the column is mostly numbers, else text."""
    own = facts.where(F.col("region") == region)
    kinds = {r["name"]: r["numeric"] for r in own.groupBy("name").agg((F.count_if((F.col("kind") == "number") & ~F.col("is_label")) >= V.DOMINANT * F.count(F.lit(1))).alias("numeric")).collect()}
    return own.groupBy("row").agg(*[F.max(F.when(F.col("name") == n, F.col("num") if kinds.get(n) else F.col("raw"))).alias(n) for n in names])
