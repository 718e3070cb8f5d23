"""From files to results: every workbook and text file under a path, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.cells import is_blank
from gridwright.operators import audit, journal, model, orient, profile
from gridwright.operators.audit import is_total_label
from gridwright.operators.series import plan_vs_actual as plan_against
from gridwright.sources.scratch import written
from gridwright.sources.workbook import cells_of, first_copies, refusals, too_many_cells


def analyse(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What all files under `path` hold, by name:

    errors (path, error), copies (path, n_copies), contracts (path, is_journal), sheets, regions,
    tables (facts), fields of forms, series of cross-tabs, columns (profiles of the tables), model
    (by year), months (by month, without the sheets that are plans), plan (by month, of these
    alone), plan_vs_actual, journal, journal_findings.

    A sheet is named by the whole path of its file and its own name, and a book is a file: all
    files are read, typed and classified together, and nothing of one is mixed into another's
    results. A file that can't be read, is empty or too large, or spans too many cells is a row of
    errors; of files with equal content the first by path is read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    known = written(files.select("path", "length", F.sha2("content", 256).alias("sha256")), "file-hashes")
    refused = refusals(known)
    first = written(first_copies(known.join(refused, "path", "left_anti")), "file-copies")
    raw = written(cells_of(files.join(first.select("path"), "path", "left_semi")), "file-cells")
    large = written(too_many_cells(raw.where("error is null")), "file-sizes")
    good = raw.where("error is null").join(large, "path", "left_anti")
    cells = good.withColumn("sheet", F.concat_ws("!", "path", "sheet"))
    books = written(cells.select("sheet", F.col("path").alias("book")).distinct(), "file-sheets")
    regions, placed = orient.orient(cells)
    tables = written(orient.tidy_tables(placed, regions), "file-tables")
    series = written(model.series_of(placed, regions, books), "file-series")
    monthly = series.where("grain = 'month'").withColumn("pool", model.pool(F.element_at(F.split("sheet", "!"), -1)))
    roles = {name: written(model.assembled(monthly.where(F.col("pool") == name).drop("pool")), f"file-{name}") for name in ("actual", "plan")}
    rows = written(journal.parsed(good.where(~is_blank(F.col("raw")))), "file-journals")
    return {
        "errors": raw.where("error is not null").select("path", "error").unionByName(refused.withColumnRenamed("reason", "error")).unionByName(large.select("path", F.lit("too many cells").alias("error"))),
        "copies": first.where("n_copies > 1"),
        "contracts": journal.matches_contract(good),
        "sheets": orient.sheet_orientations(regions),
        "regions": regions,
        "tables": tables,
        "fields": orient.form_fields(placed, regions),
        "series": series,
        "columns": profile.column_profile(tables.select(F.concat_ws("|", "region", "name").alias("name"), "raw")),
        "model": model.metrics(model.assembled(series.where("grain = 'year'"))),
        "months": model.metrics(roles["actual"]),
        "plan": model.metrics(roles["plan"]),
        "plan_vs_actual": plan_vs_actual(roles["actual"], roles["plan"]),
        "journal": rows,
        "journal_findings": journal_findings(rows),
    }


def plan_vs_actual(actual: DataFrame, plan: DataFrame) -> DataFrame:
    """`series.plan_vs_actual` within each book."""
    keyed = lambda df: df.select("book", "role", "period", "value")
    return plan_against(keyed(actual), keyed(plan), ["book"])


def journal_findings(rows: DataFrame) -> DataFrame:
    """(path, rule, severity, subject, usd) of the rules over journals that need nothing but their rows, by book."""
    usd = F.coalesce(F.greatest(F.col("outU"), F.col("inU")), F.lit(0.0))
    named = lambda df, rule, severity: df.select("path", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.concat_ws(":", "j", "seq").alias("subject"), usd.alias("usd"))
    content = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("j", "d", "label", "code", "inC", "outC", "inU", "outU")]
    found = [
        named(journal.zero_rows(rows), "zero row", "LOW"), named(journal.transfers_as_spend(rows), "transfer as spend", "HIGH"), named(journal.out_of_order(rows), "date before the row above", "LOW"),
        named(journal.balance_breaks(rows, "inU", "outU", "balU"), "balance in USD", "HIGH"), named(journal.balance_breaks(rows.where("j = 'site'"), "inC", "outC", "balC"), "balance in CDF", "HIGH"),
        named(journal.duplicates(rows, *content), "duplicate", "MED"),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def checks(tables: DataFrame, region: str) -> DataFrame:
    """The relations of one table, from the facts of `analyse`: products and row sums of its numeric columns; rows of totals don't count.

    The columns of a table are as many as a sheet is wide, so their names come to the driver.
    """
    own = tables.where(F.col("region") == region)
    numeric = F.count_if((F.col("kind") == "number") & ~F.col("is_label")) * 10 >= 6 * F.count(F.lit(1))
    columns = own.groupBy("ord", "name").agg(numeric.alias("numeric"), F.max("is_label").alias("is_label")).orderBy("ord").collect()
    label = next((c["name"] for c in columns if c["is_label"]), None)
    rows = orient.wide(tables, region, [c["name"] for c in columns])
    totals = F.coalesce(is_total_label(F.col(f"`{label}`")), F.lit(False)) if label else None
    return audit.run_checks(rows, "row", [c["name"] for c in columns], [c["numeric"] for c in columns], totals)
