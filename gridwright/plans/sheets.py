"""Queries over whole sheets, models, journals, findings and publications; the catalogue registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridwright.functions import cells as C
from gridwright.operators import audit, journal, layout, mapping, model, orient, profile, report, series, story
from gridwright.plans.catalog import AUDITED, AUDITED_SQL, BROKEN_SQL, LEDGER_SQL, YEARLY_SQL, _audited, _ledger, _yearly, query, read
from gridwright.sources import reports, workbook
from gridwright.sources.scratch import folder, written
from gridwright.sources.store import Store

# Sheets built from whole tables, and found again

CUSTOMER_TEXT = "SELECT c_custkey, c_name, c_mktsegment, c_acctbal::DECIMAL(18,2) AS c_acctbal FROM customer"


def _customer_sheet(spark, sf_dir):
    """All customers as a sheet under a banner, with segments that stand only where they change."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"))
    cells = layout.encode(rows, "customers", ["c_custkey"], top=2)
    banner = spark.createDataFrame([("customers", 0, 0, "All customers")], "sheet string, row long, col int, raw string")
    return cells.unionByName(banner)


@query(f"""WITH c AS ({CUSTOMER_TEXT}) SELECT 'c_acctbal' AS name, count(*) AS n, sum(c_acctbal)::DOUBLE AS total, 0::BIGINT AS n_labels FROM c
UNION ALL SELECT 'c_custkey', count(*), sum(c_custkey)::DOUBLE, 0 FROM c UNION ALL SELECT 'c_name', count(*), NULL, count(*) FROM c UNION ALL SELECT 'c_mktsegment', count(*), NULL, count(*) FROM c""")
def sheet_columns(spark, sf_dir):
    regions, cells = orient.orient(_customer_sheet(spark, sf_dir))
    facts = orient.tidy_tables(cells, regions)
    return facts.groupBy("name").agg(F.count(F.lit(1)).alias("n"), profile.exact_sum(F.col("num")).alias("total"), F.count_if("is_label").alias("n_labels"))


@query(f"""WITH c AS ({CUSTOMER_TEXT}), n AS (SELECT count(*) AS n FROM c) SELECT row_number() OVER (ORDER BY abs(c_acctbal) DESC, c_custkey)::INT AS k, c_name AS label, c_acctbal::DOUBLE AS value, n AS n_items FROM c, n QUALIFY k <= 10""")
def sheet_line_items(spark, sf_dir):
    regions, cells = orient.orient(_customer_sheet(spark, sf_dir))
    return orient.line_items(orient.tidy_tables(cells, regions), "c_acctbal", "c_name").select("k", "label", "value", "n_items")


@query("SELECT c_name AS field, c_mktsegment AS value FROM customer")
def sheet_form(spark, sf_dir):
    """Customers as lines of a field and its value, without a header."""
    rows = read(spark, sf_dir, "customer").select("c_name", "c_mktsegment")
    cells = layout.encode(rows, "form", ["c_name"]).where("row > 0")
    regions, placed = orient.orient(cells)
    return orient.form_fields(placed, regions).select("field", "value")


MONTH_NAMES = ["Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre"]


@query("""WITH y AS (SELECT max(year(o_orderdate)) - 1 AS y FROM orders)
SELECT o_orderpriority AS label, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, count(*)::DOUBLE AS value FROM orders, y WHERE year(o_orderdate) = y GROUP BY 1, 2""")
def sheet_months(spark, sf_dir):
    """Orders of the last full year by bare months, under a banner that names the year."""
    orders = read(spark, sf_dir, "orders")
    year = orders.agg(F.max(F.year("o_orderdate")) - 1).first()[0]
    if year is None:
        return spark.createDataFrame([], "label string, period string, value double")
    own = orders.where(F.year("o_orderdate") == year)
    table = own.groupBy(F.col("o_orderpriority").alias("priority")).agg(*[F.nullif(F.count_if(F.month("o_orderdate") == i + 1), F.lit(0)).alias(m) for i, m in enumerate(MONTH_NAMES)])
    banner = spark.createDataFrame([("months", 0, 0, f"COMMANDES {year}")], "sheet string, row long, col int, raw string")
    regions, cells = orient.orient(layout.encode(table, "months", ["priority"], top=1).unionByName(banner))
    return orient.cross_tab_facts(cells, regions).select("label", "period", "value")


@query("""SELECT * FROM (SELECT 0::BIGINT AS row, unnest([{'col': 0, 'raw': 'n_nationkey'}, {'col': 1, 'raw': 'n_name'}, {'col': 2, 'raw': 'n_regionkey'}], recursive := true))
UNION ALL SELECT * FROM (SELECT n_nationkey + 1 AS row, unnest([{'col': 0, 'raw': n_nationkey::VARCHAR}, {'col': 1, 'raw': n_name}, {'col': 2, 'raw': n_regionkey::VARCHAR}], recursive := true) FROM nation WHERE n_nationkey < 5)""")
def sheet_preview(spark, sf_dir):
    return orient.preview(layout.encode(read(spark, sf_dir, "nation"), "nation", ["n_nationkey"])).select("row", "col", "raw")


@query("""WITH s AS (SELECT p_brand AS path, p_partkey AS sheet_ord, p_type AS sheet, left(p_type, 31) AS base FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY path, lower(base) ORDER BY sheet_ord) AS k FROM s)
SELECT path, sheet_ord, sheet, CASE WHEN k = 1 THEN base WHEN k <= 99 THEN left(base, 28) || ' ' || k END AS name FROM k""")
def sheet_name_list(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("sheet_ord"), F.col("p_type").alias("sheet"))
    return workbook.sheet_names(parts)


@query("SELECT 'd' || doc_id AS path, CASE WHEN strlen(text) = 0 THEN 'empty' ELSE 'too large' END AS reason FROM documents WHERE strlen(text) = 0 OR strlen(text) * 1000 > 26214400")
def file_refusals(spark, sf_dir):
    """Documents as files of a thousand times their size."""
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), (F.octet_length("text").cast("long") * 1000).alias("length"))
    return workbook.refusals(files)


@query("""SELECT event_id, CASE WHEN event_id % 5 > 1 THEN value END AS value, CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events""")
def json_safe_values(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    odd = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 5 == 1, float("inf")).otherwise(F.col("value"))
    blank = F.when(F.col("event_id") % 3 == 0, "#N/A").otherwise(F.col("event_type"))
    return events.select("event_id", C.json_safe(odd, "double").alias("value"), C.json_safe(blank, "string").alias("event_type"), C.json_safe(F.col("ts"), "timestamp").alias("at"))


@query("""WITH v AS (SELECT unnest([{'ord': 0, 'name': 'event_id', 'ok': true}, {'ord': 1, 'name': 'event_type', 'ok': false}, {'ord': 2, 'name': 'some', 'ok': event_id % 10 = 0}, {'ord': 3, 'name': 'few', 'ok': event_id % 50 = 0}], recursive := true) FROM events),
c AS (SELECT ord, name, count(*) FILTER (ok) AS n_parsed, count(*) AS n FROM v GROUP BY ALL) SELECT ord, name, n_parsed FROM c WHERE n_parsed >= greatest(3, 0.05 * n)""")
def numeric_columns(spark, sf_dir):
    """Of a tenth of a column's values numbers are enough; of a fiftieth they aren't."""
    e = read(spark, sf_dir, "events")
    mostly = lambda n: F.when(F.col("event_id") % n == 0, F.col("event_id").cast("string")).otherwise(F.col("event_type"))
    raws = [F.col("event_id").cast("string"), F.col("event_type"), mostly(10), mostly(50)]
    long = e.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), r.alias("raw")) for i, (n, r) in enumerate(zip(["event_id", "event_type", "some", "few"], raws, strict=True))])).alias("x")).select("x.*")
    return profile.numeric_columns(long)


# Journals from sheets

JOURNAL_SQL = "SELECT CASE WHEN user_id % 3 = 0 THEN 'dgo' ELSE 'site' END AS j, event_id, ts::DATE AS d, event_type AS code, round(abs(value), 2) AS outU FROM events"


def _journal_cells(spark, sf_dir):
    """Events as the cells of the two journals of a workbook: their header stands in the tenth row."""
    events = read(spark, sf_dir, "events")
    out = None
    for sheet, own in ((journal.SITE_SHEET, F.col("user_id") % 3 != 0), (journal.HEAD_SHEET, F.col("user_id") % 3 == 0)):
        rows = events.where(own).select(
            F.col("event_id").alias("N"), F.date_format("ts", "dd/MM/yyyy").alias("Dates"), F.col("event_type").alias("Code Interne"), F.concat(F.lit("user "), "user_id").alias("Libellés"),
            F.round(F.abs("value"), 2).cast("decimal(18,2)").alias("Sorties USD"),
        )
        cells = layout.encode(rows, sheet, ["N"], top=journal.HEADER_ROW)
        out = cells if out is None else out.unionByName(cells)
    return out.withColumn("path", F.lit("book"))


@query(f"SELECT j, row_number() OVER (PARTITION BY j ORDER BY event_id) - 1 AS seq, strftime(d, '%Y-%m-%d') AS d, code, outU, 0.0::DOUBLE AS inU FROM ({JOURNAL_SQL})")
def journal_parsed(spark, sf_dir):
    return journal.parsed(_journal_cells(spark, sf_dir)).select("j", "seq", F.col("d").cast("string").alias("d"), "code", "outU", "inU")


@query("""WITH e AS (SELECT 'book ' || (user_id % 10) AS path, CASE WHEN user_id % 3 = 0 THEN 'dgo' ELSE 'site' END AS j, event_id, ts::DATE AS d, event_type AS code, round(abs(value), 2) AS outU FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY path, j ORDER BY event_id) - 1 AS seq FROM e), p AS (SELECT *, lag(d) OVER (PARTITION BY path, j ORDER BY seq) AS before FROM s)
SELECT path, j, count(*) AS n, sum(outU::DECIMAL(18,2))::DOUBLE AS out_usd, max(seq) AS last_seq, count(*) FILTER (d < before) AS n_out_of_order FROM p GROUP BY 1, 2""")
def journal_books(spark, sf_dir):
    """Events as the journals of ten workbooks: rows, sums and dates out of order of each."""
    events = read(spark, sf_dir, "events").withColumn("path", F.concat(F.lit("book "), F.col("user_id") % 10))
    by = Window.partitionBy("path", "j").orderBy("event_id")
    placed = events.withColumn("j", F.when(F.col("user_id") % 3 == 0, journal.HEAD_SHEET).otherwise(journal.SITE_SHEET)).withColumn("row", F.row_number().over(by) + journal.HEADER_ROW)
    raws = [F.date_format("ts", "dd/MM/yyyy"), F.col("event_type"), F.round(F.abs("value"), 2).cast("decimal(18,2)").cast("string")]
    body = placed.select("path", F.col("j").alias("sheet"), "row", F.posexplode(F.array(*raws)).alias("col", "raw"))
    names = F.posexplode(F.array(F.lit("Dates"), F.lit("Code Interne"), F.lit("Sorties USD"))).alias("col", "raw")
    heads = body.select("path", "sheet").distinct().select("path", "sheet", F.lit(journal.HEADER_ROW).alias("row"), names)
    rows = written(journal.parsed(body.unionByName(heads)), "journals-of-books")
    late = journal.out_of_order(rows).groupBy("path", "j").agg(F.count(F.lit(1)).alias("n_out_of_order"))
    sums = rows.groupBy("path", "j").agg(F.count(F.lit(1)).alias("n"), profile.exact_sum(F.col("outU")).alias("out_usd"), F.max("seq").alias("last_seq"))
    return sums.join(late, ["path", "j"], "left").fillna(0, ["n_out_of_order"])


@query("SELECT 'book' AS path, count(DISTINCT user_id % 3 = 0) = 2 AS is_journal FROM events")
def journal_contract(spark, sf_dir):
    return journal.matches_contract(_journal_cells(spark, sf_dir))


@query(f"""WITH s AS (SELECT CASE WHEN j = 'dgo' THEN 'dgo' WHEN code = 'purchase' THEN 'capex' WHEN code = 'click' THEN 'opex' ELSE 'unmapped' END AS kind, sum(outU::DECIMAL(18,2)) AS usd FROM ({JOURNAL_SQL}) GROUP BY 1)
SELECT kind, usd::DOUBLE AS usd, round((100 * usd::DOUBLE / (SELECT sum(usd) FROM s)::DOUBLE), 1) AS pct FROM s WHERE usd <> 0""")
def journal_destinations(spark, sf_dir):
    rows = journal.parsed(_journal_cells(spark, sf_dir))
    kind = F.when(F.col("code") == "purchase", "capex").when(F.col("code") == "click", "opex").otherwise("unmapped")
    return journal.destinations(rows.where("j = 'site'").select(kind.alias("kind"), F.col("outU").alias("usd")), rows.where("j = 'dgo'").select(F.col("outU").alias("usd")))


FOUND_SQL = f"""SELECT 'MED' AS severity, j || seq AS subject, 0.0::DOUBLE AS usd FROM ({LEDGER_SQL}) WHERE outU = 0 UNION ALL SELECT 'HIGH', j || seq, outU FROM ({LEDGER_SQL}) WHERE code = 'Banque' AND outU > 0"""


def _journal_findings(spark, sf_dir):
    rows = _ledger(spark, sf_dir)
    named = lambda df, severity: df.select(F.lit(severity).alias("severity"), F.concat("j", "seq").alias("subject"), F.coalesce("outU", F.lit(0.0)).alias("usd"))
    return named(journal.zero_rows(rows), "MED").unionByName(named(journal.transfers_as_spend(rows), "HIGH"))


@query(f"SELECT count(*) AS n, count(*) FILTER (severity = 'HIGH') AS n_high, sum(abs(usd::DECIMAL(18,2)))::DOUBLE AS at_stake_usd FROM ({FOUND_SQL})")
def journal_exceptions(spark, sf_dir):
    return journal.exceptions(_journal_findings(spark, sf_dir))


@query(f"SELECT * FROM ({FOUND_SQL}) ORDER BY CASE severity WHEN 'HIGH' THEN 1 ELSE 2 END, abs(usd) DESC, subject LIMIT 200")
def journal_gravest(spark, sf_dir):
    """The report of the gravest two hundred."""
    return journal.gravest_first(_journal_findings(spark, sf_dir))


# Findings with decisions

@query(f"""WITH n AS (SELECT count(*) AS n FROM ({AUDITED_SQL})), bad AS (SELECT target || '=' || a || '*' || b AS relation, target, count(*) AS n_mismatched, round(sum(abs(delta::DECIMAL(18,4)))::DOUBLE, 2) AS delta_total FROM ({BROKEN_SQL}) GROUP BY 1, 2)
SELECT relation, 'product' AS rule, target, n AS n_checked, n - n_mismatched AS n_matched, n_mismatched, delta_total, 'mismatch' AS status FROM bad, n""")
def checks_run(spark, sf_dir):
    """All relations of the table of lines: its two products, and no sum of columns."""
    out = audit.run_checks(_audited(spark, sf_dir), "row_key", ["row_key", *AUDITED], [False, *(True for _ in AUDITED)])
    return out.select("relation", "rule", "target", "n_checked", "n_matched", "n_mismatched", "delta_total", "status")


DECIDED_SQL = """WITH f AS (SELECT o_orderpriority AS sheet, o_orderstatus AS target, 'sum' AS formula, count(*) AS n, CASE count(*) % 3 WHEN 0 THEN 'mismatch' WHEN 1 THEN 'ok' ELSE 'doubtful' END AS status FROM orders GROUP BY 1, 2),
d AS (SELECT *, substr(sha1(sheet || '|-|' || target || '|' || formula), 1, 12) AS finding_id, CASE WHEN status IN ('mismatch', 'ok') THEN status ELSE 'unverified' END AS bucket, CASE WHEN n % 2 = 0 THEN 'flagged' ELSE 'open' END AS decision FROM f)"""


def _decided(spark, sf_dir):
    n = F.col("n")
    found = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("sheet"), F.col("o_orderstatus").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    shaped = found.select("sheet", F.lit(None).cast("string").alias("panel"), "target", F.lit("sum").alias("formula"), F.when(n % 3 == 0, "mismatch").when(n % 3 == 1, "ok").otherwise("doubtful").alias("status"), n.cast("double").alias("delta_total"), "n")
    ids = C.short_hash(12, F.col("sheet"), F.lit("-"), F.col("target"), F.lit("sum"))
    decisions = shaped.where(n % 2 == 0).select(ids.alias("finding_id"), F.lit("flagged").alias("decision"))
    return audit.with_decisions(shaped, decisions)


@query(f"{DECIDED_SQL} SELECT sheet, target, finding_id, bucket, decision FROM d")
def findings_decided(spark, sf_dir):
    return _decided(spark, sf_dir).select("sheet", "target", "finding_id", "bucket", "decision")


@query(f"{DECIDED_SQL} SELECT count(*) FILTER (bucket <> 'ok' AND decision = 'open') AS n_open, CASE WHEN count(*) = 0 THEN NULL WHEN count(*) FILTER (decision = 'flagged') > 0 THEN 'flagged' ELSE 'reconciled' END AS status FROM d")
def findings_open(spark, sf_dir):
    decided = _decided(spark, sf_dir)
    return audit.open_findings(decided).join(audit.deliverable_status(decided))


# Stories

@query("SELECT 'o_totalprice' AS measure, 'sum' AS metric, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders UNION ALL SELECT 'l_discount', 'mean', round(avg(l_discount), 4) FROM lineitem")
def story_headlines(spark, sf_dir):
    return story.headline_value(read(spark, sf_dir, "orders"), "o_totalprice", "amount").unionByName(story.headline_value(read(spark, sf_dir, "lineitem"), "l_discount", "ratio"))


@query("""WITH m AS (SELECT 'l_discount' AS measure, l_returnflag AS member, round(avg(l_discount), 4) AS mean_value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_tax', l_returnflag, round(avg(l_tax), 4), count(*) FROM lineitem GROUP BY 2)
SELECT *, row_number() OVER (PARTITION BY measure ORDER BY mean_value DESC, member)::INT AS rank FROM m""")
def story_change_means(spark, sf_dir):
    return story.change_means(read(spark, sf_dir, "lineitem"), "l_returnflag", ["l_discount", "l_tax", "l_quantity"])


@query("""WITH f AS (SELECT o_orderpriority AS label, strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY 1, 2),
d AS (SELECT label AS entity, round(v - lead(v) OVER w, 4) AS value, round(v, 4) AS headline, row_number() OVER w AS k, lead(v) OVER w AS before FROM f WINDOW w AS (PARTITION BY label ORDER BY month DESC)),
n AS (SELECT entity, value, headline FROM d WHERE k = 1 AND before IS NOT NULL),
s AS (SELECT 'Stock ' || o_orderstatus AS entity, arg_max(n, p)::DOUBLE AS value FROM (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS p, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)
SELECT 'low_stock' AS metric, row_number() OVER (ORDER BY value, entity)::INT AS rank, entity, value, NULL::DOUBLE AS headline FROM s QUALIFY rank <= 5
UNION ALL SELECT 'gained', row_number() OVER (ORDER BY value DESC, entity)::INT AS rank, entity, value, headline FROM n QUALIFY rank <= 5
UNION ALL SELECT 'lost', row_number() OVER (ORDER BY value, entity)::INT AS rank, entity, value, headline FROM n QUALIFY rank <= 5""")
def story_matrix(spark, sf_dir):
    """Sums by priority, their total, and numbers of orders by status as stocks, month by month."""
    orders = read(spark, sf_dir, "orders").withColumn("period", F.date_format("o_orderdate", "yyyy-MM-01"))
    flows = orders.groupBy(F.col("o_orderpriority").alias("label"), "period").agg(profile.exact_sum(F.col("o_totalprice")).alias("value"))
    total = flows.groupBy("period").agg(profile.exact_sum(F.col("value")).alias("value")).select(F.lit("TOTAL").alias("label"), "period", "value")
    stocks = orders.groupBy(F.concat(F.lit("Stock "), F.col("o_orderstatus")).alias("label"), "period").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return story.matrix_story(flows.unionByName(total).unionByName(stocks))


@query("SELECT CASE WHEN (SELECT count(*) FROM orders) > 0 THEN 'order_total' END AS headline")
def story_headline(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_totalprice", "order_total")
    names = orders.agg(*[F.count(c).alias(c) for c in orders.columns])  # only columns with values count
    long = names.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("name"), F.col(c).alias("n")) for i, c in enumerate(orders.columns)])).alias("x")).select("x.*").where("n > 0")
    kinds = F.when(F.col("name").isin("order_total", "o_orderkey", "o_custkey"), "amount")
    return story.headline(long.withColumns({"measure_kind": kinds, "role": C.role(F.col("name"))}).where("measure_kind is not null"))


@query("""SELECT requires, 'no rows for ' || requires AS reason FROM (SELECT 'time' AS requires, count(o_orderdate) AS n FROM orders UNION ALL SELECT 'stock', count(*) FILTER (o_orderpriority LIKE '%stock%') FROM orders UNION ALL SELECT 'refund', count(*) FILTER (o_totalprice < 0) FROM orders) WHERE n = 0""")
def story_gaps(spark, sf_dir):
    return story.gap_rows(read(spark, sf_dir, "orders"), {"time": F.col("o_orderdate").isNotNull(), "stock": F.contains("o_orderpriority", F.lit("stock")), "refund": F.col("o_totalprice") < 0})


# Models: yearly sums of lines as three sheets, of which one leads and the others add

def _series(spark, sf_dir):
    y = _yearly(spark, sf_dir)
    row = lambda ord_, sheet, label, value: F.struct(F.lit(f"{sheet}#1").alias("chart"), F.lit(ord_).alias("ord"), F.lit(sheet).alias("sheet"), F.lit("year").alias("grain"), F.lit(label).alias("label"), F.col("year").cast("string").alias("period"), F.round(value, 2).alias("value"))
    parts = [
        row(1, "EXPLOITATION", "Chiffre d'affaires", F.col("revenue")), row(1, "EXPLOITATION", "OPEX", F.col("opex")), row(1, "EXPLOITATION", "PRODUCTION FFB", F.col("volume")),
        row(2, "INVESTISSEMENT", "CAPEX", F.col("capex")), row(2, "INVESTISSEMENT", "PRODUCTION CPO", F.col("volume") / 4),
        row(3, "BUDGET", "Chiffre d'affaires", F.col("revenue") * 2),
    ]
    return y.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


MODEL_SQL = f"SELECT year::VARCHAR AS period, round(revenue, 2) AS revenue, round(opex, 2) AS opex, round(capex, 2) AS capex, round(volume, 2) AS volume, round(volume / 4, 2) AS out FROM ({YEARLY_SQL})"


@query(f"""SELECT 'revenue' AS role, 'EXPLOITATION' AS sheet, period, revenue AS value FROM ({MODEL_SQL}) UNION ALL SELECT 'opex', 'EXPLOITATION', period, opex FROM ({MODEL_SQL}) UNION ALL SELECT 'volume', 'EXPLOITATION', period, volume FROM ({MODEL_SQL})
UNION ALL SELECT 'capex', 'INVESTISSEMENT', period, capex FROM ({MODEL_SQL}) UNION ALL SELECT 'volume_secondary', 'INVESTISSEMENT', period, out FROM ({MODEL_SQL})""")
def model_roles(spark, sf_dir):
    series_ = _series(spark, sf_dir)
    return model.assembled(series_.where(model.pool(F.col("sheet")) == "actual")).select("role", "sheet", "period", "value")


@query(f"""SELECT period, round(revenue - opex, 4) AS margin, round(100 * ((revenue - opex) / revenue), 4) AS margin_pct, round(out / volume, 4) AS volume_ratio, round(revenue - opex - capex, 4) AS net_cash FROM ({MODEL_SQL})""")
def model_metrics(spark, sf_dir):
    roles = model.assembled(_series(spark, sf_dir).where(model.pool(F.col("sheet")) == "actual"))
    return model.metrics(roles).select("period", "margin", "margin_pct", "volume_ratio", F.round("net_cash", 4).alias("net_cash"))


@query("""WITH y AS (SELECT 'book ' || (l_suppkey % 10) AS book, l_suppkey % 10 AS k, year(l_shipdate)::VARCHAR AS period, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS volume FROM lineitem GROUP BY ALL)
SELECT book, period, round(revenue - CASE WHEN k % 2 = 0 THEN volume END, 4) AS margin, round(CASE WHEN k % 3 = 0 THEN volume / 4 END / volume, 4) AS volume_ratio FROM y""")
def model_books(spark, sf_dir):
    """Ten books of two sheets: costs stand in every second, a second volume in every third, and none lends to another."""
    k = F.col("l_suppkey") % 10
    y = read(spark, sf_dir, "lineitem").groupBy(k.alias("k"), F.year("l_shipdate").cast("string").alias("period")).agg(profile.exact_sum(F.col("l_extendedprice")).alias("revenue"), profile.exact_sum(F.col("l_quantity")).alias("volume"))
    row = lambda ord_, sheet, label, value: F.struct(F.lit(sheet).alias("chart"), F.lit(ord_).alias("ord"), F.lit(sheet).alias("sheet"), F.lit("year").alias("grain"), F.lit(label).alias("label"), value.alias("value"))
    parts = [row(1, "EXPLOITATION", "Chiffre d'affaires", F.col("revenue")), row(1, "EXPLOITATION", "PRODUCTION FFB", F.col("volume")), row(2, "COUTS", "OPEX", F.when(F.col("k") % 2 == 0, F.col("volume"))), row(2, "COUTS", "PRODUCTION CPO", F.when(F.col("k") % 3 == 0, F.col("volume") / 4))]
    series_ = y.select(F.concat(F.lit("book "), "k").alias("book"), "period", F.explode(F.array(*parts)).alias("x")).select("book", "period", "x.*").where("value is not null")
    return model.metrics(model.assembled(series_)).select("book", "period", "margin", "volume_ratio")


@query(f"SELECT 'revenue' AS role, 'EXPLOITATION' AS sheet, period, revenue AS value FROM ({MODEL_SQL}) UNION ALL SELECT 'volume', 'INVESTISSEMENT', period, out FROM ({MODEL_SQL})")
def model_pinned(spark, sf_dir):
    """Roles as pinned: one by label and sheet, one by a label that stands once, one that isn't there."""
    series_ = _series(spark, sf_dir)
    wanted = spark.createDataFrame([("revenue", "Chiffre d'affaires", "EXPLOITATION"), ("volume", "PRODUCTION CPO", None), ("area", "HA", None)], "role string, label string, sheet string")
    there = series_.groupBy("sheet", "label").agg(F.array_sort(F.collect_list("period")).alias("periods"))
    return model.pinned(series_, mapping.resolve(wanted, there)).select("role", "sheet", "period", "value")


@query("SELECT 'PRODUCTION CPO' AS actual, 'PRODUCTION CPO PREVUE' AS plan, 2 AS n UNION ALL SELECT r_name || ' SALES', 'BUDGET ' || r_name, CASE WHEN r_name LIKE '% %' THEN 2 ELSE 1 END FROM region")
def plan_pairs(spark, sf_dir):
    regions = read(spark, sf_dir, "region")
    label = lambda c, more: regions.select(c.alias("label")).unionByName(spark.createDataFrame([(more,)], "label string"))
    return series.match_plan(label(F.concat("r_name", F.lit(" SALES")), "PRODUCTION CPO"), label(F.concat(F.lit("BUDGET "), "r_name"), "PRODUCTION CPO PREVUE"))


WORDS_SQL = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-zÀ-ÿ]{{{{3,}}}}'), lambda t: upper(t)))"


@query(f"""WITH a AS (SELECT DISTINCT p_name || ' ' || p_type AS actual FROM part WHERE p_size % 2 = 0), p AS (SELECT p_name || ' ' || p_type || ' ' || p_brand AS plan, count(*) AS copies FROM part WHERE p_size % 2 = 1 GROUP BY 1),
aw AS (SELECT actual, {WORDS_SQL.format("actual").format()} AS w FROM a), pw AS (SELECT plan, copies, {WORDS_SQL.format("plan").format()} AS v FROM p),
x AS (SELECT actual, plan, copies, len(list_intersect(w, v)) AS n FROM aw, pw), m AS (SELECT actual, max(n) AS n FROM x WHERE n > 0 GROUP BY 1)
SELECT actual, min(plan) AS plan, n::INT AS n FROM x JOIN m USING (actual, n) GROUP BY actual, n HAVING sum(copies) = 1""")
def plan_words(spark, sf_dir):
    """Parts of even sizes as what happened, those of odd sizes as the plan: labels of some words each, matched by their rare ones."""
    part = read(spark, sf_dir, "part").withColumn("label", F.concat_ws(" ", "p_name", "p_type"))
    return series.match_plan(part.where("p_size % 2 = 0").select("label"), part.where("p_size % 2 = 1").select(F.concat_ws(" ", "label", "p_brand").alias("label")))


@query("""WITH c AS (SELECT n_name AS client, c_mktsegment AS segment, c_acctbal::DECIMAL(18,2) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT client, segment, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT client, count(*) AS customers, sum(v)::DOUBLE AS balance FROM c GROUP BY 1),
r AS (SELECT client, to_json({'totals': {'customers': customers, 'balance': balance}, 'segments': (SELECT list({'name': segment, 'n': n} ORDER BY segment) FROM s WHERE s.client = t.client)}) AS report FROM t)
SELECT client, (report ->> '$.totals.customers')::BIGINT AS customers, round((report ->> '$.totals.balance')::DOUBLE, 2) AS balance, report ->> '$.segments[0].name' AS first_segment, (report ->> '$.segments[1].n')::BIGINT AS second_n, report ->> '$.segments[9].name' AS tenth FROM r""")
def report_paths(spark, sf_dir):
    """A report for each nation's customers, stored as VARIANT, and read again by paths."""
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("client"), F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("v"))
    totals = F.struct(F.sum("n").alias("customers"), F.sum("v").cast("double").alias("balance"))
    made = reports.parsed(reports.bodies(rows, ["client"], {"totals": totals, "segments": F.array_sort(F.collect_list(F.struct("name", "n")))}))
    path = f"{folder(spark)}/reports-{uuid.uuid4().hex}"
    reports.save(made, path)
    found = reports.load(spark, path)
    return found.select("client", reports.at("$.totals.customers", "long").alias("customers"), F.round(reports.at("$.totals.balance", "double"), 2).alias("balance"), reports.at("$.segments[0].name").alias("first_segment"), reports.at("$.segments[1].n", "long").alias("second_n"), reports.at("$.segments[9].name").alias("tenth"))


@query(f"""WITH w AS (SELECT year, round(CASE WHEN year < 1997 THEN -1 ELSE 1 END * (revenue - opex - capex), 2) AS net FROM ({YEARLY_SQL})), r AS (SELECT year, round(sum(net) OVER (ORDER BY year ROWS UNBOUNDED PRECEDING), 4) AS running FROM w)
SELECT round(-least(min(running), 0.0), 4) AS bridge, arg_min(year, {{'r': running, 'y': year}}) AS bridge_period, CASE WHEN arg_min(running, year) < 0 THEN min(year) FILTER (running >= 0) END AS positive_from FROM r""")
def cash_turn(spark, sf_dir):
    net = F.round(F.when(F.col("year") < 1997, -1).otherwise(1) * (F.col("revenue") - F.col("opex") - F.col("capex")), 2)
    return series.cash_turn(series.walk(_yearly(spark, sf_dir).select("year", net.alias("net")), "year", "net"), "year")


@query(f"SELECT year, round(opex / volume, 4) AS unit_cost, round((opex * 2) / (volume * 3), 4) AS target, round(100 * ((opex / volume - (opex * 2) / (volume * 3)) / ((opex * 2) / (volume * 3))), 4) AS variance_pct FROM ({YEARLY_SQL})")
def unit_cost_budget(spark, sf_dir):
    y = _yearly(spark, sf_dir).select("year", "opex", "volume")
    return mapping.unit_cost_budget(y, y.select("year", (F.col("opex") * 2).alias("opex"), (F.col("volume") * 3).alias("volume")))


# Reports and publications

@query("SELECT o_orderpriority AS role, max(strftime(o_orderdate, '%Y-%m-%d')) AS period, arg_max(o_totalprice, {'d': o_orderdate, 'k': o_orderkey}) AS value FROM orders GROUP BY 1")
def stat_tiles(spark, sf_dir):
    """The last order's value of each priority; of orders of one day the last key's."""
    last = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("role"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period")).agg(F.max_by("o_totalprice", "o_orderkey").alias("value"))
    return report.stat_tiles(last)


@query("""WITH f AS (SELECT r_name AS subject, count(*) AS n, round(avg(c_acctbal), 2) AS size FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
items AS (SELECT 0 AS p, 'unreconciled relations' AS rule, subject, n::DOUBLE AS size FROM f WHERE subject < 'B' UNION ALL SELECT 4, 'capital bridge', subject, size FROM f WHERE size > 0
UNION ALL (SELECT 7, 'open gaps', subject, n::DOUBLE FROM f ORDER BY n DESC, subject LIMIT 2))
SELECT row_number() OVER (ORDER BY p, size DESC, subject)::INT AS rank, rule, subject, size FROM items QUALIFY rank <= 7""")
def executive_agenda(spark, sf_dir):
    joined = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sums = joined.groupBy(F.col("r_name").alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 2).alias("size"))
    none = F.lit(None).cast("double")
    facts = sums.select("subject", F.when(F.col("subject") < "B", F.col("n")).otherwise(0).alias("n_unreconciled"), none.alias("unit_cost_over_pct"), none.alias("attainment_pct"), F.lit(False).alias("is_spend"), none.alias("conversion_under_pct"), F.col("size").alias("capital_bridge"), F.lit(0).alias("n_exceptions"), none.alias("investment_share_pct"), F.col("n").alias("n_open_gaps"))
    return report.executive_agenda(facts)


@query("""WITH a AS (SELECT DISTINCT 'a' || doc_id AS analysis_id, doc_id AS d, (CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 + 2 ELSE 1 END)::INT AS version FROM documents)
SELECT analysis_id, version, d AS published_at, substr(sha256(analysis_id || '|' || version || '|' || d), 1, 32) AS token FROM a""")
def publications(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("a"), "doc_id").alias("analysis_id"), F.col("doc_id").alias("at")).distinct()
    before = docs.where("at % 3 = 0").select("analysis_id", (F.col("at") % 5 + 1).cast("int").alias("version"))
    return Store.published(before, docs).select("analysis_id", "version", "published_at", "token")


@query("""SELECT 'now' AS asked, c_custkey AS analysis_id, round(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END * c_acctbal, 2) AS balance FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT 'before', c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END * c_acctbal, 2) FROM customer UNION ALL SELECT 'first', c_custkey, round(c_acctbal, 2) FROM customer""")
def store_versions(spark, sf_dir):
    """Customers as analyses: stored, a third stored again, a fifth deleted with all that hangs on it, compacted, and read at three versions."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("analysis_id"), F.col("c_acctbal").alias("balance"))
    store = Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}")
    first = store.write({"analyses": rows, "published": rows.select("analysis_id")})
    before = store.upsert("analyses", ["analysis_id"], rows.where("analysis_id % 3 = 0").withColumn("balance", F.col("balance") * 2))
    store.cascade(rows.where("analysis_id % 5 = 0"), ["published"])
    store.compacted("analyses", ["analysis_id"])
    # what hangs on a deleted analysis is gone too
    now = store.latest("analyses", ["analysis_id"]).join(store.latest("published", ["analysis_id"]).select("analysis_id"), "analysis_id")
    as_of = lambda name, df: df.select(F.lit(name).alias("asked"), "analysis_id", F.round("balance", 2).alias("balance"))
    return as_of("now", now).unionByName(as_of("before", store.latest("analyses", ["analysis_id"], before))).unionByName(as_of("first", store.latest("analyses", ["analysis_id"], first)))


@query("""SELECT 'a' || o_custkey AS analysis_id, count(o_orderkey) AS n_opens, max(o_orderkey) AS last_opened FROM (SELECT c_custkey AS o_custkey FROM customer) LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders) USING (o_custkey) WHERE o_custkey % 2 = 0 GROUP BY 1""")
def publication_opens(spark, sf_dir):
    """Customers as publications, of which those with odd keys are closed; orders open them."""
    published = read(spark, sf_dir, "customer").select(F.concat(F.lit("a"), "c_custkey").alias("analysis_id"), F.col("c_custkey").alias("token"), (F.col("c_custkey") % 2 == 0).alias("is_open"))
    return Store.opens(published, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("token"), F.col("o_orderkey").alias("at")))


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) <= 3 AS allowed FROM events")
def throttled(spark, sf_dir):
    """Times count in whole seconds, rounded to the nearest, halves to the even one, as the SQL's cast of epoch() does."""
    seconds = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)).cast("long")
    log = read(spark, sf_dir, "events").select("user_id", "event_id", seconds.alias("at"))
    return Store.throttle(log, "user_id", "at").select("user_id", "event_id", "allowed")
