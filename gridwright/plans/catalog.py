"""All queries of the engine, by name, and their SQL counterparts.

Each query applies operators of the library to whole tables; each SQL text computes the same
rows independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions import cells as C
from gridwright.functions import vocabulary as V
from gridwright.operators import audit, journal, layout, orient, profile, report, series, story
from gridwright.sources import workbook
from gridwright.sources.scratch import written
from gridwright.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Typing and coercion

KIND_SQL = r"""CASE WHEN raw IS NULL OR trim(raw) = '' OR lower(trim(raw)) IN ('#div/0!','#n/a','#name?','#null!','#num!','#ref!','#value!','#error!') THEN 'blank'
 WHEN regexp_full_match(raw, '\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}[/.-]\d{1,2}[/.-]\d{1,2}') THEN 'date'
 WHEN regexp_full_match(replace(raw, ' ', ''), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?%*') THEN 'number' ELSE 'text' END"""


@query(rf"""
WITH v AS (
  SELECT unnest([{{'name': 'event_id', 'raw': event_id::VARCHAR}}, {{'name': 'event_type', 'raw': event_type}}, {{'name': 'day', 'raw': strftime(ts, '%Y-%m-%d')}}, {{'name': 'props', 'raw': props}},
                 {{'name': 'sparse', 'raw': CASE WHEN event_id % 3 = 0 THEN '#N/A' WHEN event_id % 3 = 1 THEN '  ' ELSE '12%' END}}], recursive := true)
  FROM events)
SELECT name, {KIND_SQL} AS kind, count(*) AS n FROM v GROUP BY ALL""")
def cell_kinds(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    sparse = F.when(F.col("event_id") % 3 == 0, "#N/A").when(F.col("event_id") % 3 == 1, "  ").otherwise("12%")
    texts = events.select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "props", sparse.alias("sparse"))
    long = profile.long_text(texts, texts.columns)
    return long.select("name", C.cell_kind(F.col("raw")).alias("kind")).groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, round(p_retailprice, 2) AS num FROM part")
def coerce_numbers(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    french = F.translate(F.format_number(F.round("p_retailprice", 2), 2), ",.", " ,")
    return part.select("p_partkey", C.coerce_number(french).alias("num"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS iso_year_first FROM orders")
def coerce_dates(spark, sf_dir):
    day = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", C.coerce_date(F.date_format(day, "dd/MM/yyyy")).cast("string").alias("iso"), C.coerce_date(F.date_format(day, "yyyy.MM.dd")).cast("string").alias("iso_year_first"))


@query("""SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day,
['janv.','févr.','mars','avr.','mai','juin','juil.','août','sept.','oct.','nov.','déc.'][month(o_orderdate)] || ' ' || year(o_orderdate) AS shown FROM orders""")
def month_labels(spark, sf_dir):
    periods = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period")).distinct()
    shown = periods.withColumn("shown", C.period_label(F.col("period"), "fr"))
    return shown.select("period", C.month_year(F.col("shown")).cast("string").alias("first_day"), "shown")


@query("""SELECT l_suppkey AS n, CASE WHEN l_suppkey < 26 THEN chr((65 + l_suppkey)::INT) WHEN l_suppkey < 702 THEN chr((65 + (l_suppkey - 26) // 26)::INT) || chr((65 + (l_suppkey - 26) % 26)::INT)
ELSE chr((65 + (l_suppkey - 702) // 676)::INT) || chr((65 + ((l_suppkey - 702) // 26) % 26)::INT) || chr((65 + (l_suppkey - 702) % 26)::INT) END || '7' AS ref, l_suppkey AS back
FROM (SELECT DISTINCT l_suppkey FROM lineitem)""")
def a1_references(spark, sf_dir):
    keys = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("n")).distinct()
    named = keys.withColumn("ref", C.a1(F.lit(6), F.col("n")))
    return named.select("n", "ref", C.parse_a1(F.col("ref"), exact=True)["col"].cast("long").alias("back"))


# Profiles

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


def _line_cells(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    shaped = [F.col(c).cast("decimal(18,2)").cast("string").alias(c) for c in LINE_NUMBERS] + ["l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate")]
    return profile.long_text(lines.select(*shaped), LINE)


def _numeric_profile(c: str) -> str:
    v = f"CAST({c} AS DECIMAL(18,2))"
    return f"SELECT '{c}' AS name, count(*) AS n_rows, 0::BIGINT AS n_blank, count(*) AS n_number, 0::BIGINT AS n_date, 0::BIGINT AS n_text, min({v})::DOUBLE AS min_value, max({v})::DOUBLE AS max_value, sum({v})::DOUBLE AS sum_value, count(*) FILTER ({v} = 0) AS n_zero, count(*) FILTER ({v} < 0) AS n_negative, 1.0::DOUBLE AS fill, round(sum({v})::DOUBLE / count(*), 4) AS mean_value, 'number' AS dtype FROM lineitem"


def _other_profile(c: str, kind: str) -> str:
    counts = "0::BIGINT AS n_number, count(*) AS n_date, 0::BIGINT AS n_text" if kind == "date" else "0::BIGINT AS n_number, 0::BIGINT AS n_date, count(*) AS n_text"
    return f"SELECT '{c}' AS name, count(*) AS n_rows, 0::BIGINT AS n_blank, {counts}, NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::DOUBLE AS sum_value, 0::BIGINT AS n_zero, 0::BIGINT AS n_negative, 1.0::DOUBLE AS fill, NULL::DOUBLE AS mean_value, '{kind}' AS dtype FROM lineitem"


PROFILE_SQL = " UNION ALL ".join([*map(_numeric_profile, LINE_NUMBERS), _other_profile("l_returnflag", "text"), _other_profile("l_linestatus", "text"), _other_profile("l_shipdate", "date")])


@query(PROFILE_SQL)
def column_profile(spark, sf_dir):
    return profile.column_profile(_line_cells(spark, sf_dir))


@query(f"""SELECT count(*) AS n_columns, round((sum(n_rows) - sum(n_blank))::DOUBLE / sum(n_rows), 4) AS cell_fill, count(*) FILTER (dtype = 'number') AS number_columns, count(*) FILTER (dtype = 'date') AS date_columns,
count(*) FILTER (dtype = 'text') AS text_columns, count(*) FILTER (dtype = 'mixed') AS mixed_columns, count(*) FILTER (dtype = 'empty') AS empty_columns FROM ({PROFILE_SQL})""")
def table_summary(spark, sf_dir):
    return profile.table_summary(profile.column_profile(_line_cells(spark, sf_dir)))


PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(f"""WITH v AS (SELECT unnest([{", ".join(f"{{'name': '{c}', 'raw': {c}::{'DECIMAL(18,2)::VARCHAR' if c == 'p_retailprice' else 'VARCHAR'}}}" for c in PART)}], recursive := true) FROM part),
c AS (SELECT name, raw, count(*) AS n FROM v GROUP BY ALL)
SELECT name, raw, n, row_number() OVER (PARTITION BY name ORDER BY n DESC, raw)::INT AS rank FROM c QUALIFY rank <= 5""")
def top_values(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(18,2)"))
    return profile.top_values(profile.long_text(part, PART))


@query("""WITH v AS (SELECT unnest([{'name': 'l_orderkey', 'raw': l_orderkey::VARCHAR}, {'name': 'l_linenumber', 'raw': l_linenumber::VARCHAR}, {'name': 'l_returnflag', 'raw': l_returnflag}], recursive := true) FROM lineitem),
c AS (SELECT name, count(DISTINCT raw) AS n FROM v GROUP BY name)
SELECT name, CASE WHEN n <= 1000 THEN n END AS n_distinct, n > 1000 AS capped FROM c""")
def distinct_capped(spark, sf_dir):
    return profile.distinct_capped(profile.long_text(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"]))


@query("""SELECT 'o_orderdate' AS name, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date,
CASE WHEN count(DISTINCT o_orderdate::DATE) <= 1000 THEN count(DISTINCT o_orderdate::DATE) END AS n_distinct, count(DISTINCT o_orderdate::DATE) > 1000 AS capped FROM orders""")
def date_stats(spark, sf_dir):
    days = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_orderdate"))
    return profile.date_stats(profile.long_text(days, ["o_orderdate"]))


@query("""WITH j AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
v AS (SELECT unnest([{'name': 'doc_id', 'raw': doc_id::VARCHAR}, {'name': 'quality', 'raw': quality::VARCHAR}, {'name': 'toxic', 'raw': toxic::VARCHAR}], recursive := true) FROM j)
SELECT name, count(*) FILTER (raw IS NULL OR trim(raw) = '') AS n_missing, round(100.0 * count(*) FILTER (raw IS NULL OR trim(raw) = '')::DOUBLE / count(*), 4) AS pct_missing FROM v GROUP BY name""")
def missingness(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return profile.missingness(profile.long_text(joined, ["doc_id", "quality", "toxic"]))


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS n_duplicates, count(*) FILTER (n > 1) AS n_groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(" UNION ALL ".join(f"SELECT name, n_distinct FROM (SELECT '{n}' AS name, count(DISTINCT {e}) AS n_distinct FROM customer) WHERE n_distinct <= 1" for n, e in [*((c, c) for c in CUSTOMER), ("one", "'x'"), ("none", "NULL"), ("one_in_many", "CASE WHEN c_custkey = 1 THEN 'y' END")]))
def constant_columns(spark, sf_dir):
    flagged = read(spark, sf_dir, "customer").withColumns({"one": F.lit("x"), "none": F.lit(None).cast("string"), "one_in_many": F.when(F.col("c_custkey") == 1, "y")})
    return profile.constant_columns(profile.long_text(flagged, [*CUSTOMER, "one", "none", "one_in_many"]))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG_SQL = "SELECT unnest([" + ", ".join(f"{{'name': '{c}', 'value': {c}}}" for c in NUMBERS) + "], recursive := true) FROM lineitem"


@query(f"""SELECT name, count(value) AS n, min(value) AS min_value, max(value) AS max_value, round(avg(value), 4) AS mean_value, round(median(value), 4) AS median_value, round(stddev_samp(value), 4) AS std_value, round(skewness(value), 3) AS skew FROM ({LONG_SQL}) GROUP BY name""")
def numeric_summary(spark, sf_dir):
    return profile.numeric_summary(profile.long_numbers(read(spark, sf_dir, "lineitem"), NUMBERS))


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT 'value' AS name, q1, q3, (SELECT count(*) FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM q""")
def iqr_outliers(spark, sf_dir):
    return profile.iqr_outliers(profile.long_numbers(read(spark, sf_dir, "events"), ["value"]))


PAIRS_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n_pairs, round(corr({a}, {b}), 4) AS r FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :])


@query(PAIRS_SQL)
def correlations(spark, sf_dir):
    return profile.correlations(read(spark, sf_dir, "lineitem"), NUMBERS)


@query(f"""SELECT CASE WHEN a = 'l_extendedprice' THEN b ELSE a END AS driver, n_pairs, r FROM ({PAIRS_SQL}) WHERE 'l_extendedprice' IN (a, b) ORDER BY abs(r) DESC, driver LIMIT 5""")
def top_drivers(spark, sf_dir):
    return profile.top_drivers(profile.correlations(read(spark, sf_dir, "lineitem"), NUMBERS), "l_extendedprice")


@query(f"""WITH c AS (SELECT row_number() OVER () AS ord, column_name AS name FROM (DESCRIBE SELECT * FROM orders)), m AS (SELECT *, regexp_matches(lower(name), '{V.TARGET_NAME}') AS hit FROM c)
SELECT coalesce(arg_min(name, ord) FILTER (hit), arg_max(name, ord)) AS target FROM m""")
def target_detection(spark, sf_dir):
    names = read(spark, sf_dir, "orders").columns
    return profile.target_column(spark.createDataFrame(list(enumerate(names)), "ord int, name string"))


@query("""SELECT c_mktsegment AS member, round(avg(o_totalprice), 4) AS mean_value, round(median(o_totalprice), 4) AS median_value, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def categorical_breakdown(spark, sf_dir):
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return profile.categorical_breakdown(joined, "c_mktsegment", "o_totalprice")


@query(f"""WITH m AS (SELECT count(*) AS n_rows, round(100.0 * count(*) FILTER (l.doc_id IS NULL)::DOUBLE / count(*), 4) AS pct FROM documents d LEFT JOIN labels l USING (doc_id)),
dup AS (SELECT sum(n)::DOUBLE AS n_rows, sum(n - 1)::DOUBLE AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, round(skewness(value), 3) AS skew, count(*) AS n FROM events),
o AS (SELECT 100.0 * (SELECT count(*) FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::DOUBLE / n AS pct, skew FROM q),
drivers AS (SELECT CASE WHEN a = 'l_extendedprice' THEN b ELSE a END AS driver, r FROM ({PAIRS_SQL}) WHERE 'l_extendedprice' IN (a, b)),
seg AS (SELECT c_mktsegment AS member, avg(o_totalprice) AS m, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT 'missing' AS kind, 'quality' AS subject, CASE WHEN pct >= 80 THEN 'low' WHEN pct >= 30 THEN 'high' WHEN pct >= 15 THEN 'medium' ELSE 'low' END AS severity, round(CASE WHEN pct >= 80 THEN 100 - pct ELSE pct END, 4) AS score FROM m WHERE pct >= 5 AND pct < 100
UNION ALL SELECT 'duplicates', 'rows', CASE WHEN 100 * n / n_rows > 5 THEN 'medium' ELSE 'low' END, round(100 * n / n_rows, 4) FROM dup WHERE n > 0
UNION ALL SELECT 'skew', 'value', 'low', round(abs(skew), 4) FROM o WHERE abs(skew) >= 1
UNION ALL SELECT 'outliers', 'value', CASE WHEN pct >= 5 THEN 'medium' ELSE 'low' END, round(pct, 4) FROM o WHERE pct >= 1
UNION ALL SELECT 'driver', driver, CASE WHEN abs(r) >= 0.7 THEN 'high' ELSE 'medium' END, round(100 * abs(r), 4) FROM drivers WHERE abs(r) BETWEEN 0.3 AND 0.995
UNION ALL (SELECT 'category', member, 'medium', 50.0 FROM seg ORDER BY round(m, 4) DESC, member LIMIT 1)""")
def insights_ranked(spark, sf_dir):
    docs, labels, events = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), read(spark, sf_dir, "events")
    missing = profile.missingness(profile.long_text(docs.join(labels, "doc_id", "left"), ["quality"])).join(docs.agg(F.count(F.lit(1)).alias("n_rows"))).select("name", "n_rows", F.col("pct_missing").alias("pct"))
    twice = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("k")).agg(F.sum("k").alias("n_rows"), F.sum(F.col("k") - 1).alias("n"))
    values = profile.long_numbers(events, ["value"])
    shapes = profile.numeric_summary(values).select("name", "n", "skew").join(profile.iqr_outliers(values).select("name", "n_outliers"), "name")
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n_rows = read(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n_rows"))
    split = profile.categorical_breakdown(joined, "c_mktsegment", "o_totalprice").join(n_rows).select("member", "n_rows", "n", "mean_value")
    return profile.insights(missing, twice, shapes, top_drivers(spark, sf_dir), split)


# Audit. The tables hold no relation of their own, so every line gets a unit price and a duty; one amount in a hundred is planted tenfold, one duty in ninety twice as high.

AUDITED = ["qty", "unit", "amount", "rate", "duty", "one"]


def _audited(spark, sf_dir):
    """Every line with a quantity, under a key of its own."""
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 0")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # in whole cents, so that no rounding depends on binary fractions
    cents = lines.select(key.alias("row_key"), "l_orderkey", F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("p"), F.round(F.col("l_discount") * 100).cast("long").alias("d"))
    priced = cents.withColumn("u", F.expr("(2 * p + q) div (2 * q)")).withColumn("m", F.expr("q * u * CASE WHEN l_orderkey % 100 = 7 THEN 10 ELSE 1 END"))
    duty = F.expr("(2 * m * (d + 5) + 100) div 200 * CASE WHEN l_orderkey % 90 = 11 THEN 2 ELSE 1 END")
    money = lambda c, name: (c / 100.0).cast("double").alias(name)
    return priced.select("row_key", "l_orderkey", F.col("q").cast("double").alias("qty"), money(F.col("u"), "unit"), money(F.col("m"), "amount"), money(F.col("d") + 5, "rate"), money(duty, "duty"), F.lit(1.0).alias("one"))


AUDITED_SQL = """SELECT row_key, l_orderkey, q::DOUBLE AS qty, u / 100.0::DOUBLE AS unit, m / 100.0::DOUBLE AS amount, (d + 5) / 100.0::DOUBLE AS rate, ((2 * m * (d + 5) + 100) // 200 * CASE WHEN l_orderkey % 90 = 11 THEN 2 ELSE 1 END) / 100.0::DOUBLE AS duty FROM (
SELECT *, q * u * CASE WHEN l_orderkey % 100 = 7 THEN 10 ELSE 1 END AS m FROM (SELECT *, (2 * p + q) // (2 * q) AS u FROM (
SELECT l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey AS row_key, l_orderkey, l_quantity::BIGINT AS q, round(l_extendedprice * 100)::BIGINT AS p, round(l_discount * 100)::BIGINT AS d
FROM lineitem WHERE l_quantity > 0)))"""
BROKEN_SQL = f"""SELECT row_key, 'amount' AS target, 'qty' AS a, 'unit' AS b, qty * unit AS expected, amount AS actual, amount - qty * unit AS delta FROM ({AUDITED_SQL}) WHERE abs(qty * unit - amount) > greatest(0.01, 0.01 * abs(amount))
UNION ALL SELECT row_key, 'duty', 'amount', 'rate', amount * rate, duty, duty - amount * rate FROM ({AUDITED_SQL}) WHERE abs(amount * rate - duty) > greatest(0.01, 0.01 * abs(duty))"""


@query(f"SELECT row_key, target, a, b, round(expected, 4) AS expected, actual, round(delta, 4) AS delta FROM ({BROKEN_SQL})")
def product_audit(spark, sf_dir):
    rows = written(_audited(spark, sf_dir), "audited")
    bad = audit.product_mismatches(rows, "row_key", AUDITED, audit.products(rows, AUDITED))
    return bad.withColumns({"expected": F.round("expected", 4), "delta": F.round("delta", 4)})


@query(f"""WITH n AS (SELECT count(*) AS n FROM ({AUDITED_SQL})), bad AS (SELECT target || '=' || a || '*' || b AS relation, row_key, delta FROM ({BROKEN_SQL})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY abs(round(delta, 4)) DESC, row_key) AS k FROM bad)
SELECT relation, n AS n_checked, n - count(*) AS n_matched, count(*) AS n_mismatched, round(sum(abs(delta::DECIMAL(18,4)))::DOUBLE, 2) AS delta_total, string_agg(row_key, ',' ORDER BY row_key) FILTER (k <= 10) AS listed, 'mismatch' AS status, 'high' AS confidence
FROM ranked, n GROUP BY relation, n""")
def product_findings(spark, sf_dir):
    rows = written(_audited(spark, sf_dir), "audited")
    found = audit.products(rows, AUDITED)
    named = F.concat(F.col("target"), F.lit("="), F.col("a"), F.lit("*"), F.col("b"))
    bad = audit.product_mismatches(rows, "row_key", AUDITED, found).withColumn("relation", named).withColumn("delta", F.round("delta", 4))
    out = audit.findings(bad, found.select(named.alias("relation"), "n_checked", "n_matched"))
    return out.withColumn("listed", F.array_join("listed", ","))


MONTHS = [f"m{m:02d}" for m in range(1, 13)]


def _monthly(spark, sf_dir):
    """Priorities by year with a column for each month and a total, of which a planted one is wrong."""
    orders = read(spark, sf_dir, "orders").select(F.concat_ws("|", "o_orderpriority", F.year("o_orderdate").cast("string")).alias("row_key"), F.month("o_orderdate").alias("m"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    sums = orders.groupBy("row_key").agg(*[F.coalesce(F.sum(F.when(F.col("m") == i + 1, F.col("v"))), F.lit(0)).cast("double").alias(c) for i, c in enumerate(MONTHS)], F.sum("v").cast("double").alias("total"))
    return sums.withColumn("total", F.when(F.col("row_key").endswith("|1997"), F.round(F.col("total") * 2, 2)).otherwise(F.col("total")))


@query("""WITH s AS (SELECT o_orderpriority || '|' || year(o_orderdate) AS row_key, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS expected FROM orders GROUP BY 1)
SELECT row_key, round(expected, 2) AS expected, round(expected * 2, 2) AS actual, round(round(expected * 2, 2) - expected, 2) AS delta FROM s WHERE row_key LIKE '%|1997'""")
def row_sum_audit(spark, sf_dir):
    rows = _monthly(spark, sf_dir)
    return audit.row_sum_mismatches(rows, "row_key", "total", MONTHS)


@query("""SELECT 'total' AS target, 'm01+m02+m03+m04+m05+m06+m07+m08+m09+m10+m11+m12' AS parts, count(*) AS n_checked, count(*) FILTER (row_key NOT LIKE '%|1997') AS n_matched
FROM (SELECT DISTINCT o_orderpriority || '|' || year(o_orderdate) AS row_key FROM orders)""")
def row_sum_relations(spark, sf_dir):
    columns = [*MONTHS, "row_key", "total"]
    return audit.row_sums(_monthly(spark, sf_dir), columns, [c != "row_key" for c in columns])


def _totalled(spark, sf_dir):
    """Balances by nation with a row for each region's total, of which one is planted twice as high, and one for all."""
    base = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cube = base.rollup("n_regionkey", "n_name").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"), F.count(F.lit(1)).cast("double").alias("customers"))
    order = [F.col("n_regionkey").asc_nulls_last(), F.col("n_name").asc_nulls_last()]
    from pyspark.sql import Window as W

    wrong = F.when((F.col("n_regionkey") == 2) & F.col("n_name").isNull(), 2).otherwise(1)
    ranked = cube.withColumn("rec", F.row_number().over(W.orderBy(*order))).withColumn("balance", F.col("balance") * wrong)
    label = F.when(F.col("n_regionkey").isNull(), "Grand total").when(F.col("n_name").isNull(), "Total region").otherwise(F.col("n_name"))
    return ranked.select("rec", label.alias("label"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("num")) for c in ("balance", "customers")])).alias("x")).select(F.lit("r").alias("region"), "rec", "label", "x.*")


#: The sheet that `_totalled` makes, and what its rows of totals should hold: a region's own sum, or that of all nations.
TOTALLED_SQL = """WITH n AS (SELECT n_regionkey AS r, n_name AS nation, sum(c_acctbal::DECIMAL(18,2)) AS balance, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
sums AS (SELECT r, 'section' AS base, sum(balance)::DOUBLE AS balance, sum(customers)::DOUBLE AS customers, count(*) AS n FROM n GROUP BY r UNION ALL SELECT NULL, 'grand', sum(balance)::DOUBLE, sum(customers)::DOUBLE, count(*) FROM n),
placed AS (SELECT *, (sum(n + 1) FILTER (r IS NOT NULL) OVER (ORDER BY r NULLS LAST ROWS UNBOUNDED PRECEDING) + CASE WHEN r IS NULL THEN 1 ELSE 0 END)::BIGINT AS rec FROM sums),
t AS (SELECT rec, base, unnest([{'column': 'balance', 'expected': balance, 'actual': CASE WHEN r = 2 THEN 2 * balance ELSE balance END}, {'column': 'customers', 'expected': customers, 'actual': customers}], recursive := true) FROM placed)"""


@query(f"""{TOTALLED_SQL} SELECT 'r' AS region, rec, base, "column", round(expected, 2) AS expected, round(actual, 2) AS actual FROM t""")
def totals_rows(spark, sf_dir):
    return audit.totals_rows(_totalled(spark, sf_dir)).withColumns({"expected": F.round("expected", 2), "actual": F.round("actual", 2)})


@query(f"""{TOTALLED_SQL} SELECT 'r' AS region, rec, count(*) AS n_checked, count(*) FILTER (hit) AS n_matched, CASE WHEN bool_and(hit) THEN 'ok' ELSE 'mismatch' END AS status, round(sum(CASE WHEN hit THEN 0 ELSE abs(actual - expected) END), 2) AS delta_total
FROM (SELECT *, abs(expected - actual) <= greatest(0.01, 0.01 * abs(actual)) AS hit FROM t) GROUP BY rec""")
def column_sum_check(spark, sf_dir):
    return audit.column_sum_check(audit.totals_rows(_totalled(spark, sf_dir)))


@query("""WITH d AS (SELECT date_trunc('month', o_orderdate) AS m, o_orderdate::DATE AS d, o_orderstatus AS s, o_totalprice::DECIMAL(18,2) AS v FROM orders),
n AS (SELECT m FROM d GROUP BY m HAVING count(DISTINCT d) >= 2),
f AS (SELECT m, 'all' AS "column", sum(v)::DOUBLE AS v FROM d SEMI JOIN n USING (m) GROUP BY 1 UNION ALL SELECT m, s, sum(v)::DOUBLE FROM d SEMI JOIN n USING (m) GROUP BY 1, 2)
SELECT strftime(m, '%Y-%m') AS month, "column", round(v, 2) AS expected, round(v, 2) AS actual FROM f""")
def totals_by_month(spark, sf_dir):
    """All orders by day, sums by status, with a row behind each month that no label calls a total; of two days at least, it is one."""
    orders = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    sums = orders.select("month", "d", "v", F.explode(F.array(F.lit("all"), "o_orderstatus")).alias("column")).groupBy("month", "d", "column").agg(F.sum("v").alias("v"))
    totals = sums.groupBy("month", "column").agg(F.sum("v").alias("v"))
    place = lambda day: F.datediff(day, F.lit("1970-01-01")) * 2
    days = sums.select("month", place(F.col("d")).alias("rec"), "column", F.col("v").cast("double").alias("num"))
    ends = totals.select("month", (place(F.last_day(F.to_date(F.concat("month", F.lit("-01"))))) + 1).alias("rec"), "column", F.col("v").cast("double").alias("num"))
    facts = days.unionByName(ends).withColumns({"region": F.lit("orders"), "label": F.col("month")})
    found = audit.totals_rows(facts)
    months = ends.select("month", "rec").distinct()
    return found.join(months, "rec").select("month", "column", F.round("expected", 2).alias("expected"), F.round("actual", 2).alias("actual"))


@query(f"""WITH t AS ({AUDITED_SQL}), b AS (
  SELECT target || '=' || a || '*' || b AS relation, target AS col, row_key FROM ({BROKEN_SQL})
  UNION ALL SELECT 'copy', 'unit', row_key FROM t WHERE qty > 48),
ok AS (SELECT row_key FROM t WHERE abs(amount * rate - duty) <= greatest(0.01, 0.01 * abs(duty)))
SELECT relation, col AS "column", row_key, n_breaking, n_breaking < 2 AND NOT (relation = 'amount=qty*unit' AND row_key IN (SELECT row_key FROM ok)) AS suggest
FROM (SELECT *, count(*) OVER (PARTITION BY row_key) AS n_breaking FROM b)""")
def cross_examine(spark, sf_dir):
    """Rows that break a product, or were copied wrongly; an amount that the duty agrees with is not suggested."""
    rows = written(_audited(spark, sf_dir), "audited")
    found = audit.products(rows, AUDITED)
    named = F.concat(F.col("target"), F.lit("="), F.col("a"), F.lit("*"), F.col("b")).alias("relation")
    broken = audit.product_mismatches(rows, "row_key", AUDITED, found).select(named, F.col("target").alias("column"), "row_key")
    copied = rows.where("qty > 48").select(F.lit("copy").alias("relation"), F.lit("unit").alias("column"), "row_key")
    agreed = rows.where(C.close(F.col("amount") * F.col("rate"), F.col("duty"))).select(F.lit("duty=amount*rate").alias("relation"), F.lit("amount").alias("column"), "row_key")
    return audit.cross_examine(broken.unionByName(copied), agreed)


@query("""WITH f AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL),
h AS (SELECT *, substr(sha1(a || '|' || left(b, 0)), 1, 12) AS base_id FROM f)
SELECT a, b, n, CASE WHEN row_number() OVER w = 1 THEN base_id ELSE base_id || '-' || row_number() OVER w END AS finding_id FROM h WINDOW w AS (PARTITION BY base_id ORDER BY a, b, n)""")
def finding_ids(spark, sf_dir):
    found = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return audit.finding_ids(found.withColumn("none", F.lit("")), ["a", "none"]).drop("none")


@query(f"""WITH f AS (SELECT row_key AS finding_id, CASE WHEN abs(qty * unit - amount) > greatest(0.01, 0.01 * abs(amount)) THEN 'mismatch' ELSE 'ok' END AS status, l_orderkey % 3 = 0 AS decided, abs(round(amount - qty * unit, 2)::DECIMAL(18,2)) AS delta FROM ({AUDITED_SQL}))
SELECT count(*) AS n_total, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status <> 'ok' AND NOT decided) AS n_open, coalesce(sum(delta) FILTER (status <> 'ok' AND NOT decided), 0)::DOUBLE AS at_stake, max(finding_id) FILTER (decided) AS last_decided FROM f""")
def findings_rollup(spark, sf_dir):
    rows = _audited(spark, sf_dir)
    expected = F.col("qty") * F.col("unit")
    found = rows.select(F.col("row_key").alias("finding_id"), F.when(C.close(expected, F.col("amount")), "ok").otherwise("mismatch").alias("status"), F.abs(F.round(F.col("amount") - expected, 2).cast("decimal(18,2)")).alias("delta_total"))
    decisions = rows.where("l_orderkey % 3 = 0").select(F.col("row_key").alias("finding_id"), F.lit("accepted").alias("decision"), F.col("row_key").alias("decided_at")).distinct()
    return audit.rollup(found, decisions).withColumn("at_stake", F.col("at_stake").cast("double"))


# Stories

TREND_SQL = "SELECT strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 60"


@query(TREND_SQL)
def trend_monthly(spark, sf_dir):
    return story.monthly_trend(read(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


@query(f"""WITH t AS ({TREND_SQL}), l AS (SELECT *, lag(value) OVER (ORDER BY period) AS previous FROM t)
SELECT period, value, previous, round(value - previous, 2) AS delta, round(100 * ((value - previous) / abs(previous)), 4) AS pct FROM l""")
def mom_change(spark, sf_dir):
    return story.month_change(trend_monthly(spark, sf_dir))


@query(f"""WITH t AS ({TREND_SQL})
SELECT a.period, a.value, b.value AS previous, round(a.value - b.value, 2) AS delta, round(100 * ((a.value - b.value) / abs(b.value)), 4) AS pct
FROM t a JOIN t b ON strftime((a.period || '-01')::DATE - INTERVAL 12 MONTH, '%Y-%m') = b.period""")
def yoy_change(spark, sf_dir):
    return story.year_change(trend_monthly(spark, sf_dir))


@query("""WITH t AS (SELECT year(o_orderdate)::INT AS year, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY 1), l AS (SELECT *, lag(value) OVER (ORDER BY year) AS previous FROM t)
SELECT year, value, previous, round(100 * ((value - previous) / abs(previous)), 4) AS pct FROM l""")
def trend_yearly(spark, sf_dir):
    return story.yearly_trend(read(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


@query("""WITH s AS (SELECT p_brand AS member, sum(p_retailprice::DECIMAL(18,2)) AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, member) AS k FROM s)
SELECT CASE WHEN k <= 12 THEN member ELSE '(others)' END AS member, sum(v)::DOUBLE AS value, sum(n)::BIGINT AS n, least(k, 13)::INT AS shown FROM r GROUP BY 1, 4""")
def by_dimension_fold(spark, sf_dir):
    return story.by_dimension(read(spark, sf_dir, "part"), "p_brand", "p_retailprice")


SPEND_SQL = "SELECT o_custkey AS entity, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY 1"


@query(f"""WITH v AS ({SPEND_SQL}) SELECT 'top' AS side, row_number() OVER (ORDER BY value DESC, entity)::INT AS rank, entity, value FROM v QUALIFY rank <= 5
UNION ALL SELECT 'bottom', row_number() OVER (ORDER BY value, entity)::INT AS rank, entity, value FROM v QUALIFY rank <= 5""")
def movers(spark, sf_dir):
    spend = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(profile.exact_sum(F.col("o_totalprice")).alias("value"))
    return story.movers(spend)


@query("SELECT user_id AS entity, arg_max(value, {'ts': ts, 'id': event_id}) AS value FROM events GROUP BY 1")
def latest_level(spark, sf_dir):
    return story.latest_level(read(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id")


@query("WITH l AS (SELECT user_id AS entity, arg_max(value, {'ts': ts, 'id': event_id}) AS value FROM events GROUP BY 1) SELECT 'bottom' AS side, row_number() OVER (ORDER BY value, entity)::INT AS rank, entity, value FROM l QUALIFY rank <= 5")
def low_stock(spark, sf_dir):
    return story.movers(latest_level(spark, sf_dir)).where("side = 'bottom'")


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), g AS (SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS gap FROM d)
SELECT median(gap)::DOUBLE AS median_gap, CASE WHEN median(gap) <= 1.5 THEN 'day' WHEN median(gap) <= 8 THEN 'week' WHEN median(gap) <= 45 THEN 'month' WHEN median(gap) <= 120 THEN 'quarter' ELSE 'year' END AS grain FROM g""")
def time_grain(spark, sf_dir):
    return story.time_grain(read(spark, sf_dir, "orders"), "o_orderdate")


@query("""SELECT * FROM (VALUES ('o_orderkey', 'measure', 'amount', NULL), ('o_orderstatus', 'dimension', NULL, NULL), ('o_totalprice', 'measure', 'amount', NULL), ('o_orderdate', 'time', NULL, NULL), ('o_orderpriority', 'dimension', NULL, NULL)) t(name, class, measure_kind, role)""")
def schema_classes(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    cells = profile.long_text(orders, orders.columns)
    typed = profile.column_profile(cells).select("name", "dtype", "n_rows", (F.col("n_rows") - F.col("n_blank")).alias("n_filled"))
    counts = cells.groupBy("name").agg(F.count_distinct("raw").alias("n_distinct"), F.count_if(F.col("raw").isin("0", "1")).alias("n_binary"))
    return story.schema_classes(typed.join(counts, "name"))


_quoted = lambda text: "'" + text.replace("'", "''") + "'"
STOP_SQL = "[" + ", ".join(map(_quoted, V.STOP_WORDS)) + "]"
INTENT_SQL = ", ".join(f"({_quoted(n)}, {_quoted(asks)}, {_quoted(takes)}, {str(n in V.GENERIC_INTENTS).lower()})" for n, asks, takes in V.INTENTS)
TOKENS_SQL = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{3,}}')), lambda t: NOT list_contains(" + STOP_SQL + ", t))"


@query(f"""WITH q(question) AS (VALUES ('How is revenue trending over time?'), ('Which region has the most revenue?'), ('Which products are out of stock?'), ('Tell me a joke')),
s AS (SELECT 0 AS ord, 'orders' AS story, 'Order revenue region ' || string_agg(r_name, ' ' ORDER BY r_name) AS words FROM region UNION ALL SELECT 1, 'stock', 'Stock inventory products'),
m(story, metric, available) AS (VALUES ('orders', 'headline', true), ('orders', 'trend', true), ('orders', 'by_region', true), ('orders', 'yoy', false), ('stock', 'low_stock', true)),
i(intent, asks, takes, generic) AS (VALUES {INTENT_SQL}),
p AS (SELECT question, ord, story, {TOKENS_SQL.format("question")} AS t, {TOKENS_SQL.format("words")} AS v FROM q, s),
a AS (SELECT question, ord, story, len(list_filter(t, lambda x: list_contains(v, x) OR (len(x) >= 5 AND len(list_filter(v, lambda y: len(y) >= 5 AND left(y, 5) = left(x, 5))) > 0))) AS affinity FROM p),
h AS (SELECT a.*, takes, NOT generic OR affinity > 0 AS is_open FROM a JOIN i ON regexp_matches(question, asks, 'i')),
k AS (SELECT DISTINCT question, ord, metric, available FROM h JOIN m USING (story) WHERE regexp_matches(metric, takes, 'i') AND (is_open OR NOT available)),
n AS (SELECT question, ord, count(*) FILTER (available) AS n, count(*) FILTER (NOT available) AS lacks, string_agg(metric, ',' ORDER BY metric) FILTER (available) AS ids FROM k GROUP BY ALL),
r AS (SELECT a.*, coalesce(n, 0) AS n, coalesce(lacks, 0) AS lacks, coalesce(ids, '') AS ids FROM a LEFT JOIN n USING (question, ord) QUALIFY row_number() OVER (PARTITION BY question ORDER BY coalesce(n, 0) DESC, affinity DESC, ord) = 1)
SELECT question, CASE WHEN n > 0 THEN story END AS story, ids AS metrics, CASE WHEN n > 0 AND lacks > 0 THEN 'partial' WHEN n > 0 THEN 'answerable' WHEN lacks > 0 THEN 'unanswerable' ELSE 'unmatched' END AS status FROM r""")
def brief_match(spark, sf_dir):
    regions = read(spark, sf_dir, "region").agg(F.concat_ws(" ", F.sort_array(F.collect_list("r_name"))).alias("words"))
    stories = regions.select(F.lit(0).alias("ord"), F.lit("orders").alias("story"), F.concat(F.lit("Order revenue region "), F.col("words")).alias("words")).unionByName(spark.createDataFrame([(1, "stock", "Stock inventory products")], "ord int, story string, words string"))
    metrics = spark.createDataFrame([("orders", "headline", True), ("orders", "trend", True), ("orders", "by_region", True), ("orders", "yoy", False), ("stock", "low_stock", True)], "story string, metric string, available boolean")
    questions = spark.createDataFrame([("How is revenue trending over time?",), ("Which region has the most revenue?",), ("Which products are out of stock?",), ("Tell me a joke",)], "question string")
    return story.match_questions(questions, stories, metrics)


# Series, models and plans

@query("""WITH f AS (SELECT n_name AS label, year(o_orderdate)::INT AS period, o_totalprice::DECIMAL(18,2) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT label, row_number() OVER (ORDER BY sum(abs(v)) DESC, label) AS k FROM f GROUP BY label)
SELECT CASE WHEN k <= 5 THEN label ELSE 'Other' END AS label, period, sum(v)::DOUBLE AS value FROM f JOIN r USING (label) GROUP BY 1, 2""")
def series_topk_other(spark, sf_dir):
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    facts = joined.select(F.col("n_name").alias("label"), F.year("o_orderdate").alias("period"), F.col("o_totalprice").cast("decimal(18,2)").alias("v")).groupBy("label", "period").agg(F.sum("v").alias("value"))
    return series.top_series(facts)


@query("SELECT year(l_shipdate)::INT AS year, 'l_quantity' AS name, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS value FROM lineitem GROUP BY 1 UNION ALL SELECT year(l_shipdate)::INT, 'l_extendedprice', sum(l_extendedprice::DECIMAL(18,2))::DOUBLE FROM lineitem GROUP BY 1")
def year_rows_series(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    return profile.long_numbers(lines, ["l_quantity", "l_extendedprice"], "year").groupBy("year", "name").agg(profile.exact_sum(F.col("value")).alias("value"))


@query("""WITH v AS (SELECT unnest([{'ord': 0, 'name': 'l_quantity', 'value': l_quantity}, {'ord': 1, 'name': 'ship_year', 'value': year(l_shipdate)::DOUBLE}, {'ord': 2, 'name': 'l_linenumber', 'value': l_linenumber::DOUBLE}], recursive := true) FROM lineitem),
s AS (SELECT ord, name, avg(CASE WHEN value BETWEEN 1900 AND 2100 AND value = floor(value) THEN 1.0 ELSE 0.0 END) AS share, count(DISTINCT value) AS n FROM v GROUP BY ALL) SELECT arg_min(name, ord) AS year_column FROM s WHERE share >= 0.9 AND n >= 3""")
def year_column(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_quantity", F.year("l_shipdate").alias("ship_year"), "l_linenumber")
    ords = spark.createDataFrame(list(enumerate(lines.columns)), "ord int, name string")
    return series.year_column(profile.long_numbers(lines, lines.columns).join(F.broadcast(ords), "name"))


@query("SELECT 'm' || lpad(month(o_orderdate)::VARCHAR, 2, '0') AS name, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY 1")
def column_profile_chart(spark, sf_dir):
    return profile.long_numbers(_monthly(spark, sf_dir), MONTHS).groupBy("name").agg(profile.exact_sum(F.col("value")).alias("value"))


@query("""SELECT user_id, event_id, CASE WHEN event_id % 10 >= 7 THEN event_type END AS label, last_value(CASE WHEN event_id % 10 >= 7 THEN event_type END IGNORE NULLS) OVER w AS filled,
event_id % 10 < 7 AND last_value(CASE WHEN event_id % 10 >= 7 THEN event_type END IGNORE NULLS) OVER w IS NOT NULL AS is_ghost
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def ffill_labels(spark, sf_dir):
    sparse = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 10 >= 7, F.col("event_type")).alias("label"))
    return layout.filled_down(sparse, "user_id", "event_id", "label")


@query("""SELECT * FROM (VALUES ('c','Chiffre d''affaires','revenue'),('c','OPEX','opex'),('c','Budget OPEX','budget'),('c','Prix par kg','price'),('c','Production CPO','volume'),('c','FFB harvest','volume_secondary'),('c','Personnel Production','headcount'),('c','Surface (ha)','area')) t(chart,label,role)""")
def role_tags(spark, sf_dir):
    labels = [("Chiffre d'affaires", 9.0), ("OPEX", 5.0), ("OPEX total", 50.0), ("Budget OPEX", 6.0), ("Prix par kg", 1.0), ("Cost / tonne", 2.0), ("Production CPO", 8.0), ("FFB harvest", 7.0), ("Personnel Production", 3.0), ("Surface (ha)", 2.0)]
    return series.tag_roles(spark.createDataFrame([("c", *x) for x in labels], "chart string, label string, total double")).select("chart", "label", "role")


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS period FROM orders), s AS (SELECT period FROM y WHERE period > (SELECT min(period) FROM y) AND period < (SELECT max(period) FROM y)),
f AS (SELECT year(l_shipdate)::INT AS period, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY 1)
SELECT period, CASE WHEN period = 1997 THEN NULL ELSE v END AS aligned FROM s LEFT JOIN f USING (period)""")
def period_align(spark, sf_dir):
    spine = _full_years(spark, sf_dir)
    return series.align(spine, _ship_years(spark, sf_dir))


def _full_years(spark, sf_dir):
    """The years of orders but for the first and the last, which may be incomplete. A row for each year."""
    from pyspark.sql import Window as W

    years = read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("period")).distinct()
    every = W.partitionBy(F.lit(0).alias("all"))
    return years.withColumns({"lo": F.min("period").over(every), "hi": F.max("period").over(every)}).where("period > lo and period < hi").select("period")


def _ship_years(spark, sf_dir):
    """Quantities by year of shipping, with 1997 twice."""
    sums = read(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("period")).agg(profile.exact_sum(F.col("l_quantity")).alias("value"))
    return sums.unionByName(sums.where("period = 1997"))


@query("WITH y AS (SELECT DISTINCT year(o_orderdate) AS period FROM orders) SELECT count(DISTINCT year(l_shipdate)) AS n_outside FROM lineitem WHERE NOT (year(l_shipdate) > (SELECT min(period) FROM y) AND year(l_shipdate) < (SELECT max(period) FROM y))")
def period_outside(spark, sf_dir):
    spine = _full_years(spark, sf_dir)
    return series.outside(spine, _ship_years(spark, sf_dir))


YEARLY_SQL = """SELECT year(l_shipdate)::INT AS year, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue, sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(18,2))::DOUBLE AS capex,
sum(l_extendedprice::DECIMAL(18,2) * l_tax::DECIMAL(18,2))::DOUBLE AS opex, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS volume FROM lineitem GROUP BY 1"""


def _yearly(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    money = lambda c: F.col(c).cast("decimal(18,2)")
    total = lambda c, name: F.sum(c).cast("double").alias(name)
    price = money("l_extendedprice")
    return lines.groupBy(F.year("l_shipdate").alias("year")).agg(total(price, "revenue"), total(price * money("l_discount"), "capex"), total(price * money("l_tax"), "opex"), total(money("l_quantity"), "volume"))


@query(f"""SELECT year, round(revenue - opex, 4) AS margin, round(100 * ((revenue - opex) / revenue), 4) AS margin_pct, round(opex / volume, 4) AS opex_per_volume, round(revenue / volume, 4) AS revenue_per_volume, NULL::DOUBLE AS opex_per_area, round(revenue - opex - capex, 4) AS net_cash FROM ({YEARLY_SQL})""")
def derived_metrics(spark, sf_dir):
    return series.derived_metrics(_yearly(spark, sf_dir)).select("year", "margin", "margin_pct", "opex_per_volume", "revenue_per_volume", "opex_per_area", "net_cash")


@query(f"""WITH y AS (SELECT year, CASE WHEN year <> 1999 THEN round(CASE WHEN year < 1997 THEN -1 ELSE 1 END * (revenue - opex - capex), 2) END AS net FROM ({YEARLY_SQL}))
SELECT year, net, CASE WHEN year < 1999 THEN round(sum(net) OVER (ORDER BY year ROWS UNBOUNDED PRECEDING), 4) END AS running FROM y""")
def net_cash_walk(spark, sf_dir):
    sign = F.when(F.col("year") < 1997, -1).otherwise(1)
    net = F.when(F.col("year") != 1999, F.round(sign * (F.col("revenue") - F.col("opex") - F.col("capex")), 2))
    return series.walk(_yearly(spark, sf_dir).select("year", net.alias("net")), "year", "net")


@query("""SELECT sum(l_tax::DECIMAL(18,2))::DOUBLE AS a_total, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS b_total, count(*) AS n_periods,
round(100 * (sum(l_tax::DECIMAL(18,2))::DOUBLE / (sum(l_tax::DECIMAL(18,2))::DOUBLE + sum(l_extendedprice::DECIMAL(18,2))::DOUBLE)), 4) AS a_share FROM lineitem WHERE l_linenumber <> 3""")
def cash_split(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("tax"), F.col("l_extendedprice").alias("price"))
    return series.split_share(lines, "tax", "price")


@query("""WITH a AS (SELECT o_orderpriority AS role, strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS actual FROM orders GROUP BY 1, 2),
j AS (SELECT a.role, a.period, a.actual, round(b.actual * 1.1, 2) AS plan FROM a JOIN a b ON a.role = b.role AND strftime((a.period || '-01')::DATE - INTERVAL 12 MONTH, '%Y-%m') = b.period)
SELECT role, period, actual, plan, round(100 * (sum(actual::DECIMAL(18,2)) OVER (PARTITION BY role)::DOUBLE / sum(plan::DECIMAL(18,2)) OVER (PARTITION BY role)::DOUBLE), 4) AS total_pct, round(100 * (actual / plan), 4) AS pct FROM j""")
def plan_vs_actual(spark, sf_dir):
    actual = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("role"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(profile.exact_sum(F.col("o_totalprice")).alias("value"))
    next_year = F.date_format(F.add_months(F.to_date(F.concat("period", F.lit("-01"))), 12), "yyyy-MM")
    return series.plan_vs_actual(actual, actual.select("role", next_year.alias("period"), F.round(F.col("value") * 1.1, 2).alias("value")))


@query("""WITH m AS (SELECT o_orderpriority AS role, month(o_orderdate)::INT AS month, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY 1, 2, 3),
p AS (SELECT role, month, v FROM m WHERE y = 1996), a AS (SELECT role, round(sum(v::DECIMAL(18,2))::DOUBLE, 2) AS actual_to_date FROM m WHERE y = 1997 AND month <= 5 GROUP BY 1),
t AS (SELECT role, sum(v::DECIMAL(18,2))::DOUBLE AS plan_year, sum(v::DECIMAL(18,2)) FILTER (month <= 5)::DOUBLE AS phased FROM p GROUP BY 1)
SELECT role, plan_year, actual_to_date, round(100 * (actual_to_date / plan_year), 4) AS pct, round(100 * (phased / plan_year), 4) AS expected_pct, 'monthly plan' AS rule FROM t JOIN a USING (role)""")
def plan_progress(spark, sf_dir):
    months = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("role"), F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("y")).agg(profile.exact_sum(F.col("o_totalprice")).alias("value"))
    plan = months.where("y = 1996").select("role", "month", "value")
    year = plan.groupBy("role").agg(profile.exact_sum(F.col("value")).alias("value"))
    return series.plan_progress(months.where("y = 1997 and month <= 5").select("role", "month", "value"), year, plan)


#: The relative difference of two expressions, as SQL.
APART_SQL = "round(max(CASE WHEN greatest(abs({a}), abs({b})) = 0 THEN 0.0 ELSE abs({a} - ({b})) / greatest(abs({a}), abs({b})) END), 6)"


def _identity(name: str, a: str, b: str, most: float) -> str:
    worst = APART_SQL.format(a=a, b=b)
    return f"SELECT '{name}' AS identity, {worst} AS worst, count(*) AS n, {worst} <= {most} AS ok FROM ({YEARLY_SQL})"


@query(" UNION ALL ".join([_identity("margin", "(revenue - opex)", "(revenue - opex)", 0.01), _identity("revenue", "revenue", "((revenue / volume) * volume)", 0.02), _identity("budget", "opex", "(opex * 2)", 0.6)]))
def mapping_identities(spark, sf_dir):
    y = _yearly(spark, sf_dir)
    return series.identities(y.select("revenue", "opex", "volume", (F.col("revenue") - F.col("opex")).alias("margin"), (F.col("revenue") / F.col("volume")).alias("price"), (F.col("opex") * 2).alias("budget")))


@query(f"SELECT round(sum(opex::DECIMAL(18,2))::DOUBLE / sum(volume::DECIMAL(18,2))::DOUBLE, 4) AS blended, count(*) AS n FROM ({YEARLY_SQL}) WHERE year <> 1998")
def blended_unit_cost(spark, sf_dir):
    return report.blended_unit_cost(_yearly(spark, sf_dir).withColumn("opex", F.when(F.col("year") != 1998, F.col("opex"))))


@query("""WITH t AS (SELECT o_orderpriority AS role, sum(o_totalprice::DECIMAL(18,2)) FILTER (year(o_orderdate) = 1997)::DOUBLE AS a, sum(o_totalprice::DECIMAL(18,2)) FILTER (year(o_orderdate) = 1996)::DOUBLE AS p FROM orders GROUP BY 1)
SELECT role, round(100 * (a / p), 4) AS pct, CASE WHEN 100 * (a / p) < 70 THEN 'bad' WHEN 100 * (a / p) < 100 THEN 'warn' ELSE 'good' END AS state FROM t""")
def kpi_tiles(spark, sf_dir):
    year = lambda y: profile.exact_sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")))
    return report.tiles(read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("role")).agg(year(1997).alias("actual"), year(1996).alias("plan")))


@query("""WITH t AS (SELECT sum(o_totalprice::DECIMAL(18,2)) FILTER (year(o_orderdate) = 1996)::DOUBLE AS plan, sum(o_totalprice::DECIMAL(18,2)) FILTER (year(o_orderdate) = 1997 AND month(o_orderdate) <= 5)::DOUBLE AS done FROM orders)
SELECT plan AS plan_total, done AS actual_total, 7::BIGINT AS remaining, round((plan - done) / 7, 1) AS required FROM t""")
def outlook_runrate(spark, sf_dir):
    months = read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("month")).agg(profile.exact_sum(F.col("o_totalprice")).alias("value"))
    return report.outlook(months.where("y = 1996").select("month", "value"), months.where("y = 1997 and month <= 5").select("month", "value"))


# Layout: tables become sheets and are found again

@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def roundtrip_extract_tidy(spark, sf_dir):
    regions, cells = orient.orient(layout.encode(read(spark, sf_dir, "nation"), "nation", ["n_nationkey"], top=0))
    facts = orient.tidy_tables(cells, regions)
    wide = facts.groupBy("row").agg(*[F.max(F.when(F.col("name") == c, F.col("raw"))).alias(c) for c in ("n_nationkey", "n_name", "n_regionkey")])
    return wide.drop("row")


@query("SELECT o_orderpriority AS label, year(o_orderdate)::VARCHAR AS period, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2")
def roundtrip_extract_matrix(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    # one column a year: as many as the table has, a small set
    years = [str(y) for (y,) in orders.select(F.year("o_orderdate").alias("y")).where("y is not null").distinct().orderBy("y").collect()]
    if not years:
        return spark.createDataFrame([], "label string, period string, value double")
    table = orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(*[F.nullif(F.count_if(F.year("o_orderdate") == int(y)), F.lit(0)).alias(y) for y in years])
    regions, cells = orient.orient(layout.encode(table, "matrix", ["priority"]))
    return orient.cross_tab_facts(cells, regions).select("label", "period", "value")


def _side_by_side(spark, sf_dir):
    return layout.encode(read(spark, sf_dir, "nation"), "sheet", ["n_nationkey"]).unionByName(layout.encode(read(spark, sf_dir, "region"), "sheet", ["r_regionkey"], left=5))


@query("""WITH n AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r)
SELECT 'sheet' AS sheet, 0::BIGINT AS r0, greatest(n, r)::BIGINT AS r1, 0 AS c0, 6 AS c1, (3 * (n + 1) + 2 * (r + 1))::BIGINT AS n_cells FROM n""")
def bounding_boxes(spark, sf_dir):
    return layout.bounding_boxes(_side_by_side(spark, sf_dir))


@query("SELECT * FROM (VALUES ('sheet', 1, 0::BIGINT, 2::BIGINT), ('sheet', 2, 5::BIGINT, 6::BIGINT)) t(sheet, island, first, last)")
def panels(spark, sf_dir):
    return layout.islands(_side_by_side(spark, sf_dir)).select("sheet", F.col("island").cast("int").alias("island"), "first", "last")


@query("""SELECT 'nation' AS sheet, count(*) + 1 AS n_rows, 3 AS n_cols, count(*) + 1 AS filled_rows, 3::BIGINT AS filled_cols, 3 * (count(*) + 1) AS n_cells, 1.0::DOUBLE AS fill, 0::BIGINT AS header_row FROM nation
UNION ALL SELECT 'supplier', count(*) + 1, 4, count(*) + 1, 4::BIGINT, 4 * (count(*) + 1), 1.0::DOUBLE, 0::BIGINT FROM supplier""")
def inventory(spark, sf_dir):
    cells = layout.encode(read(spark, sf_dir, "nation"), "nation", ["n_nationkey"]).unionByName(layout.encode(read(spark, sf_dir, "supplier"), "supplier", ["s_suppkey"]))
    return layout.inventory(cells)


@query("""SELECT 'nation' AS sheet, 'B' || (n_nationkey + 2) AS ref, n_name AS raw FROM nation UNION ALL SELECT 'nation', 'ZZ1', NULL UNION ALL SELECT 'nation', 'junk', NULL""")
def trace_cells(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    cells = layout.encode(nation, "nation", ["n_nationkey"])
    refs = nation.select(F.lit("nation").alias("sheet"), F.concat(F.lit("B"), F.col("n_nationkey") + 2).alias("ref"))
    return layout.trace(cells, refs.unionByName(spark.createDataFrame([("nation", "ZZ1"), ("nation", "junk")], "sheet string, ref string")))


@query("""WITH c AS (SELECT n_nationkey + 1 AS r, unnest([{'col': 0, 'raw': n_nationkey::VARCHAR}, {'col': 1, 'raw': n_name}, {'col': 2, 'raw': n_regionkey::VARCHAR}], recursive := true) FROM nation)
SELECT r::BIGINT AS row, col, raw FROM c WHERE r BETWEEN 8 AND 12""")
def trace_excerpt(spark, sf_dir):
    return layout.excerpt(layout.encode(read(spark, sf_dir, "nation"), "nation", ["n_nationkey"]), 10, 1).select("row", "col", "raw")


# Journals: events are a ledger

def _ledger(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    zero = F.lit(0.0)
    out = F.when(F.col("event_id") % 50 == 0, zero).otherwise(F.round(F.abs("value"), 2))
    code = F.when(F.col("event_id") % 97 == 0, "Banque").otherwise(F.col("event_type"))
    return e.select(F.concat(F.lit("j"), F.col("user_id") % 3).alias("j"), F.col("event_id").alias("seq"), F.col("ts").cast("date").alias("d"), code.alias("code"), "user_id", zero.alias("inC"), zero.alias("outC"), zero.alias("inU"), out.alias("outU"))


LEDGER_SQL = """SELECT 'j' || (user_id % 3) AS j, event_id AS seq, ts::DATE AS d, CASE WHEN event_id % 97 = 0 THEN 'Banque' ELSE event_type END AS code, user_id, CASE WHEN event_id % 50 = 0 THEN 0.0 ELSE round(abs(value), 2) END AS outU FROM events"""


@query(f"SELECT j, seq FROM ({LEDGER_SQL}) WHERE outU = 0")
def journal_zero(spark, sf_dir):
    return journal.zero_rows(_ledger(spark, sf_dir)).select("j", "seq")


@query(f"SELECT j, seq, outU FROM ({LEDGER_SQL}) WHERE code = 'Banque' AND outU > 0")
def journal_transfer(spark, sf_dir):
    return journal.transfers_as_spend(_ledger(spark, sf_dir)).select("j", "seq", "outU")


def _codes(spark, sf_dir):
    """Codes of the glossary: the event types but for the last two."""
    return read(spark, sf_dir, "events").select(F.upper("event_type").alias("code")).distinct().orderBy("code").limit(3)


CODES_SQL = "SELECT upper(event_type) AS code FROM events GROUP BY 1 ORDER BY 1 LIMIT 3"


@query(f"SELECT lower(code) AS code, count(*) AS n, sum(outU::DECIMAL(18,2))::DOUBLE AS out_usd FROM ({LEDGER_SQL}) WHERE lower(code) NOT IN (SELECT lower(code) FROM ({CODES_SQL})) GROUP BY 1")
def journal_unknown(spark, sf_dir):
    return journal.unknown_codes(_ledger(spark, sf_dir), _codes(spark, sf_dir))


@query(f"""SELECT j, seq, previous::DATE::VARCHAR AS previous FROM (SELECT *, lag(d) OVER (PARTITION BY j ORDER BY seq) AS previous FROM (SELECT j, seq, CASE WHEN seq % 500 = 7 THEN d - 60 ELSE d END AS d FROM ({LEDGER_SQL}))) WHERE d < previous""")
def journal_order(spark, sf_dir):
    """One date in five hundred is planted two months early."""
    rows = _ledger(spark, sf_dir).withColumn("d", F.when(F.col("seq") % 500 == 7, F.date_sub("d", 60)).otherwise(F.col("d")))
    return journal.out_of_order(rows).select("j", "seq", F.col("previous").cast("string").alias("previous"))


@query(f"""WITH l AS (SELECT j, seq, outU, 100000.0 - (seq % 1000) AS bal FROM ({LEDGER_SQL})), x AS (SELECT *, lag(bal) OVER (PARTITION BY j ORDER BY seq) - outU AS expected FROM l)
SELECT j, seq, bal, round(expected, 2) AS expected FROM x WHERE abs(bal - expected) > 1""")
def journal_balance(spark, sf_dir):
    rows = _ledger(spark, sf_dir).withColumn("bal", F.lit(100000.0) - (F.col("seq") % 1000))
    return journal.balance_breaks(rows, "inU", "outU").select("j", "seq", "bal", "expected")


@query(f"""WITH h AS (SELECT j, seq, d, substr(sha1(j || '|' || code || '|' || user_id), 1, 16) AS row_hash FROM ({LEDGER_SQL}) WHERE outU <> 0)
SELECT j, seq, row_hash FROM h QUALIFY row_number() OVER (PARTITION BY row_hash ORDER BY d, j, seq) > 1""")
def journal_dupes(spark, sf_dir):
    return journal.duplicates(_ledger(spark, sf_dir), F.col("j"), F.col("code"), F.col("user_id").cast("string")).select("j", "seq", "row_hash")


MONTH_CODES_SQL = f"""WITH l AS (SELECT upper(code) AS code, strftime(d, '%Y-%m') AS month, outU::DECIMAL(18,2) AS v FROM ({LEDGER_SQL})), c AS ({CODES_SQL}),
s AS (SELECT coalesce(c.code, 'UNMAPPED') AS code, month, sum(v)::DOUBLE AS out_usd FROM l LEFT JOIN c USING (code) GROUP BY 1, 2)
SELECT c.code, m.month, coalesce(s.out_usd, 0.0) AS out_usd FROM c CROSS JOIN (SELECT DISTINCT month FROM l) m LEFT JOIN s ON s.code = c.code AND s.month = m.month
UNION ALL SELECT code, month, out_usd FROM s WHERE code = 'UNMAPPED'"""


@query(MONTH_CODES_SQL)
def journal_code_month(spark, sf_dir):
    return journal.code_months(_ledger(spark, sf_dir).withColumn("code", F.upper("code")), _codes(spark, sf_dir))


@query(f"""WITH a AS (SELECT sum(outU::DECIMAL(18,2))::DOUBLE AS journal FROM ({LEDGER_SQL})), b AS (SELECT sum(out_usd::DECIMAL(18,2))::DOUBLE AS aggregated FROM ({MONTH_CODES_SQL}))
SELECT journal, aggregated, abs(journal - aggregated) <= 1 AS ok FROM a, b""")
def journal_tieout(spark, sf_dir):
    return journal.tie_out(_ledger(spark, sf_dir), journal_code_month(spark, sf_dir))


@query(f"""WITH RECURSIVE l AS (SELECT strftime(d, '%Y-%m') AS month, d, j, seq, outU, 0.0 AS outC FROM ({LEDGER_SQL})),
h AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY month, d, j, seq) AS k FROM l WHERE seq % 10 = 0 AND outU > 0), s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY d, j, seq) AS s FROM l WHERE seq % 10 <> 0),
c AS MATERIALIZED (SELECT k, list(s ORDER BY s) AS ss FROM h JOIN s ON h.month = s.month AND (abs(s.outU - h.outU) < 0.5 OR abs(s.outC - h.outU * 2250.0) < 1200.0) GROUP BY k),
z AS MATERIALIZED (SELECT max(k) AS n FROM h), walk AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS hit, []::BIGINT[] AS used UNION ALL
  SELECT k, hit, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END FROM (SELECT w.k + 1 AS k, used, list_filter(ss, lambda x: NOT list_contains(used, x))[1] AS hit FROM walk w LEFT JOIN c ON c.k = w.k + 1 WHERE w.k < (SELECT n FROM z)))
SELECT month, j, seq, outU AS out_usd FROM h JOIN walk USING (k) WHERE hit IS NULL""")
def journal_orphans(spark, sf_dir):
    rows = _ledger(spark, sf_dir)
    return journal.orphans(rows.where("seq % 10 = 0"), rows.where("seq % 10 <> 0"), 2250.0)


# Storage, JSON and streams

@query("SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, coalesce(CASE WHEN user_id % 7 <> 0 THEN 'client ' || (user_id % 7) END, 'General') AS client, count(*) AS n FROM events GROUP BY ALL")
def upload_stats(spark, sf_dir):
    client = F.coalesce(F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("client "), F.col("user_id") % 7)), F.lit("General"))
    day = F.to_date("ts")
    return read(spark, sf_dir, "events").groupBy(day.cast("string").alias("day"), C.week_start(day).cast("string").alias("week"), client.alias("client")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1")
def content_dedupe(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return workbook.content_dedupe(files).withColumnRenamed("path", "doc_id")


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def props_json(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT user_id, ts, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR AS gap FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n_events FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return streams.sessions(read(spark, sf_dir, "events"), "6 hours").select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n_events")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1, 2")
def event_trend(spark, sf_dir):
    return streams.trend(read(spark, sf_dir, "events"), "1 day").select(F.date_format("started", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
