"""Column profiles and exploratory statistics, each in one aggregation over long cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions import vocabulary as V
from gridwright.functions.cells import FOLD, coerce_date, coerce_number, stripped, typed
from gridwright.operators import quantiles as Q
from gridwright.sources.scratch import written


def long_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, raw): the columns' values as text. Nothing is shuffled."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("raw")) for c in columns])).alias("x")).select("x.*")


def long_numbers(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """(keys, name, value): the columns' values as doubles."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(*keys, "x.*")


def exact_sum(c: Column, scale: int = 2) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double")


#: Counts that add up over parts of a table.
COUNTS = ["n_rows", "n_blank", "n_number", "n_date", "n_text", "n_zero", "n_negative"]


def profile_parts(cells: DataFrame) -> DataFrame:
    """What a part of a table says of each column, from (name, raw), in sums, least and greatest values that `merged_parts` adds up."""
    # each different value is typed once, however many rows have it
    different = typed(cells.groupBy("name", "raw").agg(F.count(F.lit(1)).alias("n")))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return different.groupBy("name").agg(
        F.sum("n").alias("n_rows"),
        *[of(F.col("kind") == k).alias(f"n_{k}") for k in ("blank", "number", "date", "text")],
        F.min("num").alias("min_value"), F.max("num").alias("max_value"), F.sum(F.col("num").cast("decimal(18,2)") * F.col("n")).cast("decimal(38,2)").alias("sum_value"),
        of(F.col("num") == 0).alias("n_zero"), of(F.col("num") < 0).alias("n_negative"),
    )


def merged_parts(parts: DataFrame) -> DataFrame:
    """The parts of one table, added up."""
    return parts.groupBy("name").agg(*[F.sum(c).alias(c) for c in COUNTS], F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("sum_value").cast("decimal(38,2)").alias("sum_value"))


def profile_of(parts: DataFrame) -> DataFrame:
    """Kinds, fill, type and number statistics of each column, from the parts of the whole table."""
    filled = F.col("n_rows") - F.col("n_blank")
    share = lambda k: F.col(f"n_{k}") >= V.DOMINANT * filled
    return parts.withColumn("sum_value", F.col("sum_value").cast("double")).withColumns({
        "fill": F.round(filled / F.col("n_rows"), 4),
        "mean_value": F.round(F.try_divide(F.col("sum_value"), F.col("n_number")), 4),
        "dtype": F.when(filled == 0, "empty").when(share("number"), "number").when(share("date"), "date").when(share("text"), "text").otherwise("mixed"),
    })


def column_profile(cells: DataFrame) -> DataFrame:
    """Kinds, fill, type and number statistics of each column, from (name, raw)."""
    return profile_of(profile_parts(cells))


def table_summary(profile: DataFrame) -> DataFrame:
    """One row for a table, from its columns' profiles."""
    return profile.agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.round(F.sum(F.col("n_rows") - F.col("n_blank")) / F.sum("n_rows"), 4).alias("cell_fill"),
        *[F.count_if(F.col("dtype") == k).alias(f"{k}_columns") for k in ("number", "date", "text", "mixed", "empty")],
    )


def top_values(cells: DataFrame, most: int = V.TOP_VALUES) -> DataFrame:
    """The most frequent texts of each column; ties go by the text."""
    counted = cells.where(F.col("raw").isNotNull()).groupBy("name", "raw").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("name").orderBy(F.desc("n"), "raw")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def distinct_capped(cells: DataFrame, cap: int = V.DISTINCT_CAP) -> DataFrame:
    """Different values of each column, null beyond the cap."""
    n = cells.groupBy("name").agg(F.count_distinct("raw").alias("n"))
    return n.select("name", F.when(F.col("n") <= cap, F.col("n")).alias("n_distinct"), (F.col("n") > cap).alias("capped"))


def date_stats(cells: DataFrame, cap: int = V.DISTINCT_CAP) -> DataFrame:
    """Dates of each column; how many different ones is null beyond the cap, and `capped` says so."""
    dated = cells.withColumn("d", coerce_date(F.col("raw")))
    n = F.count_distinct("d")
    return dated.groupBy("name").agg(F.count("d").alias("n"), F.min("d").cast("string").alias("first_date"), F.max("d").cast("string").alias("last_date"), F.when(n <= cap, n).alias("n_distinct"), (n > cap).alias("capped"))


def missingness(cells: DataFrame) -> DataFrame:
    missing = F.count_if(F.col("raw").isNull() | (stripped(F.col("raw")) == ""))
    return cells.groupBy("name").agg(missing.alias("n_missing"), F.round(100 * missing / F.count(F.lit(1)), 4).alias("pct_missing"))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows repeat another's keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"), F.count_if(F.col("n") > 1).alias("n_groups"))


def constant_columns(cells: DataFrame) -> DataFrame:
    return cells.groupBy("name").agg(F.count_distinct("raw").alias("n_distinct")).where("n_distinct <= 1")


def numeric_summary(values: DataFrame) -> DataFrame:
    """Exact statistics of (name, value): the skewness is adjusted for bias. Two passes: one for the moments and the median's bracket, one that counts inside it."""
    n = F.count("value").cast("double")
    skew = F.when((n > 2) & (F.stddev_samp("value") > 0), F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2))
    moments = [
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.round(F.avg("value"), 4).alias("mean_value"),
        F.round(F.stddev_samp("value"), 4).alias("std_value"), F.round(skew, 3).alias("skew"),
    ]
    known = written(Q.brackets(values, ["name"], [0.5], *moments), "numeric-summary")
    middle = Q.from_brackets(values, known, ["name"], [0.5], ["median_value"])
    # a row for each column
    return known.join(middle, "name").select("name", "n", "min_value", "max_value", "mean_value", F.round("median_value", 4).alias("median_value"), "std_value", "skew")


def iqr_outliers(values: DataFrame, factor: float = 1.5) -> DataFrame:
    """Values beyond the quartiles by `factor` times their distance. Bounds are a row for each column."""
    known = written(Q.brackets(values, ["name"], [0.25, 0.75]), "quartile-brackets")
    quartiles = Q.from_brackets(values, known, ["name"], [0.25, 0.75], ["q1", "q3"]).join(known.select("name", "n"), "name")
    bounds = written(quartiles.withColumn("iqr", F.col("q3") - F.col("q1")).where("n >= 4 and iqr <> 0"), "quartiles")
    out = values.join(bounds, "name").where((F.col("value") < F.col("q1") - factor * F.col("iqr")) | (F.col("value") > F.col("q3") + factor * F.col("iqr")))
    return bounds.join(out.groupBy("name").agg(F.count(F.lit(1)).alias("found")), "name", "left").select("name", "q1", "q3", F.coalesce("found", F.lit(0)).alias("n_outliers"))


def correlations(df: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """Pearson's r of each pair of columns over the rows that have both; one pass, a row for each pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b, c: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double"))
    found = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(both(a, b, a)).alias("n_pairs"), F.corr(both(a, b, a), both(a, b, b)).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    long = found.select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")
    return long.where(F.col("n_pairs") >= least).select("a", "b", "n_pairs", F.round("r", 4).alias("r"))


def top_drivers(pairs: DataFrame, target: str, most: int = 5) -> DataFrame:
    """The columns that go with the target most, by |r|."""
    other = F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a"))
    mine = pairs.where((F.col("a") == target) | (F.col("b") == target)).select(other.alias("driver"), "n_pairs", "r")
    return mine.orderBy(F.desc(F.abs("r")), "driver").limit(most)


def numeric_columns(cells: DataFrame, most: int = 15) -> DataFrame:
    """(ord, name, n_parsed) of the columns that count as numeric, the first `most`: three values and a twentieth of all rows at least can be read.

    `cells`: ord, name, raw.
    """
    counted = cells.groupBy("ord", "name").agg(F.count(coerce_number(F.col("raw"))).alias("n_parsed"), F.count(F.lit(1)).alias("n_rows"))
    fits = counted.where(F.col("n_parsed") >= F.greatest(F.lit(3.0), 0.05 * F.col("n_rows")))
    return fits.orderBy("ord").limit(most).select("ord", "name", "n_parsed")


def target_column(names: DataFrame) -> DataFrame:
    """Of (ord, name), the first name of a target, else the last."""
    hit = F.col("name").rlike(FOLD + V.TARGET_NAME)
    return names.agg(F.coalesce(F.min_by(F.when(hit, F.col("name")), F.when(hit, F.col("ord"))), F.max_by("name", "ord")).alias("target"))


def categorical_breakdown(df: DataFrame, by: str, value: str, members: int = 20, most: int = 10) -> DataFrame:
    """Mean, median and count of a value by member, the highest means first; nothing if there are more members than `members`."""
    values = df.where(F.col(by).isNotNull()).select(F.col(by).alias("member"), F.col(value).cast("double").alias("value"))
    # one more than the members that are shown is enough to know
    few = values.select("member").distinct().limit(members + 1).collect()
    small = values if len(few) <= members else values.where("false")
    known = written(Q.brackets(small, ["member"], [0.5], F.round(F.avg("value"), 4).alias("mean_value")), "members")
    middle = Q.from_brackets(small, known, ["member"], [0.5], ["median_value"])
    shown = known.join(middle, "member").select("member", "mean_value", F.round("median_value", 4).alias("median_value"), "n")
    return shown.orderBy(F.desc("mean_value"), "member").limit(most)


SEVERITY = {"high": 3, "medium": 2, "low": 1}


def insights(missing: DataFrame, duplicates: DataFrame, shapes: DataFrame, drivers: DataFrame, breakdown: DataFrame, most: int = 25) -> DataFrame:
    """Rules over profiles: (kind, subject, severity, score), the gravest first.

    `missing`: name, n_rows, pct. `duplicates`: n_rows, n. `shapes`: name, n, skew, n_outliers.
    `drivers`: driver, n_pairs, r. `breakdown`: member, n_rows, n.
    """
    row = lambda kind, subject, severity, score: [F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), severity.alias("severity"), F.round(score.cast("double"), 4).alias("score")]
    by_score = W.partitionBy("kind").orderBy(F.desc("score"), "subject")
    pct = F.col("pct")
    gaps = missing.where((pct >= 5) & (pct < 100) & (F.col("n_rows") >= 5)).select(*row("missing", F.col("name"), F.when(pct >= 80, "low").when(pct >= 30, "high").when(pct >= 15, "medium").otherwise("low"), F.when(pct >= 80, 100 - pct).otherwise(pct)))
    gaps = gaps.withColumn("k", F.row_number().over(by_score)).where("k <= 3").drop("k")
    share = 100 * F.col("n") / F.col("n_rows")
    twice = duplicates.where("n > 0").select(*row("duplicates", F.lit("rows"), F.when(share > 5, "medium").otherwise("low"), share))
    skewed = shapes.where((F.abs("skew") >= 1) & (F.col("n") >= 10)).select(*row("skew", F.col("name"), F.lit("low"), F.abs("skew")))
    out = 100 * F.col("n_outliers") / F.col("n")
    wild = shapes.where((out >= 1) & (F.col("n") >= 10)).select(*row("outliers", F.col("name"), F.when(out >= 5, "medium").otherwise("low"), out))
    r = F.abs("r")
    led = drivers.where((F.col("n_pairs") >= 10) & r.between(0.3, 0.995)).select(*row("driver", F.col("driver"), F.when(r >= 0.7, "high").otherwise("medium"), 100 * r))
    first = breakdown.orderBy(F.desc("mean_value"), "member").limit(1)
    split = first.where("n_rows >= 10 and n >= 3").select(*row("category", F.col("member"), F.lit("medium"), F.lit(50.0)))
    grave = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    every = gaps.unionByName(twice).unionByName(skewed).unionByName(wild).unionByName(led).unionByName(split)
    return every.orderBy(F.desc(grave), F.desc("score"), "kind", "subject").limit(most)
