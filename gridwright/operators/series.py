"""Series over periods: folding, roles, alignment, derived metrics, plans and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions import vocabulary as V
from gridwright.functions.cells import FOLD, identity_tokens, role
from gridwright.sources.scratch import written


def top_series(facts: DataFrame, most: int = 5) -> DataFrame:
    """(label, period, value) with all but the largest series, by the sum of |value|, folded into Other."""
    size = facts.groupBy("label").agg(F.sum(F.abs(F.col("value").cast("decimal(18,2)"))).alias("size"))
    top = size.orderBy(F.desc("size"), "label").limit(most).select("label", F.lit(True).alias("shown"))
    named = facts.join(F.broadcast(top), "label", "left").withColumn("label", F.when(F.col("shown"), F.col("label")).otherwise("Other"))
    return named.groupBy("label", "period").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


def year_column(values: DataFrame, low: int = 1900, high: int = 2100) -> DataFrame:
    """The first column of (ord, name, value) that holds years: nine in ten whole and within bounds, three different at least."""
    fits = F.col("value").between(low, high) & (F.col("value") == F.floor("value"))
    ratio = values.where("value is not null").groupBy("ord", "name").agg(F.avg(fits.cast("double")).alias("share"), F.count_distinct("value").alias("n"))
    return ratio.where("share >= 0.9 and n >= 3").agg(F.min_by("name", "ord").alias("year_column"))


def with_roles(series: DataFrame, by: list[str]) -> DataFrame:
    """`series` (by, label, total, …) with `role`: of each chart (`by`) the largest series of a role, derived ones only where alone; null for all others.

    The next largest of the volumes is volume_secondary.
    """
    named = series.withColumns({"__role": role(F.col("label")), "__derived": F.col("label").rlike(FOLD + V.DERIVED_SERIES)})
    k = F.row_number().over(W.partitionBy(*by, "__role").orderBy("__derived", F.desc(F.abs("total")), "label"))
    second = (F.col("__k") == 2) & (F.col("__role") == "volume") & ~F.col("__derived")
    tag = F.when(second, "volume_secondary").when(F.col("__k") == 1, F.col("__role"))
    return named.withColumn("__k", k).withColumn("role", tag).drop("__role", "__derived", "__k")


def tag_roles(series: DataFrame) -> DataFrame:
    """(chart, label, total, role) of the series that have a role in their chart."""
    return with_roles(series, ["chart"]).where("role is not null").select("chart", "label", "total", "role")


def align(spine: DataFrame, foreign: DataFrame) -> DataFrame:
    """The foreign values on the spine's periods; a period that the foreign series has twice gives null."""
    single = foreign.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("v")).select("period", F.when(F.col("n") == 1, F.col("v")).alias("aligned"))
    return spine.join(single, "period", "left")


def outside(spine: DataFrame, foreign: DataFrame) -> DataFrame:
    """How many foreign periods the spine doesn't have."""
    return foreign.join(spine, "period", "left_anti").agg(F.count_distinct("period").alias("n_outside"))


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.round(scale * F.try_divide(a, F.when(b != 0, b)), 4)


def derived_metrics(df: DataFrame) -> DataFrame:
    """Margins, unit costs and variances from columns named by role; null where a part is."""
    c = {r: F.col(r) if r in df.columns else F.lit(None).cast("double") for r in ("revenue", "opex", "capex", "budget", "volume", "volume_secondary", "area")}
    margin = c["revenue"] - c["opex"]
    return df.withColumns({
        "margin": F.round(margin, 4), "margin_pct": ratio(margin, c["revenue"], 100), "opex_per_volume": ratio(c["opex"], c["volume"]), "revenue_per_volume": ratio(c["revenue"], c["volume"]),
        "opex_per_area": ratio(c["opex"], c["area"]), "revenue_per_area": ratio(c["revenue"], c["area"]), "volume_ratio": ratio(c["volume_secondary"], c["volume"]),
        "opex_per_volume_out": ratio(c["opex"], c["volume_secondary"]), "opex_budget_variance_pct": ratio(c["opex"] - c["budget"], c["budget"], 100),
        "net_cash": F.when(c["capex"] != 0, F.round(margin - c["capex"], 4)),
    })


def walk(df: DataFrame, order: str, value: str) -> DataFrame:
    """A running sum that ends at the first gap. One series, a row for each period."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    alive = F.count_if(F.col(value).isNull()).over(w) == 0
    return df.withColumn("running", F.when(alive, F.round(F.sum(value).over(w), 4)))


def cash_turn(df: DataFrame, order: str) -> DataFrame:
    """The deepest need of capital, and the first period in which the walk is above 0 again, if it starts below."""
    first = F.min_by("running", order)
    low = F.min(F.struct(F.col("running"), F.col(order)))
    return df.where("running is not null").agg(first.alias("start"), F.round(-F.least(F.min("running"), F.lit(0.0)), 4).alias("bridge"), low[order].alias("bridge_period"), F.min(F.when(F.col("running") >= 0, F.col(order))).alias("positive_from")).select("bridge", "bridge_period", F.when(F.col("start") < 0, F.col("positive_from")).alias("positive_from"))


def split_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sums of two series over the periods that have both, and the first's share."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    sums = both.agg(F.sum(F.col(a).cast("decimal(18,2)")).cast("double").alias("a_total"), F.sum(F.col(b).cast("decimal(18,2)")).cast("double").alias("b_total"), F.count(F.lit(1)).alias("n_periods"))
    return sums.withColumn("a_share", ratio(F.col("a_total"), F.col("a_total") + F.col("b_total"), 100))


def plan_vs_actual(actual: DataFrame, plan: DataFrame, by: list[str] | None = None, least: int = 3) -> DataFrame:
    """(by, role, period, actual, plan, pct) for roles with three pairs at least and an attainment from 1 to 10 000 %."""
    by = by or []
    pairs = actual.withColumnRenamed("value", "actual").join(plan.withColumnRenamed("value", "plan"), [*by, "role", "period"]).where("actual is not null and plan is not null")
    per = W.partitionBy(*by, "role")
    total = 100 * F.try_divide(F.sum(F.col("actual").cast("decimal(18,2)")).over(per).cast("double"), F.sum(F.col("plan").cast("decimal(18,2)")).over(per).cast("double"))
    return pairs.withColumns({"n": F.count(F.lit(1)).over(per), "total_pct": F.round(total, 4)}).where((F.col("n") >= least) & F.col("total_pct").between(1.0, 10000.0)).withColumn("pct", ratio(F.col("actual"), F.col("plan"), 100)).drop("n")


def plan_progress(actual: DataFrame, plan_year: DataFrame, plan_months: DataFrame) -> DataFrame:
    """By role, what is done of the year's plan and what should be: the months' share of the plan, or of the year.

    `actual`, `plan_months`: role, month, value. `plan_year`: role, value.
    """
    done = actual.groupBy("role").agg(F.round(F.sum("value"), 2).alias("actual_to_date"), F.max("month").alias("last_month"), F.count_distinct("month").alias("n_months"))
    share = plan_months.join(done.select("role", "last_month"), "role").groupBy("role").agg(ratio(F.sum(F.when(F.col("month") <= F.col("last_month"), F.col("value"))), F.sum("value"), 100).alias("phased"))
    joined = plan_year.withColumnRenamed("value", "plan_year").where("plan_year <> 0").join(done, "role", "left").join(share, "role", "left")
    even = F.round(100 * F.col("n_months") / 12, 4)
    return joined.select(
        "role", "plan_year", "actual_to_date", ratio(F.col("actual_to_date"), F.col("plan_year"), 100).alias("pct"), F.coalesce("phased", even).alias("expected_pct"),
        F.when(F.col("actual_to_date").isNull(), "gap").when(F.col("phased").isNotNull(), "monthly plan").otherwise("months of the year").alias("rule"),
    )


def match_plan(actual: DataFrame, plan: DataFrame) -> DataFrame:
    """(actual, plan, n): the plan series whose label shares the most identity words with an actual series; a tie matches nothing.

    Words of plan labels are an index. A label's rarest known word leads to its first candidates,
    and the most words that one of these shares says how many of the next rarer words another
    must be looked for by, to share as many: so frequent words lead nowhere, and none is missed.
    """
    named = plan.groupBy(F.col("label").alias("plan")).agg(F.count(F.lit(1)).alias("copies")).withColumn("words", identity_tokens(F.col("plan")))
    index = written(named.select("plan", "copies", "words", F.explode("words").alias("word")), "plan-words")
    frequent = index.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    asked = actual.select(F.col("label").alias("actual")).distinct().withColumn("own", identity_tokens(F.col("actual")))
    known = asked.select("actual", "own", F.explode("own").alias("word")).join(frequent, "word").groupBy("actual", "own").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ranked"))
    known = written(known.withColumn("ranked", F.transform("ranked", lambda x: x["word"])), "actual-words")

    def met(rows: DataFrame, words: Column) -> DataFrame:
        return rows.select("actual", "own", F.explode(words).alias("word")).join(index, "word").select("actual", "plan", "copies", F.size(F.array_intersect("own", "words")).alias("n")).distinct()

    first = written(met(known, F.slice("ranked", 1, 1)), "plan-candidates")
    least = first.groupBy("actual").agg(F.max("n").alias("n"))
    more = met(known.join(least, "actual"), F.slice("ranked", F.lit(2), F.greatest(F.size("ranked") - F.col("n"), F.lit(0))))
    every = first.unionByName(more).distinct()
    most = every.groupBy("actual").agg(F.max("n").alias("most"))
    best = every.join(most, "actual").where("n = most").groupBy("actual", "n").agg(F.sum("copies").alias("ties"), F.min("plan").alias("plan"))
    return best.where("ties = 1").select("actual", "plan", "n")


def worst_delta(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """The largest relative difference of two columns, null where no row has both."""
    scale = F.greatest(F.abs(a), F.abs(b))
    return df.agg(F.round(F.max(F.when(scale == 0, 0.0).otherwise(F.abs(a - b) / scale)), 6).alias("worst"), F.count_if(a.isNotNull() & b.isNotNull()).alias("n"))


def identities(df: DataFrame) -> DataFrame:
    """margin = revenue - opex (1 %), revenue = price x volume (2 %), budget at the scale of opex (60 %)."""
    checks = [
        ("margin", F.col("margin"), F.col("revenue") - F.col("opex"), 0.01),
        ("revenue", F.col("revenue"), F.col("price") * F.col("volume"), 0.02),
        ("budget", F.col("opex"), F.col("budget"), 0.6),
    ]
    rows = [worst_delta(df, a, b).select(F.lit(n).alias("identity"), "worst", "n", (F.col("worst") <= most).alias("ok")) for n, a, b, most in checks]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
