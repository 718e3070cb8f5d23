"""Trends, changes, breakdowns and movers of a measure, and what the data can't say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions import vocabulary as V
from gridwright.functions.cells import FOLD, role, tokens
from gridwright.operators.profile import exact_sum

# Fixed limits of what is shown.
MEMBERS, PERIODS, MOVERS = 12, 60, 5


def monthly_trend(df: DataFrame, date: str, value: str, most: int = PERIODS) -> DataFrame:
    """(period, value): sums by month, the last `most`."""
    sums = df.where(F.col(date).isNotNull()).groupBy(F.date_format(date, "yyyy-MM").alias("period")).agg(exact_sum(F.col(value)).alias("value"))
    # months are few: a row for each
    return sums.orderBy(F.desc("period")).limit(most)


def yearly_trend(df: DataFrame, date: str, value: str) -> DataFrame:
    """(year, value, previous, pct): against the year before that was observed."""
    sums = df.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(exact_sum(F.col(value)).alias("value"))
    previous = F.lag("value").over(W.orderBy("year"))
    return sums.withColumn("previous", previous).withColumn("pct", F.round(100 * F.try_divide(F.col("value") - F.col("previous"), F.abs("previous")), 4))


def month_change(trend: DataFrame) -> DataFrame:
    """Each month against the one before it in the trend."""
    w = W.orderBy("period")
    out = trend.withColumn("previous", F.lag("value").over(w))
    return out.withColumn("delta", F.round(F.col("value") - F.col("previous"), 2)).withColumn("pct", F.round(100 * F.try_divide(F.col("value") - F.col("previous"), F.abs("previous")), 4))


def year_change(trend: DataFrame) -> DataFrame:
    """Each month against the same month a year before, by the calendar."""
    month = lambda c: F.to_date(F.concat(c, F.lit("-01")))
    before = trend.select(F.date_format(F.add_months(month(F.col("period")), 12), "yyyy-MM").alias("period"), F.col("value").alias("previous"))
    return trend.join(before, "period").withColumn("delta", F.round(F.col("value") - F.col("previous"), 2)).withColumn("pct", F.round(100 * F.try_divide(F.col("value") - F.col("previous"), F.abs("previous")), 4))


def by_dimension(df: DataFrame, dim: str, value: str, members: int = MEMBERS, others: str = "(others)") -> DataFrame:
    """Sums by member, the largest first; the rest is one row."""
    sums = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).cast("string").alias("member")).agg(F.sum(F.col(value).cast("decimal(18,2)")).alias("v"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.orderBy(F.desc("v"), "member"))
    top = sums.orderBy(F.desc("v"), "member").limit(members).withColumn("shown", rank)
    rest = sums.join(F.broadcast(top.select("member")), "member", "left_anti").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).where("n is not null")
    return top.select("member", F.col("v").cast("double").alias("value"), "n", "shown").unionByName(rest.select(F.lit(others).alias("member"), F.col("v").cast("double").alias("value"), "n", F.lit(members + 1).alias("shown")))


def movers(values: DataFrame, most: int = MOVERS) -> DataFrame:
    """(side, rank, entity, value): the ends of (entity, value), by two bounded sorts."""
    top = values.orderBy(F.desc("value"), "entity").limit(most).withColumn("side", F.lit("top")).withColumn("rank", F.row_number().over(W.orderBy(F.desc("value"), "entity")))
    bottom = values.orderBy("value", "entity").limit(most).withColumn("side", F.lit("bottom")).withColumn("rank", F.row_number().over(W.orderBy("value", "entity")))
    return top.unionByName(bottom).select("side", "rank", "entity", "value")


def latest_level(df: DataFrame, entity: str, at: str, value: str, tie: str) -> DataFrame:
    """The last value of each entity."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(F.max_by(F.col(value), F.struct(at, tie)).alias("value"))


def time_grain(df: DataFrame, date: str) -> DataFrame:
    """(median_gap, grain) of the different dates. Dates are few, whatever the rows."""
    days = df.where(F.col(date).isNotNull()).select(F.to_date(date).alias("d")).distinct()
    gaps = days.select(F.datediff("d", F.lag("d").over(W.orderBy("d"))).alias("gap")).where("gap is not null")
    g = F.col("median_gap")
    return gaps.agg(F.median("gap").alias("median_gap")).withColumn("grain", F.when(g <= 1.5, "day").when(g <= 8, "week").when(g <= 45, "month").when(g <= 120, "quarter").otherwise("year"))


def schema_classes(profile: DataFrame) -> DataFrame:
    """time, dimension, flag, entity or measure, from (name, dtype, n_rows, n_filled, n_distinct, n_binary)."""
    name, d, n = F.col("name"), F.col("n_distinct"), F.col("n_filled")
    labelled = name.rlike(FOLD + V.ID_NAME) | name.rlike(FOLD + V.RANK_NAME)
    kind = (
        F.when(F.col("dtype") == "date", "time")
        .when((F.col("dtype") == "number") & (F.col("n_binary") == n) & (d <= 2), "flag")
        .when((F.col("dtype") == "number") & labelled, "entity")
        .when(F.col("dtype") == "number", "measure")
        .when((d <= 50) & (d <= 0.6 * n), "dimension")
        .when(d >= 0.8 * n, "entity")
        .otherwise("text")
    )
    measured = F.when(name.rlike(FOLD + V.CHANGE), "change").when(name.rlike(FOLD + V.RATIO) | name.rlike(FOLD + V.MEAN_ONLY), "ratio").otherwise("amount")
    owned = F.when(name.rlike(FOLD + V.INVENTORY), "inventory").otherwise(role(name))
    return profile.select("name", kind.alias("class")).withColumns({"measure_kind": F.when(F.col("class") == "measure", measured), "role": F.when(F.col("class") == "measure", owned)})


def headline(measures: DataFrame) -> DataFrame:
    """The measure to lead with, of (ord, name, measure_kind, role)."""
    name = F.col("name")
    rank = (
        F.when(name.rlike(r"^col_\d+$"), 9)
        .when(F.col("role") == "revenue", 0)
        .when((F.col("measure_kind") == "amount") & name.rlike(FOLD + V.TARGET_NAME) & ~name.rlike(FOLD + V.UNIT_NAME), 1)
        .when((F.col("measure_kind") == "amount") & ~name.rlike(FOLD + V.UNIT_NAME), 2)
        .when(F.col("measure_kind") == "amount", 3)
        .otherwise(4)
    )
    return measures.agg(F.min_by("name", F.struct(rank.alias("r"), "ord")).alias("headline"))


def story_score(stories: DataFrame, most: int = 8) -> DataFrame:
    """rows x (1 + dimensions, two at most) x 3 with time; the best stories."""
    score = F.col("n_rows") * (1 + F.least(F.col("n_dims"), F.lit(2))) * F.when(F.col("has_time"), 3).otherwise(1)
    return stories.withColumn("score", score).orderBy(F.desc("score"), "story").limit(most)


def match_questions(questions: DataFrame, stories: DataFrame, metrics: DataFrame) -> DataFrame:
    """(question, story, metrics, status): which story answers a question.

    `questions`: question. `stories`: ord, story, words. `metrics`: story, metric, available.
    Questions are a brief's, so the pairs with stories are few.
    """
    intents = F.array(*[F.struct(F.lit(n).alias("intent"), F.lit(FOLD + rx).alias("asks"), F.lit(m).alias("takes")) for n, rx, m in V.INTENTS])
    asked = questions.withColumn("hit", F.filter(intents, lambda i: F.rlike(F.col("question"), i["asks"]))).withColumn("q", tokens(F.col("question")))
    vocabulary = stories.withColumn("v", tokens(F.col("words"))).select("ord", "story", "v")
    near = lambda q: F.array_contains(F.col("v"), q) | ((F.length(q) >= 5) & F.exists("v", lambda v: (F.length(v) >= 5) & (F.substring(v, 1, 5) == F.substring(q, 1, 5))))
    pairs = asked.join(F.broadcast(vocabulary)).withColumn("affinity", F.size(F.filter("q", near)))
    open_ = F.filter("hit", lambda i: ~i["intent"].isin(V.GENERIC_INTENTS) | (F.col("affinity") > 0))
    listed = metrics.groupBy("story").agg(F.array_sort(F.collect_set(F.when(F.col("available"), F.col("metric")))).alias("has"), F.array_sort(F.collect_set(F.when(~F.col("available"), F.col("metric")))).alias("lacks"))
    joined = pairs.join(listed, "story", "left").withColumn("open", open_)
    taken = lambda of, by: F.filter(F.coalesce(of, F.array().cast("array<string>")), lambda m: F.exists(by, lambda i: F.rlike(m, i["takes"])))
    valued = joined.withColumn("ids", taken(F.col("has"), F.col("open"))).withColumn("missing", taken(F.col("lacks"), F.col("hit")))
    best = valued.groupBy("question").agg(F.max_by(F.struct("story", "ids", "missing"), F.struct(F.size("ids"), "affinity", -F.col("ord"))).alias("b"))
    n, m = F.size("b.ids"), F.size("b.missing")
    status = F.when((n > 0) & (m > 0), "partial").when(n > 0, "answerable").when(m > 0, "unanswerable").otherwise("unmatched")
    return best.select("question", F.when(n > 0, F.col("b.story")).alias("story"), F.array_join("b.ids", ",").alias("metrics"), status.alias("status"))


def gap_rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A row for each staple that the data can't give: (requires, reason)."""
    found = df.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    return found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("requires"), (F.col(k) == 0).alias("lacking")) for k in checks])).alias("x")).where("x.lacking").select("x.requires", F.concat(F.lit("no rows for "), F.col("x.requires")).alias("reason"))


def headline_value(df: DataFrame, measure: str, kind: str) -> DataFrame:
    """(measure, metric, value): the sum of an amount, the mean of anything else."""
    value = exact_sum(F.col(measure)) if kind == "amount" else F.round(F.avg(F.col(measure)), 4)
    return df.agg(F.lit(measure).alias("measure"), F.lit("sum" if kind == "amount" else "mean").alias("metric"), value.alias("value"))


def change_means(df: DataFrame, dim: str, measures: list[str], most: int = 2, members: int = MEMBERS) -> DataFrame:
    """(measure, member, mean_value, n) of measures of change, two at most, the highest means first: changes aren't summed."""
    long = df.where(F.col(dim).isNotNull()).select(F.col(dim).cast("string").alias("member"), F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures[:most]])).alias("x")).select("member", "x.*")
    means = long.groupBy("measure", "member").agg(F.round(F.avg("v"), 4).alias("mean_value"), F.count("v").alias("n"))
    rank = F.row_number().over(W.partitionBy("measure").orderBy(F.desc("mean_value"), "member"))
    return means.withColumn("rank", rank).where(F.col("rank") <= members)


def matrix_story(facts: DataFrame, most_series: int = 24, most: int = MOVERS) -> DataFrame:
    """(metric, rank, entity, value, headline) of a cross-tab by date, from (label, period, value).

    Of its largest series, totals are left out, as they hold the others; stocks are levels, of
    which the lowest latest ones count; of the others, what each gained since the month before.
    """
    size = facts.groupBy("label").agg(F.sum(F.abs(F.col("value").cast("decimal(18,2)"))).alias("size"))
    ranked = size.orderBy(F.desc("size"), "label").limit(most_series).select("label")
    shown = facts.join(F.broadcast(ranked), "label").withColumn("stock", F.col("label").rlike(FOLD + V.INVENTORY))
    levels = shown.where("stock and value is not null").groupBy(F.col("label").alias("entity")).agg(F.round(F.max_by("value", "period"), 4).alias("value"))
    low = levels.orderBy("value", "entity").limit(most).select(F.lit("low_stock").alias("metric"), F.row_number().over(W.orderBy("value", "entity")).alias("rank"), "entity", "value", F.lit(None).cast("double").alias("headline"))
    flows = shown.where(~F.col("stock") & ~F.col("label").rlike(FOLD + V.DERIVED_SERIES) & F.col("value").isNotNull())
    months = flows.groupBy(F.col("label").alias("entity"), F.substring("period", 1, 7).alias("month")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"))
    last = W.partitionBy("entity").orderBy(F.desc("month"))
    newest = months.withColumns({"k": F.row_number().over(last), "before": F.lead("v").over(last)}).where("k = 1 and before is not null")
    deltas = newest.select("entity", F.round(F.col("v") - F.col("before"), 4).alias("value"), F.round("v", 4).alias("headline"))
    side = lambda name, *order: deltas.orderBy(*order).limit(most).select(F.lit(name).alias("metric"), F.row_number().over(W.orderBy(*order)).alias("rank"), "entity", "value", "headline")
    return low.unionByName(side("gained", F.desc("value"), "entity")).unionByName(side("lost", "value", "entity"))


def suggestions(metrics: DataFrame, most: int = 6) -> DataFrame:
    """(rank, question): questions that a story's metrics can answer, from (story, metric, measure, grain)."""
    what = F.coalesce("measure", "story")
    text = (
        F.when(F.col("metric") == "trend", F.concat(F.lit("How is "), what, F.lit(" trending?")))
        .when(F.col("metric") == "movers", F.concat(F.lit("Which "), F.coalesce("grain", F.lit("series")), F.lit(" is performing best, and which worst?")))
        .when(F.col("metric") == "low_stock", F.concat(F.lit("Is stock of "), what, F.lit(" running out?")))
        .when(F.col("metric").startswith("by_"), F.concat(F.lit("How is "), what, F.lit(" split by "), F.coalesce("grain", F.substring("metric", 4, 60)), F.lit("?")))
        .when(F.col("metric") == "headline", F.concat(F.lit("What is the total "), what, F.lit("?")))
    )
    order = F.when(F.col("metric") == "trend", 0).when(F.col("metric") == "movers", 1).when(F.col("metric") == "low_stock", 2).when(F.col("metric").startswith("by_"), 3).otherwise(4)
    asked = metrics.withColumns({"question": text, "o": order}).where("question is not null").groupBy("question").agg(F.min(F.struct("o", "story")).alias("at"))
    return asked.orderBy("at", "question").limit(most).select(F.row_number().over(W.orderBy("at", "question")).alias("rank"), "question")
