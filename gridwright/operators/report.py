"""What a report shows: tiles, an agenda and a page without scripts. Its inputs are aggregates of a few rows."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions.cells import fact_number
from gridwright.operators.profile import exact_sum


def attainment_state(pct: Column, spend: bool = False) -> Column:
    """good, warn or bad: for what should be reached, or for what shouldn't be passed."""
    if spend:
        return F.when(pct > 120, "bad").when(pct > 100, "warn").otherwise("good")
    return F.when(pct < 70, "bad").when(pct < 100, "warn").otherwise("good")


def unit_cost_state(ratio: Column) -> Column:
    return F.when(ratio > 1.25, "bad").when(ratio > 1, "warn").otherwise("good")


def pace(pct: Column, expected: Column) -> Column:
    share = F.try_divide(pct, expected)
    return F.when(share > 1.25, "over").when(share < 0.5, "behind").otherwise("on pace")


def agenda(items: DataFrame, most: int = 7) -> DataFrame:
    """The gravest items of (priority, subject, size), by priority and then size."""
    return items.orderBy("priority", F.desc("size"), "subject").limit(most)


def without_empty_months(table: DataFrame, period: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that have a value, and how many have none."""
    some = F.coalesce(*[F.col(v) for v in values]).isNotNull()
    return table.where(some), table.agg(F.count_if(~some).alias("n_dropped"))


def number(value: float | None, lang: str = "en", digits: int = 2) -> str:
    """12,345.60, or 12 345,60 in French with narrow spaces; whole numbers have no decimals."""
    if value is None:
        return "–"
    text = f"{value:,.{digits}f}" if value != int(value) else f"{int(value):,}"
    return text.replace(",", " ").replace(".", ",") if lang == "fr" else text


def compact(value: float) -> str:
    for size, letter in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(value) >= size:
            return f"{value / size:.1f}{letter}"
    return f"{value:.0f}"


def html(title: str, sections: list[tuple[str, DataFrame]], lang: str = "en", most: int = 200) -> str:
    """One page with a table for each section, at most `most` rows of each."""
    out = [f'<!doctype html><html lang="{lang}"><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1>']
    for name, frame in sections:
        rows = frame.limit(most).collect()
        out.append(f"<h2>{escape(name)}</h2><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in frame.columns)}</tr>")
        for row in rows:
            cells = (number(v, lang) if isinstance(v, (int, float)) and not isinstance(v, bool) else escape("–" if v is None else str(v)) for v in row)
            out.append(f"<tr>{''.join(f'<td>{c}</td>' for c in cells)}</tr>")
        out.append("</table>")
    return "".join(out) + "</html>"


def percent(value: float | None, lang: str = "en", digits: int = 1) -> str:
    return number(value, lang, digits) + (" %" if lang == "fr" else "%") if value is not None else "–"


def blended_unit_cost(months: DataFrame) -> DataFrame:
    """(blended, n): cost per unit over the months that have both."""
    both = months.where("opex is not null and volume is not null")
    return both.agg(F.round(F.try_divide(exact_sum(F.col("opex")), exact_sum(F.col("volume"))), 4).alias("blended"), F.count(F.lit(1)).alias("n"))


def tiles(sums: DataFrame, spend: list[str] | None = None) -> DataFrame:
    """(role, pct, state) of what was reached of a plan, from (role, actual, plan); of the roles in `spend`, what shouldn't be passed."""
    pct = 100 * F.try_divide("actual", "plan")
    is_spend = F.col("role").isin(spend or [])
    return sums.select("role", F.round(pct, 4).alias("pct"), F.when(is_spend, attainment_state(pct, spend=True)).otherwise(attainment_state(pct)).alias("state"))


def outlook(plan: DataFrame, actual: DataFrame) -> DataFrame:
    """(plan_total, actual_total, remaining, required): what each month of the plan that has no actual yet must bring. Both: month, value."""
    done = actual.where("value is not null")
    totals = plan.agg(exact_sum(F.col("value")).alias("plan_total"))
    rest = plan.join(done.select("month"), "month", "left_anti").agg(F.count(F.lit(1)).alias("remaining"))
    both = totals.join(rest).join(done.agg(exact_sum(F.col("value")).alias("actual_total")))  # a row each
    return both.select("plan_total", "actual_total", "remaining", F.round(F.try_divide(F.col("plan_total") - F.col("actual_total"), F.col("remaining")), 1).alias("required"))


def tightest_reference(costs: DataFrame) -> DataFrame:
    """(name, unit_cost, reference, ratio, state) against the least of the references, from (name, unit_cost, references)."""
    least = F.array_min("references")
    ratio = F.try_divide("unit_cost", "reference")
    return costs.withColumn("reference", least).select("name", "unit_cost", "reference", F.round(ratio, 4).alias("ratio"), unit_cost_state(ratio).alias("state"))


def stat_tiles(metrics: DataFrame) -> DataFrame:
    """(role, period, value): the last value of each role that there is, from (role, period, value)."""
    return metrics.where("value is not null").groupBy("role").agg(F.max("period").alias("period"), F.max_by("value", "period").alias("value"))


def executive_agenda(facts: DataFrame, most: int = 7) -> DataFrame:
    """(rank, rule, subject, size) of what a board should look at, from one row of aggregates for each subject.

    `facts`: subject, n_unreconciled, unit_cost_over_pct, attainment_pct, is_spend, conversion_under_pct, capital_bridge,
    n_exceptions, investment_share_pct, n_open_gaps. A rule speaks where its limit is passed; they go in this order.
    """
    rules = [
        ("unreconciled relations", F.col("n_unreconciled") > 0, F.col("n_unreconciled")),
        ("unit cost over budget", F.col("unit_cost_over_pct") >= 10, F.col("unit_cost_over_pct")),
        ("attainment", F.when(F.col("is_spend"), F.col("attainment_pct") > 110).otherwise(F.col("attainment_pct") < 90), F.abs(100 - F.col("attainment_pct"))),
        ("conversion under its average", F.col("conversion_under_pct") >= 10, F.col("conversion_under_pct")),
        ("capital bridge", F.col("capital_bridge") > 0, F.col("capital_bridge")),
        ("journal exceptions", F.col("n_exceptions") > 0, F.col("n_exceptions")),
        ("investment share", F.col("investment_share_pct") >= 40, F.col("investment_share_pct")),
        ("open gaps", F.col("n_open_gaps") > 0, F.col("n_open_gaps")),
    ]
    speaks = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(rule).alias("rule"), F.coalesce(cond, F.lit(False)).alias("on"), size.cast("double").alias("size")) for i, (rule, cond, size) in enumerate(rules)])
    items = facts.select("subject", F.explode(F.filter(speaks, lambda x: x["on"])).alias("x")).select("subject", "x.priority", "x.rule", "x.size")
    # of open gaps two at most
    k = F.row_number().over(W.partitionBy("priority").orderBy(F.desc("size"), "subject"))
    kept = items.withColumn("k", k).where((F.col("priority") < len(rules) - 1) | (F.col("k") <= 2))
    ranked = kept.orderBy("priority", F.desc("size"), "subject").limit(most)
    return ranked.select(F.row_number().over(W.orderBy("priority", F.desc("size"), "subject")).alias("rank"), "rule", "subject", "size")


#: Fixed: what a published snapshot never shows, as it leads back to cells and files.
PRIVATE = ["places", "cells", "raw", "path", "region", "row", "col", "content"]


def snapshot(frame: DataFrame) -> DataFrame:
    """A result without what leads back to its cells."""
    return frame.select(*[c for c in frame.columns if c not in PRIVATE])


def story_chart(series: DataFrame) -> DataFrame:
    """(chart, n_periods): the chart with the most periods, the first of equals; a report's picture where it has no model."""
    n = series.groupBy("chart", "ord").agg(F.count_distinct("period").alias("n_periods"))
    return n.orderBy(F.desc("n_periods"), "ord").limit(1).select("chart", "n_periods")


def available_blocks(counts: DataFrame) -> DataFrame:
    """(block, available) of a report's menu, from one row with the number of rows behind each block."""
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("block"), (F.coalesce(F.col(c), F.lit(0)) > 0).alias("available")) for c in counts.columns])).alias("x")).select("x.*")


def fact_sheet(metrics: DataFrame) -> DataFrame:
    """(role, line): each role's series as one line of text, from (role, period, value)."""
    parts = F.array_sort(F.collect_list(F.struct("period", "value")))
    lines = metrics.groupBy("role").agg(parts.alias("p"))
    return lines.select("role", F.array_join(F.transform("p", lambda x: F.concat(x["period"], F.lit(": "), fact_number(x["value"]))), "; ").alias("line"))
