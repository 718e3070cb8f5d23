"""Exact quantiles of columns of any length, without a task that holds a column.

A sketch of bounded size (`percentile_approx`) says between which two values a quantile lies. One
pass then counts: values inside such a bracket by value, all others by the gap between brackets
that they fall into. What is left is a small share of the different values, and its running
counts (`scans`) tell which value has the rank that is asked for. The counts decide: a rank that
lies in a gap after all, as a sketch may be wrong, is looked for again among all values.

Defined cases. Nulls don't count; NaN is greater than all numbers; a column without values has
null quantiles. Ties are one value with its count. An even number of values is interpolated:
at q (n - 1) between the values of the ranks around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.operators import scans
from gridwright.sources.scratch import written

#: Relative accuracy of the sketch, and how many times its error a bracket spans to either side.
ACCURACY, WIDTH = 10_000, 2


def brackets(values: DataFrame, keys: list[str], qs: list[float], *more: Column) -> DataFrame:
    """keys, n, and `__low`, `__high` of each quantile; `more` are aggregates of the same pass."""
    step = WIDTH / ACCURACY
    at = lambda sign: F.percentile_approx("value", [min(1.0, max(0.0, q + sign * step)) for q in qs], ACCURACY)
    return values.groupBy(*keys).agg(F.count("value").alias("n"), at(-1).alias("__low"), at(1).alias("__high"), *more)


def _ranks(qs: list[float]) -> Column:
    """The ranks that the quantiles need: (q's place, rank, whether it is the upper of two)."""
    n = F.col("n")
    out = []
    for j, q in enumerate(qs):
        place = F.lit(q) * (n - 1)
        out += [F.struct(F.lit(j).alias("j"), F.floor(place).alias("rank"), F.lit(False).alias("upper")), F.struct(F.lit(j).alias("j"), F.ceil(place).alias("rank"), F.lit(True).alias("upper"))]
    return F.array(*out)


def _found(values: DataFrame, bounds: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """keys, j, upper, value: the values of the ranks; null where a rank lies between brackets."""
    own = bounds.select(*[F.col(k).alias(f"__{k}") for k in keys], "__low", "__high")
    joined = values.where("value is not null").join(own, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    slot, kept = F.lit(2 * len(qs)), F.lit(None).cast("double")
    for j in reversed(range(len(qs))):
        low, high = F.col("__low")[j], F.col("__high")[j]
        slot = F.when(F.col("value") <= high, F.when(F.col("value") < low, 2 * j).otherwise(2 * j + 1)).otherwise(slot)
        kept = F.when(F.col("value") <= high, F.when(F.col("value") >= low, F.col("value"))).otherwise(kept)
    counts = joined.select(*keys, slot.alias("slot"), kept.alias("value")).groupBy(*keys, "slot", "value").agg(F.count(F.lit(1)).alias("k"))
    parts = scans.ranged(counts, keys, ["slot", "value"], "quantile-counts")
    upto = scans.running(parts, keys, ["slot", "value"], F.col("k"), "before")
    wanted = bounds.where("n > 0").select(*[F.col(k).alias(f"__{k}") for k in keys], F.explode(_ranks(qs)).alias("x"))
    hit = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("x.rank") >= F.col("before"), F.col("x.rank") < F.col("before") + F.col("k")]
    return upto.join(wanted, hit).select(*keys, "x.j", "x.upper", "value")


def from_brackets(values: DataFrame, bounds: DataFrame, keys: list[str], qs: list[float], names: list[str]) -> DataFrame:
    """keys and a column for each quantile. `values`: keys, value. `bounds`: as `brackets` gives them, written."""
    found = written(_found(values, bounds, keys, qs), "quantile-values")
    lost = found.where("value is null").select(*keys).distinct()
    if lost.head(1):  # the sketch was wrong: all values of these columns are looked at
        infinite = lambda sign: F.array(*[F.lit(float(f"{sign}inf")) for _ in qs])
        same = [F.col(f"__{k}").eqNullSafe(F.col(k)) for k in keys]
        again = bounds.join(lost.select(*[F.col(k).alias(f"__{k}") for k in keys]), same, "left_semi").withColumns({"__low": infinite("-"), "__high": F.transform(infinite(""), lambda _: F.lit(float("nan")))})
        kept = found.join(lost.select(*[F.col(k).alias(f"__{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
        found = kept.unionByName(_found(values, again, keys, qs))
    pick = lambda j, upper: F.max(F.when((F.col("j") == j) & (F.col("upper") == upper), F.col("value")))
    wide = found.groupBy(*keys).agg(*[pick(j, u).alias(f"__{j}{u}") for j in range(len(qs)) for u in (False, True)])
    joined = bounds.select(*keys, "n").join(wide.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in wide.columns if c not in keys]), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")

    def between(j: int, q: float) -> Column:
        low, high, place = F.col(f"__{j}False"), F.col(f"__{j}True"), F.lit(q) * (F.col("n") - 1)
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return joined.select(*keys, *[between(j, q).alias(name) for j, (q, name) in enumerate(zip(qs, names, strict=True))])


def exact_quantiles(values: DataFrame, keys: list[str], qs: list[float], names: list[str]) -> DataFrame:
    """keys and the quantiles `qs` (ascending) of `value`, under `names`. `values` is read twice."""
    return from_brackets(values, written(brackets(values, keys, qs), "quantile-brackets"), keys, qs, names)
