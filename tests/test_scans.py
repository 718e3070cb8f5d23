"""Scans over ranges and exact quantiles, against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small ranges stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, None, "x", "y", "z"]), rng.randint(-5, 9)) for i in range(3000)]


def test_scans_against_loops(spark, rows):
    from gridwright.operators import scans

    df = spark.createDataFrame(rows, "g string, i long, v string, n long").repartition(7)
    parts = scans.ranged(df, ["g"], ["i"])
    assert parts.select(scans.PART).distinct().count() > 1
    got = scans.placed(scans.running(scans.previous(scans.carried(parts, ["g"], ["i"], F.col("v"), "last"), ["g"], ["i"], F.col("n"), "prev"), ["g"], ["i"], F.col("n"), "sum"), ["g"], ["i"], "place")
    found = {r.i: (r["last"], r.prev, r["sum"], r.place) for r in got.collect()}
    state = {}
    for g, i, v, n in rows:
        last, prev, total, place = state.get(g, (None, None, 0, 0))
        last = v if v is not None else last
        assert found[i] == (last, prev, total, place), i
        state[g] = (last, n, total + n, place + 1)
    assert scans.placed(scans.ranged(df.where("false"), ["g"], ["i"]), ["g"], ["i"], "k").count() == 0


def quantile(values, q):
    values, place = sorted(values), q * (len(values) - 1)
    low = int(place)
    high = min(low + (place > low), len(values) - 1)
    return values[low] if values[low] == values[high] else (high - place) * values[low] + (place - low) * values[high]


@pytest.mark.parametrize("width", [2, -400])
def test_exact_quantiles(spark, monkeypatch, width):
    """Also where the sketch's brackets miss: counts send those columns back to all values."""
    from gridwright.operators import quantiles

    monkeypatch.setattr(quantiles, "WIDTH", width)
    rng = random.Random(5)
    columns = {"normal": [rng.gauss(0, 1) for _ in range(20_000)], "few": [float(rng.randint(0, 3)) for _ in range(5000)], "one": [7.5], "two": [1.0, 2.0], "skewed": [rng.paretovariate(0.3) for _ in range(3001)], "none": [], None: [1.0, 4.0, 2.0]}
    rows = [(k, v) for k, x in columns.items() for v in x] + [("none", None), ("few", None), ("one", None)]
    qs = [0.1, 0.25, 0.5, 0.75]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "name string, value double").repartition(5), ["name"], qs, ["a", "b", "c", "d"])
    found = {r.name: [r.a, r.b, r.c, r.d] for r in got.collect()}
    assert found["none"] == [None] * 4 and set(found) == set(columns)
    for name, values in columns.items():
        if values:
            assert found[name] == pytest.approx([quantile(values, q) for q in qs], rel=1e-12), name
    assert found["normal"][2] == pytest.approx(statistics.median(columns["normal"]), rel=1e-12)
    assert quantiles.exact_quantiles(spark.createDataFrame([], "name string, value double"), ["name"], [0.5], ["a"]).count() == 0
