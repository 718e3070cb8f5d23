"""Queries against their own SQL where larger tables go, and sf0.01 doesn't."""

import datetime


def compared(spark, folder, name, table):
    import duckdb

    from gridwright.plans import catalog, sheets  # noqa: F401

    got = catalog.queries()[name](spark, str(folder))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
        want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r) for r in got.collect()), sorted(want)


def test_throttle_rounds_seconds(spark, tmp_path):
    """Four requests an hour apart but for fractions of a second, of users with other fractions: 0.4, 0.5 and 0.6 to begin and to end with."""
    start = datetime.datetime(2024, 1, 1, 0, 0, 0)
    events = []
    for u, (a, b, odd) in enumerate((a, b, odd) for a in (4, 5, 6) for b in (4, 5, 6) for odd in (0, 1)):
        for k, seconds in enumerate((odd + a / 10, 10.0, 20.0, odd + 3600 + b / 10)):
            events.append((u, 4 * u + k, start + datetime.timedelta(seconds=seconds)))
    spark.createDataFrame(events, "user_id long, event_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    got, want = compared(spark, tmp_path, "throttled", "events")
    assert got == want and {r[2] for r in got if r[1] % 4 == 3} == {True, False}


def test_references_past_zzz(spark, tmp_path):
    """Keys past ZZZ (18277): the first character is no letter, or a small one, or one past char()'s 255."""
    keys = [0, 25, 26, 701, 702, 18277, 18278, 22334, 22361, 39909, 39910, 59999, 129817, 129818, 1_000_000]
    spark.createDataFrame([(k,) for k in keys], "l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got, want = compared(spark, tmp_path, "a1_references", "lineitem")
    assert got == want and [r[0] for r in got] == [r[2] for r in got] == keys


def test_references_of_users_have_no_case(spark):
    from pyspark.sql import functions as F

    from gridwright.functions import cells as C

    refs = spark.createDataFrame([(r,) for r in ("aAB7", " zz10 ", "[AA7", "AAB7")], "r string")
    got = [tuple(r) for r in refs.select(C.parse_a1(F.col("r"))["col"], C.parse_a1(F.col("r"), exact=True)["col"]).collect()]
    assert got == [(703, 22335), (701, None), (None, 18278), (703, 703)]
