import datetime


def test_matrix_has_every_year(spark, tmp_path):
    from gridwright.plans import catalog

    years = [1993, 1996, 1996, 1997, 2004]
    rows = [(p, datetime.date(y, 3, 1)) for y in years for p in ("1-URGENT", "2-HIGH")] + [("2-HIGH", datetime.date(1993, 5, 1))]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.label, r.period): r.value for r in catalog.queries()["roundtrip_extract_matrix"](spark, str(tmp_path)).collect()}
    want = {(p, str(y)): float(years.count(y) + (p == "2-HIGH" and y == 1993)) for p in ("1-URGENT", "2-HIGH") for y in set(years)}
    assert got == want
