"""Orphans of dense months and of odd rows, against a plain walk."""

import datetime
import random

SCHEMA = "j string, seq long, d date, outC double, outU double"
RATE = 2250.0


def plain(head, site):
    """(month, j, seq) of the rows without a match, one by one over the free rows of the month."""
    month = lambda r: r[2] and f"{r[2]:%Y-%m}"
    free, lost = {}, []
    for r in sorted((r for r in site if r[2]), key=lambda r: (r[2], r[0], r[1])):
        free.setdefault(month(r), []).append(r)
    for r in sorted((r for r in head if not r[4] <= 0), key=lambda r: (r[2] or datetime.date.min, r[0], r[1])):
        held = free.get(month(r), [])
        hit = next((i for i, f in enumerate(held) if abs((f[4] or 0.0) - r[4]) < 0.5 or abs((f[3] or 0.0) - r[4] * RATE) < 1200), None)
        if hit is None:
            lost.append((month(r), r[0], r[1]))
        else:
            del held[hit]
    return sorted(lost, key=str)


def found(spark, head, site, *most):
    from gridwright.operators import journal

    lost = journal.orphans(spark.createDataFrame(head, SCHEMA), spark.createDataFrame(site, SCHEMA), RATE, *most)
    return sorted(((r.month, r.j, r.seq) for r in lost.collect()), key=str)


def test_dense_month_is_walked_once(spark, monkeypatch):
    """More rows than 20,000, all of near amounts: bands of them took many rounds."""
    from gridwright.operators import journal

    tables, written = [], journal.written
    monkeypatch.setattr(journal, "written", lambda df, what: tables.append(what) or written(df, what))
    rng = random.Random(5)
    make = lambda n, j: [(j, i, datetime.date(2026, 1, rng.randint(1, 30)), 0.0, round(rng.expovariate(0.2), 2)) for i in range(n)]
    head, site = make(3000, "dgo") + [("dgo", 3000 + i, datetime.date(2026, 1, 15), 0.0, 30.0 + i) for i in range(30)], make(24_000, "site")
    want = plain(head, site)
    assert found(spark, head, site) == want and want
    assert tables.count("orphans-walked") <= 1


def test_odd_rows(spark):
    """Rows that are equal in all, rows without a date or an amount, no amounts, months of one journal alone; in one walk and in bands."""
    day, later = datetime.date(2026, 1, 5), datetime.date(2026, 2, 5)
    head = [("dgo", i, day, 0.0, 10.0 + i / 10) for i in range(6)] + [("dgo", 7, None, 0.0, 10.0), ("dgo", 8, later, 0.0, 10.0), ("dgo", 9, day, 0.0, float("nan")), ("dgo", 10, day, 0.0, 0.0), ("dgo", 11, day, 0.0, 0.3), ("dgo", 12, day, 0.0, float("inf"))]
    site = [("site", 1, day, 0.0, 10.2)] * 3 + [("site", 2, None, 0.0, 10.0), ("site", 3, datetime.date(2026, 3, 5), 0.0, 10.0), ("site", 4, day, None, None), ("site", 5, day, 0.0, float("nan")), ("site", 6, day, 22_500.0, 900.0), ("site", 7, day, 0.0, 10.5), ("site", 8, day, 0.0, 500.0), ("site", 9, day, 0.0, 9.5)]
    want = plain(head, site)
    assert len(want) > 2
    for most in ((), (2,)):
        assert found(spark, head, site, *most) == want
