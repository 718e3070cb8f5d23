"""Models, stories, reports, guards and publications on small inputs with known answers."""

from pyspark.sql import functions as F

from gridwright.functions import cells as C
from gridwright.operators import audit, journal, model, report, story
from gridwright.sources import workbook
from gridwright.sources.store import Store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cleaners(spark):
    texts = spark.createDataFrame([(" a ",), ("None",), ("nan",), (" ",), (None,), ("12.345",)], "t string")
    assert [r[0] for r in texts.select(C.clean_text(F.col("t"))).collect()] == ["a", None, None, None, None, "12.345"]
    assert [r[0] for r in texts.select(C.journal_text(F.col("t"))).collect()] == ["a", "None", "nan", "", "", "12.345"]
    assert [r[0] for r in texts.select(C.journal_number(F.col("t"))).collect()] == [0.0] * 5 + [12.35]
    shown = spark.createDataFrame([(1234.0,), (0.5,), (None,)], "v double").select(C.fact_number(F.col("v")))
    assert [r[0] for r in shown.collect()] == ["1,234", "0.50", "–"]
    typed = {r.raw: (r.kind, r.num) for r in C.typed(spark.createDataFrame([("1 234,5",), ("janv. 2026",), ("x",), (" ",), ("#N/A",), ("12%",), ("01/02/2024",)], "raw string")).collect()}
    assert typed == {"1 234,5": ("number", 1234.5), "janv. 2026": ("date", None), "x": ("text", None), " ": ("blank", None), "#N/A": ("blank", None), "12%": ("number", 12.0), "01/02/2024": ("date", None)}


def series(spark, *charts):
    found = [(f"{s}#1", i, s, "month", label, f"2026-{m:02d}", float(v)) for i, (s, lines) in enumerate(charts) for label, vs in lines.items() for m, v in enumerate(vs, 1) if v is not None]
    return spark.createDataFrame(found, "chart string, ord int, sheet string, grain string, label string, period string, value double")


def test_models(spark):
    lead = ("USINE", {"Chiffre d'affaires": [100, 200, 300, 400], "PRODUCTION CPO": [10, 20, 30, 40]})
    costs = ("COUTS", {"OPEX": [50, 60, 70, None], "FFB RECOLTE": [44, 88, 120, 160]})
    short = ("AUTRE", {"Surface (ha)": [5, 5, None, None]})
    got = model.assembled(series(spark, lead, costs, short))
    named = {r.role: (r.sheet, r.label) for r in got.select("role", "sheet", "label").distinct().collect()}
    # the larger volume goes in, the smaller comes out; two periods of an area are too few
    assert named == {"revenue": ("USINE", "Chiffre d'affaires"), "volume": ("COUTS", "FFB RECOLTE"), "volume_secondary": ("USINE", "PRODUCTION CPO"), "opex": ("COUTS", "OPEX")}
    wide = {r.period: r for r in model.metrics(got).collect()}
    assert wide["2026-02"].margin == 140 and wide["2026-04"].margin is None and wide["2026-01"].volume_ratio == round(10 / 44, 4)
    sheets = spark.createDataFrame([("BUDGET 2026",), ("Prévisions",), ("USINE",)], "s string")
    assert [r[0] for r in sheets.select(model.pool(F.col("s"))).collect()] == ["plan", "plan", "actual"]
    items = spark.createDataFrame([("a", 1.0), ("b", -5.0), ("a", 2.0)], "region string, value double")
    assert rows(model.breakdowns(items).select("region", "size")) == [("a", 3.0), ("b", 5.0)]


def test_story_of_a_cross_tab(spark):
    facts = [("Nord", "2026-01-01", 5.0), ("Nord", "2026-02-01", 9.0), ("Sud", "2026-01-01", 5.0), ("Sud", "2026-02-01", 2.0), ("TOTAL", "2026-02-01", 99.0), ("Stock gasoil", "2026-01-01", 7.0), ("Stock gasoil", "2026-02-01", 3.0)]
    got = story.matrix_story(spark.createDataFrame(facts, "label string, period string, value double"))
    assert rows(got.select("metric", "rank", "entity", "value")) == [("gained", 1, "Nord", 4.0), ("gained", 2, "Sud", -3.0), ("lost", 1, "Sud", -3.0), ("lost", 2, "Nord", 4.0), ("low_stock", 1, "Stock gasoil", 3.0)]
    asked = spark.createDataFrame([("Ventes", "trend", "CA", None), ("Ventes", "by_region", "CA", "region"), ("Ventes", "yoy", "CA", None)], "story string, metric string, measure string, grain string")
    assert [r.question for r in story.suggestions(asked).orderBy("rank").collect()] == ["How is CA trending?", "How is CA split by region?"]
    ranked = story.story_score(spark.createDataFrame([("a", 10, 3, False), ("b", 10, 0, True)], "story string, n_rows int, n_dims int, has_time boolean"))
    assert [(r.story, r.score) for r in ranked.collect()] == [("a", 30), ("b", 30)]


def test_checks_of_a_table(spark):
    table = [(i, float(q), float(u), float(q * u) if i != 3 else 400.0, float(q + u + (q * u if i != 3 else 400.0))) for i, (q, u) in enumerate([(2, 5), (3, 7), (4, 9), (5, 8), (6, 11), (7, 13), (8, 3)])]
    out = audit.run_checks(spark.createDataFrame(table, "k int, qty double, unit double, amount double, total double"), "k", ["k", "qty", "unit", "amount", "total"], [False, True, True, True, True]).collect()
    assert [(r.relation, r.status, r.n_mismatched, r.listed) for r in out] == [("amount=qty*unit", "mismatch", 1, [3]), ("total=qty+unit+amount", "ok", 0, None)]
    found = spark.createDataFrame([("s", None, "t", "f", "mismatch", 1.0), ("s", None, "t", "f", "ok", 1.0), ("s", "2", "t", "f", "odd", 1.0)], "sheet string, panel string, target string, formula string, status string, delta_total double")
    decided = audit.with_decisions(found, spark.createDataFrame([], "finding_id string, decision string"))
    assert decided.select("finding_id").distinct().count() == 3 and audit.open_findings(decided).first()[0] == 2
    assert audit.deliverable_status(decided).first()[0] == "reconciled" and audit.deliverable_status(decided.limit(0)).first()[0] is None


def test_reports(spark):
    plan, actual = (spark.createDataFrame(x, "month int, value double") for x in ([(1, 10.0), (2, 10.0), (3, 10.0)], [(1, 12.0), (2, None)]))
    assert tuple(report.outlook(plan, actual).first()) == (30.0, 12.0, 2, 9.0)
    sums = spark.createDataFrame([("opex", 110.0, 100.0), ("revenue", 60.0, 100.0)], "role string, actual double, plan double")
    assert rows(report.tiles(sums, ["opex"])) == [("opex", 110.0, "warn"), ("revenue", 60.0, "bad")]
    costs = spark.createDataFrame([("a", 13.0, [10.0, 20.0]), ("b", 9.0, [10.0])], "name string, unit_cost double, references array<double>")
    assert rows(report.tightest_reference(costs)) == [("a", 13.0, 10.0, 1.3, "bad"), ("b", 9.0, 10.0, 0.9, "good")]
    monthly = spark.createDataFrame([("2026-01", None, None), ("2026-02", 1.0, None)], "period string, a double, b double")
    kept, dropped = report.without_empty_months(monthly, "period", ["a", "b"])
    assert kept.count() == 1 and dropped.first()[0] == 1
    paces = spark.createDataFrame([(130.0, 100.0), (40.0, 100.0), (90.0, 100.0)], "pct double, expected double").select(report.pace(F.col("pct"), F.col("expected")))
    assert [r[0] for r in paces.collect()] == ["over", "behind", "on pace"]
    assert report.percent(12.34) == "12.3%" and report.percent(None) == "–"
    lines = report.fact_sheet(spark.createDataFrame([("opex", "2026-02", 2.5), ("opex", "2026-01", 1000.0)], "role string, period string, value double"))
    assert lines.first().line == "2026-01: 1,000; 2026-02: 2.50"
    assert report.snapshot(spark.createDataFrame([(1, 2)], "value int, places int")).columns == ["value"]
    blocks = {r.block: r.available for r in report.available_blocks(spark.createDataFrame([(3, 0)], "plan int, cash int")).collect()}
    assert blocks == {"plan": True, "cash": False}


def test_guards_names_and_files(spark, tmp_path):
    files = spark.createDataFrame([("a", 0), ("b", 5), ("c", 26 << 20)], "path string, length long")
    assert rows(workbook.refusals(files)) == [("a", "empty"), ("c", "too large")]
    cells = spark.createDataFrame([("a", "s", 999, 1999), ("b", "s", 1, 1)], "path string, sheet string, row long, col int")
    assert rows(workbook.too_many_cells(cells)) == [("a", 2_000_000)]
    long = "x" * 40
    sheets = spark.createDataFrame([("p", 0, long), ("p", 1, long + "y"), ("p", 2, "X" * 31), ("p", 3, "x" * 28 + " 2"), ("q", 0, long)], "path string, sheet_ord int, sheet string")
    names = {(r.path, r.sheet_ord): r.name for r in workbook.sheet_names(sheets).collect()}
    assert names["p", 0] == "x" * 31 and names["q", 0] == "x" * 31 and names["p", 3] == "x" * 28 + " 2"
    assert names["p", 1] == "x" * 28 + " 3" and len({n.lower() for (p, _), n in names.items() if p == "p"}) == 4
    (tmp_path / "plain.dat").write_bytes(b"a;b\n1;2\n")
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    got = workbook.read_files(spark, str(tmp_path)).collect()
    assert sorted((r.row, r.col, r.raw) for r in got if not r.error) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "2")]
    assert sum(bool(r.error) for r in got) == 1


def test_publications(spark, tmp_path):
    first = Store.published(spark.createDataFrame([], "analysis_id string, version int"), spark.createDataFrame([("a", 1)], "analysis_id string, at long"))
    again = Store.published(first, spark.createDataFrame([("a", 2), ("b", 2)], "analysis_id string, at long"))
    assert rows(again.select("analysis_id", "version")) == [("a", 2), ("b", 1)] and again.select("token").distinct().count() == 2
    log = again.where("analysis_id = 'a'").select("token", F.lit(9).cast("long").alias("at"))
    assert rows(Store.opens(again, log.unionByName(log))) == [("a", 2, 9), ("b", 0, None)]
    shown = spark.createDataFrame([("d1", "c", None, 5, True), ("d2", "c", "g", 1, True), ("d3", "c", "g", 2, True), ("d4", "x", "g", 2, True), ("d5", "c", "g", 3, False)], "deliverable_id string, client_id string, grp string, published_at int, is_open boolean")
    assert [r.deliverable_id for r in Store.portal(shown, "c").collect()] == ["d3", "d2", "d1"]
    store = Store(spark, str(tmp_path / "store"))
    for t in ("analyses", "decisions"):
        store.upsert(t, ["analysis_id"], spark.createDataFrame([("a",), ("b",)], "analysis_id string"))
    store.cascade(spark.createDataFrame([("a",)], "analysis_id string"), ["decisions"])
    assert all([r.analysis_id for r in store.latest(t, ["analysis_id"]).collect()] == ["b"] for t in ("analyses", "decisions"))


def test_journals_from_sheets(spark):
    header = {"Dates": 0, "Libellés": 1, "Code Interne": 2, "Sorties USD": 3}
    cells = [("p", s, 9, c, n) for s in (journal.SITE_SHEET, journal.HEAD_SHEET) for n, c in header.items()]
    cells += [("p", journal.SITE_SHEET, 10, 0, "05/01/2026"), ("p", journal.SITE_SHEET, 10, 2, " FUEL "), ("p", journal.SITE_SHEET, 10, 3, "12,345"), ("p", journal.SITE_SHEET, 11, 0, "no date"), ("p", journal.HEAD_SHEET, 12, 0, "2026-02-01"), ("p", "other", 10, 0, "05/01/2026")]
    frame = spark.createDataFrame(cells, "path string, sheet string, row long, col int, raw string")
    assert rows(journal.parsed(frame).select("j", "seq", F.col("d").cast("string"), "code", "outU", "inC")) == [("dgo", 2, "2026-02-01", "", 0.0, 0.0), ("site", 0, "2026-01-05", "FUEL", 12.35, 0.0)]
    assert rows(journal.matches_contract(frame)) == [("p", True)]
    spend = spark.createDataFrame([("opex", 60.0), ("capex", 0.0)], "kind string, usd double")
    assert [tuple(r) for r in journal.destinations(spend, spark.createDataFrame([(40.0,)], "usd double")).collect()] == [("opex", 60.0, 60.0), ("dgo", 40.0, 40.0)]
    pivot = spark.createDataFrame([(0, 1, 3.0), (2, 4, 2250.0), (3, 0, 900.0)], "row int, col int, num double")
    assert journal.pivot_rate(pivot).first().rate == 2250.0


def test_orphans_are_matched_in_order(spark):
    """Against a plain walk with a list of free rows."""
    import random

    rng = random.Random(3)
    make = lambda n, j: [(j, i, f"2026-0{rng.randint(1, 2)}-1{rng.randint(0, 9)}", float(rng.randint(0, 3) * 2250 * rng.randint(0, 1)), round(rng.choice([0, 1, 2, 5]) + rng.random() / 2, 2)) for i in range(n)]
    head, site = make(60, "dgo"), make(90, "site")
    want = []
    for month in ("2026-01", "2026-02"):
        free = sorted((r for r in site if r[2].startswith(month)), key=lambda r: (r[2], r[0], r[1]))
        for r in sorted((r for r in head if r[2].startswith(month) and r[4] > 0), key=lambda r: (r[2], r[0], r[1])):
            hit = next((f for f in free if abs(f[4] - r[4]) < 0.5 or abs(f[3] - r[4] * 2250.0) < 1200), None)
            if hit is None:
                want.append((month, r[1]))
            else:
                free.remove(hit)
    frame = lambda x: spark.createDataFrame(x, "j string, seq long, d string, outC double, outU double").withColumn("d", F.to_date("d"))
    # in one band, and in bands so narrow that most rows stand in several
    for most in (20_000, 5):
        assert rows(journal.orphans(frame(head), frame(site), 2250.0, most).select("month", "seq")) == sorted(want)
