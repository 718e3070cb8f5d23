"""From files to results in one call."""

from pyspark.sql import functions as F


def test_files_are_read_classified_and_checked(spark, tmp_path):
    from gridwright.plans.analysis import analyse, checks

    (tmp_path / "achats.csv").write_text("Description;Qté;Cout unit;Montant\n" + "".join(f"Article {i};{i + 2};{2 * i + 5};{(i + 2) * (2 * i + 5) if i != 3 else 400}\n" for i in range(8)) + "Total;44;96;999\n")
    (tmp_path / "projections.csv").write_text("PROJECTIONS;;;\n;2025;2026;2027\nRevenus;100;200;400\nOPEX;60;90;150\nPRODUCTION;10;20;\n")
    for name, sales in (("usine", "10;20;30"), ("budget", "20;20;20")):
        (tmp_path / f"{name}.csv").write_text(f"POSTE;01/01/2026;01/02/2026;01/03/2026\nVentes;{sales}\nCharges;1;2;3\n")
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    out = analyse(spark, str(tmp_path))
    name = lambda sheet: sheet.rpartition("/")[2]
    assert [r.error.split(":")[0] for r in out["errors"].collect()] == ["BadZipFile"]
    assert {name(r.sheet): r.orientation for r in out["sheets"].collect()} == {"achats.csv!achats": "tidy", "projections.csv!projections": "matrix", "usine.csv!usine": "matrix", "budget.csv!budget": "matrix"}
    model = {r.period: (r.margin, r.margin_pct, r.opex_per_volume) for r in out["model"].collect()}
    assert model == {"2025": (40.0, 40.0, 6.0), "2026": (110.0, 55.0, 4.5), "2027": (250.0, 62.5, None)}
    assert {(name(r.book), r.period): r.margin for r in out["months"].collect()} == {("usine.csv", "2026-01-01"): 9.0, ("usine.csv", "2026-02-01"): 18.0, ("usine.csv", "2026-03-01"): 27.0}
    # a book is a file: the plan of one isn't held against what another did
    assert {(name(r.book), r.period): r.revenue for r in out["plan"].collect()} == {("budget.csv", f"2026-0{m}-01"): 20.0 for m in (1, 2, 3)}
    assert out["plan_vs_actual"].count() == 0
    region = next(r.region for r in out["regions"].collect() if "achats.csv" in r.region)
    found = checks(out["tables"], region).collect()
    assert [(r.relation, r.status, r.n_mismatched, r.listed) for r in found] == [("Montant=Qté*Cout unit", "mismatch", 1, [4])]
    kinds = {r.name.split("|")[1]: r.dtype for r in out["columns"].collect()}
    assert kinds == {"Description": "text", "Qté": "number", "Cout unit": "number", "Montant": "number"}
    assert out["journal"].count() == 0 and not any(r.is_journal for r in out["contracts"].collect())
    assert out["series"].where(F.col("label") == "OPEX").count() == 3


def test_files_of_one_name_stay_apart(spark, tmp_path):
    """Two folders with a file of one name, and two of one content; each has its own sheet, model and rows."""
    from gridwright.plans.analysis import analyse

    for folder, revenue in (("one", 100), ("two", 900), ("three", 900)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "data.csv").write_text(f"PROJECTIONS;;;\n;2025;2026;2027\nRevenus;{revenue};200;400\n" + ("OPEX;60;90;150\n" if folder == "one" else ""))
    out = analyse(spark, str(tmp_path) + "/*/*.csv")
    values = {(r.book.split("/")[-2], r.label, r.period): r.value for r in out["series"].collect()}
    assert len(values) == 9 and values["one", "Revenus", "2025"] == 100 and ("two", "Revenus", "2025") not in values
    model = {(r.book.split("/")[-2], r.period): (r.revenue, r.opex) for r in out["model"].collect()}
    assert model["one", "2025"] == (100.0, 60.0) and model["three", "2025"] == (900.0, None)
    assert [(r.path.split("/")[-2], r.n_copies) for r in out["copies"].collect()] == [("three", 2)]


def test_journals_of_two_books(spark):
    """One row a journal in each of two books: four rows, none of which meets another's."""
    from gridwright.operators import journal

    header = {"Dates": 0, "Code Interne": 2, "Sorties USD": 3}
    cells = [(p, s, journal.HEADER_ROW, c, n) for p in "ab" for s in (journal.SITE_SHEET, journal.HEAD_SHEET) for n, c in header.items()]
    for i, (p, s) in enumerate((p, s) for p in "ab" for s in (journal.SITE_SHEET, journal.HEAD_SHEET)):
        cells += [(p, s, journal.HEADER_ROW + 1, c, v) for c, v in ((0, f"0{i + 1}/01/2026"), (2, "FUEL"), (3, str(10 + i)))]
    frame = spark.createDataFrame(cells, "path string, sheet string, row int, col int, raw string")
    got = journal.parsed(frame)
    assert sorted((r.path, r.j, r.outU) for r in got.collect()) == [("a", "dgo", 11.0), ("a", "site", 10.0), ("b", "dgo", 13.0), ("b", "site", 12.0)]
    assert journal.out_of_order(got).count() == 0
    codes = spark.createDataFrame([("a", "FUEL")], "path string, code string")
    assert [(r.path, r.code, r.n) for r in journal.unknown_codes(got, codes).collect()] == [("b", "fuel", 2)]
    assert {(r.path, r.code, r.out_usd) for r in journal.code_months(got, codes).collect()} == {("a", "FUEL", 21.0), ("b", "UNMAPPED", 25.0)}
    lost = journal.orphans(got.where("j = 'dgo'"), got.where("j = 'site'"), 2250.0)
    assert sorted((r.path, r.out_usd) for r in lost.collect()) == [("a", 11.0), ("b", 13.0)]
