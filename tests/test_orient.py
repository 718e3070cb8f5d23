"""Whole sheets: each shape of layout is recognised and read."""

import datetime as dt

import pytest

from gridwright.operators import orient as O

D = [dt.date(2024, 1, d).strftime("%d/%m/%Y") for d in (1, 2, 3)]
JULY = [dt.date(2025, 7, d).strftime("%d/%m/%Y") for d in range(1, 18)]
SHEETS = {
    "tidy": [["Rapport statistique"], ["PARCELLE", "ANNEE", "HA", "REGIMES"], ["BLOC 2019", 2019, 10, 100], [None, 2019, 12, 120], ["BLOC 2020", 2020, 8, 80]],
    "matrix": [["PRODUCTION USINE"], ["METRIC", *D], ["Regimes", 10, 20, 30], ["Tonnage", 5, 6, 7]],
    "years": [["PROJECTIONS"], [None, "2019-2021", 2025, 2026, 2027, "GT"], ["HECTARES", 475, 304, 800, 1200, 2779], ["PRODUCTION", None, 1186.8, 3353, 4704, 9243.8], ["REVENUES", None, 238939, 771190, 1081920, 2092049]],
    "months": [["ESTIMATION PRODUCTION 2026"], ["POSTE", "Janvier", "Février", "Mars"], ["CPO", 1, 2, 3], ["FFB", 4, 5, 6]],
    "two years": [["PRODUCTION 2025 et 2026"], ["POSTE", "Janvier", "Février", "Mars"], ["CPO", 1, 2, 3], ["FFB", 4, 5, 6]],
    "form": [["Fiche des operations"], ["Date", "01/01/2024"], ["Operateur", "Jean"], ["Bloc", "B12"], ["Note", "ras"]],
    "groups": [["Bloc", None, "Production", None], ["ID", "Name", "Jan", "Feb"], ["1", "A", 10, 20], ["2", "B", 30, 40]],
    "gaps": [["BUDGET 2026", None, None, "Jan", "Fev", "Mar"], ["Description", "Unité", "Qté", None, None, None], ["Semences", "nbre", 100, 10, 20, 30], ["Machettes", "pièce", 5, 1, 2, 2]],
    "blank name": [["PARCELLE", None, "HA"], ["BLOC 1", "a", 10], ["BLOC 2", "b", 8]],
    "french": [["PARCELLE", "RENDEMENT", "TAUX"], ["BLOC 1", "1 234,5", "12%"], ["BLOC 2", "2 000", "8%"]],
    "bands of years": [["ITEM", "DEPENSES"], [None, "Description", "Unité", "Qté"], [], [None] * 4 + [2026, 2026, 2027, 2027], [None, "SECTION A"], [1, "Machette", "Pièce", 8, 50, 400, 50, 400], [2, "Pelle", "Pièce", 4, 10, 80, 10, 80], [3, "Lime", "Pièce", 10, 2, 20, 2, 20]],
    "side by side": [["PARCELLE", "HA", "REGIMES", None, "POSTE", "BUDGET", "REEL"], ["BLOC 1", 10, 100, None, "Salaires", 60, 58], ["BLOC 2", 12, 120, None, "Carburant", 15, 19], ["BLOC 3", 8, 80, None, "Entretien", 9, 9]],
    "stacked": [["ESTIMATION DE PRODUCTION"], ["ANNEE", "HA", "JUIL", "AOUT", "TOTAL"], [2019, 112, 52, 69, 121], [2020, 225, 78, 104, 182], [2021, 140, 26, 35, 61], *[[] for _ in range(12)], ["BUDGET", *JULY], ["FFB RECU", *range(1, 18)], ["CPO PRODUIT", *range(2, 36, 2)]],
    "unknown": [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12]],
    "empty": [[None, " "], ["#N/A", None]],
}


@pytest.fixture(scope="module")
def read(spark):
    cells = [(name, i, j, str(v)) for name, rows in SHEETS.items() for i, row in enumerate(rows) for j, v in enumerate(row) if v is not None]
    regions, placed = O.orient(spark.createDataFrame(cells, "sheet string, row long, col int, raw string"))
    return regions, placed.cache()


def test_orientations(read):
    regions, _ = read
    got = {r.sheet: r.orientation for r in O.sheet_orientations(regions).collect()}
    tidy = ["tidy", "two years", "groups", "gaps", "blank name", "french", "bands of years"]
    want = {**dict.fromkeys(tidy, "tidy"), **dict.fromkeys(["matrix", "years", "months"], "matrix"), "form": "form", "side by side": "multi", "stacked": "multi", "unknown": "unknown"}
    assert got == want
    parts = {r.region: (r.orientation, r.axis, r.header_rows) for r in regions.collect()}
    assert parts["matrix"] == ("matrix", "date", [1]) and parts["years"] == ("matrix", "year", [1]) and parts["months"] == ("matrix", "date", [1])
    assert parts["side by side#1"] == parts["side by side#2"] == ("tidy", None, [0])
    assert parts["stacked/1"][0] == "tidy" and parts["stacked/2"] == ("matrix", "date", [17])
    assert parts["bands of years"] == ("tidy", None, [0, 1, 3])
    assert all(0 <= r.confidence <= 1 for r in regions.collect())


def test_tables(read):
    regions, cells = read
    facts = O.tidy_tables(cells, regions).collect()
    names = lambda region: [n for _, n in sorted({(r.ord, r["name"]) for r in facts if r.region == region})]
    assert names("tidy") == ["PARCELLE", "ANNEE", "HA", "REGIMES"]
    assert names("groups") == ["Bloc / ID", "Bloc / Name", "Production / Jan", "Production / Feb"]
    assert names("blank name") == ["PARCELLE", "col_2", "HA"]
    assert names("bands of years")[-4:] == ["2026", "2026.1", "2027", "2027.1"] or names("bands of years")[-1].endswith("2027.1")
    ghosts = [(r.row, r["name"], r.raw) for r in facts if r.region == "tidy" and r.is_ghost]
    assert ghosts == [(3, "PARCELLE", "BLOC 2019")]
    assert {r.num for r in facts if r.region == "french" and r["name"] == "RENDEMENT"} == {1234.5, 2000.0}
    assert all(not r.is_label for r in facts if r["name"] == "HA")


def test_cross_tabs_forms_and_items(spark, read):
    regions, cells = read
    tab = {(r.region, r.label, r.period): r.value for r in O.cross_tab_facts(cells, regions).collect()}
    assert tab["matrix", "Regimes", "2024-01-02"] == 20 and tab["years", "HECTARES", "2025"] == 304 and tab["years", "HECTARES", "2019"] == 475
    assert tab["months", "FFB", "2026-02-01"] == 5 and tab["stacked/2", "CPO PRODUIT", "2025-07-17"] == 34
    assert not any(k[0] == "two years" for k in tab)
    form = {r.field: r.value for r in O.form_fields(cells, regions).collect()}
    assert form["Operateur"] == "Jean" and form["Fiche des operations"] is None
    facts = O.tidy_tables(cells, regions)
    items = O.line_items(facts, "HA", "PARCELLE").where("region = 'tidy'").orderBy("k").collect()
    assert [(r.label, r.value, r.n_items) for r in items] == [("BLOC 2019", 12.0, 3), ("BLOC 2019", 10.0, 3), ("BLOC 2020", 8.0, 3)]
    table = O.wide(facts, "tidy", ["PARCELLE", "HA"]).orderBy("row").collect()
    assert [(r.row, r.PARCELLE, r.HA) for r in table] == [(2, "BLOC 2019", 10.0), (3, "BLOC 2019", 12.0), (4, "BLOC 2020", 8.0)]
    top = O.preview(cells.where("sheet = 'stacked' and row < 99")).agg({"row": "max", "col": "max"}).first()
    assert max(top) < 12
