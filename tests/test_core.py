"""Operators on small sheets with known answers."""

import io
import random
import re
import zipfile

from pyspark.sql import functions as F

from gridwright.functions import cells as C
from gridwright.operators import audit, journal, layout, profile, series, story


def one(spark, expression, raw):
    return spark.createDataFrame([(raw,)], "raw string").select(expression(F.col("raw")).cast("string")).first()[0]


def many(spark, expression, raws):
    return [r[0] for r in spark.createDataFrame(list(enumerate(raws)), "i int, raw string").orderBy("i").select(expression(F.col("raw")).cast("string")).collect()]


def test_kinds(spark):
    raws = [None, "  ", "#DIV/0!", "#n/a", "31/12/2024", "2025-01-05", "janv. 2026", "mars-26", "1 234,5", "1 234,5", "12%", "-3.5e2", "Q1 Total", "Budget 2026", "2026", "Mai", "T1 2026", "True", "1_000", "5d", "inf"]
    want = ["blank"] * 4 + ["date"] * 4 + ["number"] * 4 + ["text", "text", "number", "text", "text", "text", "text", "text", "text"]
    assert many(spark, C.cell_kind, raws) == want


def test_coercion(spark):
    assert many(spark, C.coerce_number, ["1 234,5", "2 000", "12%", "1,234,567", "x", None, "1,234"]) == ["1234.5", "2000.0", "12.0", "1234567.0", None, None, "1.234"]
    dates = ["31/12/2024", "2025-01-05", "2024/01/05", "12/31/2024", "janv. 2026", "mars-26", "Aug 99", "31.12.24", "99/99/2024", "Mai"]
    assert many(spark, C.coerce_date, dates) == ["2024-12-31", "2025-01-05", "2024-01-05", "2024-12-31", "2026-01-01", "2026-03-01", "1999-08-01", "2024-12-31", None, None]
    assert many(spark, C.year_value, ["2025", "2019-2021", "1890", "2025.0", "x"]) == ["2025", "2019", None, "2025", None]
    assert many(spark, C.bare_month, ["Février", " août ", "janv.", "May"]) == ["2", "8", None, "5"]


def test_references(spark):
    got = spark.range(0, 18278, 37).select("id", C.column_letters(F.col("id")).alias("l")).withColumn("back", C.parse_a1(F.concat("l", F.lit("3")))["col"])
    assert got.where("id <> back").count() == 0
    assert many(spark, lambda c: C.parse_a1(c)["row"], ["B7", "zz10", "7B", "", "A0"]) == ["6", "9", None, None, None]


def test_words(spark):
    assert one(spark, lambda c: F.array_join(F.sort_array(C.tokens(c)), ","), "Évolution des ventes par région 2024") == "2024,evolution,region,ventes"
    assert one(spark, lambda c: F.array_join(C.identity_tokens(c), ","), "PRODUCTION CPO PREVUE") == "PRODUCTION,CPO"
    assert one(spark, C.slug, "  Société Générale & Cie ") == "societe-generale-cie"
    labels = ["Prix de vente", "Coûts d'exploitation", "Personnel Production", "Production CPO", "Cost / tonne CPO", "CPO_Produced", "Budget OPEX", "Dépenses", "Surface"]
    assert many(spark, C.role, labels) == ["price", "opex", "headcount", "volume", None, "volume", "budget", None, "area"]


def test_profile(spark):
    frame = spark.createDataFrame([("1", "a", "2024-01-01"), ("2", "a", "2024-01-02"), ("", "b", None), ("-4", None, "x")], "n string, t string, d string")
    got = {r.name: r for r in profile.column_profile(profile.long_text(frame, frame.columns)).collect()}
    assert (got["n"].dtype, got["n"].n_number, got["n"].n_blank, got["n"].sum_value, got["n"].n_negative, got["n"].fill) == ("number", 3, 1, -1.0, 1, 0.75)
    assert (got["t"].dtype, got["d"].dtype, got["d"].n_date) == ("text", "date", 2)
    values = spark.createDataFrame([("x", float(v)) for v in (1, 2, 3, 4, 100)], "name string, value double")
    row = profile.numeric_summary(values).first()
    assert (row.skew, row.median_value) == (2.232, 3.0)
    assert profile.iqr_outliers(values).first().n_outliers == 1


def test_products(spark):
    rows = [(i, float(q), float(u), float(q * u) if i != 3 else 400.0) for i, (q, u) in enumerate([(2, 5), (3, 7), (4, 9), (5, 8), (6, 11), (7, 13)])]
    frame = spark.createDataFrame(rows, "k int, qty double, unit double, amount double")
    found = audit.products(frame, ["qty", "unit", "amount"])
    assert [tuple(r) for r in found.collect()] == [("amount", "qty", "unit", 6, 5)]
    bad = audit.product_mismatches(frame, "k", ["qty", "unit", "amount"], found).collect()
    assert [(r.row_key, r.expected, r.actual, r.delta) for r in bad] == [(3, 40.0, 400.0, 360.0)]
    assert audit.products(frame.limit(2), ["qty", "unit", "amount"]).count() == 0
    assert audit.products(frame.select("k", "qty", F.lit(1.0).alias("unit"), F.col("qty").alias("amount")), ["qty", "unit", "amount"]).count() == 0


def test_row_sums(spark):
    rows = [("Salaires", 60.0, 10.0, 20.0, 30.0), ("Entretien", 27.0, 9.0, 9.0, 9.0), ("Carburant", 6.0, 1.0, 2.0, 3.0), ("Divers", 99.0, 3.0, 3.0, 3.0), ("Eau", 5.0, 5.0, None, None)]
    frame = spark.createDataFrame(rows, "poste string, total double, jan double, fev double, mar double")
    columns = ["poste", "total", "jan", "fev", "mar"]
    got = audit.row_sums(frame, columns, [False, True, True, True, True]).collect()
    assert [tuple(r) for r in got] == [("total", "jan+fev+mar", 5, 4)]
    bad = audit.row_sum_mismatches(frame, "poste", "total", ["jan", "fev", "mar"]).collect()
    assert [(r.row_key, r.expected, r.actual) for r in bad] == [("Divers", 9.0, 99.0)]


def test_totals_rows(spark):
    table = [("a", 1, 2), ("b", 3, 4), ("Total 1", 4, 6), ("c", 5, 5), ("d", 6, 7), ("Total 2", 11, 12), ("Total général", 15, 60)]
    facts = [("s", i, c, float(v), label) for i, (label, *vs) in enumerate(table) for c, v in zip("xy", vs, strict=True)]
    got = audit.totals_rows(spark.createDataFrame(facts, "region string, rec int, column string, num double, label string"))
    found = {(r.rec, r.column): (r.base, r.expected, r.actual) for r in got.collect()}
    assert {k[0] for k in found} == {2, 5, 6}
    assert found[6, "x"] == ("grand", 15.0, 15.0) and found[6, "y"] == ("grand", 18.0, 60.0)
    status = {r.rec: r.status for r in audit.column_sum_check(got).collect()}
    assert status == {2: "ok", 5: "ok", 6: "mismatch"}


def walked(table, label):
    """The plain walk: (rec, base, column, expected) of the rows of totals of one region."""
    near = lambda e, a: abs(e - a) <= max(0.01, 0.01 * abs(a))
    sums, seen, out = {"section": {}, "grand": {}}, {"section": 0, "grand": 0}, []
    for rec, (name, values) in enumerate(table):
        values = {c: v for c, v in values.items() if v is not None}
        if not values:
            continue
        hits = {b: [c for c, v in values.items() if near(sums[b].get(c, 0.0), v)] for b in sums}
        base = next((b for b in sums if seen[b] >= 2 and sum(values[c] != 0 for c in hits[b]) >= 2 and len(hits[b]) >= 0.6 * len(values)), None)
        if base is None and label(name):
            base = max((b for b in sums if seen[b] >= 1), key=lambda b: len(hits[b]), default=None)
        if base is None:
            for b in sums:
                seen[b] += 1
                for c, v in values.items():
                    sums[b][c] = sums[b].get(c, 0.0) + v
        else:
            out += [(rec, base, c, round(sums[base].get(c, 0.0), 4)) for c in values]
            sums["section"], seen["section"] = {}, 0
    return out


def test_totals_rows_against_a_walk(spark):
    """Sheets with and without labels, wrong totals, gaps, totals of totals: the rows of a walk from the top, from ranges of any size."""
    rng = random.Random(11)
    sheets = {}
    for k in range(12):
        table, section, grand = [], [0.0] * 3, [0.0] * 3
        for _ in range(rng.randint(5, 120)):
            if section[0] and rng.random() < 0.2:
                wrong = 2 if rng.random() < 0.15 else 1
                values = {c: round(v * wrong, 2) for c, v in zip("xyz", grand if rng.random() < 0.2 else section, strict=True)}
                table.append(("Total" if k % 3 == 0 and rng.random() < 0.8 else "row", values))
                section = [0.0] * 3
            else:
                values = {c: round(rng.uniform(-3, 90), 2) if rng.random() < 0.9 else rng.choice([None, 0.0]) for c in "xyz"}
                table.append((rng.choice(["row", "subtotal of sums", "Somme"]) if k % 4 == 1 else "row", values))
                section = [a + (values[c] or 0) for a, c in zip(section, "xyz", strict=True)]
                grand = [a + (values[c] or 0) for a, c in zip(grand, "xyz", strict=True)]
        sheets[f"s{k}"] = table
    facts = [(s, i, c, v, name) for s, table in sheets.items() for i, (name, values) in enumerate(table) for c, v in values.items()]
    frame = spark.createDataFrame(facts, "region string, rec long, column string, num double, label string")
    label = lambda name: re.search(r"\b(total|totaux|totales?|somme|cumul|sum)\b", name, re.IGNORECASE)
    want = sorted((s, *x) for s, table in sheets.items() for x in walked(table, label))
    assert len(want) > 100
    for apart in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", apart)
        got = audit.totals_rows(frame).collect()
        assert sorted((r.region, r.rec, r.base, r.column, round(r.expected, 4)) for r in got) == want
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert audit.totals_rows(frame.where("false")).count() == 0


def test_cross_examination(spark):
    broken = spark.createDataFrame([("p", "amount", 1), ("p", "amount", 2), ("s", "total", 2), ("p", "amount", 3)], "relation string, column string, row_key int")
    confirmed = spark.createDataFrame([("q", "amount", 3), ("p", "amount", 1)], "relation string, column string, row_key int")
    got = {(r.relation, r.row_key): r.suggest for r in audit.cross_examine(broken, confirmed).collect()}
    assert got == {("p", 1): True, ("p", 2): False, ("s", 2): False, ("p", 3): False}


def grid(spark, rows, sheet="s"):
    cells = [(sheet, i, j, str(v)) for i, row in enumerate(rows) for j, v in enumerate(row) if v is not None]
    return spark.createDataFrame(cells, "sheet string, row long, col int, raw string")


def test_islands(spark):
    beside = grid(spark, [["a", "b", None, "c", "d", "e"], ["x", 1, None, "y", 2, 3], ["z", 4, None, "w", 5, 6]])
    assert [(r["first"], r["last"]) for r in layout.islands(beside).orderBy("island").collect()] == [(0, 1), (3, 5)]
    above = grid(spark, [[1, 2, 3], [4, 5, 6], [None], [7, 8, 9], [1, 2, 3], [None], [1]])
    assert [(r["first"], r["last"]) for r in layout.islands(above, "row").orderBy("island").collect()] == [(0, 1), (3, 4)]


def test_headers_of_several_rows(spark):
    cells = grid(spark, [["Région", "2025", None, "2026", None], [None, "HA", "T", "HA", "T"], ["Nord", 1, 2, 3, 4], ["Sud", 5, 6, 7, 8]])
    cells = cells.withColumn("region", F.col("sheet"))
    heads = spark.createDataFrame([("s", 0)], "region string, header_row long")
    from gridwright.operators.headers import header_blocks, header_names

    blocks = header_blocks(layout.with_kinds(cells), heads)
    assert [(r.header_row, r.last_row) for r in blocks.collect()] == [(0, 1)]
    assert [r.name for r in header_names(cells, blocks).orderBy("col").collect()] == ["Région", "2025 / HA", "2025 / T", "2026 / HA", "2026 / T"]


def test_mapping_and_report(spark):
    from gridwright.operators import mapping, report

    wanted = spark.createDataFrame([("revenue", "CA", None), ("opex", "OPEX", "B"), ("area", "HA", "gone"), ("price", "P", None), ("volume", "V", None)], "role string, label string, sheet string")
    there = spark.createDataFrame([("A", "CA", [1, 2]), ("A", "OPEX", [1, 2]), ("B", "OPEX", [1, 2]), ("C", "HA", [1, 2]), ("A", "P", [1, 2]), ("B", "P", [1, 2])], "sheet string, label string, periods array<int>")
    got = {r.role: (r.sheet, r.error) for r in mapping.resolve(wanted, there).collect()}
    assert got == {"revenue": ("A", None), "opex": ("B", None), "area": ("C", None), "price": (None, "ambiguous"), "volume": (None, "no series")}
    spine = spark.createDataFrame([("opex", 1), ("opex", 2), ("opex", 3)], "role string, period int")
    others = spark.createDataFrame([(1, "x", "volume", p, 1.0 if p < 3 else None) for p in (1, 2, 3)] + [(2, "y", "volume", p, 2.0) for p in (1, 2, 3)], "sheet_ord int, sheet string, role string, period int, value double")
    assert [tuple(r) for r in mapping.supplement(spine, others).collect()] == [("volume", "y", 3)]
    cost = mapping.unit_cost_budget(spark.createDataFrame([(2026, 540.0, 1.0), (2026, None, 4.0)], "year int, opex double, volume double"), spark.createDataFrame([(2026, 1000.0, 2.0)], "year int, opex double, volume double")).first()
    assert tuple(cost) == (2026, 540.0, 500.0, 8.0)
    assert report.number(1234.5, "fr") == "1\u202f234,50" and report.number(1234, "en") == "1,234" and report.compact(2.5e6) == "2.5M"
    page = report.html("A & B", [("Part", wanted)])
    assert "<script" not in page and "A &amp; B" in page and "revenue" in page


def test_journal(spark):
    rows = [("a", 1, "2024-01-05", "FUEL", 0.0, 10.0, 100.0), ("a", 2, "2024-01-04", "fuel", 0.0, 10.0, 90.0), ("a", 3, "2024-02-01", "Banque", 0.0, 5.0, 80.0), ("a", 4, "2024-02-02", "RH", 0.0, 0.0, 80.0), ("b", 1, "2024-01-05", "FUEL", 0.0, 10.0, 1.0)]
    frame = spark.createDataFrame(rows, "j string, seq long, d string, code string, inU double, outU double, bal double").withColumns({"d": F.to_date("d"), "inC": F.lit(0.0), "outC": F.lit(0.0)})
    keys = lambda df: sorted((r.j, r.seq) for r in df.collect())
    assert keys(journal.zero_rows(frame)) == [("a", 4)]
    assert keys(journal.transfers_as_spend(frame)) == [("a", 3)]
    assert keys(journal.out_of_order(frame)) == [("a", 2)]
    assert keys(journal.balance_breaks(frame, "inU", "outU")) == [("a", 3)]
    codes = spark.createDataFrame([("FUEL",), ("Banque",)], "code string")
    assert [tuple(r) for r in journal.unknown_codes(frame, codes).collect()] == [("rh", 1, 0.0)]
    table = journal.code_months(frame, codes)
    assert journal.tie_out(frame, table).first().ok and table.where("code = 'UNMAPPED'").agg(F.sum("out_usd")).first()[0] == 10.0
    assert [tuple(r) for r in journal.orphans(frame.where("j = 'b'").unionByName(frame.where("seq = 3")), frame.where("j = 'a' and seq < 3"), 2250.0).collect()] == [("2024-02", "a", 3, 5.0)]
    cells = spark.createDataFrame([(1, "OPEX Plantation", None), (2, "Carburant", "FUEL01"), (3, "Siège", ""), (4, "Divers", "DGO1"), (5, "Copie", "FUEL01")], "row int, label string, code string")
    assert sorted(tuple(r) for r in journal.glossary(cells).collect()) == [("DGO1", "Divers", "Siège", "overhead"), ("FUEL01", "Carburant", "OPEX Plantation", "opex")]


def test_series(spark):
    year = spark.createDataFrame([(2025, 100.0, 60.0, 10.0), (2026, 200.0, 90.0, 20.0), (2027, 400.0, 150.0, None)], "year int, revenue double, opex double, volume double")
    got = series.derived_metrics(year).orderBy("year").collect()
    assert [r.margin for r in got] == [40, 110, 250] and [r.margin_pct for r in got] == [40, 55, 62.5] and [r.opex_per_volume for r in got] == [6, 4.5, None]
    spine = spark.createDataFrame([("a",), ("b",), ("c",)], "period string")
    foreign = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("z", 4.0)], "period string, value double")
    assert {r.period: r.aligned for r in series.align(spine, foreign).collect()} == {"a": 1.0, "b": None, "c": None}
    assert series.outside(spine, foreign).first().n_outside == 1
    cash = spark.createDataFrame([("2025", -168500.0), ("2026", 57000.0), ("2027", 404900.0), ("2028", None), ("2029", 1.0)], "y string, v double")
    walked = series.walk(cash, "y", "v").orderBy("y")
    assert [r.running for r in walked.collect()] == [-168500.0, -111500.0, 293400.0, None, None]
    turn = series.cash_turn(walked, "y").first()
    assert (turn.bridge, turn.positive_from) == (168500.0, "2027")
    labels = lambda *x: spark.createDataFrame([(v,) for v in x], "label string")
    assert [tuple(r)[:2] for r in series.match_plan(labels("PRODUCTION CPO"), labels("PRODUCTION CPO PREVUE", "PRODUCTION FFB")).collect()] == [("PRODUCTION CPO", "PRODUCTION CPO PREVUE")]


def test_story(spark):
    rows = [(f"2023-{m:02d}-15", float(m)) for m in range(1, 13)] + [("2024-01-10", 20.0)]
    frame = spark.createDataFrame(rows, "d string, v double").withColumn("d", F.to_date("d"))
    trend = story.monthly_trend(frame, "d", "v")
    change = {r.period: (r.delta, r.pct) for r in story.month_change(trend).collect()}
    assert change["2024-01"] == (8.0, 66.6667) and change["2023-01"] == (None, None)
    assert [tuple(r) for r in story.year_change(trend).select("period", "delta").collect()] == [("2024-01", 19.0)]
    assert story.time_grain(frame, "d").first().grain == "month"
    measures = spark.createDataFrame([(0, "col_3", "amount", None), (1, "Prix unitaire", "amount", "price"), (2, "Montant", "amount", None)], "ord int, name string, measure_kind string, role string")
    assert story.headline(measures).first()[0] == "Montant"
    assert [r.requires for r in story.gap_rows(frame, {"time": F.col("d").isNotNull(), "stock": F.lit(False)}).collect()] == ["stock"]


def workbook() -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Données" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Date</t></si><si><r><t>Mon</t></r><r><t>tant</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="B3" s="1"><v>45658</v></c><c r="C3"><v>12.5</v></c><c r="D3" t="inlineStr"><is><t>note</t></is></c><c r="E3" t="b"><v>1</v></c><c r="F3" t="str"><v>N/A</v></c></row></sheetData></worksheet>')
    return out.getvalue() + b"salt"


def test_workbooks_and_text(spark, tmp_path):
    from gridwright.sources.delimited import read_delimited
    from gridwright.sources.workbook import content_dedupe, merge_engagement, read_workbooks

    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.xlsx").write_bytes(b"not a workbook")
    rows = read_workbooks(spark, str(tmp_path)).collect()
    assert [(r.sheet, r.row, r.col, r.raw) for r in rows if not r.error] == [("Données", 1, 1, "Date"), ("Données", 1, 2, "Montant"), ("Données", 2, 1, "2025-01-01"), ("Données", 2, 2, "12.5"), ("Données", 2, 3, "note"), ("Données", 2, 4, "True")]
    assert sum(bool(r.error) for r in rows) == 1
    (tmp_path / "Ventes.csv").write_bytes("﻿Nom;Prix\n\nCafé;1 234,5;x\nThé;N/A\n".encode())
    (tmp_path / "copy.csv").write_bytes("﻿Nom;Prix\n\nCafé;1 234,5;x\nThé;N/A\n".encode())
    cells = read_delimited(spark, str(tmp_path)).where("sheet = 'ventes'").select("sheet", "row", "col", "raw")
    assert sorted(tuple(r)[1:] for r in cells.collect()) == [(0, 0, "Nom"), (0, 1, "Prix"), (2, 0, "Café"), (2, 1, "1 234,5"), (2, 2, "x"), (3, 0, "Thé")]
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.csv"))
    assert content_dedupe(files).first().n_copies == 2
    assert {r.sheet for r in merge_engagement(cells, cells).select("sheet").distinct().collect()} == {"ventes", "PLAN · ventes"}


def test_store(spark, tmp_path):
    from gridwright.sources.store import Store

    store = Store(spark, str(tmp_path / "store"))
    store.upsert("published", ["analysis_id"], spark.createDataFrame([("a", 1), ("b", 1)], "analysis_id string, version int"))
    store.upsert("published", ["analysis_id"], spark.createDataFrame([("a", 2)], "analysis_id string, version int"))
    assert sorted(tuple(r) for r in store.latest("published", ["analysis_id"]).select("analysis_id", "version").collect()) == [("a", 2), ("b", 1)]
    store.delete("published", ["analysis_id"], spark.createDataFrame([("b",)], "analysis_id string"))
    assert [r.analysis_id for r in store.latest("published", ["analysis_id"]).collect()] == ["a"]
    log = spark.createDataFrame([("x", 0), ("x", 10), ("x", 20), ("x", 30), ("x", 5000)], "email string, at long")
    assert [r.allowed for r in Store.throttle(log, "email", "at").orderBy("at").collect()] == [True, True, True, False, True]


def test_streams(spark, tmp_path):
    from gridwright.streaming import events as streams

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 00:20:00", "a", 2.0), (1, "2024-01-02 00:00:00", "b", 3.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert streams.sessions(rows, "1 hour").count() == 2
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.trend(live, "1 day", late="1 day").writeStream.format("memory").queryName("trend").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("trend").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_products_of_a_wide_table(spark, monkeypatch):
    """More candidates than a pass counts, of which the two products are left."""
    rng = random.Random(7)
    names = [f"c{i}" for i in range(9)]
    rows = []
    for i in range(400):
        row = {c: round(rng.uniform(1.5, 9), 3) for c in names}
        row["c3"] = round(row["c0"] * row["c1"], 6) if i % 9 else 1.0
        row["c7"] = round(row["c4"] * row["c6"], 6)
        rows.append(tuple(row[c] for c in names))
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    monkeypatch.setattr(audit, "CANDIDATES", 90)
    found = {(r.target, r.a, r.b): (r.n_checked, r.n_matched) for r in audit.products(table, names).collect()}
    assert found == {("c3", "c0", "c1"): (400, 355), ("c7", "c4", "c6"): (400, 400)}
    assert audit.products_left_out([f"c{i}" for i in range(32)]) == ["c30", "c31"]
