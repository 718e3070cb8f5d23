"""Profiles that grow with arriving files."""

import os


def test_three_arrivals_equal_the_batch(spark, tmp_path):
    from gridwright.operators import profile
    from gridwright.sources.workbook import read_files
    from gridwright.streaming.profiles import GrowingProfile, named_cells

    inbox, once = tmp_path / "in", tmp_path / "once"
    inbox.mkdir()
    once.mkdir()
    growing = GrowingProfile(spark, str(tmp_path / "store"))
    texts = {"a": "name;n;d\nx;1;2024-01-02\ny;-2,5;\n", "b": "name;n\nz;0\n;#N/A\n", "c": "n;other\n7;t\n7;u\n", "bad.xlsx": "no workbook"}
    arrivals = [["a"], ["b", "a again", "bad.xlsx"], ["c", "b again"]]
    for at, names in enumerate(arrivals):
        for name in names:
            file = inbox / (name if "." in name else f"{name.replace(' ', '-')}.csv")
            file.write_text(texts[name.split()[0]])
            # the last arrival's new file is older than what came before it
            when = 1_700_000_000 + (100 * at if name != "c" else -500)
            os.utime(file, (when, when))
        growing.run(str(inbox), str(tmp_path / "checkpoint"))
    for name in ("a", "b", "c"):
        (once / f"{name}.csv").write_text(texts[name])
    want = profile.column_profile(named_cells(read_files(spark, str(once))))
    row = lambda r: tuple(sorted(r.asDict().items()))
    assert sorted(map(row, growing.current().collect())) == sorted(map(row, want.collect())) and want.count() == 4
    told = {r.path.rpartition("/")[2]: (r.is_copy, r.is_late, r.error is not None) for r in growing.files().collect()}
    assert told == {"a.csv": (False, False, False), "b.csv": (False, False, False), "a-again.csv": (True, False, False), "bad.xlsx": (False, False, True), "c.csv": (False, True, False), "b-again.csv": (True, False, False)}
    # a batch that is handed over again changes nothing
    before = growing.store.version()
    growing.absorb(spark.read.format("binaryFile").load(str(inbox)), 1)
    assert growing.store.version() == before
