"""One delimited file read by many tasks, against csv.reader over the whole."""

import csv
import io
import random

import pytest


def test_line_automaton_against_the_reader():
    """How a line ends, from either state, is what the reader makes of it."""
    from gridwright.sources.delimited import quoting

    rng = random.Random(2)
    for _ in range(20_000):
        line = "".join(rng.choice('",a,"b ') for _ in range(rng.randint(0, 9)))
        for begins, before in ((0, ""), (1, '"x\n')):
            rows = list(csv.reader(io.StringIO(before + line + "\nQ\n", newline="")))
            inside = not rows[-1] == ["Q"]
            assert quoting(line, ",")[begins] == inside, (line, begins)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cells_of_a_split_file(spark, tmp_path, end):
    from gridwright.sources.delimited import MISSING, grid, read_split

    rng = random.Random(end)
    value = lambda: rng.choice(["", "a", "12,5", 'say "x"', f"two{end}lines", f'q"{end}"', "é", " b ", "NA", "3"])
    text = io.StringIO(newline="")
    writer = csv.writer(text, lineterminator=end)
    writer.writerow(["name", "n", "note"])
    for _ in range(400):
        if rng.random() < 0.1:
            text.write(rng.choice(["", 'x,5" pipe,"y"z"', 'a,"b"c,d']) + end)
        writer.writerow([value() for _ in range(rng.randint(1, 4))])
    raw = "﻿" + text.getvalue()
    path = tmp_path / "large.csv"
    path.write_text(raw, encoding="utf-8", newline="")
    want = sorted((i, j, v) for i, row in enumerate(grid(raw.encode(), "large.csv")) for j, v in enumerate(row) if v.strip() not in MISSING)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        got = sorted((r.row, r.col, r.raw) for r in read_split(spark, str(path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [g for g, w in zip(got, want, strict=False) if g != w][:3] == [] and len(got) == len(want)
