"""Delimited text as cells: separators are sniffed, blank lines keep their place, ragged rows are kept."""

from __future__ import annotations

import csv
import io
import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet string, row long, col int, raw string"
#: Fixed: what a reader takes for a missing value.
MISSING = {"", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"}


def decode(content: bytes) -> str:
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def sniffed(text: str, tabbed: bool) -> str:
    """The separator of , ; tab | that most lines agree on; a comma where none is found."""
    if tabbed:
        return "\t"
    lines = [line for line in text.splitlines()[:50] if line.strip()]
    score = {s: (sum(line.count(s) == lines[0].count(s) > 0 for line in lines), lines[0].count(s)) for s in ",;\t|"} if lines else {}
    return max(score, key=score.get) if score and max(score.values())[1] else ","


def grid(content: bytes, name: str) -> list[list[str]]:
    text = decode(content)
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=sniffed(text, name.lower().endswith(".tsv"))))


def sheet_name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2].rpartition(".")[0].lower()


def _cells(batches):
    import pandas as pd

    for batch in batches:
        out = []
        for path, content in zip(batch.path, batch.content, strict=True):
            for i, line in enumerate(grid(content, path)):
                out += [(path, sheet_name(path), i, j, v) for j, v in enumerate(line) if v.strip() not in MISSING]
        yield pd.DataFrame(out, columns=["path", "sheet", "row", "col", "raw"])


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every .csv, .tsv and .txt file under a path; a task for each file."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(csv|tsv|txt)$"))
    return files.select("path", "content").mapInPandas(_cells, CELLS)


# One file by several tasks

_FIELD = r'(?:"(?:[^"]|"")*+"(?!")(?:[^{s}"][^{s}]*+)?+|(?:[^"{s}][^{s}]*+)?+)'


@cache
def _automaton(separator: str):
    """Patterns of lines that end outside of quotes, if they begin outside, and if they begin inside of some."""
    s = re.escape(separator)
    field = _FIELD.format(s=s)
    rest = rf"(?:{s}{field})*+"
    outside, inside = rf"{field}{rest}", rf'(?:[^"]|"")*+"(?!")(?:[^{s}"][^{s}]*+)?+{rest}'
    return tuple(re.compile(rf"(?s:{p})\r?\Z") for p in (outside, inside))


def quoting(line: str, separator: str) -> tuple[bool, bool]:
    """Whether a line ends inside quotes: if it begins outside of them, and if it begins inside."""
    if '"' not in line:
        return False, True
    outside, inside = _automaton(separator)
    return not outside.match(line), not inside.match(line)


def _line_ends(separator: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ends = [quoting(v, separator) for v in batch.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in ends], pa.bool_()), pa.array([b for _, b in ends], pa.bool_())], names=[*batch.schema.names, "from_out", "from_in"])

    return run


def _rows_of(separator: str):
    """The rows of records; a record of several lines, or with line ends of old kinds, may be several."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for block, id_, value in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "value")), strict=True):
                rows = list(csv.reader(io.StringIO(value, newline=""), delimiter=separator)) or [[]]
                out += [(block, id_, k, row) for k, row in enumerate(rows)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(pa.string()))], names=["block", "id", "part", "fields"])

    return run


def read_split(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(path, sheet, row, col, raw) of one large UTF-8 file, whose byte ranges are read by tasks of their own.

    Spark hands out lines, and a line alone doesn't say whether it begins inside of quotes. But it
    says how it ends in either case: always outside, always inside, as it began, or turned round. So
    the state before a line is that of the last line above that ends in one way, turned as often
    as lines since then turn it: two scans over ranges. Lines that begin and end outside are
    records; only the others are gathered, so that a record is a task's and a file never is.

    The cells are those of `csv.reader` over the whole. Line ends of \\r alone split rows, not ranges.
    """
    from gridwright.functions.cells import stripped
    from gridwright.operators import scans

    lines = spark.read.option("lineSep", "\n").text(path)
    if separator is None:
        separator = sniffed("\n".join(r[0] for r in lines.limit(50).collect()), path.lower().endswith(".tsv"))
    placed = lines.select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    first = (F.col("block") == 0) & (F.col("id") == 0)
    clean = placed.withColumn("value", F.when(first, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))
    ended = clean.mapInArrow(_line_ends(separator), "block long, id long, value string, from_out boolean, from_in boolean")
    order = ["block", "id"]
    parts = scans.ranged(ended, [], order, "delimited-lines")
    turned = scans.running(parts, [], order, (F.col("from_out") & ~F.col("from_in")).cast("long"), "turns")
    sure = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("inside"), F.col("turns")))
    known = scans.carried(turned, [], order, sure, "last", above=True)
    inside = F.coalesce(F.col("last.inside"), F.lit(False)) != ((F.col("turns") - F.coalesce("last.turns", F.lit(0))) % 2 == 1)
    told = known.select(*order, "value", scans.PART, inside.alias("begins"), F.when(inside, F.col("from_in")).otherwise(F.col("from_out")).alias("ends"))
    whole = told.where("not begins and not ends").select(*order, "value")
    # the lines of a record take the place of its first
    torn = scans.carried(told, [], order, F.when(~F.col("begins"), F.struct(*order)), "record").where("begins or ends")
    joined = torn.groupBy("record").agg(F.array_sort(F.collect_list(F.struct(*order, "value"))).alias("x")).select("record.*", F.array_join(F.transform("x", lambda x: x["value"]), "\n").alias("value"))
    rows = whole.unionByName(joined).mapInArrow(_rows_of(separator), "block long, id long, part int, fields array<string>")
    numbered = scans.placed(scans.ranged(rows, [], ["block", "id", "part"], "delimited-rows"), [], ["block", "id", "part"], "row")
    cells = numbered.select(F.lit(path).alias("path"), F.lit(sheet_name(path)).alias("sheet"), "row", F.posexplode("fields").alias("col", "raw"))
    return cells.where(~stripped(F.col("raw")).isin(sorted(MISSING)))
