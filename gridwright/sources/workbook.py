"""Workbooks (.xlsx, .xlsm, .ods) as cells, read from their XML. Other binary formats give an error row."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.sources.delimited import MISSING

CELLS = "path string, sheet string, sheet_ord int, row long, col int, raw string, error string"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
#: Fixed: number formats that show a date.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
Cell = tuple[str, int, int, int, str]


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits) - 1, col - 1


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _day(serial: float, epoch: dt.datetime) -> str:
    moment = epoch + dt.timedelta(days=serial)
    return moment.date().isoformat() if moment.time() == dt.time(0) else moment.isoformat(sep=" ", timespec="seconds")


def xlsx_cells(content: bytes) -> Iterator[Cell]:
    """(sheet, place of the sheet, row, col, raw) of each cell with a value."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        xml = lambda name: ElementTree.fromstring(book.read(name))
        shared = [_text(si) for si in xml("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        dates = set()
        if "xl/styles.xml" in names:
            styles = xml("xl/styles.xml")
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if re.search(r"[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower())) and "general" not in f.get("formatCode", "").lower()}
            formats = styles.find(f"{MAIN}cellXfs")
            dates = {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}
        root = xml("xl/workbook.xml")
        properties = root.find(f"{MAIN}workbookPr")
        epoch = dt.datetime(1904, 1, 1) if properties is not None and properties.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        for ord_, sheet in enumerate(root.iter(f"{MAIN}sheet")):
            target = targets[sheet.get(f"{LINK}id")]
            with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
                at = [-1, -1]
                for event, node in ElementTree.iterparse(part, ("start", "end")):
                    if event == "start" and node.tag == f"{MAIN}row":
                        at = [int(node.get("r", at[0] + 2)) - 1, -1]
                    elif event == "end" and node.tag == f"{MAIN}c":
                        row, col = _place(node.get("r")) if node.get("r") else (at[0], at[1] + 1)
                        at[1] = col
                        kind, value = node.get("t", "n"), node.find(f"{MAIN}v")
                        raw = _text(node) if kind == "inlineStr" else None if value is None else value.text or ""
                        if raw is not None:
                            if kind == "s":
                                raw = shared[int(raw)]
                            elif kind == "b":
                                raw = "True" if raw == "1" else "False"
                            elif kind == "n" and raw:
                                raw = _day(float(raw), epoch) if int(node.get("s", 0)) in dates else _number(raw)
                            if raw.strip() not in MISSING:
                                yield sheet.get("name"), ord_, row, col, raw
                        node.clear()


def ods_cells(content: bytes) -> Iterator[Cell]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        root = ElementTree.fromstring(book.read("content.xml"))
    for ord_, table in enumerate(root.iter(f"{TABLE}table")):
        row = 0
        for line in table.iter(f"{TABLE}table-row"):
            again, col = int(line.get(f"{TABLE}number-rows-repeated", 1)), 0
            found = []
            for cell in line:
                times = int(cell.get(f"{TABLE}number-columns-repeated", 1))
                kind = cell.get(f"{OFFICE}value-type")
                if kind in ("float", "percentage", "currency"):
                    raw = _number(cell.get(f"{OFFICE}value"))
                elif kind == "date":
                    raw = cell.get(f"{OFFICE}date-value").replace("T", " ")
                elif kind == "boolean":
                    raw = cell.get(f"{OFFICE}boolean-value", "").capitalize()
                else:
                    raw = "\n".join("".join(p.itertext()) for p in cell if p.tag.endswith("}p"))
                if raw.strip() not in MISSING:
                    found += [(col + k, raw) for k in range(times)]
                col += times
            if found:
                for k in range(again):
                    for c, raw in found:
                        yield table.get(f"{TABLE}name"), ord_, row + k, c, raw
            row += again


def book_cells(content: bytes, path: str) -> Iterator[Cell]:
    yield from ods_cells(content) if path.lower().endswith(".ods") else xlsx_cells(content)


def _cells(batches):
    import pandas as pd

    names = ["path", "sheet", "sheet_ord", "row", "col", "raw", "error"]
    for batch in batches:
        for path, content in zip(batch.path, batch.content, strict=True):
            rows = []
            try:
                for cell in book_cells(content, path):
                    rows.append((path, *cell, None))
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            except Exception as e:  # a file that can't be read is reported, and the others are read
                rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names).astype({"sheet_ord": "Int32", "row": "Int64", "col": "Int32"})


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every workbook under a path; a task for each file, a row with `error` for one that can't be read."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(xlsx|xlsm|xlsb|xls|ods)$"))
    return files.select("path", "content").mapInPandas(_cells, CELLS)


def content_dedupe(files: DataFrame) -> DataFrame:
    """One of the files with equal content, the first by path."""
    return files.select("path", F.sha2("content", 256).alias("sha256")).groupBy("sha256").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n_copies"))


def first_copies(files: DataFrame) -> DataFrame:
    """(path, n_copies): the first by path of files with one `sha256`."""
    return files.groupBy("sha256").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n_copies")).select("path", "n_copies")


def merge_engagement(actuals: DataFrame, plans: DataFrame) -> DataFrame:
    """The cells of two workbooks together; sheets of the plan are renamed."""
    return actuals.unionByName(plans.withColumn("sheet", F.concat(F.lit("PLAN · "), F.col("sheet"))))


#: Fixed limits of what is taken: bytes of a file, and rows times columns of all its sheets.
MOST_BYTES, MOST_CELLS = 25 << 20, 1_500_000


def refusals(files: DataFrame) -> DataFrame:
    """(path, reason) of files that aren't taken: empty ones and those over MOST_BYTES. `files`: path, length."""
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too large")
    return files.withColumn("reason", reason).where("reason is not null").select("path", "reason")


def too_many_cells(cells: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """(path, n_cells) of workbooks whose sheets span more than `most` cells, blank ones counted."""
    boxes = cells.groupBy("path", "sheet").agg(((F.max("row") + 1) * (F.max("col") + 1)).cast("long").alias("n"))
    return boxes.groupBy("path").agg(F.sum("n").alias("n_cells")).where(F.col("n_cells") > most)


def sheet_names(sheets: DataFrame, longest: int = 31, most: int = 99) -> DataFrame:
    """(path, sheet_ord, sheet, name): names of `longest` characters at most, each once in a workbook, whatever their case.

    Those that are taken get a number, 2 to `most`, behind their first characters; null beyond. A
    numbered name that is another's own is passed over, by sheets in order.
    """
    cut = sheets.withColumn("base", F.substring("sheet", 1, longest))
    k = F.row_number().over(W.partitionBy("path", F.lower("base")).orderBy("sheet_ord"))
    taken = F.collect_set(F.lower("base")).over(W.partitionBy("path"))
    numbered = F.transform(F.sequence(F.lit(2), F.lit(most)), lambda i: F.concat(F.substring("base", 1, longest - 3), F.lit(" "), i.cast("string")))
    free = F.filter(numbered, lambda n: ~F.array_contains(F.col("taken"), F.lower(n)))
    named = cut.withColumns({"k": k, "taken": taken})
    return named.select("path", "sheet_ord", "sheet", F.when(F.col("k") == 1, F.col("base")).otherwise(F.get(free, F.col("k") - 2)).alias("name"))


def _any_cells(batches):
    """Cells of files of any kind: by their extension, and else as a workbook, and else as text."""
    import pandas as pd

    from gridwright.sources.delimited import grid, sheet_name

    names = ["path", "sheet", "sheet_ord", "row", "col", "raw", "error"]

    def text_cells(content: bytes, path: str):
        for i, line in enumerate(grid(content, path)):
            for j, value in enumerate(line):
                if value.strip() not in MISSING:
                    yield sheet_name(path), 0, i, j, value

    for batch in batches:
        for path, content in zip(batch.path, batch.content, strict=True):
            kind = path.lower().rpartition(".")[2]
            readers = [text_cells] if kind in ("csv", "tsv", "txt") else [book_cells] if kind in ("xlsx", "xlsm", "xlsb", "xls", "ods") else [book_cells, text_cells]
            rows, error = [], None
            for reader in readers:
                try:
                    rows, error = [(path, *cell, None) for cell in reader(content, path)], None
                    break
                except Exception as e:  # the next reader tries, and the last one's error is the file's
                    error = f"{type(e).__name__}: {e}"
            if error:
                rows = [(path, None, None, None, None, None, error)]
            yield pd.DataFrame(rows, columns=names).astype({"sheet_ord": "Int32", "row": "Int64", "col": "Int32"})


def cells_of(files: DataFrame) -> DataFrame:
    """Cells of files (path, content), whatever their extension; a row with `error` for one that no reader takes."""
    return files.select("path", "content").mapInPandas(_any_cells, CELLS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every file under a path."""
    return cells_of(spark.read.format("binaryFile").load(path))
