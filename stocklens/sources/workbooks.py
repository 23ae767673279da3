"""Bulk reading of spreadsheet files into a long table of cells.

Spark lists and splits the files; a task unpacks its files one after another with the standard library. The binary
source packs files into tasks up to ``spark.sql.files.maxPartitionBytes``, so no repartitioning is needed and the bytes
are never shuffled: lower that setting for more parallelism.
"""

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stocklens.schemas import EMPTY_CELL_TEXTS, TEXTS

WORKBOOK_GLOB = "*.[xX][lL][sS][xX]"
CELL_SCHEMA = "path string, row_idx int, col_idx int, value string, error string"
_ROWS_PER_BATCH = 20_000

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that mean a date or time.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def is_workbook(path: Column) -> Column:
    """Whether a path has the ending the reader takes."""
    return F.lower(path).endswith(".xlsx")


def workbook_files(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """Spreadsheet files under ``folder``: path, length, modification time and, on request, bytes."""
    columns = ["path", "length", "modificationTime"] + (["content"] if with_content else [])
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", WORKBOOK_GLOB)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(*columns)
    )


def read_workbooks(spark: SparkSession, folder: str, max_bytes: int | None = None) -> DataFrame:
    """Non-empty cells of the first sheet of every workbook.

    A file that cannot be read gives one row with ``error`` set, and so does one above ``max_bytes``, if given. The size
    filter reaches the binary source, which then never loads the content of such files.
    """
    files = workbook_files(spark, folder, with_content=True)
    if max_bytes is None:
        return cells_of(files)
    too_large = workbook_files(spark, folder).filter(F.col("length") > max_bytes)
    return cells_of(files.filter(F.col("length") <= max_bytes)).unionByName(
        too_large.select("path", F.lit(TEXTS["file_too_large"]).alias("error")), allowMissingColumns=True
    )


def cells_of(files: DataFrame) -> DataFrame:
    """Cells of workbooks given as (path, content)."""
    return files.select("path", "content").mapInPandas(_unpack, CELL_SCHEMA)


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "row_idx", "col_idx", "value", "error"]
    pending: list[tuple] = []
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                for row, column, value in sheet_cells(bytes(content)):
                    pending.append((path, row, column, value, None))
                    if len(pending) >= _ROWS_PER_BATCH:
                        yield _frame(pending, columns)
                        pending = []
            except Exception as problem:  # a broken upload must not stop the others
                pending.append((path, None, None, None, f"{type(problem).__name__}: {problem}"))
    if pending:
        yield _frame(pending, columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    return frame.astype({"row_idx": "Int32", "col_idx": "Int32"})


def sheet_cells(content: bytes) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the first sheet. Cells are placed by their reference, so gaps do not shift values."""
    with zipfile.ZipFile(BytesIO(content)) as archive:
        names = set(archive.namelist())
        strings = _shared_strings(archive) if "xl/sharedStrings.xml" in names else []
        date_styles = _date_styles(archive) if "xl/styles.xml" in names else set()
        sheet, epoch = _first_sheet(archive, names)
        row = column = -1
        with archive.open(sheet) as stream:
            for event, node in ElementTree.iterparse(stream, events=("start", "end")):
                if event == "start" and node.tag == f"{_MAIN}row":
                    row = int(node.get("r")) - 1 if node.get("r") else row + 1
                    column = -1
                elif event == "end" and node.tag == f"{_MAIN}c":
                    reference = re.match(r"[A-Z]+", node.get("r") or "")
                    column = _column_number(reference.group()) if reference else column + 1
                    text = _cell_text(node, strings, date_styles, epoch)
                    if text.strip() not in EMPTY_CELL_TEXTS:
                        yield row, column, text
                elif event == "end" and node.tag == f"{_MAIN}row":
                    node.clear()


def _column_number(letters: str) -> int:
    number = 0
    for letter in letters:
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _text_of(node: ElementTree.Element) -> str:
    """Text of a string item without its phonetic hints."""
    parts = [node.findtext(f"{_MAIN}t") or ""]
    parts += [run.findtext(f"{_MAIN}t") or "" for run in node.findall(f"{_MAIN}r")]
    return "".join(parts)


def _shared_strings(archive: zipfile.ZipFile) -> list[str]:
    """Shared texts, read item by item: only the texts are kept, never the tree of the whole part."""
    found = []
    with archive.open("xl/sharedStrings.xml") as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag == f"{_MAIN}si":
                found.append(_text_of(node))
                node.clear()
    return found


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Positions of the cell styles that show a number as a date."""
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    dates = set(_DATE_FORMATS)
    for fmt in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", fmt.get("formatCode", "")).lower()
        if re.search("[ymdhs]", code.replace("general", "")):
            dates.add(int(fmt.get("numFmtId")))
    styles = root.find(f"{_MAIN}cellXfs")
    found = styles.findall(f"{_MAIN}xf") if styles is not None else []
    return {i for i, style in enumerate(found) if int(style.get("numFmtId", "0")) in dates}


def _first_sheet(archive: zipfile.ZipFile, names: set[str]) -> tuple[str, datetime]:
    """Part name of the first sheet in tab order, and day zero of the workbook's date numbers."""
    sheet, epoch = "xl/worksheets/sheet1.xml", datetime(1899, 12, 30)
    if "xl/workbook.xml" in names:
        root = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        settings = root.find(f"{_MAIN}workbookPr")
        if settings is not None and settings.get("date1904") in ("1", "true"):
            epoch = datetime(1904, 1, 1)
        first = root.find(f"{_MAIN}sheets/{_MAIN}sheet")
        if first is not None and "xl/_rels/workbook.xml.rels" in names:
            links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
            for link in links:
                if link.get("Id") == first.get(f"{_RELS}id"):
                    target = link.get("Target", "")
                    sheet = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return sheet, epoch


def _cell_text(node: ElementTree.Element, strings: list[str], date_styles: set[int], epoch: datetime) -> str:
    kind = node.get("t", "n")
    if kind == "inlineStr":
        inline = node.find(f"{_MAIN}is")
        return "" if inline is None else _text_of(inline)
    value = node.findtext(f"{_MAIN}v") or ""
    if kind == "s":
        return strings[int(value)] if value else ""
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "e":
        return ""
    if kind == "n" and value and int(node.get("s", "0")) in date_styles:
        return str(epoch + timedelta(seconds=round(float(value) * 86400)))
    return value
