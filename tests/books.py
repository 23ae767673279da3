"""Spreadsheet files built by hand."""

import zipfile
from io import BytesIO
from xml.sax.saxutils import escape

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
STYLES = (
    f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>'
)


class Date(float):
    """A serial number shown as a date."""


def letters(column):
    text = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        text = chr(65 + rest) + text
    return text


def workbook(rows, inline=False):
    """Bytes of a workbook; None leaves a cell out altogether, and an empty row is left out too."""
    strings, body = [], []
    for r, row in enumerate(rows):
        cells = []
        for c, value in enumerate(row):
            ref = f'r="{letters(c)}{r + 1}"'
            if value is None:
                continue
            if isinstance(value, Date):
                cells.append(f'<c {ref} s="{1 + r % 2}"><v>{float(value)}</v></c>')
            elif isinstance(value, bool):
                cells.append(f'<c {ref} t="b"><v>{int(value)}</v></c>')
            elif isinstance(value, (int, float)):
                cells.append(f"<c {ref}><v>{value}</v></c>")
            elif inline:
                cells.append(f'<c {ref} t="inlineStr"><is><t>{escape(value)}</t></is></c>')
            else:
                strings.append(value)
                cells.append(f'<c {ref} t="s"><v>{len(strings) - 1}</v></c>')
        if cells:
            body.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
    buffer = BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{''.join(body)}</sheetData></worksheet>")
        archive.writestr("xl/styles.xml", STYLES)
        if strings:
            items = "".join(f"<si><r><t>{escape(s[:2])}</t></r><r><t>{escape(s[2:])}</t></r></si>" for s in strings)
            archive.writestr("xl/sharedStrings.xml", f"<sst {NS}>{items}</sst>")
    return buffer.getvalue()


PLAIN = [["product_name", "category", "price", "quantity", "date"], ["Silk saree", "Sarees", 2899, 12, "2024-03-01"]]
BOOKS = {
    "plain.xlsx": workbook(PLAIN),
    "title_rows.XLSX": workbook(
        [["Stock list"], ["Printed", "today"], [], ["Product", "Type", "Unit Price", "Stock"], ["Kurti", "Kurtis", 10.5, 3]]
    ),
    "aliases.xlsx": workbook(
        [["Item Name", "Dept", "Rate", "Qty", "Order Date"], ["Tote", "Accessories", "799", 20, Date(45292)]]
    ),
    "unmapped.xlsx": workbook([["product", "quantity"], ["Top", 4]]),
    "sparse.xlsx": workbook(
        [
            [None, "product name", "empty", None, "price", "quantity"],
            [],
            [None, "Shirt", None, "stray", 5, 6],
            [None, None, None, None, None, None, "far"],
            [None, "Belt", None, None, 7, 8],
        ]
    ),
    "inline.xlsx": workbook(PLAIN, inline=True),
    "rejects.xlsx": workbook(
        [
            ["product_name", "price", "quantity", "date"],
            ["Good", 1, 2, Date(45293)],
            ["Text price", "cheap", 2],
            [" ", 1, 2],
            ["Cut", 1, "3.5"],
            ["Minus", 1, -4],
            ["No count", 1, "some"],
        ]
    ),
    "no_category.xlsx": workbook([["product", "price", "stock"], ["Scarf", 3, 4]]),
    "broken.xlsx": b"not a zip file",
    "notes.txt": b"ignored",
}


def write_books(folder, names=None):
    for name in names or BOOKS:
        (folder / name).write_bytes(BOOKS[name])
