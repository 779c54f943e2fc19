"""Spreadsheets (.xlsx) without a library of their own: a workbook is a ZIP archive of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATED = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: What XML can't hold, and rows that a sheet holds at most.
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
MOST_ROWS = 1_048_575


def column_name(i: int) -> str:
    """0 is A, 25 is Z, 26 is AA."""
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_number(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _cell(reference: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{reference}"><v>{value!r}</v></c>'
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(value)))}</t></is></c>'


def workbook(columns: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet with a header row."""
    lines = [f'<row r="{k}">' + "".join(_cell(f"{column_name(i)}{k}", v) for i, v in enumerate(row)) + "</row>" for k, row in enumerate([tuple(columns), *rows], 1)]
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATED}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_RELATED}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATED}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def parsed(data: bytes) -> list[list[str | None]]:
    """The rows of a workbook's first sheet, as texts."""
    tag = lambda name: f"{{{_MAIN}}}{name}"
    said = lambda e: "".join(t.text or "" for t in e.iter(tag("t")))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [said(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(tag("si"))] if "xl/sharedStrings.xml" in names else []
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        sheet = ElementTree.fromstring(z.read(first))
    rows = []
    for row in sheet.iter(tag("row")):
        cells: list[str | None] = []
        for c in row.iter(tag("c")):
            at = column_number(c.get("r", "")) if c.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            value = c.find(tag("v"))
            kind = c.get("t")
            cells[at] = said(c) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else str(value.text == "1").lower() if kind == "b" else value.text
        rows.append(cells)
    return rows


def write_sheet(df: DataFrame, path: str) -> str:
    """A small table as one workbook; more rows than a sheet holds are an error (write CSV or Parquet then)."""
    spark = df.sparkSession
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a sheet holds {MOST_ROWS} rows")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(workbook(df.columns, [tuple(r) for r in rows])))
    out.close()
    return path


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of all workbooks at the path; the first one's header names the columns, which are strings."""
    books = spark.read.format("binaryFile").load(path).select("path", "content")
    head = books.orderBy("path").limit(1).collect()
    if not head:
        raise FileNotFoundError(path)
    columns = [c or f"column{i}" for i, c in enumerate(next(iter(parsed(bytes(head[0].content))), []))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [(r + [None] * len(columns))[: len(columns)] for r in parsed(content.as_py())[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(columns))], names=[f"c{i}" for i in range(len(columns))])

    out = books.select("content").mapInArrow(run, ", ".join(f"c{i} string" for i in range(len(columns))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
