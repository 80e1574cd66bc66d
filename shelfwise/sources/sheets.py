"""Price lists in workbooks (XLSX): read from binary files, checked, and written as templates."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = "path string, sheet string, row int, cells map<string,string>, error string"
_ARROW = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
_BATCH = 1000
#: Bytes of a sheet that are parsed at a time.
_PIECE = 1 << 16


class _Numbers(dict):
    """The column of a cell reference's letters: B is 1, none is null."""

    def __missing__(self, letters: str) -> int | None:
        n = 0
        for c in letters:
            n = n * 26 + ord(c.upper()) - 64
        self[letters] = number = n - 1 if n else None
        return number


class _Locals(dict):
    """Names without their namespaces, each cut once."""

    def __missing__(self, tag: str) -> str:
        self[tag] = name = tag.rpartition("}")[2]
        return name


def _parsed(archive: zipfile.ZipFile, member: str, parser, found: list) -> Iterator:
    """What a parser's handlers append to found, piece by piece of the member; all that comes before a fault as well."""
    with archive.open(member) as file:
        fault, data = None, b"-"
        while data and fault is None:
            try:
                data = file.read(_PIECE)
                parser.Parse(data, not data)
            except expat.ExpatError as e:
                fault = ElementTree.ParseError(str(e))
            except Exception as e:  # of the archive, or of a cell
                fault = e
            yield from found
            found.clear()
        if fault is not None:
            raise fault


def _strings(archive: zipfile.ZipFile, member: str) -> Iterator[str]:
    """The texts of string items: all runs, without phonetic hints."""
    parser, local, found, texts, hints = expat.ParserCreate(namespace_separator="}"), _Locals(), [], [], 0
    parser.buffer_text = True

    def start(tag: str, attributes: dict) -> None:
        nonlocal hints
        name = local[tag]
        if name == "t" and not hints:
            parser.CharacterDataHandler = texts.append
        elif name == "si":
            texts.clear()
        elif name == "rPh":
            hints += 1

    def end(tag: str) -> None:
        nonlocal hints
        name = local[tag]
        if name == "t":
            parser.CharacterDataHandler = None
        elif name == "si":
            found.append("".join(texts))
        elif name == "rPh":
            hints -= 1

    parser.StartElementHandler, parser.EndElementHandler = start, end
    return _parsed(archive, member, parser, found)


def _cells(archive: zipfile.ZipFile, member: str, strings: list[str]) -> Iterator[tuple[int, dict[int, str]]]:
    """Rows of a sheet and their cells by column."""
    parser, local, found, texts = expat.ParserCreate(namespace_separator="}"), _Locals(), [], []
    parser.buffer_text, numbers = True, _Numbers()
    row, reference, column, hints, cells, kind = 0, None, -1, 0, {}, None

    def start(tag: str, attributes: dict) -> None:
        nonlocal reference, column, hints, cells, kind
        name = local[tag]
        if name == "c":
            texts.clear()
            kind, at = attributes.get("t"), numbers[attributes.get("r", "").rstrip("0123456789")]
            column = column + 1 if at is None else at
        elif name == "v" or name == "t" and not hints:
            parser.CharacterDataHandler = texts.append
        elif name == "row":
            reference, column, cells = attributes.get("r"), -1, {}
        elif name == "rPh":
            hints += 1

    def end(tag: str) -> None:
        nonlocal row, hints
        name = local[tag]
        if name == "c":
            value = "".join(texts)
            cells[column] = strings[int(value)] if kind == "s" and value else value
        elif name == "v" or name == "t":
            parser.CharacterDataHandler = None
        elif name == "row":
            row = int(reference or row + 1)
            found.append((row, cells))
        elif name == "rPh":
            hints -= 1

    parser.StartElementHandler, parser.EndElementHandler = start, end
    return _parsed(archive, member, parser, found)


def _rows(content: bytes) -> Iterator[tuple[str, int, dict[int, str]]]:
    """sheet, row and cells by column, of all sheets of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        strings = list(_strings(archive, "xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
        for member in sorted((n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")), key=lambda n: (len(n), n)):
            sheet = member.rpartition("/")[2].removesuffix(".xml")
            for row, cells in _cells(archive, member, strings):
                yield sheet, row, cells


def _named(path: str, content: bytes | None) -> Iterator[tuple[str, str | None, int | None, dict[str, str | None] | None, str | None]]:
    """Rows with their cells by header; the first row with a text is a sheet's header."""
    sheet, header, names = None, None, []
    try:
        for name, row, cells in _rows(content or b""):
            if name != sheet:
                sheet, header = name, None
            texts = {i: t for i, v in cells.items() if (t := v.strip())}
            if not texts:
                continue
            if header is None:
                header, names = texts, list(texts.values())
                continue
            named: dict[str, str | None] = {}
            for i in sorted(texts):
                if i in header:
                    named.setdefault(header[i], texts[i])
            for h in names:
                named.setdefault(h, None)
            yield path, sheet, row, named, None
    except Exception as e:  # whatever a damaged file raises
        yield path, sheet, None, None, f"damaged: {type(e).__name__}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    paths, of, numbers, cells, errors = zip(*rows) if rows else ((),) * 5
    # a null where a map starts makes that map null
    starts, at = [], 0
    for c in cells:
        starts.append(None if c is None else at)
        at += len(c or ())
    maps = pa.MapArray.from_arrays(pa.array([*starts, at], pa.int32()), pa.array([k for c in cells for k in c or ()], pa.string()), pa.array([v for c in cells for v in (c or {}).values()], pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(of, pa.string()), pa.array(numbers, pa.int32()), maps, pa.array(errors, pa.string())], schema=_ARROW)


def sheet_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, sheet, row (from 1), cells (header to trimmed text, null where blank) and error of workbooks in a binary column.

    All sheets are read, an element at a time; only the workbook's shared strings are held beside its bytes. Numbers
    stay as written in the file. Of columns with one header the first that is not blank counts; blank rows and cells
    without a header are left out. A file that is no workbook, or is cut off, gives one more row with an error, after the
    rows that could be read; so does a null. Other columns are ignored; no file, no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for p, c in zip(b.column(0), b.column(1)):
                for r in _named(p.as_py(), c.as_py()):
                    held.append(r)
                    if len(held) == _BATCH:
                        yield _batch(held)
                        held = []
        yield _batch(held)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(read, ROWS)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """sheet_rows of all .xlsx files below a folder."""
    return sheet_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path))


# How a price list names its columns.
NAMED = {"ean": r"(?iu)\bean\b|штрихкод|barcode", "price": r"(?iu)\bprice\b|цена", "shelf": r"(?iu)\bshelf\b|полка"}


def price_list(rows: DataFrame) -> DataFrame:
    """path, sheet, row, ean, price, shelf and error of rows of sheets; every row is returned.

    error is null for a row that holds. Else: what sheet_rows says; no_columns where the header names no code or no
    price; no_ean; bad_price where the price is no number above zero; repeated where a code with a price stands more
    than once in the file, as nothing tells which of its prices counts. Codes kept as numbers are written out in full.
    """
    # looked up with a lambda, once a row: the names of a sheet's columns are data
    key = lambda c: F.get(F.filter(F.map_keys("cells"), lambda k: F.regexp_like(k, F.lit(NAMED[c]))), F.lit(0))
    text = lambda c: F.try_element_at("cells", F.col(f"_{c}"))
    rows = rows.select("path", "sheet", "row", "error", "cells", *[key(c).alias(f"_{c}") for c in NAMED])
    whole = F.col("code").try_cast("decimal(38,6)").cast("decimal(38,0)").cast("string")
    ean = F.when(F.regexp_like("code", F.lit(r"^\d+(\.0+|(\.\d+)?[eE]\+?\d+)$")), whole).otherwise(F.col("code"))
    price: Column = F.regexp_replace(F.regexp_replace("amount", r"[\s ]", ""), ",", ".").try_cast("double")
    read = rows.select("path", "sheet", "row", "error", F.col("_ean").isNotNull().alias("a"), F.col("_price").isNotNull().alias("b"), text("ean").alias("code"), text("price").alias("amount"), text("shelf").alias("shelf"))
    read = read.withColumns({"ean": ean, "price": price})
    fault = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~(F.col("a") & F.col("b")), "no_columns")
        .when(F.col("ean").isNull(), "no_ean")
        .when(F.coalesce(~(F.col("price") > 0) | F.isnan("price") | (F.col("price") == float("inf")), F.lit(True)), "bad_price")
    )
    read = read.select("path", "sheet", "row", "ean", "price", "shelf", fault.alias("error"))
    holds = F.count(F.when(F.col("error").isNull(), 1)).over(Window.partitionBy("path", "ean"))
    return read.withColumn("error", F.when(F.col("error").isNull() & (holds > 1), "repeated").otherwise(F.col("error")))


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    '<Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
    '<Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/sharedStrings" Target="sharedStrings.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="1" sheetId="1" r:id="r1"/></sheets></workbook>',
}
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(rows: list[list]) -> bytes:
    """A workbook of one sheet; texts are shared strings, numbers are numbers, None is no cell."""
    strings: dict[str, int] = {}
    letters = lambda i: (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)
    names = [letters(i) for i in range(max(map(len, rows), default=0))]

    def cell(name: str, n: int, v) -> str:
        if v is None:
            return ""
        if isinstance(v, str):
            return f'<c r="{name}{n}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>'
        return f'<c r="{name}{n}"><v>{v!r}</v></c>'

    lines = [f'<row r="{n}">{"".join([cell(name, n, v) for name, v in zip(names, r)])}</row>' for n, r in enumerate(rows, 1)]
    shared = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
        for name, text in _PARTS.items():
            archive.writestr(name, text)
        archive.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
        archive.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{shared}</sst>')
    return out.getvalue()


def to_workbooks(rows: DataFrame, path: str, header: dict[str, str]) -> DataFrame:
    """path and content: a workbook of each path's rows, its columns those of header, by the names given there.

    A workbook's rows pass through one task: a path should name no more than a sheet's million rows. Rows are in the
    order of their values.
    """
    columns = list(header)

    def write(table: pa.Table) -> pa.Table:
        where = table.column("path")[0].as_py()
        data = table.sort_by([(c, "ascending") for c in columns]).select(columns).to_pydict()
        content = workbook([list(header.values()), *map(list, zip(*data.values()))])
        return pa.table({"path": pa.array([where], pa.string()), "content": pa.array([content], pa.binary())})

    return rows.select(F.col(path).alias("path"), *columns).groupBy("path").applyInArrow(write, "path string, content binary")
