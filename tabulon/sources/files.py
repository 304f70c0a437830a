"""Files as lines: what a file is, and readers for text, CSV, XLSX, DOCX and PDF. Each runs on `binaryFile` rows."""

from __future__ import annotations

import csv
import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pdf

HEAD, ROWS, COLUMNS, LINES = 128 * 1024, 2000, 40, 20_000
#: Words of PDF pages that a task gathers before it hands them on.
WORDS_HELD = 100_000
# First bytes of the formats.
MAGIC = {b"%PDF-": "pdf", b"\x89PNG\r\n\x1a\n": "image", b"\xff\xd8\xff": "image", b"GIF8": "image", b"II*\x00": "image", b"MM\x00*": "image"}
EXTENSIONS = {"pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "tif": "image", "tiff": "image", "docx": "docx", "xlsx": "xlsx", "csv": "csv", "tsv": "csv", "txt": "text", "md": "text"}


class SourceError(ValueError):
    """A file that can't be read, with what to tell its owner."""


def decode(data: bytes) -> str | None:
    """Text by its mark, else UTF-8, else cp1252; None for what looks binary."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, errors="replace")
    if b"\0" in data[:4096]:
        return None
    for name in ("utf-8", "cp1252"):
        try:
            text = data.decode(name)
        except UnicodeDecodeError as e:
            if name == "utf-8" and e.start >= len(data) - 3:  # a character cut at the end of the head
                text = data[: e.start].decode()
            else:
                continue
        odd = sum(c < " " and c not in "\t\n\r\f" for c in text[:2000])
        return None if odd > 0.02 * len(text[:2000]) else text
    return None


def is_table(text: str) -> bool:
    lines = [x for x in text.splitlines() if x.strip()][:20]
    try:
        dialect = csv.Sniffer().sniff("\n".join(lines[:10]), delimiters=",;\t|")
    except csv.Error:
        return False
    widths = {len(r) for r in csv.reader(lines, dialect)}
    return len(lines) >= 2 and len(widths) == 1 and widths.pop() >= 2


def _entries(head: bytes) -> list[bytes]:
    """Names of the zip entries that begin in the first bytes of a file."""
    found = re.finditer(rb"PK\x03\x04.{22}(..)..", head, re.DOTALL)
    return [head[m.end() : m.end() + int.from_bytes(m[1], "little")] for m in found]


def sniff(head: bytes, name: str) -> tuple[str | None, bool]:
    """(format, whether the name says otherwise); the content decides."""
    said = EXTENSIONS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
    kind = next((k for m, k in MAGIC.items() if head.startswith(m)), None)
    if kind is None and head.startswith(b"PK\x03\x04"):
        names = _entries(head)
        kind = next((k for folder, k in ((b"word/", "docx"), (b"xl/", "xlsx")) if any(n.startswith(folder) for n in names)), None)
        return kind, kind != said
    if kind is None and (text := decode(head)) is not None:
        kind = "csv" if is_table(text) else "text"
        return kind, said not in (None, "csv", "text")
    return kind, said is not None and said != kind


def show_cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, dt.datetime):
        return value.date().isoformat() if value.time() == dt.time() else value.isoformat(sep=" ", timespec="minutes")
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return re.sub(r"\s+", " ", str(value)).strip()


def _table_lines(rows: list[list[str]], sheet: str, more: bool = False) -> list[tuple[str | None, str]]:
    """Lines of a sheet's first rows and columns. more: the sheet goes on; a last line without text says what wasn't read."""
    more = more or any(any(r) for r in rows[ROWS:])
    wider = any(any(r[COLUMNS:]) for r in rows[:ROWS])
    rows = [r[:COLUMNS] for r in rows[:ROWS]]
    while rows and not any(rows[-1]):
        rows.pop()
    wide = max((i + 1 for r in rows for i, c in enumerate(r) if c), default=0)
    lines: list[tuple[str | None, str]] = [(" | ".join((r + [""] * wide)[:wide]), f"{sheet}!row {k}") for k, r in enumerate(rows, 1) if any(r)]
    cut = [f"{ROWS} rows"] * more + [f"{COLUMNS} columns"] * wider
    return lines + [(None, f"only the first {' and '.join(cut)} of {sheet} were read")] * bool(cut)


def read_text(data: bytes) -> list[tuple[str | None, str]]:
    text = decode(data)
    if text is None:
        raise SourceError("not a text file")
    lines = re.split("\r?\n", text)
    cut = any(line.strip() for line in lines[LINES:])
    return [(line, f"line {k}") for k, line in enumerate(lines[:LINES], 1) if line.strip()] + [(None, f"only the first {LINES} lines were read")] * cut


def read_csv(data: bytes) -> list[tuple[str | None, str]]:
    text = decode(data)
    if text is None:
        raise SourceError("not a text file")
    try:
        dialect: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(text[:8192], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    return _table_lines([[c.strip() for c in r] for r in csv.reader(io.StringIO(text), dialect)], "Sheet1")


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# The number formats of the standard that are dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _shows_date(code: str) -> bool:
    """Whether a number format has a part of a date or time outside quotes, escapes and brackets (but for elapsed time, as in [h])."""
    return re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?![hms]+\])[^\]]*\]', "", code.lower().partition(";")[0])) is not None


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    styles = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId", -1)): _shows_date(f.get("formatCode", "")) for f in styles.iter(f"{_MAIN}numFmt")}
    used = [int(x.get("numFmtId", 0)) for x in styles.findall(f"{_MAIN}cellXfs/{_MAIN}xf")]
    return {i for i, n in enumerate(used) if own.get(n, n in DATE_FORMATS)}


def _sheets(z: zipfile.ZipFile, book: ElementTree.Element) -> list[tuple[str, str]]:
    """(name, file) of the sheets in the order of the workbook, by its relationships; where it has none, by the numbers in the files' names."""
    if "xl/_rels/workbook.xml.rels" not in z.namelist():
        numbered = sorted((int(m[1]), m[0]) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        return [(s.get("name", ""), file) for s, (_, file) in zip(book.iter(f"{_MAIN}sheet"), numbered, strict=False)]
    links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    targets = [(s.get("name", ""), links.get(s.get(_LINK), "")) for s in book.iter(f"{_MAIN}sheet")]
    files_of = [(name, t[1:] if t.startswith("/") else posixpath.normpath(f"xl/{t}")) for name, t in targets]
    return [(name, file) for name, file in files_of if file in z.namelist() and "/chartsheets/" not in file]


def _cell(c: ElementTree.Element, shared: list[str], dates: set[int], start: dt.datetime) -> str:
    kind, raw = c.get("t", "n"), c.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        return show_cell("".join(t.text or "" for t in c.iter(f"{_MAIN}t")))
    if not raw:
        return ""
    if kind == "s":
        return show_cell(shared[int(raw)])
    if kind == "b":
        return str(raw == "1")
    if kind != "n":
        return show_cell(raw)
    number = float(raw)
    if int(c.get("s", 0)) not in dates:
        return show_cell(number)
    try:
        moment = start + dt.timedelta(days=number + (start.year == 1899 and number < 60))  # its calendar has a day too many, 29 February 1900
    except OverflowError:
        return show_cell(number)
    moment = (moment + dt.timedelta(microseconds=500_000)).replace(microsecond=0)
    return show_cell(moment) if number >= 1 else moment.time().isoformat()


def read_xlsx(data: bytes) -> list[tuple[str | None, str]]:
    """Stored values of every sheet; numbers in a date format are dates."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets, dates = _sheets(z, book), _date_styles(z)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise SourceError("not a readable workbook") from e
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    from_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_MAIN}workbookPr"))
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)
    out = []
    for name, file in sheets:
        rows: list[list[str]] = []
        more = False
        for row in ElementTree.fromstring(z.read(file)).iter(f"{_MAIN}row"):
            number = int(row.get("r", len(rows) + 1))
            if number > ROWS:
                more = more or any(_cell(c, shared, dates, start) for c in row.iter(f"{_MAIN}c"))
                continue
            rows += [[] for _ in range(number - len(rows))]
            for c in row.iter(f"{_MAIN}c"):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else len(rows[-1])
                rows[-1] += [""] * (at + 1 - len(rows[-1]))
                rows[-1][at] = _cell(c, shared, dates, start)
        out += _table_lines(rows, name, more)
    return out


def read_docx(data: bytes) -> list[tuple[str, str]]:
    """Paragraphs and table rows in the order of the body."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_WORD}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise SourceError("not a readable document") from e
    text = lambda e: re.sub(r"\s+", " ", "".join(t.text or "" for t in e.iter(f"{_WORD}t"))).strip()
    out, paragraphs, tables = [], 0, 0
    for e in body if body is not None else ():
        if e.tag == f"{_WORD}p":
            paragraphs += 1
            if text(e):
                out.append((text(e), f"paragraph {paragraphs}"))
        elif e.tag == f"{_WORD}tbl":
            tables += 1
            for k, row in enumerate(e.iter(f"{_WORD}tr"), 1):
                cells = [text(c) for c in row.iter(f"{_WORD}tc")]
                if any(cells):
                    out.append((" | ".join(cells), f"table {tables} row {k}"))
    return out


def read_pdf(data: bytes) -> list[tuple[str, str]]:
    """Lines of all pages; a PDF without any text is reported, as its pages would have to be recognised."""
    try:
        pages = pdf.read_pages(data)
    except pdf.PdfError as e:
        raise SourceError(str(e)) from e
    out = [(line["text"], f"page {k}") for k, (_, _, _, lines) in enumerate(pages, 1) for line in lines]
    if not out:
        raise SourceError("no text was found in this PDF; it may be a scan")
    return out


def _absent(what: str) -> Callable[[bytes], list[tuple[str, str]]]:
    def read(data: bytes) -> list[tuple[str, str]]:
        raise SourceError(f"{what} needs a library that isn't installed")

    return read


#: Readers by format; others can be put in.
READERS: dict[str, Callable[[bytes], list[tuple[str | None, str]]]] = {"text": read_text, "csv": read_csv, "xlsx": read_xlsx, "docx": read_docx, "pdf": read_pdf, "image": _absent("text in images")}


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their SHA-256; equal content counts once (the first name)."""
    rows = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", "length", F.sha2("content", 256).alias("content_hash"))
    names = rows.groupBy("content_hash").agg(F.min("filename").alias("filename"))
    return rows.join(names, ["content_hash", "filename"], "left_semi").dropDuplicates(["content_hash"])


def parse(found: DataFrame) -> DataFrame:
    """(filename, content_hash, source_format, mismatch, line_no, text, locator, error); a file that fails is one row with its error.

    A file of which a part wasn't read, as it has more rows, columns or lines than are taken, ends with a row that says so in `error`.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                kind, mismatch = sniff(bytes(r.content[:HEAD]), r.filename)
                try:
                    if kind is None:
                        raise SourceError("unknown format")
                    for k, (text, where) in enumerate(READERS[kind](bytes(r.content)), 1):
                        rows.append((r.filename, r.content_hash, kind, mismatch, *((None, None, None, where) if text is None else (k, text, where, None))))
                except SourceError as e:
                    rows.append((r.filename, r.content_hash, kind, mismatch, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["filename", "content_hash", "source_format", "mismatch", "line_no", "text", "locator", "error"]).astype({"line_no": "Int32"})

    return found.select("filename", "content_hash", "content").mapInPandas(run, "filename string, content_hash string, source_format string, mismatch boolean, line_no int, text string, locator string, error string")


_BOX = ("text", "x0", "top", "x1", "bottom")
_BOXES = "array<struct<text:string,x0:double,top:double,x1:double,bottom:double>>"


def _boxes(pages: list[list[dict] | None]) -> pa.Array:
    columns = [[b[c] for boxes in pages for b in boxes or ()] for c in _BOX]
    values = pa.StructArray.from_arrays([pa.array(c, pa.float64() if k else pa.string()) for k, c in enumerate(columns)], _BOX)
    ends = pa.array(np.cumsum([0, *[len(boxes or ()) for boxes in pages]]), pa.int32())
    return pa.ListArray.from_arrays(ends, values, mask=pa.array([boxes is None for boxes in pages], pa.bool_()))


def pdf_pages(found: DataFrame) -> DataFrame:
    """(document_id, page_index, width, height, words, lines, needs_ocr, error): a row per page of the PDF files of `files`, as operators.layout takes them.

    document_id is the content's hash. A page of fewer than five words needs recognition: words recognised elsewhere can
    take its place through operators.layout.ocr_lines. A file that can't be read is one row with its error. One pass, no shuffle:
    files are read by the tasks that they come to, so many small ones from one task of a table have to be dealt out before.
    """

    kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64(), None, None, pa.bool_(), pa.string()]
    columns = ["document_id", "page_index", "width", "height", "words", "lines", "needs_ocr", "error"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) if k else _boxes(c) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for name, key, content in zip(*batch.columns, strict=True):
                data = content.as_py()
                if sniff(data[:HEAD], name.as_py())[0] != "pdf":
                    continue
                try:
                    pages = pdf.read_pages(data)
                    rows += [(key.as_py(), k, w, h, words, lines, len(words) < pdf.FEW_WORDS, None) for k, (w, h, words, lines) in enumerate(pages)]
                    held += sum(len(p[2]) for p in pages)
                except pdf.PdfError as e:
                    rows.append((key.as_py(), None, None, None, None, None, None, str(e)))
                if held > WORDS_HELD:  # so that what is held doesn't grow with the number of files
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return found.select("filename", "content_hash", "content").mapInArrow(run, f"document_id string, page_index int, width double, height double, words {_BOXES}, lines {_BOXES}, needs_ocr boolean, error string")


def byte_range(content: F.Column, first: int, last: int) -> F.Column:
    """Bytes first..last, both included."""
    return F.substring(content, first + 1, last - first + 1)
