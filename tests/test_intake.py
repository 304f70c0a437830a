"""Incoming files, manifests, recorded answers, workbooks and pages with cursors."""

from __future__ import annotations

import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from tabulon.operators import trust
from tabulon.sources import files, intake

PNG = b"\x89PNG\r\n\x1a\n" + b"x" * 20


def test_intake_keeps_what_is_new(spark, tmp_path):
    data = {"a.txt": b"Total: 5\n", "b.txt": b"Total: 5\n", "c.csv": b"a;b\n1;2\n", "d.bin": b"\0\1\2\3", "e.txt": b"", "f.txt": b"y" * 101, "g.txt": PNG, "h.txt": b"known"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    stored = spark.createDataFrame([("w", hashlib.sha256(b"known").hexdigest()), ("other", hashlib.sha256(data["c.csv"]).hexdigest())], "workspace_id string, content_hash string")
    got = {r.filename: r for r in intake.intake(spark, str(tmp_path), "w", stored, most_bytes=100).collect()}
    assert {n: r.status for n, r in got.items()} == {"a.txt": "new", "b.txt": "duplicate", "c.csv": "new", "d.bin": "refused", "f.txt": "refused", "g.txt": "new", "h.txt": "duplicate"}
    assert [got[n].reason for n in ("d.bin", "f.txt")] == ["unknown format", "larger than 100 bytes"]
    assert got["g.txt"].mismatch and got["g.txt"].source_format == "image" and bytes(got["c.csv"].content) == data["c.csv"]
    assert all((r.content is not None) == (r.status == "new") for r in got.values())
    assert intake.intake(spark, str(tmp_path), "w", most_bytes=100).where("status = 'new'").count() == 4


def test_manifest_names_the_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Total: 5")
    (tmp_path / "not listed.txt").write_text("Total: 6")
    run = lambda: {r.filename: r.status for r in intake.from_manifest(spark, str(tmp_path), "w").collect()}
    for text in ('{"name": "x", "documents": [{"file": "a.txt", "kind": "invoice"}, "b.txt", {"kind": "no name"}]}', '["a.txt", "b.txt", {"file": null}]'):
        (tmp_path / "manifest.json").write_text(text)
        assert run() == {"a.txt": "new", "b.txt": "missing", "(unnamed)": "missing"}
    (tmp_path / "manifest.json").write_text("{no json")
    assert run() == {"manifest.json": "refused"}


def test_recorded_answers(spark, tmp_path):
    digest = "0123456789abcdef" * 4
    for name, text in {f"{digest[:16]}-extract.json": '{"fields": []}', f"{digest[:16]}-extract-v3.json": '{"v": 3}', f"{digest[:16]}-plan.json": "{broken"}.items():
        (tmp_path / name).write_text(text)
    asked = spark.createDataFrame([(1, digest, "extract", None), (2, digest, "extract", 3), (3, digest, "extract", 4), (4, digest, "plan", None), (5, None, "plan", None)], "n int, content_hash string, kind string, schema_version int")
    got = {r.n: (r.response, r.error is not None) for r in intake.replay(asked, str(tmp_path)).collect()}
    assert got == {1: ('{"fields": []}', False), 2: ('{"v": 3}', False), 3: (None, False), 4: (None, True), 5: (None, False)}


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(sheets, properties=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        listed = "".join(f'<sheet name="{n}" r:id="{i}"/>' for n, i, _, _ in sheets)
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}>{properties}<sheets>{listed}</sheets></workbook>")
        links = "".join(f'<Relationship Id="{i}" Target="{t}"/>' for _, i, t, _ in sheets)
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        codes = "".join(f'<numFmt numFmtId="{k}" formatCode="{c}"/>' for k, c in {164: "yyyy\\-mm\\-dd", 165: "0.0&quot;days&quot;", 166: "[Red]0.00", 167: "[h]:mm", 168: "General"}.items())
        used = "".join(f'<xf numFmtId="{k}"/>' for k in (0, 14, 22, 164, 165, 166, 167, 20))
        z.writestr("xl/styles.xml", f"<styleSheet {MAIN}><numFmts>{codes}</numFmts><cellXfs>{used}</cellXfs></styleSheet>")
        for _, _, target, cells in sheets:
            body = "".join(f'<c s="{s}"{more}><v>{v}</v></c>' for s, v, more in cells)
            z.writestr(target.lstrip("/") if target.startswith("/") else f"xl/{target}", f'<worksheet {MAIN}><sheetData><row r="1">{body}</row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_by_relationship_with_dates():
    cells = [(1, 45292, ""), (2, 45292.75, ""), (3, 59, ""), (3, 61, ""), (4, 45292, ""), (5, 1.5, ""), (7, 0.25, ""), (0, 45292, ""), (0, 1, ' t="b"'), (0, "#N/A", ' t="e"')]
    book = workbook([("First", "rId9", "worksheets/sheet2.xml", cells), ("Second", "rId2", "/xl/worksheets/sheet1.xml", [(0, 7, "")]), ("Chart", "rId3", "chartsheets/sheet1.xml", [(0, 8, "")])])
    assert files.read_xlsx(book) == [("2024-01-01 | 2024-01-01 18:00 | 1900-02-28 | 1900-03-01 | 45292 | 1.5 | 06:00:00 | 45292 | True | #N/A", "First!row 1"), ("7", "Second!row 1")]
    assert files.read_xlsx(workbook([("S", "a", "worksheets/s.xml", [(1, 0.0, ""), (1, 366, "")])], '<workbookPr date1904="1"/>')) == [("00:00:00 | 1905-01-01", "S!row 1")]
    assert files.sniff(book, "a.xlsx") == ("xlsx", False)
    prose = io.BytesIO()
    with zipfile.ZipFile(prose, "w") as z:
        z.writestr("notes/about.txt", "xl/ and word/ are folders")
    assert files.sniff(prose.getvalue(), "a.xlsx") == (None, True)


def test_what_was_not_read_is_said(spark, tmp_path):
    (tmp_path / "long.txt").write_text("line\n" * (files.LINES + 5))
    (tmp_path / "wide.csv").write_text("\n".join([",".join("x" * (files.COLUMNS + 1))] * (files.ROWS + 1)))
    (tmp_path / "exact.txt").write_text("line\n" * files.LINES)
    (tmp_path / "wide32.txt").write_bytes("Größe: 5".encode("utf-32"))
    rows = files.parse(files.files(spark, str(tmp_path)))
    said = {r.filename: r.error for r in rows.where("error is not null").collect()}
    assert said == {"long.txt": f"only the first {files.LINES} lines were read", "wide.csv": f"only the first {files.ROWS} rows and {files.COLUMNS} columns of Sheet1 were read"}
    assert {r.filename: r["count"] for r in rows.where("error is null").groupBy("filename").count().collect()} == {"long.txt": files.LINES, "wide.csv": files.ROWS, "exact.txt": files.LINES, "wide32.txt": 1}


def test_pages_by_cursor(spark):
    rows = spark.range(23).select((F.col("id") % 4).cast("timestamp").alias("at"), F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("id"))
    want = [tuple(r) for r in rows.orderBy("at", "id").collect()]
    seen, cursor, pages = [], None, 0
    while True:
        got = sorted(trust.page(rows, "at", "id", cursor, 6).collect())
        seen += [(r.at, r.id) for r in got]
        pages += 1
        assert all(r.next_cursor is None for r in got[:-1])
        cursor = got[-1].next_cursor
        if cursor is None:
            break
    assert seen == want and pages == 4
    first = sorted(trust.page(rows, "at", "id", None, 6).collect())
    for odd in ("", "%%%", "bm8gYmFy", "eHw=", "eHx5"):
        assert sorted(trust.page(rows, "at", "id", odd, 6).collect()) == first
    assert trust.page(rows, "at", "id", None, 23).where("next_cursor is not null").count() == 0
