"""PDF files written here, read back: what was drawn is found where it was drawn."""

from __future__ import annotations

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon import queries
from tabulon.operators import layout, retrieve
from tabulon.sources import files, pdf


def stream(info: str, data: bytes, packed: bool = True) -> bytes:
    data = zlib.compress(data) if packed else data
    return f"<< {info} /Length {len(data)} {'/Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream"


def document(objects: dict[int, bytes], trailer: str = "/Root 1 0 R", packed: tuple[int, ...] = ()) -> bytes:
    """A file of objects; those in `packed` go into an object stream."""
    out = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"
    for k, o in objects.items():
        if k not in packed:
            out += f"{k} 0 obj\n".encode() + o + b"\nendobj\n"
    if packed:
        heads, body = [], b""
        for k in packed:
            heads.append(f"{k} {len(body)}")
            body += objects[k] + b" "
        head = " ".join(heads).encode() + b" "
        out += b"900 0 obj\n" + stream(f"/Type /ObjStm /N {len(packed)} /First {len(head)}", head + body) + b"\nendobj\n"
    return out + f"xref\n0 1\n0000000000 65535 f \ntrailer << {trailer} >>\nstartxref\n9\n%%EOF\n".encode()


HELVETICA = b"<< /Type /Font /Subtype /Type1 /BaseFont /Any /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [" + b" ".join(b"%d" % (300 + 7 * (k % 40)) for k in range(32, 256)) + b"] /FontDescriptor << /Descent -250 >> >>"
WIDE = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [<< /DW 700 /W [1 [400 500] 10 20 250] /FontDescriptor 8 0 R >>] /ToUnicode 9 0 R >>"
CMAP = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar 2 beginbfrange <000a> <000c> <0058> <0014> <0015> [<00e9> <d83dde00>] endbfrange"


def width(text: str) -> float:
    return sum(300 + 7 * (ord(c) % 40) for c in text) / 1000


def book(contents: list[bytes], **kw) -> bytes:
    kids = " ".join(f"{100 + 2 * k} 0 R" for k in range(len(contents)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /MediaBox [0 0 600 800] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /X1 7 0 R >> >> >>".encode(), 5: HELVETICA, 6: WIDE}
    objects |= {7: stream("/Subtype /Form /Matrix [1 0 0 1 50 0]", b"BT /F1 10 Tf 0 300 Td (inside) Tj ET"), 8: b"<< /Descent -200 >>", 9: stream("", CMAP)}
    for k, c in enumerate(contents):
        objects[100 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {101 + 2 * k} 0 R >>".encode()
        objects[101 + 2 * k] = stream("", c)
    return document(objects, **kw)


def test_words_are_where_they_were_drawn():
    rnd = random.Random(1)
    content, drawn = b"", []
    for k in range(20):
        words = ["".join(rnd.choice("abcdeXYZ019") for _ in range(rnd.randint(1, 8))) for _ in range(rnd.randint(1, 5))]
        size, x, y = rnd.choice([8, 10, 12]), 40.0, 760.0 - 30 * k
        content += b"BT /F1 %d Tf 1 0 0 1 %f %f Tm (%s) Tj ET\n" % (size, x, y, " ".join(words).encode())
        for w in words:
            drawn.append((w, x, 800 - (y + 0.75 * size), x + width(w) * size, 800 - (y - 0.25 * size)))
            x += width(w + " ") * size
    (w, h, words, lines), = pdf.read_pages(book([content], packed=(1, 2, 5)))
    assert (w, h) == (600, 800) and len(lines) == 20
    assert [x["text"] for x in words] == [x[0] for x in drawn]
    for got, want in zip(words, drawn, strict=True):
        assert [got[c] for c in ("x0", "top", "x1", "bottom")] == pytest.approx(want[1:], abs=1e-3)
    assert [x["text"] for x in lines] == [" ".join(x[0] for x in drawn if abs(x[4] - line["bottom"]) < 1) for line in lines]


def test_text_operators():
    content = rb"""q 2 0 0 2 10 20 cm BT /F1 5 Tf 14 TL 10 100 Td (A\)B\050\101) Tj T* [(spl) -10 (it) -4000 (far)] TJ (next) ' 1 2 (q) " ET Q
    BT /F2 10 Tf 100 500 Td <00010002000a000b00140015> Tj ET /X1 Do BI /W 1 /H 1 ID (x) Tj EI BT /F1 10 Tf 50 Tz 300 700 Td (half) Tj ET % (comment) Tj
    BT /F1 10 Tf 3 Ts 10 Tc 10 40 Td (ab) Tj ET"""
    (_, _, words, lines), = pdf.read_pages(book([content]))
    by = {w["text"]: w for w in words}
    assert {"A)B(A", "split", "far", "next", "q", "AfiXYé😀", "inside", "half"} <= by.keys() and not any("comment" in t or "x" in t.split() for t in by)
    assert by["A)B(A"]["x0"] == pytest.approx(30) and by["A)B(A"]["top"] == pytest.approx(800 - (220 + 7.5))
    assert by["split"]["top"] == pytest.approx(by["A)B(A"]["top"] + 28) and by["next"]["top"] == pytest.approx(by["split"]["top"] + 28)
    assert by["split"]["x1"] == pytest.approx(30 + (width("split") + 0.01) * 10) and by["far"]["x0"] == pytest.approx(by["split"]["x1"] + 40)
    assert by["AfiXYé😀"]["x1"] == pytest.approx(100 + (0.4 + 0.5 + 3 * 0.25 + 0.7) * 10)
    assert by["inside"]["x0"] == pytest.approx(50) and by["half"]["x1"] == pytest.approx(300 + width("half") * 5)
    assert [w["text"] for w in words[-2:]] == ["a", "b"]  # ten points apart


def test_files_that_cannot_be_read():
    for data in (b"%PDF-1.4 nothing", document({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [2 0 R] >>"}), book([b""], trailer="/Root 1 0 R /Encrypt 3 0 R"), book([b"BT /F1 10 Tf (open Tj"])):
        with pytest.raises(pdf.PdfError):
            pdf.read_pages(data)


GOOD = book([b"BT /F1 10 Tf 10 10 Td (some words here) Tj ET"] * 2, packed=(1, 2))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, len(GOOD) - 1), st.integers(0, 255)), min_size=1, max_size=8), st.integers(0, len(GOOD)))
def test_damage_is_an_error_or_a_page(edits, end):
    data = bytearray(GOOD)
    for at, b in edits:
        data[at] = b
    for d in (bytes(data), bytes(data[:end])):
        try:
            pdf.read_pages(d)
        except pdf.PdfError:
            pass


def test_pages_as_tables(spark, tmp_path):
    page = lambda n: b"".join(b"BT /F1 10 Tf 30 %d Td (line %d of this page) Tj ET\n" % (700 - 20 * k, k) for k in range(n))
    (tmp_path / "a.pdf").write_bytes(book([page(12), b"", page(3)]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "c.txt").write_bytes(b"plain text\n")
    found = files.files(spark, str(tmp_path))
    pages = files.pdf_pages(found)
    rows = sorted(pages.collect(), key=lambda r: (r.error or "", r.page_index or 0))
    assert [(r.page_index, len(r.lines), r.needs_ocr) for r in rows if not r.error] == [(0, 12, False), (1, 0, True), (2, 3, False)]
    assert [r.error for r in rows if r.error] == ["the PDF has no pages"]
    lines = files.parse(found).collect()
    assert [(r.text, r.locator) for r in lines if r.filename == "a.pdf"][12:13] == [("line 0 of this page", "page 3")]
    assert {r.filename: r.error for r in lines if r.error} == {"b.pdf": "the PDF has no pages"}
    chunks = retrieve.chunk_pages(pages.where("error is null")).collect()
    assert [(c.ordinal, c.page_index, c.word_start, c.word_end) for c in chunks] == [(0, 0, 0, 60), (1, 2, 0, 15)]
    spans = layout.line_word_spans(pages.where("error is null")).collect()
    assert sorted((r.page_index, r.line_no, r.word_start, r.word_end) for r in spans)[:2] == [(0, 0, 0, 5), (0, 1, 5, 10)]


def test_files_of_one_maker_are_read_by_many_tasks(spark):
    """The orders lie in one part of a file, but their PDF files aren't read by one task."""
    found = queries.pdf_lines(spark, "/root/testdata/sf0.001")
    tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 3000


def test_shared_objects_are_parsed_once_and_end_where_they_end():
    pdf._kept.cache_clear()
    for k in range(20):
        (_, _, words, _), = pdf.read_pages(book([b"BT /F1 10 Tf 10 10 Td (file %d) Tj ET" % k]))
        assert [w["text"] for w in words] == ["file", str(k)]
    kept = pdf._kept.cache_info()
    assert kept.hits > 10 * kept.misses
    odd = document({1: b"<< /Type /Catalog /Pages 2 0 R /Title (an endobj, a stream) >>", 2: b"<< /Kids [3 0 R] % endobj >>\n/X (a stream) /Y <65 endobj> >>", 3: b"<< /Type /Page /Contents 4 0 R /streams 1 /Resources << /Font << /F1 5 0 R >> >> >>", 4: stream("", b"BT /F1 10 Tf (read) Tj ET", packed=False), 5: HELVETICA})
    for _ in range(2):
        assert [[w["text"] for w in page[2]] for page in pdf.read_pages(odd)] == [["read"]]
