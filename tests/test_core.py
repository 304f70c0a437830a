from __future__ import annotations

import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon import model, spec
from tabulon.functions import values as V
from tabulon.functions.exprs import bucket_of, label_of, matches, plain_number
from tabulon.functions.labels import fold_for_similarity, fold_label, fold_text, fold_token, indel_ratio, slug
from tabulon.operators import extract, ground, resolve, retrieve
from tabulon.sources import files
from tabulon.streaming.events import Rewriter


def coerced(spark, kind, raws, **options):
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    opts = {k: F.lit(v) for k, v in options.items()}
    return [(r.c.v, r.c.how) for r in df.select(V.coerce(F.col("raw"), F.lit(kind), **opts).alias("c")).collect()]


def test_numbers(spark):
    got = [(v.n, how) for v, how in coerced(spark, "number", ["42", "1,234.50", "(12.5)", "7-", ".5", "abc", "  ", "-3"])]
    assert got == [(42.0, "exact"), (1234.5, "normalised"), (-12.5, "normalised"), (-7.0, "normalised"), (0.5, "exact"), (None, "failed"), (None, "exact"), (-3.0, "exact")]


def test_currencies(spark):
    got = [(v.n, v.ccy, how) for v, how in coerced(spark, "currency", ["$1,200.00", "EUR 5", "US$ 3", "9.99", "€1.500", "none"], currency_default="USD")]
    assert got == [(1200.0, "USD", "normalised"), (5.0, "EUR", "normalised"), (3.0, "USD", "normalised"), (9.99, "USD", "inferred"), (1.5, "EUR", "normalised"), (None, None, "failed")]


def test_dates(spark):
    raws = ["2024-03-05", "05/03/2024", "25/12/2023", "12/25/2023", "5 March 2024", "Mar 5, 24", "2024-02-30", "March 2024", "2024/3/5", "01.02.69"]
    got = [(v.s, how) for v, how in coerced(spark, "date", raws)]
    assert got == [("2024-03-05", "exact"), ("2024-03-05", "inferred"), ("2023-12-25", "normalised"), ("2023-12-25", "normalised"), ("2024-03-05", "normalised"), ("2024-03-05", "normalised"), (None, "failed"), (None, "failed"), ("2024-03-05", "normalised"), ("2069-02-01", "inferred")]


def test_other_types(spark):
    assert [v.b for v, _ in coerced(spark, "boolean", ["Paid", "no", "maybe"])] == [True, False, None]
    assert coerced(spark, "string_list", ["a, b;c\n d"])[0][0].l == ["a", "b", "c", "d"]
    assert [v.s for v, _ in coerced(spark, "enum", ["OPEN", "x"], enum_values=["Open", "Closed"])] == ["Open", None]
    assert [r.t for r in spark.createDataFrame([("$5",), ("2024-01-01",), ("Net 30",), ("12",), ("yes",)], "x string").select(V.infer_type(F.col("x")).alias("t")).collect()] == ["currency", "date", "string", "number", "boolean"]


def test_filters(spark):
    rows = [("number", 480.0, None), ("number", None, None), ("string", None, "Straight Line")]
    df = spark.createDataFrame(rows, "t string, n double, s string").select("t", F.struct(F.col("s").alias("s"), F.col("n").alias("n"), F.lit(None).cast("string").alias("ccy"), F.lit(None).cast("date").alias("d"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("array<string>").alias("l")).alias("v"))
    ask = lambda op, value=None: [r.m for r in df.select(matches(F.col("v"), F.col("t"), op, value).alias("m")).collect()]
    assert ask("gt", "400") == [True, False, True]
    assert ask("ne", 481) == [True, False, True]
    assert ask("missing") == [False, True, False]
    assert ask("contains", "480.0")[0]
    assert ask("eq", "straight line") == [False, False, True]
    assert ask("lt", "not a number") == [True, False, False]
    assert ask("eq", 480 + 1e-9) == ask("eq", 480) == [True, False, False]
    assert [r.x for r in df.select(label_of(F.col("v"), F.col("t")).alias("x")).collect()] == ["480.0", "Not stated", "Straight Line"]
    assert [r.x for r in spark.createDataFrame([(12480000.5,), (0.1,), (3.0,)], "n double").select(plain_number(F.col("n")).alias("x")).collect()] == ["12480000.5", "0.1", "3.0"]
    assert spark.sql("select date'2024-05-06' d").select(bucket_of(F.col("d"), "quarter").alias("b")).first().b == "2024-Q2"


def test_labels(spark):
    row = spark.createDataFrame([("Invoice No.", "2nd Order", "kitten", "sitting")], "a string, b string, c string, d string").select(fold_label(F.col("a")).alias("f"), fold_for_similarity(F.col("a")).alias("s"), slug(F.col("b")).alias("k"), slug(F.lit("Order")).alias("o"), indel_ratio(F.col("c"), F.col("d")).alias("r")).first()
    assert (row.f, row.s, row.k, row.o) == ("invoice_no", "invoice", "f_2nd_order", "order_value")
    assert row.r == pytest.approx(2 * 4 / 13)


def test_spec_and_schema():
    with pytest.raises(spec.SpecError):
        spec.Filter("a", "eq")
    with pytest.raises(spec.SpecError):
        spec.DataQuery(limit=51)
    with pytest.raises(spec.SpecError):
        spec.DataQuery("sum")
    with pytest.raises(ValueError):
        model.FieldSpec("select", "x", "string")
    assert model.FieldSpec("kind", "Kind", "enum").type == "string"
    assert spec.shown_kind("bar", 1) == "metric" and spec.shown_kind("bar", 31) == "table"


def test_unify():
    seen = [("vendor", "Vendor", "string", 3), ("vendor_name", "Vendor", "string", 2), ("total", "Total", "currency", 2), ("total_due", "Total", "date", 1)]
    fields, made = resolve.unify(seen)
    assert [f.key for f in fields] == ["vendor", "total", "total_due"]
    assert made[1] == ("vendor_name", "map") and "vendor_name" in fields[0].aliases


def test_classify(spark):
    incoming = spark.createDataFrame([("supplier", "Supplier", "string", [1.0, 0.0]), ("total_due", "Total Due", "string", None), ("colour", "Colour", "string", [0.0, 1.0])], "key string, label string, type string, vector array<double>")
    schema = spark.createDataFrame([("supplier_name", "Supplier Name", "string", ["supplier"], None, [0.9, 0.1]), ("total_due", "Total Due", "currency", [], "USD", [0.5, 0.0])], "field_key string, field_label string, field_type string, aliases array<string>, currency_default string, field_vector array<double>")
    got = {r.key: (r.verdict, r.reason, r.target) for r in resolve.classify(resolve.score_pairs(incoming, schema), ["key"]).collect()}
    assert got["supplier"] == ("map", None, "supplier_name")
    assert got["total_due"][:2] == ("ask", "type_mismatch")
    assert got["colour"][0] == "add"


def test_grounding_window():
    assert ground.best_window("total due 480", "the invoice total due 480 usd")[0] == 100.0
    score, a, b = ground.best_window("totel due 480", "the invoice total due 480 usd")
    assert score > 85 and "total due" in "the invoice total due 480 usd"[a:b]
    assert ground.best_window("nothing like it", "zzz zzz zzz")[0] == 0.0


def _brute_window(quote, page):
    """The best stretch by trying them all, with a plain table of common subsequences."""
    best = (0.0, 0, 0)
    for place in range(1 - len(quote), len(page)):
        a, b = max(place, 0), min(place + len(quote), len(page))
        row = [0] * (b - a + 1)
        for x in quote:
            last, row = row, [0]
            for i, y in enumerate(page[a:b]):
                row.append(last[i] + 1 if x == y else max(last[i + 1], row[i]))
        ratio = 200 * row[-1] / (len(quote) + b - a)
        if ratio > best[0]:
            best = (ratio, a, b)
    return best


def test_grounding_window_begins_inside_words():
    assert ground.best_window("number 12346", "invoicenumber 12345") == (pytest.approx(91.67, abs=0.01), 6, 18)  # as good as 7 to 19, and first
    rnd, found = random.Random(6), 0
    for _ in range(300):
        page = "".join(rnd.choice("abcde é") for _ in range(rnd.randint(1, 60)))
        at = rnd.randrange(len(page))
        quote = list(page[at : at + 15])
        quote[rnd.randrange(len(quote))] = rnd.choice("abcx")
        want, got = _brute_window("".join(quote), page), ground.best_window("".join(quote), page)
        if "".join(quote) not in page and want[0] >= ground.LEAST:
            found += 1
            assert got == want
    assert found > 50


def test_ground_quotes_query(spark):
    """Against every page and stretch in the query's order."""
    from tabulon import queries as core

    where = "/root/testdata/sf0.001"
    got = core.queries()["ground_quotes"](spark, where)
    rows = got.collect()
    assert len(rows) == 3 * spark.read.parquet(f"{where}/documents.parquet").where("text is not null").count()
    by = {k: [r for r in rows if r.field_key == k] for k in ("opening", "late", "edited")}
    assert all(r.failure is None or not r.match_score for r in by["opening"])
    assert any(r.match_page for r in by["late"]) and any(85 <= r.match_score < 100 for r in by["edited"])


@settings(max_examples=300)
@given(st.lists(st.integers(0, 200), max_size=40))
def test_cuts_equal_taking_line_after_line(counts):
    want, held, new = [], [], False
    for i, n in enumerate(counts):
        if new and sum(counts[j] for j in held) + n > retrieve.LONGEST:
            want.append((held[0], held[-1] + 1))
            held, new = held[-1:], False
        held, new = [*held, i], True
        if sum(counts[j] for j in held) >= retrieve.TARGET:
            want.append((held[0], held[-1] + 1))
            held, new = held[-1:], False
    if new:
        want.append((held[0], held[-1] + 1))
    assert retrieve.cut_lines(counts) == want


def test_passages_merge_runts_and_leave_out_what_is_said():
    line = lambda n, w="w": " ".join([w] * n)
    spans = [(line(100), 0, 100), (" ", None, None), (line(15, "x"), 100, 115), (line(5, "y"), None, None)]
    assert retrieve.passages_of(spans) == [("\n".join([line(100), line(15, "x"), line(15, "x"), line(5, "y")]), 0, 3, 0, 115)]
    same = [(line(120), 0, 120), (line(2), 120, 122)]
    assert retrieve.passages_of(same)[-1][1:] == (0, 2, 0, 122)  # 122 words are no runt, and new
    assert retrieve.passages_of([(line(60), 0, 60), (line(60), 60, 120), ("", None, None)]) == [(line(60) + "\n" + line(60), 0, 2, 0, 120)]
    assert retrieve.passages_of([]) == []


def test_passages_of_documents(spark):
    """Ordinals run through a document; word ranges cover each word, and cite the boxes of their lines."""
    from tabulon.operators import layout, views

    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, "\n".join(" ".join(f"w{rnd.randrange(999)}" for _ in range(rnd.randrange(30))) for _ in range(rnd.randrange(150)))) for i in range(12)] + [(99, None)], "document_id long, text string")
    pages = layout.layout_pages(docs)
    chunks = retrieve.chunk_pages(pages)
    words = {(r.document_id, r.page_index): r.words for r in pages.collect()}
    by = {}
    for r in chunks.collect():
        by.setdefault(r.document_id, []).append(r)
    assert 99 not in by
    for doc, rows in by.items():
        rows.sort(key=lambda r: r.ordinal)
        assert [r.ordinal for r in rows] == list(range(len(rows))) and [r.page_index for r in rows] == sorted(r.page_index for r in rows)
        for page in {r.page_index for r in rows}:
            covered = set()
            for r in rows:
                if r.page_index == page:
                    covered |= set(range(r.word_start, r.word_end))
                    assert set(r.text.split()) == {w.text for w in words[doc, page][r.word_start : r.word_end]}
            assert covered == set(range(len(words[doc, page])))
    cited = layout.cite(chunks.withColumn("chunk_id", F.concat_ws("-", "document_id", "ordinal")), pages).collect()
    assert len(cited) == sum(map(len, by.values()))
    for r in cited:
        doc, k = map(int, r.chunk_id.split("-"))
        c = by[doc][k]
        tops = sorted({w.top for w in words[doc, c.page_index][c.word_start : c.word_end]})
        assert [b.top for b in r.boxes] == tops[:40]
    names = spark.createDataFrame([("w", 3, "c.txt"), ("x", 4, "d.txt")], "workspace_id string, document_id long, filename string")
    marked = chunks.withColumn("workspace_id", F.lit("w"))
    assert [(r.filename, r.text) for r in views.one_passage(marked, names, "w", 3, 0).collect()] == [("c.txt", by[3][0].text)]
    assert views.one_passage(marked, names, "x", 3, 0).count() == 0 and views.one_passage(marked, names, "w", 4, 0).count() == 0


@settings(max_examples=60)
@given(st.integers(0, 10_000))
def test_rewriter_does_not_depend_on_cuts(seed):
    rnd = random.Random(seed)
    known = "0a1b2c3d-0000-1111-2222-333344445555"
    parts = ["Total ", "{{a}}", " USD", " is", f"[^chunk:{known}]", "[^1]", "[", "{", "{{zz}}", "[^chunk:bad]", " USDX", "end"]
    text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))

    def run(cuts):
        w, events = Rewriter(lambda c: c if c == known else None, {"a": ("5 USD", "USD")}), []
        for piece in cuts:
            events += w.feed(piece)
        events += w.flush()
        return "".join(x for k, x in events if k == "token"), [x for k, x in events if k == "citation"]

    at = sorted(rnd.randint(0, len(text)) for _ in range(rnd.randint(0, 6)))
    assert run([text]) == run([text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)])


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_files(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = _zip({"xl/workbook.xml": f'<workbook {main}><sheets><sheet name="Invoices"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Vendor</t></is></c><c r="B1"><v>12</v></c></row></sheetData></worksheet>'})
    word = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = _zip({"word/document.xml": f"<w:document {word}><w:body><w:p><w:r><w:t>Supplier: Acme</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    for name, data in {"a.xlsx": xlsx, "b.docx": docx, "c.csv": b"Date;Debit\n2024-01-01;5\n2024-01-02;\n", "d.txt": b"Hello, you\n\nTotal: 5", "e.txt": b"Hello, you\n\nTotal: 5", "f.pdf": b"%PDF-1.7 x"}.items():
        (tmp_path / name).write_bytes(data)
    rows = files.parse(files.files(spark, str(tmp_path))).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.filename, r.line_no or 0)):
        by.setdefault(r.filename, []).append((r.source_format, r.text, r.locator, r.error))
    assert by["a.xlsx"] == [("xlsx", "Vendor | 12", "Invoices!row 1", None)]
    assert [x[1:3] for x in by["b.docx"]] == [("Supplier: Acme", "paragraph 1"), ("a | b", "table 1 row 1")]
    assert [x[1] for x in by["c.csv"]] == ["Date | Debit", "2024-01-01 | 5", "2024-01-02 | "]
    assert [x[2] for x in by["d.txt"]] == ["line 1", "line 3"]
    assert "e.txt" not in by and by["f.pdf"][0][3]


def test_sequence_stream(spark, tmp_path):
    from tabulon.streaming.events import sequence_stream

    source = tmp_path / "in"
    spark.createDataFrame([(k, i, "t", "p") for i in range(6) for k in ("a", "b")], "workspace_id string, event_id long, type string, payload string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("workspace_id string, event_id long, type string, payload string").parquet(str(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = sequence_stream(stream, "workspace_id").writeStream.format("memory").queryName("sequenced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("sequenced").orderBy("workspace_id", "seq").collect()
    assert [(r.workspace_id, r.event_id, r.seq) for r in rows] == [(k, i, i + 1) for k in ("a", "b") for i in range(6)]


def test_a_line_is_matched_once(spark):
    """Neither the pattern of a line nor that of a key or a type is copied into what reads it, and lines that are no rows of a table aren't shuffled."""
    lines = spark.createDataFrame([(1, 0, 1, "Total Due: $5"), (1, 0, 2, "no mark"), (1, 0, 3, "Notes: x")], "document_id long, page_index int, line_no int, text string")
    found = extract.labelled_fields(lines)
    assert [(r.key, r.label, r.value_text, r.value_type, r.line_no) for r in found.collect()] == [("total_due", "Total Due", "$5", "currency", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("A-Za-z0-9 /&") <= 2 and plan.count("[^a-z0-9]+") == 1


def test_search_of_pages_as_page_by_page():
    """The best page by every stretch of every page, in order, for quotes that are there, edited, absent, long and repeated."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randint(1, 7)))
    for trial in range(300):
        pages = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(rng.randint(1, 5))]
        held = rng.choice(pages)[1]
        at = rng.randint(0, max(0, len(held) - 5))
        quote = list(held[at : at + rng.choice((1, 2, 9, 30, 60, 150))] or "ab")
        for _ in range(rng.randint(0, 1 + len(quote) // 8)):
            quote[rng.randrange(len(quote))] = rng.choice(("", "z", "et"))
        quote = "".join(quote).strip() or "q"
        best = (0.0, None, 0, 0)
        for k, text in pages:
            s, i, j = ground.best_window(quote, text)
            if s > best[0]:
                best = (s, k, i, j)
            if best[0] >= ground.ENOUGH:
                break
        assert ground.search(quote, pages) == best, (trial, quote, pages)


def test_a_text_is_folded_as_its_words(spark):
    """In whole as word by word, for marks, numbers, letters of several scripts and words of which nothing is left."""
    rng = random.Random(11)
    odd = ["$1,234.50", "1,234,567", "1,2345", "--a--b--", "%", "5%", "(5%)", "%-", "a%-", "--%", "«Ж»", "ΟΔΟΣ", "İs", "٣,٢٢٢", "12,345é", "x́,", "1,234́", "€€", "a- ", "\x85b", "_x_", "😀a😀", "½", "…", "'", "a\tb\n", " q ", "ΑΣ'", "1,234_", "𝒜", "𝒜.", "-𝒜😀-", "😀-", "😀-𝒜"]
    signs = "aZ1,.%$€-_ éΣ½́😀𝒜"
    texts = [" ".join(rng.choice(odd) for _ in range(rng.randint(0, 6))) for _ in range(400)] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    by_word = F.array_join(F.filter(F.transform(F.split("t", " "), lambda w: fold_token(w)), lambda w: w != ""), " ")
    assert rows.select("t", fold_text(F.col("t")).alias("whole"), by_word.alias("words")).where("whole <> words").collect() == []


def test_quotes_of_many_documents_share_batches(spark):
    """As page by page, where documents begin and end inside batches; a word may hold a blank, a page no words, a document no pages."""
    rng = random.Random(12)
    word = lambda: rng.choice(("", "..", "Total", "a b", *["".join(rng.choice("etaoin") for _ in range(rng.randint(1, 7))) for _ in range(9)]))
    pages, fields = [], []
    for d in range(60):
        sheets = {k: [word() for _ in range(rng.choice((0, 3, 40)))] for k in rng.sample(range(6), rng.randint(0, 5))}
        pages += [(f"d{d}", k, words) for k, words in sheets.items()]
        for q in range(rng.randint(0, 4)):
            held = rng.choice([*sheets.values(), ["absent"]])
            at = rng.randrange(max(1, len(held)))
            quote = list(" ".join(held[at : at + 6]))
            if quote and rng.random() < 0.5:
                quote[rng.randrange(len(quote))] = "#z"
            fields.append((f"d{d}", f"q{q}", rng.choice(("".join(quote), None)) if q == 3 else "".join(quote), rng.choice((None, 0, 1, 4, 9))))
    folded = lambda words: [w for w in (x.strip(".#").lower() for x in words) if w]
    want = set()
    for d, key, quote, cited in fields:
        of = sorted(((k, folded(w)) for x, k, w in pages if x == d), key=lambda x: (2 if cited is None else min(2, abs(x[0] - cited)), x[0]))
        q, best, failure, a, b = " ".join(folded((quote or "").split())), (0.0, None, 0, 0), None, None, None
        if not q:
            failure = "no_quote"
        elif not any(w for _, w in of):
            failure = "no_text_layer"
        else:
            for k, words in of:
                score, i, j = ground.best_window(q, " ".join(words))
                if score > best[0]:
                    best = (score, k, i, j)
                if best[0] >= ground.ENOUGH:
                    break
            if best[0] < ground.LEAST:
                failure = "quote_not_found" if cited is None or cited in dict(of) else "page_out_of_range"
                best = (best[0], None, 0, 0)
        at = 0
        for n, w in enumerate(dict(of).get(best[1], ())):
            if at < best[3] and best[2] < at + len(w):
                a, b = (n if a is None else a), n + 1
            at += len(w) + 1
        want.add((d, key, round(best[0], 1), best[1], a, b, failure))
    assert {None, "no_quote", "no_text_layer", "quote_not_found", "page_out_of_range"} == {x[6] for x in want} and sum(85 <= x[2] < 100 for x in want) > 9
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = ground.ground(spark.createDataFrame(fields, "document_id string, field_key string, quote string, page_index int"), spark.createDataFrame(pages, "document_id string, page_index int, words array<string>"))
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    assert len(got) == len(fields) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" not in plan and plan.count("MapInArrow") == 1  # Python was called once a document, at some 10 ms each


def test_search_of_repeated_words_scores_few_stretches(monkeypatch):
    """Equal stretches further on can't be first: one is scored, and those before it; over runs of pages as over pages."""
    monkeypatch.setattr(ground, "LETTERS_HELD", 500)
    quote, pages = "so on and so on and", [(k, ("so on end " * 40).strip()) for k in range(20)] + [(20, "so on and so onx and")]
    scored, kept = [], ground.Stretches.ratio
    monkeypatch.setattr(ground.Stretches, "ratio", lambda self, *place: scored.append(place) or kept(self, *place))
    best = max(((*ground.best_window(quote, text)[:1], -k, *ground.best_window(quote, text)[1:]) for k, text in pages), key=lambda x: x[:2])
    assert ground.search(quote, pages) == (best[0], -best[1], *best[2:])
    assert len(scored) < 2000  # 8,000 places
    scored.clear()
    score, first, end = ground.best_window("x" * 50 + "#" + "x" * 449, "x" * 502)
    assert ground.search("x" * 50 + "#" + "x" * 449, [(0, "y"), (1, "x" * 502)]) == (score, 1, first, end)
    assert len(scored) < 5  # what is on the same page and can only be less isn't scored
