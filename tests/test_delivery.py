"""Sinks by document, drift, guided extraction, answers and views on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.model import FieldSpec
from tabulon.operators import drift, guided, views
from tabulon.sources import blobs, sinks
from tabulon.streaming import answers

SCHEMA = (FieldSpec("total_due", "Total Due", "currency", currency_default="USD"), FieldSpec("vendor", "Vendor Name", "string", aliases=("seller",)))


def rows_of(spark, path):
    return sorted(tuple(r) for r in sinks.read_documents(spark, path).select("document_id", "ordinal", "text").collect())


def test_documents_are_replaced_and_deleted(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    make = lambda rows: spark.createDataFrame(rows, "document_id string, ordinal int, text string")
    sinks.delete_documents(make([("a", 0, "x")]), path)  # no table yet
    first = make([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), (None, 0, "lost")])
    for _ in range(2):
        sinks.replace_documents(first, path)
        assert rows_of(spark, path) == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]
    sinks.replace_documents(make([("a", 0, "new")]), path)
    assert rows_of(spark, path) == [("a", 0, "new"), ("b", 0, "z")]
    sinks.replace_documents(make([("b", 7, "w")]).limit(0), path, make([("b", 0, "")]).select("document_id"))  # re-extracted to nothing
    assert rows_of(spark, path) == [("a", 0, "new")]
    sinks.delete_documents(make([("a", 0, ""), ("unknown", 0, "")]), path)
    assert rows_of(spark, path) == []
    sinks.replace_documents(make([(str(i), i, "t") for i in range(50)]), path)
    assert len(rows_of(spark, path)) == 50


def test_broken_writes_and_compaction(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    make = lambda rows: spark.createDataFrame(rows, "document_id string, ordinal int, text string")
    sinks.replace_documents(make([("a", i, "x") for i in range(40)] + [("b", 0, "y")]), path)
    sinks.replace_documents(make([("b", 1, "z"), ("c", 0, "w")]).withColumn("page", F.lit(3)), path)
    want = rows_of(spark, path)
    assert want == sorted([("a", i, "x") for i in range(40)] + [("b", 1, "z"), ("c", 0, "w")])
    make([("a", 99, "lost")]).write.parquet(f"{path}/rows/write=3")  # a job that died before its commit
    assert rows_of(spark, path) == want
    make([("a", 99, "lost")]).select("document_id").write.parquet(f"{path}/commits/write=3")
    (tmp_path / "chunks/commits/write=3/_SUCCESS").unlink()
    assert rows_of(spark, path) == want
    sinks.compact(spark, path)
    assert rows_of(spark, path) == want and sinks.vacuum(spark, path) == 6
    assert rows_of(spark, path) == want and sinks.vacuum(spark, path) == 0
    assert {r.page for r in sinks.read_documents(spark, path).where("document_id = 'c'").collect()} == {3}
    sinks.replace_documents(sinks.read_documents(spark, path).where("document_id = 'a' and ordinal < 2"), path)  # from the table itself
    assert rows_of(spark, path) == [("a", 0, "x"), ("a", 1, "x"), ("b", 1, "z"), ("c", 0, "w")]


def test_blobs_by_key_range_and_prefix(spark, tmp_path):
    path = f"file://{tmp_path}/blobs"
    data = {"w/d1/file.pdf": bytes(range(256)) * 5, "w/d1/page-0.png": b"0123456789", "w/d2/file": b"", "w/d10": b"abc"}
    odd = [("../etc/passwd", b"x"), ("/abs", b"x"), ("a//b", b"x"), ("a/.hidden", b"x"), ("a b", b"x"), ("end/", b"x"), ("line\n", b"x"), ("/".join("abcdefghi"), b"x"), (None, b"x"), ("empty", None)]
    objects = spark.createDataFrame([*data.items(), ("w/d10", b"abc"), *odd], "key string, content binary")
    blobs.put(objects, path, block=7)
    assert blobs.refused(objects).count() == len(odd)
    assert {r.key: r.length for r in blobs.listing(spark, path).collect()} == {k: len(v) for k, v in data.items()}
    names = spark.createDataFrame([(k,) for k in [*data, "unknown"]], "key string")
    assert {r.key: bytes(r.content) for r in blobs.get(spark, path, names).collect()} == data
    asked = [(k, f, t) for k in [*data, "unknown"] for f in (None, 0, 6, 7, 13, 500, 5000) for t in (None, 0, 6, 7, 20, 1279, 9000)]
    want = {}
    for k, f, t in asked:
        if k in data:
            end = len(data[k]) - 1
            first = max(min(f or 0, end), 0)
            last = end if end < 0 else max(min(end if t is None else t, end), first)
            want[k, first, last] = data[k][first : last + 1]
    got = blobs.ranges(spark, path, spark.createDataFrame(asked, "key string, first long, last long")).collect()
    assert {(r.key, r.first, r.last): bytes(r.content) for r in got} == want and len(got) == len(want)
    blobs.put(spark.createDataFrame([("w/d10", b"newer")], "key string, content binary"), path)
    blobs.delete_prefix(spark, path, "w/d1/")
    assert {r.key: bytes(r.content) for r in blobs.get(spark, path, names).collect()} == {"w/d2/file": b"", "w/d10": b"newer"}


def test_pages_keep_their_boxes(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    pages = spark.sql("select 'd' as document_id, 0 as page_index, array(struct('w' as text, struct(1d as x0, 2d as top, 3d as x1, 4d as bottom) as box)) as words")
    sinks.replace_documents(pages, path)
    assert sinks.read_documents(spark, path).select("document_id", "page_index", "words").collect() == pages.collect()


def extras(spark, rows):
    return spark.createDataFrame([("d", 0, i, k, label, t) for i, (k, label, t) in enumerate(rows)], "document_id string, page_index int, line_no int, key string, label string, type string")


def test_drift_in_order_and_capped(spark):
    rows = [("seller", "Seller", "string"), ("amount_due_total", "Due Total", "number"), ("vendor_nam", "Vendor Nam", "number"), ("zone", "Zone", "string"), ("zone", "Zone", "string"), ("zones", "Zones", "string"), ("Bad Key", "x", "string"), *[(f"q{c}{c}{c}x", f"{c}{c}{c}", "string") for c in "abcdefghijk"]]
    got = [(r.key, r.verdict, r.target, r.why) for r in drift.assess(extras(spark, rows), SCHEMA).collect()]
    assert got[0] == ("seller", "map", "vendor", None)
    assert got[1] == ("amount_due_total", "map", "total_due", None)
    assert got[2] == ("vendor_nam", "add", "vendor_nam", "type_mismatch")
    assert [g[1] for g in got[3:6]] == ["add", "map", "map"] and got[5][2] == "zone"
    assert got[6][1:] == ("drop", None, "unusable_key")
    assert sum(g[1] == "add" for g in got) == 8 and {g[3] for g in got if g[1] == "drop"} == {"unusable_key", "too_many"}
    fields = drift.merged_schema(SCHEMA, drift.assess(extras(spark, rows), SCHEMA))
    assert len(fields) == 10 and "zones" in next(f for f in fields if f.key == "zone").aliases
    assert fields[1].aliases == ("seller",)


def test_decisions_beyond_the_width_have_rows(spark):
    names = [f"{a}{b}" * 5 for a in "abcdefgh" for b in "klmnopqr"]
    rows = [(f"d{i}", 0, 0, n, n, "string") for i, n in enumerate(names)] + [("again", 0, 0, names[9], names[9], "string")]
    assessed = drift.assess(spark.createDataFrame(rows, "document_id string, page_index int, line_no int, key string, label string, type string"), SCHEMA)
    made = drift.decisions(SCHEMA, assessed).where("verdict = 'add'").collect()
    assert len(made) == len(names) and sum(r.kept for r in made) == 40 - len(SCHEMA)
    assert min(made, key=lambda r: r.place).key == names[9]
    fields = drift.merged_schema(SCHEMA, assessed)
    assert {f.key for f in fields} == {f.key for f in SCHEMA} | {r.key for r in made if r.kept}


def test_drift_with_vectors_and_without_a_schema(spark):
    one = extras(spark, [("colour", "Colour", "string"), ("far", "Far", "string")]).withColumn("vector", F.when(F.col("key") == "colour", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    got = drift.assess(one, [FieldSpec("hue", "Hue", "string")], {"hue": [1.0, 0.01]}).orderBy("key").collect()
    assert [(r.verdict, r.target, r.why) for r in got] == [("map", "hue", None), ("add", "far", None)]
    assert [r.verdict for r in drift.assess(extras(spark, [("a", "A", "string")]), []).collect()] == ["add"]
    assert drift.assess(extras(spark, [("a", "A", "string")]).limit(0), SCHEMA).count() == 0
    assert drift.summaries(drift.assess(extras(spark, [("vendor", "Vendor", "string")]), SCHEMA)).first().summary == "No schema change."
    assert drift.summaries(drift.assess(extras(spark, [("seller", "Seller", "string")]), SCHEMA)).first().summary == "Mapped seller to vendor."


def test_guided_choice():
    assert guided.pick(SCHEMA[1], [("seller", "x"), ("vendor", "y")]) == 1
    assert guided.pick(SCHEMA[1], [("other", "Vendor Name"), ("SELLER", "y")]) == 1
    assert guided.pick(SCHEMA[0], [("a", "Total Dues"), ("b", "Total Due")]) == 1
    assert guided.pick(SCHEMA[0], [("a", "Quantity")]) is None and guided.pick(SCHEMA[0], []) is None


def test_answers(spark):
    rows = [(1, 1, "status", "reading", None), (1, 2, "token", "a", None), (1, 3, "citation", "old", 1), (1, 4, "citation", "two", 2), (1, 5, "citation", "new", 1), (1, 6, "token", "b", None), (1, 2, "token", "a", None), (2, 1, "error", "no", None)]
    events = spark.createDataFrame(rows, "message_id long, seq long, type string, text string, n long")
    got = {r.message_id: (r.text, r.stage, [tuple(c) for c in r.citations]) for r in answers.fold_answers(events).collect()}
    assert got == {1: ("ab", "reading", [(1, "new"), (2, "two")]), 2: ("", "failed", [])}


def test_table_order_and_locator(spark):
    from tabulon.queries import _v

    rows = spark.createDataFrame([("a", 10.0), ("b", 9.0), ("c", None)], "k string, n double").select("k", _v(n=F.col("n"), s=F.col("k")).alias("v"))
    order = lambda kind, desc: [r.k for r in rows.orderBy(*views.table_order(F.col("v"), F.lit(kind), desc)).collect()]
    assert order("number", False) == ["b", "a", "c"] and order("number", True) == ["a", "b", "c"]
    assert order("string", True) == ["c", "b", "a"]
    found = spark.sql("select array(struct('A1' as locator, struct(0d as x0, 0d as top, 9d as x1, 5d as bottom) as box), struct('A2' as locator, struct(0d as x0, 10d as top, 9d as x1, 15d as bottom) as box)) as lines, struct(1d as x0, 11d as top, 2d as x1, 12d as bottom) as box")
    assert found.select(views.locator_of(F.col("lines"), F.col("box")).alias("at")).first().at == "A2"
    assert spark.range(1).select(views.wire_status(F.lit("awaiting_schema")).alias("s")).first().s == "extracting"
