"""Pages, visual lines and citations against plain versions."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tabulon.functions.vectors import cosine
from tabulon.model import FieldSpec
from tabulon.operators import drift, guided, layout, retrieve


def plain_lines(boxes):
    lines = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0], b[3], b[2])):
        if lines and any(b[1] - 0.5 < m[3] and m[1] - 0.5 < b[3] for m in lines[-1]):
            lines[-1].append(b)
        else:
            lines.append([b])
    return [(min(b[0] for b in x), min(b[1] for b in x), max(b[2] for b in x), max(b[3] for b in x)) for x in lines]


def test_visual_lines(spark):
    rng = random.Random(3)
    rows = []
    for key in range(40):
        for _ in range(rng.randint(1, 12)):
            x, top = rng.randint(0, 50) / 2, rng.randint(0, 60) / 2
            rows.append((key, x, top, x + rng.randint(1, 9), top + rng.randint(0, 5)))
    rows += rows[:20]  # the same box again
    got = layout.visual_lines(spark.createDataFrame(rows, "k int, x0 double, top double, x1 double, bottom double"), ["k"]).orderBy("k", "line").collect()
    want = [(k, *b) for k in range(40) for b in plain_lines([tuple(map(float, r[1:])) for r in rows if r[0] == k])]
    assert [(r.k, r.x0, r.top, r.x1, r.bottom) for r in got] == want
    assert sum(r.n_boxes for r in got) == len(rows)


def test_pages_and_citations(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(i % 40)) for i in range(130))
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x" * 5000 + " y")], "document_id long, text string")
    pages = layout.layout_pages(docs)
    held = {(r.document_id, r.page_index): r for r in pages.collect()}
    assert [w.text for k in sorted(held) if k[0] == 1 for w in held[k].words] == text.split()
    assert all(len(r.lines) <= layout.LINES for r in held.values())
    assert not held[2, 0].words and not held[3, 0].words and len(held[4, 0].lines) == 2
    spans = layout.line_word_spans(pages).withColumn("chunk_id", F.concat_ws("-", "document_id", "page_index", "line_no"))
    for r in spans.collect():
        assert r.text == " ".join(w.text for w in held[r.document_id, r.page_index].words[r.word_start : r.word_end])
    whole = spans.groupBy("document_id", "page_index").agg(F.lit("t " * 300).alias("text"), F.min("word_start").alias("word_start"), F.max("word_end").alias("word_end")).withColumn("chunk_id", F.concat_ws("-", "document_id", "page_index"))
    none = spark.createDataFrame([("none", 2, 0, "t", None, None)], "chunk_id string, document_id long, page_index int, text string, word_start int, word_end int")
    cited = {r.chunk_id: r for r in layout.cite(whole.unionByName(none), pages).collect()}
    assert cited["none"].boxes == []
    assert len(cited["1-0"].excerpt) <= 240 and cited["1-0"].excerpt.endswith("…")
    for (doc, page), p in held.items():
        if p.words:
            want = [(b.x0, b.top, b.x1, b.bottom) for b in p.lines][: layout.MOST_BOXES]
            assert [tuple(b) for b in cited[f"{doc}-{page}"].boxes] == want


def test_line_without_words():
    box = lambda top, text="t": {"text": text, "top": top, "bottom": top + 10}
    assert layout.spans_of([], []) == []
    assert layout.spans_of([box(0), box(0), box(40)], [box(0), box(20), box(40), box(60), box(80, " ")]) == [(0, 0, 2), (2, 2, 3), (3, None, None)]


def test_digest_page(spark):
    rows = [(1, 0, [1]), (1, 1, [1, 2]), (1, 2, [1]), (1, 2, [2]), (2, 0, []), (3, None, [1])]
    got = layout.digest_page(spark.createDataFrame(rows, "document_id long, page_index int, boxes array<int>")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 2)]


def test_nearest_in_blocks(spark):
    rng = random.Random(5)
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(8)]) for i in range(120)], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pick = lambda df: sorted((r.query_id, r.place, r.vec_id) for r in df.collect())
    once = pick(retrieve.nearest(vectors, asked, 4))
    assert len(once) == 24 * 4 and pick(retrieve.nearest(vectors, asked, 4, block=5)) == once
    assert retrieve.nearest(vectors, asked.where("false"), 4).count() == 0


class Caught:
    """A frame of (document_id, text) that keeps what is mapped over it, so that a task's batches can be counted."""

    dtypes = (("document_id", "bigint"), ("text", "string"))

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_pages_are_given_up_in_parts(monkeypatch):
    monkeypatch.setattr(layout, "WORDS_HELD", 1000)
    run = layout.layout_pages(Caught())
    texts = ["word " * 300, None, "", "x " * 30_000]
    docs = pa.RecordBatch.from_pydict({"document_id": pa.array(range(400), pa.int64()), "text": [texts[i % 4] for i in range(400)]})
    words, pages = [], 0
    for batch in run(iter([docs, docs.slice(0, 0)])):
        words.append(len(batch.column("words").flatten()))
        pages += batch.num_rows
    assert sum(words) == 100 * 30_300 and max(words) <= 1000 + layout.LINES * layout.COLUMNS
    assert pages > 300


def test_spans_of_a_batch_in_parts(monkeypatch):
    monkeypatch.setattr(layout, "ROWS_HELD", 3)
    rng = random.Random(7)
    box = lambda top: {"text": "t", "top": float(top), "bottom": float(top + rng.randint(3, 9))}
    pages = [([box(k * rng.randint(5, 12)) for k in range(rng.randint(0, 30))], [box(k * 10) for k in range(rng.randint(0, 20))]) for _ in range(50)]
    pages[4] = (None, None)
    of = lambda side, c: [None if p[side] is None else [b[c] for b in p[side]] for p in pages]
    batch = pa.RecordBatch.from_pydict({"document_id": list(range(50)), "page_index": [0] * 50, "wt": of(0, "top"), "wb": of(0, "bottom"), "lt": of(1, "top"), "lb": of(1, "bottom"), "text": of(1, "text")})
    got = {doc: spans for doc, _, _, spans in layout.spanned(batch.slice(2))}
    assert got == {i: layout.spans_of(w or [], n or []) for i, (w, n) in enumerate(pages) if i >= 2}


def test_boxes_of_a_range_without_a_shuffle(spark):
    rng = random.Random(11)
    rows = []
    for key in range(60):
        boxes = [(rng.randint(0, 50) / 2, top := rng.randint(0, 60) / 2, 60.0, top + rng.randint(0, 5)) for _ in range(rng.randint(0, 12))]
        rows.append((key, boxes + boxes[:2]))
    df = spark.createDataFrame(rows, "k int, b array<struct<x0:double,top:double,x1:double,bottom:double>>")
    got = df.select("k", layout.line_boxes(F.col("b")).alias("l")).collect()
    assert {r.k: [tuple(b) for b in r.l] for r in got} == {k: plain_lines(b) for k, b in rows}
    pages = df.select(F.col("k").alias("document_id"), F.lit(0).alias("page_index"), F.col("b").alias("words"))
    chunks = df.select(F.col("k").alias("chunk_id"), F.col("k").alias("document_id"), F.lit(0).alias("page_index"), F.lit("t").alias("text"), F.lit(0).alias("word_start"), F.size("b").alias("word_end"))
    plan = layout.cite(chunks, pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 0 and plan.count("Join") == 1  # pages meet their chunks once, no box is shuffled


def test_nearest_of_odd_vectors(spark):
    """As every pair by the expression: copies, lengths, nulls, zeros, negatives, extremes; and no pair is made in the plan."""
    rng = random.Random(9)
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, 2.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [1e-200, 0.0, 0.0, 0.0], [-1.0, -1.0, -1.0, -1.0], [1e200, 1e200, 0.0, 0.0]]
    rows = [(i, odd[i % 10] if i % 7 == 0 else [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    every = vectors.crossJoin(asked).select("query_id", "vec_id", cosine(F.col("embedding"), F.col("query")).alias("score"))
    want = {}
    for r in every.collect():
        want.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    found = retrieve.nearest(vectors, asked, 6, block=40, part=70)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.place, -r.score, r.vec_id))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == {q: sorted(v)[:6] for q, v in want.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner" not in plan


def test_documents_are_no_groups_of_python(spark):
    """Drift and guided extraction send many documents a batch, judge equal ones alike, and keep the order of a document's fields."""
    fields = (FieldSpec("total", "Total", "currency"), FieldSpec("issued", "Issued", "date"))
    rows = [(d, p, n, k, k.title(), k, "string", 0.5, k) for d in range(50) for p, n, k in ((None, 1, "zeta"), (0, 2, "totals"), (0, None, "issued"), (0, 1, "omega"))]
    found = spark.createDataFrame(rows, "document_id long, page_index int, line_no int, key string, label string, value_text string, value_type string, confidence double, quote string")
    for df in (drift.assess(found.withColumnRenamed("value_type", "type"), fields), guided.guided(found.select("document_id").where("document_id < 5"), found, fields)):
        assert "InPandas" not in df._jdf.queryExecution().optimizedPlan().toString()
        held = {}
        for r in df.collect():
            held.setdefault(r.document_id, []).append(tuple(r)[1:])
        assert len(held) == 50 and len(set(map(repr, held.values()))) == 1
        assert [x[0] for x in held[0]] == (["omega", "totals", "issued", "zeta"] if "verdict" in df.columns else ["total", "issued", "omega", "zeta"])
