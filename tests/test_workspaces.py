"""Queries as rows, planned questions and dashboards against single queries and brute force; streams of answers."""

from __future__ import annotations

import contextlib
import io
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tabulon import queries_workspaces
from tabulon.model import FieldSpec
from tabulon.operators import ask, dashboard, profile
from tabulon.plans import shared
from tabulon.plans.planner import plan
from tabulon.spec import DataQuery

TYPES = {"total": "currency", "rank": "number", "segment": "string", "day": "date", "urgent": "boolean", "tags": "string_list"}
VALUE = "struct<s:string,n:double,ccy:string,d:date,b:boolean,l:array<string>>"


def slots(spark, rows):
    """(workspace, record, key, kind, value) as tall rows."""
    cells = []
    for w, r, k, kind, x in rows:
        s = {"s": None, "n": None, "ccy": None, "d": None, "b": None, "l": None}
        if x is not None:
            if kind == "currency":
                s["n"], s["ccy"] = x
            elif kind == "date":
                s["s"] = x
            else:
                s[{"number": "n", "boolean": "b", "string_list": "l"}.get(kind, "s")] = x
        cells.append((w, r, k, kind, tuple(s.values())))
    df = spark.createDataFrame(cells, f"workspace_id string, record_id string, field_key string, value_type string, v {VALUE.replace('d:date', 'd:string')}")
    return df.withColumn("v", F.struct("v.s", "v.n", "v.ccy", F.when(F.col("value_type") == "date", F.to_date("v.s")).alias("d"), "v.b", "v.l"))


@pytest.fixture(scope="module")
def tenants(spark):
    """Three workspaces with the same schema, aliases, missing rows, rows without a value, and a workspace without values."""
    rnd, rows, records = random.Random(5), [], []
    for w in ("a", "b", "c"):
        for i in range(40):
            r = f"{w}{i}"
            records.append((w, r))
            if w == "c":
                continue
            make = {
                "total": lambda: (round(rnd.uniform(-50, 500), 2), rnd.choice(["USD", "EUR"] if w == "a" else ["USD"])), "rank": lambda: float(rnd.randint(0, 5)), "segment": lambda: rnd.choice(["north", "South", " ", "5", "Not stated"]),
                "day": lambda: f"202{rnd.randint(0, 3)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}", "urgent": lambda: rnd.random() < 0.5, "tags": lambda: rnd.choice([["x"], ["x", "y"], []])}
            for k, f in make.items():
                if rnd.random() < 0.8:
                    key = "amount_due" if k == "total" and rnd.random() < 0.3 else k
                    rows.append((w, r, key, TYPES[k], f() if rnd.random() < 0.9 else None))
    fields = [(w, i, k, k.title(), t, "USD" if t == "currency" else None, [k, "amount_due"] if k == "total" else [k]) for w in ("a", "b", "c") for i, (k, t) in enumerate(TYPES.items())]
    return spark.createDataFrame(records, "workspace_id string, record_id string").cache(), slots(spark, rows).cache(), spark.createDataFrame(fields, shared.FIELD).cache()


SPECS = [FieldSpec(k, k.title(), t, aliases=("amount_due",) if k == "total" else (), currency_default="USD" if t == "currency" else None) for k, t in TYPES.items()]


def random_query(rnd):
    aggregate = rnd.choice(["sum", "count", "avg", "min", "max"])
    measure = rnd.choice(["total", "rank", "urgent", "segment", "nowhere"] + ([None] if aggregate == "count" else []))
    group = rnd.choice([None, "segment", "day", "urgent", "tags", "total", "nowhere"])
    values = {"total": ["100", "1e2", "-3.5", "abc"], "rank": ["3", "3.0", "2,0"], "segment": ["NORTH", "o", "5"], "day": ["2021-06-01", "2022"], "urgent": ["true", "1", "yes"], "tags": ["x", "x, y"], "nowhere": ["q"]}
    filters = []
    for _ in range(rnd.randint(0, 2)):
        f, op = rnd.choice(list(values)), rnd.choice(["eq", "ne", "gt", "gte", "lt", "lte", "contains", "missing", "present"])
        filters.append({"field": f, "op": op, "value": None if op in ("missing", "present") else rnd.choice(values[f])})
    return {"aggregate": aggregate, "measure_field": measure, "group_by": group, "date_bucket": rnd.choice([None, "month", "quarter", "year"]) if group == "day" else None, "filters": filters, "sort": rnd.choice(["value_desc", "value_asc", "label_asc"]), "limit": rnd.choice([1, 3, 50])}


@pytest.mark.parametrize("few", [True, False])
def test_many_queries_equal_single_ones(spark, tenants, few, monkeypatch):
    records, values, fields = tenants
    rnd = random.Random(11)
    specs = [random_query(rnd) for _ in range(24 if few else 8)]
    if not few:
        monkeypatch.setattr(shared, "BROADCAST_QUERIES", 0)
    rows = [(w, str(i), q["aggregate"], q["measure_field"], q["group_by"], q["date_bucket"], [(f["field"], f["op"], f["value"]) for f in q["filters"]], q["sort"], q["limit"]) for i, q in enumerate(specs) for w in ("a", "b", "c")]
    got = {}
    for r in shared.evaluate(spark.createDataFrame(rows, shared.QUERY), records, values, fields).collect():
        got.setdefault((r.workspace_id, r.query_id), {})[r.place] = (r.label, r.value, r.record_count, r.currencies)
    assert len(got) == len(rows)
    near = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) < 1e-9)
    for i, q in enumerate(specs):
        spec = {**q, "filters": [{**f, "value": True if f["value"] == "true" else f["value"]} for f in q["filters"]]}
        for w in ("a", "b", "c") if i < 6 else ("a",):
            out, total = plan(DataQuery.of(spec), records, values, SPECS, workspace_id=w)
            mine, t = got[w, str(i)], total.first()
            want = [(r.label, r.value) for r in out.collect()]
            found = [mine[p][:2] for p in sorted(mine) if p]
            assert len(want) == len(found) and all(a[0] == b[0] and near(a[1], b[1]) for a, b in zip(want, found, strict=True)), (q, want, found)
            assert near(mine[0][1], t.total) and mine[0][2] == t.record_count and mine[0][3] == t.currencies, (q, mine[0], t)


def test_queries_read_their_table_once(spark, tenants, tmp_path):
    records, values, fields = tenants
    values.write.parquet(str(tmp_path / "values"))
    rnd = random.Random(2)
    rows = [("a", str(i), "sum", "total", rnd.choice(["segment", None]), None, [], "value_desc", 20) for i in range(6)]
    df = shared.evaluate(spark.createDataFrame(rows, shared.QUERY), records, spark.read.parquet(str(tmp_path / "values")), fields)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[", text)) == 1


def test_queries_that_cannot_be_asked_are_left_out(spark, tenants):
    ok = ("a", "0", "count", None, None, None, None, None, None)
    bad = [("a", "1", "median", "total", None, None, [], None, None), ("a", "2", "sum", None, None, None, [], None, None), ("a", "3", "count", None, None, None, [("total", "gt", None)], None, None), ("a", "4", "count", None, None, None, [], None, 51), ("a", "5", "count", None, "day", "week", [], None, None)]
    got = shared.evaluate(spark.createDataFrame([ok, *bad], shared.QUERY), *tenants).collect()
    assert {r.query_id for r in got} == {"0"} and [r.value for r in got] == [40.0, 40.0]


def folded(text):
    words = re.sub(r"[^\w]+|_", " ", text.lower()).split()
    kept = [w for w in words if w not in ("no", "num", "number", "id", "ref", "reference", "the", "of")]
    return set(kept or words)


def asked(question, passages, fields):
    """(answerable, kind, title, aggregate, measure, group, missing) by reading the rules one after the other. fields: (key, label, type, currency)."""
    if not passages:
        return (False, *[None] * 6)
    low = question.lower()
    hints = ("total", "sum", "how much", "how many", "count", "average", "avg", "most", "largest", "highest", "lowest", "per ", " by ", "breakdown", "spend")
    if not fields or not any(h in low for h in hints):
        return (True, *[None] * 6)
    named = [f for f in fields if folded(f[1]) & folded(question)]
    m = next((f for f in named if f[2] == "currency"), None) or next((f for f in named if f[2] == "number"), None) or next((f for f in fields if f[2] == "currency"), None)
    g = next((f for f in named if f[2] in ("string", "enum", "date")), None)
    if any(h in low for h in ("missing", "without", "no ", "lack", "absent")) and named:
        return (True, "metric", f"Documents with no {named[0][1]}", "count", None, None, named[0][0])
    if m is None:
        return (True, "bar" if g else "metric", f"Documents by {g[1]}" if g else "Documents", "count", None, g[0] if g else None, None)
    title = f"{m[1]} by {g[1]}" if g else m[1] if m[1].lower().startswith("total") else f"Total {m[1]}"
    return (True, "bar" if g else "metric", title, "sum", m[0], g[0] if g else None, None)


def test_questions_are_planned_by_the_rules(spark):
    rnd = random.Random(9)
    labels = ["Total due", "Vendor name", "Invoice number", "Due date", "Status", "Quantity", "No.", "Amount", "Reference", "Paid by"]
    kinds = ["currency", "string", "number", "date", "enum", "boolean"]
    schemas, rows, questions = {}, [], []
    for w in range(12):
        fields = [(f"k{i}", label, rnd.choice(kinds), None) for i, label in enumerate(rnd.sample(labels, rnd.randint(0, 7)))]
        schemas[str(w)] = fields
        rows += [(str(w), i, k, label, t, "USD" if t == "currency" else None, [k]) for i, (k, label, t, _) in enumerate(fields)]
        words = ["total", "how many", "by vendor", "due", "missing", "no", "status", "average", "the", "quantity", "Amount?", "who", "paid", "reference", "per month", "spend"]
        questions += [(str(w), f"{w}-{i}", rnd.choice([" ".join(rnd.sample(words, rnd.randint(1, 5))), None]) if i else None, rnd.randint(0, 3)) for i in range(25)]
    got = ask.plan_questions(spark.createDataFrame(questions, "workspace_id string, question_id string, question string, passages int"), spark.createDataFrame(rows, shared.FIELD))
    found = {r.question_id: (r.answerable, r.kind, r.title, r.aggregate, r.measure_field, r.group_by, r.filters[0].field if r.filters else None) for r in got.collect()}
    assert found == {i: asked(q or "", p, schemas[w]) for w, i, q, p in questions}
    assert shared.checked(got.where("aggregate is not null").withColumn("query_id", F.col("question_id"))).count() == sum(v[1] is not None for v in found.values())


def test_slots_of_a_question(spark, tenants):
    q = spark.createDataFrame([("a", 1, "average total by day per quarter"), ("a", 2, "highest total"), ("a", 3, "lowest rank by segment"), ("a", 4, "total by segment"), ("a", 5, "total by segment")], "workspace_id string, question_id int, question string")
    plans = ask.with_spec_id(ask.plan_questions(q, tenants[2], slots=True))
    found = {r.question_id: r for r in plans.collect()}
    assert (found[1].aggregate, found[1].date_bucket, found[1].kind, found[1].title) == ("avg", "quarter", "line", "Average Total by Day")
    assert (found[2].aggregate, found[2].kind, found[2].title) == ("max", "metric", "Highest Total")
    assert (found[3].aggregate, found[3].measure_field, found[3].group_by) == ("min", "rank", "segment")
    assert found[4].title == "Total by Segment" and found[4].query_id == found[5].query_id
    assert ask.distinct_queries(plans).count() == 4


def test_suggestions(spark):
    rows = [("m", 0, "net", "Net sum", "currency", "USD", ["net"]), ("m", 1, "kind", "Kind", "enum", None, ["kind"]), ("s", 0, "a", "Area", "string", None, ["a"]), ("s", 1, "vendor_name", "Vendor", "string", None, ["vendor_name"]), ("n", 0, "x", "X", "number", None, ["x"]), ("p", 0, "t", "Total", "currency", "USD", ["t"]), ("p", 1, "o", "Owner", "string", None, ["o"])]
    fields = spark.createDataFrame(rows, shared.FIELD)
    values = slots(spark, [("m", str(i), "net", "currency", (1.0 * i, "USD")) for i in range(4)] + [("m", str(i), "kind", "enum", "ab"[i % 2]) for i in range(4)])
    stats = profile.schema_profile(values, spark.createDataFrame([(w, str(i)) for w in "msnp" for i in range(4)], "workspace_id string, record_id string"), fields)
    got = {}
    for r in ask.suggest_questions(fields, stats).orderBy("workspace_id", "place").collect():
        got.setdefault(r.workspace_id, []).append(r.question)
    assert got["m"] == ["What is the total net sum by kind?", "What is the total net sum?", "Which document has the largest amount?"]
    assert got["s"] == ["Which documents are missing an area?", "Which vendor appears most often?", "What dates do these documents cover?"]
    assert got["n"] == ["What do these documents have in common?", "Which document has the largest amount?", "What dates do these documents cover?"]
    assert got["p"] == ["What is the total by owner?", "Which owner appears most often?", "What dates do these documents cover?"]


def test_dashboards(spark, tenants):
    records, values, fields = tenants
    stats = profile.schema_profile(values, records, fields)
    rows = {(r.workspace_id, r.position): r for r in dashboard.dashboards(dashboard.propose_panels(stats), stats, records, values, fields).collect()}
    a = [rows[k] for k in sorted(rows) if k[0] == "a"]
    assert [r.title for r in a][:3] == ["Documents in this collection", "Total", "Total by segment"]
    assert a[0].total == 40 and a[0].kind == "metric" and a[0].reason is None
    assert sum(x.value for x in a[2].rows) == pytest.approx(a[1].total)
    assert a[1].currencies == ["EUR", "USD"]
    c = [rows[k] for k in sorted(rows) if k[0] == "c"]
    assert [(r.title, r.reason) for r in c] == [("Documents in this collection", None), ("Total", "empty"), ("Documents by month of day", "empty")]
    assert c[0].rationale == "There are 40 documents, the denominator for everything else."
    assert [r.coverage for r in profile.by_coverage(stats).where("workspace_id = 'a'").collect()] == sorted((r.coverage for r in stats.where("workspace_id = 'a'").collect()), reverse=True)


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def feed(spark, folder, schema, batches):
    """Parquet files that a stream takes one in each micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i:03}")
        time.sleep(0.05)


def test_buffers_replay_follow_beat_and_expire(spark, tmp_path):
    from tabulon.streaming.buffers import DELIVERIES, REQUESTS, follow_answers

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    row = lambda m, place, kind, reader=None, after=None, payload=None: (m, place, kind, reader, after, payload)
    where = tmp_path / "in"
    where.mkdir()
    write = lambda n, rows: spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(str(where))
    write(0, [row("m", 0, "open"), row("m", 1, "event", payload="e1"), row("m", 2, "event", payload="e2"), row("m", 3, "follow", "late", 1), row("never", 0, "follow", "x", 0), row("idle", 0, "open"), row("idle", 1, "event", payload="i1"), row("idle", 2, "follow", "w", 1)])
    stream = spark.readStream.schema(REQUESTS).parquet(str(where))
    start = lambda: follow_answers(stream, heartbeat_s=1.5, grace_s=2.0, most=4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    seen = lambda: [tuple(r) for r in spark.read.schema(DELIVERIES).parquet(str(tmp_path / "out")).select("message_id", "reader", "seq", "type", "payload").collect()] if (tmp_path / "out" / "_spark_metadata").exists() else []

    def until(test, seconds=60):
        end = time.time() + seconds
        while not test(seen()):
            assert time.time() < end, seen()
            time.sleep(0.3)

    q = start()
    try:
        until(lambda s: ("m", "late", 2, "event", "e2") in s and ("never", "x", None, "gone", None) in s)
        until(lambda s: ("idle", "w", 1, "heartbeat", None) in s)
        q.stop()  # what was delivered before the restart isn't delivered again
        write(1, [row("m", 4, "event", payload="e3"), row("m", 5, "follow", "new", 0), row("m", 6, "event", payload="e4"), row("m", 7, "event", payload="dropped")])
        q = start()
        until(lambda s: ("m", "new", 4, "event", "e4") in s and ("m", "late", 4, "event", "e4") in s)
        write(2, [row("m", 8, "close"), row("m", 9, "event", payload="too late")])
        until(lambda s: ("m", "new", 4, "end", None) in s and ("m", "late", 4, "end", None) in s)
        write(3, [row("m", 10, "follow", "after", 2)])
        until(lambda s: ("m", "after", 4, "end", None) in s)
        time.sleep(5)
        write(4, [row("m", 11, "follow", "gone", 0)])
        until(lambda s: ("m", "gone", None, "gone", None) in s)
    finally:
        q.stop()
    got = [r for r in seen() if r[0] == "m"]
    of = lambda reader: [(r[2], r[4]) for r in sorted((x for x in got if x[1] == reader and x[3] == "event"), key=lambda x: x[2])]
    assert of("late") == [(2, "e2"), (3, "e3"), (4, "e4")]
    assert of("new") == [(1, "e1"), (2, "e2"), (3, "e3"), (4, "e4")]
    assert of("after") == [(3, "e3"), (4, "e4")] and of("gone") == []


def test_rewritten_text_does_not_depend_on_micro_batches(spark, tmp_path):
    from tabulon.streaming.buffers import PARTS, rewrite_stream
    from tabulon.streaming.events import Rewriter

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rnd = random.Random(4)
    ids = [f"{i:08x}-0000-0000-0000-000000000000" for i in range(4)]
    pieces = ["The total is {{t}}", " USD", " USD", " and [^chunk:%s]" % ids[0], "[^chunk:%s]" % ids[1], "[^chunk:%s]" % ids[3], " [^chunk:bad] ", " [^1]", "{{no.such}}", " [", "{", "{{ n }} ", "items", "ü", "{{t}}", "."]
    wanted, parts = {}, []
    for m in range(6):
        text = "".join(rnd.choice(pieces) for _ in range(25)) + rnd.choice(["", "[^chunk:", "{{t"])
        w = Rewriter({ids[0]: "one", ids[1]: "two", ids[2]: "three"}.get, {"t": ("12.50 USD", "USD"), "n": ("3", None)})
        events = w.feed(text) + w.flush()
        wanted[m] = ("".join(x for k, x in events if k == "token"), [x for k, x in events if k == "citation"])
        rows = [("chunk", ids[0], "one", None), ("chunk", ids[1], "two", None), ("chunk", ids[2], "three", None), ("figure", "t", "12.50 USD", "USD"), ("figure", "n", "3", None)]
        cuts = sorted(rnd.sample(range(len(text)), 12))
        rows += [("delta", None, text[a:b], None) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] + [("end", None, None, None)]
        parts += [(str(m), i, *r) for i, r in enumerate(rows)]
    rnd.shuffle(parts)
    batches = [parts[i::5] for i in range(5)]
    batches[2] = batches[2] + batches[0][:9]  # delivered twice
    feed(spark, tmp_path / "in", PARTS, batches)
    stream = spark.readStream.schema(PARTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = rewrite_stream(stream).writeStream.format("memory").queryName("rewritten").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:  # timers keep a stream going, so there is no end to wait for
        end = time.time() + 90
        while spark.table("rewritten").agg(F.sum(F.length("text"))).first()[0] != sum(len(t) + sum(len(c) for _, c in cited) for t, cited in wanted.values()) and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    got = {}
    for r in spark.table("rewritten").orderBy("message_id", "seq").collect():
        got.setdefault(int(r.message_id), []).append(r)
    for m, (text, cited) in wanted.items():
        assert "".join(r.text for r in got[m] if r.type == "token") == text
        assert [(r.n, r.text) for r in got[m] if r.type == "citation"] == cited
        assert [r.seq for r in got[m]] == list(range(1, len(got[m]) + 1))


def test_work_of_a_row_is_no_method_too_long_for_the_jvm(spark):
    """Methods of more than 8,000 bytes are interpreted, which makes a row some ten times slower."""
    said = io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        with contextlib.redirect_stdout(said):
            queries_workspaces.queries()["question_answers"](spark, "/root/testdata/sf0.001").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue())]
    assert sizes and max(sizes) < 8000


def test_a_text_is_planned_once_and_answers_each_question(spark):
    """Of 4,000 questions with three texts in two workspaces, and of odd ones, each gets its own row, and few rows are planned."""
    fields = spark.createDataFrame([("a", 0, "total", "Total", "currency", "USD", ["total"]), ("a", 1, "segment", "Segment", "string", None, ["segment"]), ("b", 0, "segment", "Segment", "string", None, ["segment"])], shared.FIELD)
    texts = ("What is the total by segment?", "WHAT IS THE TOTAL BY SEGMENT?", "How many are missing a segment?")
    rows = [("ab"[k % 2], k, texts[k % 3], k % 5) for k in range(4000)] + [("a", 4000, None, None), (None, 4001, texts[0], 1), ("c", 4002, texts[0], 1)]
    asked = spark.createDataFrame(rows, "workspace_id string, question_id long, question string, passages int")
    got = ask.plan_questions(asked, fields).collect()
    assert sorted(r.question_id for r in got) == list(range(4003))
    of = {r.question_id: r for r in got}
    for w, k, text, passages in rows:
        (alone,) = ask.plan_questions(spark.createDataFrame([(w, 0, text, passages)], asked.schema), fields).collect() if k < 30 and k % 7 == 0 or k >= 4000 else [of[k % 30]]
        assert (of[k].answerable, of[k].aggregate, of[k].title, of[k].filters) == (alone.answerable, alone.aggregate, alone.title, alone.filters)
    planned = ask.plan_questions(asked, fields)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[workspace_id#\d+, text#\d+, answerable#\d+\]", planned)
