"""Schema versions, results by path, the vector store and the event log."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tabulon.functions import results
from tabulon.operators import vector_cache, versions
from tabulon.plans import shared
from tabulon.streaming import log

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_versions_are_folded_and_checked(spark):
    fields = spark.createDataFrame([("w", 0, "a", "A", "string", None, ["a"]), ("w", 1, "b", "B", "string", None, ["b", "b2"]), ("w", 2, "n", "N", "number", None, ["n"]), ("v", 0, "a", "A", "currency", "USD", ["a"])], shared.FIELD)
    steps = [("rename", 1, "a", "c", None), ("rename", 1, "a", "d", None), ("rename", 2, "c", "a", "Again"), ("merge", 3, "b", "a", None), ("merge", None, "n", "a", None), ("rename", None, "n", "select", None), ("rename", None, "n", "a", None), ("remove", None, "n", None, None), ("remove", None, "a", None, None), ("melt", None, "a", "a", None)]
    changes = spark.createDataFrame([("w", i, a, e, f, t, label, "user") for i, (a, e, f, t, label) in enumerate(steps)] + [("nobody", 0, "remove", None, "a", None, None, "user")], versions.CHANGE)
    out = versions.versions(fields, changes)
    rows = sorted((r for r in out.collect() if r.workspace_id == "w"), key=lambda r: -1 if r.place is None else r.place)
    assert [r.version for r in rows] == [1, 2, None, 3, 4, None, None, None, 5, None, None]
    assert [r.parent for r in rows if r.version] == [None, 1, 2, 3, 4]
    assert all((r.refused is None) == (r.version is not None) for r in rows)
    assert rows[3].summary == "You renamed 'A' to 'Again'."
    at = lambda v: {r.key: (r.label, r.names) for r in versions.fields_at(out, v).where("workspace_id = 'w'").collect()}
    assert at(1)["a"] == ("A", ["a"]) and at(2)["c"] == ("A", ["c", "a"]) and at(3)["a"] == ("Again", ["a", "c"])
    assert at(4) == {"a": ("Again", ["a", "c", "b", "b2"]), "n": ("N", ["n"])} and at(None).keys() == {"a"} and at(99) == at(None)
    assert [r.currency_default for r in versions.fields_at(out).where("workspace_id = 'v'").collect()] == ["USD"]
    assert out.where("workspace_id = 'nobody'").count() == 0


def test_results_by_path(spark):
    rows = [("w", "q", 0, None, 1234.5, 7, ["USD"]), ("w", "q", 1, "a.b/c", 1234.0, 5, ["USD"]), ("w", "q", 2, "it's", 0.5, 2, ["USD"]), ("w", "empty", 0, None, None, 0, [])]
    found = results.result_json(spark.createDataFrame(rows, "workspace_id string, query_id string, place int, label string, value double, record_count long, currencies array<string>"))
    text = {r.query_id: r.result for r in found.collect()}
    assert json.loads(text["q"]) == {"total": 1234.5, "record_count": 7, "currencies": ["USD"], "rows": [{"label": "a.b/c", "value": 1234.0}, {"label": "it's", "value": 0.5}]}
    one = found.where("query_id = 'q'")
    ask = lambda pointer, kind="string": one.select(results.at_pointer(F.col("result"), pointer, kind)).first()[0]
    assert ask("/rows/1/label") == "it's" and ask("/rows/0/value", "double") == 1234.0 and ask("/rows/9/value") is None and ask("/rows/0/label", "int") is None
    odd = spark.createDataFrame([('{"a/b": {"c~d": [10, {"e\'f": 1}]}}',), ("not json",)], "j string")
    assert [r[0] for r in odd.select(results.at_pointer(F.col("j"), "/a~1b/c~0d/1/e'f", "int")).collect()] == [1, None]
    paths = found.select("query_id", results.result_paths(F.col("result"), F.lit(True), F.lit(None).cast("string")).alias("p"))
    got = {r.query_id: {k: tuple(v) for k, v in r.p.items()} for r in paths.collect()}
    assert got["q"] == {"result.total": ("1,234.50 USD", "USD"), "result.record_count": ("7", None), "result.unit": ("USD", None), "result.rows.0.value": ("1,234 USD", "USD"), "result.rows.0.label": ("a.b/c", None), "result.rows.1.value": ("0.50 USD", "USD"), "result.rows.1.label": ("it's", None)}
    assert got["empty"] == {"result.record_count": ("0", None)}
    plain = found.where("query_id = 'q'").select(F.inline(results.figures(results.result_paths(F.col("result"), F.lit(False), F.lit("EUR"))))).collect()
    assert {(r.path, r.text, r.unit) for r in plain} >= {("result.total", "1,234.50", None), ("result.unit", "EUR", None)}


def test_vectors_are_embedded_once(spark, tmp_path):
    asked = []

    def embed(df):
        asked.append(df.count())
        return df.withColumn("embedding", F.when(F.col("text") != "none", F.array(F.length("text").cast("double"))))

    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    run = lambda space, *t: {r.text: r.embedding for r in vector_cache.vectors_for(texts(*t), str(tmp_path / "store"), space, embed).collect()}
    assert run("s", "one", "three", "one", "", None, "none") == {"one": [3.0], "three": [5.0], "none": None}
    assert run("s", "one", "none", "three") == {"one": [3.0], "three": [5.0], "none": None} and asked == [3]
    assert run("other", "one") == {"one": [3.0]} and asked == [3, 1]
    assert run("s", "one", "seven") == {"one": [3.0], "seven": [5.0]} and asked == [3, 1, 1]
    many = [f"t{i}" for i in range(300)]
    short = lambda df: embed(df).where("text <> 't7'")
    got = {r.text: r.embedding for r in vector_cache.vectors_for(texts(*many), str(tmp_path / "short"), "s", short).collect()}
    lost = [t for t in many if got[t] is None]
    assert "t7" in lost and 1 < len(lost) < 200


def test_log_replays_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    source, out = tmp_path / "in", str(tmp_path / "log")
    write = lambda ids: spark.createDataFrame([(w, i, "t", f"{w}{i}") for i in ids for w in ("a", "b")], "workspace_id string, event_id long, type string, payload string").coalesce(1).write.mode("append").parquet(str(source))
    write(range(5))
    schema = "workspace_id string, event_id long, type string, payload string"
    start = lambda: log.append_log(spark.readStream.schema(schema).parquet(str(source)), out, str(tmp_path / "cp")).awaitTermination(90)
    assert start()
    write(range(5, 9))
    assert start() and start()
    rows = log.replay(spark, out, "a", 3, most=4)
    assert [(r.seq, r.event_id) for r in rows.collect()] == [(4, 3), (5, 4), (6, 5), (7, 6)]
    assert [r.seq for r in log.replay(spark, out, "a", 7).collect()] == [8, 9] and log.replay(spark, out, "c", 0).count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(seq,3)" in plan and "PartitionFilters: [isnotnull(workspace_id" in plan
    q = log.follow(spark, out, 1).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted((r.workspace_id, r.seq) for r in spark.table("followed").collect()) == [(w, i) for w in ("a", "b") for i in range(1, 10)]


@pytest.mark.parametrize("text", ["", None, "{}"])
def test_pointers_into_nothing(spark, text):
    df = spark.createDataFrame([(text,)], "j string")
    assert df.select(results.at_pointer(F.col("j"), "/rows/0/value", "double")).first()[0] is None
