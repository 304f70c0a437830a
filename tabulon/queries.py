"""The driver's queries and their SQL. The tall table is melted from orders and customers by rules that both engines share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_workspaces
from .functions import values as V
from .functions.labels import STOP_WORDS, fold_label, label_similarity, lexical_tokens
from .model import FieldSpec
from .operators import drift, extract, ground, guided, layout, profile, resolve, retrieve, trust, views
from .plans.planner import lineage, plan
from .spec import DataQuery
from .sources import blobs, files, scratch, sinks
from .streaming import answers
from .streaming import events as ev

FIELDS = (
    FieldSpec("total", "Total", "currency", currency_default="USD"),
    FieldSpec("segment", "Segment", "string"),
    FieldSpec("ordered", "Order date", "date"),
    FieldSpec("priority", "Priority", "string", aliases=("prio",)),
    FieldSpec("urgent", "Urgent", "boolean"),
)
#: Small PDF files that a task reads.
FILES = 20_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _v(**slots: F.Column) -> F.Column:
    kinds = {"s": "string", "n": "double", "ccy": "string", "d": "date", "b": "boolean", "l": "array<string>"}
    return F.struct(*[slots.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def _cell(key: F.Column, kind: str, v: F.Column) -> F.Column:
    return F.struct(key.alias("field_key"), F.lit(kind).alias("value_type"), v.alias("v"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.lit("w").alias("workspace_id"), F.col("o_orderkey").cast("string").alias("record_id"))


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd orders are in EUR; every seventh has no segment; every third writes its priority under an alias; every fifth was seen by a person."""
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("o_orderkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        k.cast("string").alias("record_id"), k.alias("k"),
        F.array(
            _cell(F.lit("total"), "currency", _v(n=F.col("o_totalprice"), ccy=F.when(k % 2 == 0, "USD").otherwise("EUR"))),
            _cell(F.lit("segment"), "string", _v(s=F.when(k % 7 != 0, F.col("c_mktsegment")))),
            _cell(F.lit("ordered"), "date", _v(d=F.to_date("o_orderdate"), s=F.date_format("o_orderdate", "yyyy-MM-dd"))),
            _cell(F.when(k % 3 == 0, "prio").otherwise("priority"), "string", _v(s=F.col("o_orderpriority"))),
            _cell(F.lit("urgent"), "boolean", _v(b=F.col("o_orderpriority").startswith("1"))),
        ).alias("f"),
    )
    return rows.select("record_id", "k", F.inline("f")).select("record_id", "field_key", "value_type", "v", (F.col("k") % 100 / 100).alias("confidence"), F.lit("medium").alias("tier"), F.when(F.col("k") % 5 == 0, "human_verified").otherwise("model").alias("status"))


_MELT = """
with m as (select cast(o_orderkey as varchar) as record_id, o_orderkey as k, o_totalprice as total, case when o_orderkey % 2 = 0 then 'USD' else 'EUR' end as ccy,
  case when o_orderkey % 7 <> 0 then c_mktsegment end as segment, cast(o_orderdate as date) as ordered, o_orderpriority as priority, starts_with(o_orderpriority, '1') as urgent
  from orders left join customer on o_custkey = c_custkey) """


def _query(spark: SparkSession, sf_dir: str, *, summary: bool = False, **spec) -> DataFrame:
    rows, total = plan(DataQuery.of(spec), records(spark, sf_dir), field_values(spark, sf_dir), FIELDS)
    return total.withColumn("currencies", F.array_join("currencies", ",")) if summary else rows


_SUM = "cast(sum(cast(total as decimal(38, 6))) as double)"
_GROUP = "coalesce(segment, 'Not stated')"


def _dq(spec: dict, sql: str) -> tuple[Callable, str]:
    return partial(_query, **spec), _MELT + sql


_BY = {"group_by": "segment"}
_SPECS: dict[str, tuple[Callable, str]] = {
    "dq_sum_by_group": _dq({"aggregate": "sum", "measure_field": "total", **_BY}, f"select {_GROUP} as label, {_SUM} as value from m group by 1"),
    "dq_avg_by_group": _dq({"aggregate": "avg", "measure_field": "total", **_BY, "sort": "value_asc"}, f"select {_GROUP} as label, {_SUM} / count(*) as value from m group by 1"),
    "dq_min_by_group": _dq({"aggregate": "min", "measure_field": "total", **_BY, "sort": "label_asc"}, f"select {_GROUP} as label, min(total) as value from m group by 1"),
    "dq_max_by_group": _dq({"aggregate": "max", "measure_field": "total", **_BY}, f"select {_GROUP} as label, max(total) as value from m group by 1"),
    "dq_count_records": _dq({}, "select 'Total' as label, cast(count(*) as double) as value from m"),
    "dq_count_field": _dq({"measure_field": "segment", "group_by": "priority"}, "select priority as label, cast(count(*) as double) as value from m group by 1"),
    "dq_sum_alone": _dq({"aggregate": "sum", "measure_field": "total"}, f"select 'Total' as label, {_SUM} as value from m"),
    "dq_unknown_fields": _dq({"aggregate": "sum", "measure_field": "total", "group_by": "no_such", "filters": [{"field": "nor_this", "op": "missing"}, {"field": "segment", "op": "missing"}]}, f"select 'Total' as label, {_SUM} as value from m where segment is null"),
    "dq_unknown_filter": _dq({"filters": [{"field": "nor_this", "op": "ne", "value": "x"}], **_BY}, "select segment as label, 0.0 as value from m where false"),
    "dq_text_on_number": _dq({**_BY, "filters": [{"field": "ordered", "op": "present"}, {"field": "segment", "op": "gt", "value": "c"}]}, "select segment as label, cast(count(*) as double) as value from m where lower(segment) > 'c' group by 1"),
    "dq_bucket_month": _dq({"aggregate": "sum", "measure_field": "total", "group_by": "ordered", "date_bucket": "month", "limit": 50}, f"select strftime(ordered, '%Y-%m') as label, {_SUM} as value from m group by 1 order by 1 limit 50"),
    "dq_bucket_quarter": _dq({"aggregate": "sum", "measure_field": "total", "group_by": "ordered", "date_bucket": "quarter", "limit": 50}, f"select strftime(ordered, '%Y') || '-Q' || quarter(ordered) as label, {_SUM} as value from m group by 1 order by 1 limit 50"),
    "dq_bucket_year": _dq({"aggregate": "sum", "measure_field": "total", "group_by": "ordered", "date_bucket": "year"}, f"select strftime(ordered, '%Y') as label, {_SUM} as value from m group by 1 order by 1 limit 20"),
    "dq_filter_numeric": _dq({"aggregate": "sum", "measure_field": "total", **_BY, "filters": [{"field": "total", "op": "gte", "value": "100,000"}, {"field": "total", "op": "lt", "value": 300000}]}, f"select {_GROUP} as label, {_SUM} as value from m where total >= 100000 and total < 300000 group by 1"),
    "dq_filter_text": _dq({**_BY, "filters": [{"field": "priority", "op": "contains", "value": "URG"}, {"field": "segment", "op": "ne", "value": "building"}]}, "select segment as label, cast(count(*) as double) as value from m where contains(lower(priority), 'urg') and lower(segment) <> 'building' group by 1"),
    "dq_filter_date": _dq({"group_by": "priority", "filters": [{"field": "ordered", "op": "gte", "value": "1995-06-01"}, {"field": "ordered", "op": "lt", "value": "1997-01-01"}]}, "select priority as label, cast(count(*) as double) as value from m where ordered >= date '1995-06-01' and ordered < date '1997-01-01' group by 1"),
    "dq_filter_presence": _dq({"group_by": "priority", "filters": [{"field": "segment", "op": "missing"}, {"field": "total", "op": "present"}]}, "select priority as label, cast(count(*) as double) as value from m where segment is null and total is not null group by 1"),
    "dq_filter_boolean": _dq({**_BY, "filters": [{"field": "urgent", "op": "eq", "value": True}]}, f"select {_GROUP} as label, cast(count(*) as double) as value from m where urgent group by 1"),
    "dq_sum_boolean": _dq({"aggregate": "sum", "measure_field": "urgent", **_BY}, f"select {_GROUP} as label, cast(sum(urgent::int) as double) as value from m group by 1"),
    "dq_total_and_currencies": _dq({"summary": True, "aggregate": "sum", "measure_field": "total", **_BY}, f"select {_SUM} as total, case when count(distinct ccy) = 1 then min(ccy) end as unit, string_agg(distinct ccy, ',' order by ccy) as currencies, count(distinct ccy) > 1 as mixed_currency, count(*) as record_count from m"),
}


def dq_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage(DataQuery.of({"aggregate": "sum", "measure_field": "total", **_BY}), records(spark, sf_dir), field_values(spark, sf_dir), FIELDS)


def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of all documents, with notices of an order's priority and comment put in front of every third."""
    d = _table(spark, sf_dir, "documents")
    heads = {0: "TAX INVOICE invoice", 1: "Purchase order", 2: "statement of account, opening balance", 3: "receipt receipt"}
    head = F.element_at(F.create_map(*[F.lit(x) for kv in heads.items() for x in kv]), (F.col("doc_id") % 7).cast("int"))
    return d.select("doc_id", extract.document_kind(F.concat_ws(" ", head, "text")).alias("kind"))


def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.profile(field_values(spark, sf_dir), records(spark, sf_dir))
    return stats.select("field_key", "present", "distinct", "numeric_min", "numeric_max", "numeric_sum", F.date_format("date_min", "yyyy-MM-dd").alias("date_min"), F.date_format("date_max", "yyyy-MM-dd").alias("date_max"), F.array_join("currencies", ",").alias("currencies"), "coverage", "groupable")


_TALL = _MELT.rstrip() + """, tall as (
  select 'total' as field_key, cast(cast(total as decimal(38, 10)) as varchar) || ccy as label, total as x, null::date as d, ccy from m union all
  select 'segment', segment, null, null, null from m where segment is not null union all
  select 'ordered', strftime(ordered, '%Y-%m-%d'), null, ordered, null from m union all
  select case when k % 3 = 0 then 'prio' else 'priority' end, priority, null, null, null from m union all
  select 'urgent', case when urgent then 'Yes' else 'No' end, urgent::int, null, null from m)
"""
_PROFILE = _TALL + """select field_key, count(*) as present, count(distinct label) as "distinct", min(x) as numeric_min, max(x) as numeric_max, cast(sum(cast(x as decimal(38, 6))) as double) as numeric_sum,
  strftime(min(d), '%Y-%m-%d') as date_min, strftime(max(d), '%Y-%m-%d') as date_max, coalesce(string_agg(distinct ccy, ',' order by ccy), '') as currencies,
  count(*) / (select count(*) from orders) as coverage, count(distinct label) between 2 and 30 as groupable from tall group by 1"""


def field_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_labels(field_values(spark, sf_dir).where("field_key <> 'total'"))


def panel_vet(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.profile(field_values(spark, sf_dir), records(spark, sf_dir))
    reason = profile.vet(F.lit("bar"), F.least("distinct", F.lit(20)), F.col("coverage"), F.col("distinct"), F.col("present"))
    return stats.select("field_key", F.coalesce(reason, F.lit("fine")).alias("reason"))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"), "o_orderkey")
    return trust.keyset_page(o, "at", "o_orderkey", (820454400, 0), 25)


def record_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of the orders by time, the second after the first one's cursor."""
    o = _table(spark, sf_dir, "orders").select(F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"), "o_orderkey")
    first = trust.page(o, "at", "o_orderkey", None, 40)
    kept = first.where("next_cursor is not null").select("next_cursor").first()  # one row
    return first.unionByName(trust.page(o, "at", "o_orderkey", kept[0] if kept else None, 60))


def _stored(spark: SparkSession, name: str) -> str:
    return f"{scratch.shared_root(spark)}/tabulon/{name}-{uuid.uuid4().hex}"


def blob_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as objects: stored, some put again, some folders deleted; a range of each of those left, with its SHA-256."""
    d = _table(spark, sf_dir, "documents").where("text is not null")
    key = F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"))
    path = _stored(spark, "blobs")
    blobs.put(d.select(key.alias("key"), F.col("text").cast("binary").alias("content")), path, block=1000)
    blobs.put(d.where("doc_id % 5 = 0").select(key.alias("key"), F.concat(F.lit("again "), "text").cast("binary").alias("content")), path, block=4096)
    blobs.delete_prefix(spark, path, "s3/")
    asked = d.select(key.alias("key"), (F.col("doc_id") % 90).alias("first"), F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") % 90 + F.col("doc_id") % 3000).alias("last"))
    return blobs.ranges(spark, path, asked).select("key", "first", "last", F.sha2("content", 256).alias("content_sha256"))


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders by document: stored, some documents extracted again, some deleted, the table compacted; what is left."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber", F.col("l_quantity").alias("quantity"))
    path = _stored(spark, "documents")
    sinks.replace_documents(rows, path)
    sinks.replace_documents(rows.where("document_id % 6 = 0 and l_linenumber % 2 = 1").withColumn("quantity", F.col("quantity") + 100), path, rows.where("document_id % 6 = 0").select("document_id"))
    sinks.compact(spark, path)
    sinks.delete_documents(rows.where("document_id % 10 = 1").select("document_id"), path)
    sinks.replace_documents(rows.where("document_id % 30 = 1").limit(0), path, rows.where("document_id % 12 = 0").select("document_id"))
    return sinks.read_documents(spark, path).groupBy("document_id").agg(F.count("*").alias("n_lines"), F.sum("quantity").alias("quantity"))


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return trust.latest(e, ["user_id"], "event_id")


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order amounts and dates, written in several ways by rule."""
    k, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    whole, rest = F.floor(cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    plain = F.concat_ws(".", whole.cast("string"), rest)
    commas = F.concat_ws(".", F.format_number(whole, 0), rest)
    number = F.when(k % 4 == 0, plain).when(k % 4 == 1, commas).when(k % 4 == 2, F.concat(F.lit("("), plain, F.lit(")"))).otherwise(F.lit("n/a"))
    money = F.when(k % 4 == 0, F.concat(F.lit("$"), commas)).when(k % 4 == 1, F.concat(plain, F.lit(" eur"))).when(k % 4 == 2, F.concat(F.lit("US$ "), plain)).otherwise(plain)
    day = F.col("o_orderdate")
    date = F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(day, "dd/MM/yyyy")).when(k % 4 == 2, F.date_format(day, "d MMMM yyyy")).otherwise(F.date_format(day, "MM.dd.yyyy"))
    return _table(spark, sf_dir, "orders").select(k.alias("k"), number.alias("number"), money.alias("money"), date.alias("date"))


def coerce_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).withColumn("c", V.coerce(F.col("number"), F.lit("number"))).select("k", F.col("c.v.n").alias("n"), F.col("c.how").alias("how"))


def coerce_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).withColumn("c", V.coerce(F.col("money"), F.lit("currency"), F.when(F.col("k") % 8 == 3, "GBP"))).select("k", F.col("c.v.n").alias("n"), F.col("c.v.ccy").alias("ccy"), F.col("c.how").alias("how"))


def coerce_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).withColumn("c", V.coerce(F.col("date"), F.lit("date"))).select("k", F.col("c.v.s").alias("iso"), F.col("c.how").alias("how"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    text = F.concat_ws("\n", F.concat(F.lit("Order No: "), F.col("o_orderkey")), F.lit(""), F.concat(F.lit("Issue Date: "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.concat(F.lit("Priority – "), F.col("o_orderpriority")), F.lit("Notes: as agreed"), F.concat(F.lit("Order no: "), F.lit("again")))
    return extract.text_lines(o.select("o_orderkey", text.alias("text")), "o_orderkey", "text")


def extract_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_lines(spark, sf_dir)).select("document_id", "key", "value_text", "value_type", "line_no")


def extract_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    text = F.concat_ws("\n", F.lit("Part Name | Brand | Size | Remark"), F.concat_ws(" | ", F.lit(""), F.col("p_brand"), F.lit(""), F.lit("")), F.concat_ws(" | ", "p_name", "p_brand", F.col("p_size").cast("string"), F.lit("")))
    lines = extract.text_lines(p.select("p_partkey", text.alias("text")), "p_partkey", "text")
    return extract.table_fields(lines).select("document_id", "key", "value_text", "value_type", "line_no")


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's second reading of the totals: every tenth differs, every eleventh record is left out."""
    rows = field_values(spark, sf_dir).where("field_key = 'total'").withColumn("k", F.col("record_id").cast("long")).where("k % 11 <> 0")
    v = F.col("v")
    return rows.withColumn("v", F.when(F.col("k") % 10 == 0, _v(n=v["n"] + 1, ccy=v["ccy"])).otherwise(v)).withColumn("tier", F.lit("low")).drop("k")


def upsert_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = field_values(spark, sf_dir).where("field_key = 'total'")
    out = trust.protected_merge(stored, _fresh(spark, sf_dir), F.lit("2024-01-01"))
    return out.select("record_id", F.col("v.n").alias("n"), "tier", "status", F.col("model_value.n").alias("model_n"), "model_value_at")


def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trust.merge_fields(field_values(spark, sf_dir).where("field_key in ('priority', 'prio', 'segment')"), "prio", "priority")
    return out.groupBy("field_key").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("n_records"))


def trust_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = field_values(spark, sf_dir)
    graded = rows.withColumn("tier", trust.tier(F.col("confidence"), F.lit(True), F.lit("normalised"), F.lit(True)))
    score = F.round(F.sum(trust.impact(F.lit(2.0), F.col("confidence"), F.col("tier"), F.col("status")).cast("decimal(20,6)")).cast("double"), 4)
    return graded.groupBy("record_id").agg(score.alias("impact")).join(trust.tally(graded), "record_id")


def label_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([(x,) for x in ("Supplier", "Supplier ID", "Vendor Name", "Invoice No", "Invoice Number", "Total Due", "Due Total", "Issue Date", "Amount")], "label string")
    pairs = labels.crossJoin(labels.withColumnRenamed("label", "other")).where("label < other")  # nine fixed labels
    return pairs.withColumn("similarity", F.round(label_similarity(F.col("label"), F.col("other")), 6)).withColumn("same", fold_label(F.col("label")) == fold_label(F.col("other")))


def propose_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = resolve.observations(extract.extract(_lines(spark, sf_dir)))
    return resolve.propose(seen.withColumn("workspace_id", F.lit("w"))).select("position", "field_key", "field_label", "field_type", F.array_join("aliases", ",").alias("aliases"))


def ground_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 200 words; six words of the opening, of a late place, and of the middle cut inside a word and with one letter changed."""
    words = lambda text: F.filter(F.split(text, r"\s+"), lambda w: w != "")
    docs = _table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), words(F.col("text")).alias("words"))
    sheets = F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(200)), lambda at: F.slice("words", at + 1, 200)))
    pages = docs.select("document_id", sheets.alias("page_index", "words"))

    def said(key: str, at: F.Column, cited: F.Column, edit=lambda q: q) -> F.Column:
        return F.struct(F.lit(key).alias("field_key"), edit(F.array_join(F.slice("words", at + 1, 6), " ")).alias("quote"), cited.cast("int").alias("page_index"))

    n = F.size("words")
    middle, late = F.floor(n / 2).cast("int"), F.floor(n * 9 / 10).cast("int")
    edited = lambda q: F.concat(F.substring(q, 3, 8), F.lit("#"), F.substring(q, 12, 2**31 - 1))
    fields = docs.select("document_id", F.inline(F.array(said("opening", F.lit(0), F.lit(0)), said("late", late, F.lit(0)), said("edited", middle, F.floor(middle / 200) + 1, edited))))
    return ground.ground(fields, pages)


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("page_index"), F.split("text", "\n").alias("lines"))
    return retrieve.chunk_pages(pages).drop("word_start", "word_end")


def cite_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the laid out documents, cited by the boxes of its words."""
    pages = _pages(spark, sf_dir)
    chunks = retrieve.chunk_pages(pages).withColumn("chunk_id", F.concat_ws("-", "document_id", "ordinal"))
    return layout.cite(chunks, pages)


def pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF file of two lines for each order, read back as lines with boxes and numbers of words."""
    text = F.concat(F.lit("BT /F1 10 Tf 40 700 Td (Order "), F.col("o_orderkey").cast("string"), F.lit(") Tj 0 -20 Td (Priority "), F.col("o_orderpriority"), F.lit(") Tj ET"))
    head = "%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj 2 0 obj <</Kids [3 0 R] /MediaBox [0 0 600 800]>> endobj 3 0 obj <</Type /Page /Contents 4 0 R /Resources <</Font <</F1 <</BaseFont /Courier>>>>>>>> endobj 4 0 obj <</Length "
    content = F.concat(F.lit(head), F.length(text).cast("string"), F.lit(">> stream\n"), text, F.lit("\nendstream endobj trailer <</Root 1 0 R>>"))
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    # a file's letters are much more work than its row says, so rows are dealt out before the files are made
    o = o.repartition(max(spark.sparkContext.defaultParallelism, -(-o.count() // FILES)), "o_orderkey")
    found = o.select(F.lit("o.pdf").alias("filename"), F.col("o_orderkey").cast("string").alias("content_hash"), content.cast("binary").alias("content"))
    pages = files.pdf_pages(found)
    lines = pages.select("document_id", "page_index", F.size("words").alias("n_words"), F.posexplode("lines").alias("line_no", "l"))
    return lines.select("document_id", "page_index", "n_words", "line_no", "l.text", *[F.round(f"l.{c}", 3).alias(c) for c in layout.BOX])


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieve.nearest(e, queries, 5).select("query_id", "vec_id", "place", F.round("score", 5).alias("score"))


def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document and benchmark item the number of shared words, where there are at least ten; joined on words."""
    words = lambda df, key: df.select(key, F.explode(F.array_distinct(lexical_tokens(F.col("text")))).alias("w"))
    d, b = words(_table(spark, sf_dir, "documents"), "doc_id"), words(_table(spark, sf_dir, "benchmark"), "item_id")
    return d.join(b, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")).where("shared >= 10")


def search_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_documents(spark, sf_dir).withColumn("chunk_id", F.concat_ws("-", F.col("document_id"), F.col("ordinal"))).withColumn("is_digest", F.lit(False))
    q = _table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("question_id"), "text")
    return retrieve.search(retrieve.embed(c), retrieve.embed(q))


def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.with_sequence(_table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"])


def event_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_sequence(spark, sf_dir)
    return ev.resume(log, "user_id", log.groupBy("user_id").agg(F.floor(F.max("seq") / 2).alias("after")))


def event_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ev.with_sequence(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"])
    return ev.latest_by(log, "user_id")


def batch_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").withColumn("status", F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1), "parsing").otherwise("done"))
    return ev.idle_groups(c, "conv_id")


def token_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as an answer, cut every nine letters, each with one of three chunks, of which those whose sum with conv_id is divisible by four are unknown, and two figures."""
    c = _table(spark, sf_dir, "conversations")
    chunk = lambda conv, k: F.concat(F.lpad(conv.cast("string"), 8, "0"), F.lit("-0000-0000-0000-"), F.lpad(k.cast("string"), 12, "0"))
    marked = F.concat(F.coalesce("text", F.lit("")), F.lit(" [^chunk:"), chunk(F.col("conv_id"), F.col("turn") % 3), F.lit("] of {{result.total}} usd [^note] {{ none }}[^chunk:x]."))
    whole = c.select(F.col("conv_id").alias("message_id"), "turn", marked.alias("text"))
    at = F.posexplode(F.sequence(F.lit(1), F.length("text"), F.lit(9))).alias("k", "from")
    deltas = whole.select("message_id", "turn", "text", at).select("message_id", (F.col("turn") * 1_000_000 + F.col("k")).alias("position"), F.substring("text", F.col("from"), F.lit(9)).alias("text"))
    messages = c.select(F.col("conv_id").alias("message_id")).distinct()
    known = messages.select("message_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).where((F.col("message_id") + F.col("k")) % 4 != 0)
    figures = messages.select("message_id", F.lit("result.total").alias("path"), F.concat(F.col("message_id").cast("string"), F.lit(".50 USD")).alias("text"), F.lit("USD").alias("unit"))
    out = ev.rewrite_answers(deltas, known.select("message_id", chunk(F.col("message_id"), F.col("k")).alias("chunk_id")), figures)
    return out.select("message_id", F.sha2("text", 256).alias("text_sha"), F.length("text").alias("length"), F.array_join("cited", ",").alias("cited"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes on their order's page."""
    x, top = F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", x.alias("x0"), top.alias("top"), (x + 1).alias("x1"), (top + 3).alias("bottom"))


def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.visual_lines(_boxes(spark, sf_dir), ["l_orderkey"])


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as recognised words: their discount gives the confidence, their supplier's parity the block."""
    x, top = F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double")
    words = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.lit(0).alias("page_index"), (F.col("l_suppkey") % 2).alias("block"), F.lit(1).alias("par"), F.lit(1).alias("line"),
        F.col("l_returnflag").alias("text"), F.round(F.col("l_discount") * 1000).alias("conf"), x.alias("x0"), top.alias("top"), (x + 1).alias("x1"), (top + 3).alias("bottom"),
    )
    return layout.ocr_lines(words)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout_pages(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"))


def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("document_id", "page_index", F.size("words").alias("n_words"), F.size("lines").alias("n_lines"))


def line_word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_word_spans(_pages(spark, sf_dir))


def cite_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every page as a cited passage."""
    pages = _pages(spark, sf_dir)
    lines = layout.line_word_spans(pages).withColumn("chunk_id", F.concat_ws("-", "document_id", "page_index", "line_no"))
    return layout.cite(lines, pages)


def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = field_values(spark, sf_dir).where("field_key = 'total'")
    return trust.merge_counts(stored, _fresh(spark, sf_dir).withColumn("grounded", F.col("record_id").cast("long") % 4 != 0))


_GUIDE = (FieldSpec("order_number", "Order Number", "number"), FieldSpec("issued", "Date of signature", "date"), FieldSpec("urgency", "Urgency", "string", aliases=("priority",)))


def guided_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema that orders fit in part: by likeness, not at all, by alias; every ninth order has no text."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    found = extract.extract(_lines(spark, sf_dir)).where("document_id % 9 <> 0")
    return guided.guided(o, found, _GUIDE).select("document_id", "field_key", "value_text", "value_type", "extra")


def _extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of each order beyond its schema, by its key: unlike ones, an alias, near ones of the same and of another type, a known one, and one that can't be a key."""
    rows = ((1, "order_no", "Order No", "number"), (2, "issue_date", "Issue date", "date"), (3, "prio", "prio", "string"), (5, "totals", "Totals", "currency"), (7, "segment", "Segment", "number"), (11, "select", "Select", "string"), (13, "urgents", "Urgents", "string"))
    one = lambda n, key, label, kind: F.when(F.col("o_orderkey") % n == 0, F.struct(F.lit(n).alias("line_no"), F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit(kind).alias("type")))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(0).alias("page_index"), F.inline(F.array_compact(F.array(*[one(*r) for r in rows]))))


def drift_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.assess(_extras(spark, sf_dir), FIELDS, most=1).select("document_id", "key", "verdict", "target", "why", "nearest", F.round("score", 6).alias("score"))


def drift_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.summaries(drift.assess(_extras(spark, sf_dir), FIELDS))


def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two turns of each conversation; every eleventh failed."""
    c = _table(spark, sf_dir, "conversations")
    status = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "failed").otherwise("done")
    m = c.select(F.col("conv_id").alias("workspace_id"), F.floor(F.col("turn") / 2).alias("created_at"), F.col("turn").alias("id"), "role", F.col("text").alias("content"), status.alias("status"))
    return answers.recent_turns(m, 2).select("workspace_id", "id", "role", "content", F.col("place").cast("long").alias("place"))


def answer_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as answers: each turn is a token and a citation, every third is delivered twice, and even ones end."""
    c = _table(spark, sf_dir, "conversations")
    event = lambda at, kind, text, n=None: F.struct((F.col("turn") * 3 + at).alias("seq"), F.lit(kind).alias("type"), text.alias("text"), F.lit(None).cast("long").alias("n") if n is None else n.alias("n"))
    end = F.col("conv_id") % 2 == 0
    three = F.array(event(0, "token", F.col("text")), event(1, "citation", F.col("role"), F.col("turn") % 3), F.struct((F.col("turn") * 3 + 2).alias("seq"), F.when(end, "done").otherwise("status").alias("type"), F.col("role").alias("text"), F.lit(None).cast("long").alias("n")))
    log = c.select(F.col("conv_id").alias("message_id"), "turn", F.inline(three))
    out = answers.fold_answers(log.unionByName(log.where("turn % 3 = 0")).drop("turn"))
    return out.select("message_id", F.sha2("text", 256).alias("text_sha"), "stage", F.array_join(F.transform("citations", lambda x: F.concat_ws(":", x["n"].cast("string"), x["text"])), ",").alias("cited"))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as its pages; every fifth is blank, every second recognised; 600 characters."""
    c = _table(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_index"), F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, F.col("text")).alias("text"), F.when(F.col("turn") % 3 == 1, "Sheet").alias("locator"), (F.col("turn") % 2 == 1).alias("ocr_applied"))
    return views.page_blocks(pages, 600).select("document_id", F.sha2("prompt", 256).alias("prompt_sha"), F.col("pages").cast("long").alias("pages"))


def record_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one workspace with their values; those of the other, and orders of unknown customers, are left out."""
    o = _table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise("w").alias("workspace_id"), F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_custkey").alias("document_id"))
    names = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename"))
    rows = views.with_document(views.record_values(views.in_workspace(o, "w"), field_values(spark, sf_dir)), names)
    return rows.select("record_id", "filename", F.col("shown")["segment"].alias("segment"), F.col("shown")["ordered"].alias("ordered"), F.size("shown").cast("long").alias("n"))


def vector_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.col("source").alias("workspace_id"), F.when(F.col("doc_id") % 6 != 0, F.col("lang")).alias("embedding_model"))
    return views.vector_space(d)


_FUNCTIONS = (merge_counts, guided_fields, drift_assess, drift_summaries, recent_turns, answer_fold, page_blocks, record_values, vector_space, visual_lines, ocr_lines, page_layout, line_word_spans, cite_lines, dq_lineage, document_kinds, field_profile, field_topk, panel_vet, keyset_page, record_pages, blob_ranges, stored_documents, latest_version, content_dedup, coerce_number, coerce_currency, coerce_date, extract_labelled, extract_table, upsert_protected, merge_fields, trust_tally, label_similarity_pairs, propose_schema, ground_quotes, chunk_documents, cite_passages, pdf_lines, vector_topk, lexical_overlap, search_passages, event_sequence, event_resume, event_latest, batch_barrier, token_rewrite)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _SPECS.items()} | {f.__name__: f for f in _FUNCTIONS} | queries_workspaces.queries()


_KINDS = {"purchase order": ["purchase order"], "bank statement": ["bank statement", "statement of account", "opening balance"], "credit note": ["credit note"], "invoice": ["tax invoice", "invoice"], "receipt": ["receipt"], "quotation": ["quotation"]}
_COUNTED = [" + ".join(f"(length({t}) - length(replace({t}, '{m}', ''))) / {len(m)} * {w}" for m in ms for t, w in (("t", 1), ("left(t, 200)", 10))) for ms in _KINDS.values()]
_KINDS_SQL = f"""with d as (select doc_id, lower(concat_ws(' ', case doc_id % 7 when 0 then 'TAX INVOICE invoice' when 1 then 'Purchase order' when 2 then 'statement of account, opening balance' when 3 then 'receipt receipt' end, text)) as t from documents),
n as (select doc_id, [{", ".join(f"cast({c} as int)" for c in _COUNTED)}] as s from d)
select doc_id, case when list_max(s) = 0 then 'document' else [{", ".join(f"'{k}'" for k in _KINDS)}][list_position(s, list_max(s))] end as kind from n"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_RANKED = "row_number() over (partition by field_key order by n desc, label) as place"
_WORDS = "len(regexp_extract_all({t}, '[^\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\p{{Z}}]+'))"
_CHUNKS = f"""with recursive
d as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: {_WORDS.format(t="x")} > 0) as lines from documents where text is not null),
p as (select doc_id, lines, len(lines) as n, list_transform(range(0, len(lines) + 1), lambda e: coalesce(list_sum(list_transform(lines[1:e], lambda x: {_WORDS.format(t="x")})), 0)::int) as total from d where len(lines) > 0),
step as (
  select doc_id, n, total, 0 as k, 0 as first, 0 as fresh, least(n, greatest(1, least(len(list_filter(total, lambda x: x < 110)), len(list_filter(total, lambda x: x <= 160)) - 1))) as stop from p
  union all
  select doc_id, n, total, k + 1, stop - 1, stop, least(n, greatest(stop + 1, least(len(list_filter(total, lambda x: x < total[stop] + 110)), len(list_filter(total, lambda x: x <= total[stop] + 160)) - 1))) from step where stop < n),
t as (select s.doc_id, k, first, stop, stop = s.n and s.total[stop + 1] - s.total[first + 1] < 110 as tail, regexp_replace(array_to_string(lines[first + 1:stop], chr(10)), '^\\s+|\\s+$', '', 'g') as text from step s join p using (doc_id)),
u as (select *, lag(text) over (partition by doc_id order by k) as before from t),
v as (select *, {_WORDS.format(t="text")} < 25 and k > 0 as runt from u where not (tail and coalesce(contains(before, text), false))),
w as (select *, sum((not runt)::int) over (partition by doc_id order by k)::int - 1 as ordinal from v)
select doc_id as document_id, 0 as page_index, ordinal, string_agg(text, chr(10) order by k) as text, min(first)::int as line_start, max(stop)::int as line_end, {_WORDS.format(t="string_agg(text, chr(10) order by k)")}::int as words from w group by doc_id, ordinal"""
_SQL = {
    "merge_counts": "select count(*) filter (k % 5 <> 0) as written, count(*) filter (k % 5 = 0) as protected, count(*) filter (k % 10 = 0) as conflicts, count(*) filter (k % 4 <> 0) as grounded, count(*) filter (k % 4 = 0) as ungrounded from (select o_orderkey as k from orders where o_orderkey % 11 <> 0)",
    "guided_fields": "with o as (select o_orderkey as document_id, o_orderkey % 9 <> 0 as has, cast(o_orderkey as varchar) as no, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderpriority as p from orders) select document_id, 'order_number' as field_key, case when has then no end as value_text, 'number' as value_type, false as extra from o union all select document_id, 'issued', null, 'date', false from o union all select document_id, 'urgency', case when has then p end, 'string', false from o union all select document_id, 'issue_date', day, 'date', true from o where has",
    "drift_assess": "select o_orderkey as document_id, v.* exclude (n) from orders join (values (1, 'order_no', 'add', 'order_no', 'borderline', 'ordered', round(10 / 12, 6)), (2, 'issue_date', 'drop', null, 'too_many', 'ordered', 0.6), (3, 'prio', 'map', 'priority', null, 'priority', 1.0), (5, 'totals', 'map', 'total', null, 'total', round(10 / 11, 6)), (7, 'segment', 'map', 'segment', null, 'segment', 1.0), (11, 'select', 'drop', null, 'unusable_key', null, 0.0), (13, 'urgents', 'drop', null, 'too_many', 'urgent', round(12 / 13, 6))) v(n, key, verdict, target, why, nearest, score) on o_orderkey % n = 0",
    "drift_summaries": "with s as (select o_orderkey as k, concat_ws(', ', case when o_orderkey % 3 = 0 then 'prio to priority' end, case when o_orderkey % 5 = 0 then 'totals to total' end) as m, concat_ws(', ', case when o_orderkey % 2 = 0 then 'issue_date from ordered' end, 'order_no from ordered', case when o_orderkey % 13 = 0 then 'urgents from urgent' end) as a from orders) select k as document_id, case when m <> '' then 'Mapped ' || m || '; kept apart ' else 'Kept apart ' end || a || case when k % 11 = 0 then '; left out select' else '' end || '.' as summary from s",
    "recent_turns": "with r as (select *, row_number() over (partition by conv_id order by turn // 2 desc, turn desc) as r from conversations where (conv_id + turn) % 11 <> 0) select conv_id as workspace_id, turn as id, role, text as content, row_number() over (partition by conv_id order by r desc) as place from r where r <= 4 and text <> ''",
    "answer_fold": "with n as (select conv_id, turn % 3 as n, min(turn) as place, arg_max(role, turn) as role from conversations group by 1, 2), c as (select conv_id, string_agg(n || ':' || role, ',' order by place) as cited from n group by 1) select conv_id as message_id, sha256(coalesce(string_agg(text, '' order by turn), '')) as text_sha, case when conv_id % 2 = 0 then 'done' else arg_max(role, turn) end as stage, any_value(cited) as cited from conversations join c using (conv_id) group by 1",
    "page_blocks": "with b as (select conv_id, turn, '=== PAGE ' || turn || case when turn % 3 = 1 then ' (Sheet)' else '' end || case when turn % 2 = 1 then ' [text recognised from a scan]' else '' end || ' ===' || chr(10) || case when (conv_id + turn) % 5 = 0 or trim(coalesce(text, ''), ' ' || chr(10)) = '' then '[no readable text on this page]' else trim(text, ' ' || chr(10)) end as block from conversations), u as (select *, sum(length(block)) over w <= 600 or row_number() over w = 1 as fits from b window w as (partition by conv_id order by turn)) select conv_id as document_id, sha256(string_agg(block, chr(10) || chr(10) order by turn) filter (fits) || case when bool_and(fits) then '' else chr(10) || chr(10) || '[Later pages of this document are not shown.]' end) as prompt_sha, count(*) filter (fits) as pages from u group by 1",
    "record_values": "select cast(o_orderkey as varchar) as record_id, c_name as filename, case when o_orderkey % 7 <> 0 then c_mktsegment else 'Not stated' end as segment, strftime(o_orderdate, '%Y-%m-%d') as ordered, 5::bigint as n from orders join customer on o_custkey = c_custkey where o_orderkey % 4 <> 0",
    "vector_space": "select workspace_id, embedding_model from (select source as workspace_id, lang as embedding_model, row_number() over (partition by source order by count(*) desc, lang) as r from documents where doc_id % 6 <> 0 and lang is not null group by 1, 2) where r = 1",
    "visual_lines": "with b as (select l_orderkey, cast(l_linenumber as double) as x0, cast(l_quantity as double) as top from lineitem), c as (select *, coalesce(top - 0.5 >= max(top + 3) over (w rows between unbounded preceding and 1 preceding), false)::int as breaks from b window w as (partition by l_orderkey order by top, x0)), d as (select *, sum(breaks) over (partition by l_orderkey order by top, x0, breaks desc rows unbounded preceding)::int as line from c) select l_orderkey, line, count(*) as n_boxes, min(x0) as x0, min(top) as top, max(x0 + 1) as x1, max(top + 3) as bottom from d group by 1, 2",
    "ocr_lines": "with g as (select l_orderkey as document_id, l_suppkey % 2 as block, string_agg(l_returnflag, ' ' order by l_linenumber, l_returnflag) as text, cast(min(l_linenumber) as double) as x0, cast(min(l_quantity) as double) as top, cast(max(l_linenumber) + 1 as double) as x1, cast(max(l_quantity) + 3 as double) as bottom from lineitem where round(l_discount * 1000) >= 30 group by 1, 2) select document_id, 0 as page_index, (row_number() over (partition by document_id order by top, x0, block) - 1)::int as line_no, text, x0, top, x1, bottom from g",
    "dq_lineage": _MELT + f"select {_GROUP} as label, record_id from m",
    "document_kinds": _KINDS_SQL,
    "field_profile": _PROFILE,
    "field_topk": _TALL + f"select * from (select *, {_RANKED} from (select field_key, label, count(*) as n from tall where field_key <> 'total' group by 1, 2)) where place <= 5",
    "panel_vet": _TALL + """select field_key, case when count(distinct label) < 2 then 'one row is a metric' when count(distinct label) > 30 then 'too many groups' when count(*) >= 5 and count(*) = count(distinct label) then 'an identifier' else 'fine' end as reason from tall group by 1""",
    "keyset_page": "select cast(epoch(o_orderdate) as bigint) as \"at\", o_orderkey from orders where epoch(o_orderdate) > 820454400 or (epoch(o_orderdate) = 820454400 and o_orderkey > 0) order by 1, 2 limit 26",
    "record_pages": "with p as (select cast(epoch(o_orderdate) as bigint) as t, o_orderkey, row_number() over (order by epoch(o_orderdate), o_orderkey) as place, count(*) over () as n from orders) select t as \"at\", o_orderkey, case when place in (40, 100) and n > place then replace(replace(to_base64(encode(t || '|' || o_orderkey)), '+', '-'), '/', '_') end as next_cursor from p where place <= 100",
    "blob_ranges": """with d as (select doc_id, 's' || doc_id % 7 || '/' || doc_id as key, hex(encode(case when doc_id % 5 = 0 then 'again ' else '' end || text)) as h, doc_id % 90 as f, case when doc_id % 11 <> 0 then doc_id % 90 + doc_id % 3000 end as l from documents where text is not null and doc_id % 7 <> 3),
e as (select key, h, length(h) // 2 - 1 as fin, greatest(least(f, length(h) // 2 - 1), 0) as "first", l from d),
r as (select key, h, "first", case when fin < 0 then fin else greatest(least(coalesce(l, fin), fin), "first") end as "last" from e)
select key, "first", "last", sha256(unhex(substr(h, (2 * "first" + 1)::bigint, (2 * ("last" - "first" + 1))::bigint))) as content_sha256 from r""",
    "stored_documents": "select l_orderkey as document_id, count(*) as n_lines, sum(case when l_orderkey % 6 = 0 then l_quantity + 100 else l_quantity end) as quantity from lineitem where l_orderkey % 10 <> 1 and l_orderkey % 12 <> 0 and (l_orderkey % 6 <> 0 or l_linenumber % 2 = 1) group by 1",
    "latest_version": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "content_dedup": "select sha256(text) as content_hash, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by 1",
    "coerce_number": "select o_orderkey as k, case o_orderkey % 4 when 3 then null when 2 then -round(o_totalprice, 2) else round(o_totalprice, 2) end as n, case o_orderkey % 4 when 0 then 'exact' when 3 then 'failed' when 2 then 'normalised' else case when o_totalprice >= 1000 then 'normalised' else 'exact' end end as how from orders",
    "coerce_currency": "select o_orderkey as k, case when o_orderkey % 8 <> 7 then round(o_totalprice, 2) end as n, case o_orderkey % 8 when 3 then 'GBP' when 7 then null else case when o_orderkey % 4 = 1 then 'EUR' else 'USD' end end as ccy, case o_orderkey % 8 when 3 then 'inferred' when 7 then 'failed' else 'normalised' end as how from orders",
    "coerce_date": "select o_orderkey as k, strftime(case when o_orderkey % 4 = 3 and day(o_orderdate) <= 12 then make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) else cast(o_orderdate as date) end, '%Y-%m-%d') as iso, case when o_orderkey % 4 = 0 then 'exact' when o_orderkey % 4 in (1, 3) and day(o_orderdate) <= 12 then 'inferred' else 'normalised' end as how from orders",
    "extract_labelled": "select o_orderkey as document_id, 'order_no' as key, cast(o_orderkey as varchar) as value_text, 'number' as value_type, 1 as line_no from orders union all select o_orderkey, 'issue_date', strftime(o_orderdate, '%Y-%m-%d'), 'date', 3 from orders union all select o_orderkey, 'priority', o_orderpriority, 'string', 4 from orders",
    "extract_table": "select p_partkey as document_id, 'part_name' as key, p_name as value_text, 'string' as value_type, 3 as line_no from part union all select p_partkey, 'brand', p_brand, 'string', 3 from part union all select p_partkey, 'size', cast(p_size as varchar), 'number', 3 from part",
    "upsert_protected": _MELT + "select record_id, case when k % 11 <> 0 and k % 10 = 0 and k % 5 <> 0 then total + 1 else total end as n, case when k % 11 = 0 then 'medium' when k % 5 = 0 and k % 10 = 0 then 'conflict' when k % 5 = 0 then 'verified' else 'low' end as tier, case when k % 5 = 0 then 'human_verified' else 'model' end as status, case when k % 11 <> 0 and k % 10 = 0 then total + 1 end as model_n, case when k % 11 <> 0 and k % 10 = 0 then '2024-01-01' end as model_value_at from m",
    "merge_fields": "select 'priority' as field_key, count(*) as n, count(*) as n_records from orders union all select 'segment', count(*), count(*) from orders",
    "trust_tally": "select cast(o_orderkey as varchar) as record_id, round(5 * case when o_orderkey % 5 = 0 then 0 else (2 * (1 - (o_orderkey % 100) / 100)) * case when o_orderkey % 100 < 60 then 1.5 else 1 end end, 4) as impact, case when o_orderkey % 100 < 60 then 'unverified' when o_orderkey % 100 < 85 then 'review' else 'high' end as trust, 5::bigint as n_values from orders",
    "pdf_lines": "with l as (select o_orderkey, o_orderpriority, unnest([0, 1]) as k from orders), t as (select *, case k when 0 then 'Order ' || o_orderkey else 'Priority ' || o_orderpriority end as text from l) select o_orderkey::varchar as document_id, 0 as page_index, 4 + (o_orderpriority like '% %')::int as n_words, k as line_no, text, 40.0::double as x0, (92 + 20 * k)::double as top, (40 + 6 * length(text))::double as x1, (102 + 20 * k)::double as bottom from t",
    "chunk_documents": _CHUNKS,
    "vector_topk": "select query_id, vec_id, place, round(score, 5) as score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from (select q.vec_id as query_id, e.vec_id, greatest(0, least(1, list_cosine_similarity(e.embedding::double[], q.embedding::double[]))) as score from embeddings e, embeddings q where q.vec_id % 20 = 0)) where place <= 5",
    "lexical_overlap": f"with d as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents), b as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from benchmark) select doc_id, item_id, count(*) as shared from d join b using (w) where w not in ({_STOP}) group by 1, 2 having count(*) >= 10",
    "event_sequence": "select user_id, event_id, row_number() over (partition by user_id order by event_id) as seq from events",
    "event_resume": "select user_id, event_id, seq from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as seq, count(*) over (partition by user_id) as n from events) where seq > n // 2",
    "event_latest": "select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as seq from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "token_rewrite": """with t as (select *, turn % 3 as k, lpad(conv_id::varchar, 8, '0') || '-0000-0000-0000-' || lpad((turn % 3)::varchar, 12, '0') as chunk, (conv_id + turn % 3) % 4 <> 0 as known from conversations),
f as (select conv_id, k, chunk, row_number() over (partition by conv_id order by min(turn)) as n from t where known group by 1, 2, 3),
c as (select conv_id, string_agg(chunk, ',' order by n) as cited from f group by 1),
x as (select t.conv_id, string_agg(coalesce(text, '') || ' ' || case when known then '[^' || n || ']' else '' end || ' of ' || t.conv_id || '.50 USD [^note] .', '' order by turn) as s from t left join f on t.conv_id = f.conv_id and t.k = f.k group by 1)
select x.conv_id as message_id, sha256(s) as text_sha, length(s)::int as length, coalesce(cited, '') as cited from x left join c using (conv_id)""",
    "batch_barrier": "select conv_id, count(*) as documents from conversations group by 1 having count(*) filter (conv_id % 3 = 0 and turn = 1) = 0",
}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _SPECS.items()} | _SQL | queries_workspaces.oracle_sql()
