"""The driver's queries over many workspaces, one per nation, each with a schema of its own; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import results
from .operators import ask, dashboard, profile, versions, views
from .plans.shared import evaluate

#: position, key, label, type, currency, aliases, and the rule by nation for which workspaces have it.
FIELDS = (
    (0, "total", "Invoice total", "currency", "USD", ("amount_due",), "c_nationkey % 5 <> 3"),
    (1, "rank", "Priority number", "number", None, (), "true"),
    (2, "segment", "Market segment", "string", None, (), "true"),
    (3, "customer_name", "Customer name", "string", None, (), "true"),
    (4, "ordered", "Order date", "date", None, (), "c_nationkey % 3 <> 2"),
    (5, "priority", "Priority", "string", None, ("prio",), "true"),
    (6, "urgent", "Urgent", "boolean", None, (), "true"),
)
QUESTIONS = (
    "What is the invoice total by market segment?",
    "How many orders are missing a customer?",
    "What is the average invoice by order date, per month?",
    "Who signed this?",
    "How many documents by priority?",
    "Give me a breakdown of spend.",
    "Highest total without urgent ones",
    "What is the total?",
)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("workspace_id", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("workspace_id", F.col("o_orderkey").cast("string").alias("record_id"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey").distinct()
    row = lambda p, k, label, t, ccy, names, has: F.when(F.expr(has), F.struct(F.lit(p).alias("position"), F.lit(k).alias("key"), F.lit(label).alias("label"), F.lit(t).alias("type"), F.lit(ccy).cast("string").alias("currency_default"), F.array(*[F.lit(n) for n in (k, *names)]).alias("names")))
    return nations.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("workspace_id"), F.explode(F.array_compact(F.array(*[row(*f) for f in FIELDS]))).alias("f")).select("workspace_id", "f.*")


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even nations write all totals in USD, others every second one in EUR; nations 1, 5, ... rarely state a segment; every third order has its priority and total under other keys."""
    k, n = F.col("o_orderkey"), F.col("c_nationkey")
    kinds = {"s": "string", "n": "double", "ccy": "string", "d": "date", "b": "boolean", "l": "array<string>"}
    cell = lambda key, kind, **v: F.struct(key.alias("field_key"), F.lit(kind).alias("value_type"), F.struct(*[v.get(s, F.lit(None)).cast(t).alias(s) for s, t in kinds.items()]).alias("v"))
    cells = [
        F.when(n % 5 != 3, cell(F.when(k % 3 == 0, "amount_due").otherwise("total"), "currency", n=F.col("o_totalprice"), ccy=F.when((n % 2 == 0) | (k % 2 == 0), "USD").otherwise("EUR"))),
        cell(F.lit("rank"), "number", n=F.substring("o_orderpriority", 1, 1)),
        F.when(F.when(n % 4 == 1, k % 5 == 0).otherwise(k % 7 != 0), cell(F.lit("segment"), "string", s=F.col("c_mktsegment"))),
        cell(F.lit("customer_name"), "string", s=F.col("c_name")),
        F.when(n % 3 != 2, cell(F.lit("ordered"), "date", d=F.to_date("o_orderdate"), s=F.date_format("o_orderdate", "yyyy-MM-dd"))),
        cell(F.when(k % 3 == 0, "prio").otherwise("priority"), "string", s=F.col("o_orderpriority")),
        cell(F.lit("urgent"), "boolean", b=F.col("o_orderpriority").startswith("1")),
    ]
    rows = _orders(spark, sf_dir).select("workspace_id", k.cast("string").alias("record_id"), F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return rows.select("workspace_id", "record_id", "c.*")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of each customer, in turn."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.array(*[F.lit(q) for q in QUESTIONS])
    return c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("workspace_id"), F.col("c_custkey").alias("question_id"), F.element_at(text, (F.col("c_custkey") % len(QUESTIONS)).cast("int") + 1).alias("question"), F.when(F.col("c_custkey") % 11 == 0, 0).otherwise(3).alias("passages"))


def workspace_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.by_coverage(profile.schema_profile(field_values(spark, sf_dir), records(spark, sf_dir), fields(spark, sf_dir)))
    return stats.select("workspace_id", "field_key", "position", "present", "distinct", "numeric_sum", F.date_format("date_max", "yyyy-MM-dd").alias("date_max"), F.array_join("currencies", ",").alias("currencies"), "coverage", "groupable")


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, rows, schema = field_values(spark, sf_dir), records(spark, sf_dir), fields(spark, sf_dir)
    stats = profile.schema_profile(values, rows, schema)
    return dashboard.dashboards(dashboard.propose_panels(stats), stats, rows, values, schema)


def dashboard_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boards(spark, sf_dir).select("workspace_id", "position", "title", "kind", "rationale", F.coalesce("reason", F.lit("fine")).alias("reason"), "total", F.array_join("currencies", ",").alias("currencies"), F.size("rows").alias("n_rows"))


def dashboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boards(spark, sf_dir).select("workspace_id", "title", F.inline("rows"))


def question_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = ask.plan_questions(questions(spark, sf_dir), fields(spark, sf_dir))
    return plans.select("workspace_id", "question_id", "answerable", "kind", "title", "unit_hint", "aggregate", "measure_field", "group_by", F.get("filters.field", F.lit(0)).alias("missing"))


def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's rows, with averages, extremes and months read from its words."""
    schema = fields(spark, sf_dir)
    plans = ask.with_spec_id(ask.plan_questions(questions(spark, sf_dir), schema, slots=True))
    found = evaluate(ask.distinct_queries(plans), records(spark, sf_dir), field_values(spark, sf_dir), schema)
    return plans.select("workspace_id", "question_id", "title", "query_id").join(found.where("place > 0"), ["workspace_id", "query_id"]).select("workspace_id", "question_id", "title", "place", "label", "value")


def suggested_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fields(spark, sf_dir)
    return ask.suggest_questions(schema, profile.schema_profile(field_values(spark, sf_dir), records(spark, sf_dir), schema))


def workspace_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names as file names: by nation, those of nations 0, 3, ... with a common first word, of 1, 4, ... with one suffix."""
    s, n = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_nationkey")
    name = F.when(n % 3 == 0, F.concat(F.lit("acme_"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".pdf").otherwise(".csv")))
    name = name.when(n % 3 == 1, F.concat(F.lit("in/x."), F.col("s_suppkey").cast("string"), F.lit("-scan.Pdf"))).otherwise(F.concat(F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".png").otherwise("")))
    return views.workspace_names(s.select(F.concat(F.lit("n"), n.cast("string")).alias("workspace_id"), name.alias("filename")))


def stale_dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as workspaces: a dashboard made at the user's median event is stale if anything but a view came later."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("workspace_id"), "event_id", "event_type")
    boards = e.groupBy("workspace_id").agg(F.floor((F.min("event_id") + F.max("event_id")) / 2).alias("generated_at")).withColumn("status", F.when(F.col("workspace_id") % 5 == 0, "pending").otherwise("ready"))
    return dashboard.mark_stale(boards, e.where("event_type <> 'view'").select("workspace_id", F.col("event_id").alias("changed_at")))


def _totals(spark: SparkSession, sf_dir: str, schema: DataFrame) -> DataFrame:
    """The total by segment of each workspace."""
    return evaluate(_one_query(schema, "sum", "total", "segment", 20), records(spark, sf_dir), field_values(spark, sf_dir), schema)


def _one_query(schema: DataFrame, aggregate: str, measure: str | None, group: str, limit: int) -> DataFrame:
    none = F.lit(None).cast("string")
    return schema.select("workspace_id").distinct().select(
        "workspace_id", F.lit("q").alias("query_id"), F.lit(aggregate).alias("aggregate"), F.lit(measure).cast("string").alias("measure_field"), F.lit(group).alias("group_by"), none.alias("date_bucket"),
        F.array().cast(ask.FILTERS).alias("filters"), F.lit("value_desc").alias("sort"), F.lit(limit).alias("limit"))


def result_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure that may be quoted of each workspace's total by segment, out of its JSON."""
    found = results.result_json(_totals(spark, sf_dir, fields(spark, sf_dir)))
    rows = found.select("workspace_id", results.at_pointer(F.col("result"), "/rows/0/label").alias("first"), F.inline(results.figures(results.result_paths(F.col("result"), F.lit(True), F.lit(None).cast("string")))))
    return rows.select("workspace_id", "first", "path", "text", F.coalesce("unit", F.lit("")).alias("unit"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each workspace: the rename of its segments by two writers of version 1, the merge of its customers into them, a merge of other types, and the removal of a field."""
    log = [(1, "rename", 1, "segment", "market", "Market"), (2, "rename", 1, "segment", "branch", "Branch"), (3, "merge", 2, "customer_name", "market", None), (4, "merge", None, "urgent", "rank", None), (5, "remove", None, "urgent", None, None)]
    kinds = {"place": "long", "action": "string", "expected": "int", "from_key": "string", "to_key": "string", "label": "string"}
    rows = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, kinds.items(), strict=True)]) for r in log])
    return fields(spark, sf_dir).select("workspace_id").distinct().select("workspace_id", F.inline(rows)).withColumn("author", F.lit("user"))


def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = versions.versions(fields(spark, sf_dir), _changes(spark, sf_dir))
    return log.select("workspace_id", F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("summary", "refused").alias("told"), F.array_join(F.flatten("fields.names"), ",").alias("names"))


def renamed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by market, whose values are still stored as segments and customers, at the latest version; a segment counts before a customer."""
    schema = versions.fields_at(versions.versions(fields(spark, sf_dir), _changes(spark, sf_dir)))
    found = evaluate(_one_query(schema, "count", None, "market", 5), records(spark, sf_dir), field_values(spark, sf_dir), schema)
    return found.where("place > 0").select("workspace_id", "place", "label", "value")


_FUNCTIONS = (result_figures, schema_versions, renamed_fields, workspace_profile, dashboard_panels, dashboard_rows, question_plans, question_answers, suggested_questions, workspace_names, stale_dashboards)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _FUNCTIONS}


_T = """with t as (
  select 'n' || c_nationkey as w, c_nationkey as nk, o_orderkey as k, case when c_nationkey % 5 <> 3 then o_totalprice end as total,
    case when c_nationkey % 5 <> 3 then case when c_nationkey % 2 = 0 or o_orderkey % 2 = 0 then 'USD' else 'EUR' end end as ccy, cast(left(o_orderpriority, 1) as double) as rank,
    case when case when c_nationkey % 4 = 1 then o_orderkey % 5 = 0 else o_orderkey % 7 <> 0 end then c_mktsegment end as segment, c_name as customer,
    case when c_nationkey % 3 <> 2 then cast(o_orderdate as date) end as ordered, o_orderpriority as priority, starts_with(o_orderpriority, '1') as urgent
  from orders join customer on o_custkey = c_custkey),
n as (select distinct c_nationkey as nk, 'n' || c_nationkey as w from customer)"""
_S = _T + """, tall as (
  select w, 'total' as key, cast(cast(total as decimal(38, 10)) as varchar) || ccy as label, total as x, null::date as d, ccy from t where total is not null union all
  select w, 'rank', cast(rank as varchar), rank, null, null from t union all select w, 'segment', segment, null, null, null from t where segment is not null union all
  select w, 'customer_name', customer, null, null, null from t union all select w, 'ordered', strftime(ordered, '%Y-%m-%d'), null, ordered, null from t where ordered is not null union all
  select w, 'priority', priority, null, null, null from t union all select w, 'urgent', case when urgent then 'Yes' else 'No' end, urgent::int, null, null from t),
f as (
  select n.w, n.nk, pos, key, label, type from n, (values (0, 'total', 'Invoice total', 'currency'), (1, 'rank', 'Priority number', 'number'), (2, 'segment', 'Market segment', 'string'), (3, 'customer_name', 'Customer name', 'string'),
    (4, 'ordered', 'Order date', 'date'), (5, 'priority', 'Priority', 'string'), (6, 'urgent', 'Urgent', 'boolean')) v(pos, key, label, type)
  where (key <> 'total' or n.nk % 5 <> 3) and (key <> 'ordered' or n.nk % 3 <> 2)),
p as (
  select w, key, count(*) as present, count(distinct label) as dist, cast(sum(cast(x as decimal(38, 6))) as double) as total, strftime(max(d), '%Y-%m-%d') as date_max, string_agg(distinct ccy, ',' order by ccy) as codes
  from tall group by 1, 2),
r as (select w, count(*) as records from t group by 1),
s as (
  select f.w, f.nk, f.pos, f.key, f.label, f.type, coalesce(present, 0) as present, coalesce(dist, 0) as dist, p.total, date_max, coalesce(codes, '') as codes, coalesce(records, 0) as records,
    coalesce(present, 0) / greatest(coalesce(records, 0), 1) as coverage, coalesce(dist, 0) between 2 and 30 as groupable
  from f left join p on f.w = p.w and f.key = p.key left join r on f.w = r.w)"""
_PCT = "cast(cast(round_even({c} * 100, 0) as int) as varchar) || '%'"
_B = _S + f""", g0 as (select *, bool_or(dist < present) over (partition by w) as rep from s where groupable and type = 'string'),
g as (select *, row_number() over (partition by w order by coverage desc, pos) as up, row_number() over (partition by w order by coverage, pos desc) as down from g0 where dist < present or not rep),
gap as (select * from s where coverage > 0 and coverage < 0.6 qualify row_number() over (partition by w order by pos) = 1),
money as (select * from s where type = 'currency'), day as (select * from s where type = 'date'),
q0 as (
  select w, 1 as p, 'metric' as kind, 'Documents in this collection' as title, 'There are ' || max(records) || ' documents, the denominator for everything else.' as why, null as m, null as g, null as miss from s group by w union all
  select w, 2, 'metric', 'Total invoice total', label || ' is present in ' || {_PCT.format(c="coverage")} || ' of documents, so the total is meaningful.', key, null, null from money union all
  select m.w, 3, 'bar', m.label || ' by ' || lower(g.label), g.label || ' has ' || g.dist || ' distinct values, few enough to compare side by side.', m.key, g.key, null from money m join g on m.w = g.w and up = 1 union all
  select w, 4, 'bar', 'Documents by ' || lower(label), label || ' splits the collection into ' || dist || ' groups.', null, key, null from g where down = 1 union all
  select w, 5, 'line', 'Documents by month of ' || lower(label), label || ' is present in ' || {_PCT.format(c="coverage")} || ' of documents, enough for a trend.', null, key, null from day union all
  select w, 6, 'metric', 'Documents with no ' || lower(label), 'Only ' || {_PCT.format(c="coverage")} || ' of documents have a ' || lower(label) || ', which is worth knowing.', null, null, key from gap),
q as (select *, row_number() over (partition by w order by p) as position from q0),
x as (
  select q.w, q.position, case g when 'segment' then coalesce(segment, 'Not stated') when 'customer_name' then customer when 'priority' then priority when 'ordered' then strftime(ordered, '%Y-%m') else case when m is null then 'Total' else 'Invoice total' end end as label,
    case when m is null then 1.0 else total end as v, case when m is not null then ccy end as ccy
  from q join t on q.w = t.w where (miss is null or (miss = 'segment' and segment is null)) and (m is null or total is not null)),
l as (select w, position, label, cast(sum(cast(v as decimal(38, 6))) as double) as value, row_number() over (partition by w, position order by value desc, label) as place from x group by 1, 2, 3),
o as (select l.w, l.position, label, value, case when kind = 'line' then row_number() over (partition by l.w, l.position order by label) else place end as place from l join q on l.w = q.w and l.position = q.position where kind <> 'line' or label is not null)"""
_ASK = """, c as (select 'n' || c_nationkey as w, c_custkey as id, c_custkey % 8 as a, c_nationkey % 5 <> 3 as money, c_nationkey % 3 <> 2 as dated, c_custkey % 11 <> 0 as ok from customer)"""
_SHOWN = "case when {v} = round({v}) then format('{{:,.0f}}', {v}) else format('{{:,.2f}}', {v}) end"
_SQL = {
    "result_figures": _T + f""", g as (select w, nk, coalesce(segment, 'Not stated') as label, cast(sum(cast(total as decimal(38, 6))) as double) as v from t where total is not null group by 1, 2, 3),
r as (select *, row_number() over (partition by w order by v desc, label) - 1 as i from g),
c as (select w, cast(sum(cast(total as decimal(38, 6))) as double) as v, count(*) as k, case when count(distinct ccy) = 1 then min(ccy) end as u from t where total is not null group by 1),
x as (
  select n.w, 'result.total' as path, {_SHOWN.format(v="coalesce(v, 0)")} || coalesce(' ' || u, '') as text, coalesce(u, '') as unit from n left join c on n.w = c.w union all
  select n.w, 'result.record_count', format('{{:,}}', coalesce(k, 0)), '' from n left join c on n.w = c.w union all select w, 'result.unit', u, '' from c where u is not null union all
  select r.w, 'result.rows.' || i || '.value', {_SHOWN.format(v="r.v")} || coalesce(' ' || c.u, ''), coalesce(c.u, '') from r join c on r.w = c.w union all select w, 'result.rows.' || i || '.label', label, '' from r)
select x.w as workspace_id, r.label as first, path, text, unit from x left join r on x.w = r.w and r.i = 0""",
    "schema_versions": _T + """, f as (select w, nk % 5 <> 3 as money, nk % 3 <> 2 as dated from n),
a as (select w, case when money then 'total,amount_due,' else '' end || 'rank,' as head, case when dated then 'ordered,' else '' end || 'priority,prio' as mid from f)
select w as workspace_id, v.place::bigint as place, v.version, v.told, case v.place when 0 then head || 'segment,customer_name,' || mid || ',urgent' when 1 then head || 'market,segment,customer_name,' || mid || ',urgent' when 3 then head || 'market,segment,customer_name,' || mid || ',urgent'
  when 5 then head || 'market,segment,customer_name,' || mid end as names
from a, (values (0, 1, 'First schema.'), (1, 2, 'You renamed ''Market segment'' to ''Market''.'), (2, 0, 'version 1 is not the latest, 2 is'), (3, 3, 'You merged ''Customer name'' into ''Market''.'), (4, 0, '''Urgent'' holds boolean values and ''Priority number'' holds number'), (5, 4, 'You removed ''Urgent''.')) v(place, version, told)""",
    "renamed_fields": _T + """, g as (select w, coalesce(segment, customer) as label, count(*)::double as value from t group by 1, 2)
select w as workspace_id, (row_number() over (partition by w order by value desc, label))::int as place, label, value from g qualify row_number() over (partition by w order by value desc, label) <= 5""",
    "workspace_profile": _S + " select w as workspace_id, key as field_key, pos as position, present, dist as \"distinct\", total as numeric_sum, date_max, codes as currencies, coverage, groupable from s",
    "dashboard_panels": _B + """, e as (select w, position, sum(cast(v as decimal(38, 6))) as total, string_agg(distinct ccy, ',' order by ccy) as codes from x group by 1, 2),
c as (select w, position, count(*) filter (place <= 20) as n from o group by 1, 2)
select q.w as workspace_id, q.position::int as position, title, case when coalesce(n, 0) <= 1 then 'metric' else kind end as kind, why as rationale,
  case when coalesce(n, 0) = 0 then 'empty' when kind in ('bar', 'line') and n < 2 then 'one row is a metric' when kind = 'metric' and sm.coverage < 1 / 3 then 'too rarely present' when sg.dist > 30 then 'too many groups'
    when sg.present >= 5 and sg.present = sg.dist then 'an identifier' else 'fine' end as reason,
  coalesce(cast(e.total as double), 0) as total, coalesce(e.codes, '') as currencies, coalesce(n, 0)::int as n_rows
from q left join e on q.w = e.w and q.position = e.position left join c on q.w = c.w and q.position = c.position left join s sm on sm.w = q.w and sm.key = q.m left join s sg on sg.w = q.w and sg.key = q.g""",
    "dashboard_rows": _B + " select o.w as workspace_id, title, place::int as place, o.label, value from o join q on o.w = q.w and o.position = q.position where place <= 20",
    "question_plans": _T + _ASK + """, b as (select *, ok and a <> 3 as asks from c)
select w as workspace_id, id as question_id, ok as answerable,
  case when not asks then null when a in (0, 2, 4) and (a <> 2 or dated) then 'bar' else 'metric' end as kind,
  case when not asks then null when a = 0 then case when money then 'Invoice total by Market segment' else 'Documents by Market segment' end when a = 1 then 'Documents with no Customer name'
    when a = 2 then case when dated and money then 'Invoice total by Order date' when dated then 'Documents by Order date' when money then 'Total Invoice total' else 'Documents' end
    when a = 4 then 'Priority number by Priority' when a = 5 then case when money then 'Total Invoice total' else 'Documents' end
    when a = 6 then case when money then 'Documents with no Invoice total' else 'Documents with no Urgent' end when a = 7 then case when money then 'Total Invoice total' else 'Documents' end end as title,
  case when asks and money and a in (0, 2, 5, 7) then 'USD' end as unit_hint,
  case when not asks then null when a in (1, 6) then 'count' when a = 4 then 'sum' when money then 'sum' else 'count' end as aggregate,
  case when not asks then null when a = 4 then 'rank' when money and a in (0, 2, 5, 7) then 'total' end as measure_field,
  case when not asks then null when a = 0 then 'segment' when a = 2 and dated then 'ordered' when a = 4 then 'priority' end as group_by,
  case when not asks then null when a = 1 then 'customer_name' when a = 6 then case when money then 'total' else 'urgent' end end as missing
from b""",
    "question_answers": _T + _ASK + """, x as (
  select w, 0 as a, coalesce(segment, 'Not stated') as label, case when nk % 5 <> 3 then total else 1 end as v from t union all
  select w, 2, case when nk % 3 <> 2 then strftime(ordered, '%Y-%m') when nk % 5 <> 3 then 'Invoice total' else 'Total' end, case when nk % 5 <> 3 then total else 1 end from t union all
  select w, 4, priority, rank from t union all
  select w, b.a, case when nk % 5 <> 3 then 'Invoice total' else 'Total' end, case when nk % 5 <> 3 then total else 1 end from t, (values (5), (7)) b(a) union all
  select w, 6, 'Total', 1 from t where (nk % 5 <> 3 and total is null) or (nk % 5 = 3 and urgent is null)),
v as (
  select x.w, a, label, case when a = 2 and nk % 5 <> 3 then cast(sum(cast(v as decimal(38, 6))) as double) / count(*) else cast(sum(cast(v as decimal(38, 6))) as double) end as value, a = 2 and nk % 3 <> 2 as dated
  from x join n on x.w = n.w group by x.w, a, label, nk),
o as (select *, row_number() over (partition by w, a order by case when dated then label end, value desc, label) as place from v)
select c.w as workspace_id, id as question_id,
  case c.a when 0 then case when money then 'Invoice total by Market segment' else 'Documents by Market segment' end
    when 2 then case when c.dated and money then 'Average Invoice total by Order date' when c.dated then 'Documents by Order date' when money then 'Average Invoice total' else 'Documents' end when 4 then 'Priority number by Priority'
    else case when money then 'Total Invoice total' else 'Documents' end end as title,
  place::int as place, label, value
from c join o on c.w = o.w and c.a = o.a where ok and place <= 20""",
    "suggested_questions": _S + """, best as (select w, lower(label) as label from s where coverage >= 0.3 and type = 'string' and dist between 2 and 12 qualify row_number() over (partition by w order by coverage desc, pos) = 1)
select n.w as workspace_id, v.place, case when nk % 5 <> 3 then v.q else v.r end as question
from n, (values (1, 'What is the invoice total by customer name?', 'Which documents are missing a market segment?'), (2, 'Which documents are missing a market segment?', 'Which customer name appears most often?'),
  (3, 'Which customer name appears most often?', 'What dates do these documents cover?')) v(place, q, r)""".replace("the invoice total by", "the total invoice total by"),
    "workspace_names": "select 'n' || s_nationkey as workspace_id, case s_nationkey % 3 when 0 then 'Acme documents' when 1 then case when count(*) = 1 then 'X.' || max(s_suppkey) || ' documents' else count(*) || ' PDF documents' end else case when count(*) = 1 then max(s_suppkey) || ' documents' when count(*) filter (s_suppkey % 2 = 0) > 0 then count(*) || ' PNG documents' else count(*) || ' mixed business documents' end end as name from supplier group by s_nationkey",
    "stale_dashboards": "with b as (select user_id, (min(event_id) + max(event_id)) // 2 as made, max(event_id) filter (event_type <> 'view') as last from events group by 1) select user_id as workspace_id, made as generated_at, case when user_id % 5 = 0 then 'pending' else 'ready' end as status, user_id % 5 <> 0 and coalesce(last > made, false) as stale from b",
}


def oracle_sql() -> dict[str, str]:
    return _SQL
