"""Dashboards of all workspaces: panels that the profile supports, evaluated in one scan, vetted and ordered; and whether they are stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import evaluate
from .ask import FILTERS, SPEC, _article, total_phrase
from .profile import vet

MOST_PANELS, SPARSE, MOST_BARS = 6, 0.6, 30


def _percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def _panel(kind: str, title: Column, rationale: Column, *, aggregate: str = "count", measure: Column | None = None, group: Column | None = None, bucket: str | None = None, missing: Column | None = None, unit: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    gaps = F.array().cast(FILTERS) if missing is None else F.array(F.struct(missing.alias("field"), F.lit("missing").alias("op"), none.alias("value"))).cast(FILTERS)
    or_none = lambda c: none if c is None else c
    return F.struct(
        F.lit(kind).alias("kind"), title.alias("title"), rationale.alias("rationale"), or_none(unit).alias("unit_hint"), F.lit(aggregate).alias("aggregate"), or_none(measure).alias("measure_field"),
        or_none(group).alias("group_by"), F.lit(bucket).cast("string").alias("date_bucket"), gaps.alias("filters"), F.lit("value_desc").alias("sort"), F.lit(20).alias("limit"))


def propose_panels(stats: DataFrame, most: int = MOST_PANELS) -> DataFrame:
    """(workspace_id, position, kind, title, rationale, unit_hint, the columns of a query): up to six panels of each workspace.

    stats: rows of operators.profile by workspace, with label, type and position. Panels, as far as there are fields for them: the number of
    records; the total of the currency field that most records have; that total by the first category; records by the last category;
    records by month of the first date; and records without the first sparse field. Categories are groupable text fields, those
    with repeated labels only if there are any; fields that more records have come first. A workspace's profile is one row here.
    """
    row = F.struct((-F.col("coverage")).alias("rank"), "position", F.col("field_key").alias("key"), "label", "type", "present", "distinct", "coverage", "groupable", "currencies")
    all_ = stats.groupBy("workspace_id").agg(F.array_sort(F.collect_list(row)).alias("f"), F.max("total_records").alias("total"))
    at = lambda rows, i=0: F.get(rows, F.lit(i))
    rows = all_.withColumn("groups", F.filter("f", lambda x: x["groupable"] & x["type"].isin("string", "enum")))
    rows = rows.withColumn("repeated", F.filter("groups", lambda x: x["distinct"] < x["present"]))
    rows = rows.withColumn("groups", F.when(F.size("repeated") > 0, F.col("repeated")).otherwise(F.col("groups")))
    thin = F.array_sort(F.transform(F.filter("f", lambda x: (x["coverage"] > 0) & (x["coverage"] < SPARSE)), lambda x: F.struct(x["position"].alias("position"), x["key"].alias("key"), x["label"].alias("label"), x["coverage"].alias("coverage"))))
    rows = rows.select(
        "workspace_id", "total", at(F.filter("f", lambda x: x["type"] == "currency")).alias("money"), at(F.col("groups")).alias("group"), at(F.reverse("groups")).alias("last"),
        at(F.filter("f", lambda x: x["type"] == "date")).alias("date"), at(thin).alias("gap"))
    money, group, last, date, gap = (F.col(c) for c in ("money", "group", "last", "date", "gap"))
    code, low = F.get(money["currencies"], F.lit(0)), lambda c: F.lower(c["label"])
    text, phrase = (lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])), total_phrase(money["label"])
    upper = F.concat(F.upper(F.substring(phrase, 1, 1)), F.substr(phrase, F.lit(2)))
    panels = [
        (F.lit(True), _panel("metric", F.lit("Documents in this collection"), text("There are ", F.col("total").cast("string"), " documents, the denominator for everything else."))),
        (money.isNotNull(), _panel("metric", upper, text(money["label"], " is present in ", _percent(money["coverage"]), " of documents, so the total is meaningful."), aggregate="sum", measure=money["key"], unit=code)),
        (money.isNotNull() & group.isNotNull(), _panel("bar", text(money["label"], " by ", low(group)), text(group["label"], " has ", group["distinct"].cast("string"), " distinct values, few enough to compare side by side."), aggregate="sum", measure=money["key"], group=group["key"], unit=code)),
        (last.isNotNull(), _panel("bar", text("Documents by ", low(last)), text(last["label"], " splits the collection into ", last["distinct"].cast("string"), " groups."), group=last["key"])),
        (date.isNotNull(), _panel("line", text("Documents by month of ", low(date)), text(date["label"], " is present in ", _percent(date["coverage"]), " of documents, enough for a trend."), group=date["key"], bucket="month")),
        (gap.isNotNull(), _panel("metric", text("Documents with no ", low(gap)), text("Only ", _percent(gap["coverage"]), " of documents have ", _article(gap["label"]), " ", low(gap), ", which is worth knowing."), missing=gap["key"])),
    ]
    chosen = F.slice(F.filter(F.array(*[F.when(holds, p) for holds, p in panels]), lambda p: p.isNotNull()), 1, most)
    return rows.select("workspace_id", F.posexplode(chosen).alias("position", "p")).select("workspace_id", (F.col("position") + 1).alias("position"), "p.*")


def shown_kind(kind: Column, rows: Column) -> Column:
    """What a result of so many rows is shown as."""
    return F.when(rows <= 1, F.when(kind == "table", "table").otherwise("metric")).when(kind == "metric", "bar").when((kind == "bar") & (rows > MOST_BARS), "table").otherwise(kind)


def dashboards(panels: DataFrame, stats: DataFrame, records: DataFrame, field_values: DataFrame, fields: DataFrame) -> DataFrame:
    """(workspace_id, position, title, kind, rationale, unit_hint, reason, total, currencies, rows array of (place, label, value)): every panel with its result.

    reason: why a panel isn't shown, else null. Panels are evaluated together, in one scan of the values; a result has 50 rows at most.
    """
    asked = panels.withColumn("query_id", F.col("position").cast("string"))
    found = evaluate(asked.select("workspace_id", "query_id", *SPEC), records, field_values, fields)
    of = found.groupBy("workspace_id", "query_id").agg(
        F.max(F.when(F.col("place") == 0, F.col("value"))).alias("total"), F.max(F.when(F.col("place") == 0, F.col("currencies"))).alias("currencies"),
        F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "label", "value")))).alias("rows"))
    known = stats.select("workspace_id", "field_key", "coverage", "distinct", "present")
    measure = known.select("workspace_id", F.col("field_key").alias("measure_field"), F.col("coverage").alias("measure_coverage"))
    group = known.select("workspace_id", F.col("field_key").alias("group_by"), F.col("distinct").alias("group_distinct"), F.col("present").alias("group_present"))
    out = asked.join(of, ["workspace_id", "query_id"], "left").join(measure, ["workspace_id", "measure_field"], "left").join(group, ["workspace_id", "group_by"], "left")
    out = out.withColumn("rows", F.coalesce("rows", F.array().cast(dict(of.dtypes)["rows"])))
    reason = vet(F.col("kind"), F.size("rows"), F.col("measure_coverage"), F.col("group_distinct"), F.col("group_present"))
    return out.select("workspace_id", "position", "title", shown_kind(F.col("kind"), F.size("rows")).alias("kind"), "rationale", "unit_hint", reason.alias("reason"), "total", "currencies", "rows")


def mark_stale(boards: DataFrame, changes: DataFrame) -> DataFrame:
    """`boards` (workspace_id, status, generated_at, ...) with `stale`: ready, and something in its workspace changed since. changes: workspace_id, changed_at.

    The last change is a maximum per workspace, so over a stream of changes the same aggregate, in update mode, is the state.
    """
    last = changes.groupBy("workspace_id").agg(F.max("changed_at").alias("changed_at"))
    late = (F.col("status") == "ready") & (F.col("changed_at") > F.col("generated_at"))
    return boards.drop("stale").join(last, "workspace_id", "left").withColumn("stale", F.coalesce(late, F.lit(False))).drop("changed_at")
