"""A DataQuery as DataFrames: only the keys it names are read, then one wide row per record, then one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import NOT_STATED, has_value, label_of, matches, numeric_of
from ..model import FieldSpec
from ..spec import DataQuery

#: Sums are taken in decimals, so their result doesn't depend on the order of the rows.
EXACT = "decimal(38,6)"


def wide(records: DataFrame, field_values: DataFrame, fields: Sequence[FieldSpec]) -> DataFrame:
    """Every record with a column per field (struct of value type, slots, presence); aliases are folded into their field, whose own key goes first.

    The keys are a filter below the pivot, so Parquet prunes row groups by them, and records without any of them stay.
    """
    names = {n: f.key for f in fields for n in reversed(f.names())}
    if not names:
        return records.select("record_id")
    place = F.coalesce(*[F.when(F.col("field_key") == n, F.lit(k)) for f in fields for k, n in enumerate(f.names())])
    canonical = F.coalesce(*[F.when(F.col("field_key").isin(*f.names()), F.lit(f.key)) for f in fields])
    rows = field_values.where(F.col("field_key").isin(*sorted(names))).select("record_id", canonical.alias("k"), place.alias("place"), F.struct(F.lit(True).alias("row"), F.col("value_type").alias("t"), "v").alias("c"))
    cells = rows.groupBy("record_id").agg(*[F.min_by("c", F.when(F.col("k") == f.key, F.col("place"))).alias(f.key) for f in fields])
    return records.select("record_id").join(cells, "record_id", "left")


def _value(cell: str) -> tuple[Column, Column]:
    return F.col(cell)["v"], F.coalesce(F.col(cell)["t"], F.lit("string"))


def _base(query: DataQuery, records: DataFrame, field_values: DataFrame, fields: Sequence[FieldSpec], row_counts: bool, workspace_id: str | None) -> DataFrame:
    """(record_id, label, x, ccy) of every record that the filters keep and that has something to measure."""
    if workspace_id is not None:
        records, field_values = (t.where(F.col("workspace_id") == workspace_id) for t in (records, field_values))
    by_key = {n: f for f in fields for n in f.names()}
    named = [query.measure_field, query.group_by, *[f.field for f in query.filters]]
    base = wide(records, field_values, list({by_key[n].key: by_key[n] for n in named if n in by_key}.values()))
    key = lambda n: by_key[n].key
    tests = [matches(*_value(key(f.field)), f.op, f.value) if f.field in by_key else F.lit(f.op == "missing") for f in query.filters]
    base = base.where(reduce(lambda a, b: a & b, tests)) if tests else base

    measure = query.measure_field
    if measure is None:
        number, code = F.lit(1.0) if query.aggregate == "count" else F.lit(None).cast("double"), F.lit(None).cast("string")
    elif measure not in by_key:
        number, code = F.lit(None).cast("double"), F.lit(None).cast("string")
    else:
        v, t = _value(key(measure))
        here = F.coalesce(F.col(key(measure))["row"], F.lit(False)) if row_counts else has_value(v, t)
        number = F.when(here, 1.0) if query.aggregate == "count" else numeric_of(v, t)
        code = v["ccy"]
    group = query.group_by if query.group_by in by_key else None
    label = label_of(*_value(key(group)), query.date_bucket) if group else F.lit(by_key[measure].label if measure in by_key else "Total")
    return base.select("record_id", label.alias("label"), number.alias("x"), code.alias("ccy")).where("x is not null")


def lineage(query: DataQuery, records: DataFrame, field_values: DataFrame, fields: Sequence[FieldSpec], *, row_counts: bool = True, workspace_id: str | None = None) -> DataFrame:
    """(label, record_id): the records behind each label of a query, a row each, so that no group is gathered in one row."""
    rows = _base(query, records, field_values, fields, row_counts, workspace_id)
    return rows.where(F.col("label") != NOT_STATED).select("label", "record_id") if query.date_bucket else rows.select("label", "record_id")


def plan(query: DataQuery, records: DataFrame, field_values: DataFrame, fields: Sequence[FieldSpec], *, row_counts: bool = True, workspace_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of label and value; one row of total, unit, currencies, mixed_currency, record_count). Their records are in `lineage`.

    row_counts: count a field where a record has a row for it, even without a value; else where it has a value. Groups that are not
    stated stay, except on a time axis, which is in its own order. The total covers every group. Without a group the label is the
    measure's, else Total. A field that the schema doesn't have is an absent value in filters, no group, and nothing to measure.
    workspace_id: the only workspace whose records and values are read, a filter that reaches both scans; None for tables of one workspace.
    """
    rows = _base(query, records, field_values, fields, row_counts, workspace_id)
    exact = F.sum(F.col("x").cast(EXACT)).cast("double")
    value = {"sum": exact, "count": F.count("x").cast("double"), "avg": exact / F.count("x"), "min": F.min("x"), "max": F.max("x")}[query.aggregate]
    out = rows.groupBy("label").agg(value.alias("value"))
    if query.date_bucket:
        out = out.where(F.col("label") != NOT_STATED).orderBy("label")
    elif query.sort == "label_asc":
        out = out.orderBy("label")
    else:
        out = out.orderBy(F.desc_nulls_last("value") if query.sort == "value_desc" else F.asc_nulls_last("value"), "label")

    codes = F.sort_array(F.collect_set("ccy"))
    summary = rows.agg(F.coalesce(value, F.lit(0.0)).alias("total") if query.aggregate in ("sum", "count") else value.alias("total"), codes.alias("currencies"), F.count("*").alias("record_count"))
    summary = summary.select("total", F.when(F.size("currencies") == 1, F.col("currencies")[0]).alias("unit"), "currencies", (F.size("currencies") > 1).alias("mixed_currency"), "record_count")
    return out.limit(query.limit), summary
