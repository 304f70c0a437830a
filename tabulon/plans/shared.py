"""Many queries at once, of any number of workspaces: queries are rows, the tall table is read once, and one aggregate serves them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.exprs import NOT_STATED, bucket_of, compared, has_value, label_of, matches_by, numeric_of
from .planner import EXACT

#: A query as a row. A null measure counts records; filters must all hold; their values are texts.
QUERY = "workspace_id string, query_id string, aggregate string, measure_field string, group_by string, date_bucket string, filters array<struct<field:string,op:string,value:string>>, sort string, limit int"
#: A field of a workspace's schema; names are its key and aliases, in the order in which they count.
FIELD = "workspace_id string, position int, key string, label string, type string, currency_default string, names array<string>"
MOST_ROWS, MOST_FILTERS = 50, 8
BUCKETS, COMPARED = ("month", "quarter", "year"), "struct<present:boolean,number:double,digits:string,shown:string>"
#: Queries are broadcast up to this number, as some hundred bytes each; beyond it their workspaces are dealt over salts.
BROADCAST_QUERIES, SALTS = 100_000, 64


def checked(queries: DataFrame) -> DataFrame:
    """The queries that can be asked: the rules of DataQuery as a filter."""
    known = F.col("aggregate").isin("sum", "count", "avg", "min", "max") & F.coalesce(F.col("sort"), F.lit("value_desc")).isin("value_desc", "value_asc", "label_asc")
    known &= F.col("date_bucket").isNull() | F.col("date_bucket").isin(*BUCKETS)
    measured = (F.col("aggregate") == "count") | F.col("measure_field").isNotNull()
    few = (F.coalesce(F.size("filters"), F.lit(0)) <= MOST_FILTERS) & F.coalesce(F.col("limit"), F.lit(20)).between(1, MOST_ROWS)
    ops = F.forall(F.coalesce("filters", F.array()), lambda f: F.when(f["op"].isin("missing", "present"), True).otherwise(f["op"].isin("eq", "ne", "gt", "gte", "lt", "lte", "contains") & f["value"].isNotNull()))
    return queries.where(known & measured & few & ops)


def bound(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """Queries with the names of each field they use; null where the workspace's schema has no such field. A schema has some dozen fields, so one is a row here."""
    schema = fields.groupBy("workspace_id").agg(F.collect_list(F.struct("names", "label")).alias("schema"))
    rows = queries.join(schema, "workspace_id", "left")
    found = lambda name: F.get(F.filter("schema", lambda s: F.array_contains(s["names"], name)), F.lit(0))
    filters = F.transform(F.coalesce("filters", F.array().cast("array<struct<field:string,op:string,value:string>>")), lambda f: F.struct(found(f["field"])["names"].alias("names"), f["op"].alias("op"), f["value"].alias("value")))
    return rows.select(
        "workspace_id", "query_id", "aggregate", F.col("measure_field").isNotNull().alias("measures"), found(F.col("measure_field")).alias("measure"), found(F.col("group_by"))["names"].alias("group_names"),
        "date_bucket", filters.alias("filters"), F.coalesce("sort", F.lit("value_desc")).alias("sort"), F.coalesce("limit", F.lit(20)).alias("limit"))


def _cell(names: Column, most: int) -> Column:
    """The value of the first of a field's names that the record has."""
    return F.coalesce(*[F.col("cells")[F.get(names, F.lit(i))] for i in range(most)])


def _spread(rows: DataFrame, queries: DataFrame, few: bool) -> DataFrame:
    """A row per record and query of its workspace. Rows stay where they are, or, for very many queries, a workspace's rows go to SALTS tasks."""
    of = queries.groupBy("workspace_id").agg(F.collect_list(F.struct(*[c for c in queries.columns if c != "workspace_id"])).alias("queries"))
    if few:
        met = rows.join(F.broadcast(of), "workspace_id")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)))
        met = salted.join(of.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["workspace_id", "salt"]).drop("salt")
    return met.select("workspace_id", "record_id", "cells", F.explode("queries").alias("q")).select("workspace_id", "record_id", "cells", "q.*")


def _roles(asked: DataFrame) -> DataFrame:
    """(workspace_id, field_key, role): what queries read of a field: `x` of a measure, `label` or a bucket's name of a group, and `text` or mere `has` of a filter."""
    named = lambda names, role: F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.struct(n.alias("field_key"), role.alias("role")))
    filters = F.flatten(F.transform("filters", lambda f: named(f["names"], F.when(f["op"].isin("missing", "present"), "has").otherwise("text"))))
    every = F.concat(named(F.col("measure.names"), F.lit("x")), named(F.col("group_names"), F.coalesce("date_bucket", F.lit("label"))), filters)
    return asked.select("workspace_id", F.inline(every)).distinct()


def _read(v: Column, kind: Column, roles: list[str]) -> Column:
    """What queries read of a value, for the roles that occur; null where the field has another role only. Once a value, as many queries read it.

    A bucket's text is that of a date; what else is grouped by buckets has its label.
    """
    buckets = [r for r in BUCKETS if r in roles]
    labelled = reduce(lambda a, b: a | b, [F.col(b) & (kind != "date") for b in buckets], F.col("label") if "label" in roles else F.lit(False))
    # a lambda, as without one the work of a row is one compiled method, which is too long for the JVM to make fast
    parts = [F.exists(F.array(has_value(v, kind)), lambda h: h).alias("has"), v["ccy"].alias("ccy"), F.when(labelled, label_of(v, kind)).alias("label")]
    parts += [F.when(F.col(b) & (kind == "date"), F.coalesce(bucket_of(v["d"], b), F.lit(NOT_STATED))).alias(b) for b in buckets]
    if "x" in roles:
        parts.append(F.when(F.col("x"), numeric_of(v, kind)).alias("x"))
    if "text" in roles:
        parts.append(F.when(F.col("text"), compared(v, kind)).alias("text"))
    return F.struct(*parts)


def evaluate(queries: DataFrame, records: DataFrame, field_values: DataFrame, fields: DataFrame, *, row_counts: bool = True) -> DataFrame:
    """(workspace_id, query_id, place, label, value, record_count, currencies): for each query its total in place 0, then its rows from place 1, in order.

    Rows and totals are those of `plan` for the same query: a query reads the records of its own workspace alone. Only keys that some
    query of the workspace names are read, and each value is made into the numbers and labels that queries ask of it once; a record's are gathered once; labels and totals are two grouping sets of one aggregate, which
    is partial before the shuffle, so a workspace or label of any size is no task of its own. A total has a null label; where a
    query has no rows, only its total is there. Queries that `checked` refuses are left out; query_id is unique within a workspace.
    """
    asked = bound(checked(queries), fields).persist()  # no more than the queries, read five times
    sizes = asked.select(
        F.greatest(F.coalesce(F.size("measure.names"), F.lit(0)), F.coalesce(F.size("group_names"), F.lit(0)), F.coalesce(F.array_max(F.transform("filters", lambda f: F.coalesce(F.size(f["names"]), F.lit(0)))), F.lit(0))).alias("names"),
        F.size("filters").alias("filters")).agg(F.count("*").alias("n"), F.max("names").alias("names"), F.max("filters").alias("filters")).first()
    names, n_filters, few = max(1, sizes.names or 0), sizes.filters or 0, sizes.n <= BROADCAST_QUERIES

    used = _roles(asked)
    roles = sorted(r.role for r in used.select("role").distinct().collect())
    used = used.groupBy("workspace_id", "field_key").agg(F.lit(True).alias("used"), *[F.bool_or(F.col("role") == r).alias(r) for r in roles])
    read = field_values.select("workspace_id", "record_id", "field_key", F.coalesce("value_type", F.lit("string")).alias("t"), "v").join(F.broadcast(used) if few else used, ["workspace_id", "field_key"])
    read = read.select("workspace_id", "record_id", "field_key", _read(F.col("v"), F.col("t"), roles).alias("c"))
    cells = read.groupBy("workspace_id", "record_id").agg(F.map_from_entries(F.collect_list(F.struct("field_key", "c"))).alias("cells"))
    rows = _spread(records.select("workspace_id", "record_id").join(cells, ["workspace_id", "record_id"], "left"), asked, few)

    # cells are columns of their own, as what reads them reads them often
    of = lambda name, role, kind: F.col(name)[role] if role in roles else F.lit(None).cast(kind)
    rows = rows.select("*", *[_cell(F.get("filters", F.lit(i))["names"], names).alias(f"f{i}") for i in range(n_filters)])
    compare = lambda i: F.struct(F.coalesce(F.col(f"f{i}.has"), F.lit(False)).alias("present"), *[of(f"f{i}", "text", COMPARED)[c].alias(c) for c in ("number", "digits", "shown")])
    filters = [F.get("filters", F.lit(i)) for i in range(n_filters)]
    test = lambda i, f: matches_by(compare(i), f["op"], f["value"]) if "text" in roles else F.when(f["op"] == "missing", ~F.coalesce(F.col(f"f{i}.has"), F.lit(False))).otherwise(F.coalesce(F.col(f"f{i}.has"), F.lit(False)))
    tests = [F.when(F.size("filters") <= i, True).when(f["names"].isNull(), f["op"] == "missing").otherwise(test(i, f)) for i, f in enumerate(filters)]
    # what a filter drops has nothing to measure: a condition would be pushed below these columns and copy them into itself
    kept = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
    rows = rows.select("workspace_id", "query_id", "aggregate", "sort", "limit", "date_bucket", "measures", "measure", kept.alias("kept"), _cell(F.col("measure.names"), names).alias("m"), F.col("group_names").isNotNull().alias("grouped"), _cell(F.col("group_names"), names).alias("g"))
    here = F.col("m").isNotNull() if row_counts else F.coalesce("m.has", F.lit(False))
    number = F.when(~F.col("measures"), F.when(F.col("aggregate") == "count", 1.0)).when(F.col("aggregate") == "count", F.when(here, 1.0)).otherwise(of("m", "x", "double"))
    shown = reduce(lambda c, b: F.when(F.col("date_bucket") == b, F.coalesce(F.col("g")[b], c)).otherwise(c), [b for b in BUCKETS if b in roles], F.col("g.label"))
    label = F.when(F.col("grouped"), F.coalesce(shown, F.lit(NOT_STATED))).otherwise(F.coalesce("measure.label", F.lit("Total")))
    facts = rows.select("workspace_id", "query_id", "aggregate", "sort", "limit", "date_bucket", F.when(F.col("kept"), number).alias("x"), label.alias("of"), F.col("m.ccy").alias("code"))
    facts = facts.select("workspace_id", "query_id", "aggregate", "sort", "limit", "date_bucket", F.when(F.col("x").isNotNull(), F.col("of")).alias("label"), "x", F.when(F.col("x").isNotNull(), F.col("code")).alias("ccy"))

    by = ["workspace_id", "query_id", "aggregate", "sort", "limit", "date_bucket"]
    # figures that sum up come first: an aggregate of them is held by hash, while one with sets of currencies sorts its rows
    exact = F.sum(F.col("x").cast(EXACT))
    facts = facts.groupBy(*by, "label", "ccy").agg(F.count("x").alias("n"), exact.alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # a row of nothing for each query, so that a query without rows has a total
    nothing = [F.lit(None).cast(kind).alias(c) if c != "n" else F.lit(0).cast(kind).alias(c) for c, kind in facts.dtypes if c not in by]
    facts = facts.unionByName(asked.select(*by, *nothing))
    sums = facts.groupingSets([[*by, "label"], by], *by, "label").agg(
        F.grouping("label").alias("all"), F.sum("n").alias("n"), F.sum("s").cast("double").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_set("ccy")).alias("currencies"))
    kind = F.col("aggregate")
    result = F.when(kind == "sum", F.coalesce("s", F.lit(0.0))).when(kind == "count", F.col("n").cast("double")).when(kind == "avg", F.when(F.col("n") > 0, F.col("s") / F.col("n"))).when(kind == "min", F.col("lo")).otherwise(F.col("hi"))
    shown = (F.col("all") == 1) | (F.col("label").isNotNull() & (F.col("date_bucket").isNull() | (F.col("label") != NOT_STATED)))
    sums = sums.select(*by, "all", "label", result.alias("value"), F.col("n").alias("record_count"), "currencies").where(shown)
    by_label = F.col("date_bucket").isNotNull() | (F.col("sort") == "label_asc")
    order = [F.when(by_label, F.col("label")).asc(), F.when(F.col("sort") == "value_asc", F.col("value")).otherwise(-F.col("value")).asc_nulls_last(), F.col("label")]
    place = F.row_number().over(W.partitionBy("workspace_id", "query_id", "all").orderBy(*order))
    ranked = sums.withColumn("place", place).where(F.col("place") <= MOST_ROWS).where(F.col("place") <= F.col("limit"))
    return ranked.select("workspace_id", "query_id", F.when(F.col("all") == 1, 0).otherwise(F.col("place")).alias("place"), "label", "value", "record_count", "currencies")
