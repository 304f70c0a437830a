"""Column profiles of the tall table, and whether a panel is worth showing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import has_value, label_of, numeric_of
from ..plans.planner import EXACT

MIN_COVERAGE, MOST_GROUPS, MIN_SAMPLE = 1 / 3, 30, 5


def label_counts(field_values: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    v, t = F.col("v"), F.col("value_type")
    stated = field_values.where(has_value(v, t))
    number = numeric_of(v, t)
    return stated.groupBy(*per, "field_key", label_of(v, t).alias("label")).agg(
        F.count("*").alias("n"), F.min(number).alias("lo"), F.max(number).alias("hi"), F.sum(number.cast(EXACT)).alias("total"),
        F.min(v["d"]).alias("first"), F.max(v["d"]).alias("last"), F.collect_set(v["ccy"]).alias("codes"))


def profile(field_values: DataFrame, records: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """A row per field, of each `per` (workspace_id) if given; labels are pre-aggregated, so distinct counts are exact without a second pass."""
    total = F.broadcast(records.agg(F.count("*").alias("total_records"))) if not per else records.groupBy(*per).agg(F.count("*").alias("total_records"))  # one row, or one each
    out = label_counts(field_values, per).groupBy(*per, "field_key").agg(
        F.sum("n").alias("present"), F.count("*").alias("distinct"), F.min("lo").alias("numeric_min"), F.max("hi").alias("numeric_max"), F.sum("total").cast("double").alias("numeric_sum"),
        F.min("first").alias("date_min"), F.max("last").alias("date_max"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("codes")))).alias("currencies"))
    out = (out.join(total, list(per)) if per else out.crossJoin(total)).withColumn("coverage", F.col("present") / F.greatest("total_records", F.lit(1)))
    return out.withColumn("groupable", F.col("distinct").between(2, MOST_GROUPS))


def schema_profile(field_values: DataFrame, records: DataFrame, fields: DataFrame) -> DataFrame:
    """profile by workspace for the fields of each schema, with position, label and type; a field without values has zeros.

    Values under an alias count for its field. fields: rows of plans.shared.FIELD; a schema has some dozen fields and workspaces
    are many, so the schema is joined after labels are counted.
    """
    names = fields.select("workspace_id", F.col("key"), F.explode("names").alias("field_key"))
    counts = label_counts(field_values, ("workspace_id",)).join(names, ["workspace_id", "field_key"]).drop("field_key")
    per = counts.groupBy("workspace_id", "key", "label").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"), F.flatten(F.collect_list("codes")).alias("codes"))
    out = per.groupBy("workspace_id", "key").agg(
        F.sum("n").alias("present"), F.count("*").alias("distinct"), F.min("lo").alias("numeric_min"), F.max("hi").alias("numeric_max"), F.sum("total").cast("double").alias("numeric_sum"),
        F.min("first").alias("date_min"), F.max("last").alias("date_max"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("codes")))).alias("currencies"))
    totals = records.groupBy("workspace_id").agg(F.count("*").alias("total_records"))
    out = fields.select("workspace_id", "position", "key", F.col("label"), "type").join(out, ["workspace_id", "key"], "left").join(totals, "workspace_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("present", "distinct", "total_records")}).withColumn("currencies", F.coalesce("currencies", F.array().cast("array<string>")))
    out = out.withColumn("coverage", F.col("present") / F.greatest("total_records", F.lit(1))).withColumn("groupable", F.col("distinct").between(2, MOST_GROUPS))
    return out.withColumnRenamed("key", "field_key")


def by_coverage(stats: DataFrame) -> DataFrame:
    """A profile in the order in which it is read: fields that more records have first, those of equal coverage as in the schema."""
    return stats.orderBy("workspace_id", F.desc("coverage"), "position")


def top_labels(field_values: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("field_key").orderBy(F.desc("n"), "label"))
    return label_counts(field_values).select("field_key", "label", "n").withColumn("place", rank).where(F.col("place") <= k)


def vet(kind: Column, rows: Column, coverage: Column, distinct: Column, present: Column) -> Column:
    """Why a panel should not be shown, or null. coverage: of a metric's measure; distinct and present: of the group."""
    return (
        F.when(rows == 0, "empty")
        .when(kind.isin("bar", "line") & (rows < 2), "one row is a metric")
        .when((kind == "metric") & (coverage < MIN_COVERAGE), "too rarely present")
        .when(distinct > MOST_GROUPS, "too many groups")
        .when((present >= MIN_SAMPLE) & (distinct == present), "an identifier")
    )


def breakdown(stats: DataFrame) -> DataFrame:
    """The best measure (by coverage) and the best group (by coverage, then fewest labels)."""
    measure = stats.where("numeric_sum is not null").agg(F.max_by("field_key", F.struct("coverage", "field_key")).alias("measure"))
    group = stats.where("groupable and numeric_sum is null and date_min is null").agg(F.max_by("field_key", F.struct("coverage", -F.col("distinct"), "field_key")).alias("group_by"))
    return measure.crossJoin(group)  # one row each
