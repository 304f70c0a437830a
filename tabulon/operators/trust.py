"""Trust: tiers, human-protected merges, corrections, review order; and versions and merges of fields."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import has_value, label_of, numeric_of

HIGH, MEDIUM = 0.85, 0.6
HUMAN = ("human_verified", "not_present")


def tier(confidence: Column, grounded: Column, how: Column, has: Column) -> Column:
    """By confidence (0.5 where absent), capped where the value isn't grounded or was inferred; an exact absence is sure."""
    c = F.coalesce(confidence, F.lit(0.5))
    by_confidence = F.when(c >= HIGH, "high").when(c >= MEDIUM, "medium").otherwise("low")
    return F.when(~has & (how == "exact"), "high").when(how.isin("inferred", "failed") | ~grounded, "low").otherwise(by_confidence)


def differs(a: Column, b: Column, kind: Column) -> Column:
    x, y = numeric_of(a, kind), numeric_of(b, kind)
    text = F.lower(F.trim(label_of(a, kind))) != F.lower(F.trim(label_of(b, kind)))
    numbers = (F.abs(x - y) > 1e-9) | ~a["ccy"].eqNullSafe(b["ccy"])
    return (has_value(a, kind) != has_value(b, kind)) | F.coalesce(F.when(x.isNotNull() & y.isNotNull(), numbers), text)


def protected_merge(stored: DataFrame, fresh: DataFrame, at: Column) -> DataFrame:
    """Fresh values over stored ones by (record_id, field_key): a person's value stays; if the model disagrees, it is marked and the model's kept beside it."""
    keys = ["record_id", "field_key"]
    s = stored.select(*keys, *[F.col(c).alias(f"s_{c}") for c in ("value_type", "v", "confidence", "tier", "status")], F.lit(True).alias("has_s"))
    f = fresh.select(*keys, *[F.col(c).alias(f"f_{c}") for c in ("value_type", "v", "confidence", "tier")], F.lit(True).alias("has_f"))
    both = s.join(f, keys, "full_outer")
    human = F.coalesce(F.col("s_status").isin(*HUMAN), F.lit(False))
    clash = human & F.col("has_f") & differs(F.col("s_v"), F.col("f_v"), F.col("s_value_type"))
    keep = human | F.col("has_f").isNull()
    pick = lambda c: F.when(keep, F.col(f"s_{c}")).otherwise(F.col(f"f_{c}")).alias(c)
    new_tier = F.when(F.col("has_f").isNull(), F.col("s_tier")).when(clash, "conflict").when(human, "verified").otherwise(F.col("f_tier"))
    return both.select(*keys, pick("value_type"), pick("v"), pick("confidence"), new_tier.alias("tier"), F.when(keep, F.col("s_status")).otherwise("model").alias("status"), F.when(clash, F.col("f_v")).alias("model_value"), F.when(clash, at).alias("model_value_at"))


def correct(stored: DataFrame, corrections: DataFrame) -> DataFrame:
    """People's values replace what is stored: tier verified, confidence 1, no model value beside it."""
    kept = stored.join(corrections, ["record_id", "field_key"], "left_anti")
    absent = ~has_value(F.col("v"), F.col("value_type"))
    status = F.when(absent, "not_present").otherwise("human_verified")
    new = corrections.select("record_id", "field_key", "value_type", "v", F.lit(1.0).alias("confidence"), F.lit("verified").alias("tier"), status.alias("status"))
    return kept.unionByName(new, allowMissingColumns=True)


def impact(weight: Column, confidence: Column, tier_: Column, status: Column) -> Column:
    base = weight * (1 - F.coalesce(confidence, F.lit(0.5)))
    return F.when((status == "human_verified") | (tier_ == "verified"), 0.0).when(tier_ == "conflict", base + weight).when(tier_ == "low", base * 1.5).otherwise(base)


def tally(field_values: DataFrame) -> DataFrame:
    """Of each record the weakest trust of its values."""
    any_ = lambda t: F.bool_or(F.col("tier") == t)
    state = F.when(any_("conflict"), "conflicts").when(any_("low"), "unverified").when(any_("medium"), "review").otherwise("high")
    return field_values.groupBy("record_id").agg(state.alias("trust"), F.count("*").alias("n_values"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def merge_fields(field_values: DataFrame, source: str, target: str) -> DataFrame:
    """One field into another: the target's value stays, unless only the source has one, or only the source's is a person's."""
    pair = F.col("field_key").isin(source, target)
    human = F.col("status").isin(*HUMAN)
    rank = F.row_number().over(W.partitionBy("record_id").orderBy(F.desc(human), F.desc(F.col("field_key") == target)))
    merged = field_values.where(pair).withColumn("rank_", rank).where("rank_ = 1").drop("rank_").withColumn("field_key", F.lit(target))
    return field_values.where(~pair).unionByName(merged)


def keyset_page(df: DataFrame, time: str, key: str, after: tuple | None, size: int) -> DataFrame:
    """The next page and one row more, which tells whether there is another."""
    if after is not None:
        df = df.where((F.col(time) > F.lit(after[0])) | ((F.col(time) == F.lit(after[0])) & (F.col(key) > F.lit(after[1]))))
    return df.orderBy(time, key).limit(size + 1)


def cursor_of(time: Column, key: Column) -> Column:
    """An opaque mark of a place in the order of (time, key): the base64 of both, safe in an address."""
    return F.translate(F.base64(F.concat_ws("|", time.cast("string"), key.cast("string")).cast("binary")), "+/\r\n", "-_")


def read_cursor(cursor: str | None) -> tuple[str, str] | None:
    """(time, key) as text; None, which is the first page, for what no cursor_of made."""
    try:
        time, bar, key = base64.b64decode((cursor or "").encode(), b"-_", validate=True).decode().partition("|")
    except ValueError:
        return None
    return (time, key) if bar and time and key else None


def page(df: DataFrame, time: str, key: str, cursor: str | None, size: int) -> DataFrame:
    """The `size` rows after a cursor; where more follow, the last has the next page's cursor in `next_cursor`.

    Places are values, not counts, so rows that come in meanwhile move none. A cursor of other types than the columns' is none.
    Only size + 1 rows leave the tasks that sort.
    """
    after = read_cursor(cursor)
    if after is not None:
        kinds = [df.schema[c].dataType.simpleString() for c in (time, key)]
        typed = df.sparkSession.range(1).select(*[F.lit(a).try_cast(t).alias(n) for a, t, n in zip(after, kinds, "tk", strict=True)]).first()
        after = None if any(a is None for a in typed) else tuple(typed)
    probe = keyset_page(df, time, key, after, size)
    place = F.row_number().over(W.orderBy(time, key))  # over size + 1 rows
    rows = probe.withColumns({"place__": place, "all__": F.count("*").over(W.partitionBy())}).where(F.col("place__") <= size)
    return rows.withColumn("next_cursor", F.when((F.col("place__") == size) & (F.col("all__") > size), cursor_of(F.col(time), F.col(key)))).drop("place__", "all__")


def merge_counts(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row of what a merge does: values written, kept from people, in conflict, and how many fresh ones are grounded (column of that name)."""
    keys = ["record_id", "field_key"]
    s = stored.select(*keys, F.col("value_type").alias("s_type"), F.col("v").alias("s_v"), F.col("status").isin(*HUMAN).alias("human"))
    both = fresh.select(*keys, "v", "grounded").join(s, keys, "left").withColumn("human", F.coalesce("human", F.lit(False)))
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    grounded = F.col("grounded")
    return both.agg(
        count(~F.col("human")).alias("written"), count(F.col("human")).alias("protected"), count(F.col("human") & differs(F.col("s_v"), F.col("v"), F.col("s_type"))).alias("conflicts"),
        count(grounded).alias("grounded"), count(~F.coalesce(grounded, F.lit(False))).alias("ungrounded"))
