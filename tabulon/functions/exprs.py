"""What queries read from a value: its number, its label, its date bucket, and whether it passes a filter."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_STATED = "Not stated"


def numeric_of(v: Column, kind: Column) -> Column:
    return F.when(kind.isin("number", "currency"), v["n"]).when(kind == "boolean", v["b"].cast("double"))


def plain_number(n: Column) -> Column:
    """A double as text: integral ones end in .0, none has an exponent below 1e16."""
    whole = F.abs(n) < 1e16
    digits = F.regexp_replace(n.cast("decimal(38,10)").cast("string"), "0+$", "")
    return F.when(whole, F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)).otherwise(n.cast("string"))


def has_value(v: Column, kind: Column) -> Column:
    slot = F.when(kind.isin("number", "currency"), v["n"].isNotNull()).when(kind == "date", v["d"].isNotNull()).when(kind == "boolean", v["b"].isNotNull()).when(kind == "string_list", v["l"].isNotNull())
    return F.coalesce(slot.otherwise(v["s"].isNotNull()), F.lit(False))


def bucket_of(d: Column, bucket: str) -> Column:
    year = F.date_format(d, "yyyy")
    return {"month": F.date_format(d, "yyyy-MM"), "quarter": F.concat(year, F.lit("-Q"), F.quarter(d).cast("string")), "year": year}[bucket]


def label_of(v: Column, kind: Column, bucket: str | Column | None = None) -> Column:
    """The text that a value is grouped and compared by; missing and blank ones are one label. A bucket in a column may be null."""
    whole = F.date_format(v["d"], "yyyy-MM-dd")
    if isinstance(bucket, Column):
        date = F.when(bucket == "month", bucket_of(v["d"], "month")).when(bucket == "quarter", bucket_of(v["d"], "quarter")).when(bucket == "year", bucket_of(v["d"], "year")).otherwise(whole)
    else:
        date = whole if bucket is None else bucket_of(v["d"], bucket)
    text = F.when(kind == "currency", F.concat_ws(" ", plain_number(v["n"]), v["ccy"]))
    text = text.when(kind == "number", plain_number(v["n"])).when(kind == "date", F.coalesce(date, v["s"]))
    text = text.when(kind == "boolean", F.when(v["b"], "Yes").when(~v["b"], "No")).when(kind == "string_list", F.array_join(v["l"], ", ")).otherwise(v["s"])
    return F.when(~has_value(v, kind) | text.isNull() | (F.trim(text) == ""), NOT_STATED).otherwise(text)


def number_in(value: Any) -> float | None:
    """The number that a filter's value stands for."""
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, int | float):
        return float(value)
    try:
        return float(str(value).replace(",", "").strip())
    except ValueError:
        return None


def matches(v: Column, kind: Column, op: str, value: Any = None) -> Column:
    """Numbers compare as numbers with a tolerance of 1e-9, everything else as case-folded text, dates as ISO text.

    No operator but `missing` holds for an absent value. Where one side is no number, both compare as text.
    """
    present = has_value(v, kind)
    if op in ("missing", "present"):
        return ~present if op == "missing" else present
    left, right, text = numeric_of(v, kind), number_in(value), str(value).strip().lower()
    shown = F.lower(F.trim(label_of(v, kind)))
    by_text = {"eq": shown == text, "ne": shown != text, "gt": shown > text, "gte": shown >= text, "lt": shown < text, "lte": shown <= text, "contains": F.contains(shown, F.lit(text))}[op]
    if right is None:
        by_number = by_text
    else:
        by_number = {"eq": F.abs(left - right) < 1e-9, "ne": F.abs(left - right) >= 1e-9, "gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right, "contains": F.contains(plain_number(left), F.lit(repr(right)))}[op]
    return present & F.coalesce(F.when(left.isNotNull(), by_number).otherwise(by_text), F.lit(False))


def number_in_text(value: Column) -> Column:
    """number_in of a column of texts; `true` and `false` are 1 and 0."""
    text = F.lower(F.trim(value))
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(F.regexp_replace(text, ",", "").try_cast("double"))


def compared(v: Column, kind: Column) -> Column:
    """What `matches_by` reads of a value, as a struct to be kept in a column: presence, number, the number as text, label."""
    number = numeric_of(v, kind)
    return F.struct(has_value(v, kind).alias("present"), number.alias("number"), plain_number(number).alias("digits"), F.lower(F.trim(label_of(v, kind))).alias("shown"))


def matches_by(cell: Column, op: Column, value: Column) -> Column:
    """`matches` of a `compared` value, with the operator and the value, as text, in columns."""
    left, right, text = cell["number"], number_in_text(value), F.lower(F.trim(value))
    order = F.when(left.isNull() | right.isNull(), F.when(cell["shown"] == text, 0).when(cell["shown"] > text, 1).otherwise(-1)).when(left > right, 1).when(left < right, -1).otherwise(0)
    # numbers within the tolerance are equal, yet still larger or smaller
    equal = F.when(left.isNull() | right.isNull(), cell["shown"] == text).otherwise(F.abs(left - right) < 1e-9)
    within = F.when(left.isNull() | right.isNull(), F.contains(cell["shown"], text)).otherwise(F.contains(cell["digits"], plain_number(right)))
    held = F.when(op == "eq", equal).when(op == "ne", ~equal).when(op == "gt", order > 0).when(op == "gte", order >= 0).when(op == "lt", order < 0).when(op == "lte", order <= 0).when(op == "contains", within)
    return F.when(op == "missing", ~cell["present"]).when(op == "present", cell["present"]).otherwise(cell["present"] & F.coalesce(held, F.lit(False)))
