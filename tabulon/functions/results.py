"""Results as JSON, values in it by pointer, and the figures that an answer's text may quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import figure


def result_json(found: DataFrame) -> DataFrame:
    """(workspace_id, query_id, result): a result of plans.shared.evaluate as JSON text; a result has 50 rows at most.

    {"total", "record_count", "currencies", "rows": [{"label", "value"}]}; what is null is left out.
    """
    rows = F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "label", "value"))))
    of = lambda c: F.max(F.when(F.col("place") == 0, F.col(c))).alias(c)
    whole = found.withColumn("total", F.col("value")).groupBy("workspace_id", "query_id").agg(of("total"), of("record_count"), of("currencies"), rows.alias("rows"))
    shown = F.transform("rows", lambda r: F.struct(r["label"].alias("label"), r["value"].alias("value")))
    return whole.select("workspace_id", "query_id", F.to_json(F.struct("total", "record_count", "currencies", shown.alias("rows"))).alias("result"))


def at_pointer(json: Column, pointer: str, kind: str = "string") -> Column:
    """The value at a pointer such as /rows/0/value, as `kind`; null where there is none or it can't be cast. ~1 stands for / and ~0 for ~."""
    steps = [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]
    if any("'" in s and '"' in s for s in steps):
        raise ValueError(f"a key with both kinds of quotes can't be named: {pointer!r}")
    path = "$" + "".join(f"[{s}]" if s.isdigit() else f'["{s}"]' if "'" in s else f"['{s}']" for s in steps)
    return F.try_variant_get(F.try_parse_json(json), path, kind)


_RESULT = "struct<total:double,record_count:bigint,currencies:array<string>,rows:array<struct<label:string,value:double>>>"


def result_paths(result: Column, money: Column, unit: Column) -> Column:
    """A map from every path that text may quote to its value as text and the unit that applies: only values of money have one.

    result: JSON of `result_json`; money: whether the measure is of money; unit: as asked for, else the only currency of the result.
    """
    r = F.from_json(result, _RESULT)
    of = F.coalesce(unit, F.when(F.size(r["currencies"]) == 1, r["currencies"][0]))
    valued = F.when(money, of)
    entry = lambda path, text, u: F.struct(path.alias("key"), F.struct(text.alias("text"), u.cast("string").alias("unit")).alias("value"))
    none = F.lit(None).cast("string")
    shown = lambda n, u: F.when(n.isNotNull(), figure(n, u))
    head = F.array(entry(F.lit("result.total"), shown(r["total"], valued), valued), entry(F.lit("result.record_count"), figure(r["record_count"].cast("double"), none), none), entry(F.lit("result.unit"), of, none))
    path = lambda i, name: F.concat(F.lit("result.rows."), i.cast("string"), F.lit(name))
    rows = F.flatten(F.transform(r["rows"], lambda x, i: F.array(entry(path(i, ".value"), shown(x["value"], valued), valued), entry(path(i, ".label"), x["label"], none))))
    return F.map_from_entries(F.filter(F.concat(head, rows), lambda e: e["value"]["text"].isNotNull()))


def figures(paths: Column) -> Column:
    """`result_paths` as entries to inline: path, text, unit, as streaming.events.rewrite_answers takes them."""
    return F.transform(F.map_entries(paths), lambda e: F.struct(e["key"].alias("path"), e["value"]["text"].alias("text"), e["value"]["unit"].alias("unit")))
