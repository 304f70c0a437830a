"""Audit of filters that run one after the other: what each removes in every order, from a histogram of failure masks."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
MOST_FILTERS = 7


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 100


def repetitive(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)


def shouting(text: Column, words: Column) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text)


def odd_signs(text: Column, words: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: What makes a document fail, by the filter's letter, from its text and words; the copy filter comes after these.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": few_words, "B": repetitive, "C": shouting, "D": odd_signs}


def failure_masks(docs: DataFrame, scratch: Scratch, *, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): how many rows of a document fail which filters; bit k of the mask is the k-th filter, the highest one the copy filter.

    A row is a copy if an equal text has a smaller doc_id anywhere in the table. Texts are grouped by their SHA-256, once, for the
    minimum; the rows that hold it are found by joining on digest and doc_id, so a text with many copies isn't gathered in a task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.split(F.trim(text, F.lit(BLANKS)), SPACE)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.array_remove(words, "").alias("words"))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    rows = scratch.keep(rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    known = rows.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    counted = known.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")).join(first, ["digest", "doc_id"], "left")
    copy = F.when(F.col("first").isNull(), 1 << len(filters)).otherwise(0)
    unknown = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select(F.lit(None).cast("long").alias("doc_id"), "part", "mask", "n")
    return counted.select("doc_id", "part", (F.col("mask") + copy).alias("mask"), "n").unionByName(unknown)


def histogram(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 2^filters cells per part. A document is good, or toxic, if any of its label rows says so."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    with_id, without = masks.where("doc_id is not null"), masks.where("doc_id is null")
    marked = with_id.join(known, "doc_id", "left").unionByName(without.withColumns({c: F.lit(None).cast("int") for c in ("good", "toxic")}))
    sums = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def orders_of(cells: DataFrame, letters: str) -> DataFrame:
    """All orders of the filters with their steps, counted from the cells of each part alone: every row reads at most 2^filters sums."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    bit_of = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), letter) - 1)
    steps = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    before = F.aggregate(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), F.lit(0), lambda m, x: F.when(x == "", m).otherwise(m.bitwiseOR(bit_of(x))))
    steps = steps.select("*", bit_of(F.substring("filter_order", F.col("step"), F.lit(1))).alias("bit"), before.alias("before"))

    def total(of: Callable[[Column], Column], where: Callable[[Column, Column], Column]) -> Column:
        """Sum over the cells; `where` gets a cell's bits of this filter, and of those before it."""
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(where(c["mask"].bitwiseAND(F.col("bit")), c["mask"].bitwiseAND(F.col("before"))), of(c)).otherwise(F.lit(0).cast("long")))

    gone = lambda own, prior: (own != 0) & (prior == 0)
    alone = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["mask"] == F.col("bit"), c["n"]).otherwise(F.lit(0).cast("long")))
    # of all orders, each filter that a document fails comes first of those equally often
    share = lambda c: F.expr(f"{factorial(len(letters))}L") * c["n"] / F.bit_count(c["mask"])
    shapley = F.aggregate("cells", F.lit(0.0), lambda a, c: a + F.when(c["mask"].bitwiseAND(F.col("bit")) != 0, share(c)).otherwise(0.0))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: c["n"], lambda own, prior: (own == 0) & (prior == 0)).alias("kept"), total(lambda c: c["n"], gone).alias("removed"),
        total(lambda c: c["n"], lambda own, prior: (own != 0) & (prior != 0)).alias("redundant"), alone.alias("unique_fails"),
        total(lambda c: c["good"], gone).alias("good_lost"), total(lambda c: c["toxic"], gone).alias("toxic_lost"), shapley.cast("long").alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, *, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Built-in expressions make a mask of the filters that a row fails; masks are counted by part; orders and steps read those counts
    alone, so the work on texts doesn't grow with the number of orders. filters: letter to condition, `copies` is the letter of the
    filter of exact copies; seven filters at most (5,040 orders).

    A null text is empty: no words, no capitals. A null part is the empty string. A null doc_id is no copy, makes none and has no
    labels. Rows that repeat a doc_id count each; none of them makes another a copy. An empty table gives no rows.
    Other columns are ignored.
    """
    letters = "".join(filters) + copies
    if len(set(letters)) != len(letters) or len(letters) != len(filters) + 1 or len(letters) > MOST_FILTERS:
        raise ValueError(f"one letter for each of at most {MOST_FILTERS} filters: {letters!r}")
    masks = failure_masks(docs, Scratch(docs.sparkSession, "audit"), filters=filters, id_col=id_col, text_col=text_col, part_col=part_col)
    return orders_of(histogram(masks, labels), letters)


def oracle() -> str:
    """The same for DuckDB, by counting documents for every order and step."""
    return """
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
m as (
  select doc_id, part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask
  from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as b),
o as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from f a, f b, f c, f d, f e
  where a.b | b.b | c.b | d.b | e.b = 31),
s as (select filter_order, step, bits[step] as bit, list_sum(bits[1:step - 1]) as before from o, (select unnest([1, 2, 3, 4, 5])::int as step)),
x as (
  select part, filter_order, step, bit, mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (mask & coalesce(before, 0)::int) = 0 as came, (mask & bit) <> 0 as fails
  from m left join l using (doc_id), s),
r as (
  select part, filter_order, step, bit, count(*) filter (came and not fails) as kept, count(*) filter (came and fails) as removed, count(*) filter (fails and not came) as redundant,
    count(*) filter (mask = bit) as unique_fails, coalesce(sum(good) filter (came and fails), 0)::bigint as good_lost, coalesce(sum(toxic) filter (came and fails), 0)::bigint as toxic_lost
  from x group by all)
select * exclude (bit), (sum(removed) over (partition by part, bit))::bigint as shapley from r"""
