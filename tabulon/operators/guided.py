"""Extraction under a schema: each field takes the best of what a document offers, and the rest are extras."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import FILLER
from ..model import FieldSpec

LIKENESS, ABSENT_CONFIDENCE = 0.72, 0.4
#: Of so many labels, pairs of labels and documents' labels a task remembers what it found.
REMEMBERED = 1 << 14


@lru_cache(maxsize=REMEMBERED)
def _plain(label: str) -> str:
    words = "".join(c if c.isalnum() else " " for c in label.lower()).split()
    return " ".join([w for w in words if w not in FILLER] or words)


@lru_cache(maxsize=REMEMBERED)
def _likeness(wanted: str, label: str) -> float:
    return SequenceMatcher(None, wanted, label).ratio()


def pick(field: FieldSpec, offers: Sequence[tuple[str, str]]) -> int | None:
    """Which of (key, label) is the field: by key, by alias, else the most alike label of at least LIKENESS; the first of equals."""
    aliases = {a.lower() for a in field.aliases}
    for test in (lambda key: key == field.key, lambda key: key.lower() in aliases):
        for i, (key, _) in enumerate(offers):
            if test(key):
                return i
    wanted = _plain(field.label or field.key)
    ratios = [_likeness(wanted, _plain(label or key)) for key, label in offers]
    best = max(range(len(offers)), key=lambda i: ratios[i], default=None)
    return best if best is not None and ratios[best] >= LIKENESS else None


def guided(documents: DataFrame, extracted: DataFrame, schema: Sequence[FieldSpec]) -> DataFrame:
    """A row per document and field of the schema, with its type and a null text where nothing fits, and a row per field left over (extra).

    documents: document_id, one row each; extracted: as `extract` returns. Fields choose in the schema's order and a value is taken once.
    A document's values are one row, and many rows a batch; Python sees keys and labels only and says which value each field takes.
    """
    if not schema:
        return _rows(documents, extracted).select("document_id", F.inline(F.transform("offers", _extra)))

    def chosen(offers: tuple) -> list[int | None]:
        left, out = list(enumerate(offers)), []
        for f in schema:
            at = pick(f, [x for _, x in left])
            out.append(None if at is None else left.pop(at)[0])
        return out

    @F.pandas_udf("array<int>")
    def choice(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        remembered = lru_cache(maxsize=REMEMBERED)(chosen)
        for offers in batches:
            yield offers.map(lambda found: remembered(tuple((o["key"], o["label"]) for o in found)))

    rows = _rows(documents, extracted)
    rows = rows.select("document_id", "offers", choice(F.transform("offers", lambda o: F.struct(o["key"].alias("key"), o["label"].alias("label")))).alias("taken"))

    def own(f: FieldSpec, i: int) -> Column:
        at = F.get("taken", F.lit(i))
        o = F.get("offers", at)
        given = lambda c, absent=None: F.when(at.isNull(), F.lit(absent)).otherwise(o[c])
        return F.struct(
            F.lit(f.key).alias("field_key"), F.lit(f.label).alias("label"), given("value_text").alias("value_text"), F.lit(f.type).alias("value_type"), given("page_index", 0).cast("int").alias("page_index"),
            given("line_no").cast("int").alias("line_no"), given("confidence", ABSENT_CONFIDENCE).cast("double").alias("confidence"), given("quote").alias("quote"), F.lit(False).alias("extra"))

    left = F.transform(F.filter("offers", lambda _, i: ~F.exists("taken", lambda t: F.coalesce(t == i, F.lit(False)))), _extra)
    return rows.select("document_id", F.inline(F.concat(F.array(*[own(f, i) for i, f in enumerate(schema)]), left)))


def _extra(o: Column) -> Column:
    return F.struct(
        o["key"].alias("field_key"), o["label"].alias("label"), o["value_text"].alias("value_text"), o["value_type"].alias("value_type"), o["page_index"].cast("int").alias("page_index"),
        o["line_no"].cast("int").alias("line_no"), o["confidence"].cast("double").alias("confidence"), o["quote"].alias("quote"), F.lit(True).alias("extra"))


def _rows(documents: DataFrame, extracted: DataFrame) -> DataFrame:
    """(document_id, offers): the values of each document of either, in their order; one shuffle."""
    order = [x for c in ("page_index", "line_no", "key") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]  # what has no place comes last
    offers = extracted.select("document_id", F.struct(*order, "label", "value_text", "value_type", "confidence", "quote").alias("o"))
    both = documents.select("document_id", F.lit(None).cast(dict(offers.dtypes)["o"]).alias("o")).unionByName(offers)
    return both.groupBy("document_id").agg(F.sort_array(F.collect_list("o")).alias("offers"))
