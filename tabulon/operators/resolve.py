"""Which incoming field is which field of the schema: signals, the margin rule, first inference and drift."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import fold_label, label_similarity
from ..functions.vectors import cosine
from ..model import SPECIFICITY, FieldSpec

WIDTH, ADDITIONS = 40, 8


@dataclass(frozen=True)
class Thresholds:
    """From which scores a signal fires, under which a field is surely new, and by how much the best must lead."""

    string_map: float = 0.88
    embedding_map: float = 0.88
    string_new: float = 0.80
    embedding_new: float = 0.80
    margin: float = 0.05


def types_agree(incoming: Column, existing: Column, currency_default: Column) -> Column:
    return (incoming == existing) | ((incoming == "number") & (existing == "currency") & currency_default.isNotNull())


def score_pairs(incoming: DataFrame, schema: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Every incoming field (key, label, type, vector) with every field of the schema, which has WIDTH rows at most and is broadcast; a wider one is an error.

    schema: field_key, field_label, field_type, aliases, currency_default, field_vector.
    """
    if schema.count() > WIDTH:
        raise ValueError(f"a schema has at most {WIDTH} fields")
    pairs = incoming.crossJoin(F.broadcast(schema))
    mine = [fold_label(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in order])) for order in (("key", "label"), ("label", "key"))]
    own = F.array(fold_label(F.col("field_key")), fold_label(F.col("field_label")))
    known = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: fold_label(a))
    exact = F.array_contains(own, mine[0]) | F.array_contains(own, mine[1])
    alias = ~exact & (F.array_contains(known, mine[0]) | F.array_contains(known, mine[1]))
    string = F.greatest(label_similarity(F.coalesce("label", "key"), F.col("field_label")), label_similarity(F.coalesce("key", "label"), F.col("field_key")))
    both = F.col("vector").isNotNull() & F.col("field_vector").isNotNull()
    pairs = pairs.withColumn("exact", exact).withColumn("alias", alias).withColumn("string", string).withColumn("embedding", F.when(both, cosine(F.col("vector"), F.col("field_vector"))))
    certain = F.col("exact") | F.col("alias")
    by_string, by_vector = F.col("string") >= t.string_map, F.coalesce(F.col("embedding") >= t.embedding_map, F.lit(False))
    headline = F.when(certain, 1.0).otherwise(F.greatest("string", F.coalesce("embedding", F.lit(0.0))))
    return pairs.select("*", certain.alias("certain"), (certain | by_string | by_vector).alias("fired"), headline.alias("headline"), types_agree(F.col("type"), F.col("field_type"), F.col("currency_default")).alias("agree"))


def classify(pairs: DataFrame, keys: list[str], t: Thresholds = Thresholds()) -> DataFrame:
    """map, add or ask (with a reason) for each incoming field, from its scored pairs."""
    cols = ["certain", "headline", "fired", "agree", "string", "embedding", "field_key"]
    ranked = F.sort_array(F.collect_list(F.struct("certain", "headline", *cols[2:])), False)
    out = pairs.groupBy(*keys).agg(ranked.alias("r"), F.bool_and("fired").alias("all_"), F.max("string").alias("ms"), F.max("embedding").alias("me"), F.count("embedding").alias("ne"), F.count("*").alias("n"))
    best, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    lead = second.isNull() | (best["certain"] & ~second["certain"]) | ((best["certain"] == second["certain"]) & (best["headline"] - second["headline"] >= t.margin))
    new = (F.col("ms") < t.string_new) & (F.coalesce("me", F.lit(0.0)) < t.embedding_new)
    verdict = F.when(best["fired"] & lead & best["agree"], "map").when(best["fired"], "ask").when(new & (F.col("ne") == F.col("n")), "add").otherwise("ask")
    reason = F.when(best["fired"] & ~best["agree"], "type_mismatch").when(best["fired"] & ~lead, "competing").when(~best["fired"] & new & (F.col("ne") < F.col("n")), "unconfirmed_novelty").when(~best["fired"] & ~new, "borderline")
    return out.select(*keys, verdict.alias("verdict"), reason.alias("reason"), best["field_key"].alias("target"), best["headline"].alias("headline"))


def observations(extracted: DataFrame) -> DataFrame:
    """Of each raw key: in how many documents, its most frequent label, and its type (ties go to the more specific)."""
    rank = F.coalesce(*[F.when(F.col("value_type") == s, F.lit(-k)) for k, s in enumerate(SPECIFICITY)])
    # what documents say of a key is much alike, so equal ones are counted first and the rest of the work is on few rows
    said = extracted.where("key is not null").groupBy("document_id", "key").agg(F.sort_array(F.collect_list(F.struct("label", "value_type"))).alias("said"))
    alike = said.groupBy("key", "said").agg(F.count("document_id").alias("documents"), F.count("*").alias("n"))
    rows = alike.select("key", "documents", "n", F.posexplode("said").alias("place", "s")).select("key", "n", "s.label", "s.value_type", F.when(F.col("place") == 0, F.col("documents")).alias("documents"))
    counts = rows.groupingSets([["key", "label"], ["key", "value_type"], ["key"]], "key", "label", "value_type").agg(F.grouping("label").alias("no_label"), F.grouping("value_type").alias("no_type"), F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    by = lambda c, test, order: F.max_by(c, F.when(test, order))
    labelled, typed = F.col("no_label") == 0, F.col("no_type") == 0
    return counts.groupBy("key").agg(F.max(F.when(~labelled & ~typed, F.col("documents"))).alias("documents"), by("label", labelled, F.struct("n", "label")).alias("label"), by("value_type", typed, F.struct(F.col("n"), rank)).alias("type"))


@lru_cache(maxsize=1 << 16)
def _indel(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for i, y in enumerate(b):
            row.append(last[i] + 1 if x == y else max(last[i + 1], row[i]))
        last = row
    return 2 * last[-1] / (len(a) + len(b))


@lru_cache(maxsize=1 << 16)
def _words(label: str) -> str:
    from ..functions.labels import FILLER

    words = "".join(c if c.isalnum() else " " for c in label.lower()).split()
    return " ".join(sorted([w for w in words if w not in FILLER] or words))


@lru_cache(maxsize=1 << 16)
def _fold(label: str) -> str:
    return "_".join("".join(c if c.isalnum() else " " for c in label.lower()).split())


def unify(seen: Sequence[tuple[str, str, str, int]], schema: Sequence[FieldSpec] = (), t: Thresholds = Thresholds(), additions: int = WIDTH) -> tuple[list[FieldSpec], list[tuple[str, str]]]:
    """The schema after (key, label, type, documents), taken one after the other, since a later field may meet an earlier one.

    Returns it and (key, verdict) pairs: map, add, or drop beyond `additions`. A field that is unsure is added: split, never merged.
    This runs over the distinct keys of one workspace, a few hundred rows, not over values.
    """
    fields, made, new = list(schema), [], 0
    for key, label, kind, _ in seen:
        scored = []
        for k, f in enumerate(fields):
            names = {_fold(f.key), _fold(f.label), *map(_fold, f.aliases)}
            certain = _fold(key) in names or _fold(label) in names
            string = max(_indel(_words(label), _words(f.label)), _indel(_words(key), _words(f.key)))
            scored.append((certain, 1.0 if certain else string, -k))
        scored.sort(reverse=True)
        target = None
        if scored and (scored[0][0] or scored[0][1] >= t.string_map):
            lead = len(scored) == 1 or (scored[0][0] and not scored[1][0]) or (scored[0][0] == scored[1][0] and scored[0][1] - scored[1][1] >= t.margin)
            f = fields[-scored[0][2]]
            if lead and (f.type == kind or (kind == "number" and f.type == "currency" and f.currency_default)):
                target = -scored[0][2]
        if target is not None:
            f = fields[target]
            names = [n for n in dict.fromkeys((key, label)) if n not in (f.key, f.label, *f.aliases)]
            fields[target] = replace(f, aliases=(*f.aliases, *names))
            made.append((key, "map"))
        elif new < additions and key not in {f.key for f in fields}:
            fields.append(FieldSpec(key, label, kind, currency_default="USD" if kind == "currency" else None))
            made.append((key, "add"))
            new += 1
        else:
            made.append((key, "drop"))
    return fields, made


def propose(observed: DataFrame) -> DataFrame:
    """The first schema of each workspace (rows with workspace_id): keys by coverage, unified one after the other."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["documents", "key"], ascending=[False, True])
        fields, _ = unify([tuple(r) for r in rows[["key", "label", "type", "documents"]].itertuples(index=False)])
        return pd.DataFrame([(pdf["workspace_id"].iloc[0], k, f.key, f.label, f.type, list(f.aliases), f.currency_default, f.weight) for k, f in enumerate(fields[:WIDTH])], columns=["workspace_id", "position", "field_key", "field_label", "field_type", "aliases", "currency_default", "weight"])

    return observed.groupBy("workspace_id").applyInPandas(fold, "workspace_id string, position int, field_key string, field_label string, field_type string, aliases array<string>, currency_default string, weight double")


def map_onto(extracted: DataFrame, schema: Sequence[FieldSpec]) -> DataFrame:
    """Extracted fields under the schema's keys; the first claim of a document on a field stays. The alias table has a few rows per field."""
    from pyspark.sql import Window as W

    names = {n.lower(): f.key for f in reversed(schema) for n in (*f.aliases, f.label, f.key)}
    table = F.broadcast(extracted.sparkSession.createDataFrame(list(names.items()) or [("", "")], "name string, field_key string"))
    by_key = extracted.join(table.withColumnRenamed("field_key", "by_key"), F.lower("key") == F.col("name"), "left").drop("name")
    both = by_key.join(table.withColumnRenamed("field_key", "by_label"), F.lower("label") == F.col("name"), "left").drop("name")
    both = both.withColumn("field_key", F.coalesce("by_key", "by_label")).drop("by_key", "by_label").where("field_key is not null")
    first = F.row_number().over(W.partitionBy("document_id", "field_key").orderBy("page_index", "line_no", "key"))
    return both.withColumn("r", first).where("r = 1").drop("r")
