"""Fields that a document has beyond its schema: mapped, added or left out, one after the other within the document."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import FieldSpec, is_field_key
from .resolve import ADDITIONS, WIDTH, Thresholds, _fold, _indel, _words

#: Most names that a field gathers from documents.
ALIASES = 200
#: Of so many documents' fields a task remembers the verdicts.
REMEMBERED = 4096
ASSESSED = "key string, label string, type string, verdict string, target string, why string, nearest string, score double"


def _cosine(a: np.ndarray | None, b: np.ndarray | None) -> float | None:
    if a is None or b is None or len(a) != len(b):
        return None
    norms = float(np.linalg.norm(a) * np.linalg.norm(b))
    return min(1.0, max(0.0, float(a @ b) / norms)) if norms else 0.0


def judge(key: str, label: str, kind: str, vector: np.ndarray | None, fields: Sequence[FieldSpec], vectors: Mapping[str, np.ndarray], t: Thresholds) -> tuple[str, str | None, str | None, float]:
    """(map, add or ask; why asked; the nearest field; how near) of one field against a schema."""
    scored = []
    for k, f in enumerate(fields):
        names = {_fold(n) for n in (f.key, f.label, *f.aliases)}
        certain = _fold(key) in names or _fold(label) in names
        string = max(_indel(_words(label), _words(f.label)), _indel(_words(key), _words(f.key)))
        near = _cosine(vector, vectors.get(f.key))
        scored.append((certain, 1.0 if certain else max(string, near or 0.0), -k, string, near))
    if not scored:
        return "add", None, None, 0.0
    scored.sort(key=lambda s: s[:3], reverse=True)
    certain, best, place, string, near = scored[0]
    field = fields[-place]
    if certain or string >= t.string_map or (near is not None and near >= t.embedding_map):
        lead = len(scored) == 1 or (certain and not scored[1][0]) or (certain == scored[1][0] and best - scored[1][1] >= t.margin)
        agree = kind == field.type or (kind == "number" and field.type == "currency" and field.currency_default is not None)
        why = "type_mismatch" if not agree else None if lead else "competing"
        return ("ask" if why else "map"), why, field.key, best
    if max(s[3] for s in scored) >= t.string_new or max(s[4] or 0.0 for s in scored) >= t.embedding_new:
        return "ask", "borderline", field.key, best
    known = all(s[4] is not None for s in scored)
    return ("add" if known else "ask"), (None if known else "unconfirmed_novelty"), field.key, best


def assess(extras: DataFrame, schema: Sequence[FieldSpec], vectors: Mapping[str, Sequence[float]] | None = None, t: Thresholds = Thresholds(), most: int = ADDITIONS) -> DataFrame:
    """A row for each extra field of a document: map (with its target), add (with `why` where it was unsure), or drop.

    extras: document_id, page_index, line_no, key, label, type, and `vector` where labels are embedded (vectors: those of the schema's
    fields). A field added by the document is seen by its later ones; beyond `most` additions, and with an unusable key, one is dropped.
    A document's extra fields are one row, and many rows a batch; documents with equal fields are judged once in a task while it remembers them.
    """
    embedded = "vector" in extras.columns
    known = {k: np.asarray(v, dtype=float) for k, v in (vectors or {}).items()}
    keys = {f.key for f in schema}

    def judged(found: tuple) -> list[dict]:
        fields, held, own, added, rows = list(schema), dict(known), set(keys), 0, []
        for key, label, kind, vector in found:
            label = label or key
            if key in own:
                rows.append((key, label, kind, "map", key, None, key, 1.0))
                continue
            if not key or not is_field_key(key):
                rows.append((key, label, kind, "drop", None, "unusable_key", None, 0.0))
                continue
            vector = None if vector is None else np.asarray(vector, dtype=float)
            verdict, why, nearest, score = judge(key, label, kind, vector, fields, held, t)
            if verdict == "map":
                rows.append((key, label, kind, "map", nearest, None, nearest, score))
            elif added >= most:
                rows.append((key, label, kind, "drop", None, "too_many", nearest, score))
            else:
                fields.append(FieldSpec(key, label, kind, currency_default="USD" if kind == "currency" else None))
                own.add(key)
                added += 1
                if vector is not None:
                    held[key] = vector
                rows.append((key, label, kind, "add", key, why, nearest, score))
        return [dict(zip(names, r, strict=True)) for r in rows]

    names = [c.split()[0] for c in ASSESSED.split(", ")]

    @F.pandas_udf(f"array<struct<{ASSESSED.replace(' ', ':').replace(',:', ',')}>>")
    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decided = judged if embedded else lru_cache(maxsize=REMEMBERED)(judged)  # vectors are too long to remember many
        for fields in batches:
            yield fields.map(lambda found: decided(tuple((f["key"], f["label"], f["type"], f["vector"]) for f in found)))

    vector = F.col("vector") if embedded else F.lit(None).cast("array<double>")
    # as pandas sorts: what has no place comes last
    order = [x for c in ("page_index", "line_no", "key") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    field = F.struct(*order, "label", "type", vector.alias("vector"))
    rows = extras.groupBy("document_id").agg(F.sort_array(F.collect_list(field)).alias("f"))
    sent = F.transform("f", lambda f: F.struct(f["key"].alias("key"), f["label"].alias("label"), f["type"].alias("type"), f["vector"].alias("vector")))
    return rows.select("document_id", verdicts(sent).alias("v")).select("document_id", F.inline("v"))


def decisions(schema: Sequence[FieldSpec], assessed: DataFrame) -> DataFrame:
    """(verdict, key, target, n, label, type, place, kept): what documents decided, each once, the most frequent first.

    Of the added fields those are kept that fit in a schema of WIDTH, of the keys mapped to a field ALIASES; what isn't kept has a row that
    says so. Counts are aggregated before they are ranked.
    """
    known = [f.key for f in schema]
    made = assessed.where("verdict <> 'drop'").groupBy("verdict", "key", "target").agg(F.count("*").alias("n"), F.mode("label", True).alias("label"), F.mode("type", True).alias("type"))
    made = made.where(~((F.col("verdict") == "add") & F.col("key").isin(known)) & ~((F.col("verdict") == "map") & (F.col("key") == F.col("target"))))
    # adds have one rank, mappings one for each target: keys are many, so the limit is taken before the shuffle
    group = F.when(F.col("verdict") == "map", F.col("target"))
    ranked = made.withColumn("place", F.row_number().over(W.partitionBy("verdict", group).orderBy(F.desc("n"), "key", "target")))
    return ranked.withColumn("kept", F.col("place") <= F.when(F.col("verdict") == "add", max(0, WIDTH - len(known))).otherwise(ALIASES))


def merged_schema(schema: Sequence[FieldSpec], assessed: DataFrame) -> list[FieldSpec]:
    """The schema with the mapped keys as aliases and the added fields behind, the most frequent first. What comes back are `decisions` that are kept: at most WIDTH fields of ALIASES names."""
    fields = {f.key: f for f in schema}
    made = decisions(schema, assessed)
    added = made.where("verdict = 'add' and kept").orderBy("place").collect()
    fields |= {r.key: FieldSpec(r.key, r.label, r.type, currency_default="USD" if r.type == "currency" else None) for r in added}
    for r in made.where((F.col("verdict") == "map") & F.col("kept") & F.col("target").isin(list(fields))).orderBy("target", "place").collect():
        f = fields[r.target]
        if r.key not in f.names():
            fields[r.target] = replace(f, aliases=(*f.aliases, r.key))
    return list(fields.values())


def summaries(assessed: DataFrame) -> DataFrame:
    """(document_id, summary): what a document changed, in a sentence; near misses name the field they were kept apart from."""
    of = lambda test, text: F.array_join(F.array_sort(F.collect_list(F.when(test, text))), ", ")
    verdict, key, apart = F.col("verdict"), F.col("key"), F.col("why").isNotNull()
    named = lambda head, part: F.when(part != "", F.concat(F.lit(head), part))
    parts = F.concat_ws(
        "; ",
        named("mapped ", of((verdict == "map") & (key != F.col("target")), F.concat_ws(" to ", key, "target"))),
        named("added ", of((verdict == "add") & ~apart, key)),
        named("kept apart ", of((verdict == "add") & apart, F.concat(key, F.coalesce(F.concat(F.lit(" from "), "nearest"), F.lit(""))))),
        named("left out ", of(verdict == "drop", key)),
    )
    text = F.when(parts == "", "No schema change.").otherwise(F.concat(F.upper(F.substring(parts, 1, 1)), F.substring(parts, 2, 1 << 30), F.lit(".")))
    return assessed.groupBy("document_id").agg(text.alias("summary"))
