"""Vectors, boxes and figures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 512
#: Rows that a task turns into vectors at a time, and words whose buckets it remembers.
ROWS_HELD, WORDS_KNOWN = 500, 200_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """From 0 to 1; 0 for absent vectors, unequal lengths and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norms > 0)
    return F.coalesce(F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norms))), F.lit(0.0))


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def lexical_vector(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Hashed bag of words: a bucket by blake2b, weight 1 + ln(count), unit length; null without words. Vectors leave ROWS_HELD at a time."""
    seen: dict[str, int] = {}
    for batch in batches:
        for at in range(0, len(batch), ROWS_HELD) or (0,):
            rows = batch.slice(at, ROWS_HELD).to_pylist()
            vectors, none = np.zeros((len(rows), DIMENSIONS)), np.zeros(len(rows), bool)
            for k, words in enumerate(rows):
                counts: dict[int, int] = {}
                for w in words or ():
                    if w not in seen:
                        if len(seen) >= WORDS_KNOWN:
                            seen.clear()
                        seen[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % DIMENSIONS
                    counts[seen[w]] = counts.get(seen[w], 0) + 1
                none[k] = not counts
                if counts:
                    vectors[k, list(counts)] = 1 + np.log(np.array(list(counts.values())))
                    vectors[k] /= np.linalg.norm(vectors[k])
            ends = np.concatenate([[0], np.cumsum(np.where(none, 0, DIMENSIONS))])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(vectors[~none].ravel()), mask=pa.array(none))


def box(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    return F.struct(x0.alias("x0"), top.alias("top"), x1.alias("x1"), bottom.alias("bottom"))


def union_box(boxes: Column) -> Column:
    edge = lambda f, name: f(F.transform(boxes, lambda b: b[name]))
    return box(edge(F.array_min, "x0"), edge(F.array_min, "top"), edge(F.array_max, "x1"), edge(F.array_max, "bottom"))


def overlaps_vertically(a: Column, b: Column, tolerance: float = 0.5) -> Column:
    return (F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])) > -tolerance


def figure(n: Column, unit_: Column) -> Column:
    """Thousands separators, two decimals unless integral, the unit behind."""
    shown = F.when(n == F.round(n), F.format_number(n, 0)).otherwise(F.format_number(n, 2))
    return F.concat_ws(" ", shown, unit_)
