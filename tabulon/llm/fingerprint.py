"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph has two vectors: lanes of 64 bits drawn from a 128-bit hash of its bytes, and signed counts of its hashed word pairs.
A text's fingerprint is the sum of its paragraphs' vectors modulo 2^64 and 2^16, whatever their order; paragraphs are added and taken away
by adding and subtracting their vectors. The first part tells equality, the second how alike two texts are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords

STRONG, COUNTS = 32, 128
WIDTH = STRONG + COUNTS
_U = np.uint64
#: The strong part is read as so many lanes of 64 bits.
LANES = STRONG // 4
_STEP = (np.arange(1, LANES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[None, :]


def vectors(texts: list[str]) -> np.ndarray:
    """The fingerprint of each text, a row of WIDTH lanes (uint16)."""
    out = np.zeros((len(texts), WIDTH), dtype=np.uint16)
    column = pa.array(texts, pa.large_string())
    for i, j, data, bounds in bytewords.chunks(column):
        breaks = np.flatnonzero(data == 10)
        edges = np.unique(np.concatenate([bounds, breaks, breaks + 1]))
        edges = edges if len(edges) > 1 else np.array([0, len(data)])
        w = bytewords.words(data, edges, bytewords.NOT_SPACE)
        doc_of = np.searchsorted(bounds, edges[:-1], side="right") - 1
        h = w.hashes()
        last = np.ones(len(h), dtype=bool)
        last[:-1] = w.text[1:] != w.text[:-1]
        first = np.ones(len(h), dtype=bool)
        first[1:] = last[:-1]
        pair = bytewords.mix(h * _U(3) + np.where(last, _U(0), np.roll(h, -1) * _U(0xD6E8FEB86659FD93)))
        used = ~last | first  # a pair, or the only word of a paragraph
        doc, pair = doc_of[w.text[used]], pair[used]
        lane = (pair & _U(COUNTS - 1)).astype(np.int64)
        sign = ((pair >> _U(32)) & _U(1)).astype(np.int64) * 2 - 1
        counts = np.bincount(doc * COUNTS + lane, weights=sign, minlength=(j - i) * COUNTS).astype(np.int64)
        out[i:j, STRONG:] = counts.reshape(j - i, COUNTS).astype(np.uint16)
        raw = data.tobytes()
        cuts = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        keep = [k for k, (a, b) in enumerate(cuts) if b - a != 1 or raw[a] != 10]
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[cuts[k][0] : cuts[k][1]]) for k in keep), dtype=np.uint64).reshape(-1, 2)
        lanes = (bytewords.mix((digests[:, :1] + _STEP).ravel()) + bytewords.mix((digests[:, 1:] ^ _STEP).ravel())).reshape(-1, LANES)
        owner = doc_of[keep]
        sums = np.zeros((j - i, LANES), dtype=np.uint64)
        np.add.at(sums, owner, lanes)
        out[i:j, :STRONG] = sums.astype("<u8").view("<u2")
    return out


def to_text(vector: np.ndarray) -> str:
    return base64.b64encode(vector.astype("<u2").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u2").astype(np.uint16)


def combined(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """The rows of a with those of b added, or taken away with sign -1: the strong part modulo 2^64, the counts modulo 2^16."""
    strong = [np.ascontiguousarray(x[..., :STRONG]).view(np.uint64) for x in (a, b)]
    counts = [x[..., STRONG:] for x in (a, b)]
    strong, counts = (p[0] + p[1] if sign > 0 else p[0] - p[1] for p in (strong, counts))
    return np.concatenate([strong.view(np.uint16), counts], axis=-1)


def insert(fingerprint: str, text: str) -> str:
    """The fingerprint of a text after the paragraphs of `text` (its lines) are added, wherever they stand."""
    return to_text(combined(from_text(fingerprint), vectors([text])[0]))


def delete(fingerprint: str, text: str) -> str:
    """The fingerprint of a text after the paragraphs of `text` are taken out."""
    return to_text(combined(from_text(fingerprint), vectors([text])[0], -1))


def _edited(sign: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            change = vectors([t or "" for t in batch.column("text").to_pylist()])
            now = [None if f is None else to_text(combined(from_text(f), c, sign)) for f, c in zip(batch.column("fingerprint").to_pylist(), change, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(now, pa.string())], names=["doc_id", "fingerprint"])

    return run


def update_fingerprints(held: DataFrame, edits: DataFrame, *, remove: bool = False) -> DataFrame:
    """held (doc_id, fingerprint) and edits (doc_id, text) -> doc_id, fingerprint after each edit's lines are added or, with `remove`, taken out.

    Edits of one document are put together before the join, a row per document: sums don't depend on order. Documents without edits
    keep theirs; a null text changes nothing, a null doc_id meets no edit. The texts themselves are not read again.
    """
    lines = edits.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    return held.select("doc_id", "fingerprint").join(lines, "doc_id", "left").mapInArrow(_edited(-1 if remove else 1), "doc_id long, fingerprint string")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common word pairs, intersection by union, of rows of fingerprints; 1 for equal ones."""
    x, y = a[:, STRONG:].view(np.int16), b[:, STRONG:].view(np.int16)
    d = (a[:, STRONG:] - b[:, STRONG:]).view(np.int16).astype(np.float64)
    both, apart = (x.astype(np.float64) ** 2).sum(1) + (y.astype(np.float64) ** 2).sum(1), (d**2).sum(1)
    share = np.clip((both - apart) / np.maximum(both + apart, 1e-9), 0, 1)
    return np.where((a == b).all(1), 1.0, share)


def edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def _bucketed(bounds: list[int], before: dict[int, int], first: dict[int, int]):
    """Rows with their bucket; the first rows of a bucket also as the followers (kind 1) of the bucket before."""
    edges = np.array(bounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_numpy()
            bucket = np.searchsorted(edges, k, side="left")
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.zeros(len(k), dtype=np.int64)), *batch.columns], names=["bucket", "kind", *batch.schema.names])
            heads = [i for i in range(len(k)) if first.get(int(bucket[i])) == int(k[i])]
            if heads:
                rows = batch.take(pa.array(heads, pa.int64()))
                to = pa.array([before[int(bucket[i])] for i in heads], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(heads), dtype=np.int64)), *rows.columns], names=["bucket", "kind", *batch.schema.names])

    return run


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: tuple | None = None

    def rows(ready: list[tuple]) -> pa.RecordBatch:
        own = vectors([t for _, t, _ in ready])
        changed = [edited(t, n) for _, t, n in ready]
        other, after = vectors(changed), vectors([n for _, _, n in ready[-1:]])
        following = np.concatenate([own[1:], after])
        for i in range(len(ready) - 1):  # neighbours in a batch are each other's next, but where a bucket ends
            if ready[i][2] is not ready[i + 1][1]:
                following[i] = vectors([ready[i][2]])[0]
        columns = [[d for d, _, _ in ready], [len(t) for _, t, _ in ready], [hashlib.sha256(c.encode()).hexdigest() for c in changed], [to_text(v) for v in own], [to_text(v) for v in other], likeness(own, other), likeness(own, following)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=NAMES)

    for whole in batches:
        for i in range(0, len(whole), 200):
            ready = []
            batch = whole.slice(i, 200)
            for bucket, kind, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("bucket", "kind", "doc_id", "text")], strict=True):
                if waiting is not None and waiting[0] == bucket:
                    ready.append((waiting[1], waiting[2], text))
                    waiting = None
                if not kind:
                    waiting = (bucket, doc_id, text)
            if ready:
                yield rows(ready)


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first ones of the next document in doc_id order;
    the last document's next is the first. The text is dealt once, into buckets of consecutive doc_ids; the head of each bucket also
    goes to the bucket before it. Only the buckets' bounds, a few numbers each, come to the driver.

    A null text is empty. A null doc_id orders before all others. Rows that repeat a doc_id follow each other in the order of
    their texts. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = rows.select("k").stat.approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n)
    bounds = sorted({int(c) for c in cuts})

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_numpy()
            bucket = np.searchsorted(np.array(bounds, dtype=np.int64), k, side="left")
            order = np.lexsort((k, bucket))
            some, at = np.unique(bucket[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(k[order][at], pa.int64())], names=["bucket", "k"])

    first = {r.bucket: r.k for r in rows.select("k").mapInArrow(head, "bucket long, k long").groupBy("bucket").agg(F.min("k").alias("k")).collect()}
    filled = sorted(first)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    dealt = rows.mapInArrow(_bucketed(bounds, before, first), "bucket int, kind long, k long, doc_id long, text string")
    dealt = dealt.repartitionById(n, "bucket").sortWithinPartitions("bucket", "kind", "k", "text")
    return dealt.mapInArrow(_compare, SCHEMA)
