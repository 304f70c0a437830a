"""Packing along a space-filling curve: neighbours on the curve share sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords
from .encode import PieceEncoder
from .store import Scratch

LENGTH, END_ID = 4096, 2
DIMS, BITS = 4, 12


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of `points`, whose coordinates have `bits` bits (Skilling's transform)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(column: pa.Array) -> np.ndarray:
    """Each text's words as a hashed vector of signs in a few dimensions, squashed to a grid, as a place on the curve."""
    keys = []
    for i, j, data, bounds in bytewords.chunks(column):
        w = bytewords.words(bytewords.LOWER[data], bounds, bytewords.ALNUM)
        h = w.hashes()
        n = np.bincount(w.text, minlength=j - i)
        grid = np.zeros((j - i, DIMS))
        for d in range(DIMS):
            sign = ((h >> np.uint64(d)) & np.uint64(1)).astype(np.float64) * 2 - 1
            grid[:, d] = np.bincount(w.text, weights=sign, minlength=j - i)
        z = grid / np.sqrt(np.maximum(n, 1))[:, None] / 2
        keys.append(hilbert(np.floor((z / (1 + np.abs(z)) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)))
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)


#: Bits of a curve place that name its stretch; there is one sum of bytes for each stretch.
STRETCH = 16
SLICES = 1 << 20


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, pa.array(curve_keys(text), pa.int64())], names=["doc_id", "text", "key"])


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{n} long" for n in NAMES)


class Packer:
    """Fills sequences one after the other; `close` cuts the last one into sequences of powers of two, which need no padding."""

    def __init__(self, length: int, first: int) -> None:
        self.length, self.sequence, self.fill = length, first, 0
        self.rows: list[tuple] = []
        self.open: list[tuple[int | None, int, np.ndarray, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            piece = ids[at : at + self.length - self.fill]
            self.open.append((doc_id, at, piece, len(ids)))
            at += len(piece)
            self.fill += len(piece)
            if self.fill == self.length:
                self._emit(self.open)
                self.open, self.fill = [], 0

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def close(self) -> None:
        rest, left = self.open, self.fill
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part, after = [], []
            for doc_id, start, ids, total in rest:
                head, tail = ids[:size], ids[size:]
                size -= len(head)
                if len(head):
                    part.append((doc_id, start, head, total))
                if len(tail):
                    after.append((doc_id, start + len(head), tail, total))
            self._emit(part)
            rest = after
        self.open, self.fill = [], 0

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)


def _pack(tokenizer: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer)
        end = np.array([end_id], dtype="<u4")
        packer = Packer(length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                    packer.add(doc_id, np.concatenate([np.frombuffer(raw, dtype=encoder.kind).astype("<u4"), end]))
                yield packer.batch()
        packer.close()
        yield packer.batch()

    return run


def pack_documents(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are dealt once, by ranges of their place on a Hilbert curve that hold about as many bytes each; a stretch of the curve
    that fills several ranges, as copies do, is spread over them by a hash of the rows. A range is sorted, encoded and packed in the
    curve's order. A full sequence has `length` tokens; what is left at the end of a range is cut into sequences
    of powers of two, so nothing is padded. A null or empty text is the end id alone. Rows that repeat a doc_id are packed each.
    A null doc_id is packed and stays null. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.mapInArrow(_keyed, "doc_id long, text string, key long")
    size, slice_ = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES))
    stretch = F.shiftright("key", DIMS * BITS - STRETCH).cast("int")
    keyed = Scratch(spark, "packing").keep(keyed.select("*", size.alias("size"), slice_.alias("slice"), stretch.alias("stretch")), "keyed")
    sums = keyed.groupBy("stretch").agg(F.sum("size").alias("w")).orderBy("stretch").collect()  # 2^STRETCH rows at most
    ends = np.cumsum([r.w for r in sums]).tolist()
    target = max(1, -(-ends[-1] // n)) if ends else 1
    places = spark.createDataFrame([(r.stretch, e - r.w, r.w) for r, e in zip(sums, ends, strict=True)], "stretch int, before long, w long")
    # a stretch at a cut, or of more than one range, is dealt by the hash of its rows
    place = F.expr(f"cast((before + slice / {SLICES}D * w) / {target} as int)")
    dealt = keyed.join(F.broadcast(places), "stretch").select("doc_id", "text", "key", F.least(place, F.lit(n - 1)).alias("range"))
    dealt = dealt.repartitionById(n, "range").sortWithinPartitions("key", "doc_id")
    return dealt.select("doc_id", "text").mapInArrow(_pack(tokenizer, length, end_id), SCHEMA)
