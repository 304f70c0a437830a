"""Token-ID files: raw id payloads in shards, each with a minimal perfect hash index over its document keys.

A shard is two files. `part-N.ids` holds the ids of its documents one after the other, little-endian, 2 bytes each where the
vocabulary fits and 4 otherwise. `part-N.idx` holds a JSON header line and arrays: the hash levels (bits and ranks), for each slot
the fingerprint and the record of its key, for each record its key, whether it has one, and where it begins.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import mix
from .encode import PieceEncoder

END_ID = 2
_U = np.uint64
#: Distinct pieces that a worker keeps: a task holds little else beside them.
KEPT = 400_000
READ = 4 << 20


@dataclass
class PerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1: at each level a key that is alone at its place stays, the others go on to the next level."""

    bits: list[np.ndarray] = field(default_factory=list)
    ranks: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + _U((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        out, total = cls(), 0
        while len(keys):
            size = -(-2 * len(keys) // 64) * 64
            at = cls._place(keys, len(out.bits), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            out.bits.append(words)
            out.ranks.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())
            keys = keys[~alone[at]]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key surely isn't one of the n; other strangers get a slot whose fingerprint tells."""
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            if not len(open_):
                break
            at = self._place(keys[open_], level, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1))).astype(np.int64)
            out[open_[here]] = (ranks[at >> 6] + below)[here]
            open_ = open_[~here]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _U(0x5851F42D4C957F2D)) >> _U(32)).astype(np.uint32)


class Shard:
    """Keyed access to one shard: slot by the perfect hash, fingerprint, record, and a read of just its ids."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.fs, self.path = fs, path
        with fs.open_input_file(f"{path}.idx") as f:
            raw = f.read()
        head, _, body = raw.partition(b"\n")
        self.spec, at, arrays = json.loads(head), 0, {}
        for name, kind, n in self.spec["arrays"]:
            arrays[name] = np.frombuffer(body, dtype=kind, count=n, offset=at)
            at += arrays[name].nbytes
        cut = self.spec["levels"]
        edges = np.cumsum([0, *cut])
        self.hash = PerfectHash([arrays["bits"][a:b] for a, b in zip(edges, edges[1:], strict=False)], [arrays["ranks"][a:b] for a, b in zip(edges, edges[1:], strict=False)])
        self.prints, self.record = arrays["prints"], arrays["record"]
        self.keys, self.keyed, self.begin = arrays["keys"], arrays["keyed"].astype(bool), arrays["begin"]
        self.kind = np.dtype(self.spec["kind"])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, -1 for keys that aren't there."""
        keys = keys.astype(np.int64).view(np.uint64)
        slots = self.hash.slots(keys)
        ok = slots >= 0
        ok[ok] = self.prints[slots[ok]] == fingerprints(keys[ok])
        return np.where(ok, self.record[np.where(ok, slots, 0)] if len(self.record) else -1, -1)

    def ids(self, record: int) -> np.ndarray:
        with self.fs.open_input_file(f"{self.path}.ids") as f:
            f.seek(int(self.begin[record]) * self.kind.itemsize)
            return np.frombuffer(f.read(int(self.begin[record + 1] - self.begin[record]) * self.kind.itemsize), dtype=self.kind)

    def payloads(self) -> Iterator[tuple[int, int, bytes, int]]:
        """(first record, end record, bytes, id at which they begin), in records' order."""
        n = len(self.begin) - 1
        with self.fs.open_input_file(f"{self.path}.ids") as f:
            i = 0
            while i < n:
                j = max(i + 1, int(np.searchsorted(self.begin, self.begin[i] + READ // self.kind.itemsize, side="right")) - 1)
                yield i, j, f.read(int(self.begin[j] - self.begin[i]) * self.kind.itemsize), int(self.begin[i])
                i = j


def crc_of_ids(raw: bytes, kind: np.dtype) -> int:
    return zlib.crc32(np.frombuffer(raw, dtype=kind).astype("<u4").tobytes())


def _write(uri: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        fs, folder = pafs.FileSystem.from_uri(uri)
        fs.create_dir(folder, recursive=True)
        encoder = PieceEncoder.of(tokenizer, KEPT)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        attempt = f"{folder}/.{shard}-{uuid.uuid4().hex}"
        keys, keyed, sizes = [], [], []
        with fs.open_output_stream(f"{attempt}.ids") as out:
            for batch in batches:
                ids = batch.column("doc_id")
                keyed.append(np.array(ids.is_valid().to_numpy(zero_copy_only=False), dtype=np.uint8))
                keys.append(ids.fill_null(0).to_numpy().astype("<i8"))
                for i in range(0, len(batch), 200):
                    coded = encoder.encode(batch.column("text").slice(i, 200).to_pylist())
                    out.write(b"".join(c + end for c in coded))
                    sizes.extend(len(c) // encoder.kind.itemsize + 1 for c in coded)
        if not sizes:
            fs.delete_file(f"{attempt}.ids")
            return
        key, has, begin = np.concatenate(keys), np.concatenate(keyed), np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
        distinct, first = np.unique(key[has == 1], return_index=True)
        first = np.flatnonzero(has)[first]
        wide = distinct.view(np.uint64)
        table = PerfectHash.build(wide)
        slots = table.slots(wide)
        prints, record = np.zeros(len(wide), dtype="<u4"), np.zeros(len(wide), dtype="<i8")
        prints[slots], record[slots] = fingerprints(wide), first
        none = np.zeros(0, dtype="<u8")
        arrays = {"bits": np.concatenate([none, *table.bits]), "ranks": np.concatenate([none.astype("<i8"), *table.ranks]), "prints": prints, "record": record, "keys": key, "begin": begin, "keyed": has}
        head = {"kind": encoder.kind.str, "levels": [len(b) for b in table.bits], "arrays": [[name, a.dtype.str, len(a)] for name, a in arrays.items()]}
        with fs.open_output_stream(f"{attempt}.idx") as out:
            out.write(json.dumps(head).encode() + b"\n" + b"".join(a.tobytes() for a in arrays.values()))
        for kind in ("ids", "idx"):  # a task that runs again puts equal files in place
            fs.move(f"{attempt}.{kind}", f"{folder}/part-{shard}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(sizes), int(begin[-1]))], names=["shard", "n_docs", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, uri: str, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> list[tuple[int, int]]:
    """Writes the shards in ascending doc_id order; returns (shard, ids of all shards before it), a row per shard.

    The text is dealt once, by ranges of doc_id, then of the text's hash for rows that repeat one, and encoded where it lands. A null text
    is empty: its ids are the end id. A null doc_id comes first and isn't in the index. `uri` is a folder that every executor reaches.
    """
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    done = sorted((r.shard, r.n_tokens) for r in dealt.mapInArrow(_write(uri, tokenizer, end_id), "shard long, n_docs long, n_tokens long").collect())
    before, out = 0, []
    for shard, tokens in done:
        out.append((shard, before))
        before += tokens
    return out


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for number, before in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(), strict=True):
                shard = Shard(fs, f"{folder}/part-{number}")
                found = shard.find(shard.keys)
                again = np.arange(len(found)) - np.where(shard.keyed, found, np.arange(len(found)))  # rows of one doc_id follow each other
                if (shard.keyed & ((found < 0) | (again < 0))).any():
                    raise ValueError(f"part-{number}: a key isn't in its index")
                for i, j, raw, at in shard.payloads():
                    cut = (shard.begin[i : j + 1] - at) * shard.kind.itemsize
                    crc = [crc_of_ids(raw[a:b], shard.kind) for a, b in zip(cut, cut[1:], strict=False)]
                    keys = pa.array(shard.keys[i:j], pa.int64(), mask=~shard.keyed[i:j])
                    yield pa.RecordBatch.from_arrays([keys, pa.array(before + shard.begin[i:j]), pa.array(np.diff(shard.begin[i : j + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(spark: SparkSession, uri: str, shards: list[tuple[int, int]]) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32. A task reads a shard in pieces."""
    if not shards:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = spark.createDataFrame(shards, "shard long, before long").repartition(len(shards))
    return rows.mapInArrow(_read(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _bounds(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for number in batch.column("shard").to_pylist():
                shard = Shard(fs, f"{folder}/part-{number}")
                keys = shard.keys[shard.keyed]
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (number, int(keys[0]), int(keys[-1]))], names=["shard", "lo", "hi"])

    return run


def _routed(shards: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id").to_numpy()
            first, end = np.searchsorted(hi, keys, side="left"), np.searchsorted(lo, keys, side="right")
            n = np.maximum(end - first, 0)  # a doc_id of many rows may lie in several shards
            place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, n)), pa.array(shards[place])], names=["doc_id", "shard"])

    return run


def _fetch(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        shard = number = None
        for batch in batches:
            asked, of = batch.column("doc_id").to_numpy(), batch.column("shard").to_numpy()
            for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(of)) + 1).tolist()], [*cuts[1:], len(of)], strict=True):
                if a == b:
                    continue
                if number != of[a]:
                    number = int(of[a])
                    shard = Shard(fs, f"{folder}/part-{number}")
                for key, record in zip(asked[a:b].tolist(), shard.find(asked[a:b]).tolist(), strict=True):
                    while 0 <= record < len(shard.keys) and shard.keyed[record] and shard.keys[record] == key:
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([number]), pa.array([record]), pa.array([shard.ids(record).astype(np.int64)])], names=["doc_id", "shard", "record", "ids"])
                        record += 1

    return run


def lookup(keys: DataFrame, uri: str, shards: list[tuple[int, int]], *, id_col: str = "doc_id", spread: int = 8) -> DataFrame:
    """The rows of the given doc_ids: doc_id, shard, record, ids. Keyed access: of a shard the index and the ids asked for are read, no others.

    A key goes to the shard whose doc_ids lie around it (their bounds, two numbers a shard, go through the driver), finds its slot by
    the perfect hash, and is compared by fingerprint, then by the key itself. A doc_id that no shard holds has no row, nor has null; one asked
    for twice is answered once; one of several rows has them all. Keys of one shard are spread over `spread` tasks.
    """
    spark = keys.sparkSession
    out = "doc_id long, shard long, record long, ids array<long>"
    found = spark.createDataFrame([(n,) for n, _ in shards], "shard long").repartition(max(1, len(shards))).mapInArrow(_bounds(uri), "shard long, lo long, hi long").collect() if shards else []
    if not found:
        return spark.createDataFrame([], out)
    table = np.array(sorted(tuple(r) for r in found), dtype=np.int64)
    asked = keys.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    routed = asked.mapInArrow(_routed(table[:, 0], table[:, 1], table[:, 2]), "doc_id long, shard long")
    dealt = routed.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(spread))).sortWithinPartitions("shard", "doc_id")
    return dealt.mapInArrow(_fetch(uri), out)
