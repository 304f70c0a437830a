"""Benchmark decontamination: CGK walks turn edit distance into Hamming distance, sampled places of the walks are hashed, hits are verified."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords
from .store import Scratch

#: Edits by words of the item, at most.
RATE = 0.2
#: Steps of a long walk, sampled steps besides the first, repetitions. A walk of 16 steps covers about 8 word pairs.
STEPS, SAMPLES, ROUNDS = 16, 2, 4
#: Items of so many words have long walks besides the short one.
LONG = 12
#: Benchmark bytes held at once; more are taken in blocks, each with a pass over the documents.
BLOCK = 16 << 20
CHUNK = 1 << 20
#: Entries of a sieve; what passes it by chance is found out by the whole key.
SIEVE = 1 << 20
_U = np.uint64


def _symbols(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, bytewords.Words]]:
    """(first row, end row, word hashes, hashes of word pairs, first word of each text and the end, words) of chunks of lower-cased texts."""
    for i, j, data, bounds in bytewords.chunks(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), CHUNK):
        w = bytewords.words(data, bounds, bytewords.ALNUM)
        h = w.hashes()
        pair = bytewords.mix(h * _U(3) + np.concatenate([h[1:], np.zeros(min(1, len(h)), dtype=np.uint64)]) * _U(0xD6E8FEB86659FD93))
        yield i, j, h, pair, w.first, w


def sampled_steps(turn: int) -> list[int]:
    return np.sort(np.random.default_rng(1000 + turn).choice(np.arange(1, STEPS), SAMPLES, replace=False)).tolist()


def rounds_of(words: int, rate: float) -> list[tuple[int, tuple[int, ...]]]:
    """(turn, sampled steps) of each repetition for items of so many words.

    e = rate * words edits leave a run of at least (words - e) / (e + 1) words whole. A walk from its first word reads nothing outside
    the run for as many steps as it has pairs, so a repetition that samples only those collides surely. At a rate of 0.2 these are
    one to three steps; of all random walks, these repetitions take the one that goes on at each step, as it reads most. Longer items also have walks of STEPS steps, which collide where edits are few.
    """
    edits = int(rate * words)
    pairs = max(1, min(3, -(-(words - edits) // (edits + 1)) - 1))
    sure = [(ROUNDS + pairs, tuple(range(1, pairs)))]
    return sure + [(turn, tuple(sampled_steps(turn))) for turn in range(ROUNDS)] * (words >= LONG)


def walk_keys(pair: np.ndarray, start: np.ndarray, last: np.ndarray, turn: int, steps: tuple[int, ...], sieves: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(places in `start`, keys, partial keys): of each walk, a key of its first symbol and its symbols at the sampled steps.

    A walk reads a symbol and, by a random bit of symbol and step, stays or goes on; equal stretches after an edit fall into step
    again. Past the last symbol (`last`) it reads a filler. With `sieves` (a table of partial keys for each sampled step) a walk ends
    where its partial key is none of theirs, as its key can't be either.
    """
    which, at, key, last = np.arange(len(start)), start.copy(), pair[start] * _U(turn * 2 + 1), last.copy()
    partial: list[np.ndarray] = []
    odd = np.random.default_rng(2000 + turn).integers(1, 2**63, STEPS, dtype=np.uint64) * _U(2) + _U(1)
    for step in range(max(steps, default=-1) + 1):
        inside = at <= last
        symbol = np.where(inside, pair[np.minimum(at, last)], _U(0))
        if step in steps:
            key = bytewords.mix(key + symbol)
            partial.append(key)
            if sieves is not None:
                on = np.flatnonzero(sieves[len(partial) - 1][(key & _U(SIEVE - 1)).astype(np.int64)])
                which, at, key, last, symbol, inside = which[on], at[on], key[on], last[on], symbol[on], inside[on]
        at += inside if turn >= ROUNDS else ((symbol * odd[step]) >> _U(63)).astype(np.int64) & inside
    return which, key, partial


def _sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(SIEVE, dtype=bool)
    out[(keys & _U(SIEVE - 1)).astype(np.int64)] = True
    return out


class Index:
    """The walks of a block of items from each of their words."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.ids = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        starts, lasts, item, offset, pairs, base = [], [], [], [], [], 0
        self.single = defaultdict(list)
        for i, j, h, pair, first, _ in _symbols(pa.array([t for _, t in items], pa.large_string())):
            for k in range(j - i):
                a, b = int(first[k]), int(first[k + 1])
                self.words.append(h[a:b])
                if b - a == 1:
                    self.single[int(h[a])].append(i + k)
                elif b > a:
                    n = b - a - 1
                    starts.append(base + a + np.arange(n))
                    lasts.append(np.full(n, base + b - 2))
                    item.append(np.full(n, i + k))
                    offset.append(np.arange(n))
            pairs.append(pair)
            base += len(pair)
        pair = np.concatenate(pairs) if pairs else np.zeros(0, dtype=np.uint64)
        none = [np.zeros(0, dtype=np.int64)]
        start, last = np.concatenate(starts or none), np.concatenate(lasts or none)
        self.item, self.offset = np.concatenate(item or none), np.concatenate(offset or none)
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        of_round = defaultdict(list)
        for n in np.unique(sizes[sizes > 1]).tolist():
            for r in rounds_of(n, rate):
                of_round[r].append(n)
        self.tables = []
        for (turn, steps), lengths in sorted(of_round.items()):
            mine = np.flatnonzero(np.isin(sizes[self.item], lengths))
            _, keys, partial = walk_keys(pair, start[mine], last[mine], turn, steps)
            order = np.argsort(keys, kind="stable")
            self.tables.append((turn, steps, _sieve(pair[start[mine]]), keys[order], mine[order], [_sieve(k) for k in partial]))
        self.alone = np.array(sorted(self.single), dtype=np.uint64)

    def candidates(self, h: np.ndarray, pair: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, item, offset of that word in the item) of colliding walks. last: of each word the last pair of its text."""
        found, low = [], (pair & _U(SIEVE - 1)).astype(np.int64)
        for turn, steps, begins, keys, order, sieves in self.tables:
            maybe = np.flatnonzero(begins[low])
            maybe = maybe[maybe <= last[maybe]]
            on, mine, _ = walk_keys(pair, maybe, last[maybe], turn, steps, sieves)
            a, b = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            n = b - a
            which = order[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if n.sum() else np.zeros(0, dtype=np.int64)
            found.append(np.stack([np.repeat(maybe[on], n), self.item[which], self.offset[which]]))
        lone = np.flatnonzero(np.isin(h, self.alone))
        extra = [(p, i, 0) for p in lone for i in self.single[int(h[p])]]
        found.append(np.array(extra, dtype=np.int64).reshape(-1, 3).T)
        return tuple(np.concatenate(found, axis=1))


def infix_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between the item and a stretch of the region, and that stretch: columns run over the region, rows over the item."""
    m = len(region)
    row, start = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1)
    place = np.arange(m + 1)
    for k, word in enumerate(item):
        change = row[:-1] + (region != word)
        drop = row[1:] + 1
        best = np.concatenate([[k + 1], np.minimum(change, drop)])
        origin = np.concatenate([[0], np.where(change <= drop, start[:-1], start[1:])])
        run = best - place  # an insertion costs 1 for each place to the right
        low = np.minimum.accumulate(run)
        at = np.maximum.accumulate(np.where(run == low, place, 0))
        row, start = low + place, origin[at]
    end = int(np.argmin(row))
    return int(row[end]), int(start[end]), end


def _scan(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, rate)
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for i, _, h, pair, first, w in _symbols(batch.column("text")):
                if not len(h):
                    continue
                last = (first[1:] - 2)[w.text]
                at, item, offset = index.candidates(h, pair, last)
                spots = np.unique(np.stack([w.text[at], item, (at - offset) >> 3], axis=1), axis=0)
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for doc, it, spot in spots.tolist():
                    words = index.words[it]
                    most = int(rate * len(words))
                    a = max(int(first[doc]), spot * 8 - most - 8)
                    b = min(int(first[doc + 1]), spot * 8 + 16 + len(words) + most)
                    if best.get((doc, it), (1,))[0] == 0 or len(words) - np.isin(words, h[a:b]).sum() > most:
                        continue  # each word of the item that the region lacks is an edit
                    d, s, e = infix_distance(words, h[a:b])
                    hit = (d, a + s - int(first[doc]), a + e - int(first[doc]))
                    if d <= most and hit < best.get((doc, it), (len(words) + 1, 0, 0)):
                        best[doc, it] = hit
                rows += [(ids[i + doc], index.ids[it], *hit, len(index.words[it])) for (doc, it), hit in best.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "first_word", "end_word", "item_words"])

    return run


SCHEMA = "doc_id long, item_id long, distance long, first_word long, end_word long, item_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document and benchmark item that a stretch of it repeats within rate * words of the item edits, by words.

    Words are runs of letters and digits, lower-cased. Items have a walk from each of their words, and documents from each word whose
    pair with the next one begins a walk of an item. How many steps of a walk are sampled, and how often, follows from the item's
    length (rounds_of): up to a rate of 0.25, each repeat within the rate has a colliding walk. It gives the place of a window as long
    as the item, whose edit distance is computed exactly. Items of one word match that word.

    Items come in blocks of at most BLOCK bytes, a pass over the documents for each, so what is sent to
    executors is bounded. Null and wordless texts and items match nothing; a null doc_id is reported as null. Repeated rows
    are reported each. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found, block, held = None, [], 0

    def add(found: DataFrame | None, block: list[tuple[int, str]]) -> DataFrame:
        hits = texts.mapInArrow(_scan(block, rate), SCHEMA)
        return hits if found is None else found.unionByName(hits)

    for row in benchmark.where("text is not null and item_id is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        held += len(row.text.encode())
        if held > BLOCK:
            found, block, held = add(found, block), [], 0
    return add(found, block) if block or found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without the rows that repeat an item; rows whose doc_id is null or repeats are judged each by its own text."""
    rows, key = Scratch(docs.sparkSession, "leaks").keyed(docs)
    hits = find_leaks(rows, benchmark, **options | {"id_col": key}).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(hits, key, "left_anti").select(*docs.columns)
