"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords
from .quality import labelled_sample
from .store import Scratch

#: Bounds of the fit: labelled documents of each class, and entries of the lexicon.
DOCUMENTS, ENTRIES = 3000, 2048
PREFIXES = (4, 5, 6)
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
CHUNK = 4 << 20
#: Words that address the reader, in the corpus's languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes tú ti tus su vosotros".split()
N_FEATURES = 14
_U = np.uint64


def _word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    return np.sort(bytewords.words(data, np.array([0, len(data)]), bytewords.ALNUM).hashes())


SECOND = _word_hashes(SECOND_PERSON)


def _keys(w: bytewords.Words) -> list[np.ndarray]:
    """Of each word: a key for itself and one for each prefix length (0 where the word is shorter)."""
    size = w.end - w.start
    out = [w.hashes()]
    for n in PREFIXES:
        out.append(np.where(size > n, bytewords.mix(w.hashes(n) + _U(n)), _U(0)))
    return out


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), dtype=np.int64) - 1
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def features(column: pa.Array, lexicon: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES numbers per text."""
    out = []
    upper = np.zeros(256, dtype=bool)
    upper[65:91] = True
    for i, j, data, bounds in bytewords.chunks(column, CHUNK):
        n = j - i
        low = bytewords.LOWER[data]
        w = bytewords.words(low, bounds, bytewords.ALNUM)
        count = np.bincount(w.text, minlength=n)
        words = np.maximum(count, 1)
        per = lambda v, t=w.text, n=n: np.bincount(t, weights=v, minlength=n)
        hits, sums = [], np.zeros(len(w.start))
        for key in _keys(w):
            at = _member(key, lexicon)
            hits.append(at >= 0)
            sums = np.maximum(sums, np.where(at >= 0, weight[np.maximum(at, 0)] if len(weight) else 0, 0))
        whole, stem = hits[0], np.any(hits[1:], axis=0)
        any_ = (whole | stem).astype(np.float64)
        second = _member(w.hashes(), SECOND) >= 0
        near = np.zeros(len(second), dtype=bool)
        for d in range(1, 4):
            near[d:] |= second[:-d] & (w.text[d:] == w.text[:-d])
            near[:-d] |= second[d:] & (w.text[d:] == w.text[:-d])
        run = np.concatenate([[0], np.cumsum(any_)])
        ahead = np.minimum(np.arange(len(any_)) + 20, w.first[1:][w.text]) if len(any_) else np.zeros(0, dtype=np.int64)
        burst = np.zeros(n)
        np.maximum.at(burst, w.text, run[ahead] - run[:-1])
        sizes = np.maximum(np.diff(bounds), 1)

        def share(mask: np.ndarray, b: np.ndarray = bounds, sizes: np.ndarray = sizes) -> np.ndarray:
            s = np.concatenate([[0], np.cumsum(mask)])
            return (s[b[1:]] - s[b[:-1]]) / sizes

        digits = np.concatenate([[0], np.cumsum((low >= 48) & (low <= 57))])
        inside = digits[w.end] - digits[w.start]
        mixed = ((inside > 0) & (inside < w.end - w.start)).astype(np.float64)
        joined = np.zeros(len(w.start))
        if len(w.start) > 1:
            gap = (w.start[1:] == w.end[:-1] + 1) & (w.text[1:] == w.text[:-1])
            between = low[np.minimum(w.end[:-1], len(low) - 1)]
            joined[1:] = gap & np.isin(between, np.frombuffer(b"*@$!#%&_", dtype=np.uint8))
        distinct = np.unique(bytewords.mix(w.hashes() + w.text.astype(np.uint64) * _U(0xD1342543DE82EF95)), return_index=True)[1]
        kinds = np.bincount(w.text[distinct], weights=any_[distinct], minlength=n)
        out.append(np.stack([per(whole), per(whole) / words, per(stem & ~whole), per(stem) / words, per(sums), per(sums) / words, kinds, burst, per(any_ * near), per(second) / words, share(upper[data]), share((data == 33) | (data == 63)), per(mixed + joined) / words, np.log1p(count)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, N_FEATURES))


@dataclass
class Trees:
    """Boosted trees of one depth: for each inner node a feature and a threshold, for each leaf a value."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            out += leaf[self._leaf(x, feature, cut)]
        return out

    @staticmethod
    def _leaf(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        return node - (2**DEPTH - 1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        """Newton boosting on the logistic loss; splits at quantiles of a feature."""
        share = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
        out = cls(base=float(np.log(share / (1 - share))))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(x), out.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (y - p), weight * p * (1 - p)
            feature, cut = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(DEPTH):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    at = np.flatnonzero(node == k)
                    best, whole = 1e-6, g[at].sum() ** 2 / (h[at].sum() + 1)
                    for f, c in enumerate(cuts):
                        gl = np.cumsum(np.bincount(binned[at, f], weights=g[at], minlength=len(c) + 1))
                        hl = np.cumsum(np.bincount(binned[at, f], weights=h[at], minlength=len(c) + 1))
                        if len(c):
                            gain = gl[:-1] ** 2 / (hl[:-1] + 1) + (gl[-1] - gl[:-1]) ** 2 / (hl[-1] - hl[:-1] + 1) - whole
                            b = int(np.argmax(gain))
                            if gain[b] > best:
                                best, feature[k], cut[k] = gain[b], f, c[b]
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            node -= 2**DEPTH - 1
            leaf = RATE * np.bincount(node, weights=g, minlength=2**DEPTH) / (np.bincount(node, weights=h, minlength=2**DEPTH) + 1)
            out.feature.append(feature)
            out.cut.append(cut)
            out.leaf.append(leaf)
            margin += leaf[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: increasing margins and the rate at each; scores in between are interpolated."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, t, w in zip(margin[order], y[order], weight[order], strict=True):
        blocks.append([m * w, t * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([b[0] / b[2] for b in blocks])
    rate = np.array([(b[1] + 0.05) / (b[2] + 0.1) for b in blocks])
    return at, np.maximum.accumulate(rate)


@dataclass
class Model:
    lexicon: np.ndarray
    weight: np.ndarray
    trees: Trees
    at: np.ndarray
    rate: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        margin = self.trees.margin(features(column, self.lexicon, self.weight))
        if not len(self.at):
            return np.full(len(margin), 0.5)
        # within a step of the isotonic curve the margin still orders
        return np.clip(0.999 * np.interp(margin, self.at, self.rate) + 0.001 / (1 + np.exp(-margin)), 0, 1)


def _document_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each key of the batch, the toxic documents and the documents that have it."""
    for batch in batches:
        label = batch.column("label").to_numpy()
        keys, toxic = [], []
        for i, _, data, bounds in bytewords.chunks(batch.column("text"), CHUNK):
            w = bytewords.words(bytewords.LOWER[data], bounds, bytewords.ALNUM)
            for key in _keys(w):
                rows = np.unique(np.stack([key[key != 0], w.text[key != 0].astype(np.uint64)], axis=1), axis=0)
                keys.append(rows[:, 0])
                toxic.append(label[i + rows[:, 1].astype(np.int64)])
        key, back = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        docs = np.bincount(back, minlength=len(key))
        hits = np.bincount(back, weights=np.concatenate(toxic) if keys else None, minlength=len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(hits), pa.array(docs.astype(np.int64))], names=["key", "toxic", "docs"])


def _featured(lexicons: list[tuple[np.ndarray, np.ndarray]]):
    """Features by the lexicon of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, text = batch.column("half").to_numpy(), batch.column("text")
            rows = np.zeros((len(half), N_FEATURES))
            for k in (0, 1):
                at = np.flatnonzero(half == k)
                rows[at] = features(text.take(pa.array(at)), *lexicons[1 - k])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("half"), bytewords.list_array(list(rows), pa.float64())], names=["doc_id", "label", "half", "features"])

    return run


def _lexicon(found: DataFrame, bad: int, good: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that toxic documents have far more often than others, with the log of how much more."""
    lift = F.log(((F.col("toxic") + 0.5) / (bad + 1)) / ((F.col("docs") - F.col("toxic") + 0.5) / (good + 1)))
    found = found.withColumn("lift", lift).where((F.col("toxic") >= max(3, 0.01 * bad)) & (F.col("lift") > 2))
    entries = found.orderBy(F.desc("lift"), "key").limit(ENTRIES).select("key", "lift").toArrow()
    key, weight = entries.column("key").to_numpy().view(np.uint64), entries.column("lift").to_numpy()
    order = np.argsort(key)
    return key[order], weight[order]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = DOCUMENTS) -> Model:
    """The sample has two halves, by a hash of the text. A half's features come from the other half's lexicon and its margins for the
    calibration from the other half's trees; the model itself has the lexicon and the trees of the whole sample."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample, prior = labelled_sample(docs, labels, "toxic", per_class, id_col, text_col)
    sample = scratch.keep(sample.select("doc_id", F.col("label").cast("int").alias("label"), "text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")), "sample")
    first = sample.select("label", "half", "text").dropDuplicates(["text"])
    total = {(r.half, r.label): r.n for r in first.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    bad, good = ([total.get((h, c), 0) for h in (0, 1)] for c in (1, 0))
    if not (all(bad) and all(good)):
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), Trees(), np.zeros(0), np.zeros(0))
    keys = [first.where(F.col("half") == h).mapInArrow(_document_keys, "key long, toxic long, docs long").withColumn("half", F.lit(h)) for h in (0, 1)]
    sums = [F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs")]
    found = scratch.keep(keys[0].unionByName(keys[1]).groupBy("key", "half").agg(*sums).where("toxic > 0"), "keys")
    halves = [_lexicon(found.where(F.col("half") == h), bad[h], good[h]) for h in (0, 1)]
    key, weight = _lexicon(found.groupBy("key").agg(*sums), sum(bad), sum(good))
    rows = sample.mapInArrow(_featured(halves), "doc_id long, label int, half int, features array<double>").orderBy("doc_id").toArrow()
    scratch.drop()
    x, y = np.array(rows.column("features").to_pylist()), rows.column("label").to_numpy().astype(float)
    half, share = rows.column("half").to_numpy(), y.mean()
    natural = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    margin = np.zeros(len(y))
    for h in (0, 1):
        margin[half == h] = Trees.fit(x[half != h], y[half != h], np.ones(int((half != h).sum()))).margin(x[half == h])
    at, rate = isotonic(margin, y, natural)
    return Model(key, weight, Trees.fit(x, y, np.ones(len(y))), at, rate)


def _scorer(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names} | {"toxicity": pa.array(model.score(batch.column(text_col)), pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = DOCUMENTS, model: Model | None = None) -> DataFrame:
    """`docs` with the column toxicity, from 0 to 1; higher where a document is likelier to be toxic.

    Fitted on at most `per_class` labelled documents of each class, none with crc32(doc_id as text) mod 3 = 1; every text is scored
    whole. A null text is scored as an empty one. Without labels of both classes every score is 0.5. Null doc_ids, repeated rows
    and empty tables are scored as they are; a column named toxicity is replaced, other columns pass through.
    """
    fitted = model or train(docs, labels, id_col=id_col, text_col=text_col, per_class=per_class)
    rows = docs.drop("toxicity")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", toxicity double"
    return rows.mapInArrow(_scorer(fitted, text_col), schema)
