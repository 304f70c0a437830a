"""Quality classifier: a linear-chain conditional random field labels each line good or bad."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords

#: Bound of the fit: labelled documents of each class, each learnt whole. The chain is cut into runs of RUN lines while it descends.
DOCUMENTS, RUN = 1500, 128
ROUNDS, STEPS = 2, 120
#: Bytes whose features are held at once; each takes some 80 bytes.
CHUNK = 1 << 20


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars.encode())] = True
    return t


UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _table("0123456789")
MARKS = _table("$%&*#@^~<>{}[]\\/=+_|`")
LOUD = _table("!?")
STOPS = _table(".,;:")
BAR = _table("|")
N_FEATURES = 12


@dataclass
class Lines:
    features: np.ndarray  # a row per line
    chars: np.ndarray  # bytes of each line
    first: np.ndarray  # of each text its first line, and the end


def lines_of(data: np.ndarray, bounds: np.ndarray) -> Lines:
    """Features of each line that isn't blank, from its own bytes and words."""
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([bounds, breaks + 1, [0]]))
    if edges[-1] != len(data):
        edges = np.append(edges, len(data))
    begin, end = edges[:-1], edges[1:]
    w = bytewords.words(data, edges, bytewords.NOT_SPACE)
    per_line = np.diff(w.first)
    has = per_line > 0

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return (sums[end] - sums[begin]).astype(np.float64)

    h, size = w.hashes(), (w.end - w.start).astype(np.float64)
    n, chars = np.maximum(per_line, 1), np.maximum(end - begin, 1)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
    upper = np.concatenate([[0], np.cumsum(UPPER[data])])
    shout = ((upper[w.end] - upper[w.start]) >= 2).astype(np.float64)
    marks = np.concatenate([[0], np.cumsum(MARKS[data] | LOUD[data])])
    dirty = ((marks[w.end] - marks[w.start]) >= 1).astype(np.float64)
    by_line = lambda v: np.bincount(w.text, weights=v, minlength=len(begin)) / n
    distinct = np.unique(bytewords.mix(h + w.text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), return_index=True)[1]
    unique = np.bincount(w.text[distinct], minlength=len(begin)) / n
    mean = by_line(size)
    spread = np.sqrt(np.maximum(by_line(size**2) - mean**2, 0))
    features = np.stack([count(UPPER) / chars, count(DIGIT) / chars, count(MARKS) / chars, count(LOUD) / chars, count(STOPS) / n, count(BAR) / n, by_line(same), by_line(shout), by_line(dirty), unique, np.minimum(mean, 30) / 10 + spread / 10, np.log1p(n)], axis=1)
    kept = np.flatnonzero(has)
    return Lines(features[kept], (end - begin)[kept], np.searchsorted(begin[kept], bounds))


def with_neighbours(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after it in its text (zeros at the ends), and 1."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    starts = first[:-1][np.diff(first) > 0]
    before[starts] = 0
    after[(first[1:] - 1)[np.diff(first) > 0]] = 0
    return np.concatenate([f, before, after, np.ones((len(f), 1))], axis=1)


def forward_backward(node: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of 'good' for each line, and the expected number of each pair of neighbouring labels.

    node: score of good against bad, for each line; move[a, b]: score of b after a. All texts take step t together.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    start, count = first[:-1][order], count[order]
    alpha, beta = np.zeros((len(node), 2)), np.zeros((len(node), 2))
    alpha[:, 1] = node
    deepest = int(count[0]) if len(count) else 0
    active = [int(np.searchsorted(-count, -t, side="left")) for t in range(deepest)]
    for t in range(1, deepest):
        at = start[: active[t]] + t
        alpha[at] += np.logaddexp(alpha[at - 1][:, :1] + move[0], alpha[at - 1][:, 1:] + move[1])
    pairs = np.zeros((2, 2))
    whole = np.zeros(len(node))
    texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ends = (first[1:] - 1)[np.diff(first) > 0]
    total = np.zeros(len(first) - 1)
    total[np.diff(first) > 0] = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    whole = total[texts]
    for t in range(deepest - 1, 0, -1):
        at = start[: active[t]] + t
        ahead = beta[at].copy()
        ahead[:, 1] += node[at]
        beta[at - 1] = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
        for a in (0, 1):
            pairs[a] += np.exp(alpha[at - 1][:, a : a + 1] + move[a] + ahead - whole[at][:, None]).sum(0)
    return np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - whole, 0)), pairs


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    slope: float
    offset: float

    def text_quality(self, lines: Lines) -> np.ndarray:
        """The share of each text's bytes in good lines, as the marginals weigh it; 0 for texts without words."""
        x = with_neighbours((lines.features - self.mean) / self.scale, lines.first)
        good, _ = forward_backward(x @ self.weights, self.move, lines.first)
        sums = np.concatenate([[0.0], np.cumsum(good * lines.chars)])
        size = np.concatenate([[0.0], np.cumsum(lines.chars)])
        a, b = lines.first[:-1], lines.first[1:]
        return (sums[b] - sums[a]) / np.maximum(size[b] - size[a], 1)

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * quality + self.offset, -30, 30)))


def _descend(x: np.ndarray, y: np.ndarray, first: np.ndarray, weights: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the negative log likelihood of the line labels."""
    inner = np.ones(len(y), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(y[at - 1] * 2 + y[at], minlength=4).reshape(2, 2)
    theta = np.concatenate([weights, move.ravel()])
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), max(1, len(y))
    for step in range(1, STEPS + 1):
        good, pairs = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        grad = np.concatenate([x.T @ (good - y), (pairs - seen).ravel()]) / n + 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _calibrate(q: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset by Newton's method, with a small ridge."""
    x, t = np.stack([q, np.ones_like(q)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 0.01 * t
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        t = t - np.linalg.solve(hess, grad)
    return float(t[0]), float(t[1])


def fit(features: np.ndarray, chars: np.ndarray, first: np.ndarray, label: np.ndarray, prior: float) -> Model:
    """label: of each text. All lines of all texts are learnt; long chains descend in runs, the calibration sees them whole. Lines start with their text's label; in bad texts, lines that the model takes for good become good.

    prior: the share of good texts among all labelled ones, for the calibration.
    """
    mean, scale = features.mean(0), features.std(0) + 1e-6
    x = with_neighbours((features - mean) / scale, first)
    of_text = np.repeat(label, np.diff(first))
    inside = np.arange(len(features)) - np.repeat(first[:-1], np.diff(first))
    runs = np.append(np.flatnonzero(inside % RUN == 0), len(features))
    y, weights, move = of_text.copy(), np.zeros(x.shape[1]), np.zeros((2, 2))
    for turn in range(ROUNDS):
        weights, move = _descend(x, y, runs, weights, move)
        if turn + 1 < ROUNDS:
            good, _ = forward_backward(x @ weights, move, runs)
            y = np.where((of_text == 0) & (good > 0.5), 1, of_text)
            for a, b in zip(first[:-1], first[1:], strict=True):  # a bad text keeps a bad line
                if b > a and of_text[a] == 0 and y[a:b].all():
                    y[a + int(np.argmin(good[a:b]))] = 0
    model = Model(mean, scale, weights, move, 1.0, 0.0)
    q = model.text_quality(Lines(features, chars, first))
    share = max(label.mean(), 1e-6)
    weight = np.where(label == 1, prior / share, (1 - prior) / max(1 - share, 1e-6))
    model.slope, model.offset = _calibrate(q, label.astype(float), weight)
    return model


def _training_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, chars = [], []
        for _, _, data, bounds in bytewords.chunks(batch.column("text"), CHUNK):
            found = lines_of(data, bounds)
            for k in range(len(bounds) - 1):
                a, b = int(found.first[k]), int(found.first[k + 1])
                parts.append(found.features[a:b].ravel())
                chars.append(found.chars[a:b])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), bytewords.list_array(parts, pa.float64()), bytewords.list_array(chars, pa.int64())], names=["doc_id", "label", "features", "chars"])


def held_out(id_col: F.Column) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """(doc_id, label, text) of at most `per_class` rows of each class, the first in the order of a hash of doc_id, none held out; and the share of label 1."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    there = rows.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r.label: r.n for r in there.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    some = [there.where(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    chosen = some[0].unionByName(some[1])
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), prior  # at most 2 * per_class pairs of numbers


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = DOCUMENTS) -> Model:
    sample, prior = labelled_sample(docs, labels, "quality", per_class, id_col, text_col)
    rows = sample.select("doc_id", "label", "text").mapInArrow(_training_lines, "doc_id long, label int, features array<double>, chars array<long>").orderBy("doc_id").toArrow()
    if rows.num_rows == 0:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2)), 0.0, 0.0)
    chars = [np.array(c, dtype=np.int64) for c in rows.column("chars").to_pylist()]
    features = np.concatenate([np.array(f).reshape(-1, N_FEATURES) for f in rows.column("features").to_pylist()])
    first = np.concatenate([[0], np.cumsum([len(c) for c in chars])])
    return fit(features, np.concatenate(chars), first, rows.column("label").to_numpy().astype(np.int64), prior)


def _scorer(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(model.text_quality(lines_of(data, bounds))) for _, _, data, bounds in bytewords.chunks(batch.column(text_col), CHUNK)]
            columns = {n: batch.column(n) for n in batch.schema.names} | {"quality_score": pa.array(np.concatenate(scores) if scores else [], pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = DOCUMENTS, model: Model | None = None) -> DataFrame:
    """`docs` with the column quality_score, from 0 to 1; higher where a document is likelier to be good.

    The model is fitted on at most `per_class` labelled documents of each class, whole ones; rows whose crc32(doc_id as text) mod 3 is 1 are never
    learnt from. Every line of every document is labelled when scoring. A null or blank text has quality 0 before calibration.
    Without labelled rows every score is 0.5. Null doc_ids, repeated rows and empty tables are scored as they are; a column
    named quality_score is replaced, other columns pass through.
    """
    fitted = model or train(docs, labels, id_col=id_col, text_col=text_col, per_class=per_class)
    rows = docs.drop("quality_score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", quality_score double"
    return rows.mapInArrow(_scorer(fitted, text_col), schema)
